"""Sharding by fixed virtual slots with a versioned slot-to-shard map.

A record is hashed into one of a fixed number of virtual slots. Bytes are summed per slot, and a map from slots
to shards is stored with a version; rebalancing edits the map (whole slots move), never the hash.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fraglens.llm.common import materialise, scratch_dir

SLOTS = 4096
SHARDS = 24


@dataclass(frozen=True)
class SlotMap:
    """shard[i] is the shard of slot i; version counts the edits."""

    version: int
    shard: np.ndarray

    @staticmethod
    def initial(slots: int, shards: int) -> SlotMap:
        return SlotMap(1, np.arange(slots) % shards)

    def loads(self, slot_bytes: np.ndarray, shards: int) -> np.ndarray:
        return np.bincount(self.shard, weights=slot_bytes, minlength=shards).astype(np.int64)

    def rebalanced(self, slot_bytes: np.ndarray, shards: int, swaps: int = 2000) -> SlotMap:
        """The next version: overfull shards give up slots, the emptiest take them, then pairs are exchanged.

        With more shards than before the new ones start empty; with fewer, the slots of those that go are dealt out.
        Slots that need not move stay.
        """
        shard, size = self.shard.copy(), np.asarray(slot_bytes, dtype=np.int64)
        target = int(size.sum()) / shards
        freed: list[int] = np.flatnonzero(shard >= shards).tolist()
        load = np.bincount(shard, weights=size, minlength=shards).astype(np.int64)[:shards]
        for s in np.flatnonzero(load > target):
            own = np.flatnonzero(shard == s)
            for i in own[np.argsort(-size[own], kind="stable")]:  # the largest that fit, so that few move
                if size[i] and load[s] - size[i] >= target:
                    load[s] -= size[i]
                    freed.append(int(i))
        heap = [(int(load[s]), s) for s in range(shards)]
        heapq.heapify(heap)
        for i in sorted(freed, key=lambda i: (-int(size[i]), i)):
            least, s = heapq.heappop(heap)
            shard[i] = s
            heapq.heappush(heap, (least + int(size[i]), s))
        load = np.bincount(shard, weights=size, minlength=shards).astype(np.int64)
        for _ in range(swaps):
            hi, lo = int(load.argmax()), int(load.argmin())
            gap = int(load[hi] - load[lo])
            a, b = np.flatnonzero(shard == hi), np.flatnonzero(shard == lo)
            order = np.argsort(size[b], kind="stable")
            give = np.concatenate([[0], size[b][order]])
            at = np.clip(np.searchsorted(give, size[a] - gap / 2), 0, len(give) - 1)
            gain = size[a] - give[at]
            ok = (gain > 0) & (gain < gap)
            if not ok.any():
                break
            k = int(np.flatnonzero(ok)[np.argmin(np.abs(gain[ok] - gap / 2))])
            shard[a[k]] = lo
            if at[k]:
                shard[b[order[at[k] - 1]]] = hi
            load[hi] -= gain[k]
            load[lo] += gain[k]
        return SlotMap(self.version + 1, shard)

    def store(self, spark: SparkSession, path: str) -> None:
        """Append this version to the map table at path: (version, slot, shard)."""
        rows = [(self.version, i, int(s)) for i, s in enumerate(self.shard)]
        spark.createDataFrame(rows, "version int, virtual_slot int, shard int").coalesce(1).write.mode("append").parquet(path)


    @staticmethod
    def latest(spark: SparkSession, path: str) -> SlotMap | None:
        """The last version that was stored at path; None if there is none."""
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            return None
        rows = stored_map(spark, path).orderBy("virtual_slot").collect()  # one for each slot
        return SlotMap(rows[0].version, np.array([r.shard for r in rows], dtype=np.int64)) if rows else None


def stored_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The given version of a stored map, or its latest."""
    table = spark.read.schema("version int, virtual_slot int, shard int").parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return table.where(F.col("version") == version)


def slot_records(records: DataFrame, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """Adds virtual_slot to records (id, size, group): equal groups share a slot.

    Only a group that holds more bytes than a shard's equal part, and so fits no shard, has its rows salted by their
    id. There are fewer than `shards` such groups, which bounds the broadcast table.
    """
    total = records.agg(F.sum("size")).first()[0] or 0
    hot = records.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("bytes") > F.lit(total / shards))).select("group", F.lit(True).alias("hot"))
    salted = F.when(F.col("hot"), F.xxhash64("group", "id")).otherwise(F.col("group"))
    return records.join(F.broadcast(hot), "group", "left").withColumn("virtual_slot", F.pmod(salted, F.lit(slots)).cast("int")).drop("hot")


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version for each row of docs.

    Law `bytes`: the shards' sizes are near equal. size is the text's UTF-8 bytes plus 8 (a null text has none);
    text_crc32 of a null or empty text is 0; slot is the row's place in its shard, gapless from 0. Equal texts
    share a virtual slot, and so a shard, unless they hold more than a shard's equal part together. The latest map at
    map_path is edited and stored as the next version; without one (or without a path) the slots are first dealt in
    turn. Null ids are hashed like any other value; repeated rows each keep a place; texts count whole, however long;
    other columns play no part; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = materialise(docs.select(F.col("doc_id").alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("group")))
    slotted = slot_records(narrow, slots, shards)
    stats = slotted.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()  # at most `slots` rows
    sizes, counts = np.zeros(slots, dtype=np.int64), np.zeros(slots, dtype=np.int64)
    for r in stats:
        sizes[r.virtual_slot], counts[r.virtual_slot] = r.bytes, r.n
    path = map_path or scratch_dir(spark)
    first = SlotMap.latest(spark, path)
    if first is None:
        first = SlotMap.initial(slots, shards)
        first.store(spark, path)
    if len(first.shard) != slots:
        raise ValueError(f"the map at {path} has {len(first.shard)} slots, not {slots}")
    now = first.rebalanced(sizes, shards)
    now.store(spark, path)
    base = np.zeros(slots, dtype=np.int64)
    for s in range(shards):
        own = np.flatnonzero(now.shard == s)
        base[own] = np.cumsum(counts[own]) - counts[own]
    places = spark.createDataFrame([(i, int(b)) for i, b in enumerate(base)], "virtual_slot int, base long")
    table = stored_map(spark, path, now.version).join(places, "virtual_slot")
    within = Window.partitionBy("virtual_slot").orderBy("id", "group", "size")
    return slotted.withColumn("at", F.row_number().over(within)).join(F.broadcast(table), "virtual_slot").select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("at") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version")
    )
