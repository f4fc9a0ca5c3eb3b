"""Queries over the synthetic tables: one opN_<name> for each training-data operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sorted_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fraglens.llm.topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", 5)


def op2_product_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fraglens.llm.pq_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fraglens.llm.simhash import simhash_components

    return simhash_components(_table(spark, sf_dir, "documents"))


def op4_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fraglens.llm.suffix_dedup import cut_repeats

    return cut_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), words=51)


def op5_private_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fraglens.llm.pii import find_private

    return find_private(_table(spark, sf_dir, "documents"))


def op6_toxic_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fraglens.llm.toxicity import score_toxicity

    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fraglens.llm.sharding import shard_documents

    return shard_documents(_table(spark, sf_dir, "documents"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fraglens.llm.pieces import encode_documents

    return encode_documents(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op9_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fraglens.llm.quality import score_quality

    return score_quality(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op10_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fraglens.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_sorted_lists, op2_product_quantisation, op3_simhash, op4_suffix_arrays, op5_private_contexts, op6_toxic_lexicon, op7_virtual_slots, op8_pieces, op9_weak_labels, op10_pattern_packing)}
_FINITE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"

#: SQL for DuckDB where it can express a query; hashes of shingles, byte windows, tokenizers and learnt models it can't.
ORACLE_SQL: dict[str, str] = {
    "op1_sorted_lists": f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE {_FINITE}),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5""",
    "op2_product_quantisation": f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE {_FINITE}),
n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM v WHERE list_inner_product(v, v) > 0),
l AS (SELECT a.vec_id AS i, b.vec_id AS j FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE list_inner_product(a.v, b.v) / (a.n * b.n) >= 0.9),
r AS (SELECT vec_id AS i, vec_id AS j FROM embeddings UNION SELECT r.i, l.j FROM r JOIN l ON r.j = l.i),
c AS (SELECT i, min(j) AS component_id FROM r GROUP BY 1), d AS (SELECT i, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(d.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON vec_id = c.i LEFT JOIN d ON vec_id = d.i""",
}
