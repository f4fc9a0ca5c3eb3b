"""A data source for BAM files: spark.read.format("bam").load(path) gives the alignment table.

A BAM file is a series of BGZF blocks, each of which is a gzip member; a file is one partition, since records cross
blocks. Register with spark.dataSource.register(BamSource).
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "name string, flag int, mapq int, chrom string, pos long, cigar string, quality long, mate_chrom string, mate_pos long, seq string, tags map<string,string>"
_CIGAR = "MIDNSHP=X"
_BASES = "=ACMGRSVTWYHKDBN"
_SIZES = {"c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4, "A": 1}
#: Bases of at least this quality count towards the quality of a read.
GOOD_BASE = 15


def _tags(raw: bytes) -> dict[str, str]:
    out, at = {}, 0
    while at + 3 <= len(raw):
        name, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind in "ZH":
            end = raw.index(0, at)
            out[name] = raw[at:end].decode()
            at = end + 1
        elif kind == "B":
            at += 5 + struct.unpack_from("<i", raw, at + 1)[0] * _SIZES[chr(raw[at])]
        else:
            if kind == "A":
                out[name] = chr(raw[at])
            at += _SIZES[kind]
    return out


def records(path: str) -> Iterator[tuple]:
    with gzip.open(path, "rb") as f:
        if f.read(4) != b"BAM\1":
            raise ValueError(f"{path} is not a BAM file")
        f.read(struct.unpack("<i", f.read(4))[0])
        names: list[str | None] = []
        for _ in range(struct.unpack("<i", f.read(4))[0]):
            names.append(f.read(struct.unpack("<i", f.read(4))[0])[:-1].decode())
            f.read(4)
        names.append(None)  # index -1
        while size := f.read(4):
            r = f.read(struct.unpack("<i", size)[0])
            ref, pos, l_name, mapq, _, n_cigar, flag, l_seq, mate, mate_pos, _ = struct.unpack_from("<iiBBHHHiiii", r)
            at = 32 + l_name
            ops = struct.unpack_from(f"<{n_cigar}I", r, at)
            at += 4 * n_cigar
            packed = r[at : at + (l_seq + 1) // 2]
            at += (l_seq + 1) // 2
            qual = r[at : at + l_seq]
            seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:l_seq]
            good = sum(q for q in qual if GOOD_BASE <= q < 255)
            yield (r[32 : 32 + l_name - 1].decode(), flag, None if mapq == 255 else mapq, names[ref], pos, "".join(f"{o >> 4}{_CIGAR[o & 15]}" for o in ops), good, names[mate], mate_pos, seq, _tags(r[at + l_seq :]))


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from records(partition.value)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"].split(","))
