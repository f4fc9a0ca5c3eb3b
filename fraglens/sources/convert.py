"""From alignment files to fragment files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraglens.operators.alignments import fragments_paired, fragments_single, usable, with_barcode
from fraglens.sources.bam import BamSource
from fraglens.sources.sinks import write_fragments


def make_fragment_file(spark: SparkSession, bam: str | list[str], path: str, tag: str | None = None, regex: str | None = None, paired: bool = True, min_mapq: int | None = 30, compression: str | None = "gzip") -> DataFrame:
    """Writes the fragments of BAM files to the folder path and returns them; barcodes come from a tag or from names."""
    if (tag is None) == (regex is None):
        raise ValueError("give a tag or a regex")
    spark.dataSource.register(BamSource)
    reads = spark.read.format("bam").load(bam if isinstance(bam, str) else ",".join(bam))
    reads = reads.withColumn("barcode", F.try_element_at("tags", F.lit(tag))) if tag else with_barcode(reads, regex)
    frags = (fragments_paired if paired else fragments_single)(usable(reads, paired, min_mapq))
    write_fragments(frags, path, compression)
    return frags
