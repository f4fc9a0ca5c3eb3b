"""Domain tables derived from the star-schema tables, in Spark and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_START = "(l_partkey*7919 + l_orderkey*104729 + l_linenumber*31) % 99000"


def frag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of 97 cells; a bag. strand is null (paired)."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('chr', cast(1 + l_suppkey % 5 as string)) as chrom",
        f"{_START} as start",
        f"{_START} + 20 + (l_orderkey*13 + l_partkey*7) % 600 as end",
        "concat('BC', lpad(cast(l_orderkey % 97 as string), 4, '0')) as barcode",
        "cast(1 + l_linenumber % 3 as int) as count",
        "cast(null as string) as strand",
    )


def frag_peaked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fragments, half of them moved to lie around 20 spots of each chromosome, 4 900 bases apart."""
    spot = "4900 * (l_orderkey % 20) + 1000 + (l_partkey % 60)"
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('chr', cast(1 + l_suppkey % 5 as string)) as chrom",
        f"case when l_linenumber % 2 = 0 then {spot} else {_START} end as start",
        f"case when l_linenumber % 2 = 0 then {spot} + 60 else {_START} + 20 + (l_orderkey*13 + l_partkey*7) % 600 end as end",
        "concat('BC', lpad(cast(l_orderkey % 97 as string), 4, '0')) as barcode",
        "cast(1 + l_linenumber % 3 as int) as count",
        "cast(null as string) as strand",
    )


def frag_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fragments as single-end ones."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('chr', cast(1 + l_suppkey % 5 as string)) as chrom",
        f"{_START} as start",
        f"{_START} + 20 + (l_orderkey*13 + l_partkey*7) % 600 as end",
        "concat('BC', lpad(cast(l_orderkey % 97 as string), 4, '0')) as barcode",
        "cast(1 + l_linenumber % 3 as int) as count",
        "case when l_linenumber % 2 = 0 then '+' else '-' end as strand",
    )


def chroms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").selectExpr("r_regionkey as ord", "concat('chr', cast(1 + r_regionkey as string)) as chrom", "cast(100000 + r_regionkey*1000 as bigint) as length")


def peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("concat('chr', cast(1 + p_partkey % 5 as string)) as chrom", "(p_partkey*48271) % 99000 as start", "(p_partkey*48271) % 99000 + 100 + p_size*10 as end", "p_partkey as region_id", "cast(p_retailprice as double) as p_value")


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey as tx_id", "concat('G', cast(c_custkey % 400 as string)) as gene", "concat('chr', cast(1 + c_nationkey % 5 as string)) as chrom", "3000 + (c_custkey*69621) % 93000 as left", "3000 + (c_custkey*69621) % 93000 + 500 + c_custkey % 1500 as right", "case when c_custkey % 2 = 0 then '+' else '-' end as strand")


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-base values (methylation)."""
    return table(spark, sf_dir, "lineitem").selectExpr("concat('BC', lpad(cast(l_orderkey % 97 as string), 4, '0')) as barcode", "concat('chr', cast(1 + l_suppkey % 5 as string)) as chrom", f"{_START} as pos", "cast(l_quantity as int) % 7 as methyl", "cast(l_quantity as int) % 7 + l_linenumber - 1 as total")


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("concat('BC', lpad(cast(l_orderkey % 97 as string), 4, '0')) as barcode", "concat('chr', cast(1 + l_suppkey % 5 as string)) as chrom1", f"{_START} as start1", "concat('chr', cast(1 + l_partkey % 5 as string)) as chrom2", "(l_partkey*48271) % 99000 as start2", "cast(1 + l_linenumber % 3 as int) as count")


def cell_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(barcode, group): four groups of cells."""
    return frag(spark, sf_dir).select("barcode").distinct().selectExpr("barcode", "concat('g', cast(cast(substr(barcode, 3) as int) % 4 as string)) as group")


def coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings in long form: (row, column, value)."""
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id as row", "posexplode(embedding) as (column, value)").selectExpr("row", "column", "cast(value as double) as value")


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with SAM fields: two per line item, as a pair."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('BC', lpad(cast(l_orderkey % 97 as string), 4, '0'), ':', cast(l_orderkey as string), '.', cast(l_linenumber as string), '.', cast(l_partkey as string), '.', cast(l_suppkey as string)) as name",
        f"{_START} as base", "l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "explode(array(1, 2)) as mate",
    ).selectExpr(
        "name",
        "cast(case when mate = 1 then 99 else 147 end + case when l_partkey % 11 = 0 then 1024 else 0 end + case when l_partkey % 13 = 0 then 256 else 0 end as int) as flag",
        "cast((l_partkey + l_suppkey) % 61 as int) as mapq",
        "concat('chr', cast(1 + l_suppkey % 5 as string)) as chrom",
        "case when mate = 1 then base % 500 else base % 500 + 150 end as pos",
        "case when l_linenumber % 2 = 0 then '50M' when mate = 1 then '5S45M' else '45M5S' end as cigar",
        "cast(1000 + (l_orderkey*31 + l_partkey*17 + mate*7) % 900 as bigint) as quality",
    )


_BC = "concat('BC', lpad(CAST(l_orderkey % 97 AS VARCHAR), 4, '0'))"
SQL = {
    "frag": f"frag AS (SELECT concat('chr', CAST(1 + l_suppkey % 5 AS VARCHAR)) AS chrom, {_START} AS start, {_START} + 20 + (l_orderkey*13 + l_partkey*7) % 600 AS \"end\", {_BC} AS barcode, CAST(1 + l_linenumber % 3 AS INTEGER) AS cnt, CASE WHEN l_linenumber % 2 = 0 THEN '+' ELSE '-' END AS strand1 FROM lineitem)",
    "chroms": "chroms AS (SELECT r_regionkey AS ord, concat('chr', CAST(1 + r_regionkey AS VARCHAR)) AS chrom, CAST(100000 + r_regionkey*1000 AS BIGINT) AS length FROM region)",
    "peak": "peak AS (SELECT concat('chr', CAST(1 + p_partkey % 5 AS VARCHAR)) AS chrom, (p_partkey*48271) % 99000 AS start, (p_partkey*48271) % 99000 + 100 + p_size*10 AS \"end\", p_partkey AS region_id, CAST(p_retailprice AS DOUBLE) AS p_value FROM part)",
    "tx": "tx AS (SELECT c_custkey AS tx_id, concat('G', CAST(c_custkey % 400 AS VARCHAR)) AS gene, concat('chr', CAST(1 + c_nationkey % 5 AS VARCHAR)) AS chrom, 3000 + (c_custkey*69621) % 93000 AS \"left\", 3000 + (c_custkey*69621) % 93000 + 500 + c_custkey % 1500 AS \"right\", CASE WHEN c_custkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM customer)",
    "vals": f"vals AS (SELECT {_BC} AS barcode, concat('chr', CAST(1 + l_suppkey % 5 AS VARCHAR)) AS chrom, {_START} AS pos, CAST(l_quantity AS INTEGER) % 7 AS methyl, CAST(l_quantity AS INTEGER) % 7 + l_linenumber - 1 AS total FROM lineitem)",
    "ins": 'ins AS (SELECT barcode, chrom, start AS pos FROM frag UNION ALL SELECT barcode, chrom, "end" - 1 FROM frag)',
    "grp": "grp AS (SELECT DISTINCT barcode, concat('g', CAST(CAST(substr(barcode, 3) AS INTEGER) % 4 AS VARCHAR)) AS \"group\" FROM frag)",
    "coords": 'coords AS (SELECT vec_id AS "row", CAST(unnest(range(len(embedding))) AS INTEGER) AS "column", CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)',
    "tiles": "tiles AS (SELECT barcode, chrom, tile, count(*) AS value FROM (SELECT barcode, chrom, start // 500 AS tile FROM frag UNION ALL SELECT barcode, chrom, (\"end\" - 1) // 500 FROM frag WHERE (\"end\" - 1) // 500 <> start // 500) GROUP BY ALL)",
    "cont": f"cont AS (SELECT {_BC} AS barcode, concat('chr', CAST(1 + l_suppkey % 5 AS VARCHAR)) AS chrom1, {_START} AS start1, concat('chr', CAST(1 + l_partkey % 5 AS VARCHAR)) AS chrom2, (l_partkey*48271) % 99000 AS start2, CAST(1 + l_linenumber % 3 AS INTEGER) AS cnt FROM lineitem)",
}


def with_sql(names: str, query: str) -> str:
    """A SQL text with the named derived tables before it."""
    return f"WITH {', '.join(SQL[n] for n in names.split())} {query}"
