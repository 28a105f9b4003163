"""Reads made from the driver's table of orders by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basewright.shared import fresh_path

_COMMON = """WITH b AS (
  SELECT CAST(o_orderkey AS BIGINT) AS read_idx, CAST(o_orderkey AS {S}) AS k,
         CAST(o_orderkey % 49 AS INT) AS m49, CAST(o_orderkey % 67 AS INT) AS m67 FROM orders),
f AS (
  SELECT read_idx, k, 80 + m49 AS flen, 30 + m67 AS rlen,
    concat(translate(md5(concat('a',k)),'0123456789abcdef','ACGTACGTACGTACGN'),
           translate(md5(concat('b',k)),'0123456789abcdef','ACGTACGTACGTACGT'),
           translate(md5(concat('c',k)),'0123456789abcdef','ACGTACGTACGTACGT'),
           translate(md5(concat('d',k)),'0123456789abcdef','ACGTACGTACGTACGN')) AS frag,
    concat(translate(md5(concat('x',k)),'0123456789abcdef','ACGTACGTACGTACGT'),
           translate(md5(concat('y',k)),'0123456789abcdef','ACGTACGTACGTACGT'),
           translate(md5(concat('z',k)),'0123456789abcdef','ACGTACGTACGTACGT')) AS other,
    translate(concat(md5(concat('e',k)),md5(concat('f',k)),md5(concat('g',k))),'0123456789abcdef',
      CASE WHEN read_idx % 3 = 0 THEN '#+5:?BDEFGHIIIII' ELSE '5:?BDEFGHIIIIIII' END) AS q1,
    translate(concat(md5(concat('i',k)),md5(concat('j',k)),md5(concat('l',k))),'0123456789abcdef',
      CASE WHEN read_idx % 5 = 0 THEN '#+5:?BDEFGHIIIII' ELSE '5:?BDEFGHIIIIIII' END) AS q2 FROM b),
reads AS (
SELECT read_idx, CASE WHEN read_idx % 4 = 0 THEN concat('read_',k) ELSE concat('read_',k,' lane:',CAST(read_idx % 8 AS {S}),' x') END AS id,
 CASE WHEN read_idx % 6 = 0 THEN concat(substr(frag,1,rlen-10),'AGATCGGAAG') WHEN read_idx % 6 = 1 THEN concat(substr(frag,1,rlen-10),'AGATCGGTAG') ELSE substr(frag,1,rlen) END AS seq,
 substr(q1,1,rlen) AS qual FROM f),
pairs AS (
SELECT read_idx, concat('pair_',k) AS id1, CASE WHEN read_idx % 4 = 0 THEN concat('only2_',k) ELSE concat('pair_',k) END AS id2,
 substr(frag,1,80) AS seq1, substr(q1,1,80) AS qual1,
 translate(reverse(CASE WHEN read_idx % 10 = 0 THEN substr(other,1,80) WHEN read_idx % 3 = 0 THEN replace(substr(frag,flen-79,80),'ACG','ATG') ELSE substr(frag,flen-79,80) END),'ACGT','TGCA') AS seq2,
 substr(q2,1,80) AS qual2 FROM f),
tagged AS (
SELECT read_idx, id1, id2, seq1, qual1, concat(seq2, CASE read_idx % 5 WHEN 0 THEN reverse('CAGGGTTC') WHEN 1 THEN reverse('GGCCAACGG') WHEN 2 THEN reverse('CGTTAAGGA') ELSE '' END) AS seq2,
 concat(qual2, CASE read_idx % 5 WHEN 0 THEN 'IIIIIIII' WHEN 1 THEN 'IIIIIIIII' WHEN 2 THEN 'IIIIIIIII' ELSE '' END) AS qual2 FROM pairs)
"""

ADAPTERS = ["AGATCGGAAG"]
BARCODES = [("CAGGGTTC", "indv1"), ("GAACGCTC", "indv2"), ("GGCCAACGG", "indv3"), ("CGTTAAGGG", "indv4")]


def oracle(select: str) -> str:
    """DuckDB SQL with the tables reads, pairs and tagged."""
    return _COMMON.replace("{S}", "VARCHAR") + select


#: Tables written by `keep`, by folder of the driver's tables and name.
_KEPT: dict[tuple[str, str], str] = {}


def keep(spark: SparkSession, sf_dir: str, name: str) -> None:
    """Write one of those tables, a file for each core, so that queries read it instead of deriving it each time (for timings)."""
    path = fresh_path(spark, name)
    made(spark, sf_dir, name).repartitionByRange(spark.sparkContext.defaultParallelism, "read_idx").sortWithinPartitions("read_idx").write.parquet(path)
    _KEPT[sf_dir, name] = path


def made(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of those tables."""
    if (sf_dir, name) in _KEPT:
        return spark.read.parquet(_KEPT[sf_dir, name])
    sql = _COMMON.replace("{S}", "STRING").replace("FROM orders", "FROM {orders}")
    return spark.sql(sql + f"SELECT * FROM {name}", orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


def mates(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two files of a table of pairs."""
    one, two = (pairs.selectExpr("read_idx", f"id{m} AS id", f"seq{m} AS seq", f"qual{m} AS qual") for m in (1, 2))
    return one, two
