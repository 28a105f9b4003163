"""Statistics over reads; each pre-aggregates in the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from basewright.functions import exprs as X
from basewright.functions.exprs import C
from basewright.schema import BASES, check_offset

QUALITIES = 5, 10, 15, 20, 30


def _bases() -> list:
    return [F.coalesce(F.sum(X.count_of(C.seq, b)), F.lit(0)).alias(b.lower()) for b in BASES]


def size(reads: DataFrame) -> DataFrame:
    """reads, bases (of the five letters) and a count for each letter."""
    one = reads.agg(F.count(F.lit(1)).alias("reads"), *_bases())
    return one.select("reads", sum((F.col(b.lower()) for b in BASES[1:]), F.col("a")).alias("bases"), *[b.lower() for b in BASES])


def summary(reads: DataFrame, phred: int = 33) -> DataFrame:
    """Lengths, GC percentage, base counts with percentages, and bases above each quality with percentages."""
    check_offset(phred)
    total = [F.coalesce(F.sum(X.quality_at_least(C.qual, q, phred)), F.lit(0)).alias(f"q{q}") for q in QUALITIES]
    n = F.length(C.seq).cast("long")
    one = reads.agg(F.count(F.lit(1)).alias("reads"), F.coalesce(F.sum(n), F.lit(0)).alias("bases"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), *_bases(), *total)
    share = lambda x: F.try_divide(100.0 * x, F.col("bases").cast("double"))
    names = [b.lower() for b in BASES] + [f"q{q}" for q in QUALITIES]
    return one.select(
        "reads", "bases", "min_length", "max_length",
        F.try_divide(F.col("bases").cast("double"), F.col("reads").cast("double")).alias("mean_length"),
        share(F.col("g") + F.col("c")).alias("gc_pct"),
        *names,
        *[share(F.col(x)).alias(f"{x}_pct") for x in names],
    )


def _cycles(reads: DataFrame, column: str, name: str) -> DataFrame:
    rows = reads.where(F.length(column) > 0).select(F.posexplode(X.letters(F.col(column))).alias("place", name))
    return rows.select((F.col("place") + 1).alias("cycle"), name)


def cycle_bases(reads: DataFrame) -> DataFrame:
    """Counts of each letter by place in the read, with percentages of the five."""
    counts = _cycles(reads, "seq", "base").groupBy("cycle").agg(*[F.count_if(F.col("base") == b).alias(b.lower()) for b in BASES])
    total = sum((F.col(b.lower()) for b in BASES[1:]), F.col("a"))
    return counts.select("*", *[F.try_divide(100.0 * F.col(b.lower()), total.cast("double")).alias(f"{b.lower()}_pct") for b in BASES])


def cycle_qualities(reads: DataFrame, phred: int = 33) -> DataFrame:
    """How many reads have each quality at each place."""
    check_offset(phred)
    return _cycles(reads, "qual", "letter").groupBy("cycle", (F.ascii("letter") - phred).alias("q")).agg(F.count(F.lit(1)).alias("n"))


def lengths(reads: DataFrame) -> DataFrame:
    return reads.groupBy(F.length(C.seq).alias("length")).agg(F.count(F.lit(1)).alias("n"))


def gc_histogram(reads: DataFrame) -> DataFrame:
    """101 rows: reads by GC percentage, and their share in percent to two places."""
    counts = reads.groupBy(X.gc_bucket(C.seq).alias("gc")).agg(F.count(F.lit(1)).alias("n"))
    every = reads.sparkSession.range(0, 101, 1, 1).select(F.col("id").cast("int").alias("gc"))
    filled = every.join(counts, "gc", "left").withColumn("total", F.sum("n").over(W.partitionBy()))  # 101 rows
    n = F.coalesce("n", F.lit(0))
    return filled.select("gc", n.alias("reads"), F.coalesce(F.round(F.try_divide(n * F.lit(10000.0), F.col("total").cast("double"))) / 100, F.lit(0.0)).alias("ratio"))


def kmers(reads: DataFrame, k: int = 21) -> DataFrame:
    """Counts of all overlapping words of k letters, as they are written."""
    if k < 1:
        raise ValueError("k must be positive")
    places = F.sequence(F.lit(1), F.length(C.seq) - k + 1)
    rows = reads.where(F.length(C.seq) >= k).select(F.explode(F.transform(places, lambda i: F.substring(C.seq, i, F.lit(k)))).alias("kmer"))
    return rows.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
