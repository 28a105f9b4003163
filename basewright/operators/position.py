"""Operators on a read's place in its file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from basewright.functions.exprs import C
from basewright.shared import written



def topn(reads: DataFrame, n: int = 10) -> DataFrame:
    return reads.where(C.read_idx < n)


def tail(reads: DataFrame, n: int = 10) -> DataFrame:
    """The last n reads, all if there are fewer. One cheap aggregate finds the end of the file."""
    end = reads.agg(F.max("read_idx")).first()[0]
    return reads.where(C.read_idx > (end if end is not None else -1) - n)


def take_range(reads: DataFrame, skip: int, take: int) -> DataFrame:
    return reads.where((C.read_idx >= skip) & (C.read_idx < skip + take))


def page(reads: DataFrame, number: int, height: int = 24) -> DataFrame:
    """What a terminal of so many lines shows as page `number` (from 0): four lines a read, two kept free."""
    size = max(1, (height - 2) // 4)
    return take_range(reads, number * size, size)


def split_interleaved(reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    pair = F.expr("read_idx div 2")
    return reads.where(C.read_idx % 2 == 0).withColumn("read_idx", pair), reads.where(C.read_idx % 2 == 1).withColumn("read_idx", pair)


def split_chunks(reads: DataFrame, size: int = 200_000) -> DataFrame:
    """reads with the number of their chunk."""
    if size < 1:
        raise ValueError("size must be positive")
    return reads.withColumn("chunk", F.expr(f"read_idx div {size}L"))


def interleave(first: DataFrame, second: DataFrame) -> DataFrame:
    """One of the first file, one of the second, and so on, to the end of the shorter."""
    from basewright.operators.paired import zipped

    both = [F.struct((C.read_idx * 2 + m - 1).alias("read_idx"), F.col(f"id{m}").alias("id"), F.col(f"seq{m}").alias("seq"), F.col(f"qual{m}").alias("qual")) for m in (1, 2)]
    return zipped(first, second).select(F.inline(F.array(*both)))


def concat(files: list[DataFrame]) -> DataFrame:
    """Files one after another; numbers go on from file to file. One job counts all files but the last."""
    if not files:
        raise ValueError("no files")
    ends = [f.agg(F.coalesce(F.max("read_idx") + 1, F.lit(0)).alias("n")).select(F.lit(i).alias("i"), "n") for i, f in enumerate(files[:-1])]
    size = dict(reduce(DataFrame.unionByName, ends).collect()) if ends else {}
    out, offset = files[0], 0
    for i, file in enumerate(files[1:]):
        offset += size[i]
        out = out.unionByName(file.withColumn("read_idx", C.read_idx + offset))
    return out


def concat_lanes(first: list[DataFrame], second: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    if len(first) != len(second):
        raise ValueError("the two lists must have as many files")
    return concat(first), concat(second)


def sort_reads(reads: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """reads in the order of name, seq, length or gc; equal keys stay in the order of the file. A range sort that spills."""
    from basewright.functions.exprs import gc_fraction

    keys = {"name": F.col("id"), "seq": F.col("seq"), "length": F.length("seq"), "gc": gc_fraction(F.col("seq"))}
    if key not in keys:
        raise ValueError(f"key must be one of {', '.join(keys)}")
    by = keys[key].desc_nulls_last() if descending else keys[key].asc_nulls_last()
    return reads.orderBy(by, "read_idx")


def renumbered(ordered: DataFrame, name: str = "rank") -> DataFrame:
    """An ordered table with gapless numbers in that order: counts of partitions, then numbers inside each.

    The sort runs once: the ordered rows are written to the shared folder with their partition and place, and
    both the counts and the result are read from there. A second run of the sort could cut its ranges elsewhere.
    Nothing is gathered: the number of a row is its place in its partition after the rows of earlier ones.
    """
    mono = F.monotonically_increasing_id()
    placed = written(ordered.select("*", mono.alias("_bw_mono")), "ordered")
    part = F.shiftright("_bw_mono", 33)
    counts = placed.groupBy(part.alias("_bw_part")).agg(F.count(F.lit(1)).alias("_bw_n"))
    first = counts.select(F.col("_bw_part"), (F.sum("_bw_n").over(W.orderBy("_bw_part")) - F.col("_bw_n")).alias("_bw_first"))
    inside = F.col("_bw_mono").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(first), part == F.col("_bw_part")).withColumn(name, F.col("_bw_first") + inside).drop("_bw_mono", "_bw_part", "_bw_n", "_bw_first")  # a row for each partition
