"""Operators on pairs of reads, which stand at the same place of two files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basewright.functions import exprs as X
from basewright.schema import check_offset


def zipped(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pairs by place, to the end of the shorter file."""
    one, two = ([F.col("read_idx"), *(F.col(c).alias(f"{c}{m}") for c in ("id", "seq", "qual"))] for m in (1, 2))
    return first.select(*one).join(second.select(*two), "read_idx")


def passes(mate: int, n_bases: int, length: int, complexity: float, quality: int, phred: int) -> Column:
    """The tests on one mate, cheap ones first."""
    seq, qual = F.col(f"seq{mate}"), F.col(f"qual{mate}")
    good = (F.length(seq) >= length) & (X.count_of(seq, "N") <= n_bases)
    if complexity > 0:
        good = good & (X.complexity(seq) * 100 >= complexity)
    return good & F.coalesce(X.mean_quality(qual, phred) >= quality, F.lit(quality <= 0))


def filter_pairs(pairs: DataFrame, n_bases: int = 5, length: int = 30, complexity: float = 0, quality: int = 20, phred: int = 33) -> DataFrame:
    """pairs with `passed`: whether both mates pass every test."""
    check_offset(phred)
    both = [passes(m, n_bases, length, complexity, quality, phred) for m in (1, 2)]
    return pairs.withColumn("passed", both[0] & both[1])


def interleaved(pairs: DataFrame) -> DataFrame:
    """Both mates of each pair, one after another, numbered by place of the pair."""
    both = [F.struct((F.col("read_idx") * 2 + m - 1).alias("read_idx"), F.col(f"id{m}").alias("id"), F.col(f"seq{m}").alias("seq"), F.col(f"qual{m}").alias("qual")) for m in (1, 2)]
    return pairs.select(F.inline(F.array(*both)))


def best_overlap(one: np.ndarray, two: np.ndarray, least: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """For rows of letters, the longest suffix of one that agrees with as long a prefix of two, and its mismatches; 0 if none."""
    n, widest = len(one), min(one.shape[1], two.shape[1])
    found, wrong, open_ = np.zeros(n, np.int32), np.zeros(n, np.int32), np.arange(n)
    for length in range(widest, max(least, 1) - 1, -1):
        off = (one[open_, one.shape[1] - length :] != two[open_, :length]).sum(axis=1)
        good = off / length <= rate
        found[open_[good]], wrong[open_[good]] = length, off[good]
        open_ = open_[~good]
        if not len(open_):
            break
    return found, wrong


def _merged(found: np.ndarray, a: np.ndarray, qa: np.ndarray, b: np.ndarray, qb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merged bases and qualities of rows of letters, all rows of one overlap length at once; None without overlap."""
    seq, qual = np.full(len(found), None, object), np.full(len(found), None, object)
    for length in np.unique(found[found > 0]).tolist():
        rows = np.flatnonzero(found == length)
        cut = a.shape[1] - length
        own = qa[rows, cut:] >= qb[rows, :length]
        for out, x, y in ((seq, a, b), (qual, qa, qb)):
            whole = np.ascontiguousarray(np.hstack([x[rows, :cut], np.where(own, x[rows, cut:], y[rows, :length]), y[rows, length:]]))
            out[rows] = whole.view(f"S{whole.shape[1]}").ravel().astype(str)
    return seq, qual


def join_overlap(pairs: DataFrame, least: int = 30, rate: float = 0.1) -> DataFrame:
    """pairs with `overlap`, `mismatches` and, where there is one, the merged `seq` and `qual`.

    Lengths are tried from the longest, for all pairs of a batch at once; at each place of the overlap the base of
    the higher quality letter stays, the first mate's where both are equal. Reads are ASCII.
    """
    schema = "overlap int, mismatches int, seq string, qual string"

    @F.pandas_udf(schema)
    def merged(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        letters = lambda rows: np.frombuffer("".join(rows).encode("ascii"), np.uint8).reshape(len(rows), -1)
        for s1, q1, s2, q2 in batches:
            out = {c: np.zeros(len(s1), np.int32) for c in ("overlap", "mismatches")} | {c: np.full(len(s1), None, object) for c in ("seq", "qual")}
            known = (s1.notna() & q1.notna() & s2.notna() & q2.notna()).to_numpy()
            size = pd.Series(list(zip(s1.str.len(), s2.str.len(), strict=True)))[known]
            for (n1, n2), rows in size.groupby(size).groups.items():
                if not n1 or not n2:
                    continue
                rows = np.asarray(rows)
                a, qa, b, qb = (letters(x.iloc[rows]) for x in (s1, q1, s2, q2))
                if qa.shape != a.shape or qb.shape != b.shape:
                    raise ValueError("bases and qualities differ in length")
                found, wrong = best_overlap(a, b, least, rate)
                out["overlap"][rows], out["mismatches"][rows] = found, wrong
                out["seq"][rows], out["qual"][rows] = _merged(found, a, qa, b, qb)
            yield pd.DataFrame(out)

    made = merged("seq1", "qual1", X.complement(F.col("seq2")), F.reverse("qual2"))
    # a generator between: else a filter on the result makes the optimizer run the function twice
    joined = pairs.withColumn("_bw_made", made).select("*", F.explode(F.array("_bw_made")).alias("_bw"))
    return joined.select(*pairs.columns, F.col("_bw.overlap"), F.col("_bw.mismatches"), F.col("_bw.seq"), F.col("_bw.qual"))


def join_summary(joined: DataFrame) -> DataFrame:
    hit = F.col("overlap") > 0
    one = joined.agg(F.count_if(hit).alias("joined"), F.count(F.lit(1)).alias("total"), F.coalesce(F.sum("overlap"), F.lit(0)).alias("overlap_bases"), F.coalesce(F.sum("mismatches"), F.lit(0)).alias("mismatches"))
    return one.withColumn("joined_pct", F.try_divide(100.0 * F.col("joined"), F.col("total").cast("double")))
