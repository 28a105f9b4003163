"""Seeded sampling and shuffling; the order is an MD5 of seed and place, so any engine can repeat it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basewright.functions.exprs import seeded_order


def sample(reads: DataFrame, n: int, seed: int = 69) -> DataFrame:
    """Exactly n reads (all if fewer), uniformly, in the order of the file; each task hands on its n smallest at most."""
    if n < 1:
        raise ValueError("n must be positive")
    return reads.orderBy(seeded_order(seed, F.col("read_idx")), "read_idx").limit(n).orderBy("read_idx")


def shuffled(reads: DataFrame, seed: int = 69) -> DataFrame:
    """All reads in a random order: a range sort on the hash, which spills."""
    return reads.orderBy(seeded_order(seed, F.col("read_idx")), "read_idx")
