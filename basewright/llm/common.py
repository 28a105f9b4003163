"""What the corpus operators share: written intermediate tables, sizes of partitions, seeded samples, word shingles."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basewright.shared import discard, fresh_path, work_folder, written  # noqa: F401  used by the operators

#: Words in a shingle, and the Jaccard similarity from which two texts count as near duplicates.
SHINGLE_WORDS = 5
SIMILAR = 0.8


#: Rows of a small written table (a few longs each) that are broadcast at most.
BROADCAST_ROWS = 1_000_000


def spread_join(large: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner", most: int | None = None) -> DataFrame:
    """large joined with one row for each key: small is written, then broadcast if counted to be few rows; else both
    sides have a plain exchange under the join, so that Spark splits the rows of a hot key."""
    small = written(small, "small")
    few = small.count() <= (BROADCAST_ROWS if most is None else most)
    return large.join(F.broadcast(small) if few else small, on, how)


def dealt(df: DataFrame, total_bytes: int, *by: str, part_bytes: int = 64 << 20) -> DataFrame:
    """df by hash of columns into as many partitions as its counted bytes ask for, the session's number at least."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-total_bytes // part_bytes)), *by)


def in_share(share: float, seed: int, *columns: str) -> Column:
    """Whether a row's 64-bit hash falls into a share (0 to 1) of all hashes; rows equal in `columns` decide alike."""
    bound = min((1 << 63) - 1, int(share * 2.0**64) - (1 << 63))
    return F.lit(share >= 1) | (F.xxhash64(F.lit(seed), *columns) < F.lit(bound))


_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64's finaliser)."""
    x = x + _MIX
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept while there are at most `most` of them."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def shingles(text: str | None, hashes: WordHashes, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles.

    Words are the lower-cased runs of letters, digits and underscores. A text of fewer words than
    `width`, but some, has one shingle of all its words; a text without words has none.
    """
    words = _WORD.findall(text.lower()) if text else []
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    span = min(width, len(each))
    out = np.zeros(len(each) - span + 1, np.uint64)
    for i in range(span):
        out = mixed(out ^ each[i : i + len(out)])
    return np.unique(out)
