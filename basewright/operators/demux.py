"""Demultiplexing of read pairs by a barcode at one end of the second mate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basewright.functions import exprs as X

_PAIRS = str.maketrans("ACGT", "TGCA")


def keys(barcodes: list[tuple[str, str]], complement: bool = False) -> list[tuple[str, str]]:
    """What is looked for: each barcode reversed, or its reverse complement; of equal ones the first counts."""
    out: dict[str, str] = {}
    for barcode, sample in barcodes:
        key = barcode[::-1]
        out.setdefault(key.translate(_PAIRS) if complement else key, sample)
    return list(out.items())


def demultiplex(pairs: DataFrame, barcodes: list[tuple[str, str]], mode: int = 2, mismatch: int = 0, complement: bool = False) -> DataFrame:
    """Pairs with a barcode: `sample`, the barcode's part, and the second mate without it. Mode 1: at its start, 2: at its end."""
    if mode not in (1, 2):
        raise ValueError("mode must be 1 or 2")
    seq = F.col("seq2")
    match = F.lit(None).cast("struct<sample:string,n:int>")
    for key, sample in reversed(keys(barcodes, complement)):
        n = len(key)
        start = F.lit(1) if mode == 1 else F.length(seq) - n + 1
        hit = (F.length(seq) >= n) & (X.mismatches(seq, start, key) <= mismatch)
        match = F.when(hit, F.struct(F.lit(sample).alias("sample"), F.lit(n).alias("n"))).otherwise(match)
    n = F.col("_bw.n")
    rest = lambda c: F.substring(c, n + 1 if mode == 1 else F.lit(1), F.length(c) - n)
    part = lambda c: F.substring(c, F.lit(1) if mode == 1 else F.length(c) - n + 1, n)
    kept = [c for c in pairs.columns if c not in ("seq2", "qual2")]
    # a generator between: else the optimizer copies the whole match into each column that uses it
    found = pairs.select("*", F.explode(F.array(match)).alias("_bw")).where(F.col("_bw").isNotNull())
    return found.select(*kept, F.col("_bw.sample").alias("sample"), rest(seq).alias("seq2"), rest(F.col("qual2")).alias("qual2"), part(seq).alias("barcode_seq"), part(F.col("qual2")).alias("barcode_qual"))


def split_rate(demultiplexed: DataFrame) -> DataFrame:
    return demultiplexed.groupBy("sample").agg(F.count(F.lit(1)).alias("n"))
