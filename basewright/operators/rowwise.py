"""Operators that make each read into one read, or into several, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basewright.functions import exprs as X
from basewright.functions.exprs import C
from basewright.schema import check_offset



def trim(reads: DataFrame, left: int = 0, right: int = 0, least: int = 0) -> DataFrame:
    """Cut bases off both ends; reads that would lose all, or end below `least`, go."""
    n = F.length(C.seq) - left - right
    kept = reads.where((F.lit(left) < F.length(C.seq)) & (F.lit(right) < F.length(C.seq)) & (n > 0) & (n >= least))
    cut = lambda c: F.substring(c, F.lit(left + 1), F.length(c) - left - right)
    return kept.withColumns({"seq": cut(C.seq), "qual": cut(C.qual)})


def cut_adapters(reads: DataFrame, adapters: list[str], left: bool = False, mismatch: int = 0) -> DataFrame:
    """Cut the first adapter of the list that stands at the read's end (or start) with few enough mismatches."""
    length = F.lit(0)
    for adapter in reversed(adapters):
        n = len(adapter)
        start = F.lit(1) if left else F.length(C.seq) - n + 1
        length = F.when((F.length(C.seq) >= n) & (X.mismatches(C.seq, start, adapter) <= mismatch), n).otherwise(length)
    cut = lambda c: F.substring(c, length + 1 if left else F.lit(1), F.length(c) - length)
    return reads.withColumns({"seq": cut(C.seq), "qual": cut(C.qual)})


def mask(reads: DataFrame, limit: int = 5, letter: str = "N", phred: int = 33) -> DataFrame:
    """Put a letter in place of bases of quality `limit` or less."""
    check_offset(phred)
    if len(letter) != 1:
        raise ValueError("letter must be one character")
    masked = F.zip_with(X.letters(C.seq), X.letters(C.qual), lambda s, q: F.when(F.ascii(q) - phred <= limit, letter).otherwise(s))
    return reads.withColumn("seq", F.array_join(masked, ""))


def masked(reads: DataFrame, limit: int = 5, phred: int = 33) -> DataFrame:
    """One row: how many bases `mask` replaces, and in how many reads."""
    n = X.count_of(C.qual, "".join(map(chr, range(1, check_offset(phred) + limit + 1))))
    return reads.agg(F.coalesce(F.sum(n), F.lit(0)).alias("bases"), F.count_if(n > 0).alias("reads"))


def rescore(reads: DataFrame, to33: bool = False, to64: bool = False) -> DataFrame:
    """Move qualities between the offsets 33 and 64 (31 apart)."""
    if to33 == to64:
        raise ValueError("choose one of to33 and to64")
    shift, letters = -31 if to33 else 31, range(32, 225)
    return reads.withColumn("qual", F.translate(C.qual, "".join(map(chr, letters)), "".join(chr(c + shift) for c in letters)))


def reverse(reads: DataFrame, only: bool = False) -> DataFrame:
    """Reverse complement, or only reverse; qualities are reversed."""
    return reads.withColumns({"seq": F.reverse(C.seq) if only else X.strict_complement(C.seq), "qual": F.reverse(C.qual)})


def rename(reads: DataFrame, prefix: str | None = None, label: str = "", before: bool = False, keep: bool = False) -> DataFrame:
    """New ids from a prefix and the read's number, or from its first token, with a label and, if kept, the rest."""
    rest = X.other_tokens(C.id) if keep else F.lit("")
    if prefix is not None:
        front = f"{label}{prefix}" if before else f"{prefix}{label}"
        new = F.concat(F.lit(front), (C.read_idx + 1).cast("string"), rest)
    elif before:
        new = F.concat(F.lit(label), C.id if keep else X.first_token(C.id))
    else:
        new = F.concat(X.first_token(C.id), F.lit(label), rest)
    return reads.withColumn("id", new)


def to_fasta(reads: DataFrame, short: bool = False) -> DataFrame:
    """read_idx, id, seq; short: ids end at their first space."""
    return reads.select("read_idx", (F.substring_index(C.id, " ", 1) if short else C.id).alias("id"), "seq")


def fasta_lines(fasta: DataFrame) -> DataFrame:
    return fasta.select("read_idx", F.concat(F.lit(">"), C.id, F.lit("\n"), C.seq).alias("value"))


def fastq_line() -> Column:
    return F.concat(F.lit("@"), C.id, F.lit("\n"), C.seq, F.lit("\n+\n"), C.qual)


def fastq_lines(reads: DataFrame) -> DataFrame:
    return reads.select("read_idx", fastq_line().alias("value"))


def sam_header(sample: str, group: str = "A", library: str | None = None, platform: str | None = None) -> str:
    fields = [f"ID:{group}", f"SM:{sample}", *[f"LB:{library}"] * bool(library), *[f"PL:{platform}"] * bool(platform)]
    return "@HD\tVN:1.6\tSO:queryname\n@RG\t" + "\t".join(fields)


def _sam(flag: int, name: Column, seq: Column, qual: Column, group: str) -> Column:
    fixed = lambda *x: [F.lit(y) for y in x]
    return F.concat_ws("\t", name, *fixed(str(flag), "*", "0", "0", "*", "*", "0", "0"), seq, qual, F.lit(f"RG:Z:{group}"))


def to_sam(reads: DataFrame, mates: DataFrame | None = None, group: str = "A") -> DataFrame:
    """read_idx, mate and the SAM line of unaligned reads, paired by position if mates are given."""
    if mates is None:
        return reads.select("read_idx", F.lit(1).alias("mate"), _sam(4, C.id, C.seq, C.qual, group).alias("value"))
    from basewright.operators.paired import zipped

    both = [F.struct(F.lit(m).alias("mate"), _sam(flag, F.col(f"id{m}"), F.col(f"seq{m}"), F.col(f"qual{m}"), group).alias("value")) for m, flag in ((1, 77), (2, 141))]
    return zipped(reads, mates).select("read_idx", F.inline(F.array(*both)))


def flatten(reads: DataFrame, flag: int = 3, sep: str = "\t", gap: bool = False, length: bool = False, gc: bool = False) -> DataFrame:
    """One delimited line for each read; flag adds 1 for the id, 2 for bases, 4 for the plus line, 8 for qualities."""
    if not 1 <= flag <= 15:
        raise ValueError("flag must be from 1 to 15")
    fields = [c for bit, c in ((1, C.id), (2, C.seq), (4, F.lit("+")), (8, C.qual)) if flag & bit]
    fields += [X.count_of(C.seq, "N").cast("string")] * gap + [F.length(C.seq).cast("string")] * length
    line = F.concat(*(F.concat(c, F.lit(sep)) for c in fields))
    if gc:
        line = F.concat(line, F.format_string("%.2f", F.coalesce(X.gc_fraction(C.seq) * 100, F.lit(0.0))))
    return reads.select("read_idx", line.alias("value"))


def slide(reads: DataFrame, window: int = 10, step: int = 5, suffix: str = "_slide") -> DataFrame:
    """Reads of all windows: each that ends inside the read, then one to its end; `part` numbers them."""
    if window < 1 or step < 1:
        raise ValueError("window and step must be positive")
    n = F.length(C.seq)
    last = F.when(n > window, F.ceil((n - window) / step)).otherwise(0).cast("int")
    each = reads.where(n > 0).select("*", F.explode(F.sequence(F.lit(0), last)).alias("part")).where(F.col("part") * step < n)
    start = F.col("part") * step
    end = F.least(start + window, n)
    cut = lambda c: F.substring(c, start + 1, F.lit(window))
    return each.select("read_idx", "part", F.concat(C.id, F.lit(f"{suffix}:"), (start + 1).cast("string"), F.lit("-"), end.cast("string")).alias("id"), cut(C.seq).alias("seq"), cut(C.qual).alias("qual"))
