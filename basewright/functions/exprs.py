"""Columns over sequences and qualities; all stay on the JVM, most inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from basewright.schema import check_offset


class _Columns:
    """Columns by name, made when asked for: modules are imported before there is a session."""

    def __getattr__(self, name: str) -> Column:
        return F.col(name)


C = _Columns()


def count_of(seq: Column, letters: str) -> Column:
    """How many characters of seq are among letters."""
    return (F.length(seq) - F.length(F.translate(seq, letters, ""))).cast("long")


def gc_fraction(seq: Column) -> Column:
    """Share of G and C; null for an empty sequence."""
    return F.try_divide(count_of(seq, "GC").cast("double"), F.length(seq).cast("double"))


def gc_bucket(seq: Column) -> Column:
    """GC percentage as a whole number, 0 for an empty sequence."""
    return F.coalesce(F.round(gc_fraction(seq) * 100), F.lit(0.0)).cast("int")


def letters(text: Column) -> Column:
    """Single characters of a text, none for an empty one."""
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def quality_at_least(qual: Column, least: int, phred: int) -> Column:
    """How many bases have this quality or more."""
    return count_of(qual, "".join(chr(x) for x in range(max(0, least + check_offset(phred)), 127)))


def mean_quality(qual: Column, phred: int) -> Column:
    """Quality of the mean error probability, rounded; null for an empty read."""
    check_offset(phred)
    errors = F.array(*[F.lit(10 ** ((phred - c) / 10)) for c in range(128)])  # by letter, looked up instead of computed
    total = F.aggregate(letters(qual), F.lit(0.0), lambda acc, c: acc + F.coalesce(F.get(errors, F.ascii(c)), F.lit(0.0)))
    return F.round(-10 * F.log10(F.try_divide(total, F.length(qual).cast("double"))))


def complexity(seq: Column) -> Column:
    """Share of neighbours that differ, of all neighbours; 0 for fewer than two bases."""
    changes = F.size(F.filter(F.sequence(F.lit(1), F.length(seq) - 1), lambda i: F.substring(seq, i, F.lit(1)) != F.substring(seq, i + 1, F.lit(1))))
    return F.when(F.length(seq) > 1, changes / (F.length(seq) - 1)).otherwise(0.0)


def complement(seq: Column) -> Column:
    """Reverse complement of A, C, G, T; other characters stay."""
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def strict_complement(seq: Column) -> Column:
    """Reverse complement; what isn't A, C, G, T or N becomes N."""
    return F.regexp_replace(complement(seq), "[^ACGTN]", "N")


def mismatches(seq: Column, start: Column, pattern: str) -> Column:
    """Differing places between a pattern and the part of seq from start (from 1), unrolled so that it is compiled."""
    total = F.lit(0)
    for i, letter in enumerate(pattern):
        total = total + (F.substring(seq, start + i, F.lit(1)) != letter).cast("int")
    return total


def tokens(name: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(name, r"\s+", " ")), " ")


def first_token(name: Column) -> Column:
    return F.get(tokens(name), F.lit(0))


def other_tokens(name: Column) -> Column:
    """A space and the tokens after the first, joined by single spaces; nothing if there are none."""
    every = tokens(name)
    rest = F.array_join(F.slice(every, F.lit(2), F.greatest(F.size(every) - 1, F.lit(0))), " ")
    return F.when(rest != "", F.concat(F.lit(" "), rest)).otherwise("")


def seeded_order(seed: int, index: Column) -> Column:
    """A reproducible random order: the same in any engine that has MD5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), index.cast("string")))
