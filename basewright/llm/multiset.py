"""Document fingerprints by a homomorphic multiset hash, in DataFrame operations only.

A document is the multiset of its paragraphs (lines that aren't empty). Each paragraph is hashed to a wide
vector, and vectors are added lane by lane modulo a power of two: the order of paragraphs doesn't matter, and a
paragraph is put in or taken out by adding or subtracting its vector. The state of a document is an array of
longs: 16 paragraph lanes modulo 2^32, the number of pieces, and 64 longs with two lanes each of a sketch.

The sketch is a second multiset hash in the same sums: it adds +1 or -1 for each bit of 128 hash bits of every piece
of the paragraphs, a word with the one before it (none before the first). Words are runs without spaces; one of over
16 characters is cut after letters of its own, and each character of East Asian scripts is a word, so that an edit
changes only pieces near it. The cosine of two such sums is the likeness of the multisets of pieces, with a standard
error of about 0.09; the paragraph lanes alone can only tell equal from different. A fingerprint prints the whole
state, and `likeness_of` two fingerprints is what `likeness` gives for their states. xxHash isn't cryptographic: equal
fingerprints of texts made to collide prove nothing.

The next document in descending doc_id is found inside cells of about RANGE_ROWS documents that follow one another
in (doc_id descending, hash of the text): equal widths first, then those cells that hold too many are cut again by
their own bounds, until none does. Texts are shuffled once.

Defined results. Null text counts as empty; empty paragraphs don't count, so an empty text has the zero vector,
and two empty texts have likeness 1. Rows that repeat a doc_id follow one another in the order of a hash of their texts;
rows equal in both follow one another, in one cell. A null doc_id has no place in the order: its next document is the
empty text, and it is handled without a cell. An only document follows itself. Texts of any length are hashed whole,
each in one task. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from basewright.llm.common import dealt, written
from basewright.llm.decontaminate import let
from basewright.operators.position import renumbered

_EAST, _REST = r"[\u2E80-\uD7FF]", r"[^\s\u2E80-\uD7FF]"
WORD_PATTERN = f"{_EAST}|{_REST}{{1,16}}(?!{_REST})|{_REST}{{4,15}}?[aeinrst0-4]|{_REST}{{1,16}}"
#: Documents in a cell, which one group of the window holds: so many on average, four times as many at most.
RANGE_ROWS = 1024
#: First documents of cells are broadcast when counted to be so many at most (some 50 MB).
BROADCAST_RANGES = 500_000
LANES, PAIRS = 16, 64
WORD = 0xFFFFFFFF


def _sums() -> list[Column]:
    """Aggregates that add up the vectors of pieces, and those of paragraphs on the row of their first piece (`_bw_first`).

    All are short terms without branches: with longer ones the generated code grows past what the JVM compiles.
    """
    out = [F.sum(F.shiftrightunsigned(f"_bw_h{i // 2}", 32 * (i % 2)).bitwiseAND(F.lit(WORD)).bitwiseAND(F.col("_bw_first"))).alias(f"_bw_l{i}") for i in range(LANES)]
    out.append(F.count("_bw_piece").alias("_bw_pieces"))
    for i in range(PAIRS):
        out.append(F.sum(F.shiftrightunsigned(f"_bw_g{i // 32}", i % 32).bitwiseAND(F.lit(1 << 32 | 1))).alias(f"_bw_p{i}"))
    return out


def _pieces(par: Column) -> Column:
    """Hashes of a paragraph's pieces."""
    words = F.regexp_extract_all(par, F.lit(WORD_PATTERN), F.lit(0))
    return let(words, lambda w: F.transform(w, lambda x, i: F.xxhash64(F.coalesce(F.get(w, i - 1), F.lit("")), x)))


def states(rows: DataFrame, text: str, *by: str) -> DataFrame:
    """The columns `by`, which must tell the rows apart, and `state` array<long>. No shuffle if rows are already
    dealt by some of them."""
    pars = rows.select(*by, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("_bw_par"))
    # in a step of their own: beside the generator, paragraphs would be hashed again for each of their pieces
    hashed = pars.select("*", *[F.when(F.col("_bw_par") == "", 0).otherwise(F.xxhash64(F.lit(i), "_bw_par")).alias(f"_bw_h{i}") for i in range(LANES // 2)])
    hashed = hashed.select(*by, *[f"_bw_h{i}" for i in range(LANES // 2)], F.posexplode_outer(_pieces(F.col("_bw_par"))).alias("_bw_n", "_bw_piece"))
    first = F.when(F.coalesce("_bw_n", F.lit(0)) == 0, F.lit(-1).cast("long")).otherwise(F.lit(0).cast("long"))
    pieces = hashed.withColumns({"_bw_first": first} | {f"_bw_g{i}": F.when(F.col("_bw_piece").isNull(), 0).otherwise(F.xxhash64(F.lit(101 + i), "_bw_piece")) for i in (0, 1)})
    lanes = [F.col(f"_bw_l{i}").bitwiseAND(F.lit(WORD)) for i in range(LANES)]
    return pieces.groupBy(*by).agg(*_sums()).select(*by, F.array(*lanes, F.col("_bw_pieces"), *[F.col(f"_bw_p{i}") for i in range(PAIRS)]).alias("state"))


def added(a: Column, b: Column) -> Column:
    """State of two documents put together."""
    return F.transform(F.zip_with(a, b, lambda x, y: x + y), lambda x, i: F.when(i < LANES, x.bitwiseAND(F.lit(WORD))).otherwise(x))


def taken(a: Column, b: Column) -> Column:
    """State of a without the paragraphs of b, all of which it must have."""
    return F.transform(F.zip_with(a, b, lambda x, y: x - y), lambda x, i: F.when(i < LANES, x.bitwiseAND(F.lit(WORD))).otherwise(x))


def _hexed(x: Column, digits: int) -> Column:
    return F.lpad(F.lower(F.hex(x)), digits, "0")


def printed(state: Column) -> Column:
    """A state as lower-case hex: paragraph lanes (8 digits each), number of pieces, sketch lanes (two in 16 digits)."""
    paragraphs = F.array_join(F.transform(F.slice(state, 1, LANES), lambda x: _hexed(x, 8)), "")
    sketch = F.array_join(F.transform(F.slice(state, LANES + 2, PAIRS), lambda x: _hexed(x, 16)), "")
    return F.concat_ws("-", paragraphs, _hexed(F.get(state, F.lit(LANES)), 16), sketch)


def parsed(fingerprint: Column) -> Column:
    """The state that a fingerprint prints."""
    number = lambda x: F.conv(x, 16, -10).cast("long")
    parts = lambda k, n, digits: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: number(F.substring(F.split_part(fingerprint, F.lit("-"), F.lit(k)), i * digits + 1, F.lit(digits))))
    return F.concat(parts(1, LANES, 8), parts(2, 1, 16), parts(3, PAIRS, 16))


def likeness_of(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints."""
    return likeness(parsed(a), parsed(b))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of the sketches, from 0 to 1; 1 for equal states, 0 where one is empty."""

    def lanes(s: Column) -> Column:
        n = F.get(s, F.lit(LANES))
        lane = lambda x: (2 * x - n).cast("double")
        return F.flatten(F.transform(F.slice(s, LANES + 2, PAIRS), lambda x: F.array(lane(x.bitwiseAND(F.lit(WORD))), lane(F.shiftrightunsigned(x, 32)))))

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda acc, y: acc + y)

    def cosine(v: Column) -> Column:
        x, y = v["x"], v["y"]
        dot = total(F.zip_with(x, y, lambda p, q: p * q))
        norms = F.sqrt(total(F.transform(x, lambda p: p * p)) * total(F.transform(y, lambda q: q * q)))
        return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(dot, norms))), F.lit(0.0))

    both = F.get(F.transform(F.array(F.struct(lanes(a).alias("x"), lanes(b).alias("y"))), cosine), F.lit(0))
    return F.when(a == b, F.lit(1.0)).otherwise(both)


def _cuts(ids: DataFrame, n: int, lo: int, hi: int, range_rows: int) -> Callable[[DataFrame], DataFrame]:
    """What gives rows of (doc_id, h) the number of their cell: equal widths, then level by level a table of the cells
    to cut again, with bounds, widths and new numbers."""
    parts = max(1, -(-n // range_rows))
    first = F.expr(f"CAST((CAST({hi} AS DECIMAL(20,0)) - CAST(doc_id AS DECIMAL(20,0))) div {-(-(hi - lo + 1) // parts)}BD AS BIGINT)")
    levels, cells, free = [], ids.withColumn("cell", first), parts
    while True:
        cells = _cut(cells, levels[-1]) if levels else cells
        bounds = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[f(c).cast("decimal(20,0)").alias(f"{k}_{c}") for c in ("doc_id", "h") for k, f in (("lo", F.min), ("hi", F.max))])
        by_id = F.col("lo_doc_id") < F.col("hi_doc_id")
        span = F.when(by_id, F.col("hi_doc_id") - F.col("lo_doc_id")).otherwise(F.col("hi_h") - F.col("lo_h")) + 1
        large = bounds.where((F.col("n") > 4 * range_rows) & (by_id | (F.col("lo_h") < F.col("hi_h")))).withColumn("parts", F.ceil(F.col("n") / range_rows))
        width = F.greatest(F.ceil(span / F.col("parts").cast("decimal(20,0)")), F.lit(1)).cast("decimal(20,0)")
        # a row for each cell that is too large, one in thousands of documents at most
        base = F.sum("parts").over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("parts") + free
        level = written(large.select(F.col("cell").alias("at"), by_id.alias("by_id"), F.when(by_id, F.col("hi_doc_id")).otherwise(F.col("lo_h")).alias("from"), width.alias("width"), base.cast("long").alias("base"), "parts"), "cuts")
        more = level.agg(F.sum("parts")).first()[0]
        if not more:
            return lambda df: reduce(_cut, levels, df.withColumn("cell", first))
        free += more
        levels.append(level.drop("parts"))


def _cut(rows: DataFrame, level: DataFrame) -> DataFrame:
    """rows with the numbers of new cells in place of those of the cells that are cut."""
    few = level.count() <= BROADCAST_RANGES
    met = rows.join(F.broadcast(level) if few else level, rows["cell"] == level["at"], "left")
    far = F.when(F.col("by_id"), F.col("from") - F.col("doc_id").cast("decimal(20,0)")).otherwise(F.col("h").cast("decimal(20,0)") - F.col("from"))
    cell = F.coalesce(F.expr("base + CAST(_bw_far div width AS BIGINT)"), F.col("cell"))
    return met.withColumn("_bw_far", far).withColumn("cell", cell).select(*rows.columns)


def with_next(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, text, `bucket`, `at` (unique in its bucket), `ghost` and `next_text`, dealt by bucket; rows with an id.

    Each cell also gets, as a ghost, the first document of the cell that follows, so that a window inside each cell
    finds the next document, and texts are shuffled once.
    """
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    n, lo, hi, total = rows.agg(F.count("doc_id"), F.min("doc_id"), F.max("doc_id"), F.sum(F.octet_length("text").cast("long"))).first()
    ids = rows.select("doc_id", "h")
    cut = _cuts(ids, n, lo or 0, hi or 0, range_rows)
    # ~h is the larger the smaller h is
    heads = cut(ids).groupBy("cell").agg(F.max(F.struct("doc_id", F.bitwise_not("h").alias("rest"))).alias("head"))
    numbered = written(renumbered(heads.orderBy(F.desc("head"))), "heads")
    last = numbered.count()
    following = numbered.select((F.pmod(F.col("rank") - 1, F.lit(max(1, last)))).alias("rank"), F.col("head.doc_id").alias("next_id"), F.bitwise_not("head.rest").alias("next_h"))
    after = written(numbered.select("rank", F.col("cell").alias("to")).join(following, "rank").drop("rank"), "after")
    after = F.broadcast(after) if last <= BROADCAST_RANGES else after
    ghosts = rows.join(after, (F.col("doc_id") == F.col("next_id")) & (F.col("h") == F.col("next_h"))).groupBy(F.col("to").alias("cell")).agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("h").alias("h"))
    all_rows = cut(rows).withColumn("ghost", F.lit(False)).unionByName(ghosts.withColumn("ghost", F.lit(True)))
    order = W.partitionBy("bucket").orderBy("ghost", F.col("doc_id").desc(), "h", "text")
    placed = dealt(all_rows.withColumnRenamed("cell", "bucket"), total or 0, "bucket")
    out = placed.select("*", F.row_number().over(order).alias("at"), F.lead("text").over(order).alias("next_text"))
    return out.drop("h")


def without_id(docs: DataFrame) -> DataFrame:
    """The same columns for rows without an id: each in a bucket of its own, followed by the empty text."""
    rows = docs.where("doc_id IS NULL").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", "text", (-1 - F.monotonically_increasing_id()).alias("bucket"), F.lit(False).alias("ghost"), F.lit(1).alias("at"), F.lit("").alias("next_text"))


def _digested(near: DataFrame) -> DataFrame:
    n = F.char_length("text").cast("long")
    cut = F.expr("char_length(text) div 3").cast("int")
    edited = F.concat(F.left("text", F.char_length("text") - cut), F.left(F.coalesce("next_text", F.lit("")), cut))
    near = near.withColumn("n_chars", n).withColumn("edited", edited)
    near = near.withColumn("edited_sha256", F.sha2(F.encode("edited", "UTF-8"), 256))
    # the paragraphs before the cut are those of both texts: they are hashed once, and the rest of either is added
    head = F.left("text", F.char_length("text") - cut)
    same = F.char_length(head) - F.char_length(F.substring_index(head, "\n", -1))
    body = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("body"))
    whole = F.array(body(0, F.col("text")), body(1, F.lit("")))
    parts = F.array(body(0, F.left("text", F.col("_bw_same"))), body(1, F.substr("text", F.col("_bw_same") + 1)), body(2, F.substr("edited", F.col("_bw_same") + 1)))
    by = ["bucket", "at", "ghost", "doc_id", "n_chars", "edited_sha256"]
    near = near.withColumn("_bw_same", same).select(*by, F.explode(F.when(F.col("ghost"), whole).otherwise(parts)).alias("_bw_k"))
    each = states(near.select(*by, "_bw_k.kind", "_bw_k.body"), "body", *by, "kind")
    order = W.partitionBy("bucket").orderBy("at", "kind")
    # rows go: what both texts share, the rest of the text, that of the edited one; then those of the next document
    lead = lambda k: F.lead("state", k).over(order)
    rows = each.select("*", *[lead(k).alias(f"_bw_{k}") for k in range(1, 5)]).where("kind = 0 AND NOT ghost")
    none = F.array_repeat(F.lit(0).cast("long"), LANES + 1 + PAIRS)
    state, edited, following = added(F.col("state"), F.col("_bw_1")), added(F.col("state"), F.col("_bw_2")), F.coalesce(added(F.col("_bw_3"), F.col("_bw_4")), none)
    # a generator between: else sums are worked out again wherever they are used
    three = rows.select("doc_id", "n_chars", "edited_sha256", F.explode(F.array(F.struct(state.alias("a"), edited.alias("b"), following.alias("c")))).alias("_bw"))
    a, b, c = (F.col(f"_bw.{x}") for x in "abc")
    return three.select("doc_id", "n_chars", "edited_sha256", printed(a).alias("fingerprint"), printed(b).alias("edited_fingerprint"), likeness(a, b).alias("near_edited"), likeness(a, c).alias("near_next"))


def digests(docs: DataFrame) -> DataFrame:
    """The contract's rows."""
    docs = docs.select("doc_id", "text")
    named = _digested(with_next(docs))
    if not docs.where("doc_id IS NULL").limit(1).count():
        return named
    return named.unionByName(_digested(without_id(docs)))
