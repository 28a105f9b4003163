"""Benchmark decontamination by winnowing, in DataFrame operations only.

Both sides are cut into words, every `GRAM` words are hashed, and in each sliding window of grams the minimum
is kept. A window of WINDOW words has WINDOW - GRAM + 1 grams, so two texts that share WINDOW words keep the
same gram of them: every shared span of that length is found. Fingerprints are joined, and each hit is extended
to both sides word by word, which decides it. An item of fewer than WINDOW words is one window of its own
length; for each such length that occurs, grams of just that length are compared at every place.

1. All texts are fingerprinted in one narrow pass; the places whose gram some item has are kept, as numbers.
2. Texts with such places, equal ones once, give a row for each place with the words around it; these meet the items'
   grams, hit by hit, and what agrees is put together to spans and items. No text holds its hits in a list before that.
3. All texts meet the spans found.

Places, spans and the benchmark's fingerprints are broadcast when counted to be few (BROADCAST_ROWS, BROADCAST_TEXTS),
and no text is shuffled then but those with places; beyond that Spark joins them by shuffles. Texts are told apart by
128 bits of hashes. Grams are told apart by 32 bits before words are compared: more candidates, not more hits.

Defined results. Null and wordless texts have no words, no hits and no items; wordless items never occur. Equal
items and items that repeat an id each count by id; items without an id hit like others, but aren't listed or counted.
Rows are decided each by its own text, whatever their doc_id. Texts of any length are read whole. An empty benchmark
leaves every document clean, no documents give no rows. Columns named `n_words`, `spans` or `items` are replaced by
`contamination` and kept as they are by `clean`.
"""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basewright.llm.common import written

WINDOW, GRAM = 10, 5
BROADCAST_ROWS = 200_000
#: Texts with places or spans (some hundred bytes each) are broadcast when counted to be so many at most.
BROADCAST_TEXTS = 200_000
KEY = ["_bw_k1", "_bw_k2"]
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once; else the optimizer may put it into a lambda that uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """A-Z lower-cased, then the runs of characters other than ASCII punctuation, spaces and controls."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    lower = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))
    return F.array_remove(F.split(lower, BETWEEN_WORDS), "")


def _key() -> list[Column]:
    return [F.xxhash64(F.lit(i), "text").alias(f"_bw_k{i}") for i in (1, 2)]


def _places(n: Column, span: int) -> Column:
    """0 to n - span."""
    return F.when(n >= span, F.sequence(F.lit(0), n - span)).otherwise(F.array().cast("array<int>"))


def _marks(hashes: Column, gram: int) -> Column:
    """For each gram a long: 32 bits of its hash, then its place."""

    def at(i: Column) -> Column:
        gram_hash = F.xxhash64(F.lit(gram), *(F.get(hashes, i + j) for j in range(gram)))
        return F.shiftleft(gram_hash, 32).bitwiseOR(i.cast("long"))

    return F.transform(_places(F.size(hashes), gram), at)


def _marks_of(gram: int) -> Callable[[Column], Column]:
    return lambda hashes: _marks(hashes, gram)


def fingerprints(word_list: Column, window: int = WINDOW, gram: int = GRAM, lengths: tuple[int, ...] = ()) -> Column:
    """Winnowed marks of a text, and all marks of grams of the given shorter lengths."""
    width = window - gram + 1

    def kept(marks: Column) -> Column:
        return F.array_distinct(F.transform(_places(F.size(marks), width), lambda i: F.array_min(F.slice(marks, i + 1, width))))

    def both(hashes: Column) -> Column:
        return F.concat(let(_marks(hashes, gram), kept), *(_marks(hashes, n) for n in lengths))

    return let(F.transform(word_list, lambda w: F.xxhash64(w)), both)


def _marked(rows: DataFrame, marks: Column, *kept: str) -> DataFrame:
    out = rows.select(*kept, F.explode(marks).alias("_bw_mark"))
    return out.withColumn("_bw_hash", F.shiftright("_bw_mark", 32)).withColumn("_bw_at", F.col("_bw_mark").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")).drop("_bw_mark")


def item_fingerprints(items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, tuple[int, ...]]:
    """A row for each kept gram of each item with the words around it, and the lengths of short items."""
    listed = items.select(F.col("item_id"), words(F.col("text")).alias("_bw_item")).where("size(_bw_item) > 0").dropDuplicates()
    lengths = tuple(sorted(x[0] for x in listed.where(F.size("_bw_item") < window).select(F.size("_bw_item")).distinct().collect()))
    back = window - gram
    at, item = F.col("_bw_at"), F.col("_bw_item")
    long = _marked(listed.where(F.size(item) >= window), fingerprints(item, window, gram), "item_id", "_bw_item").select(
        "item_id",
        "_bw_hash",
        F.lit(window).alias("need"),
        F.reverse(F.slice(item, F.greatest(at - back, F.lit(0)) + 1, F.least(at, F.lit(back)))).alias("before"),
        F.slice(item, at + 1, window).alias("after"),
    )
    made = long
    for n in lengths:
        short = _marked(listed.where(F.size(item) == n), let(F.transform(item, lambda w: F.xxhash64(w)), _marks_of(n)), "item_id", "_bw_item")
        made = made.unionByName(short.select("item_id", "_bw_hash", F.lit(n).alias("need"), F.array().cast("array<string>").alias("before"), item.alias("after")))
    return made, lengths


def _agree(a: Column, b: Column) -> Column:
    """How many words two lists have in common from their start."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return let(same, lambda s: F.when(F.array_contains(s, False), F.array_position(s, False).cast("int") - 1).otherwise(F.size(s)))


def _context(list_: Column, at: Column, back: int, window: int) -> tuple[Column, Column]:
    """The words before a place, the nearest first, and those from it on."""
    return F.reverse(F.slice(list_, F.greatest(at - back, F.lit(0)) + 1, F.least(at, F.lit(back)))), F.slice(list_, at + 1, window)


def found(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """For each text with a hit its key (_bw_k1, _bw_k2), `spans` and `items`, as a written table."""
    marks, lengths = item_fingerprints(items, window, gram)
    few = marks.count() <= BROADCAST_ROWS
    hashes = marks.select("_bw_hash").dropDuplicates()
    keyed = docs.select(*_key(), "text")
    own = _marked(keyed.select(*KEY, words(F.col("text")).alias("_bw_words")), fingerprints(F.col("_bw_words"), window, gram, lengths), *KEY)
    met = own.join(F.broadcast(hashes) if few else hashes, "_bw_hash", "left_semi")
    places = written(met.groupBy(*KEY).agg(F.collect_set(F.struct(F.col("_bw_at").alias("at"), F.col("_bw_hash").alias("hash"))).alias("places")), "places")
    texts = keyed.join(F.broadcast(places) if places.count() <= BROADCAST_TEXTS else places, KEY)
    texts = texts.groupBy(*KEY).agg(F.any_value("text").alias("text"), F.any_value("places").alias("places"))  # equal texts once

    def near(list_: Column) -> Column:
        def place(p: Column) -> Column:
            before, after = _context(list_, p["at"], window - gram, window)
            return F.struct(p["at"].alias("at"), p["hash"].alias("_bw_hash"), before.alias("own_before"), after.alias("own_after"))

        return F.transform("places", place)

    rows = texts.select(*KEY, F.inline(let(words(F.col("text")), near)))
    hits = rows.join(F.broadcast(marks) if few else marks, "_bw_hash")
    span = F.struct((F.col("at") - _agree(F.col("own_before"), F.col("before"))).alias("from"), (F.col("at") + _agree(F.col("own_after"), F.col("after"))).alias("to"))
    agreed = hits.select(*KEY, "item_id", "need", span.alias("span")).where(F.col("span.to") - F.col("span.from") >= F.col("need"))
    return written(agreed.groupBy(*KEY).agg(F.collect_set("span").alias("spans"), F.collect_set("item_id").alias("items")), "found")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs' columns with `n_words`, `spans` (from and to of hit runs, each once) and `items` (their ids)."""
    if not 0 < gram <= window:
        raise ValueError("gram must be from 1 to window")
    hit = found(docs.select("text"), items, window, gram)
    kept = [c for c in docs.columns if c not in ("n_words", "spans", "items")]
    counted = docs.select(*kept, *_key(), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    met = counted.join(F.broadcast(hit) if hit.count() <= BROADCAST_TEXTS else hit, KEY, "left")
    empty = lambda c: F.coalesce(c, F.array().cast(hit.schema[c].dataType))
    return met.select(*kept, "n_words", empty("spans").alias("spans"), empty("items").alias("items"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents without a hit, in docs' columns."""
    kept = docs.columns
    own = docs.select(*[F.col(c).alias(f"_bw_{i}") for i, c in enumerate(kept)], "doc_id", "text") if {"n_words", "spans", "items"} & set(kept) else docs
    good = contamination(own, items).where(F.size("spans") == 0)
    return good.select(*[F.col(f"_bw_{i}").alias(c) for i, c in enumerate(kept)]) if own is not docs else good.select(*kept)


def digests(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's rows."""
    found = contamination(docs.select("doc_id", "text"), items)
    hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["from"], s["to"] - 1))))).cast("long")
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
