"""Removal of repeated multi-line chunks, in DataFrame operations only.

The query and the pipeline take rolling chunks (`rolling=True`): one at each line that isn't blank, from it to the
next such line, so that neighbours share a line. A run of two such lines or more that stands in an earlier place
is made of chunks that stand there too, and goes whole, wherever it starts and however short it is. A line
that goes stands in an earlier place each time, so some place of it always stays.

Without `rolling`, chunks don't overlap: a rolling hash over two neighbouring line hashes is taken at each line; a
chunk ends after each line whose rolling hash is a strict local minimum (below the one before, not above the one
after). That depends on four neighbouring lines alone, so boundaries come again after lines were put in elsewhere,
but a passage that holds no two boundaries isn't found, nor are the ends of any other.

Chunks of two lines or more whose hash occurs more than once are compared by their bytes; of equal ones the first
stays: the one in the smallest doc_id, there the topmost. All others go, but for those that overlap the first.

Chunks with a repeated hash are written once; only they carry their text into a shuffle, that which compares their
bytes, pre-aggregated for each task. Owners are a small written table: broadcast when there are few, else joined by
hash with a plain exchange on either side, so that Spark splits the chunks of a hot hash. Where different texts share
a hash, they are joined by their bytes. A text of any length is handled inside its own row.

Defined results. A null text has no lines and stays null; an empty text is one empty line. Null doc_ids come
after all others, among each other nothing is removed but repeats inside one text. Rows that repeat a doc_id
don't remove each other's chunks (neither comes first); each is decided by its own text. Texts without repeats
stay as they are, byte for byte. An empty table gives no rows. Columns named `n_lines` or `n_removed` are replaced by
`line_deduplicated` and kept as they are by `cleaned`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basewright.llm.common import written
from basewright.llm.decontaminate import let

LEAST_LINES = 2
#: Repeated hashes and owners (one or two longs) are broadcast when counted to be so many at most (some 60 MB as a hash table).
BROADCAST_ROWS = 1_000_000
LAST = (1 << 63) - 1


def _chunk_list(lines: Column) -> Column:
    """Chunks of a text as structs of number, start (from 0) and length in lines."""

    def cut(rolling: Column) -> Column:
        n = F.size(rolling)
        inner = F.when(n >= 3, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
        ends = F.filter(inner, lambda i: (F.get(rolling, i) < F.get(rolling, i - 1)) & (F.get(rolling, i) <= F.get(rolling, i + 1)))
        starts = F.concat(F.array(F.lit(0)), F.transform(ends, lambda i: i + 1))
        return let(starts, lambda s: F.transform(s, lambda start, k: F.struct(k.alias("k"), start.alias("start"), (F.coalesce(F.get(s, k + 1), n) - start).alias("n"))))

    def roll(hashes: Column) -> Column:
        return F.transform(hashes, lambda h, i: F.xxhash64(F.coalesce(F.get(hashes, i - 1), F.lit(0)), h))

    hashes = F.transform(lines, lambda x: F.xxhash64(x))
    return let(hashes, lambda h: let(roll(h), cut))


def _rolling_list(lines: Column) -> Column:
    """Rolling chunks of a text, as _chunk_list has them: from each line that isn't blank to the next such line."""

    def cut(at: Column) -> Column:
        later = F.slice(at, F.lit(2), F.greatest(F.size(at) - 1, F.lit(0)))
        return F.transform(later, lambda end, k: F.struct(k.alias("k"), F.get(at, k).alias("start"), (end - F.get(at, k) + 1).alias("n")))

    marked = F.transform(lines, lambda x, i: F.when(F.btrim(x, F.lit(" \t\r")) != "", i))
    return let(F.filter(marked, lambda i: i.isNotNull()), cut)


def _list(lines: Column, rolling: bool) -> Column:
    return _rolling_list(lines) if rolling else _chunk_list(lines)


def _texts(lines: Column, chunks: Column) -> Column:
    """Chunks with their text's hash and text."""
    whole = F.transform(chunks, lambda c: F.struct(c["k"].alias("k"), c["start"].alias("start"), c["n"].alias("n"), F.array_join(F.slice(lines, c["start"] + 1, c["n"]), "\n").alias("text")))
    return F.transform(whole, lambda c: F.struct(c["k"].alias("k"), c["start"].alias("start"), c["n"].alias("n"), F.xxhash64(c["text"]).alias("hash"), c["text"].alias("text")))


def _rows(docs: DataFrame, rolling: bool) -> DataFrame:
    """A row for each chunk of LEAST_LINES lines or more; `again`: a chunk above in the same text is equal."""
    made = let(F.split("text", "\n"), lambda lines: let(_texts(lines, _list(lines, rolling)), lambda all_: _local(all_)))
    own = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("row"), F.explode(made).alias("c"))
    return own.select("doc", "row", "c.*")


def _local(chunks: Column) -> Column:
    """Multi-line chunks of a text, each with whether its first equal hash has the same text and ends above."""

    def each(hashes: Column) -> Column:
        def one(c: Column) -> Column:
            first = F.get(chunks, F.array_position(hashes, c["hash"]).cast("int") - 1)
            return F.struct(c["k"].alias("k"), c["hash"].alias("hash"), c["text"].alias("text"), ((first["start"] + first["n"] <= c["start"]) & (first["text"] == c["text"])).alias("again"))

        return F.transform(F.filter(chunks, lambda c: c["n"] >= LEAST_LINES), one)

    return let(F.transform(chunks, lambda c: c["hash"]), each)


def removals(docs: DataFrame, rolling: bool = False) -> DataFrame:
    """For each text with something to remove its doc, row (hash of the text) and the numbers of the chunks that go."""
    rows = _rows(docs.select("doc_id", "text").where("text IS NOT NULL"), rolling)
    repeated = written(rows.groupBy("hash").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("hash"), "hashes")
    small = F.broadcast(repeated) if repeated.count() <= BROADCAST_ROWS else repeated
    alike = written(rows.join(small, "hash", "left_semi"), "chunks")
    # here bytes are compared: a row for each different text, pre-aggregated for each task
    texts = alike.groupBy("hash", "text").agg(F.min("doc").alias("owner"), F.count(F.lit(1)).alias("many"))
    # nearly always all texts of a hash are one: then the hash stands for it, and no text is shuffled again
    owners = texts.groupBy("hash").agg(F.collect_list(F.struct("text", "owner", "many")).alias("texts"))
    first = F.get("texts", F.lit(0))
    owners = written(owners.select("hash", F.when(F.size("texts") == 1, first["owner"]).alias("owner"), F.when(F.size("texts") == 1, first["many"]).alias("many"), F.when(F.size("texts") > 1, F.col("texts")).alias("texts")).where("many > 1 OR texts IS NOT NULL"), "owners")
    alone, mixed = owners.where("texts IS NULL").select("hash", "owner"), owners.where("texts IS NOT NULL").select("hash", F.explode("texts").alias("t")).where("t.many > 1").select("hash", "t.text", "t.owner")
    alone = F.broadcast(alone) if alone.count() <= BROADCAST_ROWS else alone
    goes = alike.select("hash", "doc", "row", "k", "again").join(alone, "hash").where("again OR owner < doc").select("doc", "row", "k")
    if mixed.limit(1).count():
        goes = goes.unionByName(alike.join(mixed, ["hash", "text"]).where("again OR owner < doc").select("doc", "row", "k"))
    return goes.groupBy("doc", "row").agg(F.collect_set("k").alias("gone"))


def line_deduplicated(docs: DataFrame, rolling: bool = False) -> DataFrame:
    """docs with `text` without its repeated chunks, and `n_lines`, `n_removed` (lines) long."""
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    gone = removals(docs, rolling).withColumnsRenamed({"doc": "_bw_doc", "row": "_bw_row", "gone": "_bw_gone"})
    keyed = docs.select(*kept).withColumn("_bw_id", F.coalesce("doc_id", F.lit(LAST))).withColumn("_bw_hash", F.xxhash64("text"))
    met = keyed.join(gone, (F.col("_bw_id") == F.col("_bw_doc")) & (F.col("_bw_hash") == F.col("_bw_row")), "left")

    def stay(lines: Column) -> Column:
        gone = F.filter(_list(lines, rolling), lambda c: F.array_contains("_bw_gone", c["k"]))
        places = F.flatten(F.transform(gone, lambda c: F.sequence(c["start"], c["start"] + c["n"] - 1)))
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places)
        return F.transform(left, lambda i: F.get(lines, i))

    left = F.when(F.col("_bw_gone").isNotNull(), let(F.split("text", "\n"), stay))
    met = met.withColumn("_bw_left", left).withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long"))
    removed = F.when(F.col("_bw_left").isNull(), 0).otherwise(F.col("n_lines") - F.size("_bw_left")).cast("long")
    text = F.when(F.col("_bw_left").isNull(), F.col("text")).otherwise(F.array_join("_bw_left", "\n"))
    return met.withColumn("n_removed", removed).select(*[text.alias("text") if c == "text" else c for c in kept], "n_lines", "n_removed")


def cleaned(docs: DataFrame) -> DataFrame:
    """docs' columns with the new text, `n_chars` brought up to date; texts that lost everything are left out.

    Other columns are carried through whatever their names; an empty table gives no rows.
    """
    other = [c for c in docs.columns if c not in ("doc_id", "text")]
    private = docs.select("doc_id", "text", *[F.col(c).alias(f"_bw_c{i}") for i, c in enumerate(other)])
    out = line_deduplicated(private, rolling=True).where("n_removed = 0 OR trim(text) <> ''")
    back = {c: F.col(f"_bw_c{i}") for i, c in enumerate(other)}
    if "n_chars" in back:
        back["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(back["n_chars"])
    return out.select(*[back[c].alias(c) if c in back else c for c in docs.columns])


def digests(docs: DataFrame) -> DataFrame:
    """A row for each document: lines, lines removed, and what is left by size and digest."""
    out = line_deduplicated(docs.select("doc_id", "text"), rolling=True)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_removed", F.char_length(text).cast("long").alias("kept_chars"), F.sha2(F.encode(text, "UTF-8"), 256).alias("kept_sha256"))
