"""Near duplicates by Jaccard similarity of word shingles, with Bayesian pruning of candidates.

1. Each text becomes its set of hashed shingles, its 128 MinHash values and 32 band keys of four values each;
   texts with the same set become one node. A pair at 0.8 shares no band with probability 5e-8.
2. Candidates are the pairs that share a band. The nodes of a band key are its bucket; buckets that share nodes make a
   component. What is compared together (a unit) is a component if it fits one tile or if all its pairs are fewer than
   those of its buckets one by one (copies share most of their buckets, and are compared once that way); else, where
   similarity chains on and on, each bucket is a unit, and a pair counts in the first band that it shares.
3. A unit is compared in tiles of at most about TILE by TILE nodes and TILE_BYTES of text a side. Pairs are compared by
   MinHash values in rounds; after each, the posterior of the similarity (uniform prior) says how probable it is to
   reach the threshold, and pairs below TOLERANCE are dropped. Those that stay are verified on the exact sets. Tiles
   hand on counts of links and a spanning forest, never the pairs.
4. The components of the forests are the classes.

Cost and skew: shingling is one narrow pass; band keys, links and members are rows of a few longs. Tables with one row
for each key, bucket or class are written, and their joins are broadcast or split by Spark. A unit of n nodes
becomes n / TILE copies of its texts over n² / TILE² / 2 tiles; small units share a call up to CALL_BYTES, so that
no call holds more than two tiles' sides, a text longer than that alone. Nothing is capped.

Defined results. `n_links` of a document is the number of other documents at the threshold or above, copies
counted each. Texts without words (null among them) link only to equal texts. `class_id` is the smallest doc_id
of all that links connect; documents of the same set share `rep_id`, its smallest doc_id. Rows with a null doc_id are
compared and counted like others, and come after all others where the smallest id is chosen: class_id or rep_id is
null where no member has an id. Rows that repeat a doc_id are documents of their own in n_links; for class and rep, rows
that repeat both doc_id and text are one. `representatives` keeps one row of each class: of rows that repeat the
smallest doc_id the one of smallest text hash, and any one of rows that repeat both. An empty table gives no rows. Texts
of any length are shingled whole. Other columns aren't read, but carried through by `representatives`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basewright.llm.common import SHINGLE_WORDS, SIMILAR, WordHashes, dealt, mixed, shingles, spread_join, written
from basewright.llm.components import components

HASHES, BANDS, ROUND = 128, 32, 32
TOLERANCE = 1e-6
#: Nodes and bytes of text of a tile's side, and bytes of a call that takes several small units.
TILE, TILE_BYTES, CALL_BYTES = 512, 4 << 20, 4 << 20
#: Candidate documents (three longs each) are broadcast when counted to be so many at most.
BROADCAST_ROWS = 1_000_000
_BLOCK = 4096

_RANDOM = np.random.Generator(np.random.PCG64(5_021))
_XOR = _RANDOM.integers(0, 1 << 32, HASHES, dtype=np.uint32)[:, None]
_TIMES = _RANDOM.integers(0, 1 << 31, HASHES, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)


def minhash(hashes: np.ndarray) -> np.ndarray:
    """The 128 MinHash values of a set that isn't empty."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(short), _BLOCK):
        np.minimum(out, ((short[None, start : start + _BLOCK] ^ _XOR) * _TIMES).min(axis=1), out=out)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(BANDS, -1).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(parts.shape[1]):
        key = mixed(key ^ parts[:, i])
    return key.view(np.int64)


@lru_cache
def least_matches(n: int, similar: float, tolerance: float = TOLERANCE) -> int:
    """The fewest matches among n MinHash values that leave a posterior of tolerance for `similar` or more."""
    below = 0.0
    for m in range(n + 1):  # P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)
        below += math.comb(n + 1, m) * similar**m * (1 - similar) ** (n + 1 - m)
        if below >= tolerance:
            return m
    return n


def prune(a: np.ndarray, b: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], similar: float) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of rows of the signatures a and b those that no round drops."""
    i, j = pairs
    matches = np.zeros(len(i), np.int32)
    for start in range(0, HASHES, ROUND):
        for at in range(0, len(i), 1 << 16):  # 8 MB at a time
            part = slice(at, at + (1 << 16))
            matches[part] += (a[i[part], start : start + ROUND] == b[j[part], start : start + ROUND]).sum(axis=1, dtype=np.int32)
        keep = matches >= least_matches(start + ROUND, similar)
        i, j, matches = i[keep], j[keep], matches[keep]
    return i, j


def intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of pairs of sets."""
    if len(i) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    # many pairs: the incidence matrix of the shingles that two sets have at least, times its transpose
    every, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    shared = count[column] > 1
    number = np.cumsum(count > 1) - 1
    row, column = row[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float32)  # counts below 2^24 are exact
    for start in range(0, int(number[-1]) + 1 if len(number) else 0, _BLOCK):
        low, high = np.searchsorted(column, [start, start + _BLOCK])
        part = np.zeros((len(sets), _BLOCK), np.float32)
        part[row[low:high], column[low:high] - start] = 1
        total += part @ part.T
    return total[i, j].astype(np.int64)


def compared(left: list[np.ndarray], right: list[np.ndarray] | None, similar: float, band: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Pairs at the threshold: among left, or between left and right (whose numbers follow those of left).

    With a band, only pairs of which it is the first shared one.
    """
    sets = left + (right or [])
    size = np.array([len(x) for x in sets], np.int64)
    signature = np.stack([minhash(x) for x in sets])
    n = len(left)
    i, j = np.triu_indices(n, 1) if right is None else tuple(x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n, len(sets)), indexing="ij"))
    fits = np.minimum(size[i], size[j]) >= similar * np.maximum(size[i], size[j]) - 1e-9
    i, j = prune(signature, signature, (i[fits], j[fits]), similar)
    if band >= 0:
        keys = np.stack([band_keys(x) for x in signature])
        here = np.zeros(len(i), bool)
        for at in range(0, len(i), 1 << 16):
            same = keys[i[at : at + (1 << 16)]] == keys[j[at : at + (1 << 16)]]
            here[at : at + (1 << 16)] = same[:, band] & ~same[:, :band].any(axis=1)
        i, j = i[here], j[here]
    both = intersections(sets, i, j)
    good = both >= similar * (size[i] + size[j] - both) - 1e-9
    return i[good], j[good]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[int]:
    """For each of n things the smallest number that pairs connect it to."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def _tile(similar: float, width: int) -> Callable[[pa.Table], pa.Table]:
    hashes = WordHashes()

    def run(table: pa.Table) -> pa.Table:
        rows: dict[tuple, dict[int, tuple]] = {}
        columns = [table.column(x).to_pylist() for x in ("unit", "band", "low", "high", "block", "node", "many", "text")]
        for unit, band, low, high, block, node, many, text in zip(*columns, strict=True):
            rows.setdefault((unit, band, low, high), {})[node] = block, many, text
        out: tuple[list, list, list] = ([], [], [])
        for (_, band, low, high), nodes in rows.items():
            order = sorted(nodes, key=lambda x: (nodes[x][0], x))
            sets = [shingles(nodes[x][2], hashes, width) for x in order]
            n = sum(nodes[x][0] == low for x in order)
            if low != high and not 0 < n < len(order):
                continue
            i, j = compared(sets[:n], sets[n:] if low != high else None, similar, band)
            many = np.array([nodes[x][1] for x in order], np.int64)
            links = np.bincount(i, many[j], len(order)) + np.bincount(j, many[i], len(order))
            for column, values in zip(out, (order, links.astype(np.int64).tolist(), [order[x] for x in forest(len(order), i, j)]), strict=True):
                column.extend(values)
        return pa.table({"node": pa.array(out[0], pa.int64()), "links": pa.array(out[1], pa.int64()), "root": pa.array(out[2], pa.int64())})

    return run


def signed(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, text_hash, size (bytes), set_key (16 bytes that tell sets of shingles apart) and bands of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                keys, bands = [], []
                for text in part.column(3).to_pylist():
                    own = shingles(text, hashes, width)
                    keys.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else xxhash.xxh3_128_digest(b"text " + (text or "").encode("utf-8", "surrogatepass")))
                    bands.append(band_keys(minhash(own)) if len(own) else np.empty(0, np.int64))
                offsets = np.cumsum([0, *map(len, bands)])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(bands), pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(keys, pa.binary()), lists], names=["doc_id", "text_hash", "size", "set_key", "bands"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, size long, set_key binary, bands array<long>")


def units(sets: DataFrame, tile: int) -> DataFrame:
    """node, unit, band (-1: a component), n and bytes (of the unit's nodes and their texts), for nodes that share a band."""
    band = sets.select("node", "size", F.posexplode("bands").alias("band", "grp"))
    buckets = band.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("node").alias("first")).where("n > 1")
    members = written(spread_join(band, buckets, "grp"), "buckets")
    comps = written(components(members.select("node", "grp")).withColumnRenamed("label", "comp").join(sets.select("node", "size"), "node"), "comps")
    sizes = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    # the pairs of a component's buckets one by one, where it is more than a tile
    each = members.where("node = first").select("node", "n").join(comps.select("node", "comp"), "node")
    costs = each.groupBy("comp").agg(F.sum(F.col("n") * F.col("n")).alias("apart"))
    sizes = written(sizes.join(costs, "comp").select("comp", "n", "bytes", ((F.col("n") > tile) & (F.col("apart") < F.col("n") * F.col("n"))).alias("by_bucket")), "sizes")
    placed = spread_join(comps, sizes, "comp")
    whole = placed.where("NOT by_bucket").select("node", F.col("comp").alias("unit"), F.lit(-1).alias("band"), "n", "bytes")
    if not sizes.where("by_bucket").limit(1).count():
        return whole
    chained = placed.where("by_bucket").select("node")
    return whole.unionByName(members.join(chained, "node").select("node", F.col("grp").alias("unit"), "band", "n", "bytes"))


def join(docs: DataFrame, similar: float = SIMILAR, width: int = SHINGLE_WORDS, tile: int = TILE) -> DataFrame:
    """doc_id, text_hash, class_id, class_hash, rep_id, n_links: a row for each of docs.

    class_id and class_hash name the document that stands for the class.
    """
    rows = written(signed(docs, width), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    sets = rows.groupBy("set_key").agg(first, F.count(F.lit(1)).alias("many"), F.any_value("bands").alias("bands"), F.max("size").alias("size"))
    sets = written(sets.select(F.monotonically_increasing_id().alias("node"), "set_key", "first", "many", "bands", "size"), "sets")

    blocks = F.greatest(F.expr(f"(n + {tile - 1}) div {tile}"), F.expr(f"(bytes + {TILE_BYTES - 1}) div {TILE_BYTES}"), F.lit(1)).cast("int")
    placed = units(sets, tile).withColumn("blocks", blocks).join(sets.select("node", "many", "size", F.col("first.doc_id").alias("unit_doc"), F.col("first.text_hash").alias("unit_hash")), "node")
    placed = written(placed.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")), "units")
    n, total, alone = placed.agg(F.count(F.lit(1)), F.sum(F.col("size") * F.col("blocks")), F.sum(F.when(F.col("blocks") == 1, F.col("size")))).first()
    names = placed.select("node", "unit_doc", "unit_hash").dropDuplicates()
    small = F.broadcast(names) if n <= BROADCAST_ROWS else names
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    met = texts.join(small, F.col("doc_id").eqNullSafe(F.col("unit_doc")) & (F.col("text_hash") == F.col("unit_hash")))
    met = met.groupBy("node").agg(F.any_value("text").alias("text"))  # rows that repeat id and text
    spread = placed.select("node", "unit", "band", "blocks", "block", "many").join(met, "node")
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # tiles of one block are small: several go to one call; those of a large unit get a call each
    calls = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(alone or 0) // CALL_BYTES))
    call = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("unit", "band"), F.lit(calls))).otherwise(F.xxhash64("unit", "band", F.least("block", "other"), F.greatest("block", "other")))
    spread = spread.select(call.alias("call"), "unit", "band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "many", "text")
    done = written(dealt(spread, total or 0, "call").groupBy("call").applyInArrow(_tile(similar, width), "node long, links long, root long"), "tiles")

    links = done.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(done.select("node", F.col("root").alias("grp")).union(done.select("root", "root")))
    known = sets.select("node", "set_key", "first", "many").join(links, "node", "left").join(classes, "node", "left")
    lowest = known.where("label IS NOT NULL").groupBy("label").agg(F.min("first").alias("lowest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    known = spread_join(known, lowest, "label", "left").withColumn("of", F.coalesce("lowest", "first"))
    known = known.select("set_key", F.col("of.doc_id").alias("class_id"), F.col("of.text_hash").alias("class_hash"), F.col("first.doc_id").alias("rep_id"), (F.col("many") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"))
    return rows.join(known, "set_key").select("doc_id", "text_hash", "class_id", "class_hash", "rep_id", "n_links")


def representatives(docs: DataFrame) -> DataFrame:
    """docs' columns, one row of each class."""
    classed = join(docs.select("doc_id", "text"))
    stands = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_hash") == F.col("class_hash"))
    # what is to be done with rows by id and text: they go, or one of them stays; a row of its own isn't listed
    found = classed.groupBy(F.col("doc_id").alias("_bw_doc"), F.col("text_hash").alias("_bw_hash")).agg(F.bool_and(stands).alias("_bw_stays"), F.count(F.lit(1)).alias("_bw_n"))
    found = written(found.where("NOT _bw_stays OR _bw_n > 1").select("_bw_doc", "_bw_hash", "_bw_stays"), "found")
    same = F.col("doc_id").eqNullSafe(F.col("_bw_doc")) & (F.xxhash64("text") == F.col("_bw_hash"))
    met = docs.join(found, same, "left")
    out = met.where("_bw_stays IS NULL").select(docs.columns)
    if not found.where("_bw_stays").limit(1).count():
        return out
    return out.unionByName(met.where("_bw_stays").dropDuplicates(["_bw_doc", "_bw_hash"]).select(docs.columns))


def links(docs: DataFrame) -> DataFrame:
    """The query's rows."""
    return join(docs.select("doc_id", "text")).drop("text_hash", "class_hash")
