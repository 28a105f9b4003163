"""Exact removal of byte strings that also start in a document of smaller id, by sorted suffixes.

Texts are packed into batches of about BATCH bytes and written once to the shared folder; later steps exchange
small messages with these batches, by their number.

1. The WIDTH - GRAM + 1 grams of a window of WIDTH bytes have a minimum hash, its anchor: equal windows have equal
   anchors. Each batch sends its distinct anchor hashes, 32 bits of each, to the partition of the hash; a bit
   comes back for each that another document may have too. (A false positive only costs work.)
2. Runs of windows with the same anchor of that kind go, as one string each, to the partition of their anchor, so
   equal windows meet there. A batch sends equal strings once, with the smallest id that has it: a string that a
   third of all documents share comes once from each batch, and is sorted once.
3. There all suffixes that start a window are sorted to WIDTH bytes: by characters of eight bytes each,
   ever deeper inside equal runs, down to SHALLOW bytes; the groups of equal prefix that are left are ordered by
   blind tries, all groups at once and a branch of each at a time: a member is held against the head of its group
   once, which tells where they differ; the group branches at the first such place, by the byte there alone, and
   only those that branch off are held against a new head. Equal windows stand together in the order, and a bit goes
   back for each window: whether a smaller id has it than the smallest that the batch knows.
4. Each batch marks the bytes of its removed windows.

Messages: a batch has one for each partition it has anchors for, so there are batches times partitions of them until
each holds few anchors (some 30 at 1 TB), and never more than there are anchors: in proportion to the input, but by
then with as many bytes for the message as for what it carries. All messages of a batch are about as large as a part
of the batch. Partitions of shuffles grow with the counted bytes.

Defined results. Null and empty texts, and those shorter than WIDTH bytes, lose nothing. A null doc_id counts as
larger than all others; rows of equal doc_id don't take from each other. A text longer than a batch is a batch of its
own, held whole by a task. An empty table gives no rows. Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basewright.llm.common import dealt, mixed, written

WIDTH, GRAM, SHALLOW = 50, 20, 16
BATCH = 2 << 20
#: Bytes of text for each partition of anchors, and of runs, at most as long as they are spread evenly.
ANCHOR_BYTES, RUN_BYTES = 256 << 20, 8 << 20
#: Places whose anchors are found at once: few enough to stay in the cache, and to be numbered by 16 bits with a window.
BLOCK = 1 << 14
LAST = (1 << 63) - 1
_MULTIPLY, _AGAIN, _NEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Masks of the first 0 to 8 bytes of a little-endian word.
_FRONT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


@lru_cache(1)
def _zstd() -> tuple:
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _zip(x: bytes) -> bytes:
    return _zstd()[0].compress(x)


def _unzip(x: bytes) -> bytes:
    return _zstd()[1].decompress(x)


def _words(data: np.ndarray, order: str = "<") -> np.ndarray:
    """The eight bytes at each place but the last seven: a view, without a copy."""
    return np.ndarray((max(len(data) - 7, 0),), f"{order}u8", data, 0, (1,))


def _stable(key: np.ndarray) -> np.ndarray:
    """The stable order of keys, which leave as many high bits as their number has."""
    bits = np.uint64(len(key).bit_length())
    x = key.astype(np.uint64) << bits | np.arange(len(key), dtype=np.uint64)
    x.sort()
    return (x & (np.uint64(1) << bits) - np.uint64(1)).astype(np.int64)


def packed(docs: DataFrame, batch_bytes: int = BATCH) -> DataFrame:
    """batch, docs (ids), given (whether the id isn't null), sizes, data (compressed bytes of all texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(held: list) -> pa.RecordBatch:
            ids = [LAST if d is None else d for d, _ in held]
            columns = [[ids], [[d is not None for d, _ in held]], [[len(t) for _, t in held]], [_zip(b"".join(t for _, t in held))]]
            kinds = pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["docs", "given", "sizes", "data"])

        held, total = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                held.append((doc, data))
                total += len(data) + 8
                if total >= batch_bytes:
                    yield row(held)
                    held, total = [], 0
        if held:
            yield row(held)

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "docs array<long>, given array<boolean>, sizes array<long>, data binary")
    return written(rows.select(F.monotonically_increasing_id().alias("batch"), "*"), "packed")


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hashes of all byte strings of length gram, from words of eight bytes that may overlap."""
    count = max(len(data) - gram + 1, 0)
    x = _words(np.concatenate([data, np.zeros(8, np.uint8)]))[: len(data)]
    x = (x if gram >= 8 else x & _FRONT[gram]) * _MULTIPLY
    x ^= x >> np.uint64(32)
    x *= _AGAIN
    out = x[:count]
    for at in [*range(8, gram - 7, 8), *([gram - 8] if gram > 8 and gram % 8 else [])]:
        out = out * _NEXT
        out += x[at : at + count]
    return out


class Windows:
    """The runs of a batch's windows that share an anchor, by place: document, start, windows, hash of the anchor."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, width: int = WIDTH, gram: int = GRAM, block: int = BLOCK):
        ends = np.cumsum(sizes)
        begins, stops = ends - sizes, ends - np.minimum(sizes, width - 1)  # windows start before these
        places, left = max(len(data) - width + 1, 0), width - gram + 1
        cut = np.zeros(len(data) + 1, bool)
        cut[begins] = cut[stops] = True
        number = np.arange(block + left - 1, dtype=np.uint64)
        starts, hashes, last = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], -1
        for at in range(0, places, block):
            each = gram_hashes(data[at : min(at + block, places) + width - 1], gram)
            low, span = each & np.uint64(0xFFFFFFFFFFFF0000) | number[: len(each)], 1
            while 2 * span <= left:
                low = np.minimum(low[:-span], low[span:])
                span *= 2
            if span < left:
                low = np.minimum(low[: len(low) - (left - span)], low[left - span :])
            anchor = (low & np.uint64(0xFFFF)).astype(np.int64)
            new = cut[at : at + len(anchor)]
            new[1:] |= anchor[1:] != anchor[:-1]
            new[0] |= anchor[0] + at != last
            first, last = np.flatnonzero(new), int(anchor[-1]) + at
            starts.append(first + at)
            hashes.append(each[anchor[first]])
        start = np.concatenate(starts)
        doc = np.repeat(np.arange(len(sizes)), np.diff(np.searchsorted(start, begins), append=len(start)))
        inside = start < stops[doc]
        self.start, self.count, self.doc = start[inside], np.diff(start, append=places)[inside], doc[inside]
        self.hash = mixed(np.concatenate(hashes)[inside])


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(_unzip(row["data"]), np.uint8)
    return data, np.array(row["docs"], np.int64), np.array(row["sizes"], np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For as many windows of each run: the run of each window, its place there, and where each run's begin."""
    first = np.cumsum(count) - count
    of = np.repeat(np.arange(len(count)), count)
    return of, np.arange(len(of)) - first[of], first


def distinct_anchors(windows: Windows, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch's anchors: part, 32 bits, whether two documents here have it, by (part, bits); and each run's number."""
    part = windows.hash % np.uint64(parts)
    key = part << np.uint64(32) | (windows.hash // np.uint64(parts)) & np.uint64(0xFFFFFFFF)
    keys, inverse = np.unique(key, return_inverse=True)
    some = np.empty(len(keys), np.int64)
    some[inverse] = windows.doc
    twice = np.zeros(len(keys), bool)
    twice[inverse[windows.doc != some[inverse]]] = True
    return (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), twice, inverse


def _cut(parts: np.ndarray) -> Iterator[tuple[int, slice]]:
    at = np.flatnonzero(np.diff(parts, prepend=-1) != 0)
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(parts)], strict=False):  # no parts: none
        yield int(parts[a]), slice(a, b)


def _send_anchors(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            data, _, sizes = _opened(row)
            part, bits, twice, _ = distinct_anchors(Windows(data, sizes), parts)
            out = [(row["batch"], p, bits[s].tobytes(), np.packbits(twice[s]).tobytes()) for p, s in _cut(part)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["batch", "part", "bits", "twice"])

    return run


def _answer_anchors(table: pa.Table) -> pa.Table:
    bits = [np.frombuffer(x, np.uint32) for x in table.column("bits").to_pylist()]
    twice = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(b)) for x, b in zip(table.column("twice").to_pylist(), bits, strict=True)]
    _, inverse, count = np.unique(np.concatenate(bits), return_inverse=True, return_counts=True)
    shared = (count + np.bincount(inverse, np.concatenate(twice), len(count)) > 1)[inverse]
    ends = np.cumsum([len(b) for b in bits])[:-1]
    return pa.table({"batch": table.column("batch"), "part": table.column("part"), "bits": pa.array([np.packbits(x).tobytes() for x in np.split(shared, ends)], pa.binary())})


def _known(row: dict, windows: Windows, parts: int) -> np.ndarray:
    """Which runs of a batch have an anchor that another document may have."""
    part, _, _, inverse = distinct_anchors(windows, parts)
    shared = np.zeros(len(part), bool)
    answers = {x["part"]: x["bits"] for x in row["anchors"] or []}
    for p, s in _cut(part):
        shared[s] = np.unpackbits(np.frombuffer(answers[p], np.uint8), count=s.stop - s.start).astype(bool)
    return shared[inverse]


def distinct_strings(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strings of data: of each the number of its distinct string, and of these the first that is equal."""
    places = range(0, int(size.max(initial=1)), 8)
    word = _words(np.concatenate([data, np.zeros(8 * len(places) + 8, np.uint8)]))
    key = mixed(size.astype(np.uint64))
    for at in places:
        key = (key ^ word[start + at] & _FRONT[np.clip(size - at, 0, 8)]) * _MULTIPLY
        key ^= key >> np.uint64(32)
    order = _stable(key * _AGAIN >> np.uint64(32))
    key = key[order]
    like = np.flatnonzero(key[1:] == key[:-1]) + 1
    like = like[size[order[like]] == size[order[like - 1]]]
    for at in places:  # only those with the hash of the one before are compared, eight bytes of each at a time
        one, other, front = start[order[like]] + at, start[order[like - 1]] + at, _FRONT[np.clip(size[order[like]] - at, 0, 8)]
        like = like[(word[one] ^ word[other]) & front == 0]
    new = np.ones(len(order), bool)
    new[like] = False
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


class Runs:
    """The runs of a batch that go out: equal strings once, in the order (part, hash, first place)."""

    def __init__(self, data: np.ndarray, docs: np.ndarray, windows: Windows, shared: np.ndarray, parts: int):
        self.start, self.count, self.place = windows.start[shared], windows.count[shared], windows.doc[shared]
        self.doc = docs[self.place]
        size = self.count + WIDTH - 1
        number, head = distinct_strings(data, self.start, size)
        part = ((windows.hash[shared] >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)[head]
        by_part = _stable(part)
        place = np.empty(len(head), np.int64)
        place[by_part] = np.arange(len(head))
        self.number = place[number]  # of each run: its string
        self.part, head = part[by_part], head[by_part]
        self.size, self.head = size[head], self.start[head]
        self.least = np.full(len(head), LAST)
        np.minimum.at(self.least, self.number, self.doc)

    def text(self, data: np.ndarray) -> np.ndarray:
        """The strings, one after the other."""
        places = np.arange(0, int(self.size.max(initial=1)), 8)
        text = _words(np.concatenate([data, np.zeros(8 * len(places) + 8, np.uint8)]))[self.head[:, None] + places].view(np.uint8)
        return text[np.arange(text.shape[1]) < self.size[:, None]]


def _send_runs(anchor_parts: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            data, docs, sizes = _opened(row)
            windows = Windows(data, sizes)
            runs = Runs(data, docs, windows, _known(row, windows, anchor_parts), parts)
            text, at = runs.text(data), np.concatenate([[0], np.cumsum(runs.size)])
            out = []
            for p, s in _cut(runs.part):
                out.append((row["batch"], p, _zip(text[at[s.start] : at[s.stop]].tobytes()), _zip(runs.size[s].astype(np.uint16).tobytes()), _zip(runs.least[s].tobytes())))
            if out:
                kinds = pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["batch", "part", "text", "sizes", "least"])

    return run


def sorted_windows(data: np.ndarray, starts: np.ndarray, width: int = WIDTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes at starts in the order of their first width bytes, and where in it equal ones begin (flags).

    width must be 8 more than a multiple of 8 at least; data must go on for width bytes after each start.
    """
    word = _words(np.concatenate([data, np.zeros(8, np.uint8)]), ">").astype(np.uint64)
    key = word[starts]
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(order) else np.zeros(0, bool)
    for depth in range(8, shallow, 8):  # multikey quicksort: equal runs are sorted by the next character
        more = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(more):
            return order, new
        run, key = np.cumsum(new[more]), word[starts[order[more]] + depth]
        by_key = np.argsort(key)
        rank = np.empty(len(key), np.int64)
        rank[by_key] = np.cumsum(np.diff(key[by_key], prepend=key[by_key[:1]]) != 0)
        again = np.argsort(run * (len(key) + 1) + rank)
        order[more], run, key = order[more[again]], run[again], key[again]
        new[more[1:]] |= (run[1:] != run[:-1]) | (key[1:] != key[:-1])
    more = np.flatnonzero(~(new & np.append(new[1:], True)))
    depths = [*range(shallow, width - 7, 8)]
    if depths[-1] + 8 < width:
        depths.append(width - 8)

    def first_difference(at: np.ndarray, head: np.ndarray) -> np.ndarray:
        """The first byte in which suffixes differ from others, width if none."""
        out = np.full(len(at), width, np.int64)
        for depth in reversed(depths):
            x = word[at + depth] ^ word[head + depth]
            off = np.flatnonzero(x)
            if len(off):
                lead = np.zeros(len(off), np.int64)
                rest = x[off]
                for bits in (32, 16, 8):
                    clear = rest >> np.uint64(64 - bits) == 0
                    lead[clear] += bits // 8
                    rest = np.where(clear, rest << np.uint64(bits), rest)
                out[off] = depth + lead
        return out

    # the blind tries of all groups, a branch of each at a time: members are held against their group's head once
    begins = np.flatnonzero(new[more])
    run = np.cumsum(new[more]) - 1
    at = starts[order[more]]
    differ = first_difference(at, at[begins][run]) if len(more) else np.empty(0, np.int64)
    while len(more):
        branch = np.minimum.reduceat(differ, begins)[run]
        open_ = branch < width
        more, run, at, differ, branch = (x[open_] for x in (more, run, at, differ, branch))
        if not len(more):
            break
        byte = data[at + branch]
        again = _stable(run << 8 | byte)  # only the byte at the branch is looked at
        order[more] = order[more[again]]
        run, byte, at, differ, branch = (x[again] for x in (run, byte, at, differ, branch))
        new[more[1:]] |= (run[1:] != run[:-1]) | (byte[1:] != byte[:-1])
        last = np.concatenate([new[more[1:]], [True]])
        stay = ~(new[more] & last)
        more, at, differ, branch = (x[stay] for x in (more, at, differ, branch))
        begins, run = np.flatnonzero(new[more]), np.cumsum(new[more]) - 1
        # who branched off has a new head and is held against it; the others keep theirs, and what is known of it
        off = np.flatnonzero(differ == branch)
        differ[off] = first_difference(at[off], at[begins][run[off]])
    return order, new


def _answer_runs(table: pa.Table) -> pa.Table:
    columns = [[_unzip(x) for x in table.column(c).to_pylist()] for c in ("text", "sizes", "least")]
    sizes = [np.frombuffer(x, np.uint16).astype(np.int64) for x in columns[1]]
    size, least = np.concatenate(sizes), np.frombuffer(b"".join(columns[2]), np.int64)
    data = np.frombuffer(b"".join(columns[0]), np.uint8)
    begin = np.cumsum(size) - size
    number, head = distinct_strings(data, begin, size)  # what several batches sent is sorted once
    lowest = np.full(len(head), LAST)
    np.minimum.at(lowest, number, least)
    of, step, first = _spread(size[head] - WIDTH + 1)
    order, new = sorted_windows(data, begin[head][of] + step)
    found = np.empty(len(order), np.int64)
    found[order] = np.minimum.reduceat(lowest[of[order]], np.flatnonzero(new))[np.cumsum(new) - 1]
    of, step, _ = _spread(size - WIDTH + 1)
    bit = found[first[number][of] + step] < least[of]
    ends = np.cumsum([int(s.sum()) - len(s) * (WIDTH - 1) for s in sizes])[:-1]
    return pa.table({"batch": table.column("batch"), "part": table.column("part"), "bits": pa.array([np.packbits(x).tobytes() for x in np.split(bit, ends)], pa.binary())})


def _finish(anchor_parts: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            data, docs, sizes = _opened(row)
            windows = Windows(data, sizes)
            runs = Runs(data, docs, windows, _known(row, windows, anchor_parts), parts)
            answers = {x["part"]: x["bits"] for x in row["runs"] or []}
            count = runs.size - WIDTH + 1
            first = np.cumsum(count) - count
            bits = [np.unpackbits(np.frombuffer(answers[p], np.uint8), count=int(count[s].sum())) for p, s in _cut(runs.part)]
            smaller = np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
            # windows of the runs that went out: gone if a smaller id has them, here or elsewhere
            of, step, _ = _spread(runs.count)
            gone = (runs.doc > runs.least[runs.number])[of] | smaller[first[runs.number][of] + step] if len(of) else np.zeros(0, bool)
            start, doc = (runs.start[of] + step)[gone], runs.place[of][gone]
            # removed spans: windows that overlap or touch, inside a document
            opens = np.ones(len(start), bool)
            opens[1:] = (np.diff(start) > WIDTH) | (np.diff(doc) != 0)
            begin, doc = start[opens], doc[opens]
            end = start[np.append(opens[1:], True)] + WIDTH if len(start) else begin
            change = np.zeros(len(data) + 1, np.int8)
            change[begin] += 1
            change[end] -= 1
            kept = data[np.cumsum(change[:-1], dtype=np.int8) == 0]
            removed = np.bincount(doc, end - begin, len(sizes)).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(sizes - removed)]).astype(np.int32)
            columns = [
                pa.array(docs, mask=~np.array(row["given"], bool)),
                *(pa.array(c, pa.int64()) for c in (sizes, removed, np.bincount(doc, minlength=len(sizes)))),
                pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def _met(batches: DataFrame, answers: DataFrame, name: str, total: int) -> DataFrame:
    """The answers of all partitions to each batch: as many bits in all as the batch has asked for."""
    each = dealt(answers, total, "batch").groupBy("batch").agg(F.collect_list(F.struct("part", "bits")).alias(name))
    return dealt(batches, total, "batch").join(each, "batch", "left")


def deduplicated(docs: DataFrame, batch_bytes: int = BATCH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary): what is left of each text."""
    rows = packed(docs, batch_bytes)
    total = rows.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    anchor_parts, parts = max(least, -(-total // ANCHOR_BYTES)), max(4 * least, -(-total // RUN_BYTES))
    answer = "batch long, part long, bits binary"
    asked = rows.mapInArrow(_send_anchors(anchor_parts), "batch long, part long, bits binary, twice binary")
    anchors = written(dealt(asked, total // 4, "part").groupBy("part").applyInArrow(_answer_anchors, answer), "anchors")
    known = _met(rows, anchors, "anchors", total)
    sent = known.mapInArrow(_send_runs(anchor_parts, parts), "batch long, part long, text binary, sizes binary, least binary")
    answers = written(dealt(sent, total, "part").groupBy("part").applyInArrow(_answer_runs, answer), "runs")
    return _met(known, answers, "runs", total).mapInArrow(_finish(anchor_parts, parts), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(docs: DataFrame) -> DataFrame:
    """The contract's rows."""
    return deduplicated(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
