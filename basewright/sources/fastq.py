"""Reading and writing FASTQ and FASTA.

Plain, gzip and bzip2 files are read by Spark's text reader, from any store it knows; plain and bzip2 files are
split. Records are cut in the task that reads the lines, column by column over whole batches, so lines are never
shuffled: only those of the records that cross the border of two blocks (about one record a block) meet in a small
table, and a row for each block gives records their number in the file. xz files, which Spark's codecs lack, and a
file whose first bytes tell another codec than its ending, are read whole by Spark and decompressed in the task.

Bytes are UTF-8; a field that isn't valid UTF-8 is read as Latin-1, so no character is lost. Files are written in
UTF-8. Blank lines between records are skipped. A malformed record raises; with DROPMALFORMED reading goes on at the
next line that starts with @ and has a line that starts with + two lines on.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import sys
from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from basewright.shared import fresh_path, hadoop_path, written

#: Endings and first bytes of the three formats, in the order in which they are tried.
CODECS = (("gz", b"\x1f\x8b", gzip.open), ("bz2", b"BZh", bz2.open), ("xz", b"\xfd7zXZ\x00", lzma.open))
MODES = ("FAILFAST", "DROPMALFORMED")
#: Blocks (a row of four longs each) are broadcast when counted to be so many at most.
BROADCAST_BLOCKS = 1_000_000
#: Lines handled together where a whole file is decompressed in a task.
LINES = 40_000

_RECORDS = "file long, block long, n long, id string, seq string, qual string"
_BLOCKS = "file long, block long, n long, head array<binary>, tail array<binary>"


def opened(data: bytes) -> BinaryIO:
    """The content of a file, decompressed as its first bytes say; all members of it."""
    return next((open_(io.BytesIO(data), "rb") for _, magic, open_ in CODECS if data.startswith(magic)), io.BytesIO(data))


def _text(x: bytes) -> str:
    try:
        return x.decode("utf-8")
    except UnicodeDecodeError:
        return x.decode("latin-1")


def _strings(column: pa.Array) -> pa.Array:
    try:
        return column.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([_text(x) for x in column.to_pylist()], pa.string())


def _starts(lines: list[bytes], i: int) -> bool:
    return lines[i][:1] == b"@" and lines[i + 2][:1] == b"+"


def scanned(lines: list[bytes], mode: str) -> tuple[list[tuple[int, bytes, bytes, bytes]], int]:
    """Records of a list of lines one by one, with their first line's number, and how many lines are done with."""
    out, i, n = [], 0, len(lines)
    while i + 3 < n:
        if not lines[i]:
            i += 1
        elif _starts(lines, i) and len(lines[i + 1]) == len(lines[i + 3]):
            out.append((i, lines[i], lines[i + 1], lines[i + 3]))
            i += 4
        elif mode == "FAILFAST":
            raise ValueError(f"malformed record at {_text(lines[i])!r}")
        else:
            i = next((k for k in range(i + 1, n - 2) if _starts(lines, k)), max(i + 1, n - 3))
    while i < n and not lines[i]:
        i += 1
    return out, i


class Scanner:
    """Cuts the lines of one block into records as they come. Before the first record of a block that starts inside a
    file, lines are kept as `head`; those after the last whole record are its `tail`."""

    def __init__(self, block: int, mode: str):
        self.mode, self.synced = mode, block == 0
        self.head: list[bytes] = []
        self.tail: list[bytes] = []

    def feed(self, lines: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """id lines, bases and qualities of the records that are whole now."""
        if self.tail:
            lines = pa.concat_arrays([pa.array(self.tail, pa.binary()), lines])
            self.tail = []
        if not self.synced:
            every = lines.to_pylist()
            first = next((i for i in range(len(every) - 2) if _starts(every, i)), None)
            if first is None:
                self.tail = every
                return (pa.array([], pa.binary()),) * 3
            self.head, self.synced, lines = every[:first], True, lines.slice(first)
        n = len(lines) // 4
        name, seq, plus, qual = (lines.take(pa.array(np.arange(k, 4 * n, 4))) for k in range(4))
        good = pc.and_(pc.and_(pc.starts_with(name, b"@"), pc.starts_with(plus, b"+")), pc.equal(pc.binary_length(seq), pc.binary_length(qual)))
        sound = n if pc.all(good, min_count=0).as_py() else int(np.argmin(good.to_numpy(zero_copy_only=False)))
        rest = lines.slice(4 * sound).to_pylist()
        found, done = scanned(rest, self.mode) if len(rest) > 3 else ([], 0)
        self.tail = rest[done:]
        out = tuple(x.slice(0, sound) for x in (name, seq, qual))
        if found:
            out = tuple(pa.concat_arrays([x, pa.array([r[k] for r in found], pa.binary())]) for k, x in enumerate(out, 1))
        return out

    def close(self) -> None:
        """The block is a whole file: nothing may be left."""
        left = [x for x in self.tail if x]
        if left and self.mode == "FAILFAST":
            raise ValueError(f"malformed record at {_text(left[0])!r}: the file ends inside it")


def _batch(file: int, block: int, n: int, columns: tuple[pa.Array, pa.Array, pa.Array]) -> pa.RecordBatch:
    name, seq, qual = map(_strings, columns)
    size = len(name)
    places = [pa.array(np.full(size, file)), pa.array(np.full(size, block)), pa.array(np.arange(n, n + size))]
    return pa.RecordBatch.from_arrays([*places, pc.utf8_slice_codeunits(name, 1), seq, qual], names=["file", "block", "n", "id", "seq", "qual"])


def _cutter(mode: str, whole: bool, summary: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (file, block, value): the records, or (summary) a row for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, scanner, n = None, Scanner(0, mode), 0

        def ended() -> Iterator[pa.RecordBatch]:
            if now is not None and whole:
                scanner.close()
            if now is not None and summary:
                parts = pa.array([scanner.head], pa.list_(pa.binary())), pa.array([scanner.tail], pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in (*now, n)), *parts], names=["file", "block", "n", "head", "tail"])

        for batch in batches:
            file, block = (batch.column(i).to_numpy() for i in (0, 1))
            cuts = [0, *(np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), len(file)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if (place := (int(file[a]), int(block[a]))) != now:
                    yield from ended()
                    now, scanner, n = place, Scanner(place[1], mode), 0
                columns = scanner.feed(batch.column(2).slice(a, b - a))
                if len(columns[0]) and not summary:
                    yield _batch(*now, n, columns)
                n += len(columns[0])
        yield from ended()

    return run


def _stitcher(mode: str) -> Callable[[pa.Table], pa.Table]:
    """Records that cross the borders of a file's blocks, numbered after those inside the block they begin in."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda x: x["block"])
        lines, owner = [], []
        for x in rows:
            lines += x["head"] + x["tail"]
            owner += [x["block"]] * (len(x["head"]) + len(x["tail"]))
        found, done = scanned(lines, mode)
        if done < len(lines) and mode == "FAILFAST":
            raise ValueError(f"malformed record at {_text(lines[done])!r}: the file ends inside it")
        counts: dict[int, int] = {}
        out = []
        for i, name, seq, qual in found:
            n = counts[owner[i]] = counts.get(owner[i], -1) + 1
            out.append({"file": rows[0]["file"], "block": owner[i], "n": n, "id": _text(name)[1:], "seq": _text(seq), "qual": _text(qual)})
        kinds = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("id", pa.string()), ("seq", pa.string()), ("qual", pa.string())])
        return pa.Table.from_pylist(out, kinds)

    return run


def _decompressed(mode: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (file, content): lines of whole files, decompressed here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0), batch.column(1), strict=True):
                scanner, n = Scanner(0, mode), 0
                with opened(data.as_py()) as lines:
                    while part := [x for _, x in zip(range(LINES), lines, strict=False)]:
                        columns = scanner.feed(pa.array([x.rstrip(b"\r\n") for x in part], pa.binary()))
                        if len(columns[0]):
                            yield _batch(file.as_py(), 0, n, columns)
                            n += len(columns[0])
                scanner.close()

    return run


def _odd(spark: SparkSession, names: list[str]) -> bool:
    """Whether Spark's text reader would not see the text: xz, or a file whose first bytes and ending disagree."""
    if any(x.endswith(".xz") for x in names):
        return True
    if len(names) != 1:
        return False
    target, files = hadoop_path(spark, names[0])
    stream = files.open(target)
    head = bytes(x for x in (stream.read() for _ in range(6)) if x >= 0)
    stream.close()
    ending = next((e for e, _, _ in CODECS if names[0].endswith(f".{e}")), "")
    return head != b"" and next((e for e, magic, _ in CODECS if head.startswith(magic)), "") != ending


def _unsplit(spark: SparkSession) -> int:
    """The length up to which Spark leaves a file in one part."""
    conf = spark._jsparkSession.sessionState().conf()
    return min(conf.filesMaxPartitionBytes(), conf.filesOpenCostInBytes())


def read_fastq(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """read_idx, id, seq, qual of one file, or of all files of a folder in the order of their names."""
    mode = mode.upper()
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_path").alias("name"), "length")
    first = files.orderBy(F.desc(F.col("name").endswith(".xz")), "name").limit(2).collect()
    some = [x.name for x in first]
    if _odd(spark, some):
        whole = spark.read.format("binaryFile").load(path).select(F.xxhash64("_metadata.file_path").alias("file"), "content")
        rows, crossing = whole.mapInArrow(_decompressed(mode), _RECORDS), None
        if len(some) == 1:
            return rows.select(F.col("n").alias("read_idx"), "id", "seq", "qual")
        blocks = written(rows.groupBy("file", "block").agg((F.max("n") + 1).alias("n")), "blocks")
    else:
        lines = spark.read.text(path).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
        alone = len(some) == 1 and (some[0].endswith(".gz") or first[0].length <= _unsplit(spark))
        rows = lines.mapInArrow(_cutter(mode, alone, False), _RECORDS)
        if alone:  # one file in one task: nothing to number or to stitch
            return rows.select(F.col("n").alias("read_idx"), "id", "seq", "qual")
        blocks = written(lines.mapInArrow(_cutter(mode, False, True), _BLOCKS), "blocks")
        # the lines at the borders of one file: about a record for each block
        crossing = written(blocks.where("size(head) + size(tail) > 0").groupBy("file").applyInArrow(_stitcher(mode), _RECORDS), "crossing")
    more = crossing.groupBy("file", "block").agg(F.count(F.lit(1)).alias("more")) if crossing is not None else blocks.select("file", "block", F.lit(0).alias("more"))
    sized = blocks.select("file", "block", F.col("n").alias("inner")).join(more, ["file", "block"], "left").join(files, "file")
    total = F.col("inner") + F.coalesce("more", F.lit(0))
    first = F.sum(total).over(W.orderBy("name", "block").rowsBetween(W.unboundedPreceding, W.currentRow)) - total  # a row for each block of input
    places = sized.select("file", "block", "inner", first.alias("first"))
    places = F.broadcast(places) if blocks.count() <= BROADCAST_BLOCKS else places
    out = rows.join(places, ["file", "block"]).select((F.col("first") + F.col("n")).alias("read_idx"), "id", "seq", "qual")
    if crossing is None:
        return out
    return out.unionByName(crossing.join(places, ["file", "block"]).select((F.col("first") + F.col("inner") + F.col("n")).alias("read_idx"), "id", "seq", "qual"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).toDF("name")


#: Barcodes or adapters in a file at most; more raise.
MOST_LISTED = 100_000


def _listed(spark: SparkSession, path: str, kept: str) -> list[Row]:
    """Lines of a small file in its order, those for which `kept` (of `line`) holds counted against the bound."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r\n|\n|\r")).alias("k", "line")).where("line <> ''")
    if lines.where(kept).limit(MOST_LISTED + 1).count() > MOST_LISTED:
        raise ValueError(f"more than {MOST_LISTED} entries in the list")
    return lines.orderBy("k").collect()


def read_barcodes(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """The table of barcodes, small by its nature, in the order of the file."""
    rows = [x.line.split("\t") for x in _listed(spark, path, "true")]
    if any(len(x) < 2 for x in rows):
        raise ValueError("each line needs a barcode, a tab and a sample")
    return [(x[0], x[1]) for x in rows]


def read_fasta(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Names and sequences of a small FASTA file (a list of adapters), sequences of several lines joined."""
    out: list[list] = []
    for x in _listed(spark, path, "line LIKE '>%'"):
        if x.line.startswith(">"):
            out.append([x.line[1:], []])
        elif out:
            out[-1][1].append(x.line)
    return [(name, "".join(parts)) for name, parts in out]


def read_adapters(spark: SparkSession, path: str) -> list[str]:
    return [seq for _, seq in read_fasta(spark, path)]


def write_lines(lines: DataFrame, path: str, codec: str = "none", mode: str = "overwrite") -> None:
    """read_idx and value as text files whose names are in the order of the reads; codec none, gzip or bzip2."""
    lines.repartitionByRange("read_idx").sortWithinPartitions("read_idx").select("value").write.mode(mode).option("compression", codec).text(path)


def write_routed(lines: DataFrame, route: str, path: str, codec: str = "none", mode: str = "overwrite") -> None:
    """One pass to many outputs: a folder for each value of the column `route`; a large one is written by many tasks."""
    ordered = lines.repartitionByRange(F.col(route), F.col("read_idx")).sortWithinPartitions(route, "read_idx")
    ordered.select(route, "value").write.mode(mode).partitionBy(route).option("compression", codec).text(path)


def writer(path: str | None, append: bool = False, level: int = 6, kind: str = "u") -> BinaryIO:
    """A local file, compressed by its ending, or standard output, compressed by kind: g, b, x or u (not)."""
    mode = "ab" if append else "wb"
    ending = {"g": ".gz", "b": ".bz2", "x": ".xz", "u": ""}[kind] if path is None else path
    target = path or io.BufferedWriter(_Out())
    if ending.endswith(".gz"):
        return gzip.open(target, mode, level)
    if ending.endswith(".bz2"):
        return bz2.open(target, mode, level)
    if ending.endswith(".xz"):
        return lzma.open(target, mode, preset=level)
    return open(path, mode) if path else target


class _Out(io.RawIOBase):
    """Standard output that stays open when a writer over it is closed."""

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        sys.stdout.buffer.write(bytes(data))
        sys.stdout.buffer.flush()
        return len(data)


def write_file(lines: DataFrame, path: str | None, append: bool = False, level: int = 6, header: str = "", kind: str = "u") -> int:
    """One local file (or standard output) in the order of the reads; the driver holds one partition at a time."""
    n = 0
    with writer(path, append, level, kind) as out:
        if header:
            out.write(header.encode() + b"\n")
        for row in lines.orderBy("read_idx").select("value").toLocalIterator():
            out.write(row.value.encode() + b"\n")
            n += 1
        out.flush()
    return n


def write_files(lines: DataFrame, route: str, path_of: Callable[[object], str], append: bool = False, level: int = 6) -> dict:
    """Local files, one for each value of `route`, in one ordered pass; returns how many records each got."""
    counts: dict = {}
    out = None
    for row in lines.orderBy(route, "read_idx").select(route, "value").toLocalIterator():
        if row[0] not in counts:
            if out:
                out.close()
            counts[row[0]], out = 0, writer(path_of(row[0]), append, level)
        out.write(row[1].encode() + b"\n")
        counts[row[0]] += 1
    if out:
        out.close()
    return counts


def roundtrip(reads: DataFrame) -> DataFrame:
    """reads written as gzipped FASTQ and read back."""
    from basewright.operators.rowwise import fastq_lines

    path = fresh_path(reads.sparkSession, "fastq")
    write_lines(fastq_lines(reads), path, "gzip")
    return read_fastq(reads.sparkSession, path)
