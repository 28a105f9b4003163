import bz2
import gzip
import lzma

import pytest

from basewright import cli, streaming
from basewright.operators import aggregate, demux, paired, position, rowwise, sample, select
from basewright.plans import reports
from basewright.schema import PAIRS, READS
from basewright.sources import fastq

ROWS = [(0, "r0 d\tx  y", "ACGTN", "IIII#"), (1, "r1", "acgtACGTAC", "##########"), (2, "r2", "N", "I"), (3, "r1", "", "")]
TEXT = "".join(f"@{n}\n{s}\n+\n{q}\n" for _, n, s, q in ROWS[:3])


@pytest.fixture(scope="module")
def reads(spark):
    return spark.createDataFrame(ROWS, READS)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_positions(reads):
    assert got(position.tail(reads, 99)) == got(reads)
    assert [x.read_idx for x in position.take_range(reads, 1, 2).orderBy("read_idx").collect()] == [1, 2]
    a, b = position.split_interleaved(reads)
    assert got(position.interleave(a, b)) == got(reads)
    assert [x.read_idx for x in position.concat([reads.where("read_idx < 1"), reads]).orderBy("read_idx").collect()] == [0, 1, 2, 3, 4]
    assert [x.read_idx for x in position.sort_reads(reads, "length", True).collect()] == [1, 0, 2, 3]
    assert {x.rank for x in position.renumbered(sample.shuffled(reads)).collect()} == {0, 1, 2, 3}
    for wrong in (lambda: position.split_chunks(reads, 0), lambda: position.sort_reads(reads, "x"), lambda: sample.sample(reads, 0), lambda: position.concat_lanes([reads], [])):
        with pytest.raises(ValueError):
            wrong()


def test_rows(reads):
    assert got(rowwise.reverse(rowwise.reverse(reads.where("read_idx <> 1")))) == got(reads.where("read_idx <> 1"))
    assert rowwise.reverse(reads).where("read_idx = 1").first().seq == "GTACGTNNNN"
    assert got(rowwise.rescore(rowwise.rescore(reads, to64=True), to33=True)) == got(reads)
    assert rowwise.mask(reads, 5).where("read_idx = 0").first().seq == "ACGTN" and rowwise.mask(reads, 5).where("read_idx = 1").first().seq == "N" * 10
    assert tuple(rowwise.masked(reads, 5).first()) == (11, 2) and tuple(rowwise.masked(reads.limit(0)).first()) == (0, 0)
    assert rowwise.rename(reads, prefix="P", keep=True).first().id == "P1 d x y"
    assert [x.seq for x in rowwise.slide(reads.where("read_idx = 1"), 4, 4).orderBy("part").collect()] == ["acgt", "ACGT", "AC"]
    assert [x.seq for x in rowwise.slide(reads.where("read_idx = 1"), 10, 20).collect()] == ["acgtACGTAC"]
    assert rowwise.cut_adapters(reads, ["TACGT", "AC"], mismatch=0).where("read_idx = 1").first().seq == "acgtACGT"
    assert rowwise.flatten(reads, 15, "|", True, True, True).first().value == "r0 d\tx  y|ACGTN|+|IIII#|1|5|40.00"
    assert got(rowwise.trim(reads, 2, 2, 1)) == [(0, ROWS[0][1], "G", "I"), (1, "r1", "gtACGT", "######")]
    assert rowwise.sam_header("s", "g", "l", "p") == "@HD\tVN:1.6\tSO:queryname\n@RG\tID:g\tSM:s\tLB:l\tPL:p"
    for wrong in (lambda: rowwise.rescore(reads), lambda: rowwise.flatten(reads, 16), lambda: rowwise.slide(reads, 0), lambda: rowwise.mask(reads, phred=50)):
        with pytest.raises(ValueError):
            wrong()


def test_choosing(spark, reads):
    ids = spark.createDataFrame([("r1",), ("r1",), ("r0",)], "name string")
    assert [x.read_idx for x in select.grep(reads, ids).orderBy("read_idx").collect()] == [0, 1, 3]
    kept, gone = select.remove(reads, ids)
    assert {x.read_idx for x in kept.collect()} == {0, 2} and {x.read_idx for x in gone.collect()} == {1, 3}
    assert got(select.search(reads, "ac", True).unionByName(select.search(reads, "ac", True, True))) == got(reads)


def test_statistics(spark, reads):
    x = aggregate.summary(reads).first()
    assert (x.reads, x.bases, x.min_length, x.max_length, x.n, x.q30) == (4, 16, 0, 10, 2, 5)
    assert "total read count:\t4" in reports.summary_text(aggregate.summary(reads))
    assert sum(x.reads for x in aggregate.gc_histogram(reads).collect()) == 4
    empty = reads.limit(0)
    assert tuple(aggregate.size(empty).first()) == (0,) * 7 and aggregate.gc_histogram(empty).count() == 101
    assert reports.cycle_text(aggregate.cycle_bases(reads), aggregate.cycle_qualities(reads)).startswith("cycle\tA\tT\tG\tC\tN\t0")
    assert reports.plot_cycles(aggregate.cycle_bases(reads)).startswith("<svg") and reports.plot_gc(aggregate.gc_histogram(reads)).endswith("</svg>\n")
    assert reports.length_text(aggregate.lengths(reads)).splitlines()[:2] == ["lenth\tcount", "0\t1"]
    with pytest.raises(ValueError):
        aggregate.kmers(reads, 0)


def test_pairs(spark):
    frag = "ACGTACGGTTCAGTCCATGACTGACTTAGCATTACGGATC"
    comp = frag[::-1].translate(str.maketrans("ACGT", "TGCA"))
    rows = [(0, "a", frag[:35], "I" * 35, "a", comp[:35], "#" * 35), (1, "b", frag[:35], "I" * 35, "b", "T" * 35, "I" * 35), (2, "c", "A", "I", "c", "", "")]
    pairs = spark.createDataFrame(rows, PAIRS)
    out = {x.read_idx: x for x in paired.join_overlap(pairs).collect()}
    assert out[0].seq == frag and out[0].overlap == 30 and out[1].overlap == 0 and out[2].seq is None
    assert {x.read_idx for x in paired.filter_pairs(pairs).where("passed").collect()} == {1}
    tagged = demux.demultiplex(pairs, [(comp[:35][-4:][::-1], "s"), ("TTTT", "t")])
    assert {(x.read_idx, x.sample, x.barcode_seq) for x in tagged.collect()} == {(0, "s", comp[31:35]), (1, "t", "TTTT")}


@pytest.mark.parametrize("ending,pack", [("fq", bytes), ("fq.gz", gzip.compress), ("fq.bz2", bz2.compress), ("fq.xz", lzma.compress)])
def test_files(spark, tmp_path, ending, pack):
    path = tmp_path / f"x.{ending}"
    path.write_bytes(pack(TEXT.encode()) + pack(TEXT.encode()))
    rows = [(i, *r[1:]) for i, r in enumerate(ROWS[:3] * 2)]
    assert got(fastq.read_fastq(spark, str(path))) == sorted(rows, key=str)
    out = str(tmp_path / f"y.{ending}")
    assert fastq.write_file(rowwise.fastq_lines(spark.createDataFrame(rows, READS)), out) == 6
    assert got(fastq.read_fastq(spark, out)) == sorted(rows, key=str)


def test_malformed_and_many_blocks(spark, tmp_path):
    path = tmp_path / "x.fq"
    path.write_text(TEXT + "@bad\nAC\n+\nI\n" + TEXT)
    with pytest.raises(Exception, match="malformed"):
        fastq.read_fastq(spark, str(path)).collect()
    assert fastq.read_fastq(spark, str(path), "DROPMALFORMED").count() == 6
    big = tmp_path / "big.fq"
    big.write_text("".join(f"@n{i}\nACGT{'A' * (i % 50)}\n+\nIIII{'I' * (i % 50)}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = fastq.read_fastq(spark, str(big)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((x.read_idx, x.id) for x in rows) == [(i, f"n{i}") for i in range(3000)]


def test_stream_and_command_line(spark, reads, tmp_path):
    reads.write.parquet(f"{tmp_path}/in")
    stream = streaming.read_stream(spark, f"{tmp_path}/in")
    streaming.start(stream, "search", "memory", f"{tmp_path}/c1", "found", pattern="AC").awaitTermination(60)
    assert spark.table("found").count() == 2
    streaming.start(stream, "lengths", "memory", f"{tmp_path}/c2", "sizes").awaitTermination(60)
    assert got(spark.table("sizes")) == got(aggregate.lengths(reads))
    with pytest.raises(ValueError):
        streaming.start(stream, "tail", "memory", f"{tmp_path}/c3")
    ids = spark.createDataFrame([("r1",)], "name string")
    streaming.start(stream, "remove", "memory", f"{tmp_path}/c4", "rest", ids=ids).awaitTermination(60)
    assert got(spark.table("rest")) == got(select.remove(reads, ids)[0])
    streaming.start(stream, "gc_histogram", "memory", f"{tmp_path}/c5", "gc").awaitTermination(60)
    assert {x.gc: x.n for x in spark.table("gc").collect()} == {x.gc: x.reads for x in aggregate.gc_histogram(reads).where("reads > 0").collect()}
    with pytest.raises(ValueError):
        streaming.start(stream, "rename", "memory", f"{tmp_path}/c6", prefix="p")
    (tmp_path / "x.fq").write_text(TEXT)
    assert cli.run(spark, "size", f"{tmp_path}/x.fq").startswith("reads:3\tbases:12")
    assert cli.run(spark, "fq2fa", f"{tmp_path}/x.fq", "-o", f"{tmp_path}/x.fa") == 3
    assert fastq.read_adapters(spark, f"{tmp_path}/x.fa") == ["ACGTN", "acgtACGTAC", "N"]
