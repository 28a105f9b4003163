"""Results that must not depend on how the data is dealt over partitions and blocks."""

import gzip
import lzma
import random

import pytest
from pyspark.sql import functions as F

from basewright.functions import exprs
from basewright.operators import paired, position, rowwise, sample
from basewright.plans.fixtures import made, mates
from basewright.schema import READS
from basewright.sources import fastq

SPLIT = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.files.maxPartitionBytes": "20k", "spark.sql.files.openCostInBytes": "0"}


@pytest.fixture
def split(spark):
    before = {k: spark.conf.get(k, None) for k in SPLIT}
    for k, v in SPLIT.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_ranks_are_a_permutation_in_key_order(spark, split, tmp_path):
    made(spark, "/root/testdata/sf0.01", "reads").write.parquet(f"{tmp_path}/reads")
    reads = spark.read.parquet(f"{tmp_path}/reads")
    n = reads.count()
    keys = {"name": lambda x: x.id, "length": lambda x: len(x.seq), "gc": lambda x: sum(map(x.seq.count, "GC")) / len(x.seq)}
    for key, of in keys.items():
        got = sorted(position.renumbered(position.sort_reads(reads, key)).collect(), key=lambda x: x.rank)
        assert [x.rank for x in got] == list(range(n))
        assert [(of(x), x.read_idx) for x in got] == sorted((of(x), x.read_idx) for x in got)
    mixed = position.renumbered(sample.shuffled(reads)).collect()
    assert sorted(x.rank for x in mixed) == list(range(n)) and sorted(x.read_idx for x in mixed) == list(range(n))


def records(n):
    rnd = random.Random(n)
    sizes = [rnd.randint(0, 80) for _ in range(n)]
    return [(f"n{i} é", "".join(rnd.choice("ACGT") for _ in range(k)), "".join(rnd.choice("@+I#") for _ in range(k))) for i, k in enumerate(sizes)]


def text(rows):
    return "".join(f"@{a}\n{b}\n+{a if i % 3 == 0 else ''}\n{c}\n" for i, (a, b, c) in enumerate(rows))


def read(spark, path, *mode):
    return sorted(map(tuple, fastq.read_fastq(spark, str(path), *mode).collect()))


@pytest.mark.parametrize("size", ["20k", "700", "90"])
def test_records_that_cross_blocks(spark, split, tmp_path, size):
    rows = records(2000 if size == "20k" else 60)
    (tmp_path / "x.fq").write_text(text(rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert fastq._unsplit(spark) < (tmp_path / "x.fq").stat().st_size
    assert read(spark, tmp_path / "x.fq") == [(i, *r) for i, r in enumerate(rows)]


def test_lines_are_not_shuffled(spark, split, tmp_path):
    (tmp_path / "x.fq").write_text(text(records(50)))
    (tmp_path / "x.fq.gz").write_bytes(gzip.compress(text(records(50)).encode()))
    alone = fastq.read_fastq(spark, f"{tmp_path}/x.fq.gz")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in alone
    whole = fastq.read_fastq(spark, f"{tmp_path}/x.fq")._jdf.queryExecution().executedPlan().toString()
    assert whole.count("MapInArrow") == 1 and not any("MapInArrow" in x for part in whole.split("Exchange hashpartitioning")[1:] for x in part.split("Join")[0].splitlines())


def test_blank_lines_and_damaged_records(spark, tmp_path):
    rows = records(40)
    path = tmp_path / "x.fq"
    path.write_text(text(rows[:20]) + "\n\n" + text(rows[20:]) + "\n\n")
    assert read(spark, path) == [(i, *r) for i, r in enumerate(rows)]
    path.write_text(text(rows[:5]) + "@three lines\nAC\n+\n" + text(rows[5:]))
    assert [x[1:] for x in read(spark, path, "DROPMALFORMED")] == rows
    for end in ("@x\nAC\n", "@x\nAC\n+\nI\n"):
        path.write_text(text(rows) + end)
        with pytest.raises(Exception, match="malformed"):
            read(spark, path)
        assert read(spark, path, "dropmalformed") == [(i, *r) for i, r in enumerate(rows)]


def test_codecs_by_first_bytes_and_encodings(spark, tmp_path):
    rows = records(30)
    want = [(i, *r) for i, r in enumerate(rows)]
    (tmp_path / "packed.fq").write_bytes(gzip.compress(text(rows).encode()))
    (tmp_path / "plain.gz").write_text(text(rows))
    (tmp_path / "xz.fq").write_bytes(lzma.compress(text(rows).encode()))
    for name in ("packed.fq", "plain.gz", "xz.fq"):
        assert read(spark, tmp_path / name) == want, name
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "a.fq.xz").write_bytes(lzma.compress(text(rows).encode()))
    (tmp_path / "two" / "b.fq").write_text(text(rows))
    assert read(spark, tmp_path / "two") == [(i, *r) for i, r in enumerate(rows * 2)]
    (tmp_path / "latin.fq").write_bytes("@é\nAC\n+\nII\n@日\nA\n+\nI\n".encode("latin-1", "replace") + "@日\nA\n+\nI\n".encode())
    got = fastq.read_fastq(spark, f"{tmp_path}/latin.fq")
    assert [x.id for x in got.orderBy("read_idx").collect()] == ["é", "?", "日"]
    fastq.write_file(rowwise.fastq_lines(got), f"{tmp_path}/again.fq")
    assert read(spark, tmp_path / "again.fq") == sorted(map(tuple, got.collect()))


def test_overlaps_are_computed_once(spark):
    pairs = made(spark, "/root/testdata/sf0.001", "pairs")
    plan = paired.join_overlap(pairs).where("overlap > 0").select("read_idx", "overlap")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_files_one_after_another(spark):
    one, two = mates(made(spark, "/root/testdata/sf0.001", "pairs"))
    first, second = position.concat_lanes([one, two, one.limit(0), one], [two, one, two, two])
    n = one.count()
    assert sorted(x.read_idx for x in first.select("read_idx").collect()) == list(range(3 * n)) and second.count() == 4 * n


def test_long_headers_keep_all_tokens(spark):
    rest = " ".join(map(str, range(3000)))
    reads = spark.createDataFrame([(0, f"a  {rest}", "A", "I")], READS)
    assert reads.select(exprs.other_tokens(F.col("id"))).first()[0] == f" {rest}"
    assert sample.sample(spark.range(50).selectExpr("id AS read_idx", "'x' AS id", "'A' AS seq", "'I' AS qual"), 9).count() == 9
