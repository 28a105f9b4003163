import zlib

from basewright.llm import sharding


def test_every_row_once_and_shards_even(spark):
    rows = [(i % 50 if i % 9 else None, f"text {i % 60}" if i % 7 else None, "x") for i in range(333)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = sharding.digests(df, bucket_bytes=3_000).collect()
    again = sharding.digests(df.repartition(3), bucket_bytes=3_000).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sorted(((x.doc_id, x.text_crc32) for x in got), key=str) == sorted(((i, zlib.crc32((t or "").encode())) for i, t, _ in rows), key=str)
    slots = {s: sorted(x.slot for x in got if x.shard == s) for s in range(16)}
    assert all(v == list(range(len(v))) for v in slots.values()) and {len(v) for v in slots.values()} <= {20, 21}


def test_shuffled_and_seeded(spark):
    df = spark.range(2_000).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    order = lambda seed: [x.doc_id for x in sharding.digests(df, seed=seed).orderBy("shard", "slot").collect()]
    a, b = order(1), order(2)
    assert a != b and a != sorted(a)
    assert abs(sum(i * x for i, x in enumerate(a)) / sum(i * i for i in range(2_000)) - 0.75) < 0.05


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert sorted((x.shard, x.slot) for x in sharding.digests(df).collect()) == [(0, 0), (8, 0)]
    assert sharding.digests(df.limit(0)).count() == 0


def test_equal_rows_are_spread(spark):
    rows = spark.range(100_000).selectExpr("cast(null as long) AS doc_id", "cast(null as string) AS text").unionByName(spark.range(500).selectExpr("id AS doc_id", "repeat(cast(id AS string), 20) AS text"))
    keyed = sharding.external_shuffle(rows, bucket_bytes=50_000)
    got = keyed.groupBy("shard").count().collect()
    assert sorted(x["count"] for x in got) == [6281] * 12 + [6282] * 4
    # the named rows are spread among the others, as a shuffle does
    places = [x.shard for x in keyed.where("doc_id IS NOT NULL").collect()]
    assert len(places) == 500 and min(map(places.count, range(16))) > 10
    again = sharding.digests(rows.repartition(7), bucket_bytes=50_000).where("doc_id IS NOT NULL").collect()
    assert sorted((x.doc_id, x.shard, x.slot) for x in again) == sorted((x.doc_id, x.shard, x.slot) for x in keyed.where("doc_id IS NOT NULL").collect())


def test_sizes_and_broadcast_bounds(spark, monkeypatch):
    rows = [(1, "é" * 10), (2, None), (3, ""), (4, "x" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(1, 21), (2, 1), (3, 1), (4, 300_001)}
    assert {(x.doc_id, x.size) for x in sharding.digests(df, bucket_bytes=1_000).collect()} == want
    before = sorted(map(str, sharding.digests(df, bucket_bytes=100).collect()))
    monkeypatch.setattr(sharding, "BROADCAST_BUCKETS", -1)
    assert sorted(map(str, sharding.digests(df, bucket_bytes=100).collect())) == before
