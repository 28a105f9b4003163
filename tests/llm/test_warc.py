import hashlib

from basewright.llm import warc

SCHEMA = "page_id long, url string, html string, record_type string"


def digest(x):
    return hashlib.sha256((x or "").encode()).hexdigest()


def test_equal_payloads_become_revisits(spark):
    long, short = "<p>ü" * 40, "x" * 99
    tricky = "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 5
    rows = [(5, "http://a\r\nX: y", long, "c"), (2, None, long, "c"), (9, "u", long, None), (1, "u", short, "c"), (3, "u", short, "c"), (4, "u", None, "c"), (6, "u", "", "c"), (7, "u", tricky, "c"), (8, "u", tricky, "c"), (None, "u", tricky, "c"), (2, "again", long, "c"), (10, "u", "z" * 3_000_000, "c")]
    got = warc.digests(spark.createDataFrame(rows, SCHEMA)).collect()
    want = [(k, len((h or "").encode()), digest(h), "revisit" if r else "response", r) for (k, _, h, _), r in zip(rows, [2, None, 2, None, None, None, None, None, 7, 7, None, None], strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_records_read_back_whole(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "p" * (i % 7) * 100, "") for i in range(40)]
    warc.write_archives(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/w", file_bytes=2_000)
    back = warc.read_archives(spark, f"{tmp_path}/w").collect()
    assert {(x.record_key, x.target_uri) for x in back} == {(i, u) for i, u, _, _ in rows}
    assert {x.record_key: bytes(x.payload).decode() for x in back if x.record_type == "response"}.items() <= {(i, h) for i, _, h, _ in rows}
    assert {x.record_key for x in back if x.record_type == "revisit"} == {i for i in range(7, 40) if i % 7}
    assert all(x.payload is None and x.refers_to == x.record_key % 7 for x in back if x.record_type == "revisit")


def test_empty(spark):
    assert warc.digests(spark.createDataFrame([], SCHEMA)).count() == 0
