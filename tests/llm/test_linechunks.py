import random
import struct

import xxhash

from basewright.llm import linechunks


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def of_text(x, seed=42):
    return signed(xxhash.xxh64_intdigest(x.encode(), seed))


def of_long(x, seed=42):
    return signed(xxhash.xxh64_intdigest(struct.pack("<q", x), seed % (1 << 64)))


def chunks(lines):
    h = [of_text(x) for x in lines]
    r = [of_long(h[i], of_long(h[i - 1] if i else 0)) for i in range(len(h))]
    starts = [0] + [i + 1 for i in range(1, len(h) - 1) if r[i] < r[i - 1] and r[i] <= r[i + 1]]
    return [tuple(lines[a:b]) for a, b in zip(starts, starts[1:] + [len(lines)])]


def plain(rows):
    first = {}
    for doc, text in sorted((x for x in rows if x[1] is not None), key=lambda x: (x[0] is None, x[0] or 0)):
        for k, c in enumerate(chunks(text.split("\n"))):
            first.setdefault(c, (doc if doc is not None else linechunks.LAST, k))
    out = []
    for doc, text in rows:
        if text is None:
            out.append((doc, 0, 0, None))
            continue
        lines, left, seen = text.split("\n"), [], set()
        for k, c in enumerate(chunks(lines)):
            owner = first[c][0] if len(c) > 1 else None
            if len(c) > 1 and (owner < (doc if doc is not None else linechunks.LAST) or c in seen):
                continue
            seen.add(c)
            left += c
        out.append((doc, len(lines), len(lines) - len(left), "\n".join(left)))
    return out


def test_against_plain_version(spark):
    rnd = random.Random(3)
    passage = [f"shared line {i} é" for i in range(12)]
    rows = []
    for i in range(60):
        lines = [f"own {i} {rnd.random()}" for _ in range(rnd.randint(0, 9))]
        if i % 3:
            lines[len(lines) // 2 : len(lines) // 2] = passage
        if i % 10 == 1:
            lines += passage + ["x"] * 5
        rows.append((i, "\n".join(lines)))
    rows += [(7, rows[7][1]), (None, rows[8][1]), (None, rows[8][1]), (70, None), (71, ""), (72, "\n\n\n")]
    got = [(x.doc_id, x.n_lines, x.n_removed, x.text) for x in linechunks.line_deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)
    assert sum(x[2] for x in got) > 200


def test_without_broadcast(spark, monkeypatch):
    rows = [(i, "\n".join([f"a{i}", *map(str, range(20)), f"b{i}"])) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(str, linechunks.digests(df).collect()))
    monkeypatch.setattr(linechunks, "BROADCAST_ROWS", -1)
    assert sorted(map(str, linechunks.digests(df).collect())) == want


def test_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", 9, "s")], "doc_id long, text string, n_lines int, hash string")
    assert linechunks.cleaned(df).collect() == df.collect()
    assert linechunks.digests(df.limit(0)).count() == 0


def rolling(rows):
    """Rolling chunks by plain loops over rows of different doc_ids."""
    first, out = {}, []
    for doc, text in sorted(rows):
        lines = text.split("\n")
        at = [i for i, x in enumerate(lines) if x.strip(" \t\r")]
        gone = set()
        for a, b in zip(at, at[1:]):
            owner, end = first.setdefault(tuple(lines[a : b + 1]), (doc, b))
            if owner < doc or end < a:
                gone |= set(range(a, b + 1))
        out.append((doc, len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return out


def test_short_shared_passages_go_whole(spark):
    rnd = random.Random(5)
    line = lambda: " ".join(str(rnd.random()) for _ in range(4))
    rows, shared = [], 0
    for n in range(2, 7):
        for _ in range(12):
            passage = [line() for _ in range(n)]
            for _ in range(2):
                own = [line() for _ in range(rnd.randint(2, 8))]
                at = rnd.randint(0, len(own))
                rows.append((len(rows), "\n".join(own[:at] + passage + own[at:])))
            shared += n
    got = linechunks.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(x.n_removed for x in got) == shared
    assert all(x.n_removed == (0 if x.doc_id % 2 == 0 else 2 + x.doc_id // 24) for x in got)


def test_rolling_chunks_against_plain_version(spark):
    rnd = random.Random(6)
    rows = [(i, "\n".join(rnd.choice(["a", "b", "c", "é", "", " ", f"own {i}", f"{rnd.random()}"]) for _ in range(rnd.randint(0, 14)))) for i in range(80)]
    rows += [(100, "x\nx\nx\nx"), (101, "\n\n\n"), (102, ""), (103, "p\n\n\n\nq\n\n\n\nr")]
    got = [(x.doc_id, x.n_lines, x.n_removed, x.text) for x in linechunks.line_deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), rolling=True).collect()]
    assert sorted(got) == sorted(rolling(rows))
    assert {x[0]: x[2] for x in got}[100] == 2 and {x[0]: x[2] for x in got}[103] == 0
