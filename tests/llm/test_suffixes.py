import random
import tracemalloc

import numpy as np
import pytest

from basewright.llm import suffixes


def plain(rows):
    first = {}
    rank = lambda d: suffixes.LAST if d is None else d
    for doc, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - 49):
            w = data[i : i + 50]
            first[w] = min(first.get(w, suffixes.LAST), rank(doc))
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 49):
            if first[data[i : i + 50]] < rank(doc):
                gone[i : i + 50] = b"\1" * 50
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone, strict=True) if not g)))
    return sorted(out, key=str)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["the", "of", "éa", "tion", "ing", f"w{rnd.randint(0, 400)}"])
    passages = [" ".join(word() for _ in range(rnd.randint(8, 60))) for _ in range(6)]
    rows = []
    for i in range(90):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 40)))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a, b = sorted(rnd.sample(range(len(p)), 2))
            parts += [p if rnd.random() < 0.5 else p[a:b], " ".join(word() for _ in range(rnd.randint(0, 9)))]
        rows.append((rnd.randint(0, 60) if i % 11 else None, "".join(parts)))
    rows += [rows[3], (61, rows[3][1]), (62, ""), (63, None), (64, "a" * 300), (65, "a" * 49), (66, "a" * 120), (67, "ab" * 90), (5, "ba" * 200)]
    return rows


@pytest.mark.parametrize("batch", [400, 1 << 20])
def test_against_all_windows(spark, batch):
    rows = corpus(8)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in suffixes.deduplicated(df, batch).collect()]
    want = plain(rows)
    assert sorted(got, key=str) == want and sum(x[2] for x in want) > 5_000


def test_sorted_windows():
    rnd = np.random.default_rng(3)
    base = rnd.integers(97, 99, 700).astype(np.uint8)
    data = np.concatenate([base, base[100:400], np.full(150, 97, np.uint8), base[350:]])
    starts = np.arange(len(data) - 50)
    order, new = suffixes.sorted_windows(data, starts)
    texts = [data[s : s + 50].tobytes() for s in starts[order]]
    assert texts == sorted(texts)
    assert new.tolist() == [i == 0 or texts[i] != texts[i - 1] for i in range(len(texts))]


def test_equal_strings_are_sorted_once(monkeypatch):
    rnd = random.Random(4)
    strings = ["".join(rnd.choices("abcdefgh ", k=rnd.randint(50, 80))).encode() for _ in range(30)]
    sizes, least = np.array([len(s) for s in strings]), np.arange(30)
    windows, zipped = int(sizes.sum()) - 30 * 49, suffixes._zip
    sent = [  # twelve batches have the same strings
        {"batch": b, "part": 0, "text": zipped(b"".join(strings)), "sizes": zipped(sizes.astype(np.uint16).tobytes()), "least": zipped((least + b).tobytes())}
        for b in range(12)
    ]
    sorted_, calls = suffixes.sorted_windows, []
    monkeypatch.setattr(suffixes, "sorted_windows", lambda data, starts: calls.append(len(starts)) or sorted_(data, starts))
    bits = suffixes._answer_runs(suffixes.pa.Table.from_pylist(sent)).column("bits").to_pylist()
    assert calls == [windows]  # not twelve times as many
    for b, x in enumerate(bits):
        assert np.unpackbits(np.frombuffer(x, np.uint8), count=windows).tolist() == [b > 0] * windows


def test_windows_by_blocks():
    rnd = np.random.default_rng(7)
    data = rnd.integers(97, 100, 3_000).astype(np.uint8)
    data[500:900] = 97
    sizes = np.array([0, 700, 49, 50, 0, 1_200, 51, 3, 900, 47, 0])
    whole = suffixes.Windows(data, sizes)
    starts = [b + i for b, n in zip(np.cumsum(sizes) - sizes, sizes, strict=True) for i in range(n - 49)]
    assert [s + i for s, n in zip(whole.start, whole.count, strict=True) for i in range(n)] == starts
    ends = np.cumsum(sizes)
    assert (whole.start + whole.count + 49 <= ends[whole.doc]).all() and (whole.start >= (ends - sizes)[whole.doc]).all()
    for block in (1, 31, 200):
        other = suffixes.Windows(data, sizes, block=block)
        for name in ("start", "count", "doc", "hash"):
            assert getattr(other, name).tolist() == getattr(whole, name).tolist()
    grams = suffixes.mixed(suffixes.gram_hashes(data, suffixes.GRAM))
    for s, n, h in zip(whole.start.tolist(), whole.count.tolist(), whole.hash, strict=True):
        assert h in grams[s + n - 1 : s + 31]  # the anchor stands in each of its windows


def test_distinct_strings():
    data = np.frombuffer(b"abcabcabcdabc" + bytes(9) + b"abc\0", np.uint8)
    start, size = np.array([0, 3, 6, 10, 22, 6, 0, 22]), np.array([3, 3, 3, 3, 3, 4, 9, 4])
    number, head = suffixes.distinct_strings(data, start, size)
    strings = [data[a : a + n].tobytes() for a, n in zip(start, size, strict=True)]
    assert sorted(strings[h] for h in head) == sorted(set(strings)) and [strings[head[k]] for k in number] == strings


def test_memory_of_equal_runs():
    data = np.full(200_000, 97, np.uint8)  # each window has an anchor of its own
    windows = suffixes.Windows(data, np.array([len(data)]))
    shared = np.ones(len(data) - 49, bool)
    tracemalloc.start()
    runs = suffixes.Runs(data, np.array([1]), windows, shared, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(runs.size) == 1 and peak < 200 * len(shared)  # no table of the bytes of all strings


def test_gram_hashes():
    data = np.random.default_rng(1).integers(0, 256, 300).astype(np.uint8)
    data[200:240] = data[100:140]
    for n in (1, 2, 3, 5, 8, 13, 20, 31):
        h = suffixes.gram_hashes(data, n)
        assert len(h) == 301 - n and h[100] == h[200] and len(set(h.tolist())) == len({data[i : i + n].tobytes() for i in range(301 - n)})


def test_empty(spark):
    assert suffixes.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
