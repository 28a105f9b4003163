import hashlib
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from basewright.llm import multiset


def test_contract(spark):
    texts = {i: "\n".join(f"Satz {i} {j} über. Noch einer {i * j}!" for j in range(i % 7)) for i in range(0, 90, 3)}
    rows = [*texts.items(), (1000, None), (5_000_000_000, "ü" * 100), (-(1 << 62), "low")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(rows, reverse=True)
    got = {x.doc_id: x for x in multiset.digests(df).collect()}
    assert len(got) == len(rows)
    for (doc, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        text, following = text or "", following or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        assert got[doc].n_chars == len(text)
        assert got[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[doc].fingerprint == got[doc].edited_fingerprint) == (text == edited)
        assert 0 <= got[doc].near_next <= 1 and (text != edited or got[doc].near_edited == 1)


def test_small_ranges_give_the_same(spark):
    df = spark.range(0, 500, 7).selectExpr("id AS doc_id", "concat('t', id) AS text")
    pairs = lambda n: sorted((x.doc_id, x.next_text) for x in multiset.with_next(df, n).where("NOT ghost").collect())
    assert pairs(1) == pairs(9) == pairs(10_000)
    assert dict(pairs(9))[0] == "t497" and dict(pairs(9))[497] == "t490"


def likeness(a, b):
    """Cosine of the sketches that two printed fingerprints hold."""
    if a == b:
        return 1.0
    lanes = []
    for x in (a, b):
        _, n, sketch = x.split("-")
        lanes.append([2 * int(sketch[i : i + 8], 16) - int(n, 16) for i in range(0, len(sketch), 8)])
    norm = math.sqrt(sum(x * x for x in lanes[0]) * sum(x * x for x in lanes[1]))
    return min(1.0, max(0.0, sum(x * y for x, y in zip(*lanes, strict=True)) / norm)) if norm else 0.0


def test_likeness_is_that_of_the_fingerprints(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice("red green blue grey é".split()) + str(rnd.randint(0, 30)) for _ in range(rnd.randint(0, 90)))) for i in range(40)] + [(50, "word " * 70_000), (None, "lone")]
    got = {x.doc_id: x for x in multiset.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted((x for x in got if x is not None), reverse=True)
    for doc, following in zip(order, order[1:] + order[:1], strict=True):
        x = got[doc]
        assert abs(x.near_edited - likeness(x.fingerprint, x.edited_fingerprint)) < 1e-9
        assert abs(x.near_next - likeness(x.fingerprint, got[following].fingerprint)) < 1e-9
    prints = spark.createDataFrame([(got[1].fingerprint, got[2].fingerprint, got[50].fingerprint)], "a string, b string, c string")
    back = prints.select(multiset.likeness_of(F.col("a"), F.col("b")), multiset.printed(multiset.parsed(F.col("c"))) == F.col("c")).first()
    assert abs(back[0] - likeness(got[1].fingerprint, got[2].fingerprint)) < 1e-9 and back[1]


def test_cells_stay_small(spark, monkeypatch):
    ids = [*range(3000), 1 << 62, -(1 << 63), (1 << 63) - 1] + [7] * 500
    rows = [(d, f"t{d} {k}") for k, d in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (multiset.BROADCAST_RANGES, -1):
        monkeypatch.setattr(multiset, "BROADCAST_RANGES", most)
        got = [x for x in multiset.with_next(df, 20).collect()]
        sizes = Counter(x.bucket for x in got)
        assert max(sizes.values()) <= 4 * 20 + 1
        named = [x for x in got if not x.ghost]
        assert sorted((x.doc_id, x.text) for x in named) == sorted(rows)
        following = {x.text: x.next_text for x in named}
        at, seen = rows[0][1], []
        for _ in rows:
            seen.append(at)
            at = following[at]
        assert at == rows[0][1] and len(set(seen)) == len(rows)
        places = [int(x.split()[0][1:]) for x in seen]
        assert sum(a < b for a, b in zip(places, places[1:], strict=False)) == 1  # once around, always downwards


def test_extra_columns_and_null_ids(spark):
    rows = [(None, "same", "a", 1)] * 5 + [(3, "same", "b", 2), (2, None, None, 3)]
    got = multiset.digests(spark.createDataFrame(rows, "doc_id long, text string, bucket string, cell int")).collect()
    assert len(got) == 7 and len({x.fingerprint for x in got if x.n_chars == 4}) == 1
    assert {x.near_next for x in got if x.doc_id is None} == {0.0}


def test_order_insertion_deletion(spark):
    rows = [("ab", "A b. C\nD e"), ("ba", "D e\nA b. C"), ("a", "A b. C"), ("b", "D e"), ("x", "A b. C\n\nD f")]
    got = {x.k: x for x in multiset.states(spark.createDataFrame(rows, "k string, text string"), "text", "k").collect()}
    assert got["ab"].state == got["ba"].state != got["x"].state
    one = spark.createDataFrame([(got["a"].state, got["b"].state, got["ab"].state)], "a array<long>, b array<long>, ab array<long>")
    assert one.select(multiset.added(F.col("a"), F.col("b")) == F.col("ab"), multiset.taken(F.col("ab"), F.col("b")) == F.col("a")).first() == (True, True)


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "x"), (None, None), (4, "same"), (4, "same"), (4, "other"), (9, "")]
    got = multiset.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.n_chars) for x in got if x.doc_id) == [(4, 4), (4, 4), (4, 5), (9, 0)]
    assert len(got) == 6 and len({x.fingerprint for x in got if x.n_chars == 4}) == 1
    assert multiset.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_edited_texts_without_marks_stay_alike(spark):
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    east = lambda n: "".join(chr(rnd.randint(0x4E00, 0x9FFF)) for _ in range(n))
    texts = [" ".join(word(rnd.randint(2, 9)) for _ in range(n)) + end for n, end in ((30, "."), (40, "!"), (400, ""), (3000, ""))] + [word(900), word(4000), east(200), "   "]
    rows = [(i, t) for i, t in enumerate(x for t in texts for x in (t, " ".join(word(6) for _ in range(60))))]
    got = {x.doc_id: x for x in multiset.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, _ in rows[:-2:2]:
        assert got[i].near_edited > 0.35 > got[i].near_next and got[i].near_edited - got[i].near_next > 0.2, i
