import hashlib
import random
import re

from basewright.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ASCII = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(ASCII))


def plain(docs, items):
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, passage in items:
            iw = words(passage)
            n = min(10, len(iw))
            windows = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i : i + n]) in windows and item is not None:
                    hit |= set(range(i, i + n))
                    found.add(item)
        ids = ",".join(sorted(map(str, found)))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_against_plain_version(spark, monkeypatch):
    rnd = random.Random(2)
    word = lambda: rnd.choice(["a", "b", "É", "éa", "w1", "Xy"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([10, 11, 25, 40, 3, 9, 1, 0, 10])]
    items += [(2, items[2][1]), (20, items[2][1].upper()), (21, None), (None, items[3][1])]
    docs = []
    for i in range(80):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 30)))]
        for _ in range(rnd.randint(0, 2)):
            w = (rnd.choice(items)[1] or "").split()
            a, b = sorted((rnd.randint(0, len(w)), rnd.randint(0, len(w))))
            parts.append(", ".join(w if rnd.random() < 0.5 else w[a:b]))
        docs.append((i, "! ".join(parts)))
    docs += [(5, docs[5][1]), (5, "other"), (None, docs[6][1]), (200, None), (201, ""), (202, " -- ")]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = plain(docs, items)
    assert sorted(map(tuple, decontaminate.digests(a, b).collect()), key=str) == want
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(decontaminate, "BROADCAST_TEXTS", -1)
    assert sorted(map(tuple, decontaminate.digests(a, b).collect()), key=str) == want


def test_clean_keeps_columns(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"x {passage} y", "k", 1), (2, "w1 w2 w3", "l", 2), (None, None, "m", 3)], "doc_id long, text string, items string, n_words int")
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(map(tuple, docs.where("doc_id IS NULL OR doc_id = 2").collect()), key=str)
    assert decontaminate.digests(docs.select("doc_id", "text"), items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.digests(docs.limit(0), items).count() == 0


def test_items_without_id_hit(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"x {passage} y"), (2, "clean words"), (3, "a short one here")], "doc_id long, text string")
    items = spark.createDataFrame([(None, passage), (None, "short one")], "item_id long, text string")
    got = {x.doc_id: (x.n_hit, x.n_items, x.items_sha256 == hashlib.sha256(b"").hexdigest(), x.contaminated) for x in decontaminate.digests(docs, items).collect()}
    assert got == {1: (11, 0, True, True), 2: (0, 0, True, False), 3: (2, 0, True, True)}
    assert [x.doc_id for x in decontaminate.clean(docs, items).collect()] == [2]
