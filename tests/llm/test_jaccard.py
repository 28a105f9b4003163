import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from basewright.llm import common, components, jaccard


def plain(rows):
    sets = []
    for _, text in rows:
        w = re.findall(r"\w+", (text or "").lower())
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else {text or ""})
    n = len(rows)
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b) - 1e-9
    links = [[j for j in range(n) if j != i and near(sets[i], sets[j])] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        label = [min([label[i], *(label[j] for j in links[i])]) for i in range(n)]
    classes = {c: min(rows[i][0] for i in range(n) if label[i] == c) for c in set(label)}
    return sorted((rows[i][0], classes[label[i]], len(links[i])) for i in range(n))


def corpus(seed, n=120):
    rnd = random.Random(seed)
    rows, base = [], []
    for i in range(n):
        if i % 4 == 0 or not base:
            words = [f"w{rnd.randint(0, 900)}" for _ in range(rnd.randint(1, 150))]
            base.append(words)
        else:
            words = list(rnd.choice(base[-6:]))
            for _ in range(rnd.choice([0, 0, 1, 2, 3])):
                words[rnd.randrange(len(words))] = f"x{rnd.random()}"
        rows.append((1000 - i, " ".join(words).title() if i % 5 == 0 else " ".join(words)))
    return rows + [(2001, ""), (2002, None), (2003, "..."), (2004, "..."), (2005, "one"), (2006, "One!")]


@pytest.mark.parametrize("tile", [512, 3])
def test_against_all_pairs(spark, tile):
    rows = corpus(7)
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), tile=tile)
    assert sorted((x.doc_id, x.class_id, x.n_links) for x in got.collect()) == plain(rows)


def test_many_pairs_are_counted_alike():
    rnd = np.random.default_rng(1)
    sets = [np.unique(rnd.integers(0, 90, 60).astype(np.uint64)) for _ in range(40)]
    i, j = np.triu_indices(40, 1)
    assert jaccard.intersections(sets, i, j).tolist() == [len(set(sets[a].tolist()) & set(sets[b].tolist())) for a, b in zip(i, j, strict=True)]


def test_representatives_nulls_repeats_and_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text, "a"), (3, text + " end", "b"), (3, text + " end", "b"), (None, text, "c"), (9, "other words here", None), (None, "no id has this", "x"), (None, "no id has this", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    kept = sorted(map(tuple, jaccard.representatives(df).collect()), key=str)
    assert len(kept) == 3 and {rows[1], rows[4]} < set(kept) and kept[2] in rows[5:]
    got = sorted(((x.doc_id, x.class_id, x.rep_id, x.n_links) for x in jaccard.links(df).collect()), key=str)
    assert got == sorted([(5, 3, 5, 3), (3, 3, 3, 3), (3, 3, 3, 3), (None, 3, 5, 3), (9, 9, 9, 0), (None, None, None, 1), (None, None, None, 1)], key=str)
    none = jaccard.representatives(df.limit(0))
    assert none.columns == df.columns and none.count() == 0


def chain(n, words=60, step=6):
    """Texts of which each shares most words with the next: one long component of small buckets."""
    return [(i, " ".join(f"c{k}" for k in range(i * step, i * step + words))) for i in range(n)]


def test_chains_are_compared_by_buckets(spark, monkeypatch):
    rows, units, found = chain(90) + corpus(3, 12), jaccard.units, []

    def watched(*args):
        found.append(units(*args))
        return found[-1]

    monkeypatch.setattr(jaccard, "units", watched)
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), tile=8)
    assert sorted((x.doc_id, x.class_id, x.n_links) for x in got.collect()) == plain(rows)
    assert found[0].where("band >= 0").count() > 0


def test_without_broadcast_and_in_small_tiles(spark, monkeypatch):
    rows = corpus(9, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for module, name in ((jaccard, "BROADCAST_ROWS"), (common, "BROADCAST_ROWS"), (components, "BROADCAST_ROWS")):
        monkeypatch.setattr(module, name, -1)
    monkeypatch.setattr(jaccard, "TILE_BYTES", 1500)
    assert sorted((x.doc_id, x.class_id, x.n_links) for x in jaccard.join(df).collect()) == plain(rows)


def test_a_very_long_text(spark):
    long = " ".join(f"w{i % 7000}x{i}" for i in range(200_000))
    rows = [(1, long), (2, long + " tail"), (3, long[: len(long) // 2])]
    got = {x.doc_id: (x.class_id, x.rep_id, x.n_links) for x in jaccard.links(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1, 1), 2: (1, 2, 1), 3: (3, 3, 0)}


def test_no_aggregate_under_a_join_of_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    big, small = (spark.range(100).selectExpr("id % 5 AS k", f"id AS {c}") for c in "ab")
    plan = common.spread_join(big, small.groupBy("k").agg(F.min("b").alias("b")), "k")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Aggregate" not in plan and plan.count("Exchange hashpartitioning") == 2
