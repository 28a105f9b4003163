import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from basewright.llm import cotraining, toxicity
from basewright.llm.common import in_share

DATA = "/root/testdata/sf0.01"


def halves(spark, column):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    return docs, labels.where(~held), {x.doc_id: x[column] for x in labels.where(held).collect()}


def test_toxicity_on_held_out_labels(spark):
    docs, labels, held = halves(spark, "toxic")
    got = {x.doc_id: x for x in toxicity.severities(docs, labels).collect()}
    assert len(got) == docs.count()
    bad = [got[d].toxic for d, t in held.items() if t]
    clean = [got[d].toxic for d, t in held.items() if not t]
    assert sum(bad) / len(bad) >= 0.6 and sum(clean) / len(clean) <= 0.02
    assert all(0 <= x.expected_severity <= 3 and x.toxic == (x.p_toxic >= 0.5) for x in got.values())


def test_ordinal_regression_finds_the_steps():
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=3000)
    grades = np.searchsorted([-1.0, 0.5, 1.5], x + rnd.logistic(size=3000) * 0.2)
    w, thresholds = toxicity.fit_ordinal(np.arange(3000), np.zeros(3000, np.int64), x, grades, 1, penalty=0.0, steps=1500, balanced=False)
    assert np.all(np.diff(thresholds) > 0) and np.allclose(thresholds / w[0], [-1.0, 0.5, 1.5], atol=0.15)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "fine words")], "doc_id long, text string")
    labels = spark.createDataFrame([(2, 0), (7, 1), (None, 1)], "doc_id long, toxic int")
    got = toxicity.severities(docs, labels).collect()
    assert len(got) == 4 and not any(x.toxic or x.expected_severity for x in got)
    assert toxicity.severities(docs.limit(0), labels).count() == 0


def test_quality_on_held_out_labels(spark):
    docs, labels, held = halves(spark, "quality")
    got = {x.doc_id: x for x in cotraining.qualities(docs, labels).collect()}
    right = [got[d].accepted == bool(q) for d, q in held.items()]
    good = [got[d].accepted for d, q in held.items() if q]
    assert sum(right) / len(right) >= 0.95 and sum(good) / len(good) >= 0.98
    kept = cotraining.accepted(docs, labels)
    assert kept.schema == docs.schema and kept.count() == sum(x.accepted for x in got.values())


def test_views_teach_each_other():
    rnd = np.random.default_rng(4)
    y = rnd.integers(0, 2, 2040)
    one, two = ((y[:, None] * 3 - 1.5) + rnd.normal(size=(2040, 2)) for _ in range(2))
    model = cotraining.cotrain([one[:40], two[:40]], y[:40], [one[40:1040], two[40:1040]])
    assert ((model.probability(one[1040:], two[1040:]) >= 0.5) == y[1040:]).mean() > 0.97


def test_quality_edges(spark):
    docs = spark.createDataFrame([(None, None, None, None, 1), (1, "", "en", "s", 2)], "doc_id long, text string, lang string, source string, p_quality int")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert sorted(map(tuple, cotraining.accepted(docs, labels).collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
    assert cotraining.accepted(docs.limit(0), labels).count() == 0
    rnd = random.Random(1)
    text = " ".join(rnd.choice("ab cd ef".split()) for _ in range(9))
    assert cotraining.text_view(text).shape == (cotraining.TEXT_WIDTH,) and cotraining.text_view(None).shape == (cotraining.TEXT_WIDTH,)


def test_quality_scores_are_the_models(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = cotraining.fit(docs, labels)
    rows = {x.doc_id: x for x in docs.collect()}
    logit = lambda view, x: view.slope * (sum((a - m) / s * w for a, m, s, w in zip(x, view.mean, view.scale, view.weights, strict=False)) + view.weights[-1]) + view.offset
    for got in cotraining.scored(docs, model).collect():
        x = rows[got.doc_id]
        parts = logit(model.views[0], cotraining.text_view(x.text)), logit(model.views[1], cotraining.meta_view(x.lang, x.source, x.n_chars))
        total = sum(max(-20, min(20, p)) for p in parts) - model.base
        assert abs(got.p_quality - 1 / (1 + math.exp(-max(-30, min(30, total))))) < 1e-6


def test_sums_over_many_tasks_are_those_of_one(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300)
    rows = cotraining._views(docs.select("doc_id", *cotraining._COLUMNS))
    one, two = cotraining._unpacked([bytes(x.views) for x in rows.collect()])
    rnd = np.random.default_rng(5)
    views = tuple(cotraining.Linear(x.mean(axis=0), x.std(axis=0) + 0.1, rnd.normal(size=x.shape[1] + 1) * 2) for x in (one, two))
    weights = [v.weights / 2 for v in views]
    want = cotraining.handed((one, two), views, weights, 0.3)
    monkeypatch.setattr(cotraining, "FAN", 3)
    got = cotraining.summed(rows.repartition(23))(views, weights, 0.3)
    assert want[0][0] > 0 and all(np.allclose(a, b) for a, b in zip(got, want, strict=True))


def test_labelled_rows_stay_bounded(spark):
    docs = spark.range(3000).selectExpr("id % 10 AS doc_id", "concat('words of text ', id % 700) AS text", "'en' AS lang", "'s' AS source", "id AS n_chars")
    labels = spark.range(10).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality", "cast(id % 2 AS int) AS toxic")
    assert toxicity._labelled(docs, labels, 100).count() <= 200
    assert cotraining.fit(docs, labels, 100).views is not None
    for share in (0.0, 1e-7, 0.25, 1.0):
        n = spark.range(1_000_000).where(in_share(share, 3, "id")).count()
        assert abs(n - share * 1e6) <= 4 * math.sqrt(share * 1e6) + 4 * (0 < share < 1)


def test_toxicity_scores_are_the_models(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    assert np.all(np.diff(model.thresholds) >= 0)
    texts = {x.doc_id: x.text for x in docs.limit(200).collect()}
    for got in toxicity.score(docs.limit(200), model).collect():
        words = {w for w in re.findall(r"[^\W\d_]+", texts[got.doc_id].lower())}
        found = {f for w in words for f in [w + " ", *(w[:n] for n in (4, 5, 6) if len(w) >= n)]}
        score = sum(model.weights.get(f, 0.0) for f in found)
        above = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        assert abs(got.p_toxic - above[0]) < 1e-9 and abs(got.expected_severity - sum(above)) < 1e-9
        each = [a - b for a, b in zip([1.0, *above], [*above, 0.0], strict=True)]
        assert each[got.grade] >= max(each) - 1e-9 and got.toxic == (got.p_toxic >= 0.5)
