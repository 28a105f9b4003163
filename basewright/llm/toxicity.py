"""Severity of toxicity by cumulative-link ordinal regression over sparse text features.

Grades are 0 (not toxic) to 3. Labels say only toxic or not; toxic labelled texts are graded 1 to 3 by thirds of
their number of different words that carry a marker (a feature bound to the toxic label). The model has one weight for
each feature and an ordered threshold for each step between grades: P(grade > k) = sigmoid(w x - threshold k).
It is fitted on about SAMPLE labelled documents at most, chosen by 64-bit hashes of doc_id, then of id and text, and
written; everything is scored with it, whole texts. Features are the lower-cased words and their first four to six letters, those whose share differs between
the two labels by LEAST_Z standard errors, FEATURES of them at most.

Defined results. Null, empty and wordless texts have no features and get the model's base rate, which is
held below one half. Labels that repeat a doc_id are averaged; rows that repeat a doc_id are scored each, and fitted
each unless their texts are equal. Null labels and labels without a document don't count. Without labels of both kinds
every score is 0 and nothing is toxic. Equal texts get equal scores. Texts of any length are read whole, one at a
time. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basewright.llm.common import in_share, written

SAMPLE, FEATURES, LEAST_Z, GRADES = 20_000, 4_096, 5.0, 4
PREFIXES = 4, 5, 6
_WORD = re.compile(r"[^\W\d_]+")
_MEMORY = 400_000


def features(word: str) -> tuple[str, ...]:
    return (f"{word} ", *{word[:n] for n in PREFIXES if len(word) >= n})


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    thresholds: np.ndarray = field(default_factory=lambda: np.full(GRADES - 1, np.inf))

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) by row for k from 0."""
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(self.thresholds[None, :] - score[:, None]))


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, width: int, penalty: float = 1e-3, steps: int = 400, balanced: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds for sparse (row, column, value) cells, by Adam on the mean log loss
    (balanced: grade 0 and all above it weigh the same).

    Thresholds are the first one and the logarithms of the gaps, so they stay in order.
    """
    n, k = len(grades), int(grades.max())
    above = np.array([(grades > i).mean() for i in range(k)])
    base = np.log((1 - above + 1e-6) / (above + 1e-6))
    p = np.concatenate([np.zeros(width), base[:1], np.log(np.maximum(np.diff(base), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    balance = np.where(grades > 0, 0.5 / max(1, (grades > 0).sum()), 0.5 / max(1, (grades == 0).sum())) if balanced else np.full(n, 1 / n)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    at = np.arange(n)
    for step in range(1, steps + 1):
        w, gaps = p[:width], np.exp(p[width + 1 :])
        theta = np.concatenate([[p[width]], p[width] + np.cumsum(gaps)])
        score = np.bincount(rows, values * w[columns], n)
        up = sigmoid(score[:, None] - theta[None, :])  # P(grade > k)
        edges = np.concatenate([np.ones((n, 1)), up, np.zeros((n, 1))], axis=1)
        slope = edges * (1 - edges)
        inside = np.maximum(edges[at, grades] - edges[at, grades + 1], 1e-9)
        low, high = slope[at, grades] / inside * balance, slope[at, grades + 1] / inside * balance
        g_score = high - low  # of the loss
        g_theta = np.bincount(grades[grades > 0] - 1, low[grades > 0], k) - np.bincount(grades[grades < k], high[grades < k], k)
        g_gaps = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate([np.bincount(columns, values * g_score[rows], width) + penalty * w, g_gaps[:1], g_gaps[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p[:width], np.concatenate([[p[width]], p[width] + np.cumsum(np.exp(p[width + 1 :]))])


def _labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """toxic and text of a sample of the labelled documents, about `sample` of them; equal rows are one."""
    labels = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    chosen = labels.where(in_share(sample / max(1, labels.count()), 11, "doc_id"))
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # about `sample` rows of two numbers at most
    once = met.groupBy("doc_id", F.xxhash64("text").alias("h"), "toxic").agg(F.any_value("text").alias("text"))
    rows = written(once.select("toxic", "text", "doc_id"), "labelled")
    return rows.where(in_share(sample / max(1, rows.count()), 12, "doc_id", "text")).select("toxic", "text")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    chosen = _labelled(docs, labels, sample)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [sorted({f for w in set(_WORD.findall((t or "").lower())) for f in features(w)}) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.string()))], names=["toxic", "features"])

    sets = chosen.mapInArrow(each, "toxic int, features array<string>")
    totals = dict(chosen.groupBy("toxic").count().collect())
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return Model()
    seen = sets.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("toxic").cast("double").alias("t"), F.count(F.lit(1)).cast("double").alias("n")).where("n >= 5")
    rate = F.col("n") / (bad + good)
    z = (F.col("t") / bad - (F.col("n") - F.col("t")) / good) / F.sqrt(rate * (1 - rate) * (1 / bad + 1 / good) + 1e-12)
    top = seen.select("feature", z.alias("z")).where(F.abs("z") >= LEAST_Z).orderBy(F.abs("z").desc(), "feature").limit(FEATURES).collect()
    number, markers = {x.feature: i for i, x in enumerate(top)}, {x.feature for x in top if x.z > 0}
    if not markers:
        return Model()

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, marked = [], []
            for text in batch.column(1).to_pylist():
                words = set(_WORD.findall((text or "").lower()))
                own = {w: [f for f in features(w) if f in number] for w in words}
                found.append(sorted({number[f] for fs in own.values() for f in fs}))
                marked.append(sum(any(f in markers for f in fs) for fs in own.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32())), pa.array(marked, pa.int32())], names=["toxic", "found", "marked"])

    data = chosen.mapInArrow(cells, "toxic int, found array<int>, marked int").collect()  # at most about `sample` rows
    data.sort(key=lambda x: (x.toxic, x.marked, x.found))
    toxic, marked = np.array([x.toxic for x in data]), np.array([x.marked for x in data])
    cuts = np.quantile(marked[toxic == 1], [(i + 1) / (GRADES - 1) for i in range(GRADES - 2)])
    grades = np.where(toxic == 1, 1 + np.searchsorted(cuts, marked, side="right"), 0).astype(np.int64)
    sizes = np.array([len(x.found) for x in data])
    rows, columns = np.repeat(np.arange(len(data)), sizes), np.array([c for x in data for c in x.found], np.int64)
    weights, thresholds = fit_ordinal(rows, columns, np.ones(len(columns)), grades, len(number))
    thresholds += max(0.0, 1e-3 - thresholds[0])  # a text without features isn't toxic
    thresholds = np.concatenate([thresholds, np.full(GRADES - 1 - len(thresholds), np.inf)])
    return Model({f: float(weights[i]) for f, i in number.items()}, thresholds)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, `p_toxic`, `expected_severity` (0 to 3), `grade` (the most probable) and `toxic` of each document."""
    schema = "doc_id long, p_toxic double, expected_severity double, grade int, toxic boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, tuple[str, ...]] = {}
        weights = model.weights
        for batch in batches:
            sums = []
            for text in batch.column(1).to_pylist():
                found: set[str] = set()
                for word in set(_WORD.findall(text.lower())) if text else ():
                    own = memory.get(word)
                    if own is None:
                        if len(memory) >= _MEMORY:
                            memory.clear()
                        memory[word] = own = tuple(f for f in features(word) if f in weights)
                    if own:
                        found.update(own)
                sums.append(sum(weights[f] for f in sorted(found)))
            above = model.above(np.array(sums, float))
            each = -np.diff(np.concatenate([np.ones((len(sums), 1)), above, np.zeros((len(sums), 1))], axis=1), axis=1)
            columns = batch.column(0), pa.array(above[:, 0]), pa.array(above.sum(axis=1)), pa.array(each.argmax(axis=1), pa.int32()), pa.array(above[:, 0] >= 0.5)
            yield pa.RecordBatch.from_arrays(list(columns), names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def severities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's rows."""
    return score(docs, fit(docs, labels))
