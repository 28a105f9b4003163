"""Quality classifier by co-training on two views of a document.

The text view sees what the text is made of (kinds of characters, word lengths, repeats). The metadata view sees
language, source and the given size of the page (column `n_chars`), never the text. Both start from the labelled
documents. Then each round the models of the round before label, for the other view, every document without a
label that they are sure of (SURE, by their evidence beyond the base rate); both views are fitted anew on labels and pseudo-labels, by
STEPS Newton steps that go on from the last weights, and calibrated on labelled documents kept apart. A view takes its
new weights if they do better there; rounds end when neither does. Last, the calibrated views are combined as independent
evidence over the base rate.

All documents without a label take part, in every round: their views are written once, as a table of a few hundred
bytes a row, and a Newton step is one pass that adds up gradients and curvatures, first in the task, then in a tree of
FAN rows at a time, so that the driver gets FAN sums of two small matrices. The pseudo-labels of a view weigh as much
as its labels together, at most one label each, so the input's size doesn't change their part in the fit. Labels are
a bounded sample: at most SAMPLE labelled rows, chosen by a 64-bit hash of doc_id, then the first by a hash of id and text;
labelled documents outside of it count as without a label. Every document is scored, by its whole text.

Defined results. Null text counts as empty, null metadata as a value of its own, as does a missing `n_chars`. Labels that
repeat a doc_id are averaged; null labels and labels without a document don't count. Without labels of both kinds
every document is accepted with score 1. Rows that repeat a doc_id are scored each, equal rows alike. Texts of any
length are read whole. An empty table gives no rows. Extra columns are carried through by `accepted`, whatever their
names, and not read by `qualities`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basewright.llm.common import discard, in_share, written

SAMPLE, ROUNDS, STEPS = 20_000, 5, 3
#: A view hands on documents that it would hold to be one kind with this probability if both kinds were as common:
#: its evidence beyond the base rate counts, else a weak view would hand on most documents as the commoner kind.
SURE = 0.95
ACCEPT = 0.5
#: Rows of sums that one task adds up, and that the driver gets at most.
FAN = 64
LANGS, SOURCES = 16, 64
_CLASSES = np.zeros(256, np.int64)
for _n, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\r\n", b".", b",;:", b"!?", b"#$%&*@^~", b"|<>{}[]\\", b"'\"()-/_+="), 1):
    _CLASSES[list(_chars)] = _n
_CLASSES[128:] = 12
TEXT_WIDTH, META_WIDTH = 36, LANGS + SOURCES + 4


def text_view(text: str | None) -> np.ndarray:
    """Shares of kinds of bytes and of words, each also as its square root."""
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(_CLASSES[np.arange(256)], np.bincount(data, minlength=256), 13)
    words = text.split()
    n, size = max(1, len(words)), max(1, len(data))
    shares = [*(kinds / size), kinds[1] / max(1, kinds[1] + kinds[2]), len(set(words)) / n, sum(map(eq, words, words[1:])) / n, min(1.0, len(text) / n / 40), min(1.0, np.log1p(len(words)) / 12)]
    shares = np.array(shares)
    return np.concatenate([shares, np.sqrt(shares)])


def meta_view(lang: str | None, source: str | None, chars: object) -> np.ndarray:
    """Language and source by hash, and the given number of characters."""
    import xxhash

    out = np.zeros(META_WIDTH)
    out[xxhash.xxh32_intdigest(f"{lang}".encode("utf-8", "surrogatepass")) % LANGS] = 1
    out[LANGS + xxhash.xxh32_intdigest(f"{source}".encode("utf-8", "surrogatepass")) % SOURCES] = 1
    known = isinstance(chars, (int, float)) and chars >= 0
    size = np.log1p(chars) / 10 if known else 0.0
    out[-4:] = size, size * size, known and chars < 200, not known
    return out


@dataclass
class Linear:
    """Logistic regression on standardised columns, then a slope and an offset that calibrate it."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * ((x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1]) + self.offset, -20, 20)


def _ridge(width: int, penalty: float) -> np.ndarray:
    ridge = penalty * np.eye(width)
    ridge[-1, -1] = 1e-6  # the constant
    return ridge


def _sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the log likelihood at w."""
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return x.T @ (y - p), x.T @ (x * (p * (1 - p))[:, None])


def _moved(w: np.ndarray, gradient: np.ndarray, curvature: np.ndarray, ridge: np.ndarray) -> tuple[np.ndarray, float]:
    """w after one Newton step of bounded length, and how far it went."""
    move = np.linalg.solve(curvature + ridge + 1e-9 * np.eye(len(w)), gradient - ridge @ w)
    far = np.abs(move).max()
    return w + move * min(1.0, 5 / max(1e-9, far)), float(far)


def _ones(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def _newton(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 25) -> np.ndarray:
    """Weights, the last for the constant, of a logistic regression with a quadratic penalty."""
    x = _ones(x)
    w, ridge = np.zeros(x.shape[1]), _ridge(x.shape[1], penalty)
    for _ in range(steps):
        w, far = _moved(w, *_sums(x, y, w), ridge)
        if far < 1e-6:
            break
    return w


def fit_view(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> Linear:
    scale = np.maximum(x.std(axis=0), 1e-3)
    return Linear(x.mean(axis=0), scale, _newton((x - x.mean(axis=0)) / scale, y, penalty))


def calibrate(view: Linear, x: np.ndarray, y: np.ndarray) -> Linear:
    """Platt scaling; targets are drawn in a little, so that a perfect split stays finite."""
    good, bad = y.sum(), len(y) - y.sum()
    slope, offset = _newton(view.logit(x)[:, None], np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2)), 1e-3)
    return Linear(view.mean, view.scale, view.weights, float(max(slope, 0.0)), float(offset))


def _loss(view: Linear, x: np.ndarray, y: np.ndarray) -> float:
    """Mean log loss."""
    logit = view.logit(x)
    return float(np.mean(np.logaddexp(0, np.where(y == 1, -logit, logit))))


@dataclass
class Model:
    views: tuple[Linear, Linear] | None = None
    base: float = 0.0

    def probability(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        if self.views is None:
            return np.ones(len(text))
        total = self.views[0].logit(text) + self.views[1].logit(meta) - self.base
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def handed(pool: tuple[np.ndarray, np.ndarray], frozen: tuple[Linear, Linear], weights: list[np.ndarray], base: float) -> list[np.ndarray]:
    """For each view, over the rows that the other's frozen model is sure of: their number, gradient and curvature at weights."""
    out = []
    for i in (0, 1):
        evidence = frozen[1 - i].logit(pool[1 - i]) - base
        sure = np.abs(evidence) >= np.log(SURE / (1 - SURE))
        x = _ones((pool[i][sure] - frozen[i].mean) / frozen[i].scale)
        gradient, curvature = _sums(x, (evidence[sure] > 0).astype(float), weights[i])
        out += [np.array([sure.sum()], float), gradient, curvature.ravel()]
    return out


#: The sums of `handed` over all documents without a label.
Pool = Callable[[tuple[Linear, Linear], list[np.ndarray], float], list[np.ndarray]]


def cotrain(views: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray] | Pool, rounds: int = ROUNDS) -> Model:
    """y by label, of rows in the same order in both views; every fifth labelled row is kept for calibration."""
    add: Pool = pool if callable(pool) else lambda frozen, weights, base: handed((pool[0], pool[1]), frozen, weights, base)
    kept = np.arange(len(y)) % 5 == 4
    if len(set(y[~kept])) < 2 or len(set(y[kept])) < 2:
        kept = np.zeros(len(y), bool)
    if len(set(y)) < 2:
        return Model()
    held = kept if kept.any() else ~kept
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    raw = [fit_view(v[~kept], y[~kept]) for v in views]
    x = [_ones((v[~kept] - r.mean) / r.scale) for v, r in zip(views, raw, strict=True)]
    target = y[~kept].astype(float)
    best = [calibrate(r, v[held], y[held]) for r, v in zip(raw, views, strict=True)]
    loss = [_loss(b, v[held], y[held]) for b, v in zip(best, views, strict=True)]
    for _ in range(rounds):
        weights = [r.weights for r in raw]
        for _ in range(STEPS):
            sums = add((best[0], best[1]), weights, base)
            if not sums[0][0] and not sums[3][0]:  # neither view is sure of any document
                return Model((best[0], best[1]), base)
            for i in (0, 1):
                number, gradient, curvature = sums[3 * i : 3 * i + 3]
                share, width = min(1.0, len(target) / max(1.0, number[0])), len(gradient)
                own = _sums(x[i], target, weights[i])
                weights[i], _ = _moved(weights[i], own[0] + share * gradient, own[1] + share * curvature.reshape(width, width), _ridge(width, 1.0))
        better = False
        for i in (0, 1):
            new = Linear(raw[i].mean, raw[i].scale, weights[i])
            taught = calibrate(new, views[i][held], y[held])
            if (now := _loss(taught, views[i][held], y[held])) < loss[i] - 1e-6:
                raw[i], best[i], loss[i], better = new, taught, now, True
        if not better:
            break
    return Model((best[0], best[1]), base)


_COLUMNS = ("text", "lang", "source", "n_chars")
_WIDTHS = (TEXT_WIDTH, META_WIDTH)


def _measured(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = lambda c: batch.column(k).to_pylist() if (k := batch.schema.get_field_index(c)) >= 0 else [None] * batch.num_rows
    text, lang, source, chars = map(column, _COLUMNS)
    one = np.array([text_view(t) for t in text]).reshape(len(text), TEXT_WIDTH)
    two = np.array([meta_view(*x) for x in zip(lang, source, chars, strict=True)]).reshape(len(text), META_WIDTH)
    return one, two


def _packed(one: np.ndarray, two: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in np.hstack([one, two]).astype("<f4")], pa.binary())


def _unpacked(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(rows), "<f4").reshape(len(rows), sum(_WIDTHS)).astype(float)
    return both[:, :TEXT_WIDTH], both[:, TEXT_WIDTH:]


def _views(rows: DataFrame, *kept: str) -> DataFrame:
    """`kept` and the two views of each row as `views` binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), _packed(*_measured(part))], names=[*kept, "views"])

    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in kept), T.StructField("views", T.BinaryType())]))


def _added(rows: list[bytes]) -> bytes:
    return np.sum([np.frombuffer(x) for x in rows], axis=0).tobytes()


def _add_group(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda x: x["part"])
    return pa.table({"part": pa.array([rows[0]["part"] // FAN], pa.int64()), "sums": pa.array([_added([x["sums"] for x in rows])], pa.binary())})


def summed(pool: DataFrame) -> Pool:
    """The sums of `handed` over the rows of a table of views, one job each time."""
    width = [w + 1 for w in _WIDTHS]
    cuts = np.cumsum([n for w in width for n in (1, w, w * w)])[:-1]
    tasks = pool.rdd.getNumPartitions()

    def add(frozen: tuple[Linear, Linear], weights: list[np.ndarray], base: float) -> list[np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(int(cuts[-1]) + width[1] ** 2)
            for batch in batches:
                for start in range(0, batch.num_rows, 4096):
                    total += np.concatenate(handed(_unpacked(batch.column(0).slice(start, 4096).to_pylist()), frozen, weights, base))
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])

        rows, left = pool.mapInArrow(run, "part long, sums binary"), tasks
        while left > FAN:
            rows, left = rows.groupBy(F.expr(f"part div {FAN}")).applyInArrow(_add_group, "part long, sums binary"), -(-left // FAN)
        got = sorted(rows.collect(), key=lambda x: x.part)
        return np.split(np.frombuffer(_added([x.sums for x in got])) if got else np.zeros(int(cuts[-1]) + width[1] ** 2), cuts)

    return add


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    labels = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    chosen = labels.where(in_share(sample / max(1, labels.count()), 21, "doc_id"))
    chosen = F.broadcast(chosen)  # about `sample` rows of two numbers at most
    rows = docs.select("doc_id", *(c for c in _COLUMNS if c in docs.columns))
    known = rows.join(chosen, "doc_id").withColumn("at", F.xxhash64(F.lit(22), "doc_id", "text"))
    got = _views(known, "at", "label").orderBy("at", "label", "views").limit(sample).collect()
    y, views = np.array([x.label for x in got], np.int64), _unpacked([bytes(x.views) for x in got])
    if len(set(y.tolist())) < 2:
        return Model()
    pool = written(_views(rows.join(chosen.select("doc_id"), "doc_id", "left_anti").select(rows.columns)), "views")
    model = cotrain(list(views), y, summed(pool))
    discard(pool)
    return model


def scored(docs: DataFrame, model: Model, name: str = "p_quality") -> DataFrame:
    """docs with the probability of good quality under `name`."""
    kept = docs.select(*[c for c in docs.columns if c != name])
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.probability(*_measured(part)))], names=[*part.schema.names, name])

    return kept.mapInArrow(run, schema)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs' columns, documents of good quality only."""
    return scored(docs, fit(docs, labels), "_bw_quality").where(F.col("_bw_quality") >= ACCEPT).select(*docs.columns)


def qualities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's rows: doc_id, p_quality, accepted."""
    rows = docs.select("doc_id", *(c for c in _COLUMNS if c in docs.columns))
    return scored(rows, fit(docs, labels)).select("doc_id", "p_quality", (F.col("p_quality") >= ACCEPT).alias("accepted"))
