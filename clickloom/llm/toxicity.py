"""Toxicity: linear classifier over character n-grams scaled by naive Bayes log-count ratios.

1. A sample of labelled documents, at most ``PER_CLASS`` of each class taken in hash order of the id, is the training set.
2. Document counts of all its n-grams by class are summed in Spark; the ``FEATURES`` with the largest standardised
   difference become features, each with its log-count ratio r.
3. A document is the set of features present in its whole text, each worth r, scaled to length 1. A logistic model on these vectors is
   fitted on the driver (sample and features are bounded by the parameters).
4. Every document is scored in one pass over its whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import Scratch, first_by_hash, fold, labels_of, table

ORDERS = (3, 4, 5, 6)
PER_CLASS = 4000
FEATURES = 20_000
MIN_DOCS = 5
#: Added to a document's squared length before it is scaled to length 1.
NORM_FLOOR = 1e-6
PENALTY = 0.1
#: Bias of a model that has learned nothing.
UNLEARNED = -10.0
FOLDS, HELD_OUT = 5, 0
#: Code points hashed at once; a longer text is taken block by block, overlapping by one n-gram.
BLOCK = 1 << 18
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def ngram_hashes(text: str | None, orders: tuple[int, ...] = ORDERS) -> Iterator[np.ndarray]:
    """Hashes of the n-grams of the lower-cased text, white space as single spaces, block by block."""
    points = np.frombuffer(f" {' '.join((text or '').lower().split())} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    for at in range(0, max(1, len(points) - orders[0] + 1), BLOCK):
        part = points[at : at + BLOCK + orders[-1] - 1]
        rolling, out = part.copy(), []
        for n in range(2, orders[-1] + 1):
            if len(part) < n:
                break
            rolling = rolling[:-1] * _MULTIPLIER + part[n - 1 :]
            if n in orders:
                h = rolling[:BLOCK] * _MIX
                out.append(h ^ (h >> np.uint64(29)))
        if out:
            yield np.concatenate(out)


def distinct_hashes(text: str | None, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    found = [np.unique(h) for h in ngram_hashes(text, orders)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


@dataclass
class Model:
    hashes: np.ndarray  # sorted uint64
    ratios: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.hashes >> np.uint64(44)] = True

    def features(self, text: str | None) -> np.ndarray:
        """Positions of the features that the text has."""
        found = []
        for h in ngram_hashes(text):
            h = h[self.seen[h >> np.uint64(44)]]
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            found.append(np.unique(at[self.hashes[at] == h]))
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def score(self, text: str | None) -> float:
        z, at = self.bias, self.features(text) if len(self.hashes) else []
        if len(at):
            z += float(self.weights[at].sum() / np.sqrt((self.ratios[at] ** 2).sum() + NORM_FLOOR))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def logistic(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, width: int, penalty: float) -> tuple[np.ndarray, float]:
    """Class-balanced L2 logistic regression on sparse rows, by limited-memory BFGS."""
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)

    parts = [slice(at, at + 1_000_000) for at in range(0, len(rows), 1_000_000)]  # what is computed on the way stays small

    def loss(theta: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.full(len(y), theta[-1])
        for s in parts:
            z += np.bincount(rows[s], values[s] * theta[cols[s]], len(y))
        m = np.where(y == 1, z, -z)
        g = weight * (1 / (1 + np.exp(-z)) - y)
        grad = np.append(np.zeros(width), g.sum())
        for s in parts:
            grad[:-1] += np.bincount(cols[s], values[s] * g[rows[s]], width)
        grad[:-1] += penalty * theta[:-1]
        return float((weight * np.logaddexp(0, -m)).sum() + penalty / 2 * (theta[:-1] ** 2).sum()), grad

    theta, history = np.zeros(width + 1), []
    f, g = loss(theta)
    for _ in range(100):
        q, alphas = g.copy(), []
        for s, d in reversed(history):
            alphas.append((s @ q) / (s @ d))
            q -= alphas[-1] * d
        if history:
            s, d = history[-1]
            q *= (s @ d) / (d @ d)
        else:
            q /= max(1.0, np.abs(g).max())
        for (s, d), a in zip(history, reversed(alphas), strict=True):
            q += (a - (d @ q) / (s @ d)) * s
        step = 1.0
        while True:
            new = theta - step * q
            f2, g2 = loss(new)
            if f2 <= f - 1e-4 * step * (g @ q) or step < 1e-8:
                break
            step /= 2
        s, d = new - theta, g2 - g
        done = f - f2 < 1e-7 * max(1.0, abs(f))
        theta, f, g = new, f2, g2
        if done:
            break
        if s @ d > 1e-12:
            history = [*history[-9:], (s, d)]
    return theta[:-1], float(theta[-1])


def sample_of(docs: DataFrame, labels: DataFrame, name: str, learn_from: Column, per_class: int) -> DataFrame:
    """``doc_id, text, label``: at most ``per_class`` labelled documents of each class, in hash order of their ids."""
    known = labels_of(labels, name).filter(learn_from).join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = first_by_hash(known, "label", "doc_id", per_class)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, learn_from: Column | None = None, per_class: int = PER_CLASS) -> Model:
    """Learn from the labelled rows of ``docs`` that satisfy ``learn_from``.

    Where nothing could be learned, without both classes or without any feature, no text counts as toxic.
    """
    learn_from = F.lit(True) if learn_from is None else learn_from
    sample = scratch.save(sample_of(docs, labels, "toxic", learn_from, per_class), "sample")
    n = {int(k): c for k, c in sample.groupBy("label").count().collect()}
    if len(n) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), UNLEARNED)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(parts: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            h, at = np.unique(np.concatenate([x for _, x in parts]), return_inverse=True)
            toxic = np.repeat([y for y, _ in parts], [len(x) for _, x in parts])
            pos = np.bincount(at, toxic, len(h)).astype(np.int64)
            neg = np.bincount(at, 1 - toxic, len(h)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(pos), pa.array(neg)], names=["h", "pos", "neg"])

        parts, size = [], 0
        for b in batches:
            for text, label in zip(b.column(0), b.column(1), strict=True):
                parts.append((label.as_py(), distinct_hashes(text.as_py())))
                size += len(parts[-1][1])
                if size > 2_000_000:
                    yield summed(parts)
                    parts, size = [], 0
        if parts:
            yield summed(parts)

    p, q = n[1], n[0]
    counts = (
        sample.select("text", "label")
        .mapInArrow(count, "h long, pos long, neg long")
        .groupBy("h")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .filter(F.col("pos") + F.col("neg") >= MIN_DOCS)
    )
    weight = F.abs(F.col("pos") / p - F.col("neg") / q) / F.sqrt(F.col("pos") / p + F.col("neg") / q)
    chosen = counts.orderBy(weight.desc(), "h").limit(FEATURES).toPandas()
    hashes = chosen["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    pos, neg = chosen["pos"].to_numpy(float)[order], chosen["neg"].to_numpy(float)[order]
    ratios = np.log((pos + 1) / (p + 2)) - np.log((neg + 1) / (q + 2))
    model = Model(hashes[order], ratios, ratios * 0, UNLEARNED)
    if not len(ratios):
        return model

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.features(t.as_py()).astype(np.int32) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(found, pa.list_(pa.int32()))], names=["label", "at"])

    data = sample.select("text", "label").mapInArrow(vectors, "label int, at array<int>").toArrow()
    at = data.column("at").combine_chunks()
    lengths = np.diff(at.offsets.to_numpy())
    cols, rows = at.values.to_numpy(), np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    y = data.column("label").to_numpy().astype(float)
    values = ratios.astype(np.float32)[cols]
    norm = np.sqrt(np.bincount(rows, values * values, len(y)) + NORM_FLOOR).astype(np.float32)
    values /= norm[rows]
    w, bias = logistic(rows, cols, values, y, len(ratios), PENALTY)
    return Model(model.hashes, ratios, w * ratios, bias)


def scored(docs: DataFrame, score: Callable[[str | None], float]) -> DataFrame:
    """``doc_id, score`` of every row, from its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([score(t.as_py()) for t in b.column(1)], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, scratch: Scratch, learn_from: Column | None = None) -> DataFrame:
    """``doc_id, score, predicted`` of every row of ``docs``.

    NULL and empty texts have no features and get the bias. Equal texts get equal scores; NULL ids are kept. Labels that are
    NULL or of unknown documents teach nothing; empty tables give an empty result.
    """
    model = fit(docs, labels, scratch, learn_from)
    return scored(docs, model.score).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def drop_toxic(docs: DataFrame, labels: DataFrame, scratch: Scratch, learn_from: Column | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not predicted toxic."""
    model = fit(docs, labels, scratch, learn_from)

    @F.pandas_udf("double")
    def score(texts):
        return texts.map(model.score, na_action=None).astype(float)

    return docs.filter(score(docs["text"]) < 0.5)


def learning_rows(doc_id: str = "doc_id") -> Column:
    return fold(F.col(doc_id), FOLDS) != HELD_OUT


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = toxicity(docs, labels, Scratch(spark, "op2"), learning_rows())
    return out.select("doc_id", (~learning_rows()).alias("held_out"), "score", "predicted")
