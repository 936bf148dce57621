"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages. Each passage is encoded by its character shapes (bigrams of character classes), hashed
character trigrams and how evenly they are spread; a small network turns the encoding into a vector h and a gated attention
logit ``w . (tanh(V h) * sigmoid(U h))``. The softmax over a document's passages weights their vectors, and the weighted
representation is scored. Encoder, attention and score are learned together from document labels, by Adam on a
sample bounded by ``PER_CLASS`` documents a class of at most ``LEARN_CHARS`` characters. All documents are scored in one pass
over their whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import Scratch, fold, table
from clickloom.llm.toxicity import sample_of

PASSAGE = 400
PER_CLASS = 2000
LEARN_CHARS = 50_000
HIDDEN, GATE = 32, 16
EPOCHS, BATCH, RATE, DECAY = 25, 64, 3e-3, 1e-4
FOLDS, HELD_OUT = 3, 1
#: Passages encoded at once.
BLOCK = 512
TRIGRAMS = 256
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _classes() -> tuple[np.ndarray, np.ndarray, int]:
    """Class and lower-case form of each code point below 0x250."""
    kinds, lower = np.zeros(0x250, np.int64), np.arange(0x250, dtype=np.uint64)
    marks = {c: 6 + i for i, c in enumerate(".,!?;:'\"|-")}
    for i in range(0x250):
        c = chr(i)
        if c == "\n":
            kinds[i] = 1
        elif c.isspace() or not c.isprintable():
            kinds[i] = 2
        elif c.isdigit():
            kinds[i] = 3
        elif c.isupper():
            kinds[i] = 4
        elif c.isalpha():
            kinds[i] = 5
        else:
            kinds[i] = marks.get(c, 16)
        low = c.lower()
        if len(low) == 1 and ord(low) < 0x250:
            lower[i] = ord(low)
    return kinds, lower, 18


_KIND, _LOWER, KINDS = _classes()
WIDTH = KINDS * KINDS + TRIGRAMS + 4


def encode(text: str | None) -> Iterator[np.ndarray]:
    """Encodings of the passages of the text, at most ``BLOCK`` rows at a time; an empty text is one empty passage."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    for at in range(0, max(1, len(points)), PASSAGE * BLOCK):
        part = points[at : at + PASSAGE * BLOCK]
        n = max(1, -(-len(part) // PASSAGE))
        known = np.minimum(part, 0x24F).astype(np.int64)
        kind = np.where(part < 0x250, _KIND[known], KINDS - 1)
        low = np.where(part < 0x250, _LOWER[known], part)
        passage = np.arange(len(part)) // PASSAGE
        size = np.maximum(1, np.bincount(passage, minlength=n))[:, None]
        pairs = np.bincount(passage[1:] * KINDS * KINDS + kind[:-1] * KINDS + kind[1:], minlength=n * KINDS * KINDS)
        h = (low[:-2] * _MULTIPLIER + low[1:-1]) * _MULTIPLIER + low[2:]
        h = ((h * _MULTIPLIER) >> np.uint64(56)).astype(np.int64)
        grams = np.bincount(passage[2:] * TRIGRAMS + h, minlength=n * TRIGRAMS)
        pairs, grams = pairs.reshape(n, -1) / size, grams.reshape(n, -1) / size
        spread = [(grams**2).sum(1), grams.max(1), (grams > 0).mean(1), np.log1p(size[:, 0]) / 6]
        yield np.concatenate([np.sqrt(pairs), np.sqrt(grams), np.stack(spread, 1)], axis=1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Model:
    """The network; ``mean`` and ``scale`` standardise encodings."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, bias: float = 0.0):
        rng = np.random.default_rng(7)
        self.mean, self.scale = mean.astype(np.float32), scale.astype(np.float32)
        shapes = {"W": (WIDTH, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "d": (1,)}
        self.p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32) if k not in "bd" else np.zeros(s, np.float32) for k, s in shapes.items()}
        self.p["d"][:] = bias

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        h = np.tanh(((x - self.mean) / self.scale).clip(-8, 8) @ self.p["W"] + self.p["b"])
        t, s = np.tanh(h @ self.p["V"]), _sigmoid(h @ self.p["U"])
        return h, t, s, (t * s) @ self.p["w"]

    def score(self, text: str | None) -> float:
        """Attention is summed block by block with a running maximum, so a very long text needs no more memory."""
        top, weight, total = -np.inf, 0.0, np.zeros(HIDDEN)
        for x in encode(text):
            h, _, _, e = self.hidden(x)
            new = max(top, float(e.max()))
            a = np.exp(e - new)
            keep = np.exp(top - new)
            weight, total, top = weight * keep + a.sum(), total * keep + a @ h, new
        return float(_sigmoid(total / weight @ self.p["c"] + self.p["d"][0]))

    def gradients(self, x: np.ndarray, doc: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """``doc``: sorted document number of each passage; ``y`` and ``weight`` by document."""
        p, n = self.p, len(y)
        h, t, s, e = self.hidden(x)
        first = np.searchsorted(doc, np.arange(n))
        a = np.exp(e - np.maximum.reduceat(e, first)[doc])
        a /= np.add.reduceat(a, first)[doc]
        z = np.add.reduceat(a[:, None] * h, first)
        dl = weight * (_sigmoid(z @ p["c"] + p["d"][0]) - y)
        dz = dl[:, None] * p["c"]
        dh = a[:, None] * dz[doc]
        da = (h * dz[doc]).sum(1)
        de = a * (da - np.add.reduceat(a * da, first)[doc])
        dg = de[:, None] * p["w"]
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        dh += dt @ p["V"].T + ds @ p["U"].T
        pre = dh * (1 - h * h)
        scaled = ((x - self.mean) / self.scale).clip(-8, 8)
        return {"W": scaled.T @ pre, "b": pre.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ dl, "d": dl.sum(keepdims=True)}

    def train(self, x: np.ndarray, doc: np.ndarray, y: np.ndarray) -> None:
        rng, n = np.random.default_rng(11), len(y)
        start = np.searchsorted(doc, np.arange(n + 1))
        weight = np.where(y == 1, 0.5 * n / y.sum(), 0.5 * n / (n - y.sum()))
        m, v, step = {k: 0 * a for k, a in self.p.items()}, {k: 0 * a for k, a in self.p.items()}, 0
        for epoch in range(EPOCHS):
            order = rng.permutation(n)
            rate = RATE * (1 - epoch / EPOCHS)
            for at in range(0, n, BATCH):
                docs = order[at : at + BATCH]
                rows = np.concatenate([np.arange(start[i], start[i + 1]) for i in docs])
                number = np.repeat(np.arange(len(docs)), start[docs + 1] - start[docs])
                g, step = self.gradients(x[rows], number, y[docs], weight[docs] / len(docs)), step + 1
                for k in self.p:
                    g[k] = g[k] + DECAY * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, learn_from: Column | None = None, per_class: int = PER_CLASS) -> Model:
    """Learn from the labelled rows of ``docs`` that satisfy ``learn_from``; with one class only the score is constant."""
    learn_from = F.lit(True) if learn_from is None else learn_from
    sample = sample_of(docs, labels, "quality", learn_from, per_class).filter(F.char_length(F.coalesce("text", F.lit(""))) <= LEARN_CHARS)
    sample = scratch.save(sample, "sample")

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                found = [np.concatenate(list(encode(t.as_py()))) for t in part.column(2)]
                sizes = [len(x) for x in found]
                values = pa.array(np.concatenate(found).ravel())
                offsets = np.arange(0, sum(sizes) * WIDTH + 1, WIDTH, dtype=np.int32)
                columns = [np.repeat(part.column(i).to_numpy(), sizes) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.ListArray.from_arrays(offsets, values)], names=["doc_id", "label", "x"])

    got = sample.select("doc_id", "label", "text").mapInArrow(passages, "doc_id long, label int, x array<float>").toArrow().combine_chunks()
    ids, label = got.column("doc_id").to_numpy(), got.column("label").to_numpy().astype(np.float32)
    if not len(ids) or label.min() == label.max():
        share = float(label[0]) if len(ids) else 1.0
        model = Model(np.zeros(WIDTH), np.ones(WIDTH), 20 * share - 10)
        model.p["c"] *= 0
        return model
    x = got.column("x").combine_chunks().values.to_numpy().reshape(-1, WIDTH)
    order = np.argsort(ids, kind="stable")
    x, label = x[order], label[order]
    _, first, doc = np.unique(ids[order], return_index=True, return_inverse=True)
    model = Model(x.mean(0), x.std(0) + 1e-2)
    model.train(x, doc, label[first])
    return model


def quality(docs: DataFrame, labels: DataFrame, scratch: Scratch, learn_from: Column | None = None) -> DataFrame:
    """``doc_id, score, predicted`` of every row of ``docs``.

    NULL and empty texts are one empty passage. Equal texts get equal scores; rows with a NULL id are scored. Without labels
    every score is that of label 1; empty tables give an empty result.
    """
    model = fit(docs, labels, scratch, learn_from)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = pa.array([model.score(t.as_py()) for t in b.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), scores], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def learning_rows() -> Column:
    return fold(F.col("doc_id"), FOLDS) != HELD_OUT


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = quality(docs, labels, Scratch(spark, "op5"), learning_rows())
    return out.select("doc_id", (~learning_rows()).alias("held_out"), "score", "predicted")
