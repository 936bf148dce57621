"""Trained operators: held-out accuracy on the test tables, and odd inputs."""

import math
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.llm import langid as I
from clickloom.llm import quality as Q
from clickloom.llm import toxicity as X
from clickloom.llm.common import table

BIG = "/root/testdata/sf0.1"


def held(spark, out, name):
    """Share of held-out rows of each label that are predicted right."""
    labels = table(spark, BIG, "labels").select("doc_id", F.col(name).alias("label"))
    rows = out.filter("held_out").join(labels, "doc_id").groupBy("label").agg(F.avg((F.col("label") == F.col("predicted")).cast("int")))
    return {r[0]: r[1] for r in rows.collect()}


def test_toxicity_held_out(spark):
    out = X.op2_toxicity(spark, BIG)
    got = held(spark, out, "toxic")
    assert got[1] > 0.9 and got[0] > 0.995


def test_quality_held_out(spark):
    got = held(spark, Q.op5_quality_classifier(spark, BIG), "quality")
    assert got[1] > 0.98 and got[0] > 0.95


def test_language_held_out(spark):
    out = I.op3_language_id(spark, "/root/testdata/sf0.01")
    lang = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang")
    right = out.filter("held_out").join(lang, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, i % 2) for i in range(100, 112)] + [(1, 1, None), (2, 0, 0), (6, None, 0), (None, 1, 1), (999, 1, 1), (2, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("operator", [X.toxicity, Q.quality])
def test_classifiers_on_odd_rows(spark, odd, none, labels, scratch, operator):
    got = operator(odd, labels, scratch).collect()
    assert len(got) == odd.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    same = {r["score"] for r in got if r["doc_id"] in (4, 5)}
    assert len(same) == 1
    assert operator(none, labels, scratch).count() == 0
    unlabelled = spark.createDataFrame([], labels.schema)
    assert operator(odd, unlabelled, scratch).select("score").distinct().count() == 1


def test_drop_toxic_keeps_columns(odd, none, labels, scratch):
    out = X.drop_toxic(odd, labels, scratch)
    kept = sorted(r["score"] for r in X.toxicity(odd, labels, scratch).collect() if r["predicted"] == 0)
    assert out.columns == odd.columns and out.count() == len(kept)
    assert X.drop_toxic(none, labels, scratch).count() == 0


@pytest.mark.parametrize("toxic", [[1, 1, 1], [0, 1, 0]])
def test_nothing_is_dropped_where_nothing_is_learned(spark, scratch, toxic):
    docs = spark.createDataFrame([(i, f"clean text {i}") for i in range(3)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    assert X.drop_toxic(docs, labels, scratch).count() == 3
    assert {r["predicted"] for r in X.toxicity(docs, labels, scratch).collect()} == {0}


def test_sample_is_drawn_from_labels_of_the_documents_at_hand(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(3000)], "doc_id long, quality int, toxic int")
    got = [tuple(r) for r in X.sample_of(docs, labels, "toxic", F.lit(True), 20).groupBy("label").count().collect()]
    assert sorted(got) == [(0, 20), (1, 20)]


def test_ngrams_of_a_long_text_do_not_depend_on_blocks(monkeypatch):
    text = "the quick brown fox jumps over the lazy dog " * 200
    whole = X.distinct_hashes(text)
    monkeypatch.setattr(X, "BLOCK", 50)
    assert np.array_equal(whole, X.distinct_hashes(text))
    assert len(X.distinct_hashes(None)) == 0


def test_logistic_reaches_its_optimum():
    rng = np.random.default_rng(1)
    rows, cols = np.repeat(np.arange(60), 4), rng.integers(0, 9, 240)
    values, y = rng.normal(size=240), (rng.random(60) > 0.3).astype(float)
    w, b = X.logistic(rows, cols, values, y, 9, 0.5)
    z = np.bincount(rows, values * w[cols], 60) + b
    weight = np.where(y == 1, 30 / y.sum(), 30 / (60 - y.sum()))
    g = weight * (1 / (1 + np.exp(-z)) - y)
    assert np.abs(np.bincount(cols, values * g[rows], 9) + 0.5 * w).max() < 0.02 and abs(g.sum()) < 0.02


def test_attention_gradients():
    """Analytic gradients against differences."""
    rng = np.random.default_rng(2)
    model = Q.Model(np.zeros(Q.WIDTH), np.ones(Q.WIDTH))
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, doc = rng.normal(size=(7, Q.WIDTH)), np.array([0, 0, 0, 1, 1, 2, 2])
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([0.5, 1.0, 2.0])

    def loss():
        h, _, _, e = model.hidden(x)
        total = 0
        for d in range(3):
            a = np.exp(e[doc == d] - e[doc == d].max())
            s = (a / a.sum()) @ h[doc == d] @ model.p["c"] + model.p["d"][0]
            total += weight[d] * (np.logaddexp(0, s) - y[d] * s)
        return total

    g = model.gradients(x, doc, y, weight)
    for k, v in model.p.items():
        at = tuple(rng.integers(0, n) for n in v.shape)
        v[at] += 1e-5
        up = loss()
        v[at] -= 2e-5
        down = loss()
        v[at] += 1e-5
        assert math.isclose((up - down) / 2e-5, g[k][at], rel_tol=1e-2, abs_tol=1e-4), k


def test_quality_of_a_long_text_does_not_depend_on_blocks(monkeypatch):
    model = Q.Model(np.zeros(Q.WIDTH), np.ones(Q.WIDTH))
    text = "Some words, and more words! " * 500
    whole = model.score(text)
    monkeypatch.setattr(Q, "BLOCK", 3)
    # a bigram over the border of two blocks belongs to neither
    assert math.isclose(whole, model.score(text), abs_tol=2e-2)


def test_forward_sums_all_segmentations():
    vocabulary = I._vocabulary(I.default_vocabulary())
    rng = np.random.default_rng(4)
    p = rng.random((vocabulary.size + 1, 3)) * 1e-2
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=I.default_vocabulary())
    ids = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    words = ["▁then", "▁ünd", "▁a", "▁x日q", "▁" + "the" * 6]
    got = I.word_scores(vocabulary, words, p)
    for w, logs in zip(words, got):
        total = np.zeros(3)
        for cuts in product([0, 1], repeat=len(w) - 1):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(w)]
            parts = [w[a:b] for a, b in zip([0, *ends], ends)]
            at = [ids.get(x, vocabulary.size if len(x) == 1 else None) for x in parts]
            if None not in at and all(len(x) <= I.LONGEST for x in parts):
                total += np.prod(p[at], axis=0)
        assert np.allclose(np.log(total), logs)
    # expected counts of a word's pieces: every character is covered once
    langs, counts = np.array([0, 1, 2, 0, 1]), np.ones(5)
    e = I.expected_counts(vocabulary, words, langs, counts, p)
    sizes = np.ones(vocabulary.size + 1)
    for piece, i in ids.items():
        sizes[i] = len(piece)
    assert math.isclose((e.sum(1) * sizes).sum(), sum(map(len, words)), rel_tol=1e-9)


def test_language_on_odd_rows(odd, none, scratch):
    got = {}
    for r in I.identify(odd, scratch).collect():
        got.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    assert got[1] == got[2] == got[3] == [("und", 0.0)] and got[6] == [("en", 1.0)] and len(got[4]) == 2
    assert sorted(x for x, _ in got[None]) == ["en", "und"]
    assert I.identify(none, scratch).count() == 0
    untaught = I.identify(odd, scratch, F.lit(False)).select("lang_pred").distinct().collect()
    assert [r[0] for r in untaught] == ["und"]
