import math
import random

import pytest
from helpers import close, one, rows
from pyspark.sql import functions as F

from clickloom.functions import scalars as S
from clickloom.operators import evaluate as E
from clickloom.operators import splits as X
from clickloom.operators import tabular as M
from clickloom.sources import readers, sinks


def sizes(df):
    return {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}


def test_split_sizes():
    assert X.split_sizes(10, 0.1, 0.5) == (4, 1)
    assert X.split_sizes(3, 0.1) == (2, 1)


def test_tail_split_by_order(spark):
    rnd = random.Random(1)
    # a third of all rows share one time
    data = [(i, 50 if rnd.random() < 0.35 else rnd.randint(0, 99)) for i in range(500)]
    df = spark.createDataFrame(data, "id int, ts int").repartition(5)
    for valid, train in [(0.1, 1.0), (0.5, 0.3), (0.55, 1.0)]:
        out = X.tail_split(df, ["ts", "id"], valid, train)
        n_train, n_valid = X.split_sizes(500, valid, train)
        ranked = sorted(data, key=lambda r: (r[1], r[0]))
        want = {r[0]: "train" if i < n_train else "valid" if i >= 500 - n_valid else "dropped" for i, r in enumerate(ranked)}
        assert {r["id"]: r["split"] for r in out.collect()} == want


def test_file_order(spark, tmp_path):
    path = str(tmp_path / "t")
    for part in range(3):
        spark.range(part * 10, part * 10 + 10).coalesce(1).write.mode("append").parquet(f"{path}/part={part}")
    df = readers.read_table(spark, path, file_order=True)
    first = sorted(r["id"] for r in X.first_rows(df, 13).collect())
    assert first == list(range(13))
    assert X.first_rows(df, 99).count() == 30
    split = X.tail_split_files(df, 0.1, 0.5)
    assert sizes(split) == {"train": 13, "dropped": 14, "valid": 3}
    assert sorted(r["id"] for r in split.filter("split = 'valid'").collect()) == [27, 28, 29]
    sinks.export_first_rows(df, 12, f"{path}-out")
    assert sorted(r["id"] for r in spark.read.parquet(f"{path}-out").collect()) == list(range(12))
    with pytest.raises(Exception):
        readers.read_table(spark, str(tmp_path / "nothing"))


def test_stratified(spark):
    df = spark.range(1003).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"))
    out = X.stratified_split(df, "label", ["id"])
    got = {(r["label"], r["split"]): r["count"] for r in out.groupBy("label", "split").count().collect()}
    assert got == {(0, "test"): 181, (0, "train"): 721, (1, "test"): 20, (1, "train"): 81}
    again = X.stratified_split(df.repartition(3), "label", ["id"])
    assert rows(out, "id", "split") == rows(again, "id", "split")
    assert X.allocate({0: 7, 1: 3}, 2) == {0: 1, 1: 1}


def test_sample(spark):
    df = spark.range(5000)
    out = X.exact_sample(df, ["id"], 700)
    ids = [r["id"] for r in out.collect()]
    assert len(ids) == len(set(ids)) == 700 and 1900 < sum(ids) / 700 < 3100
    assert X.exact_sample(df, ["id"], 9999).count() == 5000


def test_shuffle(spark, tmp_path):
    df = spark.range(1000)
    sinks.export_shuffled(df, ["id"], str(tmp_path / "s"), partitions=2)
    back = [r["id"] for r in spark.read.parquet(str(tmp_path / "s")).collect()]
    assert sorted(back) == list(range(1000)) and back != sorted(back)


SCORED = [(0.9, 1), (0.8, 0), (0.8, 1), (0.4, 0), (0.1, 0), (0.1, 1)]


def test_auc(spark):
    df = spark.createDataFrame(SCORED + [(float("nan"), 1)], "s double, y int")
    r = one(E.auc(df, "s", "y"))
    assert (r["n_pos"], r["n_neg"]) == (3, 3) and close(r["auc"], 0.666667)
    assert one(E.auc(df.filter("y = 1"), "s", "y"))["auc"] == 0.0
    assert one(E.auc(df.filter("y = 7"), "s", "y"))["auc"] == 0.0


def test_auc_equals_pair_counting(spark):
    rnd = random.Random(8)
    data = [(rnd.randint(0, 30) / 30, int(rnd.random() < 0.3)) for _ in range(700)]
    pos, neg = [s for s, y in data if y], [s for s, y in data if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert close(one(E.auc(spark.createDataFrame(data, "s double, y int"), "s", "y"))["auc"], want, 1e-9)


def test_losses(spark):
    df = spark.createDataFrame([(0.0, 1), (float("nan"), 0)], "z double, y int")
    assert close(one(E.log_loss(df, "z", "y"))["log_loss"], 0.693147)
    assert math.isinf(one(E.log_loss(df.filter("isnan(z)"), "z", "y"))["log_loss"])
    clean = spark.createDataFrame([(2.0, 1), (-1.0, 0), (0.5, 0)], "z double, y int")

    def focal(z, y, a, g):
        p = 1 / (1 + math.exp(-z))
        pt, at = (p, a) if y else (1 - p, 1 - a)
        return at * (1 - pt) ** g * -math.log(pt)

    want = [focal(z, y, 0.1, 2.0) for z, y in [(2.0, 1), (-1.0, 0), (0.5, 0)]]
    assert close(one(E.focal_loss(clean, "z", "y"))["focal_loss"], sum(want) / 3)
    assert close(one(E.focal_loss(clean, "z", "y", reduction="sum"))["focal_loss"], sum(want))
    per_row = [r["focal_loss"] for r in E.focal_loss(clean, "z", "y", reduction="none").collect()]
    assert all(close(a, b) for a, b in zip(per_row, want))
    # no focus and even weights give half the cross entropy
    even = one(E.focal_loss(clean, "z", "y", 0.5, 0.0))["focal_loss"]
    assert close(2 * even, one(E.log_loss(clean, "z", "y"))["log_loss"])


def test_class_report(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (2, 0)], "y int, p int")
    got = {r["class"]: r for r in E.class_report(df, "y", "p").collect()}
    assert (got[0]["precision"], got[0]["recall"], got[0]["support"]) == (0.5, 1.0, 2)
    assert (got[1]["precision"], got[1]["recall"]) == (1.0, 0.5) and close(got[1]["f1"], 2 / 3)
    assert (got[2]["precision"], got[2]["recall"], got[2]["f1"]) == (0.0, 0.0, 0.0)


def test_last_prediction(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, 0.2), (1, 2, 0.7), (2, 5, 0.1)], "user_id int, ts int, prob double")
    assert rows(E.last_prediction(df, "user_id", ["ts"], "prob")) == [(1, 0.7), (2, 0.1)]
    sinks.write_predictions(df, str(tmp_path / "p"), "user_id", ["ts"])
    assert spark.read.json(str(tmp_path / "p")).count() == 2


def test_preview(spark):
    df = spark.createDataFrame([(i, list(range(i + 7))) for i in range(5)], "id int, a array<int>")
    got = sinks.preview(df, ["id"]).orderBy("row").collect()
    assert [r["id"] for r in got] == [0, 1, 2]
    assert got[0]["a"] == [0, 1, 2, 3, 4] and got[0]["a_len"] == 7 and got[1]["a"] is None


def test_models_learn_and_score(spark):
    rnd = random.Random(4)
    data = []
    for i in range(600):
        a, b = rnd.gauss(0, 1), rnd.gauss(0, 1)
        data.append((i, float(a + 0.3 * rnd.gauss(0, 1) > 0.8), [a * 50 + 10, b, 3.0]))
    df = M.as_vector(spark.createDataFrame(data, "id int, label double, features array<double>"))
    scaler = M.fit_standardizer(df)
    scaled = scaler.transform(df).select(M.vector_to_array("scaled").alias("v")).collect()
    xs = [r["v"][0] for r in scaled]
    assert close(sum(xs) / 600, 0.0, 1e-9) and close(sum(x * x for x in xs) / 600, 1.0, 1e-9)
    weights = M.balanced_weights(df).groupBy("label").agg(F.sum("class_weight").alias("w")).collect()
    assert all(close(r["w"], 300.0) for r in weights)
    model = M.fit_logistic(scaler.transform(df))
    out = M.score(model, scaler.transform(df))
    assert one(E.auc(out, "prob", "label"))["auc"] > 0.95
    r = out.select("prob", S.sigmoid("logit").alias("back")).first()
    assert close(r["prob"], r["back"])
    trees = M.fit_boosted_trees(df, trees=5)
    assert one(E.auc(M.score(trees, df), "prob", "label"))["auc"] > 0.9
    assert M.feature_importance(trees, ["a", "b", "c"], df, 2).first()["feature"] == "a"


def split_counts(df):
    return {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}


@pytest.mark.parametrize(
    "times",
    [
        [None] * 4 + list(range(16)),
        [float("nan")] * 15 + [1.0] * 5,
        [7] * 20,
        [None] * 20,
        [1] * 10 + [2] * 10,
    ],
)
def test_tail_split_on_any_data(spark, times):
    """NULL, NaN and equal keys: the sizes are exact; NULL comes first and NaN last."""
    df = spark.createDataFrame([(None if t is None else float(t),) for t in times], "t double")
    out = X.tail_split(df, ["t"], 0.2)
    assert split_counts(out) == {"train": 16, "valid": 4}
    valid = [r["t"] for r in out.filter("split = 'valid'").collect()]
    want = sorted(times, key=lambda t: (t is not None, t is not None and t != t, t if t is not None and t == t else 0))[-4:]
    assert sorted(map(str, valid)) == sorted(str(None if t is None else float(t)) for t in want)
    assert split_counts(X.tail_split(df, ["t"], 0.2, 0.5)) == {"train": 8, "dropped": 8, "valid": 4}


def test_tail_split_refuses_text(spark):
    with pytest.raises(TypeError):
        X.tail_split(spark.createDataFrame([("a",)], "t string"), ["t"])


@pytest.mark.parametrize("ids", [[1] * 20, ["x"] * 20, list("abcdefghijklmnopqrst"), [None] * 20, [1, 2] * 10])
def test_exact_sample_on_any_ids(spark, ids):
    df = spark.createDataFrame([(None if i is None else str(i),) for i in ids], "id string")
    for n in (0, 5, 20, 30):
        assert X.exact_sample(df, ["id"], n).count() == min(n, 20)


def test_stratified_split_with_repeated_ids_and_null_labels(spark):
    df = spark.createDataFrame([(i % 2, None if i % 5 == 0 else i % 3) for i in range(60)], "id int, y int")
    out = X.stratified_split(df, "y", ["id"], 0.25)
    assert split_counts(out) == {"test": 15, "train": 45}
    by = {(r["y"], r["split"]): r["count"] for r in out.groupBy("y", "split").count().collect()}
    sizes = {r["y"]: r["count"] for r in df.groupBy("y").count().collect()}
    assert all(abs(by.get((y, "test"), 0) - n / 4) < 1 for y, n in sizes.items())


@pytest.mark.parametrize("kind", ["map", "nested", "variant"])
def test_splits_keep_every_row_once_where_only_maps_differ(spark, kind):
    base = spark.range(10).select(F.lit(1).alias("k"), F.col("id").alias("i"))
    value = {
        "map": F.create_map(F.lit("a"), F.col("i")),
        "nested": F.array(F.create_map(F.lit("a"), F.create_map(F.lit("b"), F.col("i")))),
        "variant": F.parse_json(F.concat(F.lit('{"a": '), F.col("i").cast("string"), F.lit("}"))),
    }[kind]
    df = base.select("k", value.alias("m"), "i").drop("i").repartition(3)
    got = X.tail_split(df, ["k"], 0.4).select(F.to_json(F.struct("m")).alias("m"), "split").collect()
    assert len(got) == 10 and len({r.m for r in got}) == 10
    assert sorted(r.split for r in got).count("valid") == 4
    sample = X.exact_sample(df, ["k"], 6).select(F.to_json(F.struct("m")).alias("m")).collect()
    assert len(sample) == 6 and len({r.m for r in sample}) == 6


def test_file_counts_read_no_data_column(spark):
    df = X.with_file_order(spark.read.parquet("/root/testdata/sf0.01/orders.parquet"))
    plan = df.groupBy(X.FILE).count()._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan
