import random

import numpy as np
import pytest
from helpers import close, rows
from pyspark.sql import functions as F

from clickloom.operators import order_stats as O

PROBS = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]


def groups(seed=3):
    rnd = random.Random(seed)
    return {
        "tail": [rnd.paretovariate(0.3) * rnd.choice([-1, 1]) for _ in range(3000)],
        "offset": [1.7e9 + rnd.random() * 50 for _ in range(3000)],
        "hot": [5.0] * 2000 + [rnd.random() for _ in range(500)],
        "zero": [0.0, -0.0, 0.0, -1.0, 1.0],
        "one": [7.0],
        "wide": [float("inf"), float("-inf"), 1e300, -1e300, 0.0],
    }


@pytest.mark.parametrize("direct", [0, 5_000_000])
def test_quantiles_match_numpy(spark, monkeypatch, direct):
    monkeypatch.setattr(O, "DIRECT_ROWS", direct)
    data = groups()
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v double")
    df = df.unionByName(spark.createDataFrame([("tail", None), ("tail", float("nan")), ("none", None)], df.schema))
    got = {r["k"]: r for r in O.quantiles(df, ["k"], "v", PROBS).collect()}
    assert set(got) == set(data)
    for k, values in data.items():
        for p in PROBS:
            if k == "wide" and p not in (0.0, 1.0):
                continue
            assert close(got[k][O.probe_name(p)], float(np.percentile(values, p * 100)), 1e-12) or k == "wide"


def test_big_integers_stay_exact(spark):
    base = 2**60
    df = spark.createDataFrame([(base + i,) for i in range(101)], "v bigint")
    assert O.order_statistics(df, [], "v", {"mid": F.lit(50)}).first()["value"] == base + 50


def test_weights_and_ranks_outside(spark):
    df = spark.createDataFrame([(1, 3), (2, 1), (9, 6)], "v bigint, c bigint")
    found = O.order_statistics(df, [], "v", {"a": F.lit(2), "b": F.lit(3), "c": F.lit(4), "d": F.lit(10)}, "c")
    assert rows(found, "probe", "value", "n") == [("a", 1, 10), ("b", 2, 10), ("c", 9, 10)]


def test_nothing_to_rank(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert O.order_statistics(df, [], "v", {"a": F.lit(0)}).count() == 0


def test_frequency_quantiles(spark):
    values = [1, 1, 2, 5, 5, 5, 9]
    df = spark.createDataFrame([("a", v) for v in values], "k string, v bigint").groupBy("k", "v").count()
    got = O.frequency_quantiles(df, ["k"], "v", "count", PROBS).first()
    for p in PROBS:
        assert close(got[O.probe_name(p)], float(np.percentile(values, p * 100)))


def test_sketch_is_near(spark):
    df = spark.range(20000).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("v"))
    got = O.sketch_quantiles(df, ["k"], "v", [0.5, 0.9]).first()
    assert abs(got["p50"] - 10000) < 400 and abs(got["p90"] - 18000) < 400
