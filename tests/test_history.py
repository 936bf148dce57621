import math
import random

import pytest
from helpers import close, rows
from pyspark.sql import functions as F

from clickloom.catalogue import Catalogue
from clickloom.operators import history as H
from clickloom.operators import prepare as R
from clickloom.sources import readers, sinks


@pytest.fixture(scope="module")
def log(spark):
    """One user holds most events; items are small ids with padding among them."""
    rnd = random.Random(11)
    data = []
    for e in range(1500):
        user = 1 if rnd.random() < 0.6 else rnd.randint(2, 9)
        data.append((e, user, rnd.choice("ab"), rnd.randint(0, 12), rnd.randint(0, 400)))
    return data, spark.createDataFrame(data, "event_id int, user int, domain string, item bigint, ts int")


@pytest.fixture(scope="module")
def vectors(spark):
    rnd = random.Random(2)
    data = {i: [float(rnd.randint(-3, 3)) for _ in range(4)] for i in range(10)}
    return data, spark.createDataFrame(list(data.items()), "vec_id bigint, embedding array<double>")


def latest(data, key, k):
    groups = {}
    for r in data:
        groups.setdefault(key(r), []).append(r)
    return {g: sorted(rs, key=lambda r: (-r[4], -r[0]))[:k] for g, rs in groups.items()}


@pytest.mark.parametrize("k", [7, 200])
def test_latest_per_group(log, monkeypatch, k):
    monkeypatch.setattr(H, "GROUP_LIMIT", 100)  # 200 takes the salted way
    data, df = log
    got = rows(H.latest_per_group(df, ["user", "domain"], ["ts", "event_id"], k), "event_id", "recency")
    want = [(r[0], i + 1) for rs in latest(data, lambda r: (r[1], r[2]), k).values() for i, r in enumerate(rs)]
    assert got == sorted(want, key=lambda t: tuple((x is None, str(x)) for x in t))


def test_history_arrays(log):
    data, df = log
    out = H.history_arrays(df, "user", "domain", ["a", "b", "none"], ["ts", "event_id"], ["item", "ts"], 5)
    want = latest(data, lambda r: (r[1], r[2]), 5)
    for r in out.collect():
        for d in "ab":
            events = want.get((r["user"], d), [])[::-1]
            assert r[f"{d}_item"] == [e[3] for e in events] and r[f"{d}_ts"] == [e[4] for e in events]
        assert r["none_item"] == []


def test_lookup(log, vectors):
    data, df = log
    table, vec = vectors
    got = H.lookup_vectors(df, vec, "item", 4).collect()
    assert len(got) == len(data)
    assert all(r["vector"] == (table.get(r["item"], [0.0] * 4) if r["item"] > 0 else [0.0] * 4) for r in got)


def test_mean_pool(spark, log, vectors):
    data, df = log
    table, vec = vectors
    only_padding = spark.createDataFrame([(-1, 77, "a", 0, 5), (-2, 77, "a", -3, 5)], df.schema)
    got = {r["user"]: r for r in H.mean_pool(df.unionByName(only_padding), ["user"], vec, "item", 4).collect()}
    assert got[77]["n_valid"] == 0 and got[77]["vector"] == [0.0] * 4
    for u in {r[1] for r in data}:
        items = [r[3] for r in data if r[1] == u and r[3] > 0]
        want = [sum(table.get(i, [0.0] * 4)[d] for i in items) / len(items) for d in range(4)]
        assert got[u]["n_valid"] == len(items) and all(close(a, b, 1e-9) for a, b in zip(got[u]["vector"], want))


def test_target_top_k(spark, log, vectors):
    data, df = log
    table, vec = vectors
    target = {u: [1.0, -2.0, 0.5, 3.0] for u in range(1, 9)}  # user 9 has none
    targets = spark.createDataFrame(list(target.items()), "user int, vector array<double>")
    out = H.target_top_k(df, targets, vec, "user", ["ts", "event_id"], "item", 4, pre_k=40, k=10).collect()
    by_user = {}
    for r in out:
        by_user.setdefault(r["user"], []).append(r)
    cand = latest([r for r in data if r[3] > 0], lambda r: r[1], 40)
    assert set(by_user) == set(cand)
    for u, rs in by_user.items():
        t = target.get(u, [0.0] * 4)
        scored = [(sum(a * b for a, b in zip(table.get(r[3], [0.0] * 4), t)), i + 1, r[0]) for i, r in enumerate(cand[u])]
        want = sorted(scored, key=lambda s: (-s[0], s[1]))[:10]
        rs.sort(key=lambda r: r["rank"])
        assert [(r["recency"], r["event_id"]) for r in rs] == [(w[1], w[2]) for w in want]
        total = sum(math.exp(w[0]) for w in want)
        assert close(sum(r["weight"] for r in rs), 1.0) and all(close(r["weight"], math.exp(w[0]) / total) for r, w in zip(rs, want))


def test_softmax(spark):
    df = spark.createDataFrame([("u", 2.0), ("u", 1.0), ("v", 9000.0)], "k string, score double")
    got = [round(r["weight"], 6) for r in H.softmax_weights(df, ["k"], "score").orderBy("k", F.desc("score")).collect()]
    assert got == [0.731059, 0.268941, 1.0]


def test_timeline(spark):
    f = spark.createDataFrame([(1, 0, 7), (1, 1, 8)], "user int, pos int, token bigint")
    e = spark.createDataFrame([(1, "b", 0, 3, 2), (1, "a", 0, 4, 1), (1, "zz", 0, 1, 1)], "user int, domain string, pos int, token bigint, bucket int")
    got = H.unified_timeline(f, e, "user", ["a", "b"]).orderBy("segment", "pos").collect()
    assert [(r["segment"], r["token"], r["bucket"]) for r in got] == [(0, 7, 0), (0, 8, 0), (1, 4, 1), (2, 3, 2)]


# ---- preparation --------------------------------------------------------------------------------

CAT = Catalogue.from_dict(
    {
        "user_int": [[1, 5, 1], [2, 10, 3], [3, 0, 1]],
        "item_int": [[4, 8, 1]],
        "user_dense": [[5, 2], [6, 1]],
        "seq": {
            "s": {"prefix": "s", "ts_fid": 9, "features": [[7, 6], [9, 0], [8, 0]]},
            "t": {"prefix": "t", "ts_fid": None, "features": [[7, 3]]},
        },
    },
    {"s": 3, "t": 2},
)


@pytest.fixture(scope="module")
def impressions(spark):
    schema = """user_id bigint, timestamp bigint, label_type int, user_int_feats_1 bigint, user_int_feats_2 array<bigint>,
        user_int_feats_3 bigint, item_int_feats_4 bigint, user_dense_feats_5 array<float>, user_dense_feats_6 array<float>,
        s_7 array<bigint>, s_8 array<bigint>, s_9 array<bigint>, t_7 array<bigint>"""
    data = [
        (1, 1000, 2, 9, [4, -1, 12, 3], 5, 7, [1.5, -2.0, 3.0], None, [1, 0, 7, 2], [1, 2], [1000, 970, 0, 5], None),
        (2, 1000, None, None, None, None, -1, [], [4.0], None, [1, 1, 1, 1], [2000], [2, 3, 1]),
    ]
    return spark.createDataFrame(data, schema)


def test_prepare_rows(impressions):
    a, b = R.prepare_rows(impressions, CAT).orderBy("user_id").collect()
    assert (a["label"], b["label"]) == (1, 0)
    assert a["user_int"] == [0, 4, 0, 0, 0] and b["user_int"] == [0, 0, 0, 0, 0]
    assert (a["item_int"], b["item_int"]) == ([7], [0])
    assert (a["user_dense"], b["user_dense"]) == ([1.5, -2.0, 0.0], [0.0, 0.0, 4.0])
    assert a["s"] == [[1, 0, 0], [0, 0, 0]] and a["s_len"] == 3
    assert a["s_time_bucket"] == [1, 1, 0] and a["t_time_bucket"] == [0, 0]
    assert b["s"] == [[0, 0, 0], [0, 0, 0]] and b["s_len"] == 3 and b["s_time_bucket"] == [1, 0, 0]
    assert (a["t"], a["t_len"]) == ([[0, 0]], 0) and (b["t"], b["t_len"]) == ([[2, 0]], 2)
    assert all(len(r["user_int"]) == CAT.width("user_int") for r in (a, b))


def test_scoring_mode_and_strict(impressions):
    assert [r["label"] for r in R.prepare_rows(impressions, CAT, is_training=False).collect()] == [0, 0]
    with pytest.raises(Exception, match="outside"):
        R.prepare_rows(impressions, CAT, clip_vocab=False).collect()


def test_prepare_is_one_projection(impressions):
    plan = R.prepare_rows(impressions, CAT)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_out_of_vocabulary(impressions):
    got = rows(R.out_of_vocabulary(impressions, CAT))
    assert got == [("s_7", 6, 1, 7, 7), ("t_7", 3, 1, 3, 3), ("user_int_feats_1", 5, 1, 9, 9), ("user_int_feats_2", 10, 1, 12, 12)]


def test_groups(impressions):
    cols = R.assemble_groups(CAT, "user_int", {"U1": [2, 1], "U2": [3]})
    assert [tuple(r) for r in impressions.orderBy("user_id").select(*cols).collect()] == [([4, 0, 0, 0], [0]), ([0, 0, 0, 0], [0])]
    with pytest.raises(KeyError):
        R.assemble_groups(CAT, "user_int", {"U1": [44]})


def test_tabular(impressions):
    out = R.tabular_features(impressions, ["user_int_feats_1"], {"user_dense_feats_5": 2}, ["s_7"], ["user_id"])
    assert rows(out) == [(1, [9.0, 1.5, -2.0, 3.0]), (2, [-1.0, 0.0, 0.0, 0.0])]


def test_report_sink_and_label_filter(spark, impressions, tmp_path):
    sinks.write_oov_report(impressions, CAT, str(tmp_path / "oov"))
    back = spark.read.json(str(tmp_path / "oov"))
    assert rows(back, "column", "oov_count") == [("s_7", 1), ("t_7", 1), ("user_int_feats_1", 1), ("user_int_feats_2", 1)]
    assert [r["user_id"] for r in readers.by_label(impressions, 2).collect()] == [1]
    assert readers.row_cap(impressions, 1).count() == 1


@pytest.mark.parametrize("dim", [64, 320])
def test_mean_pool_same_at_every_width(spark, dim):
    """NULL elements and missing positions count as 0, whatever the width; a repeated id counts once."""
    rows = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 0)], "user int, item bigint")
    whole, gap = [2.0] * dim, [4.0] * dim
    gap[1] = None
    vectors = spark.createDataFrame(
        [(10, whole), (11, gap), (12, [6.0]), (12, [6.0])], "vec_id bigint, embedding array<double>"
    )
    out = {r["user"]: r for r in H.mean_pool(rows, ["user"], vectors, "item", dim).collect()}
    assert out[1]["n_valid"] == 3 and out[2]["n_valid"] == 0
    assert [round(x, 9) for x in out[1]["vector"][:3]] == [4.0, round(2 / 3, 9), 2.0]
    assert len(out[1]["vector"]) == dim and out[2]["vector"] == [0.0] * dim
    assert H.lookup_vectors(rows, vectors, "item", dim).count() == 4


def test_history_arrays_without_a_limit(spark):
    """One very long history keeps all its events."""
    df = spark.range(3000).selectExpr("1 as user", "'a' as domain", "id as ts", "id as item")
    out = H.history_arrays(df, "user", "domain", ["a"], ["ts"], ["item"]).first()
    assert out["a_item"] == list(range(3000))
