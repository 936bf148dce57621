import random

import pandas as pd
import pytest
from helpers import close, one, rows
from pyspark.sql import functions as F

from clickloom.catalogue import Catalogue
from clickloom.operators import profile as P

CLEAN = [(None,), (-1,), (0,), (3,), (9,)]


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(CLEAN, "v bigint")


def test_missing_rules_differ(small):
    assert rows(P.missing_rate(small, ["v"])) == [("v", 5, 2, 0.4)]
    assert rows(P.null_rate(small, ["v"])) == [("v", 5, 1, 0.2)]
    assert P.missing_rate(small.filter("v > 0"), ["v"]).count() == 0


def test_scalar_stats(small):
    r = one(P.scalar_stats(small, ["v"]))
    assert (r["total"], r["missing_count"], r["valid_count"], r["p50"]) == (5, 2, 3, 3.0)
    assert close(r["mean"], 3.666667) and close(r["std"], 5.033223)


def test_running_stats(small):
    r = one(P.running_stats(small, ["v"]))
    assert (r["valid_count"], r["null_count"], r["mean"], r["p50"]) == (4, 1, 2.75, 1.5)
    assert close(r["std"], 3.897114)


def test_columns_without_values_keep_a_row(spark):
    df = spark.createDataFrame([(None, 0)], "a bigint, b bigint")
    got = {r["column"]: r for r in P.scalar_stats(df, ["a", "b"]).collect()}
    assert got["a"]["valid_count"] == 0 and got["b"]["p50"] is None
    assert {r["column"]: r["valid_count"] for r in P.running_stats(df, ["a", "b"]).collect()} == {"a": 0, "b": 1}


def test_describe_matches_pandas(spark):
    values = [1.0, 2.5, None, 7.0, -3.0, 0.0]
    r = one(P.describe(spark.createDataFrame([(v,) for v in values], "v double"), ["v"]))
    want = pd.Series(values, dtype=float).describe()
    assert all(close(r[a], want[b]) for a, b in [("mean", "mean"), ("std", "std"), ("p25", "25%"), ("p75", "75%")])


def test_column_kinds_and_census(spark):
    df = spark.createDataFrame(
        [(1, 1.5, "a", [1], None), (2, None, None, None, None)], "i int, d double, s string, a array<int>, n string"
    )
    assert P.column_kinds(df) == {"i": "scalar_int", "d": "scalar_float", "s": "string", "a": "array", "n": "string"}
    assert rows(P.column_census(df), "column", "null_count", "all_null") == [
        ("a", 1, False), ("d", 1, False), ("i", 0, False), ("n", 2, True), ("s", 1, False),
    ]


def test_classify(spark):
    cat = Catalogue.from_dict({"seq": {"s": {"prefix": "dom_seq", "ts_fid": None, "features": [[1, 5]]}}})
    df = spark.createDataFrame(
        [(1, [1], 1.0, [2])], "user_int_feats_1 bigint, user_int_feats_2 array<bigint>, user_dense_feats_3 double, dom_seq_1 array<bigint>"
    )
    got = P.classify_columns(df, cat)
    assert got["user_int/scalar"] == ["user_int_feats_1"] and got["user_int/array"] == ["user_int_feats_2"]
    assert got["dense/scalar"] == ["user_dense_feats_3"] and got["seq"] == ["dom_seq_1"]


def test_labels(spark):
    df = spark.createDataFrame([(2,), (1,), (1,), (1,), (None,)], "label_type int")
    r = one(P.label_distribution(df))
    assert (r["positive"], r["negative"], r["total"], r["pos_rate"], r["neg_per_pos"]) == (1, 3, 5, 0.2, 3.0)
    assert rows(P.label_counts(df)) == [(1, 3), (2, 1), (None, 1)]


def test_strings(spark):
    long = "x" * 500
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (long,), (long,), (long + "y",)], "s string")
    r = one(P.string_stats(df, ["s"]))
    assert (r["total"], r["null_count"], r["unique_count"]) == (7, 1, 4)
    top = P.string_top(df.filter(F.length("s") < 9), ["s"], 1)
    assert rows(top, "value", "count") == [("a", 2)]
    assert one(P.string_sketch(df, ["s"]))["approx_unique"] == 4


def test_arrays(spark):
    df = spark.createDataFrame([([5, -1, 0, 7],), ([],), (None,), ([5],)], "a array<bigint>")
    r = one(P.array_stats(df, ["a"]))
    assert (r["max_dim"], r["total_values"], r["valid_count"], r["min"], r["max"]) == (4, 5, 3, 5.0, 7.0)
    assert close(r["missing_rate"], 0.4) and close(r["mean"], 17 / 3)
    assert rows(P.array_top(df, ["a"], 5), "value", "count", "rank") == [(5, 2, 1), (7, 1, 2)]
    n = one(P.array_length_stats(df, ["a"]))
    assert (n["total"], n["null_count"], n["len_min"], n["len_max"], n["len_p50"], n["elements"]) == (4, 1, 0, 4, 1, 5)
    assert close(n["len_mean"], 5 / 3) and close(n["zero_len_rate"], 1 / 3) and close(n["elem_mean"], 3.2)


def test_all_arrays_missing(spark):
    df = spark.createDataFrame([(None,), ([],)], "a array<bigint>")
    r = one(P.array_stats(df, ["a"]))
    assert (r["max_dim"], r["total_values"], r["missing_rate"]) == (0, 0, 0.0)
    assert one(P.array_length_stats(df, ["a"]))["elements"] is None


def test_lengths_coverage_and_cap(spark):
    cat = Catalogue.from_dict(
        {"seq": {"s": {"prefix": "p", "ts_fid": 1, "features": [[1, 0], [2, 9]]}, "t": {"prefix": "q", "ts_fid": 3, "features": [[3, 0]]}}}
    )
    data = [([], [1] * n + [0], [1] * n) for n in range(1, 11)] + [([], None, None)]
    df = spark.createDataFrame(data[:10], "p_1 array<bigint>, p_2 array<bigint>, q_3 array<bigint>")
    freq = P.length_frequencies(P.array_domain_lengths(df, cat))
    got = {r["domain"]: r for r in P.seq_length_stats(freq).collect()}
    assert close(got["s"]["p90"], 9.1) and got["s"]["suggested_cap"] == 9
    assert got["s"]["max_len"] == 10 and got["s"]["max_raw_len"] == 11 and got["t"]["max_raw_len"] == 10
    both = spark.createDataFrame(data, df.schema)
    cover = {r["domain"]: r for r in P.domain_coverage(P.length_frequencies(P.array_domain_lengths(both, cat))).collect()}
    assert (cover["s"]["with_seq"], cover["s"]["without_seq"]) == (10, 1) and close(cover["s"]["coverage"], 10 / 11)


def test_event_lengths_agree_with_arrays(spark):
    events = spark.createDataFrame([(1, "a", 5), (1, "a", 0), (1, "b", 2), (2, "a", 0)], "u int, d string, item int")
    got = rows(P.event_domain_lengths(events, "u", "d", "item", ["a", "b"]))
    assert got == [(1, "a", 1, 2), (1, "b", 1, 1), (2, "a", 0, 1), (2, "b", 0, 0)]


def test_vocabulary_and_timestamps(spark):
    df = spark.createDataFrame([("x", 1), ("x", 1), ("x", 2), ("x", 0), ("t", 1600000000), ("t", 1600000001)], "column string, value bigint")
    counts = P.value_counts(df)
    declared = spark.createDataFrame([("x", 1000, False), ("t", 10, True), ("none", 4, False)], "column string, vocab bigint, is_ts boolean")
    got = {r["column"]: (r["unique_ids"], r["coverage_rate"], r["note"]) for r in P.vocab_coverage(counts, declared).collect()}
    assert got == {"x": (2, 0.002, "shrink"), "t": (2, 0.2, "timestamp"), "none": (0, 0.0, "shrink")}
    stamps = {r["column"]: r["is_timestamp"] for r in P.timestamp_fields(counts).collect()}
    assert stamps == {"x": False, "t": True}


@pytest.mark.parametrize("per_word", [0, 70])
def test_overlap(spark, per_word):
    data = [("A", i) for i in (1, 2, 3, 3)] + [("B", i) for i in (3, 4)] + [("C", 9)] + [("A", 0), ("B", 0)]
    filler = [f"z{i:02d}" for i in range(per_word)]
    ids = spark.createDataFrame(data, "domain string, id bigint")
    # more domains than one word has bits, with B beyond the first word
    out = P.domain_overlap(ids, ["A", *filler, "B", "C"])
    got = {(r["domain_a"], r["domain_b"]): r for r in out.collect()}
    ab = got["A", "B"]
    assert (ab["unique_a"], ab["unique_b"], ab["overlap"], ab["share"]) == (3, 2, 1, True)
    assert close(ab["rate_a"], 1 / 3) and ab["rate_b"] == 0.5
    assert got["A", "C"]["overlap"] == 0 and got["B", "C"]["overlap"] == 0 and not got["A", "C"]["share"]


def test_outliers(spark):
    values = [float(i) for i in range(1, 11)] + [100.0]
    df = spark.createDataFrame([(v, float(i % 3)) for i, v in enumerate(values)], "v double, few double")
    r = one(P.iqr_outliers(df, ["v", "few"]))
    assert (r["column"], r["q1"], r["q3"], r["lower"], r["upper"], r["outlier_count"]) == ("v", 3.5, 8.5, -11.5, 23.5, 1)
    assert close(r["outlier_rate"], 1 / 11) and r["severity"] == "severe"
    assert P.iqr_outliers(df.limit(9), ["v"]).count() == 0


def test_correlations_match_pandas(spark):
    rnd = random.Random(5)
    data = []
    for _ in range(800):
        x = rnd.gauss(1e9, 5.0)
        y = x * 2 + rnd.gauss(0, 1)
        z, rare, const = rnd.random(), (1.0 if rnd.random() < 0.05 else 0.0), 4.0
        data.append(tuple(None if rnd.random() < 0.3 else v for v in (x, y, z, rare, const)))
    names = ["x", "y", "z", "rare", "const"]
    df = spark.createDataFrame(data, ", ".join(f"{n} double" for n in names))
    got = {(r["col_a"], r["col_b"]): r["pearson"] for r in P.correlations(df, names).collect()}
    want = pd.DataFrame(data, columns=names, dtype=float).replace(0, float("nan"))[["x", "y", "z"]].corr()
    assert set(got) == {("x", "y"), ("x", "z"), ("y", "z")}
    assert all(close(v, want.loc[a, b], 1e-7) for (a, b), v in got.items())
    assert rows(P.correlated_pairs(df, names), "col_a", "col_b") == [("x", "y")]


def test_element_top_counts_all_whole_elements(spark):
    df = spark.createDataFrame([([0.0, 0.0, 0.0, -1.0, 5.0], [0.5, 1.0]), (None, [2.0])], "a array<double>, b array<double>")
    got = [(r["column"], r["value"], r["count"]) for r in P.element_top(df, ["a", "b"]).orderBy("rank").collect()]
    assert got == [("a", 0, 3), ("a", -1, 1), ("a", 5, 1)]


def test_coverage_by_first_field(spark):
    cat = Catalogue.from_dict({"user_int": [], "item_int": [], "user_dense": [], "seq": {"d": {"prefix": "d_seq", "ts_fid": 9, "features": [[9, 0], [1, 10]]}}})
    df = spark.createDataFrame([([1], [0]), ([0], [3]), ([5], [])], "d_seq_9 array<bigint>, d_seq_1 array<bigint>")
    held = lambda first: [r["valid_len"] for r in P.array_domain_lengths(df, cat, first).collect()]
    assert held(True) == [1, 0, 1] and held(False) == [0, 1, 0]


def test_string_top_by_digest_equals_counting_values(spark):
    rows = [("x" * 5000 + str(i % 7), "b" if i % 3 else None) for i in range(100)] + [("tie" + str(i), "c") for i in range(30)]
    df = spark.createDataFrame(rows, "t string, u string")
    for k in (1, 3, 8, 40):
        got = sorted(tuple(r) for r in P.string_top(df, ["t", "u"], k).collect())
        want = sorted(tuple(r) for r in P.top_values(P.value_counts(P.string_long(df, ["t", "u"])).filter("value is not null"), k).collect())
        assert got == want
    assert P.string_top(df.filter("false"), ["t"], 5).count() == 0
