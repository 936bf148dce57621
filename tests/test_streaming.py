import pytest
from helpers import close, one
from pyspark.sql import functions as F

from clickloom.operators import profile as P
from clickloom.streaming import incremental as T

SCHEMA = "x double, a array<bigint>, s string"


@pytest.fixture()
def files(spark, tmp_path):
    path = str(tmp_path / "in")

    def add(lo, hi):
        spark.range(lo, hi).select(
            F.when(F.col("id") % 7 != 0, F.col("id") * 0.5).alias("x"),
            F.when(F.col("id") % 5 != 0, F.sequence(F.lit(1).cast("bigint"), F.col("id") % 4 + 1)).alias("a"),
            F.when(F.col("id") % 10 != 9, F.concat(F.lit("s"), (F.col("id") % 3).cast("string"))).alias("s"),
        ).coalesce(1).write.mode("append").parquet(path)

    return path, add


def state(spark, path, where):
    schema = spark.createDataFrame([], SCHEMA).schema
    stream = T.stream_files(spark, path, schema)
    return T.finish(T.run_profile(stream, where, measured))


def measured(rows):
    return T.profile_state(T.measures(rows, ["x", "a"]))


def test_stream_equals_batch_and_restarts(spark, tmp_path, files):
    path, add = files
    where = str(tmp_path / "profile")
    add(0, 300)
    add(300, 500)
    exact = ["total", "null_count", "valid_count", "min", "max", "mean", "std"]

    def check():
        got = {r["column"]: r for r in state(spark, path, where).collect()}
        df = spark.read.parquet(path)
        want = one(P.running_stats(df, ["x"]))
        assert all(close(got["x"][c], want[c]) for c in exact)
        lengths = one(P.array_length_stats(df, ["a"]))
        assert got["a#len"]["valid_count"] == lengths["total"] - lengths["null_count"]
        assert close(got["a#len"]["mean"], lengths["len_mean"]) and close(got["a#elem"]["mean"], lengths["elem_mean"])
        assert got["a#elem"]["total"] == lengths["elements"]
        assert abs(got["x"]["approx_p50"] - want["p50"]) < 0.03 * want["max"]
        return got["x"]

    first = check()
    # nothing new: the same files are not counted twice
    assert check() == first
    add(500, 650)
    assert check()["total"] == 650


def test_states_merge(spark, files):
    path, add = files
    add(0, 400)
    df = spark.read.parquet(path)
    whole = one(T.finish(T.profile_state(T.measures(df, ["x"]))))
    parts = [T.profile_state(T.measures(df.filter(c), ["x"])) for c in ("x < 50", "x >= 50 or x is null")]
    merged = one(T.finish(T.merge_states(*parts)))
    assert all(close(merged[c], whole[c]) for c in ("total", "valid_count", "mean", "std", "min", "max"))
    assert abs(merged["approx_p50"] - whole["approx_p50"]) < 5


def test_strings(spark, tmp_path, files):
    path, add = files
    add(0, 90)
    schema = spark.createDataFrame([], SCHEMA).schema
    add(90, 100)
    stream = T.stream_files(spark, path, schema)
    st = T.run_profile(stream, str(tmp_path / "strings"), lambda rows: T.string_state(rows, ["s"]), T.merge_string_states)
    r = one(T.finish_strings(st))
    assert (r["total"], r["null_count"], r["approx_unique"]) == (100, 10, 3)
    assert {x["item"]: x["count"] for x in r["approx_top"]} == {"s0": 30, "s1": 30, "s2": 30}


def test_empty_columns(spark):
    df = spark.createDataFrame([(None,)], "x double")
    r = one(T.finish(T.profile_state(T.measures(df, ["x"]))))
    assert (r["total"], r["valid_count"], r["mean"], r["approx_p50"], r["approx_distinct"]) == (1, 0, None, None, 0)


def test_stop_between_state_and_commit(spark, tmp_path, files):
    """A driver that stops after the state is written and before the batch is committed loses and doubles nothing."""
    path, add = files
    where = str(tmp_path / "profile")
    add(0, 100)
    assert state(spark, path, where).filter("column = 'x'").first()["total"] == 100
    add(100, 150)
    schema = spark.createDataFrame([], SCHEMA).schema

    def stopping(rows):
        out = measured(rows)
        raise RuntimeError("stopped")  # before the state of the batch is written
        return out

    with pytest.raises(Exception, match="stopped"):
        T.run_profile(T.stream_files(spark, path, schema), where, stopping)
    assert state(spark, path, where).filter("column = 'x'").first()["total"] == 150
    # the commit of the last batch is lost: its state is there, and the batch runs again
    commits = sorted((tmp_path / "profile" / "checkpoint" / "commits").glob("[0-9]*"))
    for f in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        f.unlink(missing_ok=True)
    assert state(spark, path, where).filter("column = 'x'").first()["total"] == 150
    add(150, 160)
    assert state(spark, path, where).filter("column = 'x'").first()["total"] == 160


def test_large_values_keep_their_spread(spark):
    df = spark.range(1000).select((F.lit(1.7e9) + F.col("id") % 2 * 0.1).alias("x"))
    batch = one(P.running_stats(df, ["x"]))
    parts = [T.profile_state(T.measures(df.limit(300), ["x"])), T.profile_state(T.measures(df.offset(300), ["x"]))]
    merged = one(T.finish(T.merge_states(*parts)))
    assert abs(batch["std"] - 0.05) < 1e-6 and abs(merged["std"] - 0.05) < 1e-6


def test_merge_with_an_empty_part(spark):
    some, none = (spark.createDataFrame([(x,) for x in v], "x double") for v in ([1.0, 3.0], [None]))
    r = one(T.finish(T.merge_states(*[T.profile_state(T.measures(d, ["x"])) for d in (some, none)])))
    assert (r["total"], r["valid_count"], r["mean"], r["std"]) == (3, 2, 2.0, 1.0)


@pytest.mark.parametrize("parts", [1, 3, 20])
def test_exact_mean_of_any_split_equals_duckdb(spark, parts):
    import duckdb
    from decimal import Decimal

    path = "/root/testdata/sf0.01/lineitem.parquet"
    df = spark.read.parquet(path).select("l_orderkey", "l_discount", "l_extendedprice")
    pieces = [df.filter(F.pmod(F.xxhash64("l_orderkey"), F.lit(parts)) == i) for i in range(parts)]
    states = [T.profile_state(T.measures(p, ["l_discount", "l_extendedprice"])) for p in pieces]
    got = {r["column"]: r for r in T.finish(T.merge_states(*states)).collect()}
    values = [v for (v,) in duckdb.sql(f"SELECT l_discount FROM '{path}' WHERE l_discount IS NOT NULL").fetchall()]
    (rounded,) = duckdb.sql(f"SELECT round(avg(l_discount), 6) FROM '{path}'").fetchall()[0]
    # each double counts as its shortest decimal form
    assert got["l_discount"]["mean_exact"] == (sum(Decimal(repr(v)) for v in values) / len(values)).quantize(Decimal(10) ** -18)
    half_up = got["l_discount"]["mean_exact"].quantize(Decimal("0.000001"), rounding="ROUND_HALF_UP")
    assert float(half_up) == rounded == 0.049919


def test_sums_of_whole_units_and_of_other_decimals_are_exact(spark):
    from fractions import Fraction

    columns = {
        "units": [0.1, 0.07, -0.0, -12.3456, 104999.91, 99999999999.9999, -99999999999.9999, 6e9, None, float("nan")],
        "others": [0.1 + 0.2, 1e-7, -2.00001, 1e11, 123456789012.3456, -1e16, 5e-18, None],
        "mixed": [0.05, 1 / 3, -7.0, -1e11 / 7, 1.7e9 + 0.1, float("nan")],
        "large": [5e19, 1.0, -0.25, 0.125],
        "too_large": [9e19, 9e19, 0.5],
        "empty": [None, float("nan")],
    }
    rows = [(c, v) for c, values in columns.items() for v in values]
    df = spark.createDataFrame(rows, "column string, value double").repartition(3)
    got = {r["column"]: r for r in T.profile_state(df).collect()}
    for c, values in columns.items():
        known = [Fraction(repr(v)) for v in values if v is not None and v == v]
        want = sum(known) if known and c != "too_large" else None
        assert (got[c]["sum"], got[c]["inexact"]) == (want, 0), c  # a decimal equals its fraction
    whole = T.profile_state(df)
    assert str(whole.schema["sum"].dataType) == "DecimalType(38,18)"
    # decimals are made only of values that are no whole number of units
    assert "isnull(_whole" in whole._jdf.queryExecution().optimizedPlan().toString()


def test_state_groups_by_the_number_of_a_column(spark):
    df = spark.createDataFrame([(1.5, [1, 2], 7), (None, [], 8), (2.5, None, 9)], "x double, a array<bigint>, y int")
    state = T.columns_state(df, ["x", "a", "y"])
    plan = state._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [_pos" in plan and "Aggregate [column" not in plan
    got = {r["column"]: (r["total"], r["valid_count"], r["sum"]) for r in state.collect()}
    assert got == {r["column"]: (r["total"], r["valid_count"], r["sum"]) for r in T.profile_state(T.measures(df, ["x", "a", "y"])).collect()}
    assert got == {"x": (3, 2, 4), "y": (3, 3, 24), "a#len": (3, 2, 2), "a#elem": (2, 2, 3)}


@pytest.mark.parametrize("parts, n", [(1, 240_000), (5, 240_000), (1, 10), (2, 0)])
def test_arriving_files_are_enough_for_all_cores(spark, parts, n):
    from clickloom.plans import queries as Q

    df = spark.range(0, n, 1, parts).withColumn("copy", F.lit(1))
    stream, where = Q._files(spark, df)
    written = spark.read.parquet(f"{where}/in")
    assert written.count() == n and written.select("id").distinct().count() == n
    sizes = [r["count"] for r in written.groupBy(F.input_file_name()).count().collect()]
    if n >= 240_000:
        # each of three batches has work for at least four tasks, also where the table is read by one
        assert len(sizes) >= 12 and max(sizes) <= 20_000
    total = one(T.finish(T.run_profile(stream, where, lambda rows: T.columns_state(rows, ["id"]))))["total"] if n else 0
    assert total == n


def test_exact_mean_gives_way_to_huge_values(spark):
    df = spark.createDataFrame([(1e30,), (1.0,), (None,), (float("nan"),)], "x double")
    r = one(T.finish(T.merge_states(T.profile_state(T.measures(df, ["x"])), T.profile_state(T.measures(df, ["x"])))))
    assert r["mean_exact"] is None and close(r["mean"], 5e29)
    small = spark.createDataFrame([(0.1,), (0.2,), (None,)], "x double")
    assert one(T.finish(T.profile_state(T.measures(small, ["x"]))))["mean_exact"] == __import__("decimal").Decimal("0.15")


def test_native_aggregation_restarts_and_equals_the_batch_profile(spark, tmp_path, files):
    path, add = files
    where = str(tmp_path / "native")
    schema = spark.createDataFrame([], SCHEMA).schema
    add(0, 300)
    add(300, 500)
    first = {r["column"]: r for r in T.finish(T.native_profile(T.stream_files(spark, path, schema), where, ["x", "a"])).collect()}
    assert first["x"]["total"] == 500
    add(500, 800)  # a new file after a stop: only it is read
    got = {r["column"]: r for r in T.finish(T.native_profile(T.stream_files(spark, path, schema), where, ["x", "a"])).collect()}
    whole = {r["column"]: r for r in T.finish(T.profile_state(T.measures(spark.read.parquet(path), ["x", "a"]))).collect()}
    assert set(got) == set(whole)
    for c in whole:
        for k in ("total", "null_count", "valid_count", "min", "max", "mean_exact"):
            assert got[c][k] == whole[c][k], (c, k)
        assert close(got[c]["std"], whole[c]["std"])


def test_theta_overlap_holds_its_bounds_in_estimation_mode(spark):
    ids = spark.range(1, 60001).select(
        F.when(F.col("id") <= 40000, F.lit("a")).otherwise(F.lit("c")).alias("domain"), F.col("id")
    ).unionByName(spark.range(20001, 90001).select(F.lit("b").alias("domain"), F.col("id")))
    ids = ids.unionByName(spark.createDataFrame([("a", None), ("b", 0), ("d", -3)], "domain string, id long"))
    parts = [T.overlap_state(ids.filter(F.pmod(F.xxhash64("id"), F.lit(3)) == i)) for i in range(3)]
    merged = {(r.domain_a, r.domain_b): r for r in T.finish_overlap(T.merge_overlap_states(*parts), ["a", "b", "c", "d"]).collect()}
    whole = {(r.domain_a, r.domain_b): r for r in T.finish_overlap(T.overlap_state(ids), ["a", "b", "c", "d"]).collect()}
    exact = {("a", "b"): (40000, 70000, 20000), ("a", "c"): (40000, 20000, 0), ("b", "c"): (70000, 20000, 20000)}
    for found in (merged, whole):
        for pair, (ua, ub, o) in exact.items():
            r = found[pair]
            assert r.overlap_spread > 0 and abs(r.overlap - o) <= r.overlap_spread
            assert abs(r.unique_a - ua) <= r.unique_a_spread and abs(r.unique_b - ub) <= r.unique_b_spread
        assert found[("a", "d")].overlap == 0 and found[("a", "d")].unique_b == 0


def test_comoments_group_by_one_number_and_carry_no_names(spark):
    rows = spark.createDataFrame([(1.0, 2.0, None), (2.0, 5.0, 3.0), (0.0, 1.0, 4.0)], "a double, b double, c double")
    state = T.comoment_state(rows, ["a", "b", "c"])
    # names and pivots are looked up after the aggregation, one row per pair
    assert "Aggregate [_pair" in state._jdf.queryExecution().optimizedPlan().toString()
    found = {(r["col_a"], r["col_b"]): (r["total"], r["n"], r["mx"], r["my"]) for r in state.collect()}
    assert found[("a", "b")] == (3, 2, 1.5, 3.5) and found[("a", "c")] == (3, 1, 2.0, 3.0)
    assert found[("c", None)] == (3, 2, 3.5, 3.5) and len(found) == 6


@pytest.mark.parametrize("parts", [1, 3, 7])
@pytest.mark.parametrize("offset", [0.0, 1.7e9])
def test_comoments_of_any_split_equal_correlations(spark, parts, offset):
    df = spark.range(0, 3000).select(
        F.col("id"),
        F.when(F.col("id") % 9 != 0, F.lit(offset) + F.col("id") * 0.5 + F.sin("id")).alias("a"),
        F.when(F.col("id") % 4 != 0, F.lit(offset) + F.col("id") * 0.3 - F.cos(F.col("id") * 3)).alias("b"),
        F.when(F.col("id") % 2 == 0, F.lit(offset) + F.sqrt("id")).otherwise(F.lit(0.0)).alias("c"),
        F.lit(7.0).alias("flat"), F.when(F.col("id") % 10 == 0, F.col("id")).alias("rare"),
    )
    cols = ["a", "b", "c", "flat", "rare"]
    pieces = [df.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == i) for i in range(parts)]
    got = {(r.col_a, r.col_b): r for r in T.finish_correlations(T.merge_comoments(*[T.comoment_state(p, cols) for p in pieces])).collect()}
    want = {(r.col_a, r.col_b): r for r in P.correlations(df, cols).collect()}
    assert set(got) == set(want) == {("a", "b"), ("a", "c"), ("b", "c")}
    for k, r in want.items():
        assert got[k].n == r.n and abs(got[k].pearson - r.pearson) < 1e-9, (k, got[k].pearson, r.pearson)


@pytest.mark.parametrize("parts", [1, 3, 10])
def test_bottom_k_of_files_in_any_order_equals_the_batch_sample(spark, parts):
    df = spark.range(0, 4000).select((F.col("id") % 1500).alias("uid"), F.col("id").alias("v"), F.create_map(F.lit("k"), F.col("id") % 3).alias("m"))
    pieces = [df.filter(F.pmod(F.xxhash64("v"), F.lit(parts)) == i) for i in range(parts)]
    for order in (pieces, pieces[::-1]):
        state = T.bottom_k(order[0], ["uid"], 300)
        for p in order[1:]:
            state = T.bottom_k(state.unionByName(T.bottom_k(p, ["uid"], 300)), ["uid"], 300)
        got = sorted((r.uid, r.v) for r in state.collect())
        assert len(got) == 300
        assert got == sorted((r.uid, r.v) for r in T.bottom_k(df, ["uid"], 300).collect())
    # a sample larger than the table holds every row
    assert T.bottom_k(df.limit(10), ["uid"], 300).count() == 10


def test_bottom_k_by_a_unique_id_equals_exact_sample(spark):
    from clickloom.operators import splits as X

    df = spark.range(0, 3000).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("x"))
    want = sorted(r.event_id for r in X.exact_sample(df, ["event_id"], 250).collect())
    assert sorted(r.event_id for r in T.bottom_k(df, ["event_id"], 250).collect()) == want


def test_outliers_from_merged_sketches_hold_their_intervals(spark):
    df = spark.range(0, 20000).select(
        F.col("id"), F.exp(F.sin(F.col("id") * 1.3) * 3).alias("x"), F.when(F.col("id") % 50 == 0, F.lit(1e6)).otherwise(F.col("id") % 100).alias("y")
    )
    parts = [T.profile_state(T.measures(df.filter(F.pmod(F.xxhash64("id"), F.lit(4)) == i), ["x", "y"])) for i in range(4)]
    found = {r["column"]: r for r in T.outlier_estimates(T.merge_states(*parts)).collect()}
    rows = df.collect()
    for c in ("x", "y"):
        r = found[c]
        below = sum(1 for row in rows if row[c] < r.lower)
        above = sum(1 for row in rows if row[c] > r.upper)
        assert abs(r.below - below) <= r.spread and abs(r.above - above) <= r.spread
    assert sum(1 for row in rows if row["y"] > found["y"].upper) == 400
    empty = T.outlier_estimates(T.profile_state(T.measures(df.filter("false"), ["x"])))
    assert empty.count() == 0
