"""Hand-computed cases of the column builders."""

import pytest
from helpers import column
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clickloom.functions import arrays as A
from clickloom.functions import scalars as S


def apply(spark, values, fn, kind="bigint"):
    return [r[0] for r in column(spark, values, kind).select(fn("v")).collect()]


def test_clean_and_limit(spark):
    values = [None, -1, 0, 3, 9]
    assert apply(spark, values, S.clean_id) == [0, 0, 0, 3, 9]
    assert apply(spark, values, lambda c: S.limit_vocab(S.clean_id(c), 5)) == [0, 0, 0, 3, 0]
    assert apply(spark, values, lambda c: S.limit_vocab(S.clean_id(c), 0)) == [0] * 5


def test_strict_vocabulary_fails_the_job(spark):
    with pytest.raises(Exception, match=r"outside \[0, 5\)"):
        apply(spark, [1, 9], lambda c: S.limit_vocab(c, 5, strict=True, name="f"))
    assert apply(spark, [1, 4], lambda c: S.limit_vocab(c, 5, strict=True)) == [1, 4]


def test_label(spark):
    assert apply(spark, [None, 1, 2, 3], S.binary_label) == [0, 0, 1, 0]
    assert apply(spark, [None, 2], lambda c: S.binary_label(c, is_training=False)) == [0, 0]


def test_fill_missing(spark):
    df = S.fill_missing(column(spark, [None, 0, 5]), ["v"])
    assert [r["v"] for r in df.orderBy("i").collect()] == [-1, 0, 5]


def test_pad_int(spark):
    values = [[5, -1, 0, 7], [2], [], None, [None, 4]]
    assert apply(spark, values, lambda c: A.pad_int(c, 3), "array<bigint>") == [
        [5, 0, 0], [2, 0, 0], [0, 0, 0], [0, 0, 0], [0, 4, 0],
    ]
    assert apply(spark, values, lambda c: A.head_length(c, 3), "array<bigint>") == [3, 1, 0, 0, 2]


def test_pad_float_keeps_signs(spark):
    assert apply(spark, [[-1.5, 2.0, 3.0], None, [1.0]], lambda c: A.pad_float(c, 2), "array<float>") == [
        [-1.5, 2.0], [0.0, 0.0], [1.0, 0.0],
    ]


def test_lengths(spark):
    values = [[5, -1, 0, 7], None, [0], []]
    assert apply(spark, values, A.valid_length, "array<bigint>") == [2, 0, 0, 0]
    assert apply(spark, values, A.nonzero_count, "array<bigint>") == [3, 0, 0, 0]
    assert apply(spark, values, A.has_valid, "array<bigint>") == [True, False, False, False]
    assert apply(spark, values, A.active_items, "array<bigint>") == [[5, -1, 7], None, [], []]


def test_last_k(spark):
    assert apply(spark, [[1, 2, 3], [1, 2, 3, 4, 5, 6, 7], []], lambda c: A.last_k(c, 5), "array<bigint>") == [
        [1, 2, 3], [3, 4, 5, 6, 7], [],
    ]


def test_time_bucket(spark):
    now = 10**9
    diffs = [0, 30, 31, 60, 61, 3600, 3601, 63072000, 63072001, -5]
    got = apply(spark, [now - d for d in diffs] + [0, -7, None], lambda c: S.time_bucket(F.lit(now), c))
    assert got == [1, 1, 2, 2, 3, 10, 11, 32, 32, 1, 0, 0, 0]


@pytest.mark.parametrize("edges", [S.TIME_EDGES, S.FINE_TIME_EDGES])
def test_time_bucket_agrees_with_counting(spark, edges):
    now = 2 * 10**9
    diffs = sorted({e + d for e in edges for d in (-1, 0, 1)})
    got = apply(spark, [now - d for d in diffs], lambda c: S.time_bucket(F.lit(now), c, edges))
    assert got == [min(sum(e < d for e in edges), len(edges) - 1) + 1 for d in diffs]
    assert len(S.TIME_EDGES) == 32 and len(S.FINE_TIME_EDGES) == 63


def test_virtual_id(spark):
    assert apply(spark, [5, 32, 0, -1, None], lambda c: S.virtual_id(c, 1, 32)) == [7, 2, 0, 0, 0]
    assert apply(spark, [31], lambda c: S.virtual_id(c, 34, 32)) == [66]
    assert apply(spark, [5, 99], lambda c: S.virtual_id(c, 10, 8, hashed=False)) == [15, 17]


def test_chunks(spark):
    assert A.chunk_shape(7, 3) == (3, 2)
    got = apply(spark, [[float(i) for i in range(1, 8)]], lambda c: A.chunk_split(c, 7, 3), "array<double>")
    assert got == [[[1, 2, 3], [4, 5, 6], [7, 0, 0]]]


def test_pairs(spark):
    df = spark.createDataFrame([([1, 2], [0.5]), ([3], [1.0])], "ids array<bigint>, w array<double>")
    got = [r[0] for r in df.select(A.aligned_pairs("ids", "w")).collect()]
    assert [[tuple(x) for x in g] for g in got] == [[(1, 0.5), (2, None)], [(3, 1.0)]]
    assert [r[0] for r in df.select(A.sizes_differ("ids", "w")).collect()] == [True, False]


def test_sigmoid_has_no_overflow(spark):
    got = apply(spark, [-1000.0, 0.0, 1000.0], S.sigmoid, "double")
    assert got == [0.0, 0.5, 1.0]


def test_dot(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "a array<double>, b array<double>")
    assert df.select(A.dot("a", "b", 2)).first()[0] == 11.0


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.lists(st.integers(-5, 50), max_size=12)), min_size=1, max_size=20), st.integers(1, 9))
def test_pad_int_property(spark, arrays, n):
    got = apply(spark, arrays, lambda c: A.pad_int(c, n), "array<bigint>")
    want = [([max(x, 0) for x in (a or [])[:n]] + [0] * n)[:n] for a in arrays]
    assert got == want
