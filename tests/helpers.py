import math


def rows(df, *cols):
    """Sorted tuples of a result."""
    names = cols or df.columns
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=lambda t: tuple((x is None, str(x)) for x in t))


def one(df):
    out = df.collect()
    assert len(out) == 1
    return out[0]


def close(a, b, tol=1e-6):
    return math.isclose(a, b, rel_tol=tol, abs_tol=tol)


def column(spark, values, kind="bigint", name="v"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} {kind}").orderBy("i")
