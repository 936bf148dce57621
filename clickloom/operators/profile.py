"""Column and sequence statistics.

Wide tables are turned into ``(column, value)`` rows first, so one aggregation with map-side combine
serves any number of columns. Each operator states its own rule for missing values; they differ on
purpose and are never shared:

* ``missing_rate``: values <= 0, NULL not counted
* ``null_rate``: NULL only
* ``scalar_stats``: drops NULL and 0, sample deviation
* ``running_stats``: drops NULL only, population deviation
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.catalogue import Catalogue
from clickloom.functions import arrays as A
from clickloom.functions.scalars import in_time_range
from clickloom.operators.order_stats import frequency_quantiles, probe_name, quantiles

REPORT_ABOVE = 0.01
IQR_FACTOR = 3.0
IQR_MIN_VALUES = 10
CORR_AT_LEAST = 0.90
CORR_PRESENT = 0.2
TS_SHARE = 0.8
DIGEST_OVER = 64


# ---- column kinds -------------------------------------------------------------------------------


def column_kinds(df: DataFrame) -> dict[str, str]:
    """Column name to ``scalar_int``, ``scalar_float``, ``array``, ``string`` or ``unknown``, from the schema."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            out[f.name] = "array"
        elif isinstance(f.dataType, T.StringType):
            out[f.name] = "string"
        elif isinstance(f.dataType, T.IntegralType):
            out[f.name] = "scalar_int"
        elif isinstance(f.dataType, T.NumericType):
            out[f.name] = "scalar_float"
        else:
            out[f.name] = "unknown"
    return out


def classify_columns(df: DataFrame, catalogue: Catalogue | None = None) -> dict[str, list[str]]:
    """Columns by name prefix and scalar or array kind, e.g. ``user_int/scalar``; sequences under ``seq``."""
    kinds = column_kinds(df)
    out: dict[str, list[str]] = {}
    for group, prefix in (("user_int", "user_int_feats"), ("item_int", "item_int_feats"), ("dense", "user_dense_feats")):
        names = [c for c in df.columns if c.startswith(prefix)]
        out[f"{group}/scalar"] = [c for c in names if kinds[c].startswith("scalar")]
        out[f"{group}/array"] = [c for c in names if kinds[c] == "array"]
    if catalogue is not None:
        known = {f.column for f in catalogue.group("seq")}
        out["seq"] = [c for c in df.columns if c in known]
    return out


def column_census(df: DataFrame) -> DataFrame:
    """Type, row count and NULLs of every column in one pass that reads no more than null masks."""
    names = df.columns
    kinds = column_kinds(df)
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(names)])
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(kinds[c]).alias("kind"),
            F.col("_n").alias("total"),
            (F.col("_n") - F.col(f"c{i}")).alias("null_count"),
            (F.col("_n") > 0).__and__(F.col(f"c{i}") == 0).alias("all_null"),
        )
        for i, c in enumerate(names)
    ]
    return counts.select(F.inline(F.array(*entries)))


# ---- long forms ---------------------------------------------------------------------------------


def numbered_form(df: DataFrame, columns: list[Column]) -> DataFrame:
    """``(_pos, value)`` rows of columns of one type by their place in the list; NULLs are kept.

    One array exploded by position: the generated code stays small for hundreds of columns, which an
    unpivot with one projection per column does not. Rows that are grouped carry one int instead of a name.
    """
    return df.select(F.posexplode(F.array(*columns)).alias("_pos", "value"))


def named(numbered: DataFrame, names: list[str]) -> DataFrame:
    """The name at place ``_pos`` as ``column``, before the other columns."""
    rest = [c for c in numbered.columns if c != "_pos"]
    return numbered.select(F.get(F.array(*[F.lit(c) for c in names]), F.col("_pos")).alias("column"), *rest)


def long_form(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``(column, value)`` rows of columns of one type; NULLs are kept."""
    return named(numbered_form(df, list(columns.values())), list(columns))


def scalar_long(df: DataFrame, columns: list[str]) -> DataFrame:
    return long_form(df, {c: F.col(c).cast("double") for c in columns})


def string_long(df: DataFrame, columns: list[str]) -> DataFrame:
    return long_form(df, {c: F.col(c).cast("string") for c in columns})


def array_long(df: DataFrame, columns: list[str], element: str = "double") -> DataFrame:
    """``(column, value)`` rows of array elements."""
    arrays = long_form(df, {c: F.col(c).cast(f"array<{element}>") for c in columns})
    return arrays.select("column", F.explode("value").alias("value"))


def value_counts(long: DataFrame, keys: list[str] = ["column"]) -> DataFrame:
    """Rows per (column, value): the de-duplicated table that frequency statistics share."""
    return long.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("count"))


def top_values(counts: DataFrame, k: int, keys: list[str] = ["column"]) -> DataFrame:
    """The ``k`` most frequent values per key, ties by value.

    The rank filter becomes a group limit below the shuffle, so each task sends at most ``k`` rows
    per key.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc("count"), "value")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


# ---- labels and missing values ------------------------------------------------------------------


def label_distribution(df: DataFrame, label: str = "label_type", positive: int = 2, negative: int = 1) -> DataFrame:
    c = F.col(label)
    return df.agg(
        F.count_if(c == positive).alias("positive"),
        F.count_if(c == negative).alias("negative"),
        F.count(F.lit(1)).alias("total"),
    ).select(
        "*",
        (F.col("positive") / F.greatest(F.col("total"), F.lit(1))).alias("pos_rate"),
        (F.col("negative") / F.greatest(F.col("positive"), F.lit(1))).alias("neg_per_pos"),
    )


def label_distribution_of(counts: DataFrame, positive: int = 2, negative: int = 1) -> DataFrame:
    """``label_distribution`` from ``label_counts``."""
    n = lambda v: F.coalesce(F.sum(F.when(F.col("label") == v, F.col("count"))), F.lit(0))
    return counts.agg(
        n(positive).alias("positive"), n(negative).alias("negative"), F.coalesce(F.sum("count"), F.lit(0)).alias("total")
    ).select(
        "*",
        (F.col("positive") / F.greatest(F.col("total"), F.lit(1))).alias("pos_rate"),
        (F.col("negative") / F.greatest(F.col("positive"), F.lit(1))).alias("neg_per_pos"),
    )


def label_counts(df: DataFrame, label: str = "label_type") -> DataFrame:
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("count"))


def _rates(df: DataFrame, columns: list[str], bad: Column, above: float) -> DataFrame:
    stats = scalar_long(df, columns).groupBy("column").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(bad).alias("missing_count")
    )
    return stats.withColumn("missing_rate", F.col("missing_count") / F.col("total")).filter(
        F.col("missing_rate") > above
    )


def missing_rate(df: DataFrame, columns: list[str], above: float = REPORT_ABOVE) -> DataFrame:
    """Share of values <= 0 over all rows, for columns where it exceeds ``above``. NULL is not counted."""
    return _rates(df, columns, F.col("value") <= 0, above)


def null_rate(df: DataFrame, columns: list[str], above: float = REPORT_ABOVE) -> DataFrame:
    """Share of NULL over all rows, for columns where it exceeds ``above``."""
    return _rates(df, columns, F.col("value").isNull(), above)


# ---- scalar statistics --------------------------------------------------------------------------


def scalar_stats(df: DataFrame, columns: list[str], probs: list[float] = [0.5, 0.9, 0.99]) -> DataFrame:
    """Per column over values other than NULL and 0 (negatives stay): range, mean, sample deviation, percentiles.

    Columns without such a value keep a row with zero ``valid_count`` and NULL statistics.
    """
    long = scalar_long(df, columns)
    v = F.when((F.col("value") != 0) & ~F.isnan("value"), F.col("value"))
    moments = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("value") <= 0).alias("missing_count"),
        F.count(v).alias("valid_count"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
    )
    found = quantiles(long.filter(F.col("value") != 0), ["column"], "value", probs)
    # both sides hold one row per column
    return moments.join(F.broadcast(found), "column", "left").withColumn(
        "missing_rate", F.col("missing_count") / F.col("total")
    )


def scalar_summary(
    counts: DataFrame, probs: list[float] = [0.5, 0.9, 0.99], factor: float = IQR_FACTOR
) -> tuple[DataFrame, DataFrame]:
    """``scalar_stats`` and ``iqr_outliers`` of all columns from one saved table ``(column, value, count)``.

    Moments, then both sets of percentiles together, then deviation and outliers in one more pass. Both results have a
    row per column.
    """
    real = F.col("value").isNotNull() & ~F.isnan("value")
    v = F.when(real & (F.col("value") != 0), F.col("value"))
    held = F.when(v.isNotNull(), F.col("count")).otherwise(0)
    moments = counts.groupBy("column").agg(
        F.sum("count").alias("total"),
        F.coalesce(F.sum(F.when(F.col("value") <= 0, F.col("count"))), F.lit(0)).alias("missing_count"),
        F.sum(held).alias("valid_count"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        (F.sum(v * F.col("count")) / F.nullif(F.sum(held), F.lit(0))).alias("mean"),
    )
    sets = F.array_compact(F.array(F.when(F.col("value") != 0, "other"), F.when(F.col("value") > 0, "above")))
    both = counts.filter(real).select("column", "value", "count", F.explode(sets).alias("of"))
    every = sorted({*probs, 0.25, 0.75})
    found = quantiles(both, ["column", "of"], "value", every, "count")
    other = found.filter("of = 'other'").select("column", *[probe_name(p) for p in probs])
    spread = F.col("p75") - F.col("p25")
    bounds = found.filter("of = 'above'").select(
        "column", F.col("p25").alias("q1"), F.col("p75").alias("q3"),
        (F.col("p25") - factor * spread).alias("lower"), (F.col("p75") + factor * spread).alias("upper"),
    )
    rows = moments.join(F.broadcast(other), "column", "left").join(F.broadcast(bounds), "column", "left")
    rows = rows.sparkSession.createDataFrame(rows.collect(), rows.schema)  # a row per column
    above = real & (F.col("value") > 0)
    outside = above & ((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper")))
    second = counts.join(F.broadcast(rows.select("column", "mean", "lower", "upper")), "column").groupBy("column").agg(
        F.sum(F.col("count") * F.pow(v - F.col("mean"), 2)).alias("_m2"),
        F.coalesce(F.sum(F.when(above, F.col("count"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(outside, F.col("count"))), F.lit(0)).alias("outlier_count"),
    )
    all_rows = rows.join(F.broadcast(second), "column")
    std = F.when(F.col("valid_count") > 1, F.sqrt(F.col("_m2") / (F.col("valid_count") - 1)))
    names = ["total", "missing_count", "valid_count", "min", "max", "mean"]
    stats = all_rows.select(
        "column", *names, std.alias("std"), *[probe_name(p) for p in probs],
        (F.col("missing_count") / F.col("total")).alias("missing_rate"),
    )
    return stats, _severity(all_rows.select("column", "q1", "q3", "lower", "upper", "n", "outlier_count"))


def running_moments(long: DataFrame, keys: list[str] = ["column"]) -> DataFrame:
    """Mergeable exact moments over non-NULL values: the state that incremental profiling keeps.

    ``m2`` is the sum of squared differences from the mean, so large values do not swallow their spread.
    """
    v = F.when(~F.isnan("value"), F.col("value"))
    return long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count(v).alias("valid_count"),
        F.avg(v).alias("mean"),
        (F.coalesce(F.var_pop(v), F.lit(0.0)) * F.count(v)).alias("m2"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )


def merge_moments(parts: DataFrame, keys: list[str] = ["column"], extra: list[Column] = []) -> DataFrame:
    """Moments of all rows from the moments of disjoint parts, by the pairwise formula; few rows per key."""
    group = Window.partitionBy(*keys)
    n = F.sum("valid_count").over(group)
    mean = F.sum(F.col("mean") * (F.col("valid_count") / n)).over(group)
    around = F.col("m2") + F.col("valid_count") * F.coalesce(F.pow(F.col("mean") - F.col("_mean"), 2), F.lit(0.0))
    return (
        parts.withColumn("_mean", F.when(n > 0, mean))
        .withColumn("_around", around)
        .groupBy(*keys)
        .agg(
            F.sum("total").alias("total"),
            F.sum("valid_count").alias("valid_count"),
            F.max("_mean").alias("mean"),
            F.sum("_around").alias("m2"),
            F.min("min").alias("min"),
            F.max("max").alias("max"),
            *extra,
        )
    )


def finish_moments(moments: DataFrame, keys: list[str] = ["column"], extra: list[Column] = []) -> DataFrame:
    """Counts, range, mean and population deviation from moments, then the ``extra`` columns."""
    n = F.when(F.col("valid_count") > 0, F.col("valid_count"))
    return moments.select(
        *keys,
        "total",
        (F.col("total") - F.col("valid_count")).alias("null_count"),
        ((F.col("total") - F.col("valid_count")) / F.col("total")).alias("null_rate"),
        "valid_count",
        "min",
        "max",
        "mean",
        F.sqrt(F.col("m2") / n).alias("std"),
        *extra,
    )


def running_stats(df: DataFrame, columns: list[str], probs: list[float] = [0.5, 0.9, 0.99]) -> DataFrame:
    """Per column over non-NULL values: counts, range, mean, population deviation, exact percentiles."""
    long = scalar_long(df, columns)
    stats = finish_moments(running_moments(long))
    return stats.join(F.broadcast(quantiles(long, ["column"], "value", probs)), "column", "left")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sample deviation, range and quartiles of the non-NULL values per column."""
    long = scalar_long(df, columns)
    v = F.when(~F.isnan("value"), F.col("value"))
    stats = long.groupBy("column").agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"),
    )
    return stats.join(F.broadcast(quantiles(long, ["column"], "value", [0.25, 0.5, 0.75])), "column", "left")


def string_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, NULLs and number of different values per string column.

    Long strings are told apart by their SHA-256 digest, so texts are not shuffled.
    """
    short = F.when(F.length("value") > DIGEST_OVER, F.sha2("value", 256)).otherwise(F.col("value"))
    counts = value_counts(string_long(df, columns).withColumn("value", short))
    return counts.groupBy("column").agg(
        F.sum("count").alias("total"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("count"))), F.lit(0)).alias("null_count"),
        F.count("value").alias("unique_count"),
    )


def string_top(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """The ``k`` most frequent non-NULL values per string column, ties by value: ``column, value, count, rank``.

    Values are counted by a 128-bit digest, so long texts are not shuffled to be counted. The ``k``-th count of each column
    comes from the counts alone; texts are then fetched only for digests above it and for those tied at it, and the ties
    are ordered by text.
    """
    long = string_long(df, columns).filter("value is not null").withColumn("_d", F.md5("value"))
    counts = long.groupBy("column", "_d").agg(F.count(F.lit(1)).alias("count"))
    by_count = Window.partitionBy("column").orderBy(F.desc("count"))
    kth = counts.withColumn("_r", F.row_number().over(by_count)).filter(F.col("_r") == k).select("column", F.col("count").alias("_kth"))
    # columns with fewer than k values keep them all
    wanted = counts.join(F.broadcast(kth), "column", "left").filter(F.col("_kth").isNull() | (F.col("count") >= F.col("_kth")))
    texts = long.join(wanted.select("column", "_d"), ["column", "_d"], "left_semi").groupBy("column", "_d").agg(F.min("value").alias("value"))
    found = wanted.join(texts, ["column", "_d"]).select("column", "value", "count")
    return top_values(found, k)


def string_sketch(df: DataFrame, columns: list[str], k: int = 20, counters: int = 10000) -> DataFrame:
    """One-pass estimate of distinct values and frequent values: fixed memory per column."""
    return (
        string_long(df, columns)
        .groupBy("column")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.hll_sketch_estimate(F.hll_sketch_agg("value")).alias("approx_unique"),
            F.expr(f"approx_top_k(value, {k}, {counters}) filter (where value is not null)").alias("approx_top"),
        )
    )


# ---- array statistics ---------------------------------------------------------------------------


def array_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per array column: longest array and, over all elements, count, count above 0 and range and mean of those.

    Empty and NULL arrays pass the explode as a row without a position, so one scan serves all.
    """
    arrays = long_form(df, {c: F.col(c).cast("array<double>") for c in columns})
    elements = arrays.select("column", F.posexplode_outer("value").alias("pos", "value"))
    v = F.when(F.col("value") > 0, F.col("value"))
    stats = elements.groupBy("column").agg(
        (F.coalesce(F.max("pos") + 1, F.lit(0))).cast("bigint").alias("max_dim"),
        F.count("pos").alias("total_values"),
        F.count(v).alias("valid_count"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.avg(v).alias("mean"),
    )
    missing = F.col("total_values") - F.col("valid_count")
    return stats.withColumn("missing_rate", missing / F.greatest(F.col("total_values"), F.lit(1)))


def element_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, value, count, last)``: elements by value with their last position; one NULL row stands for what is empty."""
    arrays = long_form(df, {c: F.col(c).cast("array<double>") for c in columns})
    elements = arrays.select("column", F.posexplode_outer("value").alias("pos", "value"))
    return elements.groupBy("column", "value").agg(F.count("pos").alias("count"), F.max("pos").alias("last"))


def array_summary(counts: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """``array_stats`` and ``array_top`` from one saved table of ``element_counts``."""
    above = F.col("value") > 0
    valid = F.coalesce(F.sum(F.when(above, F.col("count"))), F.lit(0))
    stats = counts.groupBy("column").agg(
        F.coalesce(F.max("last") + 1, F.lit(0)).cast("bigint").alias("max_dim"),
        F.sum("count").alias("total_values"),
        valid.alias("valid_count"),
        F.min(F.when(above, F.col("value"))).alias("min"),
        F.max(F.when(above, F.col("value"))).alias("max"),
        (F.sum(F.when(above, F.col("value") * F.col("count"))) / F.nullif(valid, F.lit(0))).alias("mean"),
    )
    missing = F.col("total_values") - F.col("valid_count")
    stats = stats.withColumn("missing_rate", missing / F.greatest(F.col("total_values"), F.lit(1)))
    whole = counts.select("column", F.col("value").cast("bigint").alias("value"), "count").filter("value > 0")
    return stats, top_values(whole.groupBy("column", "value").agg(F.sum("count").alias("count")), k)


def array_top(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """Most frequent whole-number elements above 0 per array column."""
    long = array_long(df, columns, "bigint").filter("value > 0")
    return top_values(value_counts(long), k)


def element_top(df: DataFrame, columns: list[str], k: int = 20) -> DataFrame:
    """Most frequent elements per array column over all elements, 0 and negatives too, where all are whole numbers.

    NULL and NaN elements are left out. A column with any fraction gives no row.
    """
    counts = value_counts(array_long(df, columns).filter("value is not null and not isnan(value)"))
    # the flag is one aggregate per column: joined, so that a column's values stay spread
    fraction = counts.groupBy("column").agg(F.max(F.col("value") != F.floor("value")).alias("_fraction"))
    whole = counts.join(F.broadcast(fraction), "column").filter("not _fraction").drop("_fraction")
    return top_values(whole.withColumn("value", F.col("value").cast("bigint")), k)


def array_length_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per array column: lengths of non-NULL arrays (mean, population deviation, percentiles, share of empty)
    and, over all elements, count, range, mean and population deviation."""
    probs = [0.5, 0.75, 0.9, 0.95, 0.99]
    sizes = long_form(df, {c: F.size(c).cast("bigint") for c in columns})
    known = F.when(F.col("value").isNotNull(), F.col("count"))
    x = F.col("value").cast("double")
    n, total = F.sum(known), F.sum(known * x)
    of_column = Window.partitionBy("column")
    freq = value_counts(sizes).withColumn("_mean", total.over(of_column) / n.over(of_column))
    lengths = frequency_quantiles(
        freq, ["column"], "value", "count", probs,
        F.sum("count").alias("total"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("count"))), F.lit(0)).alias("null_count"),
        (total / n).alias("len_mean"),
        F.sqrt(F.sum(known * F.pow(x - F.col("_mean"), 2)) / n).alias("len_std"),
        F.min("value").alias("len_min"),
        F.max("value").alias("len_max"),
        (F.coalesce(F.sum(F.when(F.col("value") == 0, F.col("count"))), F.lit(0)) / n).alias("zero_len_rate"),
    )
    names = [c for c in lengths.columns if c.startswith("p")]
    lengths = lengths.select(
        *[c for c in lengths.columns if c not in names], *[F.floor(c).alias(f"len_{c}") for c in names]
    )
    elements = array_long(df, columns).groupBy("column").agg(
        F.count(F.lit(1)).alias("elements"),
        F.min("value").alias("elem_min"),
        F.max("value").alias("elem_max"),
        F.avg("value").alias("elem_mean"),
        F.stddev_pop("value").alias("elem_std"),
    )
    # one row per column each
    return lengths.join(F.broadcast(elements), "column", "left")


# ---- sequences ----------------------------------------------------------------------------------


def array_domain_lengths(
    df: DataFrame, catalogue: Catalogue, first_field: bool = False, keep: list[str] = []
) -> DataFrame:
    """``(domain, valid_len, raw_len)`` per row and domain, measured on each domain's reference column, after ``keep``.

    With ``first_field`` the first field of the domain that the table has stands for it, timestamp or not: the rule
    of batch coverage.
    """
    chosen = {}
    for d in catalogue.domains:
        fields = [f for f in catalogue.group("seq") if f.domain == d] if first_field else [catalogue.reference_feature(d)]
        present = [f.column for f in fields if f.column in df.columns]
        if present:
            chosen[d] = present[0]
    parts = []
    for d, c in chosen.items():
        valid, raw = A.valid_length(c), F.coalesce(F.size(c), F.lit(0))
        parts.append(F.struct(F.lit(d).alias("domain"), valid.alias("valid_len"), raw.alias("raw_len")))
    if not parts:
        nothing = F.array().cast("array<struct<domain: string, valid_len: int, raw_len: int>>")
        return df.select(*keep, F.inline(nothing))
    return df.select(*keep, F.inline(F.array(*parts)))


def event_domain_lengths(events: DataFrame, user: str, domain: str, item: str, domains: list[str]) -> DataFrame:
    """``(user, domain, valid_len, raw_len)`` counted from single events, with 0 for domains a user lacks.

    Counts combine on the map side; no history is gathered.
    """
    counts = events.groupBy(user).agg(
        *[F.count_if((F.col(domain) == d) & (F.col(item) > 0)).alias(f"v_{d}") for d in domains],
        *[F.count_if(F.col(domain) == d).alias(f"r_{d}") for d in domains],
    )
    parts = [
        F.struct(F.lit(d).alias("domain"), F.col(f"v_{d}").alias("valid_len"), F.col(f"r_{d}").alias("raw_len"))
        for d in domains
    ]
    return counts.select(user, F.inline(F.array(*parts)))


def length_frequencies(lengths: DataFrame) -> DataFrame:
    """``(domain, valid_len, count, raw_len)``: rows per valid length, with the longest raw length among them."""
    return lengths.groupBy("domain", F.col("valid_len").cast("bigint").alias("valid_len")).agg(
        F.count(F.lit(1)).alias("count"), F.max("raw_len").cast("bigint").alias("raw_len")
    )


def seq_length_stats(freq: DataFrame) -> DataFrame:
    """Per domain from ``length_frequencies``: mean, percentiles and maximum of valid lengths, share of empty
    ones, suggested cap (the 90th percentile rounded down)."""
    n = F.sum("count")
    stats = frequency_quantiles(
        freq, ["domain"], "valid_len", "count", [0.5, 0.9, 0.99],
        n.alias("n_rows"),
        (F.sum(F.col("valid_len").cast("double") * F.col("count")) / n).alias("mean_len"),
        F.max("valid_len").alias("max_len"),
        F.max("raw_len").alias("max_raw_len"),
        (F.coalesce(F.sum(F.when(F.col("valid_len") == 0, F.col("count"))), F.lit(0)) / n).alias("zero_seq_rate"),
    )
    return stats.withColumn("suggested_cap", F.floor("p90"))


def domain_coverage(freq: DataFrame) -> DataFrame:
    """Per domain from ``length_frequencies``: rows with and without a valid element, and the share with one."""
    held = F.coalesce(F.sum(F.when(F.col("valid_len") > 0, F.col("count"))), F.lit(0))
    return freq.groupBy("domain").agg(
        held.alias("with_seq"),
        (F.sum("count") - held).alias("without_seq"),
        (held / F.sum("count")).alias("coverage"),
    )


def sequence_value_counts(df: DataFrame, catalogue: Catalogue) -> DataFrame:
    """``(domain, column, value, count)`` over ids above 0 of all sequence columns in one pass.

    Grouped by the position of the column; names are put on the de-duplicated rows.
    """
    present = [f for f in catalogue.group("seq") if f.column in df.columns]
    arrays = F.array(*[F.col(f.column).cast("array<bigint>") for f in present])
    elements = df.select(F.posexplode(arrays).alias("_pos", "items")).select("_pos", F.explode("items").alias("value"))
    counts = value_counts(elements.filter("value > 0"), ["_pos"])
    domains, columns = (F.array(*[F.lit(x) for x in names]) for names in zip(*[(f.domain, f.column) for f in present]))
    at = F.col("_pos")
    return counts.select(F.get(domains, at).alias("domain"), F.get(columns, at).alias("column"), "value", "count")


def vocab_coverage(counts: DataFrame, declared: DataFrame) -> DataFrame:
    """Different ids seen per field against the declared vocabulary.

    ``counts`` holds ``(column, value, count)``, ``declared`` ``(column, vocab, is_ts)``. Fields never
    seen keep a row with 0.
    """
    # value > 0 rows are unique per column here, so counting them is the distinct count
    seen = counts.filter("value > 0").groupBy("column").agg(F.count(F.lit(1)).alias("unique_ids"))
    unique = F.coalesce(F.col("unique_ids"), F.lit(0))
    return declared.join(seen, "column", "left").select(
        "column",
        "vocab",
        unique.alias("unique_ids"),
        (unique / F.greatest(F.col("vocab"), F.lit(1))).alias("coverage_rate"),
        "is_ts",
        F.when(F.col("is_ts"), "timestamp").when(unique < F.col("vocab") * 0.01, "shrink").otherwise("").alias("note"),
    )


def timestamp_fields(counts: DataFrame, keys: list[str] = ["column"]) -> DataFrame:
    """Share of values above 0 that lie in the plausible time range, and whether it exceeds 80%."""
    share = F.sum(F.when(in_time_range("value"), F.col("count")).otherwise(0)) / F.sum("count")
    return (
        counts.filter("value > 0")
        .groupBy(*keys)
        .agg(share.alias("in_range"))
        .withColumn("is_timestamp", F.col("in_range") > TS_SHARE)
    )


BITS = 62


def domain_overlap(ids: DataFrame, domains: list[str], domain: str = "domain", item: str = "id") -> DataFrame:
    """Shared ids of every pair of domains, pairs without any included.

    Each id carries one bit per domain it occurs in, so one aggregation by id with map-side combine
    replaces the self-join. Ids with the same bits are then counted as one row; only these rows are
    turned into pairs of domains. Domains beyond 62 use further words.
    """
    words = [domains[i : i + BITS] for i in range(0, len(domains), BITS)]
    masks = []
    for w, names in enumerate(words):
        code = F.lit(0).cast("bigint")
        for i, d in enumerate(names):
            code = F.when(F.col(domain) == d, F.lit(1 << i).cast("bigint")).otherwise(code)
        masks.append(F.bit_or(code).alias(f"_m{w}"))
    words_of = [f"_m{w}" for w in range(len(words))]
    by_mask = (
        ids.filter(F.col(item) > 0)
        .groupBy(item)
        .agg(*masks)
        .groupBy(*words_of)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    held = F.array_compact(
        F.array(
            *[
                F.when(F.col(f"_m{w}").bitwiseAND(F.lit(1 << i)) != 0, F.lit(d))
                for w, names in enumerate(words)
                for i, d in enumerate(names)
            ]
        )
    )
    rows = by_mask.select("_n", held.alias("_held")).select(
        "_n", "_held", F.posexplode("_held").alias("_i", "domain_a")
    )
    # every domain is paired with itself, which counts its ids, and with those after it
    counts = (
        rows.select("_n", "domain_a", F.explode(F.slice("_held", F.col("_i") + 1, F.size("_held"))).alias("domain_b"))
        .groupBy("domain_a", "domain_b")
        .agg(F.sum("_n").alias("_n"))
    )
    pairs = ids.sparkSession.createDataFrame(
        [(a, b) for i, a in enumerate(domains) for b in domains[i + 1 :]], "domain_a string, domain_b string"
    )

    def of(side: str, name: str) -> DataFrame:
        own = counts.filter("domain_a = domain_b")
        return F.broadcast(own.select(F.col("domain_a").alias(side), F.col("_n").alias(name)))

    # all tables here have at most one row per pair of domains
    o, a, b = (F.coalesce(F.col(c), F.lit(0)) for c in ("_n", "_a", "_b"))
    one = F.lit(1)
    return (
        pairs.join(F.broadcast(counts), ["domain_a", "domain_b"], "left")
        .join(of("domain_a", "_a"), "domain_a", "left")
        .join(of("domain_b", "_b"), "domain_b", "left")
        .select(
            "domain_a", "domain_b", a.alias("unique_a"), b.alias("unique_b"), o.alias("overlap"),
            (o / F.greatest(a, one)).alias("rate_a"), (o / F.greatest(b, one)).alias("rate_b"),
            (o / F.greatest(F.least(a, b), one) > 0.3).alias("share"),
        )
    )


# ---- outliers and correlation -------------------------------------------------------------------


def iqr_outliers(df: DataFrame, columns: list[str], factor: float = IQR_FACTOR) -> DataFrame:
    """Values above 0 that lie more than ``factor`` quartile ranges outside the quartiles.

    Columns with fewer than 10 values above 0 or without outliers have no row.
    """
    long = scalar_long(df, columns).filter("value > 0 and not isnan(value)")
    q = quantiles(long, ["column"], "value", [0.25, 0.75])
    spread = F.col("p75") - F.col("p25")
    bounds = q.select(
        "column", F.col("p25").alias("q1"), F.col("p75").alias("q3"),
        (F.col("p25") - factor * spread).alias("lower"), (F.col("p75") + factor * spread).alias("upper"),
    )
    outside = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    # bounds has one row per column
    stats = long.join(F.broadcast(bounds), "column").groupBy("column", "q1", "q3", "lower", "upper").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(outside).alias("outlier_count")
    )
    return _severity(stats)


def _severity(stats: DataFrame) -> DataFrame:
    """Columns with enough values and an outlier, with rate and grade."""
    rate = F.col("outlier_count") / F.col("n")
    return stats.filter((F.col("n") >= IQR_MIN_VALUES) & (F.col("outlier_count") > 0)).select(
        "*",
        rate.alias("outlier_rate"),
        F.when(rate > 0.01, "severe").when(rate > 0.0001, "mild").otherwise("rare").alias("severity"),
    )


def correlations(df: DataFrame, columns: list[str], stats: list | None = None) -> DataFrame:
    """Pearson r of every pair of columns over rows where both are present, ``(col_a, col_b, n, pearson)``.

    0 counts as absent, columns present in at most 20% of rows are left out. All pairs come from one
    Gramian of ``[x m, m, x x m]`` with centred ``x`` and presence ``m``: one pass whatever the number
    of columns, and a result of catalogue size on the driver. Runs when called. ``stats`` are rows ``column, total,
    valid_count, mean, std`` of values that are present, if they are known already.
    """
    spark = df.sparkSession
    schema = "col_a string, col_b string, n bigint, pearson double"

    def present(v: Column) -> Column:
        return F.when((v != 0) & ~F.isnan(v), v)

    if stats is None:
        values = scalar_long(df, columns).withColumn("value", present(F.col("value")))
        stats = values.groupBy("column").agg(
            F.count(F.lit(1)).alias("total"), F.count("value").alias("valid_count"),
            F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        ).collect()
    stats = [r for r in stats if r["valid_count"] > r["total"] * CORR_PRESENT]
    known = {r["column"]: r for r in stats}
    kept = [c for c in columns if c in known]
    if len(kept) < 2:
        return spark.createDataFrame([], schema)
    d = len(kept)
    # scaling by the deviation keeps the cells of columns of very different size comparable
    means = F.array(*[F.lit(known[c]["mean"]) for c in kept])
    scales = F.array(*[F.lit(known[c]["std"] or 1.0) for c in kept])
    values = F.transform(F.array(*[F.col(c).cast("double") for c in kept]), present)
    x = F.transform(values, lambda v, i: F.coalesce((v - F.get(means, i)) / F.get(scales, i), F.lit(0.0)))
    m = F.transform(values, lambda v: F.when(v.isNull(), 0.0).otherwise(1.0))
    centred = df.select(x.alias("x"), m.alias("m"))
    squares = F.transform("x", lambda v: v * v)
    vectors = centred.select(array_to_vector(F.concat("x", "m", squares)).alias("v"))
    g = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v")).computeGramianMatrix().toArray()

    out = []
    for i in range(d):
        for j in range(i + 1, d):
            n = g[d + i, d + j]
            sx, sy, sxy = g[i, d + j], g[j, d + i], g[i, j]
            vx = n * g[2 * d + i, d + j] - sx * sx
            vy = n * g[2 * d + j, d + i] - sy * sy
            # what rounding leaves of a constant column is no variance
            if n > 1 and vx > 1e-12 * n * n and vy > 1e-12 * n * n:
                r = (n * sxy - sx * sy) / (vx * vy) ** 0.5
                out.append((kept[i], kept[j], int(round(n)), float(min(1.0, max(-1.0, r)))))
    return spark.createDataFrame(out, schema)


def correlated_pairs(
    df: DataFrame, columns: list[str], at_least: float = CORR_AT_LEAST, stats: list | None = None
) -> DataFrame:
    """Pairs with |r| >= ``at_least``, r rounded to 4 places."""
    return correlations(df, columns, stats).filter(F.abs("pearson") >= at_least).select(
        "col_a", "col_b", F.round("pearson", 4).alias("pearson")
    )
