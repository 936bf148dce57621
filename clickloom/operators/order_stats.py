"""Exact order statistics and percentiles without sorting the table or holding a group in memory.

The value at a rank is found by narrowing. Rows are counted per logarithmic bin; the bin that holds
the rank is, if it is large, cut into linear sub-bins between its actual ends; rows of the piece that
holds the rank are counted per value. Every count combines on the map side, so what is shuffled is
bounded by the number of bins, and only the last, narrow step looks at single values. A value that
holds a third of all rows is one counted row there.

Between the passes one row per (group, rank) comes to the driver. Groups are columns, domains or
label classes, so these rows are of catalogue size; more than ``BROADCAST_ROWS`` of them are joined
by shuffle instead of broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PER_OCTAVE = 64
SUB_BINS = 16384
BROADCAST_ROWS = 10_000
# bins holding more rows than this in total are cut once more before single values are counted
DIRECT_ROWS = 5_000_000
_LARGEST = 1.7976931348623157e308


def _log_bin(v: Column) -> Column:
    size = F.floor(F.log2(F.abs(v)) * PER_OCTAVE) + 1100 * PER_OCTAVE
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0)).cast("bigint")


def _sub_bin(v: Column, low: Column, high: Column) -> Column:
    part = F.floor((v - low) / (high - low) * SUB_BINS).cast("bigint")
    return F.when(high > low, F.least(part, F.lit(SUB_BINS - 1))).otherwise(F.lit(0)).cast("bigint")


def _running(df: DataFrame, by: list[str], order: str, count: str) -> DataFrame:
    """Add ``_before``: rows of the group that sort before this one."""
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_before", F.sum(count).over(upto) - F.col(count))


def _holds(rank: str) -> Column:
    return (F.col(rank) >= F.col("_before")) & (F.col(rank) < F.col("_before") + F.col("_c"))


def order_statistics(
    df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column], weight: str | None = None
) -> DataFrame:
    """The values at given 0-based ranks within each group: rows ``(keys, n, probe, rank, value)``.

    ``ranks`` maps a probe name to an expression over ``n``, the number of rows in the group; ranks
    outside ``[0, n)`` give no row. NULL and NaN values are left out. ``weight`` names a column of
    counts when rows are already grouped. Runs one or two small jobs when called; ``df`` is read
    again by the result, so persist it if it is costly to compute.
    """
    spark = df.sparkSession
    on = [f"_k{i}" for i in range(max(len(keys), 1))]
    key_cols = [F.col(k).alias(n) for k, n in zip(keys, on)] or [F.lit(0).alias("_k0")]
    w = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    rows = (
        df.select(*key_cols, F.col(value).alias("_x"), w.alias("_w"))
        .filter(F.col("_x").isNotNull() & ~F.isnan(F.col("_x").cast("double")))
        .withColumn("_v", F.greatest(F.least(F.col("_x").cast("double"), F.lit(_LARGEST)), F.lit(-_LARGEST)))
        .withColumn("_b", _log_bin(F.col("_v")))
    )
    fields = {f.name: f.dataType for f in rows.schema.fields}
    key_type = [T.StructField(k, fields[k]) for k in on]
    long = T.LongType()

    def local(data: list[tuple], *names: str) -> DataFrame:
        extra = [T.StructField(n, T.StringType() if n == "probe" else T.DoubleType() if n in ("_lo", "_hi") else long)
                 for n in names]
        table = spark.createDataFrame(data, T.StructType(key_type + extra))
        return F.broadcast(table) if len(data) <= BROADCAST_ROWS else table

    # pass 1: counts per logarithmic bin
    probes = F.array(
        *[F.struct(F.lit(name).alias("probe"), e.cast("bigint").alias("_rank")) for name, e in ranks.items()]
    )
    bins = rows.groupBy(*on, "_b").agg(F.sum("_w").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    hits = (
        _running(bins, on, "_b", "_c")
        .withColumn("n", F.sum("_c").over(Window.partitionBy(*on)))
        .select("*", F.inline(probes))
        .filter(_holds("_rank"))
        .collect()
    )
    ends = {(*[h[k] for k in on], h["_b"]): (h["_lo"], h["_hi"], h["_c"]) for h in hits}
    found = [(*[h[k] for k in on], h["_b"], 0, h["n"], h["probe"], h["_rank"], h["_rank"] - h["_before"]) for h in hits]
    pieces = rows.join(local([(*k, lo, hi) for k, (lo, hi, _) in ends.items()], "_b", "_lo", "_hi"), [*on, "_b"])

    if sum(c for _, _, c in ends.values()) > DIRECT_ROWS:
        # pass 2: counts per linear sub-bin of those bins
        pieces = pieces.withColumn("_s", _sub_bin(F.col("_v"), F.col("_lo"), F.col("_hi")))
        subs = pieces.groupBy(*on, "_b", "_s").agg(F.sum("_w").alias("_c"))
        hits = (
            _running(subs, [*on, "_b"], "_s", "_c")
            .join(local(found, "_b", "_z", "n", "probe", "rank", "_left"), [*on, "_b"])
            .filter(_holds("_left"))
            .collect()
        )
        found = [
            (*[h[k] for k in on], h["_b"], h["_s"], h["n"], h["probe"], h["rank"], h["_left"] - h["_before"])
            for h in hits
        ]
        wanted = list({f[: len(on) + 2]: None for f in found})
        pieces = pieces.join(local(wanted, "_b", "_s"), [*on, "_b", "_s"])
    else:
        pieces = pieces.withColumn("_s", F.lit(0).cast("bigint"))

    # last pass: counts per value of the pieces left
    values = pieces.groupBy(*on, "_b", "_s", "_x").agg(F.sum("_w").alias("_c"))
    return (
        _running(values, [*on, "_b", "_s"], "_x", "_c")
        .join(local(found, "_b", "_s", "n", "probe", "rank", "_left"), [*on, "_b", "_s"])
        .filter(_holds("_left"))
        .select(*[F.col(n).alias(k) for k, n in zip(keys, on)], "n", "probe", "rank", F.col("_x").alias("value"))
    )


def probe_name(p: float) -> str:
    return f"p{p * 100:g}"


def quantiles(
    df: DataFrame, keys: list[str], value: str, probs: list[float], weight: str | None = None
) -> DataFrame:
    """Linearly interpolated percentiles, one row per group with a column ``p50`` for 0.5 and so on."""
    ranks = {}
    for p in probs:
        at = F.lit(p) * (F.col("n") - 1)
        ranks[f"{p}/low"], ranks[f"{p}/high"] = F.floor(at), F.ceil(at)
    found = order_statistics(df, keys, value, ranks, weight)
    cols = []
    for p in probs:
        low = F.max(F.when(F.col("probe") == f"{p}/low", F.col("value").cast("double")))
        high = F.max(F.when(F.col("probe") == f"{p}/high", F.col("value").cast("double")))
        at = F.lit(p) * (F.max("n") - 1)
        cols.append((low + (high - low) * (at - F.floor(at))).alias(probe_name(p)))
    return found.groupBy(*keys).agg(*cols)


def frequency_quantiles(
    freq: DataFrame, keys: list[str], value: str, count: str, probs: list[float], *others: Column
) -> DataFrame:
    """Interpolated percentiles from a table of ``(keys, value, count)``, next to ``others``, further
    aggregates over it. Rows with a NULL value are seen by ``others`` only.

    For values of small range such as sequence lengths: lengths that add up to N rows take at most
    about sqrt(2 N) different values, so a group's frequency table stays small.
    """
    group = Window.partitionBy(*keys)
    upto = group.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.when(F.col(value).isNotNull(), F.col(count))
    table = freq.withColumn("_upto", F.sum(known).over(upto)).withColumn("_n", F.sum(known).over(group))
    cols = []
    for p in probs:
        at = F.lit(p) * (F.col("_n") - 1)
        low = F.min(F.when(F.col("_upto") > F.floor(at), F.col(value).cast("double")))
        high = F.min(F.when(F.col("_upto") > F.ceil(at), F.col(value).cast("double")))
        part = F.max(at - F.floor(at))
        cols.append((low + (high - low) * part).alias(probe_name(p)))
    return table.groupBy(*keys).agg(*others, *cols)


def sketch_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], k: int = 400) -> DataFrame:
    """Percentiles from a KLL sketch: one pass, a few kilobytes per group, rank error below 1%."""
    sketch = df.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("_s"))
    return sketch.select(
        *keys, *[F.kll_sketch_get_quantile_double("_s", F.lit(p)).alias(probe_name(p)) for p in probs]
    )
