"""Profiling of files as they arrive.

The state is one row of mergeable statistics per column: exact moments and counts plus a KLL sketch for percentiles and
an HLL sketch for distinct values. Each micro-batch is aggregated by itself, merged with the state before it and
written under its batch id before the engine commits the batch. A batch that is run again after a stop starts from the
same older state and overwrites its own, so nothing is lost and nothing counts twice. The state of scalars and strings has
catalogue size; a new file costs one scan of it and no reading of older ones. Counts by value (ids) grow with the data and
are kept as levelled runs instead (``levelled.py``).
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.operators.order_stats import probe_name
from clickloom.operators.profile import column_kinds, finish_moments, merge_moments, named, numbered_form, string_long

PROBS = [0.5, 0.9, 0.99]
TOP_COUNTERS = 10_000
KLL_K = 400


def _measured(df: DataFrame, columns: list[str]) -> tuple[list[str], list[str]]:
    kinds = column_kinds(df.select(*columns))
    return [c for c in columns if kinds[c].startswith("scalar")], [c for c in columns if kinds[c] == "array"]


def measure_names(df: DataFrame, columns: list[str]) -> list[str]:
    """What ``measures`` profiles as a number: scalars under their name, array lengths under ``name#len`` and array
    elements under ``name#elem``."""
    scalars, arrays = _measured(df, columns)
    return [*scalars, *[f"{c}#len" for c in arrays], *[f"{c}#elem" for c in arrays]]


def measures(df: DataFrame, columns: list[str], key: str = "column") -> DataFrame:
    """``(column, value)`` rows of everything in ``measure_names``; with ``key`` ``_pos`` the place there instead of the name,
    which is cheaper to group by (``named`` looks the names up on what is left)."""
    scalars, arrays = _measured(df, columns)
    parts = []
    if scalars:
        parts.append(numbered_form(df, [F.col(c).cast("double") for c in scalars]))
    if arrays:
        n = len(scalars)
        sizes = numbered_form(df, [F.size(c).cast("double") for c in arrays])
        parts.append(sizes.select((F.col("_pos") + n).alias("_pos"), "value"))
        elements = numbered_form(df, [F.col(c).cast("array<double>") for c in arrays])
        parts.append(elements.select((F.col("_pos") + n + len(arrays)).alias("_pos"), F.explode("value").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out if key == "_pos" else named(out, measure_names(df, columns))


#: Exact sums are kept to this many decimals; a value of 10 ** (38 - EXACT_SCALE) or more makes its column's sum inexact.
EXACT_SCALE = 18
#: Values of up to this many decimals and ``EXACT_DIGITS`` digits are summed as whole numbers.
UNIT_SCALE = 4
EXACT_DIGITS = 15
LOW_BITS = 25


def _summands(rows: DataFrame) -> DataFrame:
    """The doubles of ``value`` as exact summands, each taken as its shortest decimal form.

    A double that equals a whole number of ``10 ** -UNIT_SCALE`` of at most 15 digits has that decimal as its shortest form,
    as no two decimals of 15 digits share a double. Such values add up as whole numbers, ``_high`` and ``_low``, two halves
    whose sums do not overflow below 10 ** 11 rows; only others are cast to decimals, which costs some ten times as much.
    """
    scale, v, whole = F.lit(10.0**UNIT_SCALE), F.col("value"), F.col("_whole")
    units = F.rint(v * scale)
    small = (units / scale == v) & (F.abs(units) < F.lit(10.0**EXACT_DIGITS))
    return rows.withColumn("_whole", F.when(small, units.cast("bigint"))).withColumns(
        {
            "_high": F.shiftright(whole, LOW_BITS),
            "_low": whole.bitwiseAND(F.lit(2**LOW_BITS - 1).cast("bigint")),
            "_other": F.when(v.isNotNull() & whole.isNull(), v.try_cast(f"decimal(38, {EXACT_SCALE})")),
        }
    )


def _exact_sum() -> Column:
    """The sum of what ``_summands`` gives; NULL where there is nothing to add and where it overflows."""
    wide = lambda c: F.try_sum(c).cast("decimal(20, 0)")
    fast = (wide("_high") * F.lit(Decimal(2**LOW_BITS)) + wide("_low")) * F.lit(Decimal(1).scaleb(-UNIT_SCALE))
    held = f"decimal(38, {EXACT_SCALE})"
    half = f"decimal(37, {EXACT_SCALE})"  # two of them add up without giving up a decimal
    fast, slow = fast.try_cast(held), F.try_sum("_other")
    both = F.coalesce(F.try_add(fast.try_cast(half), slow.try_cast(half)), F.try_add(fast, slow).try_cast(held))
    return F.when(F.count("_other") == 0, fast).when(F.count("_whole") == 0, slow).otherwise(both)


def profile_state(long: DataFrame, key: str = "column") -> DataFrame:
    """Mergeable state per column; works on static and on streaming rows.

    Beside the moments, ``sum`` adds the values as decimals of ``EXACT_SCALE`` places, so the mean of any number of batches
    is one division at the end; ``inexact`` counts values that such a decimal cannot hold (then the mean of the moments serves).
    """
    v = F.col("value")
    # what several aggregates read is worked out once per row, below the aggregation
    rows = _summands(long.select(key, F.when(~F.isnan(v), v).alias("value"))).withColumn("_hash", F.when(v.isNotNull(), F.xxhash64(v)))
    return rows.groupBy(key).agg(
        _exact_sum().alias("sum"),
        (F.count(v) - F.count("_whole") - F.count("_other")).alias("inexact"),
        F.count(F.lit(1)).alias("total"),
        F.count(v).alias("valid_count"),
        F.avg(v).alias("mean"),
        (F.coalesce(F.var_pop(v), F.lit(0.0)) * F.count(v)).alias("m2"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.kll_sketch_agg_double(v, F.lit(KLL_K)).alias("kll"),
        F.hll_sketch_agg("_hash").alias("hll"),
    )


def columns_state(df: DataFrame, columns: list[str]) -> DataFrame:
    """``profile_state`` of the ``measures`` of a table: rows group by a number, names are put on the state."""
    return named(profile_state(measures(df, columns, "_pos"), "_pos"), measure_names(df, columns))


def merge_states(*states: DataFrame) -> DataFrame:
    """Combine states computed apart, e.g. one per day or per cluster."""
    rows = states[0]
    for s in states[1:]:
        rows = rows.unionByName(s)
    sketches = [F.kll_merge_agg_double("kll").alias("kll"), F.hll_union_agg("hll").alias("hll")]
    sums = [F.try_sum("sum").alias("sum"), F.sum("inexact").alias("inexact")]
    return merge_moments(rows, extra=[*sketches, *sums])


def exact_mean(state: DataFrame) -> Column:
    """The mean from the exact sum, a decimal of ``EXACT_SCALE`` places (rounded half up); NULL where the sum is not exact."""
    n = F.col("valid_count").cast("decimal(20, 0)")
    return F.when((F.col("inexact") == 0) & F.col("sum").isNotNull() & (F.col("valid_count") > 0), F.col("sum") / n)


def finish(state: DataFrame, probs: list[float] = PROBS) -> DataFrame:
    """Statistics from a state: counts, range, mean and deviation exact, percentiles and distinct estimated."""
    held = F.col("valid_count") > 0
    distinct = F.when(held, F.hll_sketch_estimate("hll")).otherwise(F.lit(0)).alias("approx_distinct")
    quantiles = [
        F.when(held, F.kll_sketch_get_quantile_double("kll", F.lit(p))).alias(f"approx_{probe_name(p)}") for p in probs
    ]
    return finish_moments(state, extra=[distinct, *quantiles, exact_mean(state).alias("mean_exact")])


def string_state(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mergeable state of string columns: counts, distinct sketch, frequent-values sketch."""
    return (
        string_long(df, columns)
        .groupBy("column")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count("value").alias("valid_count"),
            F.hll_sketch_agg("value").alias("hll"),
            F.expr(f"approx_top_k_accumulate(value, {TOP_COUNTERS}) filter (where value is not null)").alias("top"),
        )
    )


def merge_string_states(*states: DataFrame) -> DataFrame:
    rows = states[0]
    for s in states[1:]:
        rows = rows.unionByName(s)
    return rows.groupBy("column").agg(
        F.sum("total").alias("total"),
        F.sum("valid_count").alias("valid_count"),
        F.hll_union_agg("hll").alias("hll"),
        F.expr(f"approx_top_k_combine(top, {TOP_COUNTERS})").alias("top"),
    )


def count_state(df: DataFrame, keys: list[str], count: str = "count", most: list[str] = []) -> DataFrame:
    """Exact mergeable counts: labels, lengths per domain, ids per field. ``df`` holds rows or counts of earlier ones."""
    n = F.sum(count) if count in df.columns else F.count(F.lit(1))
    return df.groupBy(*keys).agg(n.alias("count"), *[F.max(c).alias(c) for c in most])


def finish_strings(state: DataFrame, k: int = 20) -> DataFrame:
    return state.select(
        "column",
        "total",
        (F.col("total") - F.col("valid_count")).alias("null_count"),
        F.hll_sketch_estimate("hll").alias("approx_unique"),
        F.expr(f"approx_top_k_estimate(top, {k})").alias("approx_top"),
    )


def stream_files(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1, glob: str | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def run_profile(
    stream: DataFrame,
    where: str,
    state: Callable[[DataFrame], DataFrame],
    merge: Callable[..., DataFrame] = merge_states,
) -> DataFrame:
    """Process all files not seen yet and return the current state.

    ``stream`` is read by ``stream_files``; ``state`` turns a batch of its rows into mergeable state and ``merge`` combines two;
    ``where`` is a folder that all executors reach. It keeps the checkpoint and the states, so calling this again adds new
    files only. A stop at any point loses nothing: the state of a batch is written before the batch is committed, and a
    repeated batch starts from the state of the batches below it.
    """
    spark = stream.sparkSession
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    root = jvm_path(f"{where}/states")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())

    def done() -> list[int]:
        """Batches whose state is complete."""
        if not fs.exists(root):
            return []
        names = [f.getPath() for f in fs.listStatus(root)]
        return sorted(int(p.getName().split("=")[1]) for p in names if fs.exists(jvm_path(f"{p}/_SUCCESS")))

    def absorb(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        new = state(batch)
        older = [b for b in done() if b < batch_id]
        if older:
            new = merge(session.read.parquet(f"{where}/states/batch={older[-1]}"), new)
        new.write.mode("overwrite").parquet(f"{where}/states/batch={batch_id}")
        # a repeated batch needs the one below it, nothing needs older ones
        for b in older[:-1]:
            fs.delete(jvm_path(f"{where}/states/batch={b}"), True)

    query = (
        stream.writeStream.foreachBatch(absorb)
        .option("checkpointLocation", f"{where}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    batches = done()
    if not batches:
        raise ValueError("no file has been read yet")
    return spark.read.parquet(f"{where}/states/batch={batches[-1]}")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def native_profile(stream: DataFrame, where: str, columns: list[str]) -> DataFrame:
    """The profile of ``columns`` as a streaming aggregation that Spark keeps in its state store.

    Spark holds one state row per column (moments, the exact sum, a KLL and an HLL sketch) and updates it with each
    micro-batch; the complete result of each epoch is written under its epoch id by the sink, and the newest complete
    epoch is read back. The state store is RocksDB unless the session names another provider. A stop at any point resumes
    from the engine's checkpoint under ``where``; an epoch that is run again rewrites its own folder.
    """
    spark = stream.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    if not spark.conf.get(key, None):
        spark.conf.set(key, ROCKSDB)
    state = columns_state(stream, columns)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    root = jvm_path(f"{where}/epochs")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())

    def sink(result: DataFrame, epoch: int) -> None:
        result.write.mode("overwrite").parquet(f"{where}/epochs/epoch={epoch}")

    query = (
        state.writeStream.outputMode("complete")
        .foreachBatch(sink)
        .option("checkpointLocation", f"{where}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    done = [] if not fs.exists(root) else sorted(
        int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(root) if fs.exists(jvm_path(f"{s.getPath()}/_SUCCESS"))
    )
    if not done:
        raise ValueError("no file has been read yet")
    return spark.read.parquet(f"{where}/epochs/epoch={done[-1]}")


#: Theta sketches keep about 2 ** THETA_LG hashes; up to that many distinct ids they are exact.
THETA_LG = 12


def overlap_state(ids: DataFrame, domain: str = "domain", item: str = "id") -> DataFrame:
    """One theta sketch of the ids above 0 of each domain: the mergeable state of domain overlap."""
    return ids.filter(F.col(item) > 0).groupBy(domain).agg(F.theta_sketch_agg(item, THETA_LG).alias("theta"))


def merge_overlap_states(*states: DataFrame, domain: str = "domain") -> DataFrame:
    rows = states[0]
    for s in states[1:]:
        rows = rows.unionByName(s)
    return rows.groupBy(domain).agg(F.theta_union_agg("theta", THETA_LG).alias("theta"))


def _spread(estimate: Column, union: Column) -> Column:
    """Three standard deviations of a theta estimate (of a set within a union of ``union``), 0 while sketches are exact.

    A sketch in estimation mode keeps each hash with probability theta of about ``2 ** THETA_LG / union``, so the estimate
    ``kept / theta`` has a deviation of at most ``sqrt(estimate * union / 2 ** THETA_LG)``.
    """
    k = F.lit(float(2**THETA_LG))
    return F.when(union < k, F.lit(0.0)).otherwise(F.lit(3.0) * F.sqrt(estimate * union / k) + F.lit(1.0))


def finish_overlap(state: DataFrame, domains: list[str], domain: str = "domain") -> DataFrame:
    """Estimated distinct ids of every pair of domains and their overlap, each with the half-width of its interval.

    ``state`` has one row per domain, so the pairs are a join of two rows at a time; domains without ids count 0.
    """
    spark = state.sparkSession
    pairs = spark.createDataFrame([(a, b) for i, a in enumerate(domains) for b in domains[i + 1 :]], "domain_a string, domain_b string")
    side = lambda name, col: F.broadcast(state.select(F.col(domain).alias(name), F.col("theta").alias(col)))
    both = pairs.join(side("domain_a", "ta"), "domain_a", "left").join(side("domain_b", "tb"), "domain_b", "left")
    est = lambda c: F.coalesce(F.theta_sketch_estimate(c), F.lit(0.0))
    a, b = est(F.col("ta")), est(F.col("tb"))
    both_present = F.col("ta").isNotNull() & F.col("tb").isNotNull()
    union = F.when(both_present, est(F.theta_union("ta", "tb", THETA_LG))).otherwise(F.greatest(a, b))
    overlap = F.when(both_present, est(F.theta_intersection("ta", "tb"))).otherwise(F.lit(0.0))
    return both.select(
        "domain_a", "domain_b", a.alias("unique_a"), _spread(a, a).alias("unique_a_spread"), b.alias("unique_b"),
        _spread(b, b).alias("unique_b_spread"), overlap.alias("overlap"), _spread(overlap, union).alias("overlap_spread"),
    )


#: A column takes part in correlations if present in more than this share of rows (as in ``correlations``).
CORR_PRESENT = 0.2


def comoment_state(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mergeable co-moments: a row per pair of columns over rows where both are present (not NULL, NaN or 0) and a row per
    column (``col_b`` NULL) with its presence.

    ``total`` rows, ``n`` rows counted, means ``mx``, ``my`` and the sums of products of deviations ``cxy``, ``mxx``, ``myy``,
    each from Spark's own one-pass aggregates over values less a pivot per column (one small job finds the pivots).
    """
    def present(c: str) -> Column:
        v = F.col(c).cast("double")
        return F.when((v != 0) & ~F.isnan(v), v)

    # values are taken less a pivot per column (the batch's mean): products of deviations keep their digits near 1.7e9
    pivots = df.agg(*[F.coalesce(F.avg(present(c)), F.lit(0.0)) for c in columns]).first() if columns else []
    shifted = [present(c) - F.lit(float(p)) for c, p in zip(columns, pivots, strict=True)]

    # a row is exploded into the numbers of its pairs only; values are looked up by place, so that rows group by one int
    # and carry no names
    ends = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))] + [(i, i) for i in range(len(columns))]
    first, last = F.array(*[F.lit(i) for i, _ in ends]), F.array(*[F.lit(j) for _, j in ends])
    long = df.select(F.array(*shifted).alias("_v")).select("_v", F.explode(F.array(*[F.lit(k) for k in range(len(ends))])).alias("_pair"))
    long = long.select("_pair", F.get("_v", F.get(first, F.col("_pair"))).alias("_x"), F.get("_v", F.get(last, F.col("_pair"))).alias("_y"))
    both = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    x, y = F.when(both, F.col("_x")), F.when(both, F.col("_y"))
    n = F.count(x)
    sums = long.groupBy("_pair").agg(
        F.count(F.lit(1)).alias("total"), n.alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"),
        (F.coalesce(F.covar_pop(x, y), F.lit(0.0)) * n).alias("cxy"),
        (F.coalesce(F.var_pop(x), F.lit(0.0)) * n).alias("mxx"), (F.coalesce(F.var_pop(y), F.lit(0.0)) * n).alias("myy"),
    )

    def of_pair(values: list, kind: str) -> Column:
        return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("_pair"))

    return sums.select(
        of_pair([columns[i] for i, _ in ends], "string").alias("col_a"), of_pair([columns[j] if i != j else None for i, j in ends], "string").alias("col_b"),
        "total", "n", (F.col("mx") + of_pair([float(pivots[i]) for i, _ in ends], "double")).alias("mx"),
        (F.col("my") + of_pair([float(pivots[j]) for _, j in ends], "double")).alias("my"), "cxy", "mxx", "myy",
    )


def merge_comoments(*states: DataFrame) -> DataFrame:
    """Co-moments of all rows from those of disjoint parts: deviations are moved to the common means, few rows per pair."""
    rows = states[0]
    for s in states[1:]:
        rows = rows.unionByName(s)
    keys = ["col_a", "col_b"]
    group = Window.partitionBy(*keys)
    n = F.sum("n").over(group)
    mean = lambda m: F.when(n > 0, F.sum(F.coalesce(F.col(m), F.lit(0.0)) * F.col("n")).over(group) / n)
    moved = rows.withColumn("_mx", mean("mx")).withColumn("_my", mean("my"))
    dx = F.coalesce(F.col("mx") - F.col("_mx"), F.lit(0.0))
    dy = F.coalesce(F.col("my") - F.col("_my"), F.lit(0.0))
    return moved.groupBy(*keys).agg(
        F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("_mx").alias("mx"), F.max("_my").alias("my"),
        F.sum(F.col("cxy") + F.col("n") * dx * dy).alias("cxy"),
        F.sum(F.col("mxx") + F.col("n") * dx * dx).alias("mxx"), F.sum(F.col("myy") + F.col("n") * dy * dy).alias("myy"),
    )


def finish_correlations(state: DataFrame) -> DataFrame:
    """``col_a, col_b, n, pearson`` of pairs whose columns are both present in more than ``CORR_PRESENT`` of rows; pairs
    with fewer than two rows or a constant side have no r. A column never present has no rows at all."""
    share = state.filter(F.col("col_b").isNull()).select(
        F.col("col_a").alias("_c"), (F.col("n") > F.col("total") * F.lit(CORR_PRESENT)).alias("_kept")
    )
    kept = F.broadcast(share.filter("_kept").select("_c"))  # one row per column
    pairs = state.filter(F.col("col_b").isNotNull())
    pairs = pairs.join(kept, pairs["col_a"] == kept["_c"], "left_semi").join(kept, pairs["col_b"] == kept["_c"], "left_semi")
    r = F.col("cxy") / F.sqrt(F.col("mxx") * F.col("myy"))
    # what rounding leaves of a constant column (a deviation below 1e-12 of the mean) is no variance
    varies = lambda m, mean: F.col(m) > F.col("n") * F.pow(F.lit(1e-12) * F.col(mean), 2)
    ok = (F.col("n") > 1) & (F.col("mxx") > 0) & (F.col("myy") > 0) & varies("mxx", "mx") & varies("myy", "my")
    return pairs.filter(ok).select("col_a", "col_b", F.col("n").cast("bigint").alias("n"), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r)).alias("pearson"))


def bottom_k(rows: DataFrame, ids: list[str], k: int, seed: int = 42) -> DataFrame:
    """The ``k`` rows least by the hash of their id (``_h``), then by id, then by a digest of the whole row: a uniform
    sample of exactly ``k`` rows (all, if fewer) that is its own mergeable state.

    Merging is the same call on the union of two samples, so the sample of any number of files in any order equals the
    sample of all rows at once. Each task keeps ``k`` rows at most before they meet in one.
    """
    from clickloom.operators.splits import hash_key

    data = [c for c in rows.columns if c != "_h"]
    keyed = rows if "_h" in rows.columns else rows.withColumn("_h", hash_key(ids, seed))
    whole = F.md5(F.to_json(F.struct(*[F.col(c) for c in data])))
    return keyed.withColumn("_row", whole).orderBy("_h", *ids, "_row").limit(k).drop("_row")


def rank_error(k: int = KLL_K) -> float:
    """Normalised rank error (99 % confidence, both sides) of a KLL sketch of parameter ``k``: the published fit
    ``2.296 / k ** 0.9723``."""
    return 2.296 / k**0.9723


def outlier_estimates(state: DataFrame, whisker: float = 1.5) -> DataFrame:
    """Outliers by the IQR rule from a profile state alone, without a second scan of the data.

    Fences are ``q1 - whisker * iqr`` and ``q3 + whisker * iqr`` of the sketch's quartiles; values below the lower fence
    are about ``rank(lower) * n``, above the upper ``(1 - rank(upper)) * n``, each within ``spread`` (``rank_error() * n``
    plus one) of the truth. The sketch takes its points as constants, so the fences (one row per column) are read first.
    Columns without values give no row.
    """
    kll = F.col("kll")
    q1, q3 = F.kll_sketch_get_quantile_double(kll, F.lit(0.25)), F.kll_sketch_get_quantile_double(kll, F.lit(0.75))
    fenced = state.filter(F.col("valid_count") > 0).select(
        "column", F.col("valid_count").alias("n"), "kll", (q1 - F.lit(whisker) * (q3 - q1)).alias("lower"), (q3 + F.lit(whisker) * (q3 - q1)).alias("upper")
    )
    fences = fenced.select("column", "lower", "upper").collect()  # one row per column
    if not fences:
        return fenced.select("column", "n", "lower", "upper", *[F.lit(0.0).alias(c) for c in ("below", "above", "spread")])
    n = F.col("n")

    def at(point: str):
        out = F.lit(None).cast("double")
        for r in fences:
            out = F.when(F.col("column") == F.lit(r["column"]), F.kll_sketch_get_rank_double(kll, F.lit(float(r[point])))).otherwise(out)
        return out

    # a rank counts the values at or below its point
    return fenced.select(
        "column", "n", "lower", "upper", (at("lower") * n).alias("below"), ((F.lit(1.0) - at("upper")) * n).alias("above"),
        (F.lit(rank_error()) * n + F.lit(1.0)).alias("spread"),
    )
