"""Operators on behaviour histories kept as one row per event.

Histories are limited before anything is gathered per user: the rank filter turns into a group limit
below the shuffle, so a user who holds a third of all events sends at most ``k`` rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions import arrays as A

# Spark only plans the limit below the shuffle up to this many rows per group (its own default);
# longer histories are limited per salted part of the group first.
GROUP_LIMIT = 1000
SALT_PARTS = 64
PADDING_KEYS = 1024


def latest_per_group(
    events: DataFrame, keys: list[str], order: list[str], k: int, rank: str = "recency"
) -> DataFrame:
    """The ``k`` latest rows per group with their rank, 1 being the latest. ``order`` must be unique in a group."""
    newest_first = [F.desc(c) for c in order]
    if k > GROUP_LIMIT:
        salt = F.pmod(F.xxhash64(*order), F.lit(SALT_PARTS))
        part = Window.partitionBy(*keys, "_salt").orderBy(*newest_first)
        events = (
            events.withColumn("_salt", salt)
            .withColumn("_r", F.row_number().over(part))
            .filter(F.col("_r") <= k)
            .drop("_salt", "_r")
        )
    w = Window.partitionBy(*keys).orderBy(*newest_first)
    return events.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def history_arrays(
    events: DataFrame,
    user: str,
    domain: str,
    domains: list[str],
    order: list[str],
    values: list[str],
    k: int | None = None,
) -> DataFrame:
    """One row per user with, per domain, arrays ``{domain}_{value}`` of its latest ``k`` events, oldest first.

    Without ``k`` all events are gathered, for keys that bound them, such as user and day.

    The arrays of a domain are aligned by position; domains a user lacks have empty arrays.
    """
    recent = latest_per_group(events, [user, domain], order, k, "_recency") if k else events
    fields = list(dict.fromkeys([*order, *values]))
    per_domain = [
        F.sort_array(F.collect_list(F.when(F.col(domain) == d, F.struct(*fields)))).alias(f"_h{i}")
        for i, d in enumerate(domains)
    ]
    gathered = recent.groupBy(user).agg(*per_domain)
    arrays = [F.col(f"_h{i}")[v].alias(f"{d}_{v}") for i, d in enumerate(domains) for v in values]
    return gathered.select(user, *arrays)


def lookup_vectors(
    rows: DataFrame, vectors: DataFrame, item: str, dim: int, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """Add ``vector`` to every row; padding ids (<= 0) and ids without a vector get the zero vector.

    Of several vectors with one id the largest in array order counts, so rows are never multiplied.

    A plain equi-join: the optimizer broadcasts a small vector table and splits skewed items of a
    large one at run time. Padding rows match nothing, so they join under spread negative keys
    instead of meeting in one partition.
    """
    table = (
        vectors.filter(F.col(vec_id) > 0)
        .select(F.col(vec_id).cast("bigint").alias("_key"), F.col(vector).cast("array<double>").alias("_vec"))
        .groupBy("_key")
        .agg(F.max("_vec").alias("_vec"))
    )
    spread = -1 - F.pmod(F.xxhash64(*rows.columns), F.lit(PADDING_KEYS))
    key = F.when(F.col(item) > 0, F.col(item)).otherwise(spread).cast("bigint")
    return (
        rows.withColumn("_key", key)
        .join(table, "_key", "left")
        .withColumn("vector", F.coalesce("_vec", A.zero_vector(dim)))
        .drop("_key", "_vec")
    )


def mean_pool(
    rows: DataFrame,
    keys: list[str],
    vectors: DataFrame,
    item: str,
    dim: int,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """Mean vector of the ids above 0 per group and their number; the zero vector where there are none.

    Repeated items are counted before the vectors join, so a long history is moved as its different
    items only. Vectors of moderate width are summed position by position, which compiles into one hash
    aggregation; wider ones go through the summarizer of Spark's ML library. Both combine on the map side.
    """
    counts = rows.groupBy(*keys, F.when(F.col(item) > 0, F.col(item)).alias("_item")).agg(
        F.count(F.lit(1)).cast("double").alias("_n")
    )
    weighted = lookup_vectors(counts, vectors, "_item", dim, vec_id, vector).withColumn(
        "_n", F.when(F.col("_item").isNull(), F.lit(0.0)).otherwise(F.col("_n"))
    )
    sums = [F.sum(F.col("_n") * F.get("vector", F.lit(i))).alias(f"_s{i}") for i in range(dim)]
    pooled = weighted.groupBy(*keys).agg(F.sum("_n").alias("_total"), *sums)
    mean = F.array(*[F.coalesce(F.col(f"_s{i}"), F.lit(0.0)) / F.greatest("_total", F.lit(1.0)) for i in range(dim)])
    return pooled.select(*keys, F.col("_total").cast("bigint").alias("n_valid"), mean.alias("vector"))


def target_top_k(
    events: DataFrame,
    targets: DataFrame,
    vectors: DataFrame,
    key: str,
    order: list[str],
    item: str,
    dim: int,
    pre_k: int = 256,
    k: int = 64,
) -> DataFrame:
    """Two-stage selection: the latest ``pre_k`` items per user, of these the ``k`` nearest to the target.

    ``targets`` holds one ``(key, vector)`` per user; users without one are scored against the zero
    vector. Gives ``score`` (dot product), ``rank`` (ties: latest first) and ``weight``, the softmax of
    the scores kept, which adds up to 1 per user.

    The limit comes before any vector moves. Items meet their vectors first, so the one shuffle that
    carries vectors is by user and serves the target join and both windows.
    """
    valid = events.filter(F.col(item) > 0)
    recent = latest_per_group(valid, [key], order, pre_k).select(key, item, "recency", *order)
    scored = (
        lookup_vectors(recent, vectors, item, dim)
        .join(targets.select(key, F.col("vector").alias("_target")), key, "left")
        .withColumn("score", A.dot("vector", F.coalesce("_target", A.zero_vector(dim)), dim))
        .drop("vector", "_target")
    )
    best = Window.partitionBy(key).orderBy(F.desc("score"), "recency")
    kept = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return softmax_weights(kept, [key], "score")


def softmax_weights(rows: DataFrame, keys: list[str], score: str, name: str = "weight") -> DataFrame:
    """Softmax of ``score`` within each group, shifted by the group's maximum."""
    group = Window.partitionBy(*keys)
    return (
        rows.withColumn("_top", F.max(score).over(group))
        .withColumn("_e", F.exp(F.col(score) - F.col("_top")))
        .withColumn(name, F.col("_e") / F.sum("_e").over(group))
        .drop("_top", "_e")
    )


def unified_timeline(features: DataFrame, events: DataFrame, user: str, domains: list[str]) -> DataFrame:
    """Feature tokens followed by each domain's events as one token table ``(user, segment, pos, token, bucket)``.

    ``features`` holds ``(user, pos, token)``, ``events`` ``(user, domain, pos, token, bucket)``. Segment 0
    is the features, segment i the i-th domain. Rows are not sorted globally; order by
    ``(segment, pos)`` within a user where a sequence is needed.
    """
    segment = F.create_map(*[F.lit(x) for i, d in enumerate(domains) for x in (d, i + 1)])
    head = features.select(
        user, F.lit(0).alias("segment"), F.col("pos").cast("bigint").alias("pos"),
        F.col("token").cast("bigint").alias("token"), F.lit(0).alias("bucket"),
    )
    tail = events.filter(F.col("domain").isin(domains)).select(
        user, segment[F.col("domain")].alias("segment"), F.col("pos").cast("bigint").alias("pos"),
        F.col("token").cast("bigint").alias("token"), F.col("bucket").cast("int").alias("bucket"),
    )
    return head.unionByName(tail)


def explode_pairs(df: DataFrame, keys: list[str], ids: str, weights: str) -> DataFrame:
    """Aligned id and weight arrays as rows ``(keys, pos, id, weight)``."""
    return df.select(*keys, F.posexplode(A.aligned_pairs(ids, weights)).alias("pos", "_p")).select(
        *keys, "pos", F.col("_p.id").alias("id"), F.col("_p.weight").alias("weight")
    )


def misaligned_rows(df: DataFrame, ids: str, weights: str) -> DataFrame:
    """Rows whose id and weight arrays differ in length."""
    return df.filter(A.sizes_differ(ids, weights))


def explode_positions(df: DataFrame, keys: list[str], array: Column | str, name: str = "value") -> DataFrame:
    """Array elements as rows with their 0-based position."""
    return df.select(*keys, F.posexplode(array).alias("pos", name))
