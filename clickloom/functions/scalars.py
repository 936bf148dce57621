"""Scalar column builders: labels, cleaning, vocabulary limits, time buckets, losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper edges of the time-since-event buckets, in seconds.
TIME_EDGES = [
    30, 60, 120, 300,
    600, 900, 1200, 1800, 2700, 3600,
    5400, 7200, 10800, 14400, 21600, 32400, 43200, 86400,
    172800, 259200, 345600, 432000, 518400, 604800,
    1209600, 1814400, 2592000,
    5184000, 7776000, 15552000, 31536000,
    63072000,
]

# The finer set of edges, in seconds.
FINE_TIME_EDGES = [
    5, 10, 15, 20, 25, 30, 35, 40, 45, 50, 55, 60,
    120, 180, 240, 300, 360, 420, 480, 540, 600,
    900, 1200, 1500, 1800, 2100, 2400, 2700, 3000, 3300, 3600,
    5400, 7200, 9000, 10800, 12600, 14400, 16200, 18000, 19800, 21600,
    32400, 43200, 54000, 64800, 75600, 86400,
    172800, 259200, 345600, 432000, 518400, 604800,
    1123200, 1641600, 2160000, 2592000,
    4320000, 6048000, 7776000,
    11664000, 15552000,
    31536000,
]

# The span of plausible event times, 2020-01-01 to 2030-01-01 in Unix seconds.
TS_RANGE = (1577836800, 1893456000)


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def binary_label(c: Column | str, positive: int = 2, is_training: bool = True) -> Column:
    """1 where the label type is the positive one, else 0; NULL counts as 0. Scoring mode: always 0."""
    if not is_training:
        return F.lit(0).cast("bigint")
    return F.when(as_col(c) == positive, 1).otherwise(0).cast("bigint")


def clean_id(c: Column | str) -> Column:
    """NULL, zero and negative ids become the padding id 0."""
    c = as_col(c)
    return F.when(c > 0, c).otherwise(F.lit(0)).cast("bigint")


def limit_vocab(c: Column | str, vocab: int, strict: bool = False, name: str = "") -> Column:
    """Ids at or above ``vocab`` become 0, or fail the job when ``strict``; ``vocab <= 0`` gives 0."""
    c = as_col(c)
    if vocab <= 0:
        return F.lit(0).cast("bigint")
    if strict:
        message = F.concat(F.lit(f"{name}: value "), c.cast("string"), F.lit(f" is outside [0, {vocab})"))
        return F.when(c >= vocab, F.raise_error(message).cast("bigint")).otherwise(c)
    return F.when(c >= vocab, F.lit(0).cast("bigint")).otherwise(c)


def fill_missing(df: DataFrame, columns: list[str], value: int = -1) -> DataFrame:
    return df.fillna(value, subset=columns)


def _bucket_tree(diff: Column, edges: list[int], low: int, high: int) -> Column:
    # the number of edges below diff, known to lie in [low, high], by halving
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(diff <= edges[mid], _bucket_tree(diff, edges, low, mid)).otherwise(
        _bucket_tree(diff, edges, mid + 1, high)
    )


def time_bucket(request_ts: Column | str, event_ts: Column | str, edges: list[int] = TIME_EDGES) -> Column:
    """Bucket 1..len(edges) of the seconds between event and request; 0 for a missing event time.

    Events after the request fall in bucket 1, those beyond the last edge in the last bucket. The
    search is a tree of comparisons, so one value costs about log2(len(edges)) of them.
    """
    event = as_col(event_ts)
    diff = F.greatest(as_col(request_ts) - event, F.lit(0))
    found = _bucket_tree(diff, edges, 0, len(edges) - 1) + 1
    return F.when(event > 0, found).otherwise(F.lit(0)).cast("int")


def virtual_id(value: Column | str, base: int, slots: int, hashed: bool = True) -> Column:
    """Map a positive id into its feature's own id range; missing ids stay 0.

    ``hashed`` wraps ids around ``slots``; otherwise ids are limited to ``1..slots-1`` (vocabulary mode).
    """
    v = as_col(value)
    if hashed:
        inner = F.least(F.greatest(v % slots + 1, F.lit(1)), F.lit(slots))
    else:
        inner = F.least(F.greatest(v, F.lit(1)), F.lit(slots - 1))
    return F.when(v > 0, F.lit(base) + inner).otherwise(F.lit(0)).cast("bigint")


def in_time_range(v: Column | str) -> Column:
    return as_col(v).between(*TS_RANGE)


def sigmoid(z: Column | str) -> Column:
    """Logistic function, written so that neither tail overflows."""
    z = as_col(z)
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def log_loss_term(z: Column | str, y: Column | str) -> Column:
    """Cross entropy of one row from its logit."""
    z, y = as_col(z), as_col(y).cast("double")
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))


def focal_loss_term(z: Column | str, y: Column | str, alpha: float = 0.1, gamma: float = 2.0) -> Column:
    """Cross entropy weighted down for rows the score already gets right."""
    y = as_col(y)
    p = sigmoid(z)
    hit, weight = F.when(y == 1, p).otherwise(1 - p), F.when(y == 1, alpha).otherwise(1 - alpha)
    return weight * F.pow(1 - hit, F.lit(float(gamma))) * log_loss_term(z, y)
