"""Array column builders for sequences that already sit inside one row.

A lambda over array elements is interpreted, one call per element; ``array_min``, ``array_max`` and
``array_contains`` are compiled loops. Where those can show that an array needs no work, the builders
return it as it is and keep the lambda for the others. ``array_contains`` gives NULL for an array with
NULL elements, which sends it to the lambda too.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from clickloom.functions.scalars import TIME_EDGES, as_col, limit_vocab, time_bucket


def empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _fill(head: Column, missing: Column, zero: Column) -> Column:
    return F.concat(head, F.array_repeat(zero, missing))


def pad_int(c: Column | str, n: int, vocab: int | None = None, strict: bool = False, name: str = "") -> Column:
    """The first ``n`` ids, non-positive ones as 0, filled with 0 to exactly ``n``; NULL is all 0.

    With ``vocab``, ids at or above it become 0 too, or fail the job when ``strict``.
    """
    zero = F.lit(0).cast("bigint")
    if vocab is not None and vocab <= 0:
        return F.array_repeat(zero, n)
    raw = F.coalesce(as_col(c).cast("array<bigint>"), empty("bigint"))
    clean = (F.array_min(raw) > 0) & ~F.array_contains(raw, zero)
    if vocab is not None:
        clean = clean & (F.array_max(raw) < vocab)

    def fix(e: Column) -> Column:
        if vocab is None:
            return F.greatest(e, zero)
        if strict:
            return limit_vocab(F.greatest(e, zero), vocab, strict, name)
        return F.when((e > 0) & (e < vocab), e).otherwise(zero)

    head = F.slice(raw, 1, n)
    return _fill(F.when(clean, head).otherwise(F.transform(head, fix)), _missing(raw, n), zero)


def _missing(raw: Column, n: int) -> Column:
    return F.greatest(F.lit(n) - F.size(raw), F.lit(0))


def pad_float(c: Column | str, n: int) -> Column:
    """The first ``n`` values filled with 0.0 to exactly ``n``; signs are kept, NULL elements are 0.0."""
    zero = F.lit(0).cast("float")
    raw = F.coalesce(as_col(c).cast("array<float>"), empty("float"))
    head = F.slice(raw, 1, n)
    # true or false unless there are NULL elements
    whole = F.array_contains(raw, zero).isNotNull()
    fixed = F.when(whole, head).otherwise(F.transform(head, lambda e: F.coalesce(e, zero)))
    return _fill(fixed, _missing(raw, n), zero)


def head_length(c: Column | str, n: int) -> Column:
    """Stored length limited to ``n``; counts every element, NULL array is 0."""
    return F.least(F.coalesce(F.size(as_col(c)), F.lit(0)), F.lit(n))


def valid_length(c: Column | str) -> Column:
    """How many elements are above 0; NULL array is 0."""
    c = as_col(c)
    all_valid = (F.array_min(c) > 0) & ~F.array_contains(c, F.lit(0))
    return F.coalesce(F.when(all_valid, F.size(c)).otherwise(F.size(F.filter(c, lambda e: e > 0))), F.lit(0))


def nonzero_count(c: Column | str) -> Column:
    """How many elements differ from 0 (negatives count); NULL array is 0."""
    return F.coalesce(F.size(active_items(c)), F.lit(0))


def active_items(c: Column | str) -> Column:
    """The elements other than 0."""
    c = as_col(c)
    return F.when(~F.array_contains(c, F.lit(0)), c).otherwise(F.filter(c, lambda e: e != 0))


def has_valid(c: Column | str) -> Column:
    """Whether any element is above 0."""
    return F.coalesce(F.array_max(as_col(c)) > 0, F.lit(False))


def last_k(c: Column | str, k: int) -> Column:
    """The last ``k`` elements of an array kept in time order; all of them when it is shorter."""
    c = as_col(c)
    return F.slice(c, F.greatest(F.size(c) - k + 1, F.lit(1)), F.lit(k))


def time_bucket_array(request_ts: Column | str, c: Column | str, n: int, edges: list[int] = TIME_EDGES) -> Column:
    """Time buckets of the first ``n`` event times, filled with 0 to exactly ``n``."""
    return F.transform(pad_int(c, n), lambda e: time_bucket(request_ts, e, edges))


def flat_vector(parts: list[Column]) -> Column:
    """Parts side by side in the given order."""
    return F.concat(*parts)


def chunk_shape(length: int, n: int) -> tuple[int, int]:
    """Chunk size and padding that split ``length`` values into ``n`` equal chunks."""
    size = math.ceil(length / n)
    return size, size * n - length


def chunk_split(c: Column | str, length: int, n: int) -> Column:
    """Fill with 0.0 to a multiple of ``n`` and cut into ``n`` equal chunks."""
    size, fill = chunk_shape(length, n)
    full = F.concat(as_col(c).cast("array<double>"), F.array_repeat(F.lit(0.0), fill))
    return F.array(*[F.slice(full, i * size + 1, size) for i in range(n)])


def aligned_pairs(ids: Column | str, weights: Column | str) -> Column:
    """Zip ids with weights by position; the shorter side is filled with NULL."""
    return F.arrays_zip(as_col(ids).alias("id"), as_col(weights).alias("weight"))


def sizes_differ(ids: Column | str, weights: Column | str) -> Column:
    return F.coalesce(F.size(as_col(ids)), F.lit(0)) != F.coalesce(F.size(as_col(weights)), F.lit(0))


def dot(a: Column | str, b: Column | str, dim: int) -> Column:
    """Dot product with the terms added in position order.

    Written out per position: whole-stage codegen covers it, a higher-order aggregate would not.
    """
    a, b = as_col(a), as_col(b)
    terms = [F.get(a, F.lit(i)).cast("double") * F.get(b, F.lit(i)).cast("double") for i in range(dim)]
    return reduce(lambda x, y: x + y, terms)


def zero_vector(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)
