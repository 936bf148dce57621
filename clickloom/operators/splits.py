"""Splits, exact samples and shuffles that neither sort the table nor number its rows.

A split point is found as an exact order statistic (see ``order_stats``), brought to the driver as one
value and applied as a filter. Every row has a place: NULL sorts first and NaN last, rows with equal keys are told apart by a
hash of all their columns, and rows that are equal in every column are shared out by number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.operators.order_stats import order_statistics

FILE, ROW = "_file", "_row"


def split_sizes(n: int, valid_ratio: float, train_ratio: float = 1.0) -> tuple[int, int]:
    """Rows of the train prefix and of the validation tail out of ``n``."""
    valid = max(1, int(n * valid_ratio))
    train = n - valid
    if train_ratio < 1.0:
        train = max(1, int(train * train_ratio))
    return train, valid


def row_at(df: DataFrame, order: list[str], rank: int) -> tuple | None:
    """The order columns of the row at a 0-based rank of the lexicographic order; None past the end."""
    values: list = []
    for i, c in enumerate(order):
        found = order_statistics(df, [], c, {"at": F.lit(rank)}).collect()
        if not found:
            return None
        value = found[0]["value"]
        values.append(value)
        rest = order[i + 1 :]
        if rest:
            same = F.col(c) == F.lit(value)
            seen = df.agg(
                F.count_if(F.col(c) < F.lit(value)).alias("_below"),
                F.count_if(same).alias("_same"),
                *[F.min(F.when(same, F.col(r))).alias(f"_{r}") for r in rest],
            ).first()
            if seen["_same"] == 1:
                return (*values, *[seen[f"_{r}"] for r in rest])
            rank -= seen["_below"]
            df = df.filter(same)
    return tuple(values)


def before(order: list[str], point: tuple | None) -> Column:
    """Rows that sort before ``point``; all rows if it is None."""
    if point is None:
        return F.lit(True)
    cond = F.lit(False)
    for c, v in reversed(list(zip(order, point))):
        cond = (F.col(c) < F.lit(v)) | ((F.col(c) == F.lit(v)) & cond)
    return cond


def _placed(df: DataFrame, order: list[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with numeric sort columns that are never NULL or NaN, the last a hash of the whole row."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    odd = [c for c in order if not isinstance(kinds[c], T.NumericType)]
    if odd:
        raise TypeError(f"order columns must be numeric: {', '.join(odd)}")
    columns: dict[str, Column] = {}
    for i, c in enumerate(order):
        bad = F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
        columns[f"_class{i}"] = F.when(F.col(c).isNull(), 0).when(bad, 2).otherwise(1)
        columns[f"_place{i}"] = F.when(bad, F.lit(0)).otherwise(F.col(c))
    # maps and variants cannot be hashed as they are: their JSON stands for them, so rows that differ there never tie
    whole = [F.to_json(F.struct(F.col(c))) if _has_map(kinds[c]) else F.col(c) for c in df.columns]
    columns["_tie"] = F.xxhash64(*whole) if whole else F.lit(0).cast("bigint")
    return df.select("*", *[c.alias(n) for n, c in columns.items()]), list(columns)


def _has_map(kind: T.DataType) -> bool:
    return "map<" in kind.simpleString() or "variant" in kind.simpleString()


def split_at(df: DataFrame, order: list[str], ranks: list[int], labels: list[str]) -> DataFrame:
    """Add ``split``: ``labels[0]`` for the rows before the first rank of the order, ``labels[1]`` up to the second, and so on.

    Exact for any data: see the head of the module. ``ranks`` ascend; ranks beyond the table leave later labels empty.
    """
    placed, keys = _placed(df, order)
    narrow = placed.select(*keys)
    # columns without NULL and NaN need no class
    seen = narrow.agg(F.count(F.lit(1)).alias("n"), *[F.max(F.col(k) != 1).alias(k) for k in keys if k.startswith("_class")]).first()
    keys = [k for k in keys if not k.startswith("_class") or seen[k]]
    n = seen["n"]
    points = {r: row_at(narrow, keys, r) for r in dict.fromkeys(ranks) if 0 < r < n}
    distinct = list(dict.fromkeys(points.values()))
    counts = []
    if distinct:
        equal = [_equal(keys, p) for p in distinct]
        row = narrow.agg(
            *[F.count_if(before(keys, p)).alias(f"b{i}") for i, p in enumerate(distinct)],
            *[F.count_if(e).alias(f"s{i}") for i, e in enumerate(equal)],
        ).first()
        counts = [(row[f"b{i}"], row[f"s{i}"]) for i in range(len(distinct))]
    bounds = [0, *[min(max(r, 0), n) for r in ranks], n]
    # every row is before, at or after each point; labels of rows that are at none follow from the points before them
    split = F.lit(labels[0])
    for i, r in enumerate(ranks):
        if r <= 0:
            split = F.lit(labels[i + 1])
        elif r < n:
            split = F.when(~before(keys, points[r]), labels[i + 1]).otherwise(split)
    shared, at_any = [], F.lit(False)
    for (below, same), e in zip(counts, [_equal(keys, p) for p in distinct]):
        parts = [(label, min(below + same, hi) - max(below, lo)) for label, lo, hi in zip(labels, bounds, bounds[1:])]
        parts = [(label, k) for label, k in parts if k > 0]
        if len(parts) > 1:  # rows equal in every column: any k of them are the same k rows
            at_any = at_any | e
            shared += [placed.filter(e).limit(k).withColumn("split", F.lit(label)) for label, k in parts]
    out = placed.withColumn("split", split)
    if shared:
        out = out.filter(~at_any)
    for s in shared:
        out = out.unionByName(s)
    return out.select(*df.columns, "split")


def _equal(order: list[str], point: tuple) -> Column:
    cond = F.lit(True)
    for c, v in zip(order, point):
        cond = cond & (F.col(c) == F.lit(v))
    return cond


def tail_split(
    df: DataFrame, order: list[str], valid_ratio: float = 0.1, train_ratio: float = 1.0
) -> DataFrame:
    """Add ``split``: the last ``max(1, int(n * valid_ratio))`` rows by ``order`` are ``valid``, the first ones
    ``train``; with ``train_ratio < 1`` only that share of them, and the rows between are ``dropped``.

    ``order`` columns are numeric; NULL, NaN and equal keys have their places (see ``split_at``).
    """
    n = df.count()
    train, valid = split_sizes(n, valid_ratio, train_ratio)
    return split_at(df, order, [train, n - valid], ["train", "dropped", "valid"])


def _mark(df: DataFrame, in_train: Column, before_valid: Column) -> DataFrame:
    return df.withColumn(
        "split", F.when(~before_valid, "valid").when(in_train, "train").otherwise("dropped")
    )


def with_file_order(df: DataFrame) -> DataFrame:
    """Add the source file and the row number in it. Call right after reading, before any shuffle."""
    return df.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))


def file_position(df: DataFrame, rank: int) -> tuple[str, int] | None:
    """File and row number of the row at a 0-based rank in file order.

    Only per-file counts are ordered: one row per file, whatever the number of data rows.
    """
    for name, n in sorted(df.groupBy(FILE).count().collect()):
        if rank < n:
            return name, rank
        rank -= n
    return None


def tail_split_files(df: DataFrame, valid_ratio: float = 0.1, train_ratio: float = 1.0) -> DataFrame:
    """``tail_split`` in file order, for a table read through ``with_file_order``."""
    n = df.count()
    train, valid = split_sizes(n, valid_ratio, train_ratio)
    order = [FILE, ROW]
    return _mark(df, before(order, file_position(df, train)), before(order, file_position(df, n - valid)))


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows in file order, read through ``with_file_order``. Stays distributed for any ``n``."""
    return df.filter(before([FILE, ROW], file_position(df, n)))


def hash_key(ids: list[str], seed: int) -> Column:
    """A reproducible uniform 52-bit number per row id."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def allocate(counts: dict, total: int) -> dict:
    """Share ``total`` among classes in proportion to their sizes, largest remainders first."""
    n = sum(counts.values())
    exact = {k: c * total / n for k, c in counts.items()}
    out = {k: int(math.floor(v)) for k, v in exact.items()}
    rest = sorted(counts, key=lambda k: (out[k] - exact[k], str(k)))
    for k in rest[: total - sum(out.values())]:
        out[k] += 1
    return out


def stratified_split(
    df: DataFrame, label: str, ids: list[str], test_ratio: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``split`` (``train`` or ``test``) with exactly ``ceil(n * test_ratio)`` test rows, shared among the
    classes of ``label`` by size. Rows of a class are picked by the hash of their id, rows of equal ids by that of all columns.

    The thresholds of all classes are found together, in a fixed number of jobs.
    """
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    if not counts:
        return df.withColumn("split", F.lit("train"))
    sizes = allocate(counts, math.ceil(sum(counts.values()) * test_ratio))
    spark = df.sparkSession
    kind = next(f.dataType for f in df.schema.fields if f.name == label)
    schema = T.StructType([T.StructField("_label", kind), T.StructField("_size", T.LongType()), T.StructField("_class", T.LongType())])
    classes = F.broadcast(spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(sizes.items())], schema))  # a row per class
    keyed = df.withColumn("_h", hash_key(ids, seed)).join(classes, F.col(label).eqNullSafe(F.col("_label"))).drop("_label")
    # the class and its share are one key, so the rank can read the share
    keyed = keyed.withColumn("_key", F.col("_class") * (max(counts.values()) + 1) + F.col("_size"))
    share = F.col("_k0") % (max(counts.values()) + 1)
    found = order_statistics(keyed.select("_key", "_h"), ["_key"], "_h", {"at": share}).select(
        F.col("_key").alias("_of"), F.col("value").alias("_from")
    )
    # classes that are taken whole have no row at that rank
    placed = keyed.join(F.broadcast(found), F.col("_key") == F.col("_of"), "left").drop("_of")
    below = placed.groupBy("_key").agg(
        F.count_if(F.col("_from").isNull() | (F.col("_h") < F.col("_from"))).alias("_below"),
        F.count_if(F.col("_h") == F.col("_from")).alias("_same"),
    )
    need = {r["_key"]: (r["_below"], r["_same"]) for r in below.collect()}
    tied = [k for k, (b, same) in need.items() if same > 1 and 0 < k % (max(counts.values()) + 1) - b < same]
    test = F.col("_from").isNull() | (F.col("_h") < F.col("_from"))
    out = placed.withColumn("split", F.when(test & (F.col("_size") > 0), "test").otherwise("train"))
    if tied:
        at = F.col("_key").isin(tied) & (F.col("_h") == F.col("_from"))
        whole = [c for c in df.columns if not _has_map(df.schema[c].dataType)]
        left = F.create_map(*[F.lit(x) for k in tied for x in (k, k % (max(counts.values()) + 1) - need[k][0])])
        place = F.row_number().over(Window.partitionBy("_key").orderBy(F.xxhash64(*whole)))
        shared = out.filter(at).withColumn("_place", place)
        shared = shared.withColumn("split", F.when(F.col("_place") <= left[F.col("_key")], "test").otherwise("train"))
        out = out.filter(~F.coalesce(at, F.lit(False))).unionByName(shared.drop("_place"))
    return out.select(*df.columns, "split")


def exact_sample(df: DataFrame, ids: list[str], n: int, seed: int = 42) -> DataFrame:
    """A uniform sample of exactly ``n`` rows (all rows if fewer), the same on every run.

    Rows are taken by the hash of their id, rows of equal ids by that of all columns.
    """
    keyed = df.withColumn("_h", hash_key(ids, seed))
    return split_at(keyed, ["_h"], [n], ["in", "out"]).filter("split = 'in'").select(*df.columns)


def shuffled(df: DataFrame, ids: list[str], seed: int = 42, partitions: int | None = None) -> DataFrame:
    """Rows in a reproducible random order: spread by the hash of their id and sorted by it within partitions."""
    keyed = df.withColumn("shuffle_key", hash_key(ids, seed))
    spread = keyed.repartition(partitions, "shuffle_key") if partitions else keyed.repartition("shuffle_key")
    return spread.sortWithinPartitions("shuffle_key", *ids)
