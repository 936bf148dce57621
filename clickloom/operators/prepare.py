"""Wide impression rows to clean, bounded, bucketed training rows.

Everything is one projection built from the catalogue: no shuffle, and the scan reads only the
catalogue's columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.catalogue import Catalogue, Feature
from clickloom.functions import arrays as A
from clickloom.functions.scalars import TIME_EDGES, binary_label, clean_id, limit_vocab


def int_feature(f: Feature, clip_vocab: bool = True) -> Column:
    """One id feature as an array of exactly ``dim`` ids within its vocabulary."""
    strict = not clip_vocab
    if f.scalar:
        return F.array(limit_vocab(clean_id(f.column), f.vocab, strict, f.column))
    return A.pad_int(f.column, f.dim, f.vocab, strict, f.column)


def seq_feature(f: Feature, n: int, clip_vocab: bool = True) -> Column:
    return A.pad_int(f.column, n, f.vocab, not clip_vocab, f.column)


def _vector(parts: list[Column], kind: str) -> Column:
    return A.flat_vector(parts) if parts else A.empty(kind)


def prepare_rows(
    df: DataFrame,
    catalogue: Catalogue,
    clip_vocab: bool = True,
    is_training: bool = True,
    edges: list[int] = TIME_EDGES,
) -> DataFrame:
    """Training rows: ``user_id, timestamp, label``, flat vectors ``user_int``, ``item_int``,
    ``user_dense`` and per domain ``{d}`` (one array per side-info column), ``{d}_len`` and
    ``{d}_time_bucket``. Arrays have the widths and lengths of the catalogue.

    ``clip_vocab=False`` fails on the first id outside its vocabulary.
    """
    label = binary_label("label_type") if is_training else binary_label(F.lit(0), is_training=False)
    out = [
        F.col("user_id"),
        F.col("timestamp"),
        label.alias("label"),
        _vector([int_feature(f, clip_vocab) for f in catalogue.group("user_int")], "bigint").alias("user_int"),
        _vector([int_feature(f, clip_vocab) for f in catalogue.group("item_int")], "bigint").alias("item_int"),
        _vector([A.pad_float(f.column, f.dim) for f in catalogue.group("user_dense")], "float").alias("user_dense"),
    ]
    for d in catalogue.domains:
        n, side, ts = catalogue.max_len(d), catalogue.side_info(d), catalogue.ts_feature(d)
        # a domain with nothing but a timestamp has no slots, and its length is that of the timestamps
        lengths = [A.head_length(f.column, n) for f in side or [ts]]
        buckets = (
            A.time_bucket_array(F.col("timestamp"), ts.column, n, edges)
            if ts is not None
            else F.array_repeat(F.lit(0), n)
        )
        out += [
            (F.array(*[seq_feature(f, n, clip_vocab) for f in side]) if side else F.array().cast("array<array<bigint>>")).alias(d),
            (F.greatest(*lengths) if len(lengths) > 1 else lengths[0]).alias(f"{d}_len"),
            buckets.alias(f"{d}_time_bucket"),
        ]
    return df.select(*out)


OUTSIDE = "array<struct<column: string, vocab: bigint, value: bigint>>"


def _outside(ids: Column, f: Feature) -> Column:
    name, vocab = F.lit(f.column).alias("column"), F.lit(f.vocab).cast("bigint").alias("vocab")
    bad = F.transform(F.filter(ids, lambda e: e >= f.vocab), lambda e: F.struct(name, vocab, e.alias("value")))
    return F.when(F.array_max(ids) >= f.vocab, bad).otherwise(F.array().cast(OUTSIDE))


def out_of_vocabulary(df: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Per column: how many used ids are outside the vocabulary, the least and the greatest of them.

    Only such ids leave a row, so the aggregation sees next to nothing on clean data. Columns without
    one have no row.
    """
    parts = []
    for f in catalogue.features:
        if not f.vocab or f.vocab <= 0 or f.is_ts or f.column not in df.columns:
            continue
        if f.group != "seq" and f.scalar:
            used = F.array(clean_id(f.column))
        else:
            n = catalogue.max_len(f.domain) if f.group == "seq" else f.dim
            used = F.slice(F.coalesce(F.col(f.column), A.empty("bigint")), 1, n)
        parts.append(_outside(used, f))
    found = df.select(F.inline(F.concat(*parts)))
    return found.groupBy("column", "vocab").agg(
        F.count(F.lit(1)).alias("oov_count"), F.min("value").alias("oov_min"), F.max("value").alias("oov_max")
    )


def assemble_groups(catalogue: Catalogue, group: str, groups: dict[str, list[int]], clip_vocab: bool = True) -> list[Column]:
    """One array column per feature group holding the ids of its features side by side."""
    by_fid = {f.fid: f for f in catalogue.group(group)}
    out = []
    for name, fids in groups.items():
        missing = [fid for fid in fids if fid not in by_fid]
        if missing:
            raise KeyError(f"group {name} names fids that the catalogue lacks: {missing}")
        out.append(A.flat_vector([int_feature(by_fid[fid], clip_vocab) for fid in fids]).alias(name))
    return out


def scalar_features(df: DataFrame, columns: list[str], missing: float = -1.0) -> Column:
    """Scalar columns as one array of doubles, NULL as ``missing``."""
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(missing)) for c in columns])


def tabular_features(
    df: DataFrame, scalars: list[str], embeddings: dict[str, int], sequences: list[str], keep: list[str]
) -> DataFrame:
    """Feature matrix of the tabular baseline: scalars (NULL as -1), fixed-width embeddings, and the
    number of non-zero elements of each sequence column, as one ``features`` array."""
    parts = [scalar_features(df, scalars)] if scalars else []
    parts += [A.pad_float(c, n).cast("array<double>") for c, n in embeddings.items()]
    if sequences:
        parts.append(F.array(*[A.nonzero_count(c).cast("double") for c in sequences]))
    return df.select(*keep, A.flat_vector(parts).alias("features"))
