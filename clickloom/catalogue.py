"""The feature catalogue: which columns exist, their vocabularies, widths and order.

The catalogue is a few hundred rows at most, lives on the driver and drives expression building.
``to_df`` exposes it as a table for joins with observed statistics.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickloom.functions.scalars import in_time_range

DEFAULT_SEQ_LEN = 256
SCHEMA = (
    "group string, domain string, column string, fid int, vocab bigint, dim int, ord int, is_ts boolean"
)
PREFIX = {"user_int": "user_int_feats", "item_int": "item_int_feats", "user_dense": "user_dense_feats"}


@dataclass(frozen=True)
class Feature:
    group: str
    column: str
    fid: int
    vocab: int | None
    dim: int
    ord: int
    domain: str | None = None
    is_ts: bool = False

    @property
    def scalar(self) -> bool:
        return self.dim == 1


@dataclass(frozen=True)
class Catalogue:
    features: tuple[Feature, ...]
    ts_fids: dict = field(default_factory=dict)
    max_lens: dict = field(default_factory=dict)

    @staticmethod
    def from_dict(spec: dict, max_lens: dict | None = None) -> "Catalogue":
        """Build from the JSON layout: ``[fid, vocab, dim]`` lists and a ``seq`` map of domains."""
        out: list[Feature] = []
        for group in ("user_int", "item_int"):
            for i, (fid, vocab, dim) in enumerate(spec.get(group, [])):
                out.append(Feature(group, f"{PREFIX[group]}_{fid}", fid, vocab, dim, i))
        for i, (fid, dim) in enumerate(spec.get("user_dense", [])):
            out.append(Feature("user_dense", f"{PREFIX['user_dense']}_{fid}", fid, None, dim, i))
        ts_fids = {}
        for domain in sorted(spec.get("seq", {})):
            cfg = spec["seq"][domain]
            ts_fids[domain] = cfg.get("ts_fid")
            for i, (fid, vocab) in enumerate(cfg["features"]):
                is_ts = fid == cfg.get("ts_fid")
                out.append(Feature("seq", f"{cfg['prefix']}_{fid}", fid, vocab, 1, i, domain, is_ts))
        return Catalogue(tuple(out), ts_fids, dict(max_lens or {}))

    def group(self, name: str) -> list[Feature]:
        return [f for f in self.features if f.group == name]

    @property
    def domains(self) -> list[str]:
        return list(dict.fromkeys(f.domain for f in self.features if f.domain))

    def side_info(self, domain: str) -> list[Feature]:
        return [f for f in self.features if f.domain == domain and not f.is_ts]

    def ts_feature(self, domain: str) -> Feature | None:
        return next((f for f in self.features if f.domain == domain and f.is_ts), None)

    def reference_feature(self, domain: str) -> Feature:
        """The field that stands for a domain's length: first non-timestamp one, else the first."""
        return (self.side_info(domain) or [f for f in self.features if f.domain == domain])[0]

    def max_len(self, domain: str) -> int:
        return int(self.max_lens.get(domain, DEFAULT_SEQ_LEN))

    def width(self, group: str) -> int:
        return sum(f.dim for f in self.group(group))

    def with_max_lens(self, max_lens: dict) -> "Catalogue":
        return replace(self, max_lens=dict(max_lens))

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(f.group, f.domain, f.column, f.fid, f.vocab, f.dim, f.ord, f.is_ts) for f in self.features]
        return spark.createDataFrame(rows, SCHEMA)


def read_json(spark: SparkSession, path: str) -> dict:
    """One small JSON document from any file system Spark can reach."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def load_catalogue(spark: SparkSession, path: str, max_lens: dict | str | None = None) -> Catalogue:
    if isinstance(max_lens, str):
        max_lens = parse_max_lens(max_lens)
    return Catalogue.from_dict(read_json(spark, path), max_lens)


def parse_max_lens(text: str) -> dict[str, int]:
    """``'seq_a:256,seq_b:512'`` to a dict."""
    pairs = (part.split(":") for part in text.split(",") if part.strip())
    return {name.strip(): int(length) for name, length in pairs}


def feature_groups(spark: SparkSession, catalogue: Catalogue, config: dict | None) -> DataFrame:
    """Groups of features as a table ``(group, name, pos, fid, ord)``.

    ``config`` holds ``user_ns_groups`` and ``item_ns_groups``; keys starting with ``_`` are notes.
    Without a config every feature is its own group. A fid the catalogue lacks is an error.
    """
    rows = []
    for group, key in (("user_int", "user_ns_groups"), ("item_int", "item_ns_groups")):
        known = {f.fid: f for f in catalogue.group(group)}
        if config is None:
            named = {str(f.fid): [f.fid] for f in known.values()}
        else:
            named = {k: v for k, v in config.get(key, {}).items() if not k.startswith("_")}
        for name, fids in named.items():
            missing = [fid for fid in fids if fid not in known]
            if missing:
                raise KeyError(f"group {name} of {group} names fids that the catalogue lacks: {missing}")
            rows += [(group, name, pos, fid, known[fid].ord) for pos, fid in enumerate(fids)]
    return spark.createDataFrame(rows, "group string, name string, pos int, fid int, ord int")


def feature_offsets(catalogue_df: DataFrame) -> DataFrame:
    """Add ``offset``: where each feature starts in the flattened vector of its group.

    The window runs over catalogue rows only, never over data rows.
    """
    before = Window.partitionBy("group").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return catalogue_df.withColumn("offset", F.coalesce(F.sum("dim").over(before), F.lit(0)).cast("int"))


def virtual_id_bases(catalogue_df: DataFrame, buckets: int | None, max_tokens: int | None = None) -> DataFrame:
    """Scalar features with the base of their id range, plus ``table_size`` of the whole group.

    Bases start at 1 and advance by the slots of each feature plus one. ``buckets=None`` gives each
    feature its vocabulary as slots. The size counts all scalar features, also those beyond
    ``max_tokens``.
    """
    slots = F.lit(buckets) if buckets is not None else F.col("vocab")
    group = Window.partitionBy("group")
    before = group.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    out = (
        catalogue_df.filter("group != 'seq' and dim = 1 and vocab is not null")
        .withColumn("slots", slots.cast("bigint"))
        .withColumn("base", F.coalesce(F.sum(F.col("slots") + 1).over(before), F.lit(0)) + 1)
        .withColumn("table_size", F.sum(F.col("slots") + 1).over(group) + 1)
        .withColumn("token", F.row_number().over(group.orderBy("ord")))
    )
    return out if max_tokens is None else out.filter(F.col("token") <= max_tokens)


def vocab_gate(catalogue_df: DataFrame, skip_above: int = 0, id_above: int = 10000) -> DataFrame:
    """Mark features without a usable vocabulary (``skipped``) and high-cardinality ones (``is_id``).

    ``skip_above <= 0`` switches the upper bound off.
    """
    too_big = (F.col("vocab") > skip_above) if skip_above > 0 else F.lit(False)
    return catalogue_df.select(
        "*",
        ((F.coalesce("vocab", F.lit(0)) <= 0) | too_big).alias("skipped"),
        (F.coalesce("vocab", F.lit(0)) > id_above).alias("is_id"),
    )


def primary_field(catalogue_df: DataFrame, cap: int) -> DataFrame:
    """Per domain the first non-timestamp field with ``vocab <= cap``; NULL where there is none."""
    usable = F.when(~F.col("is_ts") & (F.col("vocab") <= cap), F.col("ord"))
    ranked = catalogue_df.filter("domain is not null and not is_ts").withColumn(
        "slot", F.row_number().over(Window.partitionBy("domain").orderBy("ord")) - 1
    )
    return ranked.groupBy("domain").agg(
        F.min_by("column", usable).alias("column"),
        F.min_by("fid", usable).alias("fid"),
        F.min_by("slot", usable).alias("slot"),
        F.min_by("vocab", usable).alias("vocab"),
    )


def observed_catalogue(values: DataFrame) -> DataFrame:
    """Catalogue rows from data: ``values`` holds ``(domain, column, ord, value)`` ids.

    The vocabulary is the greatest id plus one; a field is a timestamp when over 80% of its ids above 0
    lie in the plausible time range.
    """
    share = F.avg(F.when(F.col("value") > 0, in_time_range("value").cast("double")))
    return values.groupBy("domain", "column", "ord").agg(
        (F.max("value") + 1).alias("vocab"), F.coalesce(share > 0.8, F.lit(False)).alias("is_ts")
    ).withColumn("fid", F.col("ord"))
