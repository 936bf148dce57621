"""The registered queries: every operator over the whole test tables.

Results use plain column types: counts as bigint, rates and means as doubles rounded to 6 places,
arrays as rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom import catalogue as C
from clickloom.functions import arrays as A
from clickloom.functions import scalars as S
from clickloom.operators import evaluate as E
from clickloom.operators import history as H
from clickloom.operators import prepare as R
from clickloom.operators import profile as P
from clickloom.operators import splits as X
from clickloom.operators import tabular as M
from clickloom.operators.order_stats import sketch_quantiles
from clickloom.plans import report as G
from clickloom.plans import standins as V
from clickloom.session import stored, work_dir
from clickloom.sources import readers, sinks
from clickloom.streaming import incremental as T
from clickloom.streaming import levelled as L

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
REQUEST_TS = 1706745600  # fixed request time for single-event buckets, 2024-02-01
ORDER = ["ts", "event_id"]
BUCKETS = 32


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def r6(c: str) -> Column:
    return F.round(F.col(c).cast("double"), 6).alias(c)


def big(c: str) -> Column:
    return F.col(c).cast("bigint").alias(c)


def tidy(df: DataFrame, doubles: list[str] = [], counts: list[str] = []) -> DataFrame:
    return df.select(*[r6(c) if c in doubles else big(c) if c in counts else F.col(c) for c in df.columns])


# ---- cleaning -----------------------------------------------------------------------------------


@query
def clean_scalar(spark, sf):
    return V.accounts(spark, sf).select(
        "c_custkey", S.clean_id("nation").alias("nation"), S.clean_id("balance").alias("balance")
    )


@query
def binary_label(spark, sf):
    f = V.features(spark, sf)
    return f.select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), S.binary_label("label_type").alias("label"),
        S.binary_label("label_type", is_training=False).alias("scoring_label"),
    )


@query
def fill_missing(spark, sf):
    return S.fill_missing(V.accounts(spark, sf), ["balance"]).select("c_custkey", "nation", "balance")


@query
def oov_clip(spark, sf):
    return V.behaviour(spark, sf).select(
        "event_id",
        S.limit_vocab(S.clean_id("item"), V.VOCAB_ITEM).alias("item"),
        S.limit_vocab(S.clean_id("id"), V.VOCAB_ID).alias("id"),
        S.limit_vocab(S.clean_id("item"), 0).alias("no_vocab"),
    )


@query
def oov_report(spark, sf):
    return R.out_of_vocabulary(V.wide(spark, sf), V.wide_catalogue())


@query
def label_filter(spark, sf):
    return readers.by_label(V.table(spark, sf, "labels"), 1, "quality").select("doc_id", big("toxic"))


@query
def row_cap(spark, sf):
    return readers.row_cap(V.table(spark, sf, "lineitem").select("l_orderkey"), 1000).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


@query
def first_rows(spark, sf):
    ordered = readers.read_table(spark, f"{sf}/orders.parquet", file_order=True)
    return X.first_rows(ordered, 1000).select("o_orderkey", "o_custkey")


# ---- arrays -------------------------------------------------------------------------------------


@query
def pad_int(spark, sf):
    n = 16
    rows = V.words(spark, sf).select(
        "doc_id", A.pad_int("words", n).alias("v"), A.head_length("words", n).cast("bigint").alias("length")
    )
    return tidy(H.explode_positions(rows, ["doc_id", "length"], "v"), counts=["pos"])


@query
def pad_float(spark, sf):
    rows = V.table(spark, sf, "embeddings").select("vec_id", A.pad_float("embedding", V.DIM + 6).alias("v"))
    return H.explode_positions(rows, ["vec_id"], "v").select(
        "vec_id", big("pos"), F.col("value").cast("double").alias("value")
    )


@query
def valid_length(spark, sf):
    return V.words(spark, sf).select(
        "doc_id", A.valid_length("words").cast("bigint").alias("valid_len"),
        A.nonzero_count("words").cast("bigint").alias("nonzero"), A.has_valid("words").cast("bigint").alias("has_valid"),
    )


def _by_domain(wide: DataFrame, values: Callable[[str], dict[str, Column]]) -> DataFrame:
    """A row per wide row and domain, from one read."""
    parts = [F.struct(F.lit(d).alias("domain"), *[c.alias(n) for n, c in values(d).items()]) for d in V.DOMAINS]
    return wide.select("user_id", F.inline(F.array(*parts)))


@query
def active_items(spark, sf):
    """Items of each event history other than 0, from the arrays of the wide rows."""
    rows = _by_domain(V.wide(spark, sf), lambda d: {"v": A.active_items(f"{d}_seq_1")})
    return tidy(H.explode_positions(rows, ["user_id", "domain"], "v"), counts=["pos"])


@query
def seq_prep(spark, sf):
    cat = V.wide_catalogue()
    w = R.prepare_rows(V.wide(spark, sf), cat)
    parts = [
        F.struct(F.lit(d).alias("domain"), F.col(d).alias("slots"), F.col(f"{d}_len").cast("bigint").alias("length"))
        for d in cat.domains
    ]
    slots = w.select("user_id", F.inline(F.array(*parts))).select(
        "user_id", "domain", "length", F.posexplode("slots").alias("slot", "ids")
    )
    return tidy(H.explode_positions(slots, ["user_id", "domain", "length", "slot"], "ids"), counts=["slot", "pos"])


@query
def flat_vector(spark, sf):
    w = R.prepare_rows(V.wide(spark, sf), V.wide_catalogue())
    parts = [
        F.struct(F.lit(p).alias("part"), F.col(p).cast("array<double>").alias("v"))
        for p in ("user_int", "item_int", "user_dense")
    ]
    rows = w.select("user_id", "label", F.inline(F.array(*parts)))
    return tidy(H.explode_positions(rows, ["user_id", "label", "part"], "v"), counts=["pos"])


@query
def feature_offsets(spark, sf):
    """Catalogue offsets next to the widths found in the prepared rows."""
    cat = V.wide_catalogue()
    w = R.prepare_rows(V.wide(spark, sf), cat)
    widths = [F.struct(F.lit(g).alias("group"), F.size(g).alias("width")) for g in ("user_int", "item_int", "user_dense")]
    found = w.select(F.inline(F.array(*widths))).groupBy("group").agg(F.max("width").alias("width"))
    offsets = C.feature_offsets(cat.to_df(spark).filter("group != 'seq'"))
    return tidy(
        offsets.join(F.broadcast(found), "group").select("column", "dim", "offset", "width"),
        counts=["dim", "offset", "width"],
    )


@query
def time_bucket(spark, sf):
    cat = V.wide_catalogue()
    w = R.prepare_rows(V.wide(spark, sf), cat)
    parts = [F.struct(F.lit(d).alias("domain"), F.col(f"{d}_time_bucket").alias("v")) for d in cat.domains]
    rows = w.select("user_id", F.inline(F.array(*parts)))
    return tidy(H.explode_positions(rows, ["user_id", "domain"], "v", "bucket"), counts=["pos", "bucket"])


@query
def time_bucket_fine(spark, sf):
    bucket = S.time_bucket(F.lit(REQUEST_TS), "ts", S.FINE_TIME_EDGES)
    return V.behaviour(spark, sf).select("event_id", bucket.cast("bigint").alias("bucket"))


@query
def aligned_pairs(spark, sf):
    rows = _by_domain(V.wide(spark, sf), lambda d: {"items": F.col(f"{d}_seq_1"), "ids": F.col(f"{d}_seq_2")})
    return tidy(H.explode_pairs(rows, ["user_id", "domain"], "items", "ids"), counts=["pos"])


@query
def misaligned_rows(spark, sf):
    """Rows and pairs of domains whose histories could not be zipped."""
    pairs = [
        F.struct(F.lit(a).alias("domain_a"), F.lit(b).alias("domain_b"), F.col(f"{a}_seq_1").alias("a"), F.col(f"{b}_seq_1").alias("b"))
        for i, a in enumerate(V.DOMAINS)
        for b in V.DOMAINS[i + 1 :]
    ]
    bad = H.misaligned_rows(V.wide(spark, sf).select("user_id", F.inline(F.array(*pairs))), "a", "b")
    size = {n: F.size(n).cast("bigint").alias(f"n_{n}") for n in ("a", "b")}
    return bad.select("user_id", "domain_a", "domain_b", size["a"], size["b"])


@query
def tabular_matrix(spark, sf):
    e = V.table(spark, sf, "embeddings").select("vec_id", F.expr("nullif(label, 3)").alias("label"), "embedding")
    rows = R.tabular_features(e, ["label"], {"embedding": V.DIM}, ["embedding"], ["vec_id"])
    return tidy(H.explode_positions(rows, ["vec_id"], "features"), counts=["pos"])


@query
def chunk_split(spark, sf):
    e = V.table(spark, sf, "embeddings").select("vec_id", A.chunk_split("embedding", V.DIM, 6).alias("chunks"))
    chunks = e.select("vec_id", F.posexplode("chunks").alias("chunk", "v"))
    return tidy(H.explode_positions(chunks, ["vec_id", "chunk"], "v"), counts=["chunk", "pos"])


@query
def virtual_ids(spark, sf):
    cat = V.wide_catalogue()
    tokens = C.virtual_id_bases(cat.to_df(spark), BUCKETS).collect()
    cols = [
        F.struct(F.lit(t["column"]).alias("column"), S.virtual_id(t["column"], t["base"], t["slots"]).alias("virtual_id"))
        for t in tokens
    ]
    return V.wide(spark, sf).select("user_id", F.inline(F.array(*cols)))


def _observed(spark: SparkSession, sf: str) -> DataFrame:
    ev = V.behaviour(spark, sf)
    fields = [("ts", "ts"), ("id", "id"), ("item", "item")]
    rows = [
        F.struct(F.lit(n).alias("column"), F.lit(i).alias("ord"), F.col(c).cast("bigint").alias("value"))
        for i, (n, c) in enumerate(fields)
    ]
    return C.observed_catalogue(ev.select("domain", F.inline(F.array(*rows))))


@query
def observed_catalogue(spark, sf):
    return tidy(_observed(spark, sf), counts=["ord", "fid"])


@query
def primary_field(spark, sf):
    return tidy(C.primary_field(_observed(spark, sf), 50_000), counts=["fid", "slot"])


@query
def vocab_gate(spark, sf):
    gated = C.vocab_gate(_observed(spark, sf), skip_above=1_000_000, id_above=10_000)
    return gated.select("domain", "column", "vocab", "skipped", "is_id")


@query
def group_assembly(spark, sf):
    groups = {"U1": [1, 3], "U2": [2]}
    cols = R.assemble_groups(V.wide_catalogue(), "user_int", groups)
    rows = V.wide(spark, sf).select("user_id", *cols)
    parts = [F.struct(F.lit(g).alias("group_name"), F.col(g).alias("v")) for g in groups]
    long = rows.select("user_id", F.inline(F.array(*parts)))
    return tidy(H.explode_positions(long, ["user_id", "group_name"], "v"), counts=["pos"])


# ---- profiling ----------------------------------------------------------------------------------


@query
def label_dist(spark, sf):
    return tidy(P.label_distribution(V.features(spark, sf)), doubles=["pos_rate", "neg_per_pos"])


@query
def label_counts(spark, sf):
    return tidy(P.label_counts(V.features(spark, sf)), counts=["label"])


ACCOUNT_COLUMNS = ["c_acctbal", "nation", "balance"]


@query
def missing_le0(spark, sf):
    return tidy(P.missing_rate(V.accounts(spark, sf), ACCOUNT_COLUMNS), doubles=["missing_rate"])


@query
def null_rate(spark, sf):
    f = V.features(spark, sf)
    return tidy(P.null_rate(f, V.FEAT), doubles=["missing_rate"])


@query
def column_census(spark, sf):
    return P.column_census(V.features(spark, sf).drop("l_orderkey"))


@query
def scalar_stats(spark, sf):
    names = ["missing_rate", "min", "max", "mean", "std", "p50", "p90", "p99"]
    return tidy(P.scalar_stats(V.features(spark, sf), V.FEAT), doubles=names)


@query
def scalar_stats_signed(spark, sf):
    names = ["missing_rate", "min", "max", "mean", "std", "p50", "p90", "p99"]
    return tidy(P.scalar_stats(V.accounts(spark, sf), ACCOUNT_COLUMNS), doubles=names)


@query
def scalar_stats_pop(spark, sf):
    names = ["null_rate", "min", "max", "mean", "std", "p50", "p90", "p99"]
    return tidy(P.running_stats(V.features(spark, sf), V.FEAT), doubles=names)


@query
def describe(spark, sf):
    names = ["mean", "std", "min", "max", "p25", "p50", "p75"]
    return tidy(P.describe(V.features(spark, sf), V.FEAT), doubles=names)


@query
def top_values(spark, sf):
    long = P.scalar_long(V.features(spark, sf), ["l_quantity", "l_discount", "l_tax"]).filter("value != 0")
    return tidy(P.top_values(P.value_counts(long), 10), counts=["rank"])


def _text_columns(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "documents").select(F.expr("nullif(lang, 'en')").alias("lang"), "source", "text")


@query
def string_stats(spark, sf):
    return P.string_stats(_text_columns(spark, sf), ["lang", "source", "text"])


@query
def string_top(spark, sf):
    return tidy(P.string_top(_text_columns(spark, sf), ["lang", "source", "text"], 20), counts=["rank"])


@query
def array_stats(spark, sf):
    return tidy(P.array_stats(V.words(spark, sf), ["words"]), doubles=["missing_rate", "min", "max", "mean"])


@query
def array_top(spark, sf):
    return tidy(P.array_top(V.words(spark, sf), ["words"], 20), counts=["rank"])


@query
def array_length_stats(spark, sf):
    return tidy(
        P.array_length_stats(V.words(spark, sf), ["words"]),
        doubles=["len_mean", "len_std", "zero_len_rate", "elem_min", "elem_max", "elem_mean", "elem_std"],
    )


def _lengths(spark: SparkSession, sf: str) -> DataFrame:
    return P.event_domain_lengths(V.behaviour(spark, sf), "user_id", "domain", "item", V.DOMAINS)


@query
def seq_length(spark, sf):
    """What cap should each domain use? Valid history lengths per user and domain, summarized."""
    return tidy(
        P.seq_length_stats(P.length_frequencies(_lengths(spark, sf))), doubles=["mean_len", "zero_seq_rate", "p50", "p90", "p99"]
    )


@query
def seq_length_arrays(spark, sf):
    """The same statistics over the arrays of the wide rows."""
    lengths = P.array_domain_lengths(V.wide(spark, sf), V.wide_catalogue())
    return tidy(P.seq_length_stats(P.length_frequencies(lengths)), doubles=["mean_len", "zero_seq_rate", "p50", "p90", "p99"])


@query
def domain_coverage(spark, sf):
    return tidy(P.domain_coverage(P.length_frequencies(_lengths(spark, sf))), doubles=["coverage"])


def _id_counts(spark: SparkSession, sf: str) -> DataFrame:
    ev = V.behaviour(spark, sf)
    fields = F.array(
        F.struct(F.concat(F.col("domain"), F.lit("/id")).alias("column"), F.col("id").alias("value")),
        F.struct(F.concat(F.col("domain"), F.lit("/item")).alias("column"), F.col("item").alias("value")),
        F.struct(F.concat(F.col("domain"), F.lit("/ts")).alias("column"), F.col("ts").alias("value")),
    )
    return P.value_counts(ev.select(F.inline(fields)))


def _declared(spark: SparkSession) -> DataFrame:
    rows = [
        (f"{d}/{name}", vocab, name == "ts")
        for d in V.DOMAINS
        for name, vocab in (("id", 5_000_000), ("item", 100), ("ts", 1_772_725_488), ("unseen", 10))
    ]
    return spark.createDataFrame(rows, "column string, vocab bigint, is_ts boolean")


@query
def vocab_coverage(spark, sf):
    return tidy(P.vocab_coverage(_id_counts(spark, sf), _declared(spark)), doubles=["coverage_rate"])


@query
def ts_detect(spark, sf):
    return tidy(P.timestamp_fields(_id_counts(spark, sf)), doubles=["in_range"])


@query
def domain_overlap(spark, sf):
    return tidy(P.domain_overlap(V.behaviour(spark, sf), V.DOMAINS), doubles=["rate_a", "rate_b"])


@query
def iqr_outliers(spark, sf):
    li = V.features(spark, sf).select(
        "l_quantity", F.pow("l_quantity", 4).alias("quantity4"), F.exp(F.col("l_discount") * 60).alias("discount_exp")
    )
    return tidy(
        P.iqr_outliers(li, ["l_quantity", "quantity4", "discount_exp"]), doubles=["q1", "q3", "lower", "upper", "outlier_rate"]
    )


@query
def correlations(spark, sf):
    r = P.correlations(V.features(spark, sf), V.FEAT)
    return r.select("col_a", "col_b", "n", F.round("pearson", 4).alias("pearson"))


@query
def corr_pairs(spark, sf):
    return P.correlated_pairs(V.features(spark, sf), V.FEAT)


@query
def suggestions(spark, sf):
    """Rules over the metric table of the event log and the feature columns."""
    f, lengths = V.features(spark, sf), P.length_frequencies(_lengths(spark, sf))
    odd = f.withColumn("mostly_zero", F.when(F.col("l_quantity") > 40, F.col("l_quantity")).otherwise(0)).withColumn(
        "label_type", F.when((F.col("l_tax") == 0.08) & (F.col("label_type") == 2) & (F.col("l_quantity") < 20), 2).otherwise(1)
    )
    scalars = ["l_quantity", "l_extendedprice", "net", "mostly_zero"]
    report = reduce(
        DataFrame.unionByName,
        [
            G.metrics(P.label_distribution(odd), "label", F.lit("label_type"), ["positive", "negative", "neg_per_pos"]),
            G.metrics(P.missing_rate(odd, scalars), "missing", "column", ["missing_rate"]),
            G.metrics(P.correlated_pairs(odd, scalars), "correlation", F.concat_ws("/", "col_a", "col_b"), ["pearson"]),
            G.metrics(P.domain_coverage(lengths), "domain_coverage", "domain", ["coverage"]),
            G.metrics(P.iqr_outliers(odd, scalars), "outliers", "column", [], ["severity"]),
        ],
    )
    return tidy(G.suggestions(report), doubles=["value"])


@query
def full_report(spark, sf):
    report = G.full_report(stored(V.wide(spark, sf), "wide"), V.wide_catalogue())
    return tidy(report.na.fill({"column": "-"}), doubles=["value"])


@query
def sketch_percentiles(spark, sf):
    """One-pass estimates, each with whether its true rank is within 2% of the one asked for."""
    long = P.scalar_long(V.features(spark, sf), V.FEAT).filter("value is not null")
    probs = [0.5, 0.9, 0.99]
    found = sketch_quantiles(long, ["column"], "value", probs)
    # one row per column
    ranked = long.join(F.broadcast(found), "column").groupBy("column").agg(
        *[
            (
                (F.avg((F.col("value") < F.col(f"p{p * 100:g}")).cast("double")) <= p + 0.02)
                & (F.avg((F.col("value") <= F.col(f"p{p * 100:g}")).cast("double")) >= p - 0.02)
            ).alias(f"p{p * 100:g}_in_bounds")
            for p in probs
        ],
        F.count(F.lit(1)).alias("n"),
    )
    return ranked


@query
def sketch_strings(spark, sf):
    s = P.string_sketch(_text_columns(spark, sf), ["lang", "source"])
    return s.select("column", "total", "approx_unique", F.inline("approx_top")).select(
        "column", "total", "approx_unique", "item", "count"
    )


# ---- histories ----------------------------------------------------------------------------------


@query
def recent_k(spark, sf):
    kept = H.latest_per_group(V.behaviour(spark, sf), ["user_id", "domain"], ORDER, 64)
    return kept.select("user_id", "domain", big("recency"), "event_id", "item")


@query
def recent_arrays(spark, sf):
    """The last 2 positions of gathered arrays, which are in time order."""
    rows = _by_domain(V.wide(spark, sf), lambda d: {"v": A.last_k(f"{d}_seq_1", 2)})
    return tidy(H.explode_positions(rows, ["user_id", "domain"], "v"), counts=["pos"])


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "embeddings").select("vec_id", "embedding")


@query
def embedding_lookup(spark, sf):
    """Vector of every event's item; every third item has none."""
    known = _vectors(spark, sf).filter("vec_id % 3 != 2")
    rows = H.lookup_vectors(V.behaviour(spark, sf).select("event_id", "item"), known, "item", V.DIM)
    v = F.col("vector")
    return rows.select(
        "event_id", "item", v[0].alias("first"), v[V.DIM - 1].alias("last"), F.size(v).cast("bigint").alias("dim")
    )


@query
def mean_pool(spark, sf):
    pooled = H.mean_pool(V.behaviour(spark, sf), ["user_id", "domain"], _vectors(spark, sf), "item", V.DIM)
    rows = H.explode_positions(pooled, ["user_id", "domain", "n_valid"], "vector")
    return tidy(rows, doubles=["value"], counts=["pos"])


@query
def mean_pool_wide(spark, sf):
    """The same for vectors of width 320, some with a NULL element and some too short."""
    e = F.col("embedding").cast("array<double>")
    odd = F.when(F.col("vec_id") % 5 == 0, F.slice(e, 1, 40)).when(
        F.col("vec_id") % 5 == 1, F.transform(e, lambda x, i: F.when(i != 3, x))
    ).otherwise(F.concat(e, e, e, e, e))
    vectors = V.table(spark, sf, "embeddings").select("vec_id", odd.alias("embedding"))
    pooled = H.mean_pool(V.behaviour(spark, sf), ["domain"], vectors, "item", 5 * V.DIM)
    return tidy(H.explode_positions(pooled, ["domain", "n_valid"], "vector"), doubles=["value"], counts=["pos"])


@query
def target_topk(spark, sf):
    """Per user the 64 events of the latest 256 nearest to the mean vector of its latest 4 purchases."""
    ev, vectors = V.behaviour(spark, sf), _vectors(spark, sf)
    bought = H.latest_per_group(ev.filter("domain = 'purchase'"), ["user_id"], ORDER, 4)
    targets = H.mean_pool(bought, ["user_id"], vectors, "item", V.DIM)
    kept = H.target_top_k(ev, targets, vectors, "user_id", ORDER, "item", V.DIM)
    return tidy(
        kept.select("user_id", "rank", "recency", "event_id", "item", "score", "weight"),
        doubles=["score", "weight"],
        counts=["rank", "recency"],
    )


@query
def unified_timeline(spark, sf):
    cat = V.wide_catalogue()
    w = stored(V.wide(spark, sf), "wide")
    tokens = C.virtual_id_bases(cat.to_df(spark), BUCKETS).collect()
    ids = F.array(*[S.virtual_id(t["column"], t["base"], t["slots"]) for t in tokens])
    features = w.select("user_id", F.posexplode(ids).alias("pos", "token"))
    parts = []
    for d in cat.domains:
        n = cat.max_len(d)
        seq = A.pad_int(f"{d}_seq_1", n, V.VOCAB_ITEM)
        held = A.head_length(f"{d}_seq_1", n)
        buckets = A.time_bucket_array(F.col("timestamp"), f"{d}_seq_3", n)
        both = F.slice(F.arrays_zip(seq.alias("token"), buckets.alias("bucket")), F.lit(1), held)
        parts.append(F.struct(F.lit(d).alias("domain"), both.alias("items")))
    events = w.select("user_id", F.inline(F.array(*parts))).select(
        "user_id", "domain", F.posexplode("items").alias("pos", "e")
    )
    events = events.select("user_id", "domain", "pos", F.col("e.token").alias("token"), F.col("e.bucket").alias("bucket"))
    return tidy(H.unified_timeline(features, events, "user_id", cat.domains), counts=["segment", "bucket"])


# ---- splits and sinks ---------------------------------------------------------------------------


@query
def tail_split(spark, sf):
    return X.tail_split(V.behaviour(spark, sf), ORDER, 0.1).select("event_id", "split")


@query
def train_prefix(spark, sf):
    return X.tail_split(V.behaviour(spark, sf), ORDER, 0.1, 0.5).select("event_id", "split")


@query
def tail_split_nulls(spark, sf):
    """Every third time is NULL, and many are equal: NULL first, then time, then the hash of the row."""
    ev = V.behaviour(spark, sf).select("event_id", F.when(F.col("event_id") % 3 != 0, F.floor(F.col("ts") / 86400)).alias("day"))
    marked = X.tail_split(ev, ["day", "event_id"], 0.4)
    return marked.select("event_id", "day", "split")


@query
def tail_split_ties(spark, sf):
    """By a key that many rows share: how many rows of each day are in each part."""
    ev = V.behaviour(spark, sf).select(F.when(F.col("event_id") % 3 != 0, F.floor(F.col("ts") / 86400)).alias("day"))
    return X.tail_split(ev, ["day"], 0.4, 0.5).groupBy("day", "split").agg(F.count(F.lit(1)).alias("n"))


@query
def sample_repeated_ids(spark, sf):
    """A sample by an id that rows share has exactly the size asked for."""
    ev = V.behaviour(spark, sf).select("user_id", "item")
    return X.exact_sample(ev, ["user_id"], 500).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query
def tail_split_files(spark, sf):
    ordered = readers.read_table(spark, f"{sf}/orders.parquet", file_order=True)
    return X.tail_split_files(ordered, 0.1, 0.5).select("o_orderkey", "split")


@query
def stratified_split(spark, sf):
    labels = V.table(spark, sf, "labels")
    return X.stratified_split(labels, "quality", ["doc_id"], 0.2).select("doc_id", big("quality"), "split")


@query
def exact_sample(spark, sf):
    return X.exact_sample(V.behaviour(spark, sf), ["event_id"], 500).select("event_id", "user_id", "item")


@query
def shuffled_export(spark, sf):
    path = work_dir(spark, "shuffled")
    ev = V.behaviour(spark, sf).select("event_id", "user_id", "item")
    sinks.export_shuffled(ev, ["event_id"], path)
    return readers.read_table(spark, path)


@query
def last_prediction(spark, sf):
    ev = V.behaviour(spark, sf).withColumn("prob", S.sigmoid((F.col("value") - 50) / 100))
    return tidy(E.last_prediction(ev, "user_id", ORDER, "prob"), doubles=["prob"])


@query
def preview(spark, sf):
    rows = sinks.preview(V.table(spark, sf, "embeddings"), ["vec_id"])
    return rows.select(
        big("row"), "vec_id", big("label"), F.col("embedding_len").cast("bigint").alias("embedding_len"),
        *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(6)],
    )


# ---- evaluation and tabular models --------------------------------------------------------------


@query
def auc(spark, sf):
    s = V.scored(spark, sf).withColumn("prob", S.sigmoid("logit"))
    return tidy(E.auc(s, "prob", "label"), doubles=["auc"])


@query
def logloss(spark, sf):
    return tidy(E.log_loss(V.scored(spark, sf), "logit", "label"), doubles=["log_loss"])


@query
def focal_loss(spark, sf):
    clean = V.scored(spark, sf).filter("not isnan(logit)")
    both = E.focal_loss(clean, "logit", "label").withColumn("kind", F.lit("mean")).unionByName(
        E.focal_loss(clean, "logit", "label", 0.25, 3.0, "sum").withColumn("kind", F.lit("sum"))
    )
    return tidy(both, doubles=["focal_loss"])


@query
def class_report(spark, sf):
    s = V.scored(spark, sf).filter("not isnan(logit)").withColumn("said", (F.col("logit") > 0.5).cast("int"))
    return tidy(E.class_report(s, "label", "said"), doubles=["precision", "recall", "f1"], counts=["class"])


NAMES = ["n_chars", "n_words", "n_lines", "mean_word", "n_upper", "n_digit"]


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Text measures of the labelled documents."""
    lab = V.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    d = lab.join(V.table(spark, sf, "documents"), "doc_id")
    joined = d.select(
        "doc_id", "label",
        F.col("n_chars").cast("double").alias("n_chars"),
        F.size(F.split("text", " ", -1)).cast("double").alias("n_words"),
        F.size(F.split("text", "\n", -1)).cast("double").alias("n_lines"),
        (F.length("text") / F.size(F.split("text", " ", -1))).alias("mean_word"),
        F.length(F.regexp_replace("text", "[^A-Z]", "")).cast("double").alias("n_upper"),
        F.length(F.regexp_replace("text", "[^0-9]", "")).cast("double").alias("n_digit"),
    )
    return joined.select("doc_id", "label", R.scalar_features(joined, NAMES).alias("features"))


def _train_test(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    # measured once, read by split, scaler and every iteration
    rows = stored(_labelled(spark, sf), "labelled")
    split = X.stratified_split(rows, "label", ["doc_id"], 0.2)
    vectors = M.as_vector(split)
    return vectors.filter("split = 'train'").drop("split"), vectors.filter("split = 'test'").drop("split")


@query
def standardize(spark, sf):
    """Fit on all labelled documents, so that the scaled values can be checked."""
    rows = M.as_vector(_labelled(spark, sf))
    scaled = M.fit_standardizer(rows).transform(rows)
    flat = scaled.select("doc_id", M.vector_to_array("scaled").alias("v"))
    return tidy(H.explode_positions(flat, ["doc_id"], "v"), doubles=["value"], counts=["pos"])


def _auc(df: DataFrame, score: str) -> float:
    return E.auc(df, score, "label").first()["auc"]


@query
def logistic_baseline(spark, sf):
    """Whether each term of the fitted model satisfies its score equation, and how many test rows each class has."""
    train, test = _train_test(spark, sf)
    scaler = M.fit_standardizer(train)
    rows = M.balanced_weights(scaler.transform(train))
    model = M.fit_logistic(scaler.transform(train))
    terms = ["intercept", *NAMES]
    x = F.concat(F.array(F.lit(1.0)), M.vector_to_array("scaled"))
    scored = M.score(model, rows).select("class_weight", (F.col("prob") - F.col("label")).alias("miss"), x.alias("x"))
    sums = scored.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("class_weight") * F.col("miss") * F.col("x")[i]).alias(t) for i, t in enumerate(terms)])
    weights = [0.0, *model.coefficients.toArray().tolist()]
    # the penalty on the summed loss is half the squared coefficients
    holds = [F.struct(F.lit(t).alias("term"), (F.abs(F.col(t) + w) / F.col("n") < 1e-3).alias("holds"), F.lit(0).cast("bigint").alias("n")) for t, w in zip(terms, weights)]
    support = E.class_report(M.score(model, scaler.transform(test)), "label", "prediction")
    support = support.select(F.concat(F.lit("class "), F.col("class").cast("int")).alias("term"), F.lit(True).alias("holds"), F.col("support").alias("n"))
    return sums.select(F.inline(F.array(*holds))).unionByName(support)


@query
def boosted_trees(spark, sf):
    """Test rows per class; probabilities are shares, and trees rank at least about as well as the best single measure."""
    train, test = _train_test(spark, sf)
    out = M.score(M.fit_boosted_trees(train), test)
    flat = out.select("label", "prob", *[M.vector_to_array("features")[i].alias(n) for i, n in enumerate(NAMES)])
    single = [_auc(flat, n) for n in NAMES]
    ranks = _auc(flat, "prob") >= max(max(a, 1 - a) for a in single) - 0.05
    shares = out.groupBy("label").agg(F.count(F.lit(1)).alias("support"), F.min(F.col("prob").between(0, 1)).alias("shares"))
    return shares.select(F.col("label").cast("bigint").alias("class"), "support", "shares", F.lit(ranks).alias("ranks"))


@query
def feature_importance(spark, sf):
    """Ranks of the measures; importances fall, are not negative and add up to 1."""
    train, _ = _train_test(spark, sf)
    found = M.feature_importance(M.fit_boosted_trees(train), NAMES, train).collect()  # a row per measure
    values = [r["importance"] for r in found]
    good = abs(sum(values) - 1) < 1e-6 and values == sorted(values, reverse=True) and values[-1] >= 0
    good = good and {r["feature"] for r in found} == set(NAMES)
    return spark.createDataFrame([(r["rank"], good) for r in found], "rank bigint, holds boolean")


@query
def batch_scoring(spark, sf):
    """One prediction per test document, equal to the logistic of its linear form."""
    train, test = _train_test(spark, sf)
    scaler = M.fit_standardizer(train)
    model = M.fit_logistic(scaler.transform(train))
    rows = scaler.transform(test)
    linear = F.lit(float(model.intercept))
    for i, c in enumerate(model.coefficients.toArray().tolist()):
        linear = linear + c * M.vector_to_array("scaled")[i]
    last = E.last_prediction(M.score(model, rows), "doc_id", ["doc_id"], "prob")
    want = rows.select("doc_id", (1 / (1 + F.exp(-linear))).alias("want"))
    return last.join(want, "doc_id").select("doc_id", (F.abs(F.col("prob") - F.col("want")) < 1e-9).alias("holds"))


# ---- streaming ----------------------------------------------------------------------------------


#: Files of arriving rows hold between so many rows, as far as there are enough for every batch.
FILE_ROWS = (20_000, 1_000_000)


def _files(spark: SparkSession, df: DataFrame, batches: int = 3) -> tuple[DataFrame, str]:
    """The rows of a table as a stream of files arriving in about ``batches`` batches, and a folder for its state.

    Rows are written by the tasks that read them, without a shuffle, as files of so many rows that each batch keeps all
    cores busy.
    """
    where = work_dir(spark, "profile")
    n, (least, most) = df.count(), FILE_ROWS
    # two files a core and batch, so that a file more or less makes no second round
    rows = min(max(-(-n // (2 * batches * spark.sparkContext.defaultParallelism)), least), most, max(1, -(-n // batches)))
    df.write.option("maxRecordsPerFile", rows).parquet(f"{where}/in")
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{where}/in")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sum(1 for s in fs.listStatus(folder) if s.getPath().getName().endswith(".parquet"))
    return T.stream_files(spark, f"{where}/in", df.schema, files_per_batch=max(1, -(-files // batches))), where


def _in_bounds(finished: DataFrame, numbered: DataFrame, columns: list[str]) -> DataFrame:
    """Adds booleans: true ranks within 2% of those of the percentiles, distinct values within 5%."""
    names = {0.5: "approx_p50", 0.9: "approx_p90", 0.99: "approx_p99"}
    found = F.broadcast(finished.select("column", "approx_distinct", *names.values()))  # one row per column
    # values are counted by the number of their column, names are put on the de-duplicated rows
    counts = P.named(P.value_counts(numbered.filter("value is not null"), ["_pos"]), columns).join(found, "column")
    n = F.sum("count")
    checks = counts.groupBy("column").agg(
        *[
            (
                (F.sum(F.when(F.col("value") < F.col(c), F.col("count")).otherwise(0)) / n <= p + 0.02)
                & (F.sum(F.when(F.col("value") <= F.col(c), F.col("count")).otherwise(0)) / n >= p - 0.02)
            ).alias(f"p{p * 100:g}_in_bounds")
            for p, c in names.items()
        ],
        (F.abs(F.count(F.lit(1)) - F.max("approx_distinct")) <= F.greatest(F.lit(1.0), 0.05 * F.count(F.lit(1)))).alias("distinct_in_bounds"),
    )
    return finished.drop("approx_distinct", *names.values()).join(checks, "column")


def _incremental(spark: SparkSession, df: DataFrame, columns: list[str], native: bool = False) -> DataFrame:
    stream, where = _files(spark, df)
    if native:
        state = T.native_profile(stream, where, columns)
    else:
        state = T.run_profile(stream, where, lambda rows: T.columns_state(rows, columns))
    out = _in_bounds(T.finish(state), T.measures(df, columns, "_pos"), T.measure_names(df, columns))
    # the exact mean is rounded as a decimal: its nearest double may lie on the other side of a tie
    mean = F.coalesce(F.round("mean_exact", 6).cast("double"), F.col("mean"))
    return tidy(out.withColumn("mean", mean).drop("mean_exact"), doubles=["null_rate", "min", "max", "mean", "std"])


@query
def incremental_profile(spark, sf):
    names = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return _incremental(spark, V.table(spark, sf, "lineitem").select(*names), names)


@query
def incremental_overlap(spark, sf):
    """Domain overlap as files arrive, from theta sketches; tells whether every exact count lies within its interval."""
    ids = V.behaviour(spark, sf).select("domain", "id")
    stream, where = _files(spark, ids)
    state = T.run_profile(stream, where, T.overlap_state, T.merge_overlap_states)
    found = T.finish_overlap(state, V.DOMAINS)
    exact = P.domain_overlap(ids, V.DOMAINS).select(
        "domain_a", "domain_b", F.col("unique_a").alias("_ua"), F.col("unique_b").alias("_ub"), F.col("overlap").alias("_o")
    )
    near = lambda est, spread, truth: F.abs(F.col(est) - F.col(truth)) <= F.col(spread) + F.lit(1e-6)
    return found.join(exact, ["domain_a", "domain_b"]).select(
        "domain_a", "domain_b",
        (near("unique_a", "unique_a_spread", "_ua") & near("unique_b", "unique_b_spread", "_ub")).alias("unique_in_bounds"),
        near("overlap", "overlap_spread", "_o").alias("overlap_in_bounds"),
    )


@query
def incremental_correlations(spark, sf):
    """Pearson r of every pair of feature columns as files arrive, from mergeable co-moments."""
    stream, where = _files(spark, V.features(spark, sf).select(*V.FEAT))
    state = T.run_profile(stream, where, lambda rows: T.comoment_state(rows, V.FEAT), T.merge_comoments)
    return T.finish_correlations(state).select("col_a", "col_b", "n", F.round("pearson", 4).alias("pearson"))


@query
def incremental_sample(spark, sf):
    """``exact_sample`` of the events as files arrive: the least 500 by hash, kept and merged as state."""
    stream, where = _files(spark, V.behaviour(spark, sf).select("event_id", "user_id", "item"))
    sample = lambda rows: T.bottom_k(rows, ["event_id"], 500)
    state = T.run_profile(stream, where, sample, lambda a, b: sample(a.unionByName(b)))
    return state.select("event_id", "user_id", "item")


@query
def incremental_outliers(spark, sf):
    """Outliers of every lineitem column by the IQR rule from the state of arriving files; tells whether the exact counts
    outside the sketch's fences lie within the intervals."""
    names = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    df = V.table(spark, sf, "lineitem").select(*names)
    stream, where = _files(spark, df)
    state = T.run_profile(stream, where, lambda rows: T.columns_state(rows, names))
    found = T.outlier_estimates(state)
    values = T.measures(df, names).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    exact = values.join(F.broadcast(found.select("column", "lower", "upper")), "column").groupBy("column").agg(
        F.count(F.when(F.col("value") < F.col("lower"), 1)).alias("_below"), F.count(F.when(F.col("value") > F.col("upper"), 1)).alias("_above")
    )
    near = lambda est, truth: F.abs(F.col(est) - F.col(truth)) <= F.col("spread")
    return found.join(exact, "column").select("column", near("below", "_below").alias("below_in_bounds"), near("above", "_above").alias("above_in_bounds"))


@query
def incremental_native(spark, sf):
    """The profile of ``incremental_profile``, kept by Spark's streaming aggregation in its state store."""
    names = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return _incremental(spark, V.table(spark, sf, "lineitem").select(*names), names, native=True)


@query
def incremental_times(spark, sf):
    """Epoch seconds with fractions: the deviation must not be lost in the size of the values."""
    ev = V.behaviour(spark, sf).select("event_id", (F.lit(1.7e9) + F.pmod(F.col("event_id"), F.lit(7)) / 10).alias("tick"), "ts")
    # a plain sum of so many large values is good to some thousandths
    return _incremental(spark, ev, ["tick", "ts"]).withColumns({"mean": F.round("mean", 2), "std": F.round("std", 4)})


@query
def incremental_arrays(spark, sf):
    return _incremental(spark, V.table(spark, sf, "embeddings"), ["embedding"])


@query
def incremental_strings(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    stream, where = _files(spark, docs)
    names = ["lang", "source", "text"]
    state = T.run_profile(stream, where, lambda rows: T.string_state(rows, names), T.merge_string_states)
    found = T.finish_strings(state)
    exact = P.string_stats(docs, names).select("column", "unique_count")
    near = F.abs(F.col("approx_unique") - F.col("unique_count")) <= F.greatest(F.lit(1.0), 0.05 * F.col("unique_count"))
    return found.join(exact, "column").select("column", "total", "null_count", near.alias("unique_in_bounds"))


@query
def incremental_labels(spark, sf):
    """Label counts as files arrive, from the state of several batches."""
    stream, where = _files(spark, V.features(spark, sf))
    count = lambda rows: T.count_state(rows.select(F.col("label_type").alias("label")), ["label"])
    return tidy(T.run_profile(stream, where, count, lambda a, b: T.count_state(a.unionByName(b), ["label"])), counts=["label"])


@query
def incremental_lengths(spark, sf):
    """Sequence lengths and coverage of the wide rows as files arrive."""
    cat = V.wide_catalogue()
    stream, where = _files(spark, V.wide(spark, sf))
    keys = ["domain", "valid_len"]

    def merge(a: DataFrame, b: DataFrame) -> DataFrame:
        return T.count_state(a.unionByName(b), keys, most=["raw_len"])

    freq = T.run_profile(stream, where, lambda rows: P.length_frequencies(P.array_domain_lengths(rows, cat)), merge)
    stats, cover = P.seq_length_stats(freq), P.domain_coverage(freq)
    # one row per domain each
    out = stats.select("domain", "n_rows", "mean_len", "p50", "p90", "p99", "max_len").join(F.broadcast(cover), "domain")
    return tidy(out, doubles=["mean_len", "p50", "p90", "p99", "coverage"])


@query
def incremental_ids(spark, sf):
    """Vocabulary coverage and timestamp fields of the wide rows as files arrive."""
    cat = V.wide_catalogue()
    stream, where = _files(spark, V.wide(spark, sf))
    # counts by id are kept as levelled runs: a batch writes in proportion to itself, not to all ids seen
    counts = L.run_levelled(stream, where, lambda rows: P.sequence_value_counts(rows, cat), ["domain", "column", "value"])
    cover = P.vocab_coverage(counts, G.declared_fields(V.wide(spark, sf), cat))
    stamps = P.timestamp_fields(counts)
    return tidy(cover.join(F.broadcast(stamps), "column", "left"), doubles=["coverage_rate", "in_range"])


@query
def element_top(spark, sf):
    """Most frequent elements of the word lengths and of the embeddings, which are no whole numbers."""
    words = P.element_top(V.words(spark, sf), ["words"], 20)
    return tidy(words.unionByName(P.element_top(V.table(spark, sf, "embeddings"), ["embedding"], 20)), counts=["rank"])


@query
def coverage_first_field(spark, sf):
    """Coverage by the first field of each domain, next to that by its reference field."""
    w, cat = stored(V.wide(spark, sf), "wide"), V.wide_catalogue()
    rules = {"first": True, "reference": False}
    parts = [
        P.domain_coverage(P.length_frequencies(P.array_domain_lengths(w, cat, first))).withColumn("rule", F.lit(name))
        for name, first in rules.items()
    ]
    return tidy(reduce(DataFrame.unionByName, parts), doubles=["coverage"])
