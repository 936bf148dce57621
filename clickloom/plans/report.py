"""The full profile of a wide impression table as one long metric table, and the suggestions drawn from it.

Every section becomes rows ``(section, column, metric, value, text)``: numbers in ``value``, names in
``text``. Rates stay numbers; formatting is left to whoever displays them.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.catalogue import Catalogue, load_catalogue
from clickloom.operators import profile as P
from clickloom.operators.splits import FILE, ROW, first_rows
from clickloom.session import stored
from clickloom.sources.readers import read_table
from clickloom.sources.sinks import export_first_rows, write_report

OVERLAP_MAX_VOCAB = 100_000_000
TOP_K = 10
COLUMNS = ["section", "column", "metric", "value", "text"]


def metrics(df: DataFrame, section: str, name: str | Column, values: list[str], texts: list[str] = []) -> DataFrame:
    """One table of named columns as metric rows."""
    key = F.col(name) if isinstance(name, str) else name
    none = F.lit(None)
    rows = [F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value"), none.cast("string").alias("text"))
            for v in values]
    rows += [F.struct(F.lit(t).alias("metric"), none.cast("double").alias("value"), F.col(t).cast("string").alias("text"))
             for t in texts]
    return df.select(F.lit(section).alias("section"), key.alias("column"), F.inline(F.array(*rows)))


def overlap_fields(catalogue: Catalogue, held: set[str] | None = None) -> dict[str, str]:
    """Per domain the column that stands for its items: the first non-timestamp field of moderate vocabulary that
    holds ids. ``held`` names the columns that do; without it all count."""
    out = {}
    for d in catalogue.domains:
        fit = [f.column for f in catalogue.side_info(d) if (f.vocab or 0) <= OVERLAP_MAX_VOCAB]
        fit = [c for c in fit if held is None or c in held]
        if fit:
            out[d] = fit[0]
    return out


def declared_fields(df: DataFrame, catalogue: Catalogue) -> DataFrame:
    rows = [(f.column, f.vocab, f.is_ts) for f in catalogue.group("seq") if f.column in df.columns]
    return df.sparkSession.createDataFrame(rows, "column string, vocab bigint, is_ts boolean")


def sections(
    df: DataFrame, catalogue: Catalogue, counts: DataFrame, freq: DataFrame, labels: DataFrame | None
) -> list[DataFrame]:
    """All report sections that read the table.

    ``counts`` is ``sequence_value_counts``: vocabulary, overlap and timestamp detection read this one
    de-duplicated table. ``freq`` is ``length_frequencies``, ``labels`` ``label_counts``. The caller keeps all materialized.
    Scalars and arrays are counted by value once each, so the table itself is read five times in all.
    """
    kinds = P.classify_columns(df, catalogue)
    scalars = kinds["user_int/scalar"] + kinds["item_int/scalar"] + kinds["dense/scalar"]
    arrays = kinds["user_int/array"] + kinds["item_int/array"]
    out = []
    if labels is not None:
        label = ["positive", "negative", "total", "pos_rate", "neg_per_pos"]
        distribution = P.label_distribution_of(labels)
        out.append(metrics(distribution, "label", F.lit("label_type"), label))
        values = labels.withColumn("label", F.coalesce(F.col("label").cast("string"), F.lit("null")))
        out.append(metrics(values, "label_counts", "label", ["count"]))
    out += [
        metrics(P.domain_coverage(freq), "domain_coverage", "domain", ["with_seq", "without_seq", "coverage"]),
        metrics(
            P.seq_length_stats(freq), "seq_length", "domain",
            ["mean_len", "p50", "p90", "p99", "max_len", "max_raw_len", "zero_seq_rate", "suggested_cap"],
        ),
    ]
    if scalars:
        stats = ["total", "missing_count", "missing_rate", "valid_count", "min", "max", "mean", "std", "p50", "p90", "p99"]
        outlier = ["outlier_count", "outlier_rate"]
        values = stored(P.value_counts(P.scalar_long(df, scalars)), "scalar_counts")
        top = P.top_values(values.filter("value != 0 and value is not null"), TOP_K)
        summary, outliers = P.scalar_summary(values)
        known = summary.collect()  # a row per column
        found = df.sparkSession.createDataFrame(known, summary.schema)
        out += [
            metrics(found, "scalar", "column", stats),
            _top(top, "scalar_top"),
            metrics(
                P.correlated_pairs(df, scalars, stats=known), "correlation", F.concat_ws("/", "col_a", "col_b"), ["pearson"]
            ),
            metrics(outliers, "outliers", "column", outlier, ["severity"]),
        ]
    if arrays:
        stats = ["max_dim", "total_values", "valid_count", "missing_rate", "min", "max", "mean"]
        summary, top = P.array_summary(stored(P.element_counts(df, arrays), "element_counts"), TOP_K)
        out += [metrics(summary, "array", "column", stats), _top(top, "array_top")]
    declared = declared_fields(df, catalogue)
    stamps = P.timestamp_fields(counts).filter("is_timestamp").join(declared, "column")
    out += [
        metrics(P.vocab_coverage(counts, declared), "vocab", "column", ["vocab", "unique_ids", "coverage_rate"], ["note"]),
        metrics(stamps.withColumn("declared", F.col("is_ts").cast("int")), "timestamp", "column", ["in_range", "declared"]),
    ]
    # columns of the catalogue that hold an id
    held = {r["column"] for r in counts.select("column").distinct().collect()}
    fields = overlap_fields(catalogue, held)
    lengths = {d: catalogue.reference_feature(d).column for d in catalogue.domains}
    named = [("fields", d, "length_field", None, c) for d, c in lengths.items() if c in df.columns]
    named += [("fields", d, "overlap_field", None, c) for d, c in fields.items()]
    named.append(("fields", "scalars", "correlated_columns", float(len(scalars)), None))
    out.append(df.sparkSession.createDataFrame(named, "section string, column string, metric string, value double, text string"))
    if len(fields) > 1:
        chosen = counts.filter(F.col("column").isin(list(fields.values())))
        pairs = P.domain_overlap(chosen, list(fields), "domain", "value")
        out.append(
            metrics(
                pairs.withColumn("share", F.col("share").cast("int")), "overlap", F.concat_ws("/", "domain_a", "domain_b"),
                ["unique_a", "unique_b", "overlap", "rate_a", "rate_b", "share"],
            )
        )
    return out


def _top(top: DataFrame, section: str) -> DataFrame:
    value = F.format_string("%d", F.col("value").cast("bigint"))
    plain = F.when(F.col("value") == F.floor("value"), value).otherwise(F.col("value").cast("string"))
    return top.select(
        F.lit(section).alias("section"), "column", F.concat(F.lit("top"), F.col("rank")).alias("metric"),
        F.col("count").cast("double").alias("value"), plain.alias("text"),
    )


def suggestions(report: DataFrame, catalogue: Catalogue | None = None) -> DataFrame:
    """Rows ``(rule, column, value)`` for every finding of a metric table that calls for action; one row
    ``ok`` if there is none.

    ``report`` has catalogue size. Undeclared timestamps count only in domains that declare none.
    """

    def metric(section: str, name: str) -> DataFrame:
        return report.filter((F.col("section") == section) & (F.col("metric") == name))

    def found(df: DataFrame, rule: str) -> DataFrame:
        return df.select(F.lit(rule).alias("rule"), "column", "value")

    severe = metric("outliers", "severity").filter("text in ('mild', 'severe')")
    stamps = metric("timestamp", "declared").filter("value = 0")
    if catalogue is not None:
        without = [f.column for f in catalogue.group("seq") if catalogue.ts_fids.get(f.domain) is None]
        stamps = stamps.filter(F.col("column").isin(without) if without else F.lit(False))
    side = {m: F.max(F.when(F.col("metric") == m, F.col("value"))) for m in ("positive", "negative")}
    ratio = side["negative"] / F.when(side["positive"] > 0, side["positive"])
    label = report.filter("section = 'label'").groupBy("column")
    imbalance = label.agg(ratio.alias("value")).filter("value > 20")
    rules = [
        found(imbalance, "imbalance"),
        found(metric("missing", "missing_rate").filter("value > 0.5"), "missing"),
        found(metric("correlation", "pearson"), "correlated"),
        found(stamps, "undeclared_timestamp"),
        found(metric("domain_coverage", "coverage").filter("value < 0.5"), "low_coverage"),
        found(severe, "outliers"),
    ]
    hits = reduce(DataFrame.unionByName, rules)
    none = hits.agg(F.count(F.lit(1)).alias("_n")).filter("_n = 0").select(
        F.lit("ok").alias("rule"), F.lit(None).cast("string").alias("column"), F.lit(None).cast("double").alias("value")
    )
    return hits.unionByName(none)


def full_report(df: DataFrame, catalogue: Catalogue) -> DataFrame:
    """All sections plus the suggestions, a table of catalogue size.

    The value counts, which grow with the data, are written to the shared work folder once and read by
    several sections. Runs when called.
    """
    counts = stored(P.sequence_value_counts(df, catalogue), "value_counts")
    lengths, labels = P.array_domain_lengths(df, catalogue), None
    measured = [d for d in catalogue.domains if catalogue.reference_feature(d).column in df.columns]
    if "label_type" in df.columns and measured:
        # one pass gives both: each row has every domain once
        by = P.array_domain_lengths(df, catalogue, keep=["label_type"]).groupBy(
            "label_type", "domain", F.col("valid_len").cast("bigint").alias("valid_len")
        )
        by = stored(by.agg(F.count(F.lit(1)).alias("count"), F.max("raw_len").cast("bigint").alias("raw_len")), "lengths")
        freq = by.groupBy("domain", "valid_len").agg(F.sum("count").alias("count"), F.max("raw_len").alias("raw_len"))
        one = by.filter(F.col("domain") == measured[0])
        labels = one.groupBy(F.col("label_type").alias("label")).agg(F.sum("count").alias("count"))
    else:
        labels = P.label_counts(df) if "label_type" in df.columns else None
        freq = P.length_frequencies(lengths)
    freq = freq.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        parts = [s.select(*COLUMNS) for s in sections(df, catalogue, counts, freq, labels)]
        report = reduce(DataFrame.unionByName, parts)
        found = report.collect()
    finally:
        freq.unpersist()
    # the missing section repeats scalar statistics of the columns where they matter
    often = {r["column"] for r in found
             if r["section"] == "scalar" and r["metric"] == "missing_rate" and (r["value"] or 0) > P.REPORT_ABOVE}
    found += [("missing", *r[1:]) for r in found
              if r["section"] == "scalar" and r["metric"] in ("missing_count", "missing_rate") and r["column"] in often]
    rows = df.sparkSession.createDataFrame(found, report.schema)
    advice = suggestions(rows, catalogue).select(
        F.lit("suggestions").alias("section"), "column", F.col("rule").alias("metric"), "value",
        F.lit(None).cast("string").alias("text"),
    )
    return rows.unionByName(advice)


def run_analysis(
    spark: SparkSession,
    data_path: str,
    schema_path: str,
    output_dir: str,
    max_rows: int | None = None,
    export_rows: int | None = None,
) -> DataFrame:
    """Profile a Parquet table and write ``report`` below ``output_dir``; optionally look at the first
    ``max_rows`` only and export the first ``export_rows``, both in file order."""
    ordered = read_table(spark, data_path, file_order=True)
    catalogue = load_catalogue(spark, schema_path)
    capped = first_rows(ordered, max_rows) if max_rows else ordered
    if export_rows:
        export_first_rows(capped, export_rows, f"{output_dir}/first_{export_rows}")
    report = full_report(capped.drop(FILE, ROW), catalogue)
    write_report(report, f"{output_dir}/report")
    return report
