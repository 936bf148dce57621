"""Benchmark decontamination: broadcast set of test n-grams, scan of token windows, verified hits.

The benchmark's windows are few (a test set does not grow with the corpus). Their 64-bit hashes become one ``IN`` set of
the scan, so every document is scanned in place: no exploded windows, no shuffle of text. What the set hits
is carried as window text and joined to the benchmark by that text, which verifies it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import Scratch, ascii_lower, table

WINDOW = 13
#: Windows that the scan's set may hold; a larger benchmark is scanned set by set.
SET_SIZE = 50_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and everything beyond ASCII; none for NULL."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item_id, length, hash, gram`` of every different window of every item; an item of fewer words is one window."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    grams = F.expr(
        f"transform(sequence(1, greatest(size(w) - {window - 1}, 1)), i -> slice(w, i, least(size(w), {window})))"
    )
    return (
        items.select("item_id", F.explode(grams).alias("g"))
        .select("item_id", F.size("g").alias("length"), F.expr("xxhash64(g)").alias("hash"), F.array_join("g", " ").alias("gram"))
        .distinct()
    )


def _scan(sets: dict[int, list[int]]) -> Column:
    """Windows of ``w`` whose hash is in the set of their length, as structs of place, length and text."""
    parts = []
    for length, hashes in sorted(sets.items()):
        for at in range(0, len(hashes), SET_SIZE):
            within = ",".join(f"{h}L" if h != -(2**63) else "(-9223372036854775807L - 1L)" for h in hashes[at : at + SET_SIZE])
            parts.append(
                F.expr(
                    f"""transform(
                        filter(if(size(w) >= {length}, sequence(1, greatest(size(w) - {length - 1}, 1)), array()),
                               i -> xxhash64(slice(w, i, {length})) in ({within})),
                        i -> named_struct('at', i, 'length', {length}, 'gram', array_join(slice(w, i, {length}), ' ')))"""
                )
            )
    empty = F.expr("cast(array() as array<struct<at:int,length:int,gram:string>>)")
    return reduce(F.concat, parts, empty)


def find_hits(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: its id, ``t1, t2`` (two hashes of its text), ``n_words``, ``n_hit``,
    ``n_items``, ``items`` (sorted as strings) and ``spans`` (merged word ranges ``first, last``, from 1).

    Rows are told apart by id and text, so a repeated row gets the same result twice. NULL texts have no words; NULL
    item ids are left out of ``items``; an empty benchmark hits nothing.
    """
    grams = scratch.save(benchmark_windows(benchmark, window), "grams")
    # One row per different window: bounded by the words of the test set, whatever the corpus.
    sets: dict[int, list[int]] = {}
    for length, h in grams.select("length", "hash").distinct().collect():
        sets.setdefault(length, []).append(h)
    text = F.coalesce("text", F.lit(""))
    scanned = (
        docs.select("doc_id", F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), words_of(F.col("text")).alias("w"))
        .select("doc_id", "t1", "t2", F.size("w").alias("n_words"), _scan(sets).alias("found"))
    )
    scanned = scratch.save(scanned, "scanned")
    by_gram = grams.groupBy("gram").agg(F.collect_set("item_id").alias("items"))
    hits = (
        scanned.filter(F.size("found") > 0)
        .dropDuplicates(["doc_id", "t1", "t2"])
        .select("doc_id", "t1", "t2", F.explode("found").alias("f"))
        .select("doc_id", "t1", "t2", "f.*")
        .join(by_gram, "gram")
        .groupBy("doc_id", "t1", "t2")
        .agg(
            F.sort_array(F.collect_set(F.struct("at", (F.col("at") + F.col("length")).alias("end")))).alias("runs"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_set("items"))).cast("array<string>")).alias("items"),
        )
        # overlapping and touching windows become one span
        .withColumn(
            "spans",
            F.expr(
                """aggregate(runs, cast(array() as array<struct<first:int,last:int>>), (s, r) ->
                    if(size(s) > 0 and element_at(s, -1).last + 1 >= r.at,
                       concat(slice(s, 1, size(s) - 1), array(named_struct('first', element_at(s, -1).first,
                              'last', greatest(element_at(s, -1).last, r.end - 1)))),
                       concat(s, array(named_struct('first', r.at, 'last', r.end - 1)))))"""
            ),
        )
        .withColumn("n_hit", F.expr("aggregate(spans, 0L, (n, s) -> n + s.last - s.first + 1)"))
        .select(F.col("doc_id").alias("hit_id"), F.col("t1").alias("hit_1"), F.col("t2").alias("hit_2"), "n_hit", "items", "spans")
    )
    on = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("t1") == F.col("hit_1")) & (F.col("t2") == F.col("hit_2"))
    return scanned.join(hits, on, "left").select(
        "doc_id",
        "t1",
        "t2",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
        F.coalesce("spans", F.expr("cast(array() as array<struct<first:int,last:int>>)")).alias("spans"),
    )


def contaminated() -> Column:
    """At least one word in twenty lies in a test window."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns, without contaminated documents."""
    bad = find_hits(docs, benchmark, scratch, window).filter(contaminated()).select("doc_id", "t1", "t2").distinct()
    bad = bad.toDF("bad_doc_id", "bad_text_1", "bad_text_2")
    text = F.coalesce(docs["text"], F.lit(""))
    on = docs["doc_id"].eqNullSafe(bad["bad_doc_id"]) & (F.xxhash64(text) == bad["bad_text_1"]) & (F.xxhash64(F.lit(1), text) == bad["bad_text_2"])
    return docs.join(bad, on, "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """``doc_id, text`` of every row, hit words cut out; text that has hits comes back as its normalised words."""
    hits = find_hits(docs, benchmark, scratch, window).filter("n_hit > 0")
    hits = hits.dropDuplicates(["doc_id", "t1", "t2"]).select(
        F.col("doc_id").alias("hit_doc_id"), F.col("t1").alias("hit_text_1"), F.col("t2").alias("hit_text_2"), F.col("spans").alias("hit_spans")
    )
    text = F.coalesce(docs["text"], F.lit(""))
    on = docs["doc_id"].eqNullSafe(hits["hit_doc_id"]) & (F.xxhash64(text) == hits["hit_text_1"]) & (F.xxhash64(F.lit(1), text) == hits["hit_text_2"])
    kept = F.expr("filter(hit_words, (x, i) -> not exists(hit_spans, s -> i + 1 between s.first and s.last))")
    return (
        docs.select("doc_id", "text")
        .join(hits, on, "left")
        .withColumn("hit_words", words_of(F.col("text")))
        .select("doc_id", F.when(F.col("hit_spans").isNull(), F.col("text")).otherwise(F.array_join(kept, " ")).alias("text"))
    )


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "op10"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
g AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN g ON dw.n = g.n AND dw.gram = g.gram),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw ON d.doc_id = hw.doc_id LEFT JOIN hi ON d.doc_id = hi.doc_id
"""
