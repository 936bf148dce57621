"""Line dedup with levelled sorted runs of line hashes.

Documents arrive in batches. A batch is first brought to one row per line key (two 64-bit hashes): number of documents and
largest document id. It is then merged with what is known:

- the *settled* run holds keys already found in ``min_docs`` documents. The batch's keys that are there only update their
  count and last document;
- the rest (merge anti-join) becomes a new run of level 0. ``FAN_IN`` runs of a level, the new one among them, are compacted
  to one run of the next without being written before; keys that reach ``min_docs`` there move on to the settled run.

Runs are bucketed and sorted by key, so joining a batch with a run needs no shuffle of the run. A key's rows are
pre-aggregated in every task before they move, so a line that a third of all documents share costs one row per task.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import SPACES, Scratch, ascii_lower, table

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FAN_IN = 2

KEY = ["k1", "k2"]


def _lines(text: str) -> str:
    return f"split(coalesce({text}, ''), '\\n', -1)"


def line_key(line):
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


class LineRuns:
    """Levelled sorted runs of line keys ``k1, k2, n_docs, last_doc``; a key has one row in a run.

    Runs are joined pairwise and never read as a union: a union of bucketed tables passes for bucketed itself in
    Spark 4.1 and then loses matches.
    """

    def __init__(self, spark: SparkSession, scratch: Scratch, min_docs: int = MIN_DOCS, fan_in: int = FAN_IN):
        self.spark, self.scratch, self.min_docs, self.fan_in = spark, scratch, min_docs, fan_in
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.settled: str | None = None

    def add(self, batch: DataFrame) -> None:
        """``batch``: one row ``k1, k2, doc_id`` per document and key; no document may come in two batches.

        What a batch brings is merged with the runs of every level that it fills in one step, so a batch writes one run and
        the settled run, however many levels are compacted.
        """
        keys = batch.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        new, settling = keys, []
        if self.settled:
            known = self.spark.table(self.settled).hint("merge")
            new = keys.join(known, KEY, "left_anti")
            settling.append(keys.join(known.select(*KEY), KEY, "left_semi"))
        level, old = 0, []
        while level < len(self.levels) and len(self.levels[level]) + 1 >= self.fan_in:
            old += self.levels[level]
            self.levels[level] = []
            level += 1
        if old:
            both = self._merged([*(self.spark.table(r) for r in old), new])
            new = both.filter(F.col("n_docs") < self.min_docs)
            settling.append(both.filter(F.col("n_docs") >= self.min_docs))
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(self._write(new))
        if settling:
            before = self.settled
            self.settled = self._write(self._merged([*([self.spark.table(before)] if before else []), *settling]))
            self._delete(*([before] if before else []))
        self._delete(*old)

    def frequent(self) -> DataFrame:
        """``k1, k2, last_doc`` of the keys found in at least ``min_docs`` documents, over all runs."""
        # A settled key may also have rows in older runs of other levels, so all are merged together.
        runs = [*([self.settled] if self.settled else []), *(r for level in self.levels for r in level)]
        return self._merged([self.spark.table(r) for r in runs]).filter(F.col("n_docs") >= self.min_docs).select(*KEY, "last_doc")

    def close(self) -> None:
        self._delete(*([self.settled] if self.settled else []), *(r for level in self.levels for r in level))

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        def two(a: DataFrame, b: DataFrame) -> DataFrame:
            b = b.select(*KEY, F.col("n_docs").alias("more_docs"), F.col("last_doc").alias("other_doc"))
            return a.hint("merge").join(b, KEY, "full").select(
                *KEY,
                (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more_docs", F.lit(0))).alias("n_docs"),
                F.greatest("last_doc", "other_doc").alias("last_doc"),
            )

        return reduce(two, runs)

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (
            df.select(*KEY, "n_docs", "last_doc")
            .repartition(self.buckets, *KEY)
            .write.bucketBy(self.buckets, *KEY)
            .sortBy(*KEY)
            .option("path", self.scratch.path(name))
            .saveAsTable(name)
        )
        return name

    def _delete(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.scratch.drop(name)


def repeated_lines(
    docs: DataFrame, scratch: Scratch, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES
) -> DataFrame:
    """``doc_id, dropped``: per document the keys (``k1, k2``) whose lines it loses."""
    spark = docs.sparkSession
    lines = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.explode(F.expr(_lines("text"))).alias("line"))
    keys = (
        lines.filter(F.char_length("line") >= min_chars)
        .select("doc_id", line_key(F.col("line")).alias("key"))
        .filter(F.char_length("key") >= min_chars)
        .select("doc_id", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2"))
        # partial: a row per document and key leaves each task, all rows of a document in one batch
        .groupBy("doc_id", *KEY)
        .agg(F.count("*").alias("n"))
        .select("doc_id", *KEY, F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"))
    )
    keys = scratch.save(keys, "keys", "batch")
    runs = LineRuns(spark, scratch, min_docs)
    for b in range(batches):
        runs.add(keys.filter(F.col("batch") == b).drop("batch"))
    frequent = scratch.save(runs.frequent(), "frequent")
    runs.close()
    return (
        keys.join(frequent, KEY)
        .filter(F.col("doc_id") != F.col("last_doc"))
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct(*KEY)).alias("dropped"))
    )


def dedup_lines(
    docs: DataFrame,
    scratch: Scratch,
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    batches: int = BATCHES,
    counts: tuple[str, str] | None = None,
) -> DataFrame:
    """All columns of ``docs`` with ``text`` rewritten; ``counts`` names two more, lines before and lines dropped.

    Lines whose key has at least ``min_chars`` code points and occurs in at least ``min_docs`` documents stay only in the
    document with the largest id that holds them. NULL or empty text is one empty line. Rows with a NULL id are not
    counted and keep every line; rows that share an id are one document. Text without a dropped line comes back
    as it was, NULL as NULL.
    """
    gone = scratch.save(repeated_lines(docs.select("doc_id", "text"), scratch, min_chars, min_docs, batches), "gone")
    own_id, own_keys, own_kept = (f"{n}_{uuid.uuid4().hex}" for n in ("id", "keys", "kept"))  # no clash with columns of docs
    gone = gone.select(F.col("doc_id").alias(own_id), F.col("dropped").alias(own_keys))
    # always by merge: a plan that broadcasts small sets would change with the size of the input
    joined = docs.join(gone.hint("merge"), docs["doc_id"] == gone[own_id], "left")
    lines = F.split(F.coalesce(docs["text"], F.lit("")), "\n", -1)

    def stays(line):
        key = line_key(line)
        return ~F.array_contains(F.col(own_keys), F.struct(F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(1), key).alias("k2")))

    some = F.col(own_keys).isNotNull()
    kept = F.when(some, F.filter(lines, lambda x: (F.char_length(x) < min_chars) | stays(x)))
    out = joined.withColumn(own_kept, kept)
    columns = [F.when(some, F.array_join(own_kept, "\n")).otherwise(docs[c]).alias(c) if c == "text" else docs[c] for c in docs.columns]
    if counts:
        total = F.size(lines).cast("long")
        columns += [total.alias(counts[0]), F.when(some, total - F.size(own_kept)).otherwise(F.lit(0)).cast("long").alias(counts[1])]
    return out.select(*columns)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs, Scratch(spark, "op1"), counts=("n_lines", "n_dropped"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, i, lines[i] AS line,
         translate(trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
f AS (SELECT k, max(doc_id) AS last_doc FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT l.doc_id, i, line, f.k IS NOT NULL AND l.doc_id <> last_doc AS gone FROM l LEFT JOIN f ON l.k = f.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INTEGER)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
