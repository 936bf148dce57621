"""Stupid-backoff scores: count tables partitioned by n-gram hash, joined to exploded n-grams, summed per document.

Documents are dealt into blocks. A block explodes its texts into n-grams and brings them to one entry per different n-gram,
so however common an n-gram is, it is one entry per block. Entries go, packed by hash bucket, to the partition of the count
table that holds them; there counts of all blocks are summed and joined back to the entries that asked. The block then
holds the corpus count of every n-gram of its documents and sums their scores.

With ``c`` the corpus counts, ``m`` the smallest count that an n-gram above order 1 must have to be in the table, and ``a`` the
backoff factor, a token scores the logarithm of::

    c(w1..wk) / c(w1..wk-1)       for the longest k whose n-gram is in the table, times a per order backed off
    a^(order - 1) * c(wk) / N     if none is

All counts cover all documents; what moves grows with the input.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import Scratch, table

ORDER = 2
MIN_COUNT = 2
BACKOFF = 0.4
#: Bytes of text in a block, and bytes of text for which the count table gets a bucket.
BLOCK_BYTES, BUCKET_BYTES = 10_000_000, 8_000_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def token_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words (runs without ASCII white space, A-Z lower-cased)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def exploded(texts: list[str | None], order: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Document number of each token; per order the hash of the n-gram that ends there (0: none); token counts."""
    hashes = [token_hashes(t) for t in texts]
    sizes = np.array([len(h) for h in hashes], np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    grams, h = [], flat
    for n in range(1, order + 1):
        if n > 1:
            h = np.concatenate([np.zeros(min(1, len(flat)), np.uint64), h[:-1]]) * _MULTIPLIER + flat
        mixed = (h + np.uint64(n)) * _MIX
        mixed ^= mixed >> np.uint64(32)
        grams.append(np.where(place >= n - 1, np.maximum(mixed, np.uint64(1)), np.uint64(0)))
    return doc, grams, sizes


def entries(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different n-grams of all orders, the entry of each token and order, and how often each entry occurs."""
    every = np.concatenate(grams)
    u, at, n = np.unique(every, return_inverse=True, return_counts=True)
    if len(u) and u[0] == 0:
        n[0] = 0
    return u, at.reshape(len(grams), -1), n


def buckets_of(u: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the entries by bucket, and where each bucket starts in it."""
    bucket = ((u >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def sum_scores(doc: np.ndarray, counts: np.ndarray, docs: int, total: int, min_count: int, backoff: float) -> np.ndarray:
    """Per document the sum of the tokens' log scores. ``counts``: corpus count by order and token (0: no such n-gram)."""
    order = len(counts)
    score = np.log(np.maximum(counts[0], 1) / max(1, total)) + (order - 1) * math.log(backoff)
    for n in range(2, order + 1):
        seen = counts[n - 1] >= min_count
        context = np.concatenate([np.ones(1, np.int64), counts[n - 2][:-1]])[: len(seen)]
        better = np.log(np.maximum(counts[n - 1], 1) / np.maximum(context, 1)) + (order - n) * math.log(backoff)
        score = np.where(seen, better, score)
    return np.bincount(doc, score, docs)


def lm_scores(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, backoff: float = BACKOFF) -> DataFrame:
    """``doc_id, n_tokens, score, mean_log`` of every row of ``docs``; ``score`` is the sum of log scores.

    NULL and empty texts have no tokens, score 0 and a NULL mean. Repeated rows count as often as they occur; rows with
    a NULL id are scored. An empty table gives an empty result.
    """
    words = F.expr(r"size(filter(split(coalesce(text, ''), '[\\x09-\\x0D ]+'), w -> w <> ''))")
    size, total = docs.select(F.sum(F.octet_length("text")), F.sum(words)).first()
    blocks, buckets = max(1, math.ceil((size or 0) / BLOCK_BYTES)), max(1, math.ceil((size or 0) / BUCKET_BYTES))
    total = int(total or 0)
    dealt = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block")
    )

    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        u, _, n = entries(exploded(rows["text"].tolist(), order)[1])
        by, start = buckets_of(u, buckets)
        some = np.flatnonzero(np.diff(start))
        return pd.DataFrame(
            {
                "block": int(rows["block"].iloc[0]),
                "bucket": some,
                "grams": [u[by[start[b] : start[b + 1]]].tobytes() for b in some],
                "n": [n[by[start[b] : start[b + 1]]].astype(np.int64).tobytes() for b in some],
            }
        )

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        grams = [np.frombuffer(g, np.uint64) for g in rows["grams"]]
        _, at = np.unique(np.concatenate(grams), return_inverse=True)
        sums = np.zeros(int(at.max()) + 1, np.int64)
        np.add.at(sums, at, np.concatenate([np.frombuffer(n, np.int64) for n in rows["n"]]))
        parts = np.split(sums[at], np.cumsum([len(g) for g in grams])[:-1])
        return pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], "counts": [p.tobytes() for p in parts]})

    def score(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        doc, grams, sizes = exploded(rows["text"].tolist(), order)
        u, at, _ = entries(grams)
        by, _ = buckets_of(u, buckets)
        counts = np.zeros(len(u), np.int64)
        if len(answers):
            counts[by] = np.concatenate([np.frombuffer(c, np.int64) for c in answers.sort_values("bucket")["counts"]])
        summed = sum_scores(doc, counts[at], len(rows), total, min_count, backoff)
        return pd.DataFrame(
            {
                "doc_id": rows["doc_id"],
                "n_tokens": sizes,
                "score": summed,
                "mean_log": np.where(sizes > 0, summed / np.maximum(sizes, 1), np.nan),
            }
        )

    asked = dealt.groupBy("block").applyInPandas(ask, "block int, bucket int, grams binary, n binary")
    answered = asked.groupBy("bucket").applyInPandas(count, "block int, bucket int, counts binary")
    # both sides of the block grouping read the same shuffle of the documents
    out = dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInPandas(score, "doc_id long, n_tokens long, score double, mean_log double")
    return out.withColumn("mean_log", F.expr("if(isnan(mean_log), null, mean_log)"))


def rounded(out: DataFrame) -> DataFrame:
    # sums of doubles depend on their order in the last digits
    return out.select("doc_id", "n_tokens", F.round("score", 4).alias("score"), F.round("mean_log", 6).alias("mean_log"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lm_scores(table(spark, sf_dir, "documents")))


def op7_lm_scoring_order3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lm_scores(table(spark, sf_dir, "documents"), 3))


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D ]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT doc_id, w[i] AS b, CASE WHEN i > 1 THEN w[i - 1] END AS a
      FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
u AS (SELECT b AS word, count(*) AS c FROM t GROUP BY b),
p AS (SELECT a, b, count(*) AS c FROM t WHERE a IS NOT NULL GROUP BY a, b HAVING count(*) >= 2),
s AS (SELECT t.doc_id, CASE WHEN p.c IS NOT NULL THEN ln(p.c / ua.c)
             ELSE ln(ub.c / (SELECT CAST(count(*) AS DOUBLE) FROM t)) + ln(0.4) END AS x
      FROM t JOIN u ub ON t.b = ub.word LEFT JOIN u ua ON t.a = ua.word LEFT JOIN p ON t.a = p.a AND t.b = p.b),
g AS (SELECT doc_id, sum(x) AS x FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_tokens, round(coalesce(x, 0), 4) AS score,
       round(x / len(w), 6) AS mean_log FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""

SQL_ORDER3 = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D ]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT doc_id, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a
      FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
u AS (SELECT c AS word, count(*) AS n FROM t GROUP BY c),
p AS (SELECT b, c, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY b, c HAVING count(*) >= 2),
q AS (SELECT a, b, c, count(*) AS n FROM t WHERE a IS NOT NULL GROUP BY a, b, c HAVING count(*) >= 2),
s AS (SELECT t.doc_id, CASE WHEN q.n IS NOT NULL THEN ln(q.n / pa.n)
             WHEN p.n IS NOT NULL THEN ln(p.n / ub.n) + ln(0.4)
             ELSE ln(uc.n / (SELECT CAST(count(*) AS DOUBLE) FROM t)) + 2 * ln(0.4) END AS x
      FROM t JOIN u uc ON t.c = uc.word LEFT JOIN u ub ON t.b = ub.word LEFT JOIN p ON t.b = p.b AND t.c = p.c
      LEFT JOIN p pa ON t.a = pa.b AND t.b = pa.c LEFT JOIN q ON t.a = q.a AND t.b = q.b AND t.c = q.c),
g AS (SELECT doc_id, sum(x) AS x FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_tokens, round(coalesce(x, 0), 4) AS score,
       round(x / len(w), 6) AS mean_log FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
