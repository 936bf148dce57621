"""SimHash near-dedup by anchor-point covering.

A fingerprint's first 46 bits are two words of 23 bits. The binary Golay code covers each word perfectly: every word
has exactly one codeword within distance 3. A pair of codewords is an *anchor* (2^24 of them), so a fingerprint has one
home anchor at covering radius 3 + 3. Of two fingerprints that differ in at most ``t`` bits, with ``t1`` and ``t2`` of them
in the two words, one lies within ``3 + t1`` and ``3 + t2`` of the other's home. Each fingerprint is
therefore replicated to every anchor within covering radius plus threshold (``t1 + t2 <= t``, 61 anchors on average at
``t = 2``), and each anchor compares its residents with its visitors on all 64 bits. No link is missed, and no all-pairs list
is formed: residents of an anchor are about (fingerprints / 2^24).

Equal fingerprints are one node from the start, so copies cost nothing; a node has at most ``sum(C(64, i), i <= t)``
neighbours, which bounds the links however large a group of near copies is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import Scratch, table

SHINGLE = 3
MAX_BITS = 2
SEED = 42
#: Generator polynomial of the perfect binary Golay code of length 23 and its covering radius.
GOLAY, WORD, RADIUS = 0b101011100011, 23, 3
#: Shingles hashed at once, so a very long text needs memory for its words alone.
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the word shingles, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    h = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        end = min(at + BLOCK, n)
        parts = [words[at + i : end + i] for i in range(min(shingle, len(words)))]
        hashes = np.array([h(b" ".join(s), SEED) for s in zip(*parts)], np.uint64)
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` of every row; ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word by the generator polynomial (11 bits)."""
    rest = words.astype(np.int64)
    for bit in range(WORD - 1, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GOLAY << (bit - 11)), rest)
    return rest


@cache
def _cosets(extra: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Error patterns up to weight 3 + ``extra`` sorted by syndrome: start of each syndrome, patterns, their excess over 3."""
    patterns, excess = [], []
    for weight in range(RADIUS + extra + 1):
        for bits in combinations(range(WORD), weight):
            patterns.append(sum(1 << b for b in bits))
            excess.append(max(0, weight - RADIUS))
    p, e = np.array(patterns, np.int64), np.array(excess, np.int8)
    s = _syndrome(p)
    order = np.lexsort((e, s))
    return np.searchsorted(s[order], np.arange((1 << 11) + 1)), p[order], e[order]


def _codewords(words: np.ndarray, extra: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codewords within 3 + ``extra`` of each word: index of the word, information bits of the codeword, excess."""
    start, patterns, excess = _cosets(extra)
    s = _syndrome(words)
    n = start[s + 1] - start[s]
    row = np.repeat(np.arange(len(words)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[s], n)
    return row, (words[row] ^ patterns[at]) >> 11, excess[at]


def anchors(fps: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every (row, anchor, excess) with the anchor within covering radius plus ``max_bits``; excess 0 is the home."""
    u = fps.view(np.uint64).astype(np.uint64)
    one = _codewords((u & np.uint64((1 << WORD) - 1)).astype(np.int64), max_bits)
    two = _codewords((u >> np.uint64(WORD) & np.uint64((1 << WORD) - 1)).astype(np.int64), max_bits)
    n2 = np.bincount(two[0], minlength=len(u))
    from2 = np.cumsum(n2) - n2
    row = np.repeat(one[0], n2[one[0]])
    first = np.repeat(np.arange(len(one[0])), n2[one[0]])
    per = n2[one[0]]
    second = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + from2[row]
    excess = one[2][first] + two[2][second]
    near = excess <= max_bits
    return row[near], (one[1][first] << 12 | two[1][second])[near].astype(np.int32), excess[near]


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``a, b``: every pair of different fingerprints of ``nodes.fp`` that differ in at most ``max_bits`` bits, ``a < b``."""

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), 4096):
                part = fps[at : at + 4096]
                row, anchor, excess = anchors(part, max_bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(part[row]), pa.array(excess == 0)], names=["anchor", "fp", "home"]
                )

    placed = nodes.select("fp").mapInArrow(replicate, "anchor int, fp long, home boolean")
    residents = placed.filter("home").select("anchor", F.col("fp").alias("a"))
    visitors = placed.select("anchor", F.col("fp").alias("b"))
    # each pair meets once: the larger visits the smaller's home
    near = F.expr(f"a < b and bit_count(a ^ b) <= {max_bits}")
    return residents.hint("merge").join(visitors, (residents["anchor"] == visitors["anchor"]) & near).select("a", "b")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``a, b``); the component is its smallest node.

    Alternating large-star and small-star steps: each links nodes to the smallest neighbour they know, and both
    are one join and one distinct. The number of rounds grows with the logarithm of the longest chain.
    """
    now = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star-0")
    step, before = 0, None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, f"large-{step}")
        # small star: each node's smaller neighbours and itself go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = scratch.save(small, f"star-{step + 1}")
        # order-free digest of the edges: unchanged means that only stars are left
        digest = after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("v", "u"), 24))).first()
        scratch.drop(f"star-{step}", f"large-{step}")
        now, step = after, step + 1
        if digest == before:
            break
        before = digest
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def near_duplicates(docs: DataFrame, scratch: Scratch, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fp, component_id`` of every row of ``docs``.

    NULL and empty texts have fingerprint 0 and link like any other. Rows with equal texts have equal fingerprints, so
    repeated rows share a component. NULL ids take part; the component's id is the smallest id that is there, NULL only if
    all are.
    """
    prints = scratch.save(fingerprints(docs, shingle), "fingerprints")
    nodes = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    edges = scratch.save(links(nodes, max_bits), "links")
    stars = components(edges, scratch)
    joined = stars.join(nodes.withColumnRenamed("fp", "node"), "node")
    least = joined.groupBy("component").agg(F.min("least_id").alias("component_id"))
    grouped = scratch.save(stars.join(least, "component").select(F.col("node").alias("fp"), "component_id"), "grouped")
    every = nodes.join(grouped, "fp", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id"))
    return prints.join(every, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, scratch: Scratch, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs``, all columns, whose id is the smallest of its component, one row per id.

    A row with a NULL id goes if its component has a row with an id; else it stays.
    """
    found = scratch.save(near_duplicates(docs, scratch, shingle, max_bits), "found")
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("near_dup_id")).distinct()
    kept = docs.join(gone, docs["doc_id"] == gone["near_dup_id"], "left_anti")
    ids = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("component_id").isNotNull()).alias("known"))
    odd = ids.agg(F.max(F.col("doc_id").isNotNull() & (F.col("n") > 1)), F.max(F.col("doc_id").isNull() & F.col("known"))).first()
    if odd[1]:  # NULL ids that copy a row with an id are told by their fingerprint
        nulls = docs.filter("doc_id is null")
        prints = found.filter("doc_id is not null").select(F.col("fp").alias("near_dup_fp")).distinct()
        linked = found.filter("doc_id is null and component_id is not null").select(F.col("fp").alias("near_dup_fp")).distinct()
        prints = prints.unionByName(linked).distinct()
        marked = nulls.withColumn("near_dup_own", _fingerprint_udf(shingle)(F.col("text")))
        nulls = marked.join(prints, marked["near_dup_own"] == prints["near_dup_fp"], "left_anti").drop("near_dup_own")
        kept = kept.filter("doc_id is not null").unionByName(nulls)
    if odd[0]:
        kept = kept.filter("doc_id is null").unionByName(kept.filter("doc_id is not null").dropDuplicates(["doc_id"]))
    return kept


def _fingerprint_udf(shingle: int):
    @F.pandas_udf("long")
    def own(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return own


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op4"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
