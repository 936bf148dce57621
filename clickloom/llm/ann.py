"""Approximate nearest neighbours by cosine over robust-pruned directed graphs.

Different vectors are dealt by hash to shards of about ``SHARD_ROWS``; each shard becomes one directed graph, built in
one task of bounded size. A vector is inserted by a greedy beam search from fixed entry points; what the search proposes is pruned
with the relaxed rule (a candidate goes if it is ``ALPHA`` times nearer to a kept neighbour than to the vector), which keeps
diverse edges, and back edges are pruned the same way. A query beam-searches every shard; the proposals of all shards are
scored again in double precision on the original vectors.

Equal vectors are one node, which carries the few smallest ids that any result can need, so copies cost nothing. Queries go to
shards in blocks of about ``BLOCK``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickloom.llm.common import Scratch, table

SHARD_ROWS = 8192
DEGREE, BEAM, ALPHA = 32, 64, 1.2
#: Entry points of a shard; nodes expanded at once; vectors inserted at once.
ENTRIES, EXPAND, INSERT = 32, 4, 256
BLOCK = 1024
#: Proposals of a shard for each query, beside the number of results asked for.
SPARE = 11


class Graph:
    """Unit vectors ``x`` (float32) and up to ``degree`` out-edges each (-1: none)."""

    def __init__(self, x: np.ndarray, edges: np.ndarray, entries: np.ndarray):
        self.x, self.edges, self.entries = x, edges, entries

    def search(self, queries: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Node numbers and similarities of the ``beam`` best found for each query, best first (-1, -inf: none)."""
        q, n = len(queries), len(self.x)
        ids = np.tile(self.entries.astype(np.int32), (q, 1))
        sims = queries @ self.x[self.entries].T
        width = max(beam, ids.shape[1])
        ids = np.pad(ids, ((0, 0), (0, width - ids.shape[1])), constant_values=-1)
        sims = np.pad(sims, ((0, 0), (0, width - sims.shape[1])), constant_values=-np.inf)
        seen = np.zeros((q, n + 1), bool)  # the last column stands for no node
        seen[:, self.entries] = True
        seen[:, n] = True
        done = ids < 0
        row = np.arange(q)[:, None]
        while True:
            order = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
            ids, sims, done = (np.take_along_axis(a, order, 1) for a in (ids, sims, done))
            # sims are sorted, so the first nodes not expanded are the best
            rank = np.where(done, beam, np.arange(ids.shape[1]))
            pick = np.sort(np.partition(rank, min(EXPAND, rank.shape[1] - 1), axis=1)[:, :EXPAND], axis=1)
            active = (pick < beam).any(1)
            if not active.any():
                return ids, sims
            safe = np.minimum(pick, ids.shape[1] - 1)
            chosen = np.where(pick < beam, np.take_along_axis(ids, safe, 1), -1)
            flags = np.zeros((q, ids.shape[1] + 1), bool)
            np.put_along_axis(flags, np.minimum(pick, ids.shape[1]), True, 1)
            done |= flags[:, :-1]
            near = np.where((chosen >= 0)[:, :, None], self.edges[chosen], -1).reshape(q, -1)
            near = np.sort(np.where(near < 0, n, near), axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = n
            near[np.take_along_axis(seen, near, 1)] = n
            seen[row, near] = True
            new = near < n
            at = np.nonzero(new)
            found = np.full(near.shape, -np.inf, np.float32)
            found[at] = np.einsum("ij,ij->i", queries[at[0]], self.x[near[at]])
            ids = np.concatenate([ids, np.where(new, near, -1).astype(np.int32)], 1)
            sims = np.concatenate([sims, found], 1)
            done = np.concatenate([done, ~new], 1)


def robust_prune(x: np.ndarray, points: np.ndarray, pool: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` diverse neighbours of each point from its ``pool`` (-1: none)."""
    alive = (pool >= 0) & (pool != points[:, None])
    safe = np.maximum(pool, 0)
    own = np.where(alive, np.maximum(0, 2 - 2 * np.einsum("ij,ikj->ik", x[points], x[safe])), np.inf)
    order = np.argsort(own, axis=1, kind="stable")
    pool, own, alive = (np.take_along_axis(a, order, 1) for a in (pool, own, alive))
    vectors = x[np.maximum(pool, 0)]
    apart = np.maximum(0, 2 - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1)))
    out = np.full((len(points), degree), -1, np.int32)
    rows = np.arange(len(points))
    for k in range(degree):
        first = alive.argmax(1)
        some = alive[rows, first]
        if not some.any():
            break
        out[:, k] = np.where(some, pool[rows, first], -1)
        # squared distances, so alpha is squared too; the kept one is at distance 0 from itself
        alive &= ~(alpha * alpha * apart[rows, first] <= own) | ~some[:, None]
        alive[rows, first] = False
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 0) -> Graph:
    """The graph of unit vectors ``x``; the same input gives the same graph."""
    n, rng = len(x), np.random.default_rng(seed)
    medoid = int((x @ x.mean(0)).argmax())
    entries = np.unique(np.append(rng.choice(n, min(n, ENTRIES), replace=False), medoid))
    edges = np.full((n, 2 * degree), -1, np.int32)  # room for back edges until they are pruned
    if n > 1:
        start = rng.integers(0, n - 1, (n, min(degree // 2, n - 1)))
        edges[:, : start.shape[1]] = start + (start >= np.arange(n)[:, None])
    fill = (edges >= 0).sum(1)
    graph = Graph(x, edges, entries)
    for at in range(0, n, INSERT):
        if at == 0:
            order = rng.permutation(n)
        points = order[at : at + INSERT]
        found, _ = graph.search(x[points], beam)
        pool = np.concatenate([found, edges[points]], 1)
        ordered = np.sort(pool, axis=1)
        ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]] = -1
        kept = robust_prune(x, points, ordered, degree, alpha)
        edges[points] = -1
        edges[points, :degree] = kept
        fill[points] = (kept >= 0).sum(1)
        source, target = np.repeat(points, degree), kept.ravel()
        source, target = source[target >= 0], target[target >= 0]
        back = np.argsort(target, kind="stable")
        for s, t in zip(source[back].tolist(), target[back].tolist()):
            if (edges[t, : fill[t]] == s).any():
                continue
            if fill[t] == 2 * degree:
                edges[t, :degree] = robust_prune(x, np.array([t]), edges[t : t + 1], degree, alpha)[0]
                edges[t, degree:] = -1
                fill[t] = (edges[t] >= 0).sum()
            edges[t, fill[t]] = s
            fill[t] += 1
    full = np.flatnonzero(fill > degree)
    for at in range(0, len(full), INSERT):
        part = full[at : at + INSERT]
        edges[part, :degree] = robust_prune(x, part, edges[part], degree, alpha)
    graph.edges = np.ascontiguousarray(edges[:, :degree])
    return graph


def valid_vector(name: str) -> Column:
    """Not NULL, no NULL or non-finite component, not zero."""
    return F.expr(
        f"""{name} is not null and not exists({name}, v -> v is null or isnan(v) or abs(v) = double('infinity'))
            and exists({name}, v -> v <> 0)"""
    )


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # squares of very large or small components stay finite
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def cosine(a: str, b: str) -> Column:
    """In double precision on the original components."""
    dot = "aggregate(zip_with({0}, {1}, (x, y) -> double(x) * double(y)), 0d, (s, v) -> s + v)"
    return F.expr(f"{dot.format(a, b)} / (sqrt({dot.format(a, a)}) * sqrt({dot.format(b, b)}))")


def search(vectors: DataFrame, scratch: Scratch, is_query: Column, k: int = 5, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest other rows found for every row of ``vectors`` that is a query.

    ``vectors`` has ``vec_id, embedding``. Invalid vectors and NULL ids take no part; vectors are compared with those of the same
    dimension. Rows that repeat an id and vector count once. Ties go to the smaller id. With fewer candidates all are returned.
    """
    spark = vectors.sparkSession
    rows = vectors.filter(F.col("vec_id").isNotNull() & valid_vector("embedding")).select("vec_id", "embedding")
    rows = scratch.save(rows.distinct(), "rows")
    # any result needs at most k members of a node beside the query itself
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    members = rows.withColumn("place", place).filter(F.col("place") <= k + 1)
    nodes = members.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    nodes = scratch.save(
        nodes.select(F.xxhash64("embedding").alias("h"), F.size("embedding").alias("dim"), "embedding", "members"), "nodes"
    ).withColumn("node", F.col("members")[0])
    per_dim = {r[0]: r[1] for r in nodes.groupBy("dim").count().collect()}
    if not per_dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards = {d: max(1, math.ceil(n / shard_rows)) for d, n in per_dim.items()}
    count = F.expr("case dim " + " ".join(f"when {d} then {s}" for d, s in shards.items()) + " end")
    n_shards = sum(shards.values())
    sharded = nodes.select("node", "embedding", "dim", F.pmod("h", count).cast("int").alias("shard"))

    def index(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        graph = build(_unit(np.stack(rows["embedding"].to_numpy())))
        blob = {
            "ids": rows["node"].to_numpy(np.int64).tobytes(),
            "x": graph.x.tobytes(),
            "edges": graph.edges.tobytes(),
            "entries": graph.entries.astype(np.int64).tobytes(),
        }
        return pd.DataFrame([{"dim": int(rows["dim"].iloc[0]), "shard": int(rows["shard"].iloc[0]), **blob}])

    schema = "dim int, shard int, ids binary, x binary, edges binary, entries binary"
    graphs = scratch.save(sharded.repartition(4 * n_shards, "dim", "shard").groupBy("dim", "shard").applyInPandas(index, schema), "graphs")

    queries = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.size("embedding").alias("dim"))
    queries = scratch.save(queries, "queries")
    blocks = max(1, math.ceil(queries.count() / BLOCK))
    packed = queries.groupBy("dim", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("query_id", "query")).alias("queries"))
    every = F.expr("sequence(0, " + "case dim " + " ".join(f"when {d} then {s}" for d, s in shards.items()) + " end - 1)")
    jobs = packed.select("dim", "queries", F.explode(every).alias("shard")).join(graphs.hint("merge"), ["dim", "shard"])

    def beam(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                ids = np.frombuffer(r.ids, np.int64)
                x = np.frombuffer(r.x, np.float32).reshape(len(ids), -1)
                graph = Graph(x, np.frombuffer(r.edges, np.int32).reshape(len(ids), -1), np.frombuffer(r.entries, np.int64))
                asked = np.array([q["query_id"] for q in r.queries], np.int64)
                unit = _unit(np.stack([np.asarray(q["query"], np.float64) for q in r.queries]))
                for at in range(0, len(asked), 256):
                    found, sims = graph.search(unit[at : at + 256], BEAM)
                    found, sims = found[:, : k + SPARE], sims[:, : k + SPARE]
                    row, col = np.nonzero(found >= 0)
                    yield pd.DataFrame({"query_id": asked[at : at + 256][row], "node": ids[found[row, col]], "near": sims[row, col]})

    proposals = jobs.repartition(4 * n_shards, "dim", "shard", F.xxhash64("queries")).select("ids", "x", "edges", "entries", "queries")
    proposals = scratch.save(proposals.mapInPandas(beam, "query_id long, node long, near float"), "proposals")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "node"))
    best = proposals.withColumn("place", best).filter(F.col("place") <= k + SPARE).select("query_id", "node")
    # the query's own node is scored too, so copies of a query are found whatever the graph proposes
    own = queries.join(nodes.select("embedding", "node"), F.col("query") == F.col("embedding")).select("query_id", "node")
    scored = (
        best.unionByName(own)
        .distinct()
        .join(nodes.select("node", "embedding", "members"), "node")
        .join(queries.select("query_id", "query"), "query_id")
        .select("query_id", cosine("query", "embedding").alias("score"), F.explode("members").alias("vec_id"))
        .filter("vec_id <> query_id")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), Scratch(spark, "op9"), F.col("vec_id") % 50 == 0)
