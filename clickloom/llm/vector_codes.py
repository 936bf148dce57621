"""Product codes of vectors by active-entry Lloyd rounds.

Components become integers ``floor(scale * x)``; a vector is cut into ``parts`` equal consecutive parts, and each part
position has a codebook of ``entries`` entries, first that part of the vectors with the smallest ids. A round assigns each
part to its nearest entry (squared distance, ties to the lower index) and then moves each used entry to the componentwise
``floor(sum / count)`` of its parts; unused entries stay.

Active entries: each row keeps its assigned entry and the exact distance to it. In the next assignment a part whose entry did
not move compares only the entries that moved with that stored distance (the others are where they were, so none of them
was nearer, or as near with a lower index); a part whose entry moved scans its whole codebook again. Ties keep the lower
index either way, so the result is that of plain Lloyd rounds.

Each assignment is one pass over the rows that writes the rows with their codes and distances to the shared folder, so a lost
executor costs one pass; the sums of a round are aggregated per (part, entry) from partial sums of each batch. Codebooks
are ``parts * entries * width`` integers, bounded by the parameters, and go to the tasks in the closure.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import Scratch, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096


def valid_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is not NULL and holds only finite, non-NULL components."""
    v = F.col(vector)
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return rows.filter(v.isNotNull() & ok)


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column of equal lengths as an int64 matrix."""
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(-1, width) if len(col) else np.zeros((0, width), np.int64)


def assign(x: np.ndarray, books: np.ndarray, codes: np.ndarray | None, dist: np.ndarray | None, moved: np.ndarray | None):
    """Nearest entries and their distances of all parts of ``x`` (rows, parts, width) in ``books`` (parts, entries, width).

    With ``codes``, ``dist`` of the last assignment and ``moved`` (parts, entries) of the last update, a part whose entry
    stayed compares only moved entries with its stored distance; the others scan every entry.
    """
    n, parts, _ = x.shape
    new_codes, new_dist = np.empty((n, parts), np.int64), np.empty((n, parts), np.int64)
    for p in range(parts):
        b = books[p]
        if codes is None:
            full = np.ones(n, bool)
        else:
            full = moved[p][codes[:, p]]
        if full.any():
            d = ((x[full, p, None, :] - b[None]) ** 2).sum(-1)
            best = d.argmin(1)  # first of equal minima: the lower index
            new_codes[full, p], new_dist[full, p] = best, d[np.arange(len(best)), best]
        stay = ~full
        if stay.any():
            c, s = codes[stay, p].copy(), dist[stay, p].copy()
            for e in np.nonzero(moved[p])[0]:
                d = ((x[stay, p] - b[e]) ** 2).sum(-1)
                better = (d < s) | ((d == s) & (e < c))
                c[better], s[better] = e, d[better]
            new_codes[stay, p], new_dist[stay, p] = c, s
    return new_codes, new_dist


class Coder:
    """Runs the rounds over a saved table ``row, vec_id, label, q`` (``q``: integer components)."""

    def __init__(self, scratch: Scratch, width: int, parts: int = PARTS):
        self.scratch, self.width, self.parts = scratch, width, parts

    def _pass(self, rows: DataFrame, books: np.ndarray, moved: np.ndarray | None, name: str) -> DataFrame:
        width, parts, first = self.width, self.parts, moved is None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _matrix(b.column("q"), width).reshape(-1, parts, width // parts)
                codes = None if first else _matrix(b.column("codes"), parts)
                dist = None if first else _matrix(b.column("dist"), parts)
                c, d = assign(x, books, codes, dist, moved)
                listed = [pa.ListArray.from_arrays(np.arange(0, (len(c) + 1) * parts, parts, dtype=np.int32), pa.array(a.ravel())) for a in (c, d)]
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("vec_id"), b.column("label"), b.column("q"), *listed], names=["row", "vec_id", "label", "q", "codes", "dist"])

        schema = "row long, vec_id long, label int, q array<long>, codes array<long>, dist array<long>"
        return self.scratch.save(rows.select("row", "vec_id", "label", "q", *([] if first else ["codes", "dist"])).mapInArrow(run, schema), name)

    def _sums(self, coded: DataFrame) -> DataFrame:
        """``part, entry, n, sums`` over all rows, from partial sums of each batch."""
        width, parts = self.width, self.parts
        step = width // parts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _matrix(b.column("q"), width).reshape(-1, parts, step)
                codes = _matrix(b.column("codes"), parts)
                out = []
                for p in range(parts):
                    entries, at = np.unique(codes[:, p], return_inverse=True)
                    sums = np.zeros((len(entries), step), np.int64)
                    np.add.at(sums, at, x[:, p])
                    counts = np.bincount(at, minlength=len(entries))
                    out += [(p, int(e), int(c), s.tolist()) for e, c, s in zip(entries, counts, sums, strict=True)]
                if out:
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(pa.int64()))],
                        names=["part", "entry", "n", "sums"],
                    )

        partial = coded.select("q", "codes").mapInArrow(run, "part int, entry int, n long, sums array<long>")
        per_pos = partial.select("part", "entry", "n", F.posexplode("sums").alias("pos", "s"))
        counts = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"))
        sums = per_pos.groupBy("part", "entry", "pos").agg(F.sum("s").alias("s"))
        return sums.join(counts, ["part", "entry"])

    def update(self, coded: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """New codebooks (used entries at the floor of their mean) and which entries moved."""
        new = books.copy()
        for r in self._sums(coded).collect():  # at most parts * entries * width rows
            new[r["part"], r["entry"], r["pos"]] = r["s"] // r["n"]
        return new, (new != books).any(-1)

    def run(self, rows: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
        coded, moved = self._pass(rows, books, None, "coded-0"), None
        for r in range(rounds):
            books, moved = self.update(coded, books)
            previous, coded = coded, self._pass(coded, books, moved, f"coded-{r + 1}")
            self.scratch.drop(f"coded-{r}")
            del previous
        return coded, books


def codebook_digest(books: np.ndarray) -> str:
    """sha256 of all components by part, entry and position, in decimal, comma-joined."""
    return hashlib.sha256(",".join(str(int(v)) for v in books.ravel()).encode()).hexdigest()


def compress(
    vectors: DataFrame, scratch: Scratch, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """Codes of ``vectors`` (``vec_id, embedding, label``) and the final codebooks (parts, entries, width).

    Rows with a NULL vector or a NULL or non-finite component are left out; all others are coded, rows with a NULL or
    repeated id and NULL labels included. Vectors must all have one length, a multiple of ``parts`` (the length of the
    first kept vector; others raise). Fewer than ``entries`` rows give as many entries as rows; no rows give an empty
    result and an empty codebook. The result: ``vec_id, label, code`` (two hex digits per part), ``error`` (final squared
    distances summed over parts).
    """
    kept = valid_vectors(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"), F.col("label").cast("int").alias("label")))
    q = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long"))
    rows = scratch.save(kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", q.alias("q")), "rows")
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "row").limit(entries).select("q").collect()
    lengths = rows.agg(F.min(F.size("q")), F.max(F.size("q"))).first()
    if not seeds:
        empty = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return empty, np.zeros((parts, 0, 0), np.int64)
    width = len(seeds[0]["q"])
    if lengths[0] != width or lengths[1] != width or width % parts:
        raise ValueError(f"vectors of lengths {lengths[0]} to {lengths[1]} cannot be cut into {parts} equal parts")
    books = np.array([s["q"] for s in seeds], np.int64).reshape(len(seeds), parts, width // parts).transpose(1, 0, 2).copy()
    coded, books = Coder(scratch, width, parts).run(rows, books, rounds)
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    error = F.aggregate("dist", F.lit(0).cast("long"), lambda a, d: a + d)
    return coded.select("vec_id", "label", code.alias("code"), error.alias("error")), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"), Scratch(spark, "op13"))
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    joined = coded.join(by_label, coded["label"].eqNullSafe(by_label["label"])).drop(by_label["label"])
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))
