"""Hard negatives by zone maps over Hilbert-ordered blocks of candidates.

Candidates (integer vectors, ``floor(scale * x)``) are range-partitioned and sorted by (label, Hilbert index of their first
coordinates, id), and cut into blocks of at most ``BLOCK`` rows of one label; the blocks are written once to the shared
folder. Each block has a zone map: its row count and the minimum and maximum of every component. For an anchor ``a`` interval
arithmetic bounds the inner product of any row of a block: ``sum(a_d * (min_d if a_d >= 0 else max_d))`` below and the
mirror above.

Positives: among the anchor's label, blocks sorted by lower bound tell how low the fifth best score can be (the lower bound
of the block where the counted rows reach five); only blocks whose upper bound reaches it are read. Negatives: for each
positive with score ``p`` the window ``50 p <= 100 s <= 95 p``; blocks of other labels wholly inside it bound the third best
score from below, and only blocks that meet the window and reach that bound are read. Rows of the blocks read are scored
exactly; the first by score (higher first, ties by smaller id) are kept. Nothing is cut: a bound only skips blocks that
cannot hold a result.

Anchors meet zone maps in groups of about ``ANCHORS`` anchors (a stated query set against all blocks); rows of a block meet
only the anchors that chose it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from clickloom.llm.common import Scratch, table

SCALE, ANCHOR_EVERY, RELABEL_EVERY, LABELS = 256, 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
#: The window of a negative: LOW * p <= 100 * s <= HIGH * p.
LOW, HIGH = 50, 95
#: Rows of a block; anchors that meet blocks together; blocks of a tile that anchors meet together.
BLOCK, ANCHORS, TILE = 256, 2048, 64
#: Coordinates and bits of each in the Hilbert index (at most 63 bits in all).
CURVE_DIMS, CURVE_BITS = 8, 7


def hilbert_index(x: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of points ``x`` (rows, dims) of non-negative integers below ``2 ** bits`` (Skilling's transform)."""
    x = x.astype(np.uint64).copy()
    n, dims = x.shape
    top = np.uint64(1 << (bits - 1))
    q = top
    while q > 1:
        p = q - np.uint64(1)
        for i in range(dims):
            on = (x[:, i] & q) != 0
            x[on, 0] ^= p
            off = ~on
            t = (x[off, 0] ^ x[off, i]) & p
            x[off, 0] ^= t
            x[off, i] ^= t
        q >>= np.uint64(1)
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(n, np.uint64)
    q = top
    while q > 1:
        t[(x[:, dims - 1] & q) != 0] ^= q - np.uint64(1)
        q >>= np.uint64(1)
    x ^= t[:, None]
    key = np.zeros(n, np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << np.uint64(1)) | ((x[:, i] >> np.uint64(b)) & np.uint64(1))
    return key.astype(np.int64)


def _curve(dims: int, bits: int):
    """Hilbert index of the first ``dims`` components, each shifted from about ``[-SCALE, SCALE)`` into ``bits`` bits."""
    shift = max(0, int(math.log2(2 * SCALE)) - bits)

    @F.pandas_udf(LongType())
    def curve(*cols: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(np.int64) for c in cols], 1)
        u = np.clip((x + SCALE) >> shift, 0, (1 << bits) - 1)
        return pd.Series(hilbert_index(u, bits))

    return curve


def candidates(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """``rid, vec_id, label, q`` of rows that take part: label, vector and every component present and finite.

    Where ``vec_id`` is divisible by ``RELABEL_EVERY`` the label becomes ``(label + 1) % LABELS``. Vectors shorter than the
    longest are padded with zeros. ``rid`` tells repeated rows apart.
    """
    v = F.col("embedding")
    ok = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding"), F.col("label").cast("long").alias("label"))
    rows = rows.filter(ok & F.col("label").isNotNull())
    moved = F.when(F.pmod(F.col("vec_id"), F.lit(RELABEL_EVERY)) == 0, F.pmod(F.col("label") + 1, F.lit(LABELS))).otherwise(F.col("label"))
    q = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long"))
    return rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", moved.alias("label"), q.alias("q"))


def blocks(rows: DataFrame, scratch: Scratch, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Rows with their block (``blk``, written in curve order) and the zone maps ``label, blk, n, lo, hi`` of the blocks."""
    width = rows.agg(F.max(F.size("q"))).first()[0] or 0
    padded = rows.withColumn("q", F.concat("q", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("q"))))
    dims = min(CURVE_DIMS, width)
    coords = [F.coalesce(F.try_element_at("q", F.lit(i + 1)), F.lit(0)) for i in range(dims)]
    keyed = padded.withColumn("hkey", _curve(dims, CURVE_BITS)(*coords) if dims else F.lit(0).cast("long"))
    ordered = keyed.repartitionByRange("label", "hkey", "vec_id", "rid").sortWithinPartitions("label", "hkey", "vec_id", "rid")
    # the place in a sorted part is fixed once the part is: a block never spans parts or labels
    mid = F.monotonically_increasing_id()
    placed = ordered.select("rid", "vec_id", "label", "q", ((mid.bitwiseAND(F.lit((1 << 33) - 1)) / F.lit(block)).cast("long") + F.shiftleft(F.shiftright(mid, 33), 30)).alias("blk"))
    stored = scratch.save(placed, "blocks")
    per_pos = stored.select("label", "blk", F.posexplode("q").alias("pos", "v")).groupBy("label", "blk", "pos").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    spans = per_pos.groupBy("label", "blk").agg(F.sort_array(F.collect_list(F.struct("pos", "lo", "hi"))).alias("z"))
    counts = stored.groupBy("label", "blk").agg(F.count(F.lit(1)).alias("n"))
    zones = spans.join(counts, ["label", "blk"]).select("label", "blk", "n", F.col("z.lo").alias("lo"), F.col("z.hi").alias("hi"))
    return stored, scratch.save(zones, "zones")


def _mat(values) -> np.ndarray:
    return np.stack([np.asarray(v, np.int64) for v in values]) if len(values) else np.zeros((0, 0), np.int64)


def _tiled(left: DataFrame, right: DataFrame, fn, schema: str) -> DataFrame:
    """Calls ``fn(left, right)`` with pandas frames of each (``grp``, ``tile``) that both sides hold."""
    return left.groupBy("grp", "tile").cogroup(right.groupBy("grp", "tile")).applyInPandas(fn, schema)


def _bounds(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Lower and upper bounds of the score of every anchor of ``left`` over every zone map of ``right``."""
    names = ["a_rid", "a_label", "a_blk", "label", "blk", "n", "low", "high"]
    if left.empty or right.empty:
        return pd.DataFrame({c: pd.Series([], dtype="int64") for c in names})
    a, lo, hi = _mat(left["a_q"].values), _mat(right["lo"].values), _mat(right["hi"].values)
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    low, high = up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T
    na, nz = len(a), len(lo)
    out = {
        "a_rid": np.repeat(left["a_rid"].to_numpy(np.int64), nz), "a_label": np.repeat(left["a_label"].to_numpy(np.int64), nz),
        "a_blk": np.repeat(left["a_blk"].to_numpy(np.int64), nz), "label": np.tile(right["label"].to_numpy(np.int64), na),
        "blk": np.tile(right["blk"].to_numpy(np.int64), na), "n": np.tile(right["n"].to_numpy(np.int64), na),
        "low": low.ravel(), "high": high.ravel(),
    }
    return pd.DataFrame(out)


def _best(left: pd.DataFrame, right: pd.DataFrame, keep: int, window: bool) -> pd.DataFrame:
    """Exact scores of the rows of ``right`` in the blocks each key of ``left`` chose; the first ``keep`` of each key.

    Keys are anchors (positives: rows other than the anchor itself) or (anchor, positive) pairs (negatives: rows inside the
    positive's window). Order: score down, then id, then row.
    """
    names = ["a_rid", "p_rid", "rid", "vec_id", "no_id", "score"]
    empty = pd.DataFrame({c: pd.Series([], dtype=bool if c == "no_id" else "int64") for c in names})
    anchors, chosen = left[left["kind"] == 0], left[left["kind"] == 1]
    if anchors.empty or chosen.empty or right.empty:
        return empty
    at = {r: i for i, r in enumerate(anchors["a_rid"].to_numpy(np.int64))}
    scores = _mat(anchors["a_q"].values) @ _mat(right["q"].values).T
    # ids come without NULLs (``no_id`` marks them), so pandas keeps them as exact integers
    rid, vec, no_id = right["rid"].to_numpy(np.int64), right["vec_id"].to_numpy(np.int64), right["no_id"].to_numpy(bool)
    rows_of = {k: np.asarray(v) for k, v in right.groupby(["label", "blk"]).indices.items()}
    out = []
    keys = ["a_rid", "p_rid"] if window else ["a_rid"]
    for key, part in chosen.groupby(keys, sort=False):
        a_rid = int(key[0] if window else key if np.isscalar(key) else key[0])
        blocks_of = zip(part["b_label"].to_numpy(np.int64), part["blk"].to_numpy(np.int64), strict=True)
        cols = np.concatenate([rows_of[b] for b in blocks_of if b in rows_of] or [np.zeros(0, np.int64)])
        s = scores[at[a_rid], cols]
        if window:
            p = int(part["p_score"].iloc[0])
            ok = (LOW * p <= 100 * s) & (100 * s <= HIGH * p)
        else:
            ok = rid[cols] != a_rid
        cols, s = cols[ok], s[ok]
        first = np.lexsort((rid[cols], vec[cols], no_id[cols], -s))[:keep]
        p_rid = int(key[1]) if window else -1
        out += [(a_rid, p_rid, int(rid[cols[j]]), int(vec[cols[j]]), bool(no_id[cols[j]]), int(s[j])) for j in first]
    return pd.DataFrame(out, columns=names) if out else empty


def _spread(anchors: DataFrame, stored: DataFrame, scratch: Scratch, name: str, extra: list[str]) -> tuple[DataFrame, DataFrame]:
    """Left (anchors and their chosen blocks) and right (block rows) sides, each sent only where the other needs it.

    ``name``: the saved table of chosen blocks, read once for each side.
    """
    chosen, again = (scratch.spark.read.parquet(scratch.path(name)) for _ in range(2))
    tiles = chosen.select("a_rid", "grp", "tile").distinct()
    vectors = anchors.join(tiles, ["a_rid", "grp"]).select(
        F.lit(0).alias("kind"), "a_rid", "a_id", "a_label", "a_blk", "a_q", F.lit(None).cast("long").alias("b_label"), F.lit(None).cast("long").alias("blk"),
        F.lit(None).cast("long").alias("p_rid"), F.lit(None).cast("long").alias("p_score"), "grp", "tile",
    )
    picks = chosen.select(
        F.lit(1).alias("kind"), "a_rid", F.lit(None).cast("long").alias("a_id"), F.lit(None).cast("long").alias("a_label"),
        F.lit(None).cast("long").alias("a_blk"), F.lit(None).cast("array<long>").alias("a_q"), F.col("label").alias("b_label"), "blk",
        *(extra or [F.lit(None).cast("long").alias("p_rid"), F.lit(None).cast("long").alias("p_score")]), "grp", "tile",
    )
    wanted = again.select("grp", "tile", "label", "blk").distinct()
    rows = stored.join(wanted, ["label", "blk"]).select(
        "rid", F.coalesce("vec_id", F.lit(0).cast("long")).alias("vec_id"), F.col("vec_id").isNull().alias("no_id"), "label", "blk", "q", "grp", "tile"
    )
    return vectors.unionByName(picks), rows


def _reach(rows: DataFrame, by: list[str], need: int) -> DataFrame:
    """Per ``by``: the greatest ``low`` at which the rows of blocks with at least that lower bound reach ``need``."""
    w = Window.partitionBy(*by).orderBy(F.col("low").desc(), "label", "blk").rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumn("cum", F.sum("n").over(w))
    return counted.groupBy(*by).agg(F.max(F.when(F.col("cum") >= need, F.col("low"))).alias("floor"))


def _first(found: DataFrame, by: list[str], keep: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "no_id", "vec_id", "rid")
    first = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)
    return first.withColumn("vec_id", F.when(~F.col("no_id"), F.col("vec_id"))).drop("no_id")


def mine(
    embeddings: DataFrame, scratch: Scratch, positives: int = POSITIVES, negatives: int = NEGATIVES, block: int = BLOCK
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for every anchor of ``embeddings``.

    Rows with a NULL label, vector or component, or a non-finite component take no part. Anchors are rows whose id is divisible
    by ``ANCHOR_EVERY``; a positive is any other row of the anchor's label (a repeated row counts as another row), a negative
    any row of another label inside the window. Ties of score go to the smaller id (a NULL id after all others), then to the
    row read first. Rows with a NULL id take part but are never anchors. Vectors shorter than the longest count as padded with
    zeros. An anchor
    without positives, or a positive without negatives, gives no row; an empty table gives an empty result.
    """
    stored, zones = blocks(candidates(embeddings), scratch, block)
    anchor_rows = stored.filter(F.pmod(F.col("vec_id"), F.lit(ANCHOR_EVERY)) == 0)
    n_anchors, n_blocks = anchor_rows.count(), zones.count()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if n_anchors == 0:
        return scratch.spark.createDataFrame([], schema)
    groups, tiles = max(1, math.ceil(n_anchors / ANCHORS)), max(1, math.ceil(n_blocks / TILE))
    tile = lambda blk: F.pmod(F.xxhash64(blk), F.lit(tiles))
    anchors = scratch.save(
        anchor_rows.select(
            F.col("rid").alias("a_rid"), F.col("vec_id").alias("a_id"), F.col("label").alias("a_label"), F.col("blk").alias("a_blk"),
            F.col("q").alias("a_q"), F.pmod(F.xxhash64("rid"), F.lit(groups)).alias("grp"),
        ),
        "anchors",
    )

    # bounds of every anchor over every zone map, in tiles of blocks
    left = anchors.select(F.lit(0).alias("kind"), "a_rid", "a_id", "a_label", "a_blk", "a_q", "grp").withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    right = zones.withColumn("tile", tile(F.col("blk"))).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    bound_schema = "a_rid long, a_label long, a_blk long, label long, blk long, n long, low long, high long"
    pairs = scratch.save(_tiled(left, right, _bounds, bound_schema), "pairs")
    grp_of = anchors.select("a_rid", "grp")

    # positives: blocks of the anchor's label that can reach the fifth best score
    same = pairs.filter(F.col("label") == F.col("a_label")).withColumn("n", F.col("n") - F.when(F.col("blk") == F.col("a_blk"), 1).otherwise(0))
    chosen = same.join(_reach(same, ["a_rid"], positives), "a_rid").filter(F.col("floor").isNull() | (F.col("high") >= F.col("floor")))
    chosen = chosen.join(grp_of, "a_rid").select("a_rid", "grp", "label", "blk", tile(F.col("blk")).alias("tile"))
    scratch.save(chosen, "chosen")
    lhs, rhs = _spread(anchors, stored, scratch, "chosen", [])
    found = _tiled(lhs, rhs, lambda l, r: _best(l, r, positives, False), "a_rid long, p_rid long, rid long, vec_id long, no_id boolean, score long")
    pos = scratch.save(
        _first(found, ["a_rid"], positives).select("a_rid", F.col("rid").alias("p_rid"), F.col("vec_id").alias("p_id"), F.col("score").alias("p_score")),
        "positives",
    )

    # negatives: blocks of other labels that meet a positive's window and can reach its third best score
    windows = pairs.filter(F.col("label") != F.col("a_label")).join(pos.select("a_rid", "p_rid", "p_score"), "a_rid")
    meets = (F.lit(100) * F.col("high") >= F.lit(LOW) * F.col("p_score")) & (F.lit(100) * F.col("low") <= F.lit(HIGH) * F.col("p_score"))
    inside = (F.lit(100) * F.col("low") >= F.lit(LOW) * F.col("p_score")) & (F.lit(100) * F.col("high") <= F.lit(HIGH) * F.col("p_score"))
    meeting = windows.filter(meets)
    floor3 = _reach(meeting.filter(inside), ["a_rid", "p_rid"], negatives)
    needed = meeting.join(floor3, ["a_rid", "p_rid"], "left").filter(F.col("floor").isNull() | (F.col("high") >= F.col("floor")))
    needed = needed.join(grp_of, "a_rid").select("a_rid", "grp", "label", "blk", tile(F.col("blk")).alias("tile"), "p_rid", "p_score")
    scratch.save(needed, "needed")
    lhs, rhs = _spread(anchors, stored, scratch, "needed", ["p_rid", "p_score"])
    found = _tiled(lhs, rhs, lambda l, r: _best(l, r, negatives, True), "a_rid long, p_rid long, rid long, vec_id long, no_id boolean, score long")
    ranked = _first(found, ["a_rid", "p_rid"], negatives)
    out = ranked.join(pos, ["a_rid", "p_rid"]).join(anchors.select("a_rid", "a_id"), "a_rid")
    return out.select(
        F.col("a_id").alias("anchor_id"), F.col("p_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"), F.col("p_score").alias("positive_score"), F.col("score").alias("negative_score"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"), Scratch(spark, "op11"))
