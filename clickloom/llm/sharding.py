"""Resharding by minimum-cost flow.

The old layout is read from its folders, whatever put the documents there. In the query a hash of the text stands in for it,
so shards are uneven where texts repeat. From old sizes and new capacities a minimum-cost flow finds how many bytes each old shard hands to each new one; a byte that stays costs nothing.
Within an old shard documents stand in the order of (text hash, id hash), and each transfer is one run of
that order: a block. The ends of the blocks are found by descending through the hash digits, one narrow aggregation per
digit over the few hash ranges that hold an end, so nothing is sorted and no document list reaches the driver.

Documents larger than a hundredth of a shard, at most ``100 x shards``, are placed first, one by one. Equal texts
of an old shard have equal hashes and stay together unless they are more than a hundredth of a shard; larger groups are cut by
id hash. Then the shards that lose or gain documents are written anew, and the folders of all others are kept.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from clickloom.llm.common import Scratch, ranked, table

OLD_SHARDS, NEW_SHARDS = 16, 24
#: Bits of a hash key that one pass looks at; both keys have 63.
DIGIT, BITS = 9, 63
#: Parts of a shard's mean size: documents and groups placed as a whole, and how exact an end must be.
WHOLE, EXACT = 100, 2000
BUCKETS = 256


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> dict[tuple[int, int], int]:
    """Cheapest shipment of all ``supply`` into ``demand`` (equal sums), by successive shortest paths."""
    n, m = len(supply), len(demand)
    left, room, flow = list(supply), list(demand), defaultdict(int)
    while any(left):
        # shortest distances from the old shards that still have bytes; used arcs can be walked backwards
        far = [0 if left[i] else None for i in range(n)] + [None] * m
        back: list[int | None] = [None] * (n + m)
        queue = deque(i for i in range(n) if left[i])
        while queue:
            u = queue.popleft()
            if u < n:
                steps = [(n + j, cost[u][j]) for j in range(m)]
            else:
                steps = [(i, -cost[i][u - n]) for i in range(n) if flow[i, u - n] > 0]
            for v, c in steps:
                if far[v] is None or far[u] + c < far[v]:
                    far[v], back[v] = far[u] + c, u
                    queue.append(v)
        end = min((n + j for j in range(m) if room[j] and far[n + j] is not None), key=lambda v: far[v])
        path = [end]
        while back[path[-1]] is not None:
            path.append(back[path[-1]])
        path.reverse()
        amount = min(left[path[0]], room[end - n], *(flow[v, u - n] for u, v in zip(path, path[1:]) if u >= n))
        for u, v in zip(path, path[1:]):
            if u < n:
                flow[u, v - n] += amount
            else:
                flow[v, u - n] -= amount
        left[path[0]] -= amount
        room[end - n] -= amount
    return {k: v for k, v in flow.items() if v}


def block_ends(rows: DataFrame, targets: dict[int, list[int]], whole: int, exact: int) -> dict[int, list[tuple[int, int]]]:
    """For each old shard the keys (k1, k2) before which about the targeted bytes lie.

    ``rows`` has ``old, k1, k2, size``. Each pass sums one more digit of the keys within the open ranges: at most
    ``2^DIGIT`` rows for each of the few open ends come back.
    """
    ends: dict[tuple[int, int], tuple[int, int]] = {}
    # (old, number of the end) -> bytes before its range, bits fixed, their value
    open_ends = {(old, i): (0, 0, 0) for old, found in targets.items() for i in range(len(found))}
    while open_ends:
        ranges = sorted({(old, bits, value) for (old, _), (_, bits, value) in open_ends.items()})
        spark = rows.sparkSession
        depths = sorted({b for _, b, _ in ranges})

        def fixed(bits: int):
            one = F.shiftright("k1", BITS - min(bits, BITS)).cast("string")
            return one if bits <= BITS else F.concat(F.col("k1").cast("string"), F.lit("/"), F.shiftright("k2", 2 * BITS - bits).cast("string"))

        def digit(bits: int):
            key, rest = ("k1", BITS) if bits < BITS else ("k2", 2 * BITS)
            return F.shiftright(key, rest - bits - DIGIT).bitwiseAND(F.lit(2**DIGIT - 1))

        sums: dict[tuple[int, int, int], dict[int, tuple]] = defaultdict(dict)
        for bits in depths:
            names = {f"{v >> max(0, bits - BITS)}" + (f"/{v & (1 << (bits - BITS)) - 1}" if bits > BITS else ""): v for _, b, v in ranges if b == bits}
            here = spark.createDataFrame([(o, n) for n, v in names.items() for o, b, w in ranges if b == bits and w == v], "of_old int, at string")
            part = rows.withColumn("at_key", fixed(bits) if bits else F.lit("0")).join(
                F.broadcast(here), (F.col("old") == F.col("of_old")) & (F.col("at_key") == F.col("at"))
            )
            got = part.groupBy("old", "at_key", digit(bits).alias("digit")).agg(
                F.sum("size").alias("size"), F.min("k1").alias("a1"), F.max("k1").alias("b1"), F.min("k2").alias("a2"), F.max("k2").alias("b2")
            )
            for r in got.collect():
                sums[r["old"], bits, names[r["at_key"]]][r["digit"]] = tuple(r)[3:]
        still = {}
        for (old, i), (before, bits, value) in open_ends.items():
            target, found = targets[old][i], sums[old, bits, value]
            for d in sorted(found):
                size, a1, b1, a2, b2 = found[d]
                if before + size < target and d != max(found):
                    before += size
                    continue
                one_text = a1 == b1
                group = one_text and bits < BITS  # all rows of one text
                last = one_text and a2 == b2 or bits + DIGIT >= 2 * BITS
                if size <= exact or last or (group and size <= whole):
                    low, high = ((a1, a2), (a1, b2 + 1)) if bits >= BITS else ((a1, 0), (b1 + 1, 0))
                    ends[old, i] = low if target - before < before + size - target else high
                elif group:
                    still[old, i] = (before, BITS, a1)
                else:
                    still[old, i] = (before, bits + DIGIT, value << DIGIT | d)
                break
        open_ends = still
    return {old: [ends[old, i] for i in range(len(found))] for old, found in targets.items()}


def stand_in(old_shards: int) -> Column:
    """The old shard of a document that lies in no layout: a hash of its text."""
    return F.pmod(F.xxhash64(F.lit(2), F.coalesce("text", F.lit(""))), F.lit(old_shards)).cast("int")


def keyed(old: Column) -> list[Column]:
    """``size, text_crc32, old, k1, k2``: what a row is placed by.

    NULL text has no bytes (size 8) and hashes like the empty text.
    """
    text = F.coalesce("text", F.lit(""))
    return [
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        old.cast("int").alias("old"),
        F.shiftrightunsigned(F.xxhash64(text), 1).alias("k1"),
        F.shiftrightunsigned(F.xxhash64("doc_id", text), 1).alias("k2"),
    ]


def plan(rows: DataFrame, old_shards: int, new_shards: int) -> Callable[[DataFrame], DataFrame]:
    """From all ``old, k1, k2, size`` (a saved table) a function that adds ``shard`` to a table with these columns."""
    spark = rows.sparkSession
    sizes = {r[0]: int(r[1]) for r in rows.groupBy("old").agg(F.sum("size")).collect()}
    old_shards = max([old_shards, *(i + 1 for i in sizes)])
    total = sum(sizes.values())
    room = [total // new_shards + (j < total % new_shards) for j in range(new_shards)]
    whole, exact = total // new_shards // WHOLE, total // new_shards // EXACT
    # at most WHOLE documents of this size fit into a shard
    large = rows.filter(F.col("size") > whole).groupBy("old", "k1", "k2").agg(F.sum("size").alias("size")).collect()
    single = []
    for r in sorted(large, key=lambda r: (-r["size"], r["k1"], r["k2"])):
        old, size = r["old"], r["size"]
        to = old if old < new_shards and room[old] >= size else max(range(new_shards), key=lambda j: (room[j], -j))
        single.append((old, r["k1"], r["k2"], to))
        room[to] -= size
        sizes[old] -= size
    # what large documents take beyond a shard's room is taken from the others' rooms evenly
    over = -sum(x for x in room if x < 0)
    room = [max(0, x) for x in room]
    while over > 0:
        top = max(range(new_shards), key=lambda j: room[j])
        cut = min(over, max(1, room[top] // 50))
        room[top] -= cut
        over -= cut
    olds = [sizes.get(i, 0) for i in range(old_shards)]
    flow = min_cost_flow(olds, room, [[int(i != j) for j in range(new_shards)] for i in range(old_shards)])
    parts, targets = {}, {}
    for i in range(old_shards):
        parts[i] = sorted(j for k, j in flow if k == i) or [min(i, new_shards - 1)]
        at, targets[i] = 0, []
        for j in parts[i][:-1]:
            at += flow[i, j]
            targets[i].append(at)
    small = rows.filter(F.col("size") <= whole)
    ends = block_ends(small, {i: t for i, t in targets.items() if t}, whole, exact)
    shard = F.lit(0)
    for i in range(old_shards):
        inside = F.lit(parts[i][-1])
        for (k1, k2), j in reversed(list(zip(ends.get(i, []), parts[i][:-1]))):
            inside = F.when((F.col("k1") < k1) | ((F.col("k1") == k1) & (F.col("k2") < k2)), j).otherwise(inside)
        shard = F.when(F.col("old") == i, inside).otherwise(shard)
    alone = F.broadcast(spark.createDataFrame(single, "s_old int, s_k1 long, s_k2 long, s_shard int"))
    on = (F.col("size") > whole) & (F.col("old") == F.col("s_old")) & (F.col("k1") == F.col("s_k1")) & (F.col("k2") == F.col("s_k2"))
    return lambda df: df.join(alone, on, "left").select(*df.columns, F.coalesce("s_shard", shard).cast("int").alias("shard"))


def placed(docs: DataFrame, scratch: Scratch, old_shards: int = OLD_SHARDS, new_shards: int = NEW_SHARDS, old: Column | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, old, k1, k2, shard`` of every row of ``docs``.

    ``old`` is the shard a row lies in (default: the stand-in). Rows with a NULL id and repeated rows are placed like others.
    An empty table gives an empty result.
    """
    old = stand_in(old_shards) if old is None else old
    rows = scratch.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keyed(old)), "rows")
    return plan(rows, old_shards, new_shards)(rows)


def layout(docs: DataFrame, path: str) -> DataFrame:
    """The documents below ``path`` with the columns of ``docs``, and ``shard`` from the name of their folder."""
    fields = [f for f in docs.schema if f.name != "shard"]
    return docs.sparkSession.read.schema(StructType([*fields, StructField("shard", IntegerType())])).parquet(path)


def rewrite(docs: DataFrame, scratch: Scratch, path: str, new_path: str, old_shards: int = OLD_SHARDS, new_shards: int = NEW_SHARDS) -> list[int]:
    """Write the shards that lose or gain documents anew, folders ``shard=N`` below ``new_path``; their numbers are returned.

    ``path`` is the old layout, folders ``shard=N`` of rows with the columns of ``docs`` (``doc_id, text`` and others); which shard
    a row lies in is taken from there alone. Its folders of all other shards below ``new_shards`` may be kept (renamed or
    linked) as they are.
    """
    stored = layout(docs, path)
    rows = scratch.save(stored.select(*keyed(F.col("shard"))), "rows")
    place = plan(rows, old_shards, new_shards)
    moves = place(rows).groupBy("old", "shard").count().collect()
    changed = sorted({x for r in moves if r["old"] != r["shard"] for x in (r["old"], r["shard"]) if x < new_shards})
    # no other folder holds documents of a changed shard
    affected = stored.filter(F.col("shard").isin(changed) | (F.col("shard") >= new_shards))
    whole_rows = affected.select(F.struct(*(F.col(f"`{c}`") for c in stored.columns if c != "shard")).alias("in_row"), *keyed(F.col("shard")))
    out = place(whole_rows).select("in_row.*", "shard")
    out.write.mode("overwrite").option("compression", "snappy").partitionBy("shard").parquet(new_path)
    return changed


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents are laid out by the stand-in, resharded, and what is told of them is read from the written and kept files."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "op6")
    scratch.save(docs.withColumn("shard", stand_in(OLD_SHARDS)), "old", "shard")
    changed = rewrite(docs, scratch, scratch.path("old"), scratch.path("new"))
    kept = layout(docs, scratch.path("old")).filter(~F.col("shard").isin(changed) & (F.col("shard") < NEW_SHARDS))
    final = layout(docs, scratch.path("new")).unionByName(kept)
    rows = scratch.save(final.select(F.col("doc_id").cast("long").alias("doc_id"), *keyed(F.col("shard")), "shard"), "placed")
    return ranked(rows, "shard", ["k1", "k2", "doc_id"], "slot", BUCKETS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
