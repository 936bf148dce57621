import math

import pytest
from pyspark.sql import functions as F

from clickloom.streaming import levelled as L


def batch_counts(spark, b, keys=200):
    """Counts of batch ``b``: keys shared with other batches and keys of its own, NULL keys too."""
    rows = spark.range(b * 50, b * 50 + keys).select(
        F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.col("id") % 300).alias("k"), F.lit("x").alias("d"), F.lit(1).cast("long").alias("count")
    )
    return rows


def test_fifty_batches_equal_the_whole_and_write_in_proportion(spark, tmp_path):
    state = L.LevelledCounts(spark, str(tmp_path / "s"), ["k", "d"], fanout=4, buckets=2)
    whole, written, level0 = None, 0, 0
    for b in range(50):
        counts = batch_counts(spark, b)
        whole = counts if whole is None else whole.unionByName(counts)
        state.absorb(counts, b)
        written += sum(state.written[b].values())
        level0 += state.written[b][f"L0-b{b}"]
        assert len(state.runs()) <= 3 * (1 + math.ceil(math.log(b + 1, 4)))
    want = sorted((tuple(r) for r in whole.groupBy("k", "d").agg(F.sum("count").alias("count")).collect()), key=repr)
    assert sorted((tuple(r) for r in state.state().collect()), key=repr) == want
    # each row is written once per level at most: log4(50) < 3 merges beside the first write
    assert written <= 4 * level0
    assert len(state.batches()) == 2


def test_stop_before_the_manifest_loses_nothing(spark, tmp_path):
    state = L.LevelledCounts(spark, str(tmp_path / "s"), ["k", "d"], fanout=2, buckets=2)
    for b in range(3):
        state.absorb(batch_counts(spark, b), b)
    # batch 3 writes its run and a merged run, then stops before its manifest
    state._write_run(batch_counts(spark, 3), "L0-b3")
    state._write_run(state._read(state.runs()), "L1-b3")
    assert state.batches()[-1] == 2
    before = sorted((tuple(r) for r in state.state().collect()), key=repr)
    want = batch_counts(spark, 0)
    for b in range(1, 3):
        want = want.unionByName(batch_counts(spark, b))
    assert before == sorted((tuple(r) for r in want.groupBy("k", "d").agg(F.sum("count").alias("count")).collect()), key=repr)
    # the batch runs again from the older manifest
    state.absorb(batch_counts(spark, 3), 3)
    want = want.unionByName(batch_counts(spark, 3)).groupBy("k", "d").agg(F.sum("count").alias("count"))
    assert sorted((tuple(r) for r in state.state().collect()), key=repr) == sorted((tuple(r) for r in want.collect()), key=repr)
    # and once more, as if the engine had not committed it
    state.absorb(batch_counts(spark, 3), 3)
    assert sorted((tuple(r) for r in state.state().collect()), key=repr) == sorted((tuple(r) for r in want.collect()), key=repr)


def test_nothing_absorbed(spark, tmp_path):
    state = L.LevelledCounts(spark, str(tmp_path / "s"), ["k"])
    assert state.runs() == []
    with pytest.raises(ValueError):
        state.state()
    empty = spark.createDataFrame([], "k long, count long")
    state.absorb(empty, 0)
    assert state.state().count() == 0


def test_stream_of_files_restarts_with_new_files(spark, tmp_path):
    path, where = str(tmp_path / "in"), str(tmp_path / "w")
    for lo in (0, 100, 200):
        spark.range(lo, lo + 150).select((F.col("id") % 70).alias("k")).coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema

    def count(rows):
        return rows.groupBy("k").agg(F.count(F.lit(1)).alias("count"))

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    first = {r.k: r["count"] for r in L.run_levelled(stream, where, count, ["k"], fanout=2).collect()}
    spark.range(500, 520).select((F.col("id") % 70).alias("k")).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    second = {r.k: r["count"] for r in L.run_levelled(stream, where, count, ["k"], fanout=2).collect()}
    whole = {r.k: r["count"] for r in count(spark.read.parquet(path)).collect()}
    assert second == whole and sum(first.values()) == 450 and sum(second.values()) == 470
