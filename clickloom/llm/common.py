"""Shared helpers: tables, scratch space in the shared folder, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickloom.session import work_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = "\t\n\x0b\f\r "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def labels_of(labels: DataFrame, name: str) -> DataFrame:
    """One row ``doc_id, label`` per labelled document; the larger label counts where there are several."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(name).isin(0, 1))
    return known.groupBy("doc_id").agg(F.max(name).cast("int").alias("label"))


class Scratch:
    """Intermediate tables in the folder of ``spark.checkpoint.dir``.

    A saved table cuts the lineage and survives the loss of any executor. ``drop`` deletes one that later steps no
    longer read; what is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, work_dir(spark, name)
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self._fs.deleteOnExit(self._path(self.root))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        # not zstd: its native contexts pile up outside the heap when many small parts are read
        writer = df.write.mode("overwrite").option("compression", "snappy")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs.delete(self._path(self.path(name)), True)


def first_by_hash(rows: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """At most ``n`` rows of each value of ``by``, the first in hash order of ``key``.

    Values of ``by`` are classes, few and counted first; a bound on the hash that a few times ``n`` rows pass keeps what
    reaches one task small, whatever the table.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(by).count().collect()}
    h, passes = F.xxhash64(key), F.lit(False)
    for value, count in counts.items():
        share = (4 * n + 100) / count
        inside = h < F.lit(int(share * 2**64) - 2**63) if share < 1 else F.lit(True)
        passes = passes | (F.col(by).eqNullSafe(F.lit(value)) & inside)
    place = F.row_number().over(Window.partitionBy(by).orderBy(h, key))
    return rows.filter(passes).withColumn("in_place", place).filter(F.col("in_place") <= n).drop("in_place")


def ranked(df: DataFrame, by: str, order: list[str], name: str, buckets: int) -> DataFrame:
    """Adds the gapless rank from 0 of each row among those of equal ``by`` (never NULL), as a column ``name``.

    Rows are counted per hash bucket of ``order``, and only rows of one bucket are ordered in one task, so a value that a
    third of all rows share is ranked in many tasks. ``df`` must be a saved table, as it is read twice.
    """
    keyed = df.withColumn("in_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(by).orderBy("in_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        keyed.groupBy(by, "in_bucket")
        .count()
        .withColumn("in_start", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .select(F.col(by).alias("of_group"), F.col("in_bucket").alias("of_bucket"), "in_start")
    )
    within = F.row_number().over(Window.partitionBy(by, "in_bucket").orderBy(*order)) - 1
    numbered = keyed.withColumn("in_rank", within)
    joined = numbered.join(starts, (F.col(by) == F.col("of_group")) & (F.col("in_bucket") == F.col("of_bucket")))
    return joined.select(*df.columns, (F.col("in_start") + F.col("in_rank")).cast("long").alias(name))
