"""Views of the test tables in the shapes the operators take.

``events`` is the behaviour log: the event type is the domain and ``props.k`` the item. A wide row holds
one user's events of one day, so every event lies in exactly one row and no history is gathered whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.catalogue import Catalogue
from clickloom.operators.history import history_arrays

DOMAINS = ["click", "error", "purchase", "signup", "view"]
CAPS = {"click": 3, "error": 4, "purchase": 4, "signup": 4, "view": 6}
DIM = 64
# declared vocabularies: items go to 99 and ids to 99490, so both limits cut some off
VOCAB_ITEM, VOCAB_ID = 90, 60000
FEAT = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "net", "tax_known"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def epoch(c: str) -> Column:
    """Whole Unix seconds of a timestamp without zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})")


def behaviour(spark: SparkSession, sf: str) -> DataFrame:
    item = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf, "events").select(
        "event_id", "user_id", F.col("event_type").alias("domain"), item.alias("item"),
        (item * 1000 + F.floor("value")).alias("id"), epoch("ts").alias("ts"), "value",
    )


def features(spark: SparkSession, sf: str) -> DataFrame:
    """Numeric columns: natural zeros in discount and tax, NULLs in ``tax_known``, one derived column."""
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        F.when(F.col("l_tax") != 0, F.col("l_tax")).alias("tax_known"),
        F.when(F.col("l_returnflag") == "R", 2).otherwise(1).alias("label_type"),
    )


def accounts(spark: SparkSession, sf: str) -> DataFrame:
    """Balances of customers, with natural negatives, and ids shifted so that some are not positive."""
    return table(spark, sf, "customer").select(
        "c_custkey", "c_acctbal", (F.col("c_nationkey") - 3).cast("bigint").alias("nation"),
        F.when(F.col("c_nationkey") != 7, F.floor("c_acctbal")).alias("balance"),
    )


def words(spark: SparkSession, sf: str) -> DataFrame:
    """Per document the word lengths minus 3: an array per row with natural zeros and negatives."""
    pieces = F.split("text", " ", -1)
    return table(spark, sf, "documents").select(
        "doc_id", F.transform(pieces, lambda w: (F.length(w) - 3).cast("bigint")).alias("words")
    )


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """A scored table: a score with many ties per line item, some of them NaN."""
    z = (F.pmod(F.col("l_partkey") * 7 + F.col("l_suppkey"), F.lit(41)) - 20) / 8.0
    return table(spark, sf, "lineitem").select(
        F.when(F.col("l_linenumber") == 7, F.lit(float("nan"))).otherwise(z).alias("logit"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
    )


def wide_catalogue() -> Catalogue:
    features = [[1, VOCAB_ITEM], [2, VOCAB_ID], [3, 0]]
    return Catalogue.from_dict(
        {
            "user_int": [[1, 80, 1], [2, 0, 1], [3, VOCAB_ITEM, 4]],
            "item_int": [[4, VOCAB_ITEM, 1]],
            "user_dense": [[5, 3]],
            "seq": {d: {"prefix": f"{d}_seq", "ts_fid": 3, "features": features} for d in DOMAINS},
        },
        CAPS,
    )


def wide(spark: SparkSession, sf: str) -> DataFrame:
    """One impression row per user and day in the catalogue's column layout; ``user_id`` is user and day in one number.

    Scalars are the oldest item or id held of a domain, the click items serve as a list feature and the
    view values as a dense one.
    """
    day = F.floor(F.col("ts") / 86400)
    ev = behaviour(spark, sf).withColumn("user_id", F.col("user_id") * 100000 + day)
    values = ["item", "id", "ts", "value"]
    h = history_arrays(ev, "user_id", "domain", DOMAINS, ["ts", "event_id"], values)
    seqs = [
        F.col(f"{d}_{src}").alias(f"{d}_seq_{fid}")
        for d in DOMAINS
        for src, fid in (("item", 1), ("id", 2), ("ts", 3))
    ]
    last_ts = F.greatest(*[F.coalesce(F.array_max(f"{d}_ts"), F.lit(0)) for d in DOMAINS])
    return h.select(
        "user_id",
        last_ts.alias("timestamp"),
        F.when(F.size("purchase_item") % 2 == 1, 2).otherwise(1).alias("label_type"),
        F.get(F.col("view_item"), F.lit(0)).alias("user_int_feats_1"),
        F.get(F.col("view_id"), F.lit(0)).alias("user_int_feats_2"),
        F.col("click_item").alias("user_int_feats_3"),
        F.get(F.col("purchase_item"), F.lit(0)).alias("item_int_feats_4"),
        F.col("view_value").cast("array<float>").alias("user_dense_feats_5"),
        *seqs,
    )
