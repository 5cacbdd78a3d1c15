"""Pair, feature, score and history tables built from the given tables.

Left entities are parts, right entities are suppliers; a pair is known if the
part was ever supplied by the supplier.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from pairlab.operators.features import onehot_associations, vocabulary
from pairlab.session import run_folder
from pairlab.sources.tables import as_features, as_pairs

ONEHOT_DIM = 25


_SCHEMAS: dict = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; its schema is looked up once per path."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every line's (part, supplier) pair; pairs repeat."""
    return as_pairs(table(spark, sf, "lineitem"), "l_partkey", "l_suppkey")


def positives(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).distinct()


def strong_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs with a large order: sparse enough for 1:1 negatives at every scale."""
    lines = table(spark, sf, "lineitem").filter("l_quantity > 40")
    return lines.select(F.col("l_partkey").cast("string").alias("left_id"), F.col("l_suppkey").cast("string").alias("right_id"))


def activity_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(user, event type): every combination occurs, so no negative exists."""
    return as_pairs(table(spark, sf, "events"), "user_id", "event_type")


def left_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return as_features(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey")


def left_price(spark: SparkSession, sf: str) -> DataFrame:
    return as_features(table(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_partkey")


def left_size(spark: SparkSession, sf: str) -> DataFrame:
    return as_features(table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey")


def left_embedding(spark: SparkSession, sf: str) -> DataFrame:
    """A modality that covers only some of the left entities."""
    return as_features(table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id")


def right_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return as_features(table(spark, sf, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey"), "s_suppkey")


def right_balance(spark: SparkSession, sf: str) -> DataFrame:
    return as_features(table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), "s_suppkey")


def right_place(spark: SparkSession, sf: str) -> DataFrame:
    return as_features(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey")


def left_associations(spark: SparkSession, sf: str) -> DataFrame:
    """Parts against the 25 nations their suppliers are in."""
    lines = table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("part"), "l_suppkey")
    homes = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    assoc = lines.join(homes, "l_suppkey")
    vocab = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"))
    return onehot_associations(assoc, "part", "s_nationkey", vocabulary(vocab, "s_nationkey"), ONEHOT_DIM)


def right_associations(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers against the 25 brands they deliver."""
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("supplier"), "l_partkey")
    brands = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    vocab = vocabulary(table(spark, sf, "part"), "p_brand")
    return onehot_associations(lines.join(brands, "l_partkey"), "supplier", "p_brand", vocab, ONEHOT_DIM)


def modalities(spark: SparkSession, sf: str) -> dict[tuple[str, str], DataFrame]:
    """All seven modality tables."""
    return {
        ("left", "seq"): left_numbers(spark, sf),
        ("left", "struct"): left_price(spark, sf),
        ("left", "disease"): left_associations(spark, sf),
        ("right", "seq"): right_numbers(spark, sf),
        ("right", "graph"): right_balance(spark, sf),
        ("right", "ecfp"): right_place(spark, sf),
        ("right", "disease"): right_associations(spark, sf),
    }


def numbers(spark: SparkSession, sf: str) -> dict[tuple[str, str], DataFrame]:
    """Two modalities of one number each per side."""
    return {
        ("left", "seq"): left_price(spark, sf),
        ("left", "struct"): left_size(spark, sf),
        ("right", "seq"): right_balance(spark, sf),
        ("right", "graph"): right_place(spark, sf),
    }


def brand_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every supplied pair, labelled 1 if the part's brand is one of the first two makers'."""
    brands = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("left_id"), F.col("p_brand"))
    label = F.substring("p_brand", 7, 1).isin("1", "2").cast("int")
    return positives(spark, sf).join(brands, "left_id").select("left_id", "right_id", label.alias("label"))


def left_brand(spark: SparkSession, sf: str) -> DataFrame:
    """The maker's digit of a part's brand as five places, 1 in one of them."""
    digits = [(F.substring("p_brand", 7, 1) == str(d)).cast("float").alias(f"maker_{d}") for d in range(1, 6)]
    return as_features(table(spark, sf, "part").select("p_partkey", *digits), "p_partkey")


def flat(spark: SparkSession, sf: str) -> dict[tuple[str, str], DataFrame]:
    """Modalities whose every vector is the same."""
    same = F.lit(7.25).alias("same")
    return {
        ("left", "seq"): as_features(table(spark, sf, "part").select("p_partkey", same), "p_partkey"),
        ("right", "seq"): as_features(table(spark, sf, "supplier").select("s_suppkey", same), "s_suppkey"),
    }


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Every line as a scored pair: fold, label, score in (0, 1)."""
    price = F.col("l_extendedprice")
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").cast("string").alias("left_id"),
        F.col("l_suppkey").cast("string").alias("right_id"),
        (F.col("l_linenumber") - 1).alias("fold"),
        (F.col("l_quantity") + F.lit(120.0) * F.col("l_discount") > 31).cast("int").alias("label"),
        (
            (F.col("l_quantity") + F.lit(30.0) * F.col("l_tax") + price / F.lit(4000.0))
            / (F.col("l_quantity") + F.lit(30.0) * F.col("l_tax") + price / F.lit(4000.0) + F.lit(38.0))
        ).alias("score"),
    )


def scored_ties(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents scored by length in 41 steps: many ties, scores of 0 and 1."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    steps = F.floor(F.least(F.col("n_chars"), F.lit(20000)) / F.lit(500.0)).cast("double")
    return table(spark, sf, "labels").join(docs, "doc_id").select(
        (F.col("doc_id") % 3).cast("int").alias("fold"),
        F.col("quality").alias("label"),
        (steps / F.lit(40.0).cast("double")).alias("score"),
    )


def history(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events in time order as the epochs of one run."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"),
        F.row_number().over(order).alias("epoch"),
        (F.col("value") / (F.col("value") + F.lit(50.0))).alias("auc"),
    )


def long_history(spark, sf):
    """(run_id, epoch, auc): a supplier's lines in order, each scored a thousandth above the last."""
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber")
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("run_id"), F.row_number().over(order).alias("epoch"))
    return lines.withColumn("auc", F.col("epoch") / F.lit(1000.0))
