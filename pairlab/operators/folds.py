"""Labelled pairs, fold assignment and the checks around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlab.functions.ids import stable_hash
from pairlab.operators.ranking import BUCKET_BITS, hash_bucket, number_copies, split_evenly
from pairlab.operators.sampling import PAIR


def label_union(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """Positives labelled 1 and negatives labelled 0 in one table."""
    pos = positives.select(*PAIR, F.lit(1).alias("label"))
    return pos.unionByName(negatives.select(*PAIR, F.lit(0).alias("label")))


def assign_folds(
    pairs: DataFrame, k: int = 5, seed=42, unique: bool = True, bits: int = BUCKET_BITS
) -> DataFrame:
    """A ``fold`` 0..k-1 per row: a seeded shuffle cut into k parts, not stratified.

    Part sizes differ by at most one, the first ``n mod k`` being larger.  Rows
    must be unique per (pair, label); with ``unique=False`` repeated rows are
    numbered first so that copies may fall into different folds.  The folds do
    not depend on ``bits``, the logarithm of the number of buckets.
    """
    keys = [c for c in (*PAIR, "label") if c in pairs.columns]
    order = [*keys]
    if not unique:
        pairs = number_copies(pairs, keys)
        order.append("copy_no")
    hashed = pairs.withColumn("_h", stable_hash(seed, *order))
    split = split_evenly(hashed, k, ["_h", *order], hash_bucket("_h", bits), "fold")
    return split.drop("_h", "copy_no")


def fold_summary(split: DataFrame) -> DataFrame:
    """Training and validation rows per fold, by label."""
    own = split.groupBy("fold").agg(
        F.count_if(F.col("label") == 1).alias("val_pos"),
        F.count_if(F.col("label") == 0).alias("val_neg"),
    )
    # one row per fold from here on
    everything = Window.partitionBy(F.lit(0))
    return own.select(
        "fold",
        (F.sum("val_pos").over(everything) - F.col("val_pos")).alias("train_pos"),
        (F.sum("val_neg").over(everything) - F.col("val_neg")).alias("train_neg"),
        "val_pos",
        "val_neg",
    )


def fold_views(split: DataFrame, k: int) -> DataFrame:
    """Every row once per run: validation in its own fold's run, training in the others."""
    runs = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("run")
    part = F.when(F.col("fold") == F.col("run"), F.lit("val")).otherwise(F.lit("train"))
    return split.select("*", runs).withColumn("part", part)


def train_part(split: DataFrame, fold: int) -> DataFrame:
    return split.filter(F.col("fold") != fold)


def val_part(split: DataFrame, fold: int) -> DataFrame:
    return split.filter(F.col("fold") == fold)


def check_overlap(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """Distinct pairs present in both tables; must be empty.  One shuffle for both."""
    pos = positives.select(*PAIR, F.lit(1).alias("_side"))
    both = pos.unionByName(negatives.select(*PAIR, F.lit(0).alias("_side")))
    spread = both.groupBy(*PAIR).agg(F.min("_side").alias("_lo"), F.max("_side").alias("_hi"))
    return spread.filter("_lo < _hi").select(*PAIR)


def check_fold_leak(split: DataFrame, positives: DataFrame) -> DataFrame:
    """Per fold: distinct validation negatives, and how many of them are known positives.

    One shuffle on the pair for both tables; a pair gathers at most its folds.
    """
    negatives = split.filter("label = 0").select(*PAIR, "fold", F.lit(0).alias("_known"))
    known = positives.select(*PAIR, F.lit(None).cast("int").alias("fold"), F.lit(1).alias("_known"))
    merged = negatives.unionByName(known).groupBy(*PAIR).agg(
        F.collect_set("fold").alias("_folds"), F.max("_known").alias("_known")
    )
    checked = merged.select(F.explode("_folds").alias("fold"), "_known")
    return checked.groupBy("fold").agg(
        F.count(F.lit(1)).alias("val_neg"),
        F.sum("_known").cast("bigint").alias("leaked"),
    )


def pairs_in_several_folds(split: DataFrame) -> DataFrame:
    """Pairs that occur in more than one fold."""
    spread = split.groupBy(*PAIR).agg(F.min("fold").alias("_lo"), F.max("fold").alias("_hi"))
    return spread.filter("_lo < _hi").select(*PAIR)
