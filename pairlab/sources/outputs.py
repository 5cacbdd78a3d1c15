"""Writing and reading splits, predictions, features, results and run records."""

from __future__ import annotations

import hashlib
import json
import platform
from collections.abc import Sequence
from datetime import datetime, timezone
from functools import reduce

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.config import ExperimentConfig, enabled_modalities
from pairlab.functions.ids import stable_hash
from pairlab.functions.vectors import explode_vector
from pairlab.operators.sampling import PAIR
from pairlab.sources.tables import path_exists, read_table

SIMPLE_SCHEMA = "true_label int, predicted_score double, fold int"
DETAIL_SCHEMA = "left_id string, right_id string, true_label int, predicted_score double, fold int"


# -- splits ---------------------------------------------------------------


def split_key(params: dict, pairs: DataFrame) -> str:
    """Name of a stored split: all parameters plus an order-free fingerprint of the pairs."""
    h = stable_hash("fingerprint", *PAIR)
    mark = pairs.agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("mix"), F.sum(h % 1_000_003).alias("total")
    ).first()
    text = json.dumps({"params": params, "pairs": list(mark)}, sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:24]


def _balanced(df: DataFrame) -> DataFrame:
    """Narrow rows gathered by fold into files of even size; a large fold is split again."""
    return df.hint("rebalance", "fold")


def write_splits(split: DataFrame, root: str, key: str) -> str:
    """Store a split under its key, one folder per fold."""
    path = f"{root.rstrip('/')}/{key}"
    _balanced(split).write.mode("overwrite").partitionBy("fold").parquet(path)
    return path


def read_splits(spark: SparkSession, root: str, key: str) -> DataFrame | None:
    """The stored split, or None if no complete one exists under this key."""
    path = f"{root.rstrip('/')}/{key}"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        return None
    return spark.read.parquet(path)


def cached_splits(pairs: DataFrame, root: str, params: dict, build) -> DataFrame:
    """A stored split if parameters and pairs are the same, else a newly built and stored one."""
    spark = pairs.sparkSession
    key = split_key(params, pairs)
    found = read_splits(spark, root, key)
    if found is None:
        write_splits(build(pairs), root, key)
        found = read_splits(spark, root, key)
    return found


# -- predictions and features ---------------------------------------------


def _write(df: DataFrame, path: str, fmt: str, by: Sequence[str]) -> None:
    writer = df.write.mode("overwrite").partitionBy(*by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def prediction_rows(df: DataFrame, form: str = "simple", label: str = "label", score: str = "score") -> DataFrame:
    """true_label, predicted_score (and both ids in the detail form) beside the fold."""
    if form not in ("simple", "detail"):
        raise ValueError(f"unknown form {form!r}")
    ids = list(PAIR) if form == "detail" else []
    return df.select(
        *ids,
        F.col(label).cast("int").alias("true_label"),
        F.col(score).cast("double").alias("predicted_score"),
        "fold",
    )


def write_predictions(df: DataFrame, path: str, form: str = "simple", fmt: str = "csv") -> None:
    """One folder per fold of scored pairs."""
    _write(_balanced(prediction_rows(df, form)), path, fmt, ["fold"])


def fused_rows(df: DataFrame, side: str, dim: int, col: str | None = None) -> DataFrame:
    """Per scored pair: the side's id and its fused vector as dim_0 .. dim_{dim-1}."""
    return df.select(f"{side}_id", *explode_vector(col or f"{side}_fused", "dim_", dim), "fold")


def write_fused_features(df: DataFrame, path: str, side: str, dim: int, fmt: str = "csv") -> None:
    _write(fused_rows(df, side, dim), path, fmt, ["fold"])


def raw_rows(df: DataFrame, side: str, dims: dict[str, int]) -> DataFrame:
    """Per pair: the side's id, the label and <side>_<modality>_dim_i for every modality."""
    columns = [
        c for modality, dim in dims.items() for c in explode_vector(f"{side}_{modality}", f"{side}_{modality}_dim_", dim)
    ]
    return df.select(f"{side}_id", "label", *columns, "fold")


def write_raw_features(df: DataFrame, path: str, side: str, dims: dict[str, int], fmt: str = "csv") -> None:
    _write(raw_rows(df, side, dims), path, fmt, ["fold"])


def read_all_folds(spark: SparkSession, path, fmt: str = "csv", schema=None) -> DataFrame:
    """All folds of an output as one table.

    ``path`` is a folder with one sub-folder per fold, or a list of loose
    outputs of which missing ones are left out.
    """
    if isinstance(path, str):
        return read_table(spark, path, fmt, schema)
    found = [read_table(spark, p, fmt, schema) for p in path if path_exists(spark, p)]
    if not found:
        raise FileNotFoundError(f"none of {list(path)} exists")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


# -- results --------------------------------------------------------------


def write_results(metrics: DataFrame, summary: DataFrame, path: str, config: ExperimentConfig | None = None) -> None:
    """Fold metrics, their summary and the configuration as json."""
    root = path.rstrip("/")
    metrics.write.mode("overwrite").json(f"{root}/fold_results")
    summary.write.mode("overwrite").json(f"{root}/aggregated")
    text = json.dumps(config.as_dict() if config else {}, sort_keys=True)
    spark = metrics.sparkSession
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/config")


def read_results(spark: SparkSession, path: str) -> dict:
    """The three parts written by ``write_results``."""
    root = path.rstrip("/")
    return {
        "fold_results": spark.read.json(f"{root}/fold_results"),
        "aggregated": spark.read.json(f"{root}/aggregated"),
        "config": json.loads(spark.read.text(f"{root}/config").first()["value"]),
    }


def write_weights(weights: DataFrame, path: str) -> None:
    """Normalised modality weights (side, modality, weight) as json."""
    weights.write.mode("overwrite").json(path)


def run_record(spark: SparkSession, config: ExperimentConfig, paths: dict | None = None) -> DataFrame:
    """One row describing a run: time, parameters, data paths, modalities, versions."""
    now = datetime.now(timezone.utc)
    row = (
        f"exp_{now:%Y%m%d_%H%M%S}",
        now.replace(tzinfo=None),
        config.dataset,
        json.dumps(config.as_dict(), sort_keys=True),
        json.dumps({str(k): str(v) for k, v in (paths or {}).items()}, sort_keys=True),
        enabled_modalities(config),
        pyspark.__version__,
        platform.python_version(),
        spark.sparkContext.master,
    )
    schema = (
        "run_id string, started timestamp_ntz, dataset string, config string, data_paths string, "
        "modalities array<string>, spark_version string, python_version string, master string"
    )
    return spark.createDataFrame([row], schema)


def append_run(record: DataFrame, path: str) -> None:
    """Add a run record to the table of runs."""
    record.write.mode("append").parquet(path)
