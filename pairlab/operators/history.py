"""Reading an epoch log: when training stops and which epoch counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.operators.metrics import _names

RUN = ("run_id", "fold")


def _stop_state(log: Column, patience: int, delta: float, mode: str) -> Column:
    """Fold over the ordered (epoch, score) array; frozen once ``patience`` is used up."""
    if mode not in ("max", "min"):
        raise ValueError(f"unknown mode {mode!r}")
    start = F.struct(
        F.lit(None).cast("double").alias("best"),
        F.lit(0).alias("waited"),
        F.lit(None).cast("int").alias("stop"),
        F.lit(0.0).alias("top"),
        F.lit(None).cast("int").alias("top_epoch"),
    )

    def step(state: Column, row: Column) -> Column:
        value = row["score"]
        bar = state["best"] + delta if mode == "max" else state["best"] - delta
        better = value > bar if mode == "max" else value < bar
        # a null or NaN score improves nothing, whatever order Spark gives NaN
        known = value.isNotNull() & ~F.isnan(value)
        improved = known & (state["best"].isNull() | F.coalesce(better, F.lit(False)))
        waited = F.when(improved, F.lit(0)).otherwise(state["waited"] + 1)
        higher = known & F.coalesce(value > state["top"], F.lit(False))
        following = F.struct(
            F.when(improved, value).otherwise(state["best"]).alias("best"),
            waited.alias("waited"),
            # the very first score only sets the mark
            F.when(state["best"].isNotNull() & (waited >= patience), row["epoch"]).alias("stop"),
            F.when(higher, value).otherwise(state["top"]).alias("top"),
            F.when(higher, row["epoch"]).otherwise(state["top_epoch"]).alias("top_epoch"),
        )
        return F.when(state["stop"].isNotNull(), state).otherwise(following)

    return F.aggregate(log, start, step)


def _states(history: DataFrame, patience, delta, mode, max_epochs, keys, score) -> DataFrame:
    """One row per run with the final state; epochs after ``max_epochs`` are left out if it is given."""
    entry = F.struct(F.col("epoch").cast("int").alias("epoch"), F.col(score).cast("double").alias("score"))
    if max_epochs is not None:
        history = history.filter(F.col("epoch") <= max_epochs)
    rows = history.select(*keys, entry.alias("_r"))
    logs = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("_r")).alias("_log"))
    return logs.select(*keys, _stop_state(F.col("_log"), patience, delta, mode).alias("_s"))


def early_stop(
    history: DataFrame,
    patience: int = 5,
    delta: float = 0.001,
    mode: str = "max",
    max_epochs: int | None = None,
    by=RUN,
    score: str = "auc",
) -> DataFrame:
    """(run, stop_epoch, best_score): first epoch with ``patience`` non-improvements in a row.

    A score improves only if it beats the best by more than ``delta``; null and
    NaN scores do not.  ``stop_epoch`` is null for a run that is
    never stopped.
    """
    keys = _names(by)
    state = _states(history, patience, delta, mode, max_epochs, keys, score)
    return state.select(*keys, F.col("_s.stop").alias("stop_epoch"), F.col("_s.best").alias("best_score"))


def best_epoch(
    history: DataFrame,
    patience: int = 5,
    delta: float = 0.001,
    max_epochs: int | None = None,
    by=RUN,
    score: str = "auc",
) -> DataFrame:
    """(run, epoch, score): first epoch of the highest score above 0 up to the stop epoch."""
    keys = _names(by)
    state = _states(history, patience, delta, "max", max_epochs, keys, score)
    best = state.select(*keys, F.col("_s.top_epoch").alias("epoch"), F.col("_s.top").alias(score))
    return best.filter(F.col("epoch").isNotNull())
