"""Exact classification metrics per group.

Rows are first collapsed to one row per (group, score) with map-side combining;
everything else is computed from that table.  Running counts over descending
scores use one window per (group, score range).  There is a range for every
million distinct scores, cut at approximate quantiles, so no task receives more
than about that many and any clustering of scores is balanced.  The cuts only steer the work: results
are exact for every choice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.config import METRICS
from pairlab.functions.losses import class_weight, row_loss
from pairlab.functions.scores import predict_label
from pairlab.operators.ranking import null_safe_join
from pairlab.session import materialise

RANGE_SCORES = 1_000_000
MOST_RANGES = 10_000


def _names(by) -> list[str]:
    return [] if by is None else [by] if isinstance(by, str) else list(by)


def score_counts(df: DataFrame, by=None, label: str = "label", score: str = "score") -> DataFrame:
    """(group, score, p, n): positives and negatives per distinct score."""
    return df.groupBy(*_names(by), F.col(score).cast("double").alias("score")).agg(
        F.sum(F.col(label).cast("bigint")).alias("p"),
        F.sum(1 - F.col(label).cast("bigint")).alias("n"),
    )


def score_cuts(counts: DataFrame, ranges: int | None = None) -> list[float]:
    """Up to ``ranges - 1`` inner quantiles of the distinct scores; by default as many ranges as the scores need."""
    if ranges is None:
        ranges = min(MOST_RANGES, -(-counts.count() // RANGE_SCORES))
    if ranges <= 1:
        return []
    shares = [i / ranges for i in range(1, ranges)]
    cuts = counts.agg(F.percentile_approx("score", shares, 10 * ranges).alias("c")).first()["c"]
    return sorted(set(cuts or []))


def _score_range(counts: DataFrame, cuts: Sequence[float]) -> DataFrame:
    if not cuts:
        return counts.withColumn("_range", F.lit(0.0))
    splits = [-float("inf"), *cuts, float("inf")]
    ranged = Bucketizer(splits=splits, inputCol="score", outputCol="_range", handleInvalid="keep").transform(counts)
    # never null, so that no filter on it moves below the shared exchange
    return ranged.withColumn("_range", F.coalesce("_range", F.lit(-1.0)))


def score_steps(
    df: DataFrame,
    by=None,
    label: str = "label",
    score: str = "score",
    cuts: Sequence[float] | None = None,
    totals: bool = False,
) -> DataFrame:
    """(group, score, p, n, tp, fp): counts at or above each distinct score.

    ``totals`` adds the group's ``pos`` and ``neg``.  ``cuts=None`` takes as many
    score ranges as the distinct scores need; pass a list (maybe empty) to fix
    them.  A null group is a group of its own.
    """
    keys = _names(by)
    counts = score_counts(df, keys, label, score)
    if cuts is None:
        counts = materialise(counts, "score-counts")
        cuts = score_cuts(counts)
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    upto = (Window.unboundedPreceding, Window.currentRow)
    ranged = _score_range(counts, cuts)
    inside = Window.partitionBy(*keys, "_range").orderBy(F.desc("score")).rowsBetween(*upto)
    local = ranged.withColumn("_tp", F.sum("p").over(inside)).withColumn("_fp", F.sum("n").over(inside))
    sums = ranged.groupBy(*keys, "_range").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    above = group.orderBy(F.desc("_range")).rowsBetween(*upto)
    offsets = sums.select(
        *keys,
        "_range",
        (F.sum("_p").over(above) - F.col("_p")).alias("_tp0"),
        (F.sum("_n").over(above) - F.col("_n")).alias("_fp0"),
        F.sum("_p").over(group).alias("pos"),
        F.sum("_n").over(group).alias("neg"),
    )
    joined = null_safe_join(local, offsets, [*keys, "_range"])
    return joined.select(
        *keys,
        "score",
        "p",
        "n",
        (F.col("_tp") + F.col("_tp0")).alias("tp"),
        (F.col("_fp") + F.col("_fp0")).alias("fp"),
        *(["pos", "neg"] if totals else []),
    )


def _double(name: str) -> Column:
    return F.col(name).cast("double")


def _ratio(top: Column, bottom: Column) -> Column:
    """Quotient that is 0 where the denominator is 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top.cast("double") / F.nullif(bottom, F.lit(0)))


def _auc_terms() -> tuple[Column, Column, Column]:
    pos, neg = F.sum("p").cast("double"), F.sum("n").cast("double")
    # half of the positives tied with a negative count as ranked above it
    area = F.sum(_double("n") * (_double("tp") - _double("p") / F.lit(2.0).cast("double")))
    return area, pos, neg


def _auc_expr() -> Column:
    area, pos, neg = _auc_terms()
    return area / F.nullif(pos * neg, F.lit(0.0))


def _ap_expr() -> Column:
    _, pos, _ = _auc_terms()
    hits = F.sum(_double("p") * _double("tp") / (_double("tp") + _double("fp")))
    return hits / F.nullif(pos, F.lit(0.0))


def _grouped(df: DataFrame, by):
    return df.groupBy(*_names(by))


def confusion_matrix(df: DataFrame, by=None, label: str = "label", score: str = "score", pred: str | None = None) -> DataFrame:
    """tn, fp, fn, tp per group, always all four columns."""
    y = F.col(label) == 1
    yes = (F.col(pred) if pred else predict_label(score)) == 1
    return _grouped(df, by).agg(
        F.count_if(~y & ~yes).alias("tn"),
        F.count_if(~y & yes).alias("fp"),
        F.count_if(y & ~yes).alias("fn"),
        F.count_if(y & yes).alias("tp"),
    )


def accuracy(df: DataFrame, by=None, label: str = "label", score: str = "score", pred: str | None = None) -> DataFrame:
    """Share of rows whose predicted label is right."""
    yes = F.col(pred) if pred else predict_label(score)
    return _grouped(df, by).agg(F.avg((F.col(label) == yes).cast("int")).alias("accuracy"))


def _prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    return [
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    ]


def precision_recall_f1(df: DataFrame, by=None, label: str = "label", score: str = "score", pred: str | None = None) -> DataFrame:
    """Precision, recall and F1 per group; an empty denominator gives 0."""
    cells = confusion_matrix(df, by, label, score, pred)
    return cells.select(*_names(by), *_prf(F.col("tp"), F.col("fp"), F.col("fn")))


def auc_roc(df: DataFrame, by=None, cuts: Sequence[float] | None = None) -> DataFrame:
    """Exact area under the ROC curve, ties counting half; null for one-class groups."""
    return _grouped(score_steps(df, by, cuts=cuts), by).agg(_auc_expr().alias("auc_roc"))


def average_precision(df: DataFrame, by=None, cuts: Sequence[float] | None = None) -> DataFrame:
    """Step-wise average precision over distinct scores; null without positives."""
    return _grouped(score_steps(df, by, cuts=cuts), by).agg(_ap_expr().alias("pr_auc"))


def class_weights(df: DataFrame, by=None, label: str = "label") -> DataFrame:
    """weight_neg, weight_pos: inverse class counts scaled to sum 2; null if a class is absent."""
    counts = _grouped(df, by).agg(
        F.count_if(F.col(label) == 0).cast("double").alias("_neg"),
        F.count_if(F.col(label) == 1).cast("double").alias("_pos"),
    )
    rows = F.nullif(F.col("_neg") + F.col("_pos"), F.lit(0.0))
    both = (F.col("_neg") > 0) & (F.col("_pos") > 0)
    return counts.select(
        *_names(by),
        F.when(both, 2.0 * F.col("_pos") / rows).alias("weight_neg"),
        F.when(both, 2.0 * F.col("_neg") / rows).alias("weight_pos"),
    )


def _weight_pair(weights, keys: Sequence[str]) -> tuple[Column, Column]:
    """(class 0, class 1) weights: a fixed pair, or one pair per group value."""
    if not isinstance(weights, Mapping):
        return class_weight(F.lit(0), weights), class_weight(F.lit(1), weights)
    (key,) = keys

    def pick(side: int) -> Column:
        entries = [F.lit(v) for group, pair in weights.items() for v in (group, float(pair[side]))]
        return F.create_map(*entries)[F.col(key)]

    return pick(0), pick(1)


def evaluate(
    df: DataFrame,
    by="fold",
    label: str = "label",
    score: str = "score",
    loss: str = "ce",
    weights: Sequence[float] | Mapping | None = None,
    cuts: Sequence[float] | None = None,
    **loss_params,
) -> DataFrame:
    """One row per group: six metrics, the confusion matrix and the mean loss.

    ``weights`` are the [class 0, class 1] weights of the weighted_ce loss, or a
    mapping from the (single) group's values to such pairs.  One aggregate per (group, score), one window, one final aggregate.
    """
    keys = _names(by)
    steps = score_steps(df, keys, label, score, cuts)
    yes = predict_label("score") == 1
    one, zero = F.lit(1), F.lit(0)

    def total(name: str, keep: Column) -> Column:
        return F.sum(F.when(keep, F.col(name)).otherwise(F.lit(0).cast("bigint")))

    w0, w1 = _weight_pair(weights if loss == "weighted_ce" else None, keys)
    lost = w1 * _double("p") * row_loss(loss, one, "score", **loss_params) + w0 * _double("n") * row_loss(
        loss, zero, "score", **loss_params
    )
    base = steps.groupBy(*keys).agg(
        total("n", ~yes).alias("tn"),
        total("n", yes).alias("fp"),
        total("p", ~yes).alias("fn"),
        total("p", yes).alias("tp"),
        _auc_expr().alias("auc_roc"),
        _ap_expr().alias("pr_auc"),
        (F.sum(lost) / F.sum(w1 * _double("p") + w0 * _double("n"))).alias("loss"),
    )
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    precision, recall, f1 = _prf(tp, fp, fn)
    return base.select(
        *keys,
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        "auc_roc",
        "pr_auc",
        f1,
        precision,
        recall,
        "tn",
        "fp",
        "fn",
        "tp",
        "loss",
    )


def metric_rows(metrics: DataFrame, by="fold") -> DataFrame:
    """(group, metric, value): the six metrics in long form."""
    return metrics.unpivot(_names(by), list(METRICS), "metric", "value")


def cv_summary(metrics: DataFrame, by: str = "fold") -> DataFrame:
    """(metric, mean, std, values): population deviation and the values in fold order."""
    ordered = F.array_sort(F.collect_list(F.struct(by, "value")))
    return metric_rows(metrics, by).groupBy("metric").agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.transform(ordered, lambda x: x["value"]).alias("values"),
    )


def metrics_comparison(metrics: DataFrame, by: str = "fold") -> DataFrame:
    """(fold, metric, value, mean): every fold's value beside the metric's mean."""
    rows = metric_rows(metrics, by)
    return rows.withColumn("mean", F.avg("value").over(Window.partitionBy("metric")))
