"""ROC and precision-recall curves, their common grid, means and areas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.operators.metrics import _names, average_precision, auc_roc, score_steps

GRID_POINTS = 100


def curve_points(df: DataFrame, by="fold", kind: str = "roc", cuts: Sequence[float] | None = None) -> DataFrame:
    """(group, threshold, x, y) per distinct score, plus the curve's start point.

    ROC: x = false positive rate, y = true positive rate, start (0, 0).
    PR: x = recall, y = precision, start (0, 1).  The start has no threshold.
    """
    keys = _names(by)
    steps = score_steps(df, keys, cuts=cuts, totals=True)
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    pos, neg = F.nullif(F.col("pos"), F.lit(0)), F.nullif(F.col("neg"), F.lit(0))
    if kind == "roc":
        x, y, y0 = fp / neg, tp / pos, 0.0
    elif kind == "pr":
        x, y, y0 = tp / pos, tp / (tp + fp), 1.0
    else:
        raise ValueError(f"unknown curve {kind!r}")
    point = F.struct(F.col("score").alias("threshold"), x.alias("x"), y.alias("y"))
    start = F.struct(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("x"), F.lit(y0).alias("y"))
    # the highest score of a group, and only it, has nothing counted above it
    highest = (F.col("tp") == F.col("p")) & (F.col("fp") == F.col("n"))
    return steps.select(*keys, F.inline(F.when(highest, F.array(start, point)).otherwise(F.array(point))))


def _grid_x(i: Column, n: int) -> Column:
    """The i-th of n evenly spaced values 0 .. 1."""
    return F.when(i == n - 1, F.lit(1.0)).otherwise(i.cast("double") * F.lit(1.0 / (n - 1)))


def interpolate_curve(points: DataFrame, by="fold", kind: str = "roc", n: int = GRID_POINTS) -> DataFrame:
    """(group, i, x, y): the curve read off linearly at n even x values.

    Each grid cell keeps only its first and last curve point, one mergeable
    aggregate with at most 2n rows per group; neighbours are then looked up
    among those few rows.  Of points with equal x the last counts to its right
    and the first to its left.  ROC curves are 0 at the first grid value.
    """
    keys = _names(by)
    # order of equal x along the curve: tpr rises, precision falls
    rise = F.col("y") if kind == "roc" else -F.col("y")
    guess = F.least(F.lit(n - 1), F.floor(F.col("x") * (n - 1)).cast("int"))
    low = F.when(F.col("x") < _grid_x(guess, n), guess - 1).when(
        (guess < n - 1) & (F.col("x") >= _grid_x(guess + 1, n)), guess + 1
    ).otherwise(guess)
    placed = points.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).select(
        *keys, "x", "y", rise.alias("_s"), low.alias("_i")
    )
    # even cells sit exactly on a grid value, odd cells lie right of it
    cell = 2 * F.col("_i") + (F.col("x") > _grid_x(F.col("_i"), n)).cast("int")
    point = F.struct("x", "_s", "y")
    cells = placed.groupBy(*keys, cell.alias("_cell")).agg(F.min(point).alias("_first"), F.max(point).alias("_last"))
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    own = F.struct(
        F.col("_cell").cast("double").alias("_at"), "_first", "_last", F.lit(None).cast("int").alias("i")
    )
    none = F.lit(None).cast(placed.select(point.alias("p")).schema["p"].dataType)
    # a grid value comes after the points on it and before those right of it
    marks = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.struct((2.0 * i + 0.5).alias("_at"), none.alias("_first"), none.alias("_last"), i.alias("i")),
    )
    # the group's first cell also brings the grid, so that the curve is read only once
    numbered = cells.withColumn("_no", F.row_number().over(group.orderBy("_cell")))
    rows = numbered.select(
        *keys, F.inline(F.when(F.col("_no") == 1, F.concat(F.array(own), marks)).otherwise(F.array(own)))
    )
    along = group.orderBy("_at")
    before = F.last("_last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("_first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing))
    near = rows.select(*keys, "i", before.alias("_a"), after.alias("_b")).filter("i is not null")
    gx = _grid_x(F.col("i"), n)
    ax, ay, bx, by_ = F.col("_a.x"), F.col("_a.y"), F.col("_b.x"), F.col("_b.y")
    slope = (by_ - ay) / (bx - ax)
    read = F.when((ax == gx) | bx.isNull(), ay).otherwise(slope * (gx - ax) + ay)
    if kind == "roc":
        read = F.when(F.col("i") == 0, F.lit(0.0)).otherwise(read)
    return near.select(*keys, "i", gx.alias("x"), read.alias("y"))


def mean_curve(grid: DataFrame, kind: str = "roc", n: int = GRID_POINTS) -> DataFrame:
    """(i, x, mean, std, lower, upper) over all groups; the ROC mean ends at 1."""
    agg = grid.groupBy("i").agg(
        F.first("x").alias("x"), F.avg("y").alias("_mean"), F.stddev_pop("y").alias("std")
    )
    mean = F.col("_mean")
    if kind == "roc":
        mean = F.when(F.col("i") == n - 1, F.lit(1.0)).otherwise(mean)
    out = agg.withColumn("mean", mean)
    return out.select(
        "i",
        "x",
        "mean",
        "std",
        F.greatest(F.col("mean") - F.col("std"), F.lit(0.0)).alias("lower"),
        F.least(F.col("mean") + F.col("std"), F.lit(1.0)).alias("upper"),
    )


def curve_area(points: DataFrame, by=None, x: str = "x", y: str = "y", order: Sequence[str] = ("x", "y")) -> DataFrame:
    """Trapezoid area under an ordered curve; meant for gridded curves."""
    keys = _names(by)
    along = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)
    piece = (F.col(x) - F.lag(x).over(along)) * (F.col(y) + F.lag(y).over(along)) / F.lit(2.0).cast("double")
    return points.select(*keys, piece.alias("_piece")).groupBy(*keys).agg(F.sum("_piece").alias("area"))


def curve_summary(df: DataFrame, by="fold", kind: str = "roc", cuts: Sequence[float] | None = None) -> DataFrame:
    """(area, std) of a cross-validated curve.

    ROC: area of the mean curve with the deviation of the fold areas.
    PR: mean and deviation of the fold average precisions.
    """
    if kind == "pr":
        folds = average_precision(df, by, cuts)
        return folds.groupBy().agg(F.avg("pr_auc").alias("area"), F.stddev_pop("pr_auc").alias("std"))
    mean = mean_curve(interpolate_curve(curve_points(df, by, kind, cuts), by, kind), kind)
    area = curve_area(mean, y="mean", order=("i",)).select("area", F.lit(None).cast("double").alias("std"))
    spread = auc_roc(df, by, cuts).groupBy().agg(F.stddev_pop("auc_roc").alias("std"))
    rows = area.unionByName(spread, allowMissingColumns=True)
    return rows.groupBy().agg(F.max("area").alias("area"), F.max("std").alias("std"))
