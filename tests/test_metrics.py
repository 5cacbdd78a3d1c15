import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairlab.operators import curves, metrics

FEW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def scored(spark, rows):
    return spark.createDataFrame(rows, "fold int, label int, score double")


def auc_by_pairs(y, s):
    pos, neg = s[y == 1], s[y == 0]
    if not len(pos) or not len(neg):
        return None
    return float(np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)))


def ap_by_steps(y, s):
    if not y.sum():
        return None
    total, last = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        hit = y[s >= t]
        recall = hit.sum() / y.sum()
        total += (recall - last) * hit.mean()
        last = recall
    return float(total)


def curve_by_hand(y, s, kind):
    xs, ys = [0.0], [0.0 if kind == "roc" else 1.0]
    for t in sorted(set(s), reverse=True):
        tp, fp = (y[s >= t] == 1).sum(), (y[s >= t] == 0).sum()
        xs.append(fp / (y == 0).sum() if kind == "roc" else tp / y.sum())
        ys.append(tp / y.sum() if kind == "roc" else tp / (tp + fp))
    return np.array(xs), np.array(ys)


rows_of = st.lists(st.tuples(st.integers(0, 2), st.integers(0, 1), st.integers(0, 12).map(lambda v: v / 12)), min_size=3, max_size=80)


@FEW
@given(rows=rows_of)
def test_ranking_metrics_against_brute_force(spark, rows):
    df = scored(spark, rows)
    plain = {r.fold: r for r in metrics.evaluate(df, "fold", cuts=[]).collect()}
    ranged = {r.fold: r for r in metrics.evaluate(df.repartition(3), "fold", cuts=[0.25, 0.5, 0.75]).collect()}
    for fold in {r[0] for r in rows}:
        y = np.array([r[1] for r in rows if r[0] == fold])
        s = np.array([r[2] for r in rows if r[0] == fold])
        for got in (plain[fold], ranged[fold]):
            assert got.auc_roc == (None if auc_by_pairs(y, s) is None else pytest.approx(auc_by_pairs(y, s)))
            assert got.pr_auc == (None if ap_by_steps(y, s) is None else pytest.approx(ap_by_steps(y, s)))
            assert got.accuracy == pytest.approx(np.mean(y == (s > 0.5)))
            assert got.tp == ((y == 1) & (s > 0.5)).sum() and got.tn == ((y == 0) & (s <= 0.5)).sum()
    turned = {r.fold: r.auc_roc for r in metrics.auc_roc(df.withColumn("score", 1 - F.col("score")), "fold").collect()}
    for fold, got in plain.items():
        if got.auc_roc is not None:
            assert turned[fold] == pytest.approx(1 - got.auc_roc)


def test_one_class_and_empty_denominators(spark):
    df = scored(spark, [(0, 1, 0.2), (0, 1, 0.4), (1, 0, 0.5), (1, 0, 0.7)])
    rows = {r.fold: r for r in metrics.evaluate(df, "fold").collect()}
    assert rows[0].auc_roc is None and rows[0].pr_auc == 1.0 and rows[1].pr_auc is None
    assert (rows[0].precision, rows[0].recall, rows[0].f1) == (0.0, 0.0, 0.0)
    assert (rows[1].tn, rows[1].fp, rows[1].fn, rows[1].tp) == (1, 1, 0, 0)
    weights = {r.fold: r for r in metrics.class_weights(df, "fold").collect()}
    assert weights[0].weight_pos is None
    assert metrics.evaluate(df.filter("fold = 7"), "fold").collect() == []


def test_class_weights(spark):
    row = metrics.class_weights(scored(spark, [(0, 1, 0.1)] + [(0, 0, 0.1)] * 3)).first()
    assert (row.weight_neg, row.weight_pos) == pytest.approx((0.5, 1.5))


def test_given_predictions(spark):
    df = scored(spark, [(0, 1, 0.2), (0, 0, 0.9)]).withColumn("pred", F.col("label"))
    assert metrics.confusion_matrix(df, pred="pred").first() == (1, 0, 0, 1)
    assert metrics.accuracy(df, pred="pred").first()[0] == 1.0
    assert metrics.accuracy(df).first()[0] == 0.0


def test_summary_and_comparison(spark):
    df = scored(spark, [(f, (i * 7 + f) % 2, ((i * 13 + f * 5) % 17) / 17) for f in range(3) for i in range(30)])
    found = metrics.evaluate(df, "fold")
    folds = sorted(found.collect(), key=lambda r: r.fold)
    for row in metrics.cv_summary(found).collect():
        values = [getattr(r, row.metric) for r in folds]
        assert row["values"] == pytest.approx(values)
        assert row["mean"] == pytest.approx(np.mean(values)) and row["std"] == pytest.approx(np.std(values))
    assert metrics.metrics_comparison(found).count() == 18


@pytest.mark.parametrize("kind", ["roc", "pr"])
def test_curves_against_numpy(spark, kind):
    rng = np.random.default_rng(5)
    rows = [(f, int(rng.random() < 0.4), float(round(rng.random(), d))) for f, d in ((0, 1), (1, 6), (2, 2)) for _ in range(150)]
    df = scored(spark, rows)
    points = curves.curve_points(df, "fold", kind)
    same = curves.curve_points(df, "fold", kind, cuts=[0.3, 0.6])
    assert sorted(points.collect(), key=str) == sorted(same.collect(), key=str)
    grid = curves.interpolate_curve(points, "fold", kind)
    got = {(r.fold, r.i): r.y for r in grid.collect()}
    gx, read, areas = np.linspace(0, 1, 100), [], []
    for fold in range(3):
        y, s = (np.array([r[c] for r in rows if r[0] == fold]) for c in (1, 2))
        xs, ys = curve_by_hand(y, s, kind)
        want = np.interp(gx, xs, ys)
        if kind == "roc":
            want[0] = 0.0
        assert [got[fold, i] for i in range(100)] == pytest.approx(list(want))
        read.append(want)
        areas.append(auc_by_pairs(y, s) if kind == "roc" else ap_by_steps(y, s))
    mean, std = np.mean(read, axis=0), np.std(read, axis=0)
    if kind == "roc":
        mean[-1] = 1.0
    rows = sorted(curves.mean_curve(grid, kind).collect(), key=lambda r: r.i)
    assert [r["mean"] for r in rows] == pytest.approx(list(mean))
    assert [r.upper for r in rows] == pytest.approx(list(np.minimum(mean + std, 1)))
    assert [r.lower for r in rows] == pytest.approx(list(np.maximum(mean - std, 0)))
    out = curves.curve_summary(df, "fold", kind).first()
    area = np.trapezoid(mean, gx) if kind == "roc" else np.mean(areas)
    assert out.area == pytest.approx(area) and out.std == pytest.approx(np.std(areas))


def test_score_cuts_are_bounded_and_balanced(spark):
    df = spark.range(5000).select(F.lit(0).alias("fold"), (F.col("id") % 2).cast("int").alias("label"), (F.lit(0.5) + F.col("id") / 1e9).alias("score"))
    counts = metrics.score_counts(df, "fold")
    cuts = metrics.score_cuts(counts, 16)
    assert 10 <= len(cuts) <= 15
    sizes = [r["count"] for r in metrics._score_range(counts, cuts).groupBy("_range").count().collect()]
    assert max(sizes) < 800
    a, b = (metrics.auc_roc(df, "fold", cuts=c).first().auc_roc for c in ([], cuts))
    assert a == pytest.approx(b)


def test_a_null_group_counts_in_every_form(spark):
    rows = [(f, i % 2, i / 10) for i in range(10) for f in (None, 1)]
    df = spark.createDataFrame(rows, "fold int, label int, score double")
    for cuts in (None, [], [0.2, 0.5]):
        got = metrics.evaluate(df, cuts=cuts).collect()
        assert len(got) == 2 and len({tuple(r)[1:] for r in got}) == 1
