import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pairlab.config import ExperimentConfig
from pairlab.functions.vectors import concat_vectors
from pairlab.operators import blocks, folds, metrics
from pairlab.plans import experiment, modelling


def world(spark, n_left=40, n_right=12, seed=0):
    """Pairs whose label follows from the entities' first numbers."""
    rng = np.random.default_rng(seed)
    left, right = rng.normal(size=(n_left, 6)), rng.normal(size=(n_right, 3))
    rows = [
        (f"l{i}", f"r{j}", int(left[i, 0] + right[j, 0] + 0.3 * rng.normal() > 0)) for i in range(n_left) for j in range(n_right)
    ]
    split = folds.assign_folds(spark.createDataFrame(rows, "left_id string, right_id string, label int"), 3, 1)

    def table(prefix, m):
        return spark.createDataFrame([(f"{prefix}{i}", [float(v) for v in r]) for i, r in enumerate(m)], "id string, features array<float>")

    tables = {
        ("left", "seq"): table("l", left[:, :4]),
        ("left", "struct"): table("l", left[:, 4:]),
        ("right", "seq"): table("r", right[:, :2]),
        ("right", "graph"): table("r", right[:, 2:]),
        ("right", "ecfp"): table("r", right[:, 1:2]),
    }
    return split, tables


CFG = ExperimentConfig(n_folds=3, common_dim=4, parallel_folds=3)


def test_cross_validation_learns(spark):
    split, tables = world(spark)
    run = experiment.cross_validate(split, tables, ExperimentConfig(n_folds=3, fusion="concat", parallel_folds=3))
    assert run.predictions.count() == split.count()
    same = run.predictions.select("left_id", "right_id", "label", "fold")
    assert sorted(same.collect()) == sorted(split.select(*same.columns).collect())
    for row in run.metrics.collect():
        assert row.auc_roc > 0.85 and row.tp + row.tn + row.fp + row.fn == 160
    assert {r.metric for r in run.summary.collect()} == {"accuracy", "auc_roc", "pr_auc", "f1", "precision", "recall"}


def test_pooled_fusion_and_weighted_loss(spark):
    split, tables = world(spark)
    cfg = ExperimentConfig(n_folds=3, common_dim=4, parallel_folds=3, loss="weighted_ce")
    run = experiment.cross_validate(split, tables, cfg)
    assert all(r.auc_roc > 0.6 and r.loss > 0 for r in run.metrics.collect())


@pytest.mark.parametrize("kind", ["logistic", "mlp", "gbt"])
def test_classifiers(spark, kind):
    split, tables = world(spark, 25, 8)
    left = experiment.side_entities(tables, "left", CFG)
    right = experiment.side_entities(tables, "right", CFG)
    cfg = ExperimentConfig(n_folds=3, fusion="concat")
    rows = experiment.fold_features(split, left, right, 0, cfg).withColumn("features", concat_vectors("left_fused", "right_fused"))
    params = {"mlp": {"hidden": 8, "maxIter": 60}, "gbt": {"maxIter": 5}}.get(kind, {})
    model = modelling.fit_fold(folds.train_part(rows, 0), kind=kind, params=params, weighting=kind != "mlp")
    out = modelling.score(model, folds.val_part(rows, 0))
    assert metrics.auc_roc(out).first().auc_roc > 0.7
    assert out.filter("pred <> cast(score > 0.5 as int)").count() == 0


def test_the_network_takes_no_class_weights(spark):
    for given in ({"weighting": True}, {"weights": (1.0, 2.0)}):
        with pytest.raises(ValueError, match="no class weights"):
            modelling.fit_fold(spark.range(1), kind="mlp", **given)


def test_projection_is_fitted_on_the_given_rows_only(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(2.0, 3.0, (60, 5))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, v array<double>")
    fit = x[:40]
    z = (x - fit.mean(0)) / fit.std(0, ddof=1)
    wide = modelling.project_modality(df.filter("i < 40"), "v", 2)(df).orderBy("i").collect()
    _, vec = np.linalg.eigh(np.cov(z[:40].T))
    want = z @ vec[:, ::-1][:, :2]
    got = np.array([r.v for r in wide])
    assert np.abs(np.abs(got) - np.abs(want)).max() < 1e-6
    narrow = modelling.project_modality(df.filter("i < 40"), "v", 7)(df).orderBy("i").collect()
    assert np.abs(np.array([r.v for r in narrow]) - np.hstack([z, np.zeros((60, 2))])).max() < 1e-6


def test_views_exist_only_with_both_sides(spark):
    split, tables = world(spark, 10, 5)
    assert experiment.fused_features(split, tables, CFG).count() == 50
    out = experiment.projection_2d(split, tables, CFG)
    assert {r.view: r["count"] for r in out.groupBy("view").count().collect()} == {"sequence": 50, "structure": 50, "fused": 50}
    with pytest.raises(ValueError, match="no view"):
        experiment.projection_2d(split, {k: t for k, t in tables.items() if k[1] != "struct" or k[0] == "right"}, CFG, {"structure": (("struct",), ("struct",))})


def arrays(spark, split, tables, side, fold, modality):
    """A side's vectors of one modality by id, standardised over the training entities of a fold."""
    vectors = {r.id: np.array(r.features, float) for r in tables[side, modality].collect()}
    train = sorted({r[f"{side}_id"] for r in split.filter(F.col("fold") != fold).collect()})
    x = np.array([vectors[i] for i in train])
    return {i: (v - x.mean(0)) / x.std(0, ddof=1) for i, v in vectors.items()}, train


def test_modality_features_and_planes_equal_plain_ones(spark):
    split, tables = world(spark, 12, 6)
    cfg = ExperimentConfig(n_folds=3, common_dim=2, enabled=("left_seq", "right_seq"))
    got = {(r.left_id, r.right_id): r for r in experiment.modality_features(split, tables, cfg).collect()}
    planes = {(r.left_id, r.right_id, r.view): (r.x, r.y) for r in experiment.projection_2d(split, tables, cfg).collect()}
    for fold in range(3):
        left, train = arrays(spark, split, tables, "left", fold, "seq")
        right, _ = arrays(spark, split, tables, "right", fold, "seq")
        _, axes = np.linalg.eigh(np.cov(np.array([left[i] for i in train]).T))
        axes = axes[:, ::-1][:, :2]
        axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), [0, 1]] < 0, -1, 1)
        rows = split.filter(F.col("fold") == fold).collect()
        z = np.array([np.concatenate([left[r.left_id] @ axes, right[r.right_id]]) for r in rows])
        for r, v in zip(rows, z, strict=True):
            mine = got[r.left_id, r.right_id]
            assert np.concatenate([mine.left_seq, mine.right_seq]) == pytest.approx(v, abs=1e-9)
        _, plane = np.linalg.eigh(np.cov(z.T))
        want = z @ plane[:, ::-1][:, :2]
        for r, v in zip(rows, want, strict=True):
            assert np.abs(planes[r.left_id, r.right_id, "sequence"]) == pytest.approx(np.abs(v), abs=1e-8)


def test_joint_fit_equals_a_plain_newton_search(spark, monkeypatch):
    monkeypatch.setattr(blocks, "MOST_PLACES", 4)
    split, tables = world(spark)
    cfg = ExperimentConfig(n_folds=3, common_dim=3, fusion="pooled", classifier_params={"tol": 1e-10, "maxIter": 200, "regParam": 1e-3})
    run = experiment.cross_validate(split, {k: t for k, t in tables.items() if k[1] == "seq"}, cfg)
    got = {(r.left_id, r.right_id): r.score for r in run.predictions.collect()}
    for fold in range(3):
        sides = []
        for side in ("left", "right"):
            z, train = arrays(spark, split, tables, side, fold, "seq")
            x = np.array([z[i] for i in train])
            if x.shape[1] > 3:
                _, axes = np.linalg.eigh(np.cov(x.T))
                z = {i: v @ axes[:, ::-1][:, :3] for i, v in z.items()}
            sides.append(z)
        rows = split.collect()
        x = np.array([np.concatenate([sides[0][r.left_id], sides[1][r.right_id], [1.0]]) for r in rows])
        y, train = np.array([r.label for r in rows]), np.array([r.fold != fold for r in rows])
        w, ridge = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, 1e-3), 0)
        for _ in range(30):
            p = 1 / (1 + np.exp(-x[train] @ w))
            hess = (x[train] * (p * (1 - p))[:, None]).T @ x[train] / train.sum() + np.diag(ridge)
            w = w - np.linalg.solve(hess, x[train].T @ (p - y[train]) / train.sum() + ridge * w)
        for r, s in zip(rows, 1 / (1 + np.exp(-x @ w)), strict=True):
            if r.fold == fold:
                assert got[r.left_id, r.right_id] == pytest.approx(s, abs=1e-6)


def jobs_of(spark, action):
    tracker = spark.sparkContext.statusTracker()
    group = f"count-{id(action)}"
    spark.sparkContext.setJobGroup(group, "counted")
    action()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(tracker.getJobIdsForGroup(group))


def test_jobs_do_not_grow_with_folds_or_modalities(spark):
    rng = np.random.default_rng(5)
    pairs = spark.createDataFrame([(f"l{i}", f"r{j}", int(rng.integers(0, 2))) for i in range(20) for j in range(6)], "left_id string, right_id string, label int")
    # vectors without information: every run stops after the same single step
    tables = {(s, m): spark.createDataFrame([(f"{s[0]}{i}", [1.0, 2.0]) for i in range(20)], "id string, features array<float>") for s in ("left", "right") for m in ("seq", "disease")}
    counts = []
    for k, names in ((2, ("left_seq", "right_seq")), (5, ("left_seq", "right_seq")), (5, tuple(f"{s}_{m}" for s in ("left", "right") for m in ("seq", "disease")))):
        split = experiment.materialise(folds.assign_folds(pairs, k, 1), "split")
        cfg = ExperimentConfig(n_folds=k, common_dim=2, enabled=names)
        counts.append(jobs_of(spark, lambda: experiment.joint_runs(split, tables, {"a": cfg, "b": cfg})))
    assert max(counts) - min(counts) <= 4 and counts[1] <= counts[0] + 2, counts  # the planner may add or merge a stage


def test_ablation_has_rows_per_subset(spark):
    split, tables = world(spark, 25, 8)
    cfg = ExperimentConfig(n_folds=3, fusion="concat", parallel_folds=3)
    out = experiment.ablation(split, tables, cfg, [("left_seq", "right_seq"), ("left_struct", "right_struct")])
    best = {r.modalities: r.auc for r in out.groupBy("modalities").agg(F.avg("auc_roc").alias("auc")).collect()}
    assert best["left_seq+right_seq"] > best["left_struct+right_struct"]


def test_external_model_on_batch_and_stream(spark, tmp_path):
    def make():
        def predict(a, b):
            return 1.0 / (1.0 + np.exp(a - b))

        return predict

    df = spark.createDataFrame([(float(i), float(i % 3)) for i in range(20)], "a double, b double")
    col = modelling.score_with(make, ["a", "b"])
    got = {r.a: r.s for r in df.withColumn("s", col).collect()}
    assert got[4.0] == pytest.approx(1 / (1 + np.exp(3.0)))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).withColumn("s", col)
    query = stream.writeStream.format("memory").queryName("scores").start()
    query.processAllAvailable()
    query.stop()
    assert {r.a: r.s for r in spark.table("scores").collect()} == got


def test_splits_of_a_whole_run(spark, pairs_of):
    pairs = pairs_of([(f"l{i % 20}", f"r{i % 7}") for i in range(60)])
    split = experiment.prepare_splits(pairs, ExperimentConfig())
    rows = split.collect()
    assert sum(r.label for r in rows) == sum(1 - r.label for r in rows) == 60
    assert len({(r.left_id, r.right_id) for r in rows}) == 120
    repeated = experiment.prepare_splits(pairs.union(pairs.limit(5)), ExperimentConfig(dedupe=False))
    assert repeated.filter("label = 1").count() == 65


def test_gaps_in_features(spark):
    split, tables = world(spark, 20, 8)
    tables = {k: t for k, t in tables.items() if k[1] == "seq"}
    tables["left", "struct"] = tables["left", "seq"].filter("id <> 'l3'")
    known = split.filter("left_id <> 'l3'").count()
    for fusion in ("concat", "pooled"):
        counts = {}
        for missing in ("zeros", "drop"):
            cfg = ExperimentConfig(n_folds=3, fusion=fusion, common_dim=4, missing=missing, parallel_folds=3)
            counts[missing] = experiment.cross_validate(split, tables, cfg).predictions.count()
        assert counts == {"zeros": split.count(), "drop": known}
    with pytest.raises(PySparkException, match="no left_fused vector for l3"):
        experiment.cross_validate(split, tables, ExperimentConfig(n_folds=3, fusion="concat"))


def test_training_class_weights(spark):
    split, _ = world(spark, 20, 8)
    weights = experiment.training_class_weights(split)
    for fold, (w0, w1) in weights.items():
        row = metrics.class_weights(folds.train_part(split, fold)).first()
        assert (w0, w1) == pytest.approx((row.weight_neg, row.weight_pos))
    scored = split.withColumn("score", F.lit(0.3))
    got = {r.fold: r.loss for r in metrics.evaluate(scored, "fold", loss="weighted_ce", weights=weights).collect()}
    for fold, (w0, w1) in weights.items():
        val = folds.val_part(scored, fold)
        n0, n1 = val.filter("label = 0").count(), val.filter("label = 1").count()
        want = -(w1 * n1 * np.log(0.3) + w0 * n0 * np.log(0.7)) / (w1 * n1 + w0 * n0)
        assert got[fold] == pytest.approx(want)
