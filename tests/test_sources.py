import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pairlab.config import MODALITIES, SWITCHES, ExperimentConfig, dataset_catalogue, enabled_modalities, enabled_tables, input_dim
from pairlab.operators import folds, metrics
from pairlab.sources import outputs, tables


def test_configuration():
    cfg = ExperimentConfig()
    assert enabled_modalities(cfg) == list(SWITCHES) and input_dim(cfg) == 5940
    few = ExperimentConfig(enabled=("right_struct", "left_seq"))
    assert enabled_modalities(few) == ["left_seq", "right_struct"] and input_dim(few) == 640 + 1024
    assert enabled_tables(few) == [("left", "seq"), ("right", "graph"), ("right", "ecfp")]
    for bad in ({"enabled": ("x",)}, {"loss": "x"}, {"fusion": "x"}, {"classifier": "x"}):
        with pytest.raises(ValueError):
            ExperimentConfig(**bad)
    paths = dataset_catalogue("/data/", "miRNA-drug")
    assert set(paths["modalities"]) == set(MODALITIES) and paths["pairs"].startswith("/data/miRNA-drug/")
    with pytest.raises(ValueError):
        dataset_catalogue("/data", "other")


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_features_of_every_format(spark, tmp_path, fmt):
    schema = "RNA_ID double, f0 double, f1 double"
    rows = [(1.0, 0.1, 0.2), (2.0, 0.3, 0.4), (None, 9.0, 9.0), (1.0, 0.5, 0.6)]
    path = str(tmp_path / "t")
    df = spark.createDataFrame(rows, schema).coalesce(1)
    (df.write.option("header", True) if fmt == "csv" else df.write).format(fmt).save(path)
    out = {r.id: r.features for r in tables.read_features(spark, path, "RNA_ID", fmt, schema).collect()}
    assert out == {"1": pytest.approx([0.5, 0.6]), "2": pytest.approx([0.3, 0.4])}
    assert tables.read_features(spark, path, "RNA_ID", fmt, schema, unique=True).count() == 3
    if fmt == "csv":
        typed = tables.read_features(spark, path, "RNA_ID", fmt, id_type="double")
        assert sorted(r.id for r in typed.collect()) == ["1", "2"]
        assert sorted(r.id for r in tables.read_features(spark, path, "RNA_ID", fmt).collect()) == ["1.0", "2.0"]
    if fmt == "json":
        with pytest.raises(ValueError):
            tables.read_features(spark, path, "RNA_ID", fmt)


def test_last_row_wins_across_many_splits(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(3000, numPartitions=1).select((F.col("id") % 10).alias("k"), F.col("id").alias("v")).write.csv(path, header=True)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        read = tables.read_features(spark, path, "k", "csv")
        assert {r.id: r.features[0] for r in read.collect()} == {str(i): 2990.0 + i for i in range(10)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_modalities(spark, tmp_path):
    catalogue = dataset_catalogue(str(tmp_path), "lncRNA-drug")
    entry = catalogue["modalities"][("left", "seq")]
    spark.createDataFrame([(1, 0.5)], "RNA_ID int, f float").write.parquet(entry["path"])
    got = tables.load_modalities(spark, catalogue, [("left", "seq"), ("left", "struct")], optional=True, widths=False)
    assert list(got) == [("left", "seq")]
    with pytest.raises(FileNotFoundError):
        tables.load_modalities(spark, catalogue, [("left", "struct")])
    with pytest.raises(PySparkException, match="expected width 640, got 1"):
        tables.load_modalities(spark, catalogue, [("left", "seq")])["left", "seq"].collect()
    assert tables.check_widths(got["left", "seq"], 1).count() == 1


def test_pairs_keep_repeats(spark, tmp_path):
    path = str(tmp_path / "pairs")
    spark.createDataFrame([(1.0, " x "), (1.0, "x"), (None, "y")], "a double, b string").write.parquet(path)
    assert tables.read_pairs(spark, path, "a", "b").collect() == [("1", "x")] * 2


def test_splits_are_reused_only_for_equal_inputs(spark, tmp_path, pairs_of):
    pairs = pairs_of([(str(i), str(i % 3)) for i in range(30)])
    built = []

    def build(p):
        built.append(1)
        return folds.assign_folds(p.withColumn("label", F.lit(1)), 5, 42)

    root = str(tmp_path)
    a = outputs.cached_splits(pairs, root, {"k": 5}, build).select("left_id", "right_id", "label", "fold")
    b = outputs.cached_splits(pairs.repartition(4), root, {"k": 5}, build).select("left_id", "right_id", "label", "fold")
    assert sorted(a.collect()) == sorted(b.collect()) and len(built) == 1
    outputs.cached_splits(pairs, root, {"k": 4}, build)
    outputs.cached_splits(pairs.limit(29), root, {"k": 5}, build)
    assert len(built) == 3
    assert outputs.read_splits(spark, root, "absent") is None


@pytest.fixture
def scored(spark):
    rows = [(f"l{i}", f"r{i % 3}", i % 2, (i * 7 % 11) / 11, i % 3) for i in range(30)]
    return spark.createDataFrame(rows, "left_id string, right_id string, label int, score double, fold int")


def test_predictions_round_trip(spark, scored, tmp_path):
    for form, schema in (("simple", outputs.SIMPLE_SCHEMA), ("detail", outputs.DETAIL_SCHEMA)):
        path = str(tmp_path / form)
        outputs.write_predictions(scored, path, form)
        assert sorted(os.listdir(path))[-3:] == ["fold=0", "fold=1", "fold=2"]
        back = outputs.read_all_folds(spark, path, schema=schema)
        want = outputs.prediction_rows(scored, form)
        assert sorted(back.select(*want.columns).collect()) == sorted(want.collect())
    loose = [str(tmp_path / "detail" / f"fold={i}") for i in (0, 2, 9)]
    part = outputs.read_all_folds(spark, loose)
    assert part.count() == 20
    with pytest.raises(FileNotFoundError):
        outputs.read_all_folds(spark, [loose[2]])
    with pytest.raises(ValueError):
        outputs.prediction_rows(scored, "other")


def test_feature_exports(spark, scored, tmp_path):
    df = scored.withColumn("left_fused", F.array(F.col("score"), F.lit(1.0))).withColumn("left_seq", F.array(F.col("score")))
    outputs.write_fused_features(df, str(tmp_path / "f"), "left", 2)
    fused = outputs.read_all_folds(spark, str(tmp_path / "f"))
    assert fused.columns == ["left_id", "dim_0", "dim_1", "fold"] and fused.count() == 30
    outputs.write_raw_features(df, str(tmp_path / "r"), "left", {"seq": 1}, "parquet")
    raw = outputs.read_all_folds(spark, str(tmp_path / "r"), "parquet")
    assert raw.columns == ["left_id", "label", "left_seq_dim_0", "fold"]


def test_results_weights_and_runs(spark, scored, tmp_path):
    found = metrics.evaluate(scored, "fold")
    cfg = ExperimentConfig(n_folds=3)
    outputs.write_results(found, metrics.cv_summary(found), str(tmp_path / "res"), cfg)
    back = outputs.read_results(spark, str(tmp_path / "res"))
    assert back["config"]["n_folds"] == 3
    assert back["fold_results"].count() == 3 and back["aggregated"].count() == 6
    weights = spark.createDataFrame([("left", "seq", 0.5)], "side string, modality string, weight double")
    outputs.write_weights(weights, str(tmp_path / "w"))
    assert spark.read.json(str(tmp_path / "w")).first().weight == 0.5
    for _ in range(2):
        outputs.append_run(outputs.run_record(spark, cfg, dataset_catalogue("/d", cfg.dataset)), str(tmp_path / "runs"))
    runs = spark.read.parquet(str(tmp_path / "runs"))
    assert runs.count() == 2 and runs.first().run_id.startswith("exp_") and list(runs.first().modalities) == list(SWITCHES)
