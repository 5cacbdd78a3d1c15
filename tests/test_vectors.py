import math

import numpy as np
import pytest
from pyspark.errors import PySparkException

from pairlab.functions import losses, scores, vectors
from pairlab.plans.modelling import fusion


@pytest.fixture
def df(spark):
    return spark.createDataFrame([([1.0, 2.0], [3.0, 5.0], [0.0, 1.0, 2.0])], "a array<double>, b array<double>, c array<double>")


def one(df, col):
    return df.select(col.alias("v")).first()["v"]


def test_pooling(df):
    assert one(df, vectors.weighted_pool(["a"])) == [1.0, 2.0]
    assert one(df, vectors.weighted_pool(["a", "b"])) == pytest.approx([2.0, 3.5])
    share = np.exp([0.3, 1.2]) / np.exp([0.3, 1.2]).sum()
    assert one(df, vectors.weighted_pool(["a", "b"], [0.3, 1.2])) == pytest.approx(
        list(share[0] * np.array([1.0, 2.0]) + share[1] * np.array([3.0, 5.0]))
    )
    with pytest.raises(PySparkException, match="differ in length"):
        one(df, vectors.weighted_pool(["a", "c"]))
    with pytest.raises(ValueError):
        vectors.weighted_pool(["a", "b"], [1.0])


def test_concat_pad_and_normalise(df):
    assert one(df, vectors.concat_vectors("a", "c")) == [1.0, 2.0, 0.0, 1.0, 2.0]
    assert one(df, vectors.pad_vector("a", 4)) == [1.0, 2.0, 0.0, 0.0]
    assert one(df, vectors.pad_vector("c", 2)) == [0.0, 1.0, 2.0]
    assert one(df, vectors.row_normalise("c")) == pytest.approx([-math.sqrt(1.5), 0.0, math.sqrt(1.5)])
    assert list(df.select(*vectors.explode_vector("c", "d", 3)).first()) == [0.0, 1.0, 2.0]
    assert df.select(*vectors.explode_vector("a", "d", 3)).first()["d2"] is None


def test_fusion(df):
    assert one(df, fusion("pooled", ["a", "b"], ["c"])) == pytest.approx([2.0, 3.5, 0.0, 1.0, 2.0])
    assert one(df, fusion("concat", ["a", "b"], ["c"])) == [1.0, 2.0, 3.0, 5.0, 0.0, 1.0, 2.0]
    with pytest.raises(ValueError):
        fusion("other", ["a"], ["b"])


def test_normalised_weights(spark):
    raw = {"left": {"seq": 0.5, "struct": 0.5}, "right": {"seq": 1.0}}
    rows = vectors.normalised_weights(spark, raw).collect()
    assert {(r.side, r.modality): r.weight for r in rows} == {("left", "seq"): 0.5, ("left", "struct"): 0.5}


def test_softmax_and_labels(spark):
    df = spark.createDataFrame([([1000.0, 1001.0],), ([0.0, 0.0],)], "z array<double>")
    got = df.select(scores.softmax("z").alias("p"), scores.positive_score("z").alias("s")).collect()
    assert got[0].p == pytest.approx([1 / (1 + math.e), math.e / (1 + math.e)])
    assert got[0].s == pytest.approx(got[0].p[1])
    assert [r[0] for r in df.select(scores.predict_label(scores.positive_score("z"))).collect()] == [1, 0]


def test_losses_against_numpy(spark):
    rng = np.random.default_rng(1)
    z, y = rng.normal(0, 3, (50, 2)), rng.integers(0, 2, 50)
    df = spark.createDataFrame([(int(t), [float(a), float(b)]) for t, (a, b) in zip(y, z)], "label int, z array<double>")
    df = df.withColumn("score", scores.positive_score("z"))
    logp = z - np.log(np.exp(z).sum(1, keepdims=True))
    ce = -logp[np.arange(50), y]
    pt = np.exp(-ce)
    at = np.where(y == 1, 0.25, 0.75)
    w = np.where(y == 1, 1.5, 0.5)
    want = {
        "ce": ce.mean(),
        "focal": (at * (1 - pt) ** 2 * ce).mean(),
        "label_smoothing": (-0.9 * logp[np.arange(50), y] - 0.1 * logp[np.arange(50), 1 - y]).mean(),
        "weighted_ce": (w * ce).sum() / w.sum(),
    }
    for kind, value in want.items():
        for source in ({"logits": "z"}, {"score": "score"}):
            got = df.agg(losses.loss(kind, "label", weights=(0.5, 1.5), **source)).first()[0]
            assert got == pytest.approx(value, rel=1e-9), (kind, source)
    assert df.agg(losses.loss("focal", "label", "score", reduction="sum")).first()[0] == pytest.approx(want["focal"] * 50)
    assert df.agg(losses.weighted_ce_loss("label", "score")).first()[0] == pytest.approx(want["ce"])
    with pytest.raises(ValueError):
        losses.loss("hinge", "label", "score")


def test_certain_scores_are_clipped(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 1.0)], "label int, score double")
    for row in df.select(losses.ce_loss("label", "score").alias("l")).collect():
        assert row.l == pytest.approx(-math.log(1e-15))
