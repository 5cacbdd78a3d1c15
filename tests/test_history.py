import pytest

from pairlab.operators.history import best_epoch, early_stop

AUC = [0.80, 0.8005, 0.8009, 0.82, 0.82, 0.81, 0.79, 0.80, 0.805, 0.9]


def log(spark, runs):
    rows = [(run, 0, i + 1, v) for run, values in runs.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "run_id string, fold int, epoch int, auc double").repartition(3)


def by_hand(values, patience, delta, mode):
    best, waited = None, 0
    for epoch, v in enumerate(values, 1):
        if best is None:
            best = v
            continue
        if v > best + delta if mode == "max" else v < best - delta:
            best, waited = v, 0
        else:
            waited += 1
        if waited >= patience:
            return epoch, best
    return None, best


def test_stop_and_best(spark):
    runs = {"a": AUC, "b": AUC[:5], "c": [0.0, 0.0], "d": [0.7] * 9}
    stops = {r.run_id: (r.stop_epoch, r.best_score) for r in early_stop(log(spark, runs)).collect()}
    assert stops["a"] == (9, 0.82) and stops["b"] == (None, 0.82) and stops["d"] == (6, 0.7)
    best = {r.run_id: (r.epoch, r.auc) for r in best_epoch(log(spark, runs)).collect()}
    assert best == {"a": (4, 0.82), "b": (4, 0.82), "d": (1, 0.7)}


@pytest.mark.parametrize("mode", ["max", "min"])
def test_against_the_state_machine(spark, mode):
    import random

    rnd = random.Random(3)
    runs = {f"r{i}": [round(rnd.random(), 2) for _ in range(rnd.randint(1, 30))] for i in range(40)}
    got = {r.run_id: (r.stop_epoch, r.best_score) for r in early_stop(log(spark, runs), 4, 0.05, mode).collect()}
    assert got == {k: by_hand(v, 4, 0.05, mode) for k, v in runs.items()}


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        early_stop(log(spark, {"a": AUC}), mode="up")


def test_nan_null_and_long_logs(spark):
    scores = {1: [0.7, float("nan"), 0.9], 2: [None, 0.5, float("nan"), 0.6], 3: [0.001 * e for e in range(150)]}
    rows = [(str(run), 0, e, v) for run, log in scores.items() for e, v in enumerate(log, 0 if run == 3 else 1)]
    df = spark.createDataFrame(rows, "run_id string, fold int, epoch int, auc double")
    best = {r.run_id: (r.epoch, r.auc) for r in best_epoch(df, delta=0.0005).collect()}
    assert best["1"] == (3, 0.9) and best["2"] == (4, 0.6) and best["3"] == (149, 0.149)
    assert {r.run_id: r.stop_epoch for r in early_stop(df, delta=0.0005).collect()} == {"1": None, "2": None, "3": None}
