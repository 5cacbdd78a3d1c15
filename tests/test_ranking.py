import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pairlab.functions.ids import stable_hash
from pairlab.operators import folds, ranking, sampling

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def hashed(spark, n, seed=3):
    return spark.range(n).select(F.col("id").cast("string").alias("k")).withColumn("h", stable_hash(seed, "k"))


def test_ranks_do_not_depend_on_buckets(spark):
    df = hashed(spark, 5000).withColumn("g", F.crc32("k") % 2)
    for by in ([], ["g"]):
        a = ranking.rank_rows(df, ["h", "k"], F.lit(0), by).collect()
        b = ranking.rank_rows(df.repartition(7), ["h", "k"], ranking.hash_bucket("h"), by).collect()
        assert sorted(a) == sorted(b)


@FEW
@given(n=st.integers(5, 400), k=st.integers(2, 5), seed=st.integers(0, 99))
def test_parts_differ_by_at_most_one(spark, n, k, seed):
    df = hashed(spark, n, seed)
    out = ranking.split_evenly(df, k, ["h", "k"], ranking.hash_bucket("h"), "part")
    sizes = {r["part"]: r["count"] for r in out.groupBy("part").count().collect()}
    assert [sizes[i] for i in range(k)] == [n // k + (i < n % k) for i in range(k)]
    # few buckets: boundaries fall inside them
    coarse = ranking.split_evenly(df, k, ["h", "k"], ranking.hash_bucket("h", 1), "part")
    assert sorted(coarse.collect()) == sorted(out.collect())


def test_too_few_rows_is_an_error(spark):
    with pytest.raises(PySparkException, match="cannot split into 5 parts"):
        ranking.split_evenly(hashed(spark, 3), 5, ["h", "k"], ranking.hash_bucket("h"), "part").collect()


@FEW
@given(n=st.integers(0, 120), width=st.integers(1, 40))
def test_first_by_number(spark, n, width):
    df = spark.range(100).select((F.col("id") * 3).alias("t"))
    got = sorted(r.t for r in ranking.first_by_number(df, "t", n, width).collect())
    assert got == [3 * i for i in range(min(n, 100))]


@FEW
@given(n=st.integers(0, 330), few=st.integers(1, 50), spread=st.sampled_from([1, 7, 1 << 40, (1 << 60) - 1]))
def test_take_first_by_digits(spark, n, few, spread):
    rng = random.Random(spread)
    rows = [(rng.randrange(-spread, spread + 1), i) for i in range(300)] + [(None, i) for i in range(20)]
    df = spark.createDataFrame(rows, "t long, i int")
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:n]
    got = ranking.take_first(df, "t", n, ["i"], ordered_rows=few).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_histograms_stay_small_however_far_keys_spread(spark, monkeypatch):
    seen = []
    plain = ranking._cut_bucket

    def watched(df, key, low, high, quota):
        found = plain(df, key, low, high, quota)
        seen.append((high - low).bit_length())
        return found

    monkeypatch.setattr(ranking, "_cut_bucket", watched)
    df = spark.range(5000).select(stable_hash(1, "id").alias("h"))
    got = ranking.take_first(df, "h", 2500, ordered_rows=1)
    assert got.count() == 2500 and 1 <= len(seen) <= 5
    assert all(a - b >= ranking.DIGIT_BITS or b == 0 for a, b in zip(seen, seen[1:]))


def test_no_window_runs_over_all_rows(spark):
    pairs = spark.range(100).select(F.col("id").cast("string").alias("left_id"), (F.col("id") % 9).cast("string").alias("right_id"), F.lit(1).alias("label"))
    for df in (
        folds.assign_folds(pairs, 5, 42),
        folds.assign_folds(pairs, 5, 42, unique=False),
        sampling.index_entities(pairs, 42),
        ranking.deterministic_shuffle(pairs, 42, ["left_id", "right_id"]),
    ):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        keys = [line.split("], [")[1] for line in plan.splitlines() if "Window [row_number" in line]
        # every numbering is inside a bucket; the others add up one row per bucket
        assert keys and all("_bucket" in k for k in keys), plan


def test_copies_are_numbered_without_gaps(spark, monkeypatch):
    monkeypatch.setattr(ranking, "COPY_CHUNK", 7)
    df = spark.range(100).select(F.when(F.col("id") < 60, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    rows = ranking.number_copies(df, ["k"]).collect()
    assert len(rows) == 100
    assert sorted(r.copy_no for r in rows if r.k == "hot") == list(range(1, 61))


def test_shuffle_is_a_permutation_for_any_partitioning(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    a = {r.k: r.position for r in ranking.deterministic_shuffle(df, 1, ["k"]).collect()}
    b = {r.k: r.position for r in ranking.deterministic_shuffle(df.repartition(13), 1, ["k"], bits=5).collect()}
    assert a == b and sorted(a.values()) == list(range(1, 1001))


def test_null_groups_keep_their_ranks(spark):
    df = spark.createDataFrame([(g, v) for g in (None, "a") for v in range(5)], "g string, v long")
    for bucket in (F.shiftright("v", 1), F.lit(0)):
        got = ranking.rank_rows(df, ["v"], bucket, by=["g"]).collect()
        assert sorted((str(r.g), r.rank) for r in got) == [(g, k) for g in ("None", "a") for k in range(1, 6)]
