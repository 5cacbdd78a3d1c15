import hashlib
import warnings

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pairlab.operators import sampling

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def number(text, start=0):
    return int(hashlib.md5(text.encode()).hexdigest()[start : start + 15], 16)


def by_hand(pairs, wanted, seed, cap):
    """Accept draws one by one in attempt order."""
    sides = [sorted({p[i] for p in pairs}, key=lambda x: (number(f"{seed}|{x}"), x)) for i in (0, 1)]
    seen, out = set(pairs), []
    for t in range(cap):
        if len(out) == wanted:
            break
        pick = (sides[0][number(f"{seed}|{t}") % len(sides[0])], sides[1][number(f"{seed}|{t}", 15) % len(sides[1])])
        if pick not in seen:
            seen.add(pick)
            out.append(pick)
    return out


pair_sets = st.sets(st.tuples(st.integers(0, 12), st.integers(0, 9)), min_size=1, max_size=60)


@FEW
@given(raw=pair_sets, ratio=st.integers(1, 3), seed=st.integers(0, 50))
def test_equals_drawing_one_by_one(spark, raw, ratio, seed):
    pairs = sorted((f"l{a}", f"r{b}") for a, b in raw)
    df = spark.createDataFrame(pairs, "left_id string, right_id string")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        got = sampling.negative_pairs(df.repartition(3), ratio, seed, with_attempt=True).collect()
    got = [(r.left_id, r.right_id) for r in sorted(got, key=lambda r: r.attempt)]
    wanted = len(pairs) * ratio
    assert got == by_hand(pairs, wanted, seed, wanted * 100)
    assert len(set(got)) == len(got) and not set(got) & set(pairs)


def test_repeated_positives_raise_the_count_only_if_asked(pairs_of):
    df = pairs_of([("a", "1"), ("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")])
    assert sampling.negative_pairs(df, 1, 1).count() == 4
    assert sampling.negative_pairs(df, 1, 1, dedupe=False).count() == 5


def test_shortfall_warns_and_returns_what_exists(pairs_of):
    df = pairs_of([(a, b) for a in "abc" for b in "123" if (a, b) != ("c", "3")])
    with pytest.warns(UserWarning, match="only 1 of 8"):
        assert sampling.negative_pairs(df, 1, 1).collect() == [("c", "3")]
    full = pairs_of([(a, b) for a in "ab" for b in "12"])
    with pytest.warns(UserWarning):
        assert sampling.negative_pairs(full, 1, 1).count() == 0


def test_attempt_cap(pairs_of):
    df = pairs_of([(f"l{i}", f"r{i}") for i in range(20)])
    with pytest.warns(UserWarning, match="may not find"):
        few = sampling.negative_pairs(df, 5, 1, max_factor=1, with_attempt=True).collect()
    assert 0 < len(few) < 100 and max(r.attempt for r in few) < 100


def test_attempts_needed_is_enough_and_not_wasteful():
    for wanted, available, possible in ((1000, 10**6, 10**6 + 10**4), (95, 95, 2000), (50_000, 148_000, 200_000)):
        got = sampling.attempts_needed(wanted, available, possible, 10**12)
        assert got >= wanted
        missing = available * (1 - 1 / possible) ** got
        assert missing <= available - wanted + 1e-9 or wanted == available and missing < 1e-11
    assert sampling.attempts_needed(1000, 10**9, 10**9, 10**12) < 1400
    assert sampling.attempts_needed(10**9, 10**13, 10**13, 10**12) < 1.001e9
    assert sampling.attempts_needed(10, 0, 100, 1000) == 0
    assert sampling.attempts_needed(100, 100, 10**6, 500) == 500


def test_draws_are_uniform(spark, pairs_of):
    df = pairs_of([(f"l{i}", f"r{i % 4}") for i in range(8)])
    draws = sampling.random_pairs(sampling.index_entities(df, 5), 8000, 5)
    counts = [r["count"] for r in draws.groupBy("left_id", "right_id").count().collect()]
    assert len(counts) == 32 and min(counts) > 180 and max(counts) < 320


def test_capacity_and_examples(pairs_of):
    df = pairs_of([("a", "1"), ("a", "1"), ("b", "2")])
    assert tuple(sampling.negative_capacity(df).first()) == (2, 2, 2, 2)
    assert sampling.violation_examples(df, n=2).collect() == [("a", "1"), ("a", "1")]
