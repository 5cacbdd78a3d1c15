"""Negative pairs: uniform draws over both entity sets that are no known positives."""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.functions.ids import hash_pair, stable_hash
from pairlab.operators.ranking import BUCKET_BITS, first_by_number, hash_bucket, rank_rows
from pairlab.session import materialise

PAIR = ("left_id", "right_id")
ROWS_PER_TASK = 4_000_000
FAILURE_ODDS = 1e-12


def entity_universe(pairs: DataFrame) -> DataFrame:
    """Distinct ids of both sides as (side, id), read in one pass."""
    sides = pairs.select(F.col("left_id").alias("left"), F.col("right_id").alias("right"))
    return sides.unpivot([], ["left", "right"], "side", "id").distinct()


def index_entities(pairs: DataFrame, seed=0) -> DataFrame:
    """(side, id, idx): a dense number 0.. per side, in hash order."""
    hashed = entity_universe(pairs).withColumn("_h", stable_hash(seed, "id"))
    ranked = rank_rows(hashed, ["_h", "id"], hash_bucket("_h"), by=["side"], rank="idx")
    return ranked.select("side", "id", (F.col("idx") - 1).alias("idx"))


def universe_sizes(entities: DataFrame) -> tuple[int, int]:
    """(number of left ids, number of right ids)."""
    sizes = {r["side"]: r["n"] for r in entities.groupBy("side").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sizes.get("left", 0), sizes.get("right", 0)


def random_pairs(entities: DataFrame, n: int, seed, sizes: tuple[int, int] | None = None) -> DataFrame:
    """``n`` independent uniform draws (attempt, left_id, right_id), repeats included.

    Attempt ``t`` hashes to one index per side, so a draw depends on nothing but
    the seed and ``t``.  The draws are spread evenly over the index values: the
    two look-ups have no hot key.
    """
    spark = entities.sparkSession
    n_left, n_right = sizes or universe_sizes(entities)
    if not n or not n_left or not n_right:
        return spark.createDataFrame([], "attempt bigint, left_id string, right_id string")
    tasks = max(spark.sparkContext.defaultParallelism, -(-n // ROWS_PER_TASK))
    left_hash, right_hash = hash_pair(seed, F.col("id"))
    draws = spark.range(0, n, 1, tasks).select(
        F.col("id").alias("attempt"),
        (left_hash % F.lit(n_left)).alias("_left_idx"),
        (right_hash % F.lit(n_right)).alias("_right_idx"),
    )
    left = entities.filter("side = 'left'").select(F.col("idx").alias("_left_idx"), F.col("id").alias("left_id"))
    right = entities.filter("side = 'right'").select(F.col("idx").alias("_right_idx"), F.col("id").alias("right_id"))
    return draws.join(left, "_left_idx").join(right, "_right_idx").select("attempt", *PAIR)


def exclude_pairs(candidates: DataFrame, positives: DataFrame) -> DataFrame:
    """Candidates that are not known positives."""
    # repeats are combined before the shuffle, so no pair of the right side is hot
    return candidates.join(positives.select(*PAIR).distinct(), list(PAIR), "left_anti")


def accepted_draws(draws: DataFrame, positives: DataFrame) -> DataFrame:
    """First attempt of every drawn pair that is no positive.

    Positives enter the same aggregate under attempt -1, so removing repeats and
    removing positives cost one shuffle together, with map-side combining.
    """
    known = positives.select(F.lit(-1).cast("bigint").alias("attempt"), *PAIR)
    first = draws.unionByName(known).groupBy(*PAIR).agg(F.min("attempt").alias("attempt"))
    return first.filter("attempt >= 0")


def attempts_needed(wanted: int, available: int, possible: int, cap: int | None = None) -> int:
    """Draws that yield ``min(wanted, available)`` distinct free pairs, at most ``cap`` if it is given.

    The smaller of two Chernoff bounds, each failing with odds below 1e-12, so
    that one pass is enough.  Sparse case: every draw is accepted with at least
    the odds left when one pair is still wanted.  Dense case: after m draws a
    free pair is missing with odds exp(-m/possible), and few enough must be.
    """
    target = min(wanted, available)
    if target <= 0:
        return 0
    spare = available - target
    doubt = -math.log(FAILURE_ODDS)

    def log_tail(mean: float) -> float:
        # ln of the bound on P(missing >= spare + 1)
        x = spare + 1.0
        return -math.inf if mean <= 0 else x - mean + x * math.log(mean / x)

    low, high = 0.0, spare + 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if log_tail(mid) <= -doubt else (low, mid)
    draws = possible * (math.log(available) - math.log(max(low, 1e-300)))
    if spare:
        accepted = target + doubt + math.sqrt(doubt * doubt + 2 * doubt * target)
        draws = min(draws, accepted * possible / spare)
    draws = max(target, math.ceil(draws) + 1)
    return draws if cap is None else min(cap, draws)


def pair_counts(pairs: DataFrame) -> tuple[int, int]:
    """(rows, distinct pairs) of a pair table in one shuffle."""
    copies = pairs.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("c"))
    row = copies.agg(F.sum("c").alias("rows"), F.count(F.lit(1)).alias("distinct")).first()
    return row["rows"] or 0, row["distinct"]


def _side_index(entities: DataFrame, side: str) -> DataFrame:
    return entities.filter(F.col("side") == side).select(F.col("id").alias(f"{side}_id"), F.col("idx").alias(f"_{side}_idx"))


def pair_codes(pairs: DataFrame, entities: DataFrame, n_right: int) -> DataFrame:
    """(code): a pair as one integer, left number x right entities + right number."""
    placed = pairs.select(*PAIR).join(_side_index(entities, "left"), "left_id").join(_side_index(entities, "right"), "right_id")
    return placed.select((F.col("_left_idx") * F.lit(n_right) + F.col("_right_idx")).alias("code"))


def drawn_codes(spark, n: int, seed, n_left: int, n_right: int) -> DataFrame:
    """(attempt, code): the draws of ``random_pairs`` as pair codes; no entity is looked up."""
    tasks = max(spark.sparkContext.defaultParallelism, -(-n // ROWS_PER_TASK))
    left_hash, right_hash = hash_pair(seed, F.col("id"))
    code = (left_hash % F.lit(n_left)) * F.lit(n_right) + right_hash % F.lit(n_right)
    return spark.range(0, n, 1, tasks).select(F.col("id").alias("attempt"), code.alias("code"))


def accepted_codes(draws: DataFrame, known: DataFrame) -> DataFrame:
    """(code, attempt): first attempt of every drawn code that is no known one; one aggregate on the integer."""
    both = draws.select("code", "attempt").unionByName(known.select("code", F.lit(-1).cast("bigint").alias("attempt")))
    return both.groupBy("code").agg(F.min("attempt").alias("attempt")).filter("attempt >= 0")


def resolve_codes(codes: DataFrame, entities: DataFrame, n_right: int) -> DataFrame:
    """(left_id, right_id, attempt) of pair codes."""
    parted = codes.select("attempt", F.expr(f"code div {n_right}").alias("_left_idx"), (F.col("code") % n_right).alias("_right_idx"))
    found = parted.join(_side_index(entities, "left"), "_left_idx").join(_side_index(entities, "right"), "_right_idx")
    return found.select(*PAIR, "attempt")


def negative_capacity(positives: DataFrame) -> DataFrame:
    """How many negatives exist at most: left ids x right ids - distinct positives.

    Arithmetic on counts; the complement itself is never enumerated.
    """
    sizes = (
        entity_universe(positives)
        .groupBy()
        .agg(
            F.count_if(F.col("side") == "left").alias("n_left"),
            F.count_if(F.col("side") == "right").alias("n_right"),
            F.lit(0).cast("bigint").alias("n_pairs"),
        )
    )
    known = positives.select(*PAIR).distinct().groupBy().agg(
        F.lit(0).cast("bigint").alias("n_left"),
        F.lit(0).cast("bigint").alias("n_right"),
        F.count(F.lit(1)).alias("n_pairs"),
    )
    total = sizes.unionByName(known).groupBy().agg(*[F.sum(c).alias(c) for c in ("n_left", "n_right", "n_pairs")])
    return total.select(
        F.col("n_left").alias("left_entities"),
        F.col("n_right").alias("right_entities"),
        F.col("n_pairs").alias("positive_pairs"),
        (F.col("n_left") * F.col("n_right") - F.col("n_pairs")).alias("max_negatives"),
    )


def negative_pairs(
    positives: DataFrame,
    ratio: int = 1,
    seed=42,
    max_factor: int | None = None,
    dedupe: bool = True,
    with_attempt: bool = False,
) -> DataFrame:
    """``ratio`` negatives per positive, in attempt order, none of them a positive.

    Entities are those of the positives.  Draws go on until all wanted or all
    possible pairs are found; ``max_factor`` limits the attempts per wanted pair,
    and fewer pairs come back, with a warning, when they do not suffice.  ``dedupe=False`` counts repeated positives.
    """
    # the positives are read once: from here on they are distinct pairs with their number
    counted = positives.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("copies"))
    known = materialise(counted, "positives")
    row = known.agg(F.sum("copies").alias("rows"), F.count(F.lit(1)).alias("distinct")).first()
    rows, distinct = row["rows"] or 0, row["distinct"]
    entities = materialise(index_entities(known, seed), "entities")
    n_left, n_right = universe_sizes(entities)
    possible = n_left * n_right
    if possible >= 1 << 62:
        raise ValueError(f"{possible} possible pairs do not fit a pair code")
    available = possible - distinct
    wanted = (distinct if dedupe else rows) * ratio
    if wanted > available:
        warnings.warn(f"only {available} of {wanted} negatives exist", stacklevel=2)
    attempts = attempts_needed(wanted, available, possible)
    if max_factor is not None and attempts > wanted * max_factor:
        attempts = wanted * max_factor
        warnings.warn(f"{attempts} attempts may not find {wanted} negatives", stacklevel=2)
    if not attempts:
        empty = positives.sparkSession.createDataFrame([], "left_id string, right_id string, attempt bigint")
        return empty if with_attempt else empty.select(*PAIR)
    accepted = accepted_codes(drawn_codes(positives.sparkSession, attempts, seed, n_left, n_right), pair_codes(known, entities, n_right))
    width = max(1, -(-attempts // (1 << BUCKET_BITS)))
    taken = resolve_codes(first_by_number(accepted, "attempt", wanted, width), entities, n_right)
    return taken.select(*PAIR, "attempt") if with_attempt else taken.select(*PAIR)


def violation_examples(df: DataFrame, order: Sequence[str] = PAIR, n: int = 5) -> DataFrame:
    """Up to ``n`` offending rows, lowest first."""
    return df.orderBy(*order).limit(n)
