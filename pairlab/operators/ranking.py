"""Exact global order without a single sorting task.

A leading integer key (a hash, an attempt number) is cut into at most 65,536
buckets.  Counting per bucket needs one small aggregate; the running total over
that bounded table gives every bucket its global offset, so only rows inside a
bucket have to be ordered among themselves.  The form is the same at every size.

``take_first`` selects by digits instead: it counts by the leading digits of
the key, then by the next ones in the one bucket that holds the cut, so that
no histogram exceeds 4,096 rows however far the keys spread.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.functions.ids import HASH_BITS, stable_hash

BUCKET_BITS = 16
DIGIT_BITS = 12
ORDERED_ROWS = 100_000
COPY_CHUNK = 100_000


def hash_bucket(h, bits: int = BUCKET_BITS) -> Column:
    """The leading bits of a 60-bit hash."""
    return F.shiftright(F.col(h) if isinstance(h, str) else h, HASH_BITS - bits)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on equal ``keys`` in which null equals null; the keys appear once."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(renamed, reduce(Column.__and__, same)).drop(*[f"_right_{k}" for k in keys])


def bucket_offsets(df: DataFrame, bucket: str, by: Sequence[str] = ()) -> DataFrame:
    """Per (group, bucket): its rows, the rows of all earlier buckets, the group's total.

    As many rows per group as there are buckets, at most 65,536 of a hash, whatever the size of ``df``.
    """
    keys = [*by, bucket]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    group = Window.partitionBy(*(by or [F.lit(0)]))
    running = group.orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.select(
        *keys,
        "_rows",
        (F.sum("_rows").over(running) - F.col("_rows")).alias("_before"),
        F.sum("_rows").over(group).alias("_total"),
    )


def rank_rows(
    df: DataFrame,
    order: Sequence[str],
    bucket: Column,
    by: Sequence[str] = (),
    rank: str = "rank",
) -> DataFrame:
    """Exact 1-based rank of every row by ``order``, whose leading key defines ``bucket``.

    Null is a group of its own.  Without ``by`` the offsets are at most 65,536
    rows and are broadcast; with it Spark chooses the join.
    """
    keyed = df.withColumn("_bucket", bucket)
    offsets = bucket_offsets(keyed, "_bucket", by).drop("_rows", "_total")
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order)
    placed = keyed.withColumn("_pos", F.row_number().over(inside))
    return (
        null_safe_join(placed, offsets if by else F.broadcast(offsets), [*by, "_bucket"])
        .withColumn(rank, (F.col("_before") + F.col("_pos")).cast("bigint"))
        .select(*df.columns, rank)
    )


def first_by_number(df: DataFrame, order: str, n: int, width: int) -> DataFrame:
    """The ``n`` rows lowest by a column of distinct numbers below ``width`` x 65,536; ``width`` of them share a bucket.

    One lazy plan for a column that the caller has numbered: whole buckets
    below the cut pass through unsorted; only the one that holds it is ordered.
    """
    # the default keeps the key not-null, so that its three uses share one exchange
    keyed = df.withColumn("_bucket", F.expr(f"coalesce(`{order}` div {int(width)}, 0L)"))
    offsets = bucket_offsets(keyed, "_bucket")
    quota = F.least(F.col("_rows"), F.lit(n) - F.col("_before"))
    quotas = offsets.select("_bucket", "_rows", quota.alias("_quota")).filter("_quota > 0")
    whole = keyed.join(F.broadcast(quotas.filter("_quota = _rows").select("_bucket")), "_bucket", "left_semi")
    cut = keyed.join(F.broadcast(quotas.filter("_quota < _rows").select("_bucket", "_quota")), "_bucket")
    inside = Window.partitionBy("_bucket").orderBy(order)
    part = cut.withColumn("_pos", F.row_number().over(inside)).filter("_pos <= _quota")
    return whole.select(*df.columns).unionByName(part.select(*df.columns))


def _cut_bucket(df: DataFrame, key: Column, low: int, high: int, quota: int) -> tuple[int, int, int, int]:
    """Of the keys low..high, the bucket that holds row number ``quota``: its keys, its rows, and what it owes to the quota."""
    bits = max(0, (high - low).bit_length() - DIGIT_BITS)
    digit = F.shiftright(key - F.lit(low), bits)
    counts = df.filter(key.between(low, high)).groupBy(digit.alias("digit")).count().orderBy("digit").collect()
    for row in counts:  # at most 4,096
        if quota <= row["count"]:
            start = low + (row["digit"] << bits)
            return start, min(high, start + (1 << bits) - 1), row["count"], quota
        quota -= row["count"]
    return high + 1, high, 0, 0


def take_first(df: DataFrame, order: str, n: int, tie: Sequence[str] = (), ordered_rows: int = ORDERED_ROWS) -> DataFrame:
    """The ``n`` rows lowest by an integer column, ties by the columns in ``tie``, nulls last and only among themselves.

    Selection by digits: every level counts at most 4,096 buckets and refines
    only the one that holds the cut, until its rows are few enough to be
    ordered in one task (or all have one key).  Rows below the cut pass
    through unsorted.  ``df`` is read once per level, so it should be stored.
    """
    key = F.col(order).cast("bigint")
    bounds = df.agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(key).alias("known")).first()
    if n <= 0:
        return df.limit(0)
    if bounds["known"] < n:
        known = df.filter(key.isNotNull())
        place = Window.partitionBy(key.isNull()).orderBy(*(tie or [order]))
        rest = df.filter(key.isNull()).withColumn("_pos", F.row_number().over(place))
        return known.unionByName(rest.filter(F.col("_pos") <= n - bounds["known"]).drop("_pos"))
    low, high, rows, quota = bounds["low"], bounds["high"], bounds["known"], n
    while rows > max(ordered_rows, quota) and low < high:
        low, high, rows, quota = _cut_bucket(df, key, low, high, quota)
    whole = df.filter(key < low)
    inside = df.filter(key.between(low, high))
    if quota < rows:
        place = Window.partitionBy(F.lit(0)).orderBy(order, *tie)  # the rows of the last bucket only
        inside = inside.withColumn("_pos", F.row_number().over(place)).filter(F.col("_pos") <= quota).drop("_pos")
    return whole.unionByName(inside)


def split_evenly(df: DataFrame, k: int, order: Sequence[str], bucket: Column, out: str) -> DataFrame:
    """Contiguous parts 0..k-1 of the global order, sizes differing by at most one.

    The first ``total mod k`` parts are the larger ones.  A bucket that lies
    inside one part assigns its rows without any shuffle; only the at most k-1
    buckets holding a boundary are ordered.  Fewer than ``k`` rows is an error.
    """
    if k < 2:
        raise ValueError("need at least two parts")

    def part_of(rank0: str) -> Column:
        small, extra = f"(_total div {k})", f"(_total % {k})"
        in_large = f"{rank0} < {extra} * ({small} + 1)"
        return F.expr(
            f"cast(if({in_large}, {rank0} div ({small} + 1), "
            f"{extra} + ({rank0} - {extra} * ({small} + 1)) div {small}) as int)"
        )

    message = F.concat(F.lit(f"cannot split into {k} parts: only "), F.col("_total").cast("string"), F.lit(" rows"))
    enough = F.when(F.col("_total") < k, F.raise_error(message).cast("bigint")).otherwise(F.col("_total"))
    keyed = df.withColumn("_bucket", bucket)

    def spans(offsets: DataFrame) -> DataFrame:
        return offsets.withColumn("_first", part_of("_before")).withColumn("_last", part_of("(_before + _rows - 1)"))

    offsets = bucket_offsets(keyed, "_bucket")
    # checked on one side only: two failing jobs at once hide each other's message
    inner = spans(offsets.withColumn("_total", enough)).filter("_first = _last").select("_bucket", F.col("_first").alias(out))
    edge = spans(offsets).filter("_first < _last").select("_bucket", "_before", "_total")
    whole = keyed.join(F.broadcast(inner), "_bucket").select(*df.columns, out)
    inside = Window.partitionBy("_bucket").orderBy(*order)
    part = (
        keyed.join(F.broadcast(edge), "_bucket")
        .withColumn("_rank0", F.col("_before") + F.row_number().over(inside) - 1)
        .select(*df.columns, part_of("_rank0").alias(out))
    )
    return whole.unionByName(part)


def deterministic_shuffle(
    df: DataFrame, seed, keys: Sequence[str], rank: str = "position", bits: int = BUCKET_BITS
) -> DataFrame:
    """A seeded permutation: each row's 1-based place, the same for any partitioning and any number of buckets."""
    hashed = df.withColumn("_h", stable_hash(seed, *keys))
    return rank_rows(hashed, ["_h", *keys], hash_bucket("_h", bits), rank=rank).drop("_h")


def number_copies(df: DataFrame, keys: Sequence[str], out: str = "copy_no") -> DataFrame:
    """Rows with equal keys numbered 1..c without gathering them in one task.

    Copies are counted with map-side combining and written out again in chunks,
    so a row repeated billions of times spreads over many tasks.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"))
    last_chunk = F.expr(f"(_copies - 1) div {COPY_CHUNK}")
    chunks = counts.select(*keys, "_copies", F.explode(F.sequence(F.lit(0).cast("bigint"), last_chunk)).alias("_chunk"))
    start = F.col("_chunk") * COPY_CHUNK
    end = F.least(F.col("_copies"), start + COPY_CHUNK)
    return (
        chunks.repartition(*keys, "_chunk")
        .select(*keys, F.explode(F.sequence(start + 1, end)).alias(out))
    )
