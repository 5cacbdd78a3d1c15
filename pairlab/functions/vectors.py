"""Feature vectors held as array columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_float_vector(df: DataFrame, id_col: str, exclude: Sequence[str] = ()) -> Column:
    """Every column but the id, in table order, as one float32 array.

    A table that already holds one array column keeps it.
    """
    names = [c for c in df.columns if c != id_col and c not in exclude]
    if not names:
        raise ValueError(f"no feature columns beside {id_col!r}")
    if len(names) == 1 and df.schema[names[0]].dataType.typeName() == "array":
        return F.col(f"`{names[0]}`").cast("array<float>")
    return F.array(*[F.col(f"`{c}`").cast("float") for c in names])


def concat_vectors(*cols) -> Column:
    """Vectors joined end to end in the given order."""
    return F.concat(*[_col(c) for c in cols])


def softmax_weights(weights: Sequence[float]) -> list[float]:
    """Softmax of raw scalar weights."""
    top = max(weights)
    raw = [math.exp(w - top) for w in weights]
    return [r / sum(raw) for r in raw]


def uniform_weights(n: int) -> list[float]:
    """Raw starting weights: all 1/n."""
    return [1.0 / n] * n


def weighted_pool(cols: Sequence, weights: Sequence[float] | None = None) -> Column:
    """Softmax-weighted sum of vectors of one length; a single vector passes unchanged."""
    cols = [_col(c) for c in cols]
    if not cols:
        raise ValueError("nothing to pool")
    if len(cols) == 1:
        return cols[0]
    raw = list(weights) if weights is not None else uniform_weights(len(cols))
    if len(raw) != len(cols):
        raise ValueError(f"{len(cols)} vectors but {len(raw)} weights")
    shares = softmax_weights(raw)

    def scaled(share):
        return lambda x: x.cast("double") * F.lit(share)

    def added(share):
        return lambda acc, x: acc + x.cast("double") * F.lit(share)

    pooled = F.transform(cols[0], scaled(shares[0]))
    same = F.lit(True)
    for col, share in zip(cols[1:], shares[1:]):
        pooled = F.zip_with(pooled, col, added(share))
        same = same & (F.size(col) == F.size(cols[0]))
    message = F.raise_error(F.lit("vectors to pool differ in length")).cast("array<double>")
    return F.when(~same, message).otherwise(pooled)


def normalised_weights(spark: SparkSession, raw: dict[str, dict[str, float]]) -> DataFrame:
    """Rows (side, modality, weight); sides with fewer than two modalities give none."""
    rows = [
        (side, modality, float(w))
        for side, weights in raw.items()
        if len(weights) > 1
        for modality, w in weights.items()
    ]
    df = spark.createDataFrame(rows, "side string, modality string, raw double")
    return softmax_by(df, "side", "raw", "weight").drop("raw")


def softmax_by(df: DataFrame, by: str, raw: str, out: str) -> DataFrame:
    """Softmax of a number over the rows of each group."""
    w = Window.partitionBy(by)
    shifted = F.exp(F.col(raw) - F.max(raw).over(w))
    return df.withColumn("_e", shifted).withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def explode_vector(col, prefix: str, dim: int) -> list[Column]:
    """A vector as ``dim`` separate columns prefix0 .. prefix{dim-1}."""
    return [F.get(_col(col), F.lit(i)).alias(f"{prefix}{i}") for i in range(dim)]


def sparse_vector(on: Column, dim: int) -> Column:
    """A vector with 1 at the sorted distinct places ``on``: its width, the places not zero and their values."""
    ones = F.transform(on, lambda x: F.lit(1.0).cast("float"))
    return F.struct(F.lit(dim).alias("width"), on.alias("places"), ones.alias("values"))


def vector_rows(df: DataFrame, keys: Sequence[str], col: str, value: str = "value") -> DataFrame:
    """Long form of a vector: one row per position; preferred for wide vectors.

    A sparse vector gives its stored places only; all others are zero.
    """
    if df.schema[col].dataType.typeName() == "struct":
        places = F.arrays_zip(F.col(f"{col}.places").alias("pos"), F.col(f"{col}.values").alias(value))
        return df.select(*keys, F.explode(places).alias("_at")).select(*keys, "_at.pos", f"_at.{value}")
    return df.select(*keys, F.posexplode(_col(col)).alias("pos", value))


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, not at every place it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def vector_sum(col) -> Column:
    """Sum of a vector's elements."""
    return F.aggregate(_col(col), F.lit(0.0), lambda a, x: a + x.cast("double"))


def row_normalise(col) -> Column:
    """(x - mean) / std over the elements of one vector; constant vectors give zeros."""
    col = _col(col)
    n = F.size(col).cast("double")

    def centred(mean):
        return F.transform(col, lambda x: x.cast("double") - mean)

    def scaled(c):
        std = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x) / n)
        return bound(std, lambda s: F.transform(c, lambda x: F.when(s > 0, x / s).otherwise(F.lit(0.0))))

    return bound(vector_sum(col) / n, lambda mean: bound(centred(mean), scaled))


def pad_vector(col, dim: int) -> Column:
    """Vector filled up with zeros to ``dim`` elements."""
    col = _col(col).cast("array<double>")
    fill = F.array_repeat(F.lit(0.0).cast("double"), F.greatest(F.lit(0), F.lit(dim) - F.size(col)))
    return F.concat(col, fill)
