"""Entity id normalisation and seeded hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# All 29 characters a text strip removes: Unicode white space plus \x1c-\x1f.
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"

HASH_BITS = 60


def strip_text(col: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.regexp_replace(col, _EDGE_SPACE, "")


def whole_number(col: Column) -> Column:
    """The digits of a double's whole part, exact up to 38 of them; null beyond, and for NaN and infinity.

    A double of 2^63 or more is m x 2^e with a 53-bit m, which decimals hold exactly.
    """
    x = col.cast("double")
    size = F.abs(x)
    small = F.when(size < F.lit(float(1 << 63)), x).try_cast("bigint").cast("string")
    e = F.floor(F.log2(size)).cast("int") - 53
    e = F.least(F.greatest(e, F.lit(0)), F.lit(80))
    half = F.least(e, F.lit(40))

    def two_to(n: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), n)

    m = (size / two_to(half).cast("double") / two_to(e - half).cast("double")).try_cast("bigint")
    digits = (m.cast("decimal(20,0)") * (two_to(half).cast("decimal(13,0)") * two_to(e - half).cast("decimal(13,0)")).cast("decimal(26,0)")).cast("decimal(38,0)").cast("string")
    large = F.when((size >= F.lit(float(1 << 63))) & (size < F.lit(1e38)), F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), digits))
    return F.coalesce(small, large)


def normalise_id(df: DataFrame, name: str) -> Column:
    """Id column as a string: numbers lose their fraction, text is stripped.

    Null, NaN, infinity and numbers of more than 38 digits become null.
    """
    dtype = df.schema[name].dataType
    col = F.col(f"`{name}`")
    if isinstance(dtype, T.StringType):
        return strip_text(col)
    if isinstance(dtype, T.IntegralType):
        return col.cast("string")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return whole_number(col)
    if isinstance(dtype, T.DecimalType):
        whole = F.when(col < 0, F.ceil(col)).otherwise(F.floor(col))
        return whole.cast("decimal(38,0)").cast("string")
    if isinstance(dtype, T.BooleanType):
        return col.cast("int").cast("string")
    return strip_text(col.cast("string"))


def drop_null_ids(df: DataFrame, cols=("left_id", "right_id")) -> DataFrame:
    """Rows whose ids are all present."""
    return df.dropna(subset=list(cols))


def _hex_number(hex_text: Column, start: int) -> Column:
    # never null: without the default, joins on it push a not-null filter below
    # the exchange, and equal exchanges are no longer shared
    return F.coalesce(F.conv(F.substring(hex_text, start, 15), 16, 10).cast("bigint"), F.lit(0))


def stable_hash(seed, *cols) -> Column:
    """60-bit hash of a seed and some columns; equal on every engine and partitioning."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c) if isinstance(c, str) else c for c in cols])
    return _hex_number(F.md5(text), 1)


def hash_pair(seed, col: Column) -> tuple[Column, Column]:
    """Two independent 60-bit numbers from one digest."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), col.cast("string")))
    return _hex_number(digest, 1), _hex_number(digest, 16)
