"""Reading pair and feature tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.functions.ids import drop_null_ids, normalise_id
from pairlab.functions.vectors import as_float_vector
from pairlab.operators.features import keep_last

FORMATS = ("parquet", "csv", "json")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """A parquet, csv (with header) or json table; csv without a schema comes as text."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}, got {fmt!r}")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)


def file_order(fmt: str) -> Column:
    """A value that rises along the rows of the files as they are stored."""
    if fmt == "parquet":
        return F.struct("_metadata.file_path", "_metadata.row_index")
    # row ids rise inside one split; splits are ordered by their place in the file
    return F.struct(
        "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")
    )


def read_features(
    spark: SparkSession,
    path: str,
    id_col: str,
    fmt: str = "parquet",
    schema=None,
    id_type: str | None = None,
    unique: bool = False,
) -> DataFrame:
    """(id, features): all columns but the id, in file order, as one float32 vector.

    Null ids are skipped; of repeated ids the last row of the files wins.
    ``unique=True`` states there are none and saves the shuffle.  ``id_type``
    gives a csv id column its type ('double' makes ``12.0`` the id ``12``).
    """
    if fmt == "json" and schema is None:
        raise ValueError("a json feature table needs a schema: inferred columns are in name order")
    raw = read_table(spark, path, fmt, schema)
    if id_type:
        raw = raw.withColumn(id_col, F.col(id_col).cast(id_type))
    vector = as_float_vector(raw, id_col)
    ident = normalise_id(raw, id_col)
    if unique:
        return raw.select(ident.alias("id"), vector.alias("features")).dropna(subset=["id"])
    rows = raw.select(ident.alias("id"), vector.alias("features"), file_order(fmt).alias("_at"))
    return keep_last(rows.dropna(subset=["id"]), "id", "_at").select("id", "features")


def as_pairs(df: DataFrame, left_col: str, right_col: str) -> DataFrame:
    """(left_id, right_id) with normalised ids; rows missing either are dropped, repeats stay."""
    pairs = df.select(normalise_id(df, left_col).alias("left_id"), normalise_id(df, right_col).alias("right_id"))
    return drop_null_ids(pairs)


def read_pairs(
    spark: SparkSession, path: str, left_col: str, right_col: str, fmt: str = "parquet", schema=None
) -> DataFrame:
    """Known pairs of a file; only the two id columns are read."""
    return as_pairs(read_table(spark, path, fmt, schema), left_col, right_col)


def as_features(df: DataFrame, id_col: str) -> DataFrame:
    """(id, features) of a table that already has one row per id."""
    ids = normalise_id(df, id_col).alias("id")
    return df.select(ids, as_float_vector(df, id_col).alias("features")).dropna(subset=["id"])


def load_modalities(
    spark: SparkSession,
    catalogue: dict,
    enabled: Iterable[tuple[str, str]],
    optional: bool = False,
    widths: bool = True,
    **read_options,
) -> dict[tuple[str, str], DataFrame]:
    """Feature tables of the enabled (side, modality) entries of a catalogue.

    Tables that are switched off are not touched.  A missing file is an error;
    ``optional=True`` leaves it out instead.  Vectors of another width than the
    entry declares fail when they are read, unless ``widths=False``.
    """
    tables = {}
    for key in enabled:
        entry = catalogue["modalities"][key]
        if not path_exists(spark, entry["path"]):
            if optional:
                continue
            raise FileNotFoundError(f"{key[0]} {key[1]}: {entry['path']}")
        read = read_features(spark, entry["path"], entry["id_col"], entry["fmt"], **read_options)
        tables[key] = check_widths(read, entry["dim"]) if widths and entry.get("dim") else read
    return tables


def check_widths(df: DataFrame, dim: int) -> DataFrame:
    """The same table, failing at run time on a vector of another length."""
    message = F.concat(F.lit(f"expected width {dim}, got "), F.size("features").cast("string"))
    ok = F.size("features") == dim
    failure = F.raise_error(message).cast("array<float>")
    return df.withColumn("features", F.when(ok, F.col("features")).otherwise(failure))
