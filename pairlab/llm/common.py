"""Helpers that the operators share: folds, stored intermediates, words, components."""

from __future__ import annotations

import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.session import run_folder, write_parquet

# A word is a run of anything but these six ASCII blanks; Java's \s is exactly that set.
WORD = r"[^\x20\x09-\x0D]+"


# bytes that go to a worker at once while an intermediate is written: both sides hold whole batches beside the heap
BATCH_BYTES = 1 << 22
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"

_HELD: dict = {}


def give_back() -> None:
    """Return freed memory to the system where the libraries can do that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run):
    """The function over batches, after which its worker holds no freed memory while it waits or does another step."""

    def whole(batches):
        yield from run(batches)
        give_back()

    return whole


def worker_cache(name: str, make):
    """What a worker process remembers under ``name``; it holds one operator's cache at a time.

    Before another operator's cache is made, the freed memory goes back to the
    system where the C library can do that.
    """
    if name not in _HELD:
        _HELD.clear()
        gc.collect()
        give_back()
        _HELD[name] = make()
    return _HELD[name]


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the session's shared folder and return the written copy.

    It cuts the lineage with files that every executor can read and that
    outlive the executor which wrote them.  The shuffles of the write are not
    needed any more and their files go.  Batches of the write stay small.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH_CONF)
    spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
    try:
        write_parquet(df, path)
    finally:
        spark.conf.set(BATCH_CONF, before)
    return spark.read.schema(df.schema).parquet(path)


def release(*stored: DataFrame) -> None:
    """Delete the files of intermediates that no later step reads."""
    for df in stored:
        spark = df.sparkSession
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remainder(id_col: str, divisor: int) -> Column:
    """crc32 of the id's text modulo ``divisor``; a null id counts as the empty text."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % divisor


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def edge_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of an edge list and the smallest node each one reaches."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while len(u):
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return nodes, nodes[label]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b long): root is the smallest reachable node.

    Every round takes the least label of the neighbours, then follows one
    pointer; both sides are aggregated before they are shuffled, and labels
    are stored each round so that a lost executor costs one round at most.
    """
    both = edges.select("a", "b").where("a <> b")
    both = store(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = store(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
            .withColumnRenamed("a", "node")
        )
        hooked = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        parent = labels.select(F.col("node").alias("root"), F.col("root").alias("up"))
        moved = store(hooked.join(parent, "root").select("node", F.least("root", "up").alias("root"), "was"), "labels")
        changed = moved.where("root <> was").limit(1).count()
        release(labels)
        labels = moved.select("node", "root")
        if not changed:
            release(both)
            return labels
