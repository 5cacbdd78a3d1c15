"""SimHash near-duplicates found exactly through vantage-point trees.

1. One pass over the texts gives each document a 64-bit fingerprint.
2. Equal fingerprints are one point.  A tree of vantage points, fitted on a
   bounded sample, sends every point to one home shard and, as a query, to
   every later shard whose region its ball of radius ``max_bits`` overlaps
   (triangle bounds), so each close pair meets in one shard.
3. Large shards are dealt into blocks of points and queries.  A block builds
   its own tree over its points, prunes by the same bounds, compares the rest
   and returns one link per point to the least point of its cluster there, so
   a group of n near copies gives O(n) links, never n * n.
4. The links' connected components are the near-duplicate classes.

The sample steers only where points are compared; results are exact for any
sample.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm.common import components, edge_roots, store, worker_cache

SAMPLE = 16_384  # fingerprints that fit the upper tree
SHARD = 4_096, 65_536  # least and most points of a shard; a table is cut into 16 shards between the two
LEAF = 256  # points of a leaf inside a block
SEED = 42


# -- fingerprints -------------------------------------------------------------


def fingerprint_bytes(text: bytes | None, width: int = 4) -> bytes:
    """Eight big-endian bytes: a bit is set where over half the shingles' hashes have it.

    A-Z count as lower case; fewer words than ``width`` are one shingle; no word gives zero.
    """
    words = (text or b"").lower().split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_digest(joined, SEED)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[: len(words) - width])]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :], strict=True)])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(rows), 65_536):
        ones += np.unpackbits(rows[at : at + 65_536], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(rows)).tobytes()


@F.arrow_udf(T.BinaryType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    worker_cache("none", dict)  # it remembers nothing, and no other operator's cache is needed now
    return pa.array([fingerprint_bytes(t.as_py()) for t in texts], pa.binary())


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column as 16 lower-case hex digits."""
    return F.lower(F.hex(_fingerprints(text.cast("binary"))))


def _as_long(hexed: str) -> Column:
    # two halves, because conv() of the upper half of the range does not fit a long
    high = F.conv(F.substring(hexed, 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(hexed, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


# -- vantage-point trees --------------------------------------------------------


class VpTree:
    """Inner nodes (vantage point, radius, inside, outside); a child below zero is leaf ``-1 - child``."""

    def __init__(self, points: np.ndarray, leaf: int, seed: int = SEED):
        self.nodes: list[tuple[np.uint64, int, int, int]] = []
        self.leaves: list[np.ndarray] = []
        self._rng = np.random.default_rng(seed)
        self._points, self._leaf = points, max(1, leaf)
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray) -> int:
        split = self._split(rows) if len(rows) > self._leaf else None
        if split is None:
            self.leaves.append(rows)
            return -len(self.leaves)
        vantage, radius, inside = split
        at = len(self.nodes)
        self.nodes.append((vantage, radius, 0, 0))
        self.nodes[at] = (vantage, radius, self._build(rows[inside]), self._build(rows[~inside]))
        return at

    def _split(self, rows: np.ndarray):
        """The candidate whose distances spread most, cut at the middle; None if no cut parts the rows."""
        points = self._points[rows]
        best = None
        for vantage in self._rng.choice(points, min(8, len(points)), replace=False):
            away = np.bitwise_count(points ^ vantage)
            if best is None or away.var() > best[1].var():
                best = vantage, away
        vantage, away = best
        radius = int(np.median(away))
        if radius == away.max():
            radius -= 1
        inside = away <= radius
        return (vantage, radius, inside) if 0 < inside.sum() < len(rows) else None

    def visits(self, queries: np.ndarray, radius: int):
        """Yields (leaf, rows of ``queries`` whose ball of ``radius`` may reach it)."""
        todo = [(self.root, np.arange(len(queries)))]
        while todo:
            at, rows = todo.pop()
            if not len(rows):
                continue
            if at < 0:
                yield -1 - at, rows
                continue
            vantage, cut, inside, outside = self.nodes[at]
            away = np.bitwise_count(queries[rows] ^ vantage).astype(np.int64)
            todo.append((inside, rows[away - radius <= cut]))
            todo.append((outside, rows[away + radius > cut]))


def _block_links(points: np.ndarray, queries: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (point, least point of its cluster) among ``points`` and from ``queries`` to them."""
    tree = VpTree(points, LEAF)
    values = np.concatenate([points, queries])
    ends_a, ends_b = [], []
    for leaf, rows in tree.visits(values, max_bits):
        inside = tree.leaves[leaf]
        for at in range(0, len(rows), 4_096):
            some = rows[at : at + 4_096]
            close = np.bitwise_count(values[some][:, None] ^ points[inside][None, :]) <= max_bits
            hit = close.sum(axis=1) > 0
            some, close = some[hit], close[hit]
            # a query joins the first point it meets; points that share a query are chained through it
            first = close.argmax(axis=1)
            ends_a.append(some)
            ends_b.append(inside[first])
            many = close.sum(axis=1) > 1
            if many.any():
                q, p = _spanning(close[many])
                ends_a.append(some[many][q])
                ends_b.append(inside[p])
    if not ends_a:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    a, b = np.concatenate(ends_a), np.concatenate(ends_b)
    nodes, roots = edge_roots(a[a != b], b[a != b])
    return values[nodes], values[roots]


def _spanning(close: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each column its first row that meets it, and each row's first column meeting an earlier class.

    Columns get labels by passing minima over rows and columns until nothing
    moves; the links (row, column) returned connect what the matrix connects.
    """
    label = np.arange(close.shape[1])
    big = close.shape[1]
    while True:
        low = np.where(close, label, big).min(axis=1)
        new = np.minimum(label, np.where(close, low[:, None], big).min(axis=0))
        if np.array_equal(new, label):
            break
        label = new
    used = np.flatnonzero(close.any(axis=0))
    row_of_root = {}
    low = np.where(close, label, big).min(axis=1)
    for r, root in enumerate(low.tolist()):
        row_of_root.setdefault(root, r)
    return np.array([row_of_root[c] for c in label[used].tolist()]), used


# -- the operator ---------------------------------------------------------------


def _route(tree: VpTree, max_bits: int):
    """A batch of points as rows of their home shard (query 0) and of later shards that they reach (query 1)."""

    def run(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            points = fp.view(np.uint64)
            home = np.empty(len(fp), np.int64)
            for shard, rows in tree.visits(points, 0):
                home[rows] = shard
            parts = [(home, fp, np.zeros(len(fp), np.int8))]
            for shard, rows in tree.visits(points, max_bits):
                rows = rows[home[rows] < shard]
                parts.append((np.full(len(rows), shard), fp[rows], np.ones(len(rows), np.int8)))
            for shard, some, query in parts:
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(some), pa.array(query)], ["shard", "fp", "query"])

    return run


def link_fingerprints(points: DataFrame, max_bits: int = 4, shard: int | None = None) -> DataFrame:
    """Links (a, b) that connect every two distinct ``fp`` (long) of ``points`` at ``max_bits`` or fewer bits.

    The links span each cluster; they are not all its pairs.
    """
    n = points.count()
    shard = shard or min(max(n // 16, SHARD[0]), SHARD[1])
    fraction = min(1.0, 1.2 * SAMPLE / max(n, 1))
    sample = [r.fp for r in points.sample(fraction, seed=SEED).limit(SAMPLE).collect()]
    tree = VpTree(np.array(sample, np.int64).view(np.uint64), max(8, len(sample) * shard // max(n, 1)))
    tree.leaves = [np.empty(0)] * len(tree.leaves)
    tree._points = None
    routed = store(points.select("fp").mapInArrow(_route(tree, max_bits), "shard int, fp long, query byte"), "routed")
    # one row per shard, and there are fewer shards than sampled points: sizes decide the number of blocks
    own, other = F.col("query") == 0, F.col("query") == 1
    sizes = routed.groupBy("shard").agg(F.count_if(own).alias("points"), F.count_if(other).alias("queries"))
    sizes = sizes.where("points > 0").select(
        "shard",
        F.ceil(F.col("points") / shard).alias("point_blocks"),
        F.ceil((F.col("queries") + F.when(F.col("points") > shard, F.col("points")).otherwise(1)) / (2 * shard)).alias("query_blocks"),
    )
    all_of = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - F.lit(1).cast("long"))
    salt = F.xxhash64("fp")
    own_p, own_q = F.pmod(salt, "point_blocks"), F.pmod(salt, "query_blocks")
    sized = routed.join(F.broadcast(sizes), "shard")
    dealt = sized.select(
        "shard",
        F.explode(F.when(own, F.array(own_p)).otherwise(all_of("point_blocks"))).alias("p"),
        F.when(other, F.array(own_q)).otherwise(all_of("query_blocks")).alias("q"),
        "fp",
        "query",
    ).withColumn("q", F.explode("q"))
    # points of one shard that fell into different blocks meet as queries of the later blocks
    home = sized.where(own & (F.col("point_blocks") > 1)).select(
        "shard", F.explode(all_of("point_blocks")).alias("p"), own_q.alias("q"), "fp", F.lit(1).cast("byte").alias("query"), own_p.alias("mine")
    ).where("p > mine").drop("mine")

    def search(block: pd.DataFrame) -> pd.DataFrame:
        fp, query = block["fp"].to_numpy(np.int64).view(np.uint64), block["query"].to_numpy()
        a, b = _block_links(fp[query == 0], fp[query == 1], max_bits) if (query == 0).any() else (fp[:0], fp[:0])
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    blocks = dealt.unionByName(home)
    links = store(blocks.groupBy("shard", "p", "q").applyInPandas(search, "a long, b long"), "links")
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    component_id is the least id reachable through links of ``max_bits`` or
    fewer bits, the row's own included.  Null and empty texts have fingerprint
    zero and link like any other.  A null id is kept as a row; it is never a
    component's least id unless no id of the component is set.  Repeated rows
    stay.  Other columns of ``docs`` are not read.  An empty table gives none.
    """
    prints = docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col)).alias("fingerprint"))
    prints = store(prints.withColumn("fp", _as_long("fingerprint")), "prints")
    points = store(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    roots = components(link_fingerprints(points, max_bits))
    linked = points.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = points.join(linked.join(least, "root").select("fp", "component_id"), "fp", "left")
    classes = classes.select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(classes, "fp").select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 4) -> DataFrame:
    """``docs`` with one document of each near-duplicate class: the one of least id, once.

    Columns stay as they are.  Rows without an id all stay.
    """
    classes = near_duplicates(docs.where(F.col(id_col).isNotNull()), id_col, text_col, max_bits)
    kept = classes.where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    once = Window.partitionBy(id_col).orderBy(F.xxhash64(*docs.columns))
    named = docs.join(kept, docs[id_col] == F.col("_kept")).withColumn("_row", F.row_number().over(once)).where("_row = 1")
    return named.select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
