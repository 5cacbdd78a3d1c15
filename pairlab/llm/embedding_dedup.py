"""Near-duplicate embeddings through an inverted multi-index.

Each half of the unit vectors has its own codebook, fitted on a bounded
sample; the product of the two is a grid of cells.  A vector lives in one cell
and visits others in the order of a lower bound on its distance to anything
inside (two sorted lists, walked together), until the bound exceeds the
radius that the cosine allows.  The bound is exact (a point of a cell lies on
its side of the planes between the centres), so the recall aimed at is 1.
Each pair of cells meets once, large cells are dealt into blocks, and blocks
return sums and spanning links, never pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import components, edge_roots, store

SAMPLE = 8_192  # vectors that fit the codebooks
CELL = 4_096  # wanted vectors of the largest label in a cell; also of a block
CENTRES = 64  # most centres of a codebook
SEED = 42


def usable(vector: Column) -> Column:
    """True for vectors that have a direction: not null or zero, no null or non-finite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def unit_vectors(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors in double precision) for every length of vector in a list column."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    found = []
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        found.append((rows, _units(values[starts[rows][:, None] + np.arange(dim)])))
    return found


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)


def _centres(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    x = np.unique(x, axis=0)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = _squared(x, centres).argmin(axis=1)
        centres = np.stack([x[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
    return np.unique(centres, axis=0)


def codebooks(units: list[np.ndarray], k: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Codebooks of the two halves for every length of vector."""
    return {x.shape[1]: (_centres(x[:, : x.shape[1] // 2], k), _centres(x[:, x.shape[1] // 2 :], k)) for x in units if len(x)}


def _bounds(half: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre, and the squared least distance to a point of every centre's cell."""
    away = _squared(half, centres)
    near = away.argmin(axis=1)
    apart = np.sqrt(_squared(centres, centres))[near]
    gap = (away - away[np.arange(len(half)), near][:, None]) / (2 * np.where(apart > 0, apart, 1))
    return near, np.where(apart > 0, np.maximum(gap, 0) ** 2, 0)


def visits(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], radius2: float):
    """Home cell of every row, then (rows, cells) that the multi-sequence walk visits."""
    (near1, low1), (near2, low2) = _bounds(x[:, : x.shape[1] // 2], books[0]), _bounds(x[:, x.shape[1] // 2 :], books[1])
    k2 = len(books[1])
    order1, order2 = low1.argsort(axis=1), low2.argsort(axis=1)
    low1, low2 = np.take_along_axis(low1, order1, 1), np.take_along_axis(low2, order2, 1)
    rows, cells = [], []
    for i in range(low1.shape[1]):
        reach = (low2 <= (radius2 - low1[:, i])[:, None]).sum(axis=1)
        some = np.flatnonzero(reach)
        if not len(some):
            break
        row = np.repeat(some, reach[some])
        place = np.arange(len(row)) - np.repeat(np.cumsum(reach[some]) - reach[some], reach[some])
        rows.append(row)
        cells.append(order1[row, i] * k2 + order2[row, place])
    return near1 * k2 + near2, np.concatenate(rows), np.concatenate(cells)


def _dealt_cells(books: dict, radius2: float):
    def run(batches):
        for batch in batches:
            column = batch.column("embedding")
            values = column.flatten().to_numpy(zero_copy_only=False)
            values = values if values.dtype in (np.float32, np.float64) else values.astype(np.float64)
            ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
            for rows, x in unit_vectors(column):
                dim = x.shape[1]
                if dim in books:
                    home, row, cell = visits(x, books[dim], radius2)
                else:
                    home, row, cell = np.zeros(len(x), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
                later = cell > home[row]
                row, cell = row[later], cell[later]
                at = np.concatenate([np.arange(len(x)), row])
                for lo in range(0, len(at), 20_000):
                    some = at[lo : lo + 20_000]
                    take = pa.array(rows[some])
                    # as they were given: single precision takes half the room
                    vectors = [values[ends[i] - dim : ends[i]].tobytes() for i in rows[some]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("label_no").take(take), pa.array(np.full(len(some), dim), pa.int32()),
                            pa.array(np.concatenate([home, cell])[lo : lo + 20_000], pa.int64()),
                            pa.array((np.arange(lo, lo + len(some)) >= len(x)).astype(np.int8)),
                            batch.column("node").take(take), batch.column("copies").take(take), pa.array(vectors, pa.binary()),
                        ],
                        ["label_no", "dim", "cell", "query", "node", "copies", "vector"],
                    )

    return run


def _compare(block: pd.DataFrame, least: float, among: bool) -> pd.DataFrame:
    """Sums of copies linked to each node, and the least node of its cluster, of one block.

    Queries meet the block's own vectors; these meet each other if ``among``.
    """
    own = (block["query"] == 0).to_numpy()
    node, copies = block["node"].to_numpy(np.int64), block["copies"].to_numpy(np.int64)
    inside = np.flatnonzero(own)
    order = np.concatenate([inside, np.flatnonzero(~own)]) if among else np.flatnonzero(~own)
    links = np.zeros(len(block), np.int64)
    ends_a, ends_b = [node[:0]], [node[:0]]
    if len(inside) and len(order):
        dim = int(block["dim"].iloc[0])
        kind = np.float64 if len(block["vector"].iloc[0]) == 8 * dim else np.float32
        x = _units(np.frombuffer(b"".join(block["vector"]), kind).reshape(-1, dim).astype(np.float64))
        for at in range(0, len(order), 512):
            some = order[at : at + 512]
            hit = (x[some] @ x[inside].T >= least) & (node[some][:, None] != node[inside])
            links[some] += hit @ copies[inside]
            asks = ~own[some]
            links[inside] += copies[some][asks] @ hit[asks]
            a, b = np.nonzero(hit)
            n, r = edge_roots(node[some][a], node[inside][b])
            ends_a.append(n)
            ends_b.append(r)
    nodes, roots = edge_roots(np.concatenate(ends_a), np.concatenate(ends_b))
    found = pd.DataFrame({"node": node, "links": links}).groupby("node", as_index=False)["links"].sum()
    found = found[found["links"] > 0]
    return found.assign(root=pd.Series(roots, index=nodes).reindex(found["node"]).to_numpy(np.int64) if len(found) else node[:0])


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Rows of equal, not null label and equal length link at a cosine of
    ``least`` or more; n_links counts the other rows linked directly, copies
    included.  Null or zero vectors and those with null or non-finite
    components link with nothing, nor do rows without label.  component_id
    is the least id reachable, the row's own included.  Repeated rows are
    copies of each other.  Other columns are not read.  An empty table gives
    no rows.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    fine = usable(F.col("embedding")) & F.col("label").isNotNull()
    rows = rows.withColumn("label_no", F.xxhash64("label")).withColumn("node", F.when(fine, F.xxhash64("label", "embedding")))
    nodes = rows.where("node is not null").groupBy("node").agg(
        F.first("label_no").alias("label_no"), F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"),
    )
    nodes = store(nodes, "vectors")
    n, largest = nodes.groupBy("label_no").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    sample = nodes.select("embedding").sample(min(1.0, 1.2 * SAMPLE / max(n, 1)), seed=SEED).limit(SAMPLE).toArrow()
    units = [x for _, x in unit_vectors(sample.column("embedding").combine_chunks())] if sample.num_rows else []
    k = int(min(CENTRES, max(1, round((largest / CELL) ** 0.5))))
    books = codebooks([x for x in units if x.shape[1] > 1], k)
    radius2 = (2 - 2 * least) * (1 + 1e-9) + 1e-12
    cells = store(nodes.select("label_no", "node", "copies", "embedding").mapInArrow(_dealt_cells(books, radius2), "label_no long, dim int, cell long, query byte, node long, copies long, vector binary"), "cells")
    keys = ["label_no", "dim", "cell"]
    own, other = F.col("query") == 0, F.col("query") == 1
    sizes = cells.groupBy(keys).agg(F.count_if(own).alias("points"), F.count_if(other).alias("queries")).where("points > 0")
    sizes = sizes.select(*keys, F.ceil(F.col("points") / CELL).alias("ps"), F.ceil((F.col("queries") + F.when(F.col("points") > CELL, F.col("points")).otherwise(1)) / (4 * CELL)).alias("qs"))
    sized = cells.join(sizes, keys)
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    p, q = F.pmod(F.xxhash64("node"), "ps"), F.pmod(F.xxhash64("node"), "qs")
    held = ["query", "node", "copies", "vector"]
    dealt = sized.select(*keys, F.explode(F.when(own, F.array(p)).otherwise(upto("ps"))).alias("p"), F.when(other, F.array(q)).otherwise(upto("qs")).alias("q"), *held)
    dealt = dealt.select(*keys, "p", F.explode("q").alias("q"), *held)
    # a block's own vectors are compared with each other in its first query block only
    later = sized.where(own & (F.col("ps") > 1)).withColumn("mine", p).select(*keys, F.explode(upto("ps")).alias("p"), q.alias("q"), F.lit(1).cast("byte").alias("query"), "node", "copies", "vector", "mine").where("p > mine").drop("mine")
    blocks = dealt.unionByName(later)

    def compare(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        return _compare(block, least, key[4] == 0)

    found = store(blocks.groupBy(*keys, "p", "q").applyInPandas(compare, "node long, links long, root long"), "links")
    roots = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = nodes.select("node", "least").join(roots, "node")
    lowest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = nodes.select("node", "copies", "least").join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
    classes = classes.join(linked.join(lowest, "root").select("node", "component_id"), "node", "left").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")
    )
    out = rows.select("vec_id", "node").join(classes, "node", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
