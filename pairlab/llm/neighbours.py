"""Approximate nearest neighbours: one navigable small-world graph per shard.

Vectors are dealt to shards by hash.  A shard's graph has levels; its nodes
are numbered so that a level holds the first of them, and a level is one flat
array of neighbour numbers.  Nodes are added in batches, each found its
neighbours by a beam search over what is there (all of a batch in step), and
links are chosen for diversity.  The index is a stored table with a row per
shard.  Every query searches every shard, in blocks; the shards' best are
merged.  Equal vectors are one node that carries its least ids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlab.llm.common import store
from pairlab.llm.embedding_dedup import unit_vectors, usable

SHARD = 8_192
BLOCK = 1_024  # queries searched in step
LINKS = 16  # links of a new node; a node keeps twice as many
BUILD = 64  # beam while building
BEAM = 96  # beam while searching
SEED = 42


def beam_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest nodes (best first, -1 where fewer) and their cosines, for all queries in step."""
    n = len(queries)
    seen = np.zeros((n, len(x)), bool)
    ids = np.full((n, beam), -1, np.int32)
    sims = np.full((n, beam), -np.inf, np.float32)
    open_ = np.zeros((n, beam), bool)
    ids[:, 0], open_[:, 0] = entry, True
    sims[:, 0] = np.einsum("qd,qd->q", x[entry], queries)
    seen[np.arange(n), entry] = True
    live = np.arange(n)
    while len(live):
        best = np.where(open_[live], sims[live], -np.inf).argmax(axis=1)
        going = open_[live, best]
        live, best = live[going], best[going]
        if not len(live):
            break
        open_[live, best] = False
        near = graph[ids[live, best]]
        new = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
        r, c = np.nonzero(new)
        seen[live[r], near[r, c]] = True
        sim = np.full(near.shape, -np.inf, np.float32)
        sim[r, c] = np.einsum("pd,pd->p", x[near[r, c]], queries[live[r]])
        all_sims = np.concatenate([sims[live], sim], axis=1)
        all_ids = np.concatenate([ids[live], np.where(new, near, -1)], axis=1)
        all_open = np.concatenate([open_[live], new], axis=1)
        keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        sims[live] = np.take_along_axis(all_sims, keep, 1)
        ids[live] = np.take_along_axis(all_ids, keep, 1)
        open_[live] = np.take_along_axis(all_open, keep, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _chosen(x: np.ndarray, near: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of candidates (best first, -1 where none) up to ``most``: those nearer to the node than to any chosen, then the nearest."""
    out = np.full((len(near), most), -1, np.int32)
    for at in range(0, len(near), 512):
        ids, sim = near[at : at + 512], sims[at : at + 512]
        v = x[np.maximum(ids, 0)]
        among = np.matmul(v, v.transpose(0, 2, 1))
        kept = np.zeros(ids.shape, bool)
        closest = np.full(ids.shape, -np.inf, np.float32)
        for c in range(ids.shape[1]):
            good = (ids[:, c] >= 0) & (sim[:, c] > closest[:, c]) & (kept.sum(axis=1) < most)
            kept[:, c] = good
            closest = np.where(good[:, None], np.maximum(closest, among[:, c]), closest)
        rank = np.argsort(np.where(ids < 0, 2, ~kept), axis=1, kind="stable")[:, :most]
        out[at : at + 512, : rank.shape[1]] = np.take_along_axis(ids, rank, 1)
    return out


def _link_back(x: np.ndarray, graph: np.ndarray, new: np.ndarray, links: np.ndarray) -> None:
    """Add links from the chosen neighbours to the new nodes; choose again where they are too many."""
    cap = graph.shape[1]
    p = np.repeat(new, links.shape[1])
    q = links.ravel()
    p, q = p[q >= 0], q[q >= 0]
    sim = np.einsum("pd,pd->p", x[p], x[q])
    order = np.lexsort((-sim, q))
    p, q = p[order], q[order]
    nodes, start, count = np.unique(q, return_index=True, return_counts=True)
    place = np.arange(len(q)) - np.repeat(start, count)
    some = place < cap
    row = np.repeat(np.arange(len(nodes)), count)[some]
    joined = np.full((len(nodes), 2 * cap), -1, np.int32)
    joined[:, :cap] = graph[nodes]
    joined[row, cap + place[some]] = p[some]
    full = (joined >= 0).sum(axis=1) > cap
    packed = np.take_along_axis(joined, np.argsort(joined < 0, axis=1, kind="stable"), 1)
    graph[nodes[~full]] = packed[~full, :cap]
    if full.any():
        ids = joined[full]
        sims = np.where(ids >= 0, np.einsum("ncd,nd->nc", x[np.maximum(ids, 0)], x[nodes[full]]), -np.inf)
        order = np.argsort(-sims, axis=1, kind="stable")
        graph[nodes[full]] = _chosen(x, np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), cap)


def level_sizes(n: int) -> list[int]:
    """Nodes of every level from the top: a level has one in ``LINKS`` of the one below."""
    sizes = [n]
    while sizes[-1] > 4 * LINKS:
        sizes.append(max(1, sizes[-1] // LINKS))
    return sizes[::-1]


def build(x: np.ndarray) -> list[np.ndarray]:
    """Neighbour arrays of the levels from the top, for vectors in random order."""
    levels: list[np.ndarray] = []
    for size in level_sizes(len(x)):
        own = x[:size]
        graph = np.full((size, 2 * LINKS), -1, np.int32)
        at = 1
        while at < size:
            end = min(size, 2 * at, at + BLOCK)
            new = np.arange(at, end)
            entry = descend(x, levels, x[new]) if levels else np.zeros(len(new), np.int64)
            entry = np.where(entry < at, entry, 0)
            ids, sims = beam_search(own[:at], graph[:at], x[new], entry, min(BUILD, at))
            # nodes of one batch may be neighbours too
            mates = x[new] @ x[new].T
            mates[np.tril_indices(len(new))] = -np.inf
            top = np.argsort(-mates.T, axis=1, kind="stable")[:, : min(LINKS, len(new))]
            mate_sims = np.take_along_axis(mates.T, top, 1)
            ids = np.concatenate([ids, np.where(np.isfinite(mate_sims), new[top], -1)], axis=1)
            sims = np.concatenate([sims, mate_sims], axis=1)
            order = np.argsort(-sims, axis=1, kind="stable")
            ids, sims = np.take_along_axis(ids, order, 1).astype(np.int32), np.take_along_axis(sims, order, 1)
            links = _chosen(own, ids, sims, LINKS)
            graph[new, : links.shape[1]] = links
            _link_back(own, graph, new, links)
            at = end
        levels.append(graph)
    return levels


def descend(x: np.ndarray, levels: list[np.ndarray], queries: np.ndarray) -> np.ndarray:
    """The nearest node of the lowest of ``levels``, met going down from the top."""
    entry = np.zeros(len(queries), np.int64)
    for graph in levels:
        ids, _ = beam_search(x[: len(graph)], graph, queries, entry, min(4, len(graph)))
        entry = ids[:, 0].astype(np.int64)
    return entry


def search(x: np.ndarray, levels: list[np.ndarray], queries: np.ndarray, beam: int = BEAM) -> np.ndarray:
    entry = descend(x, levels[:-1], queries)
    return beam_search(x, levels[-1], queries, entry, min(beam, len(x)))[0]


def build_index(nodes: DataFrame, shard: int = SHARD) -> DataFrame:
    """``nodes`` (node, embedding) as a stored table: one row (dim, shard, nodes, vectors, links) per shard."""
    nodes = nodes.withColumn("dim", F.size("embedding"))
    shards = max(1, -(-nodes.count() // shard))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)))

    def make(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.iloc[np.random.default_rng(SEED).permutation(len(part))] if len(part) > 1 else part
        raw = np.stack(part["embedding"]).astype(np.float64)
        [(_, unit)] = unit_vectors(pa.array(list(raw)))
        levels = build(unit.astype(np.float32))
        flat = np.concatenate([g.ravel() for g in levels])
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "nodes": [part["node"].to_numpy(np.int64).tobytes()], "vectors": [raw.tobytes()], "links": [flat.tobytes()]})

    return store(dealt.select("dim", "shard", "node", "embedding").groupBy("dim", "shard").applyInPandas(make, "dim int, shard long, nodes binary, vectors binary, links binary"), "index")


def _unit(raw: np.ndarray) -> np.ndarray:
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def search_index(index: DataFrame, queries: DataFrame, k: int, beam: int = BEAM) -> DataFrame:
    """(query_id, node, score): the ``k`` best nodes of every shard for ``queries`` (query_id, embedding)."""
    shards = index.agg(F.max("shard")).first()[0]
    if shards is None:
        return queries.sparkSession.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, node long, score double")
    blocks = max(1, -(-queries.count() // BLOCK))
    asked = queries.select(F.size("embedding").alias("dim"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"), "query_id", "embedding")
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards).cast("long"))))
    ready = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    keys = ["dim", "shard", "block"]

    def find(key: tuple, held: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(some):
            return pd.DataFrame({"query_id": some["query_id"][:0], "node": np.empty(0, np.int64), "score": np.empty(0)})
        row, dim = held.iloc[0], int(key[0])
        nodes = np.frombuffer(row["nodes"], np.int64)
        raw = np.frombuffer(row["vectors"]).reshape(-1, dim)
        flat, levels = np.frombuffer(row["links"], np.int32), []
        for size in level_sizes(len(nodes)):
            levels.append(flat[: size * 2 * LINKS].reshape(size, 2 * LINKS))
            flat = flat[size * 2 * LINKS :]
        asks = np.stack(some["embedding"]).astype(np.float64)
        ids = search(_unit(raw).astype(np.float32), levels, _unit(asks).astype(np.float32), beam)
        r, c = np.nonzero(ids >= 0)
        a, b = asks[r], raw[ids[r, c]]
        a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
        score = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
        order = np.lexsort((nodes[ids[r, c]], -score, r))
        r, c, score = r[order], c[order], score[order]
        top = np.arange(len(r)) - np.searchsorted(r, r) < k
        r, c = r[top], c[top]
        return pd.DataFrame({"query_id": some["query_id"].to_numpy()[r], "node": nodes[ids[r, c]], "score": score[top]})

    kind = queries.schema["query_id"].dataType.simpleString()
    return ready.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(find, f"query_id {kind}, node long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of ``queries`` its ``k`` nearest of ``vectors`` by cosine.

    Rows with the query's id are not its candidates; ties go to the smaller
    id; fewer candidates give fewer rows.  Vectors null, zero or with null or
    non-finite components take no part; vectors of another length are no
    candidates.  Rows repeated under one id count once as a query.  Other
    columns are not read.  An empty table gives no rows.
    """
    fine = vectors.where(usable(F.col(vector_col))).select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"))
    fine = fine.withColumn("node", F.xxhash64("embedding"))
    # of equal vectors the k + 1 least ids are all that a list of k can hold besides the query
    least = Window.partitionBy("node").orderBy("vec_id")
    ids = store(fine.dropDuplicates(["node", "vec_id"]).withColumn("r", F.row_number().over(least)).where(F.col("r") <= k + 1), "ids")
    asked = queries.where(usable(F.col(vector_col))).select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("embedding")).dropDuplicates(["query_id"])
    found = search_index(build_index(ids.where("r = 1").select("node", "embedding")), store(asked, "queries"), k + 1, beam)
    found = found.join(ids.select("node", "vec_id"), "node").where("vec_id <> query_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
