"""Conversation prefix trie: adaptive radix trees over fixed-width turn ids.

1. A turn's id is the SHA-256 of its role and text, a big-endian number of 32
   bytes; a conversation's key is its turns' ids end to end.  Texts are read
   once and never shuffled.
2. Equal keys become one row with their smallest conversation and the hash of
   their ids, which are streamed in sorted chunks through one SHA-256.
3. Keys in byte order are cut into shards of bounded size.  A task builds the
   adaptive radix tree of its shard: nodes of 4, 16, 48 or 256 places that
   grow, compressed paths, leaves that hold the rest of their key.  Only byte
   depths at the end of a turn emit nodes.
4. A prefix that goes on in the neighbour shard is emitted by both.  All
   measures are sums over shards once such a prefix's own words and its place
   among its parent's children are counted by the first shard alone, so one
   aggregate over these few rows completes them.

One conversation's key must fit in a task (32 bytes a turn).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from pairlab.llm.common import release, store, word_count

WIDTH = 32  # bytes of a turn id
FAMILY, HEADS = 20, 4  # conversations that share a first one; one less turn than HEADS at most is taken from it
ID_CHUNK = 512
SHARD_BYTES, SHARD_KEYS = 8 << 20, 50_000
NO_IDS = hashlib.sha256(b"").hexdigest()


# -- adaptive radix tree -------------------------------------------------------


class Leaf:
    """The only key below an edge: ``path`` is what it has left."""

    __slots__ = ("path", "row")

    def __init__(self, path: bytes, row: int):
        self.path, self.row = path, row

    def children(self) -> list:
        return []


class Inner:
    """A branching point or the end of a key that others extend; ``row`` is that key or None.

    Up to 16 children lie beside their sorted bytes, up to 48 behind an index
    of 256 one-byte places, more in 256 places of their own.
    """

    __slots__ = ("path", "row", "places", "bytes", "kids")

    def __init__(self, path: bytes, row: int | None = None):
        self.path, self.row = path, row
        self.places, self.bytes, self.kids = 4, bytearray(), []

    def find(self, byte: int):
        if self.places <= 16:
            i = bisect_left(self.bytes, byte)
            return self.kids[i] if i < len(self.bytes) and self.bytes[i] == byte else None
        if self.places == 48:
            return self.kids[self.bytes[byte] - 1] if self.bytes[byte] else None
        return self.kids[byte]

    def put(self, byte: int, node) -> None:
        """Add a child, or replace the one under the same byte."""
        if self.places <= 16:
            i = bisect_left(self.bytes, byte)
            if i < len(self.bytes) and self.bytes[i] == byte:
                self.kids[i] = node
                return
            if len(self.bytes) < self.places:
                self.bytes.insert(i, byte)
                self.kids.insert(i, node)
                return
            self._grow()
            self.put(byte, node)
        elif self.places == 48:
            if self.bytes[byte]:
                self.kids[self.bytes[byte] - 1] = node
            elif len(self.kids) < 48:
                self.kids.append(node)
                self.bytes[byte] = len(self.kids)
            else:
                self._grow()
                self.put(byte, node)
        else:
            self.kids[byte] = node

    def _grow(self) -> None:
        if self.places == 4:
            self.places = 16
        elif self.places == 16:
            index = bytearray(256)
            for i, byte in enumerate(self.bytes):
                index[byte] = i + 1
            self.places, self.bytes = 48, index
        else:
            every = [self.kids[i - 1] if i else None for i in self.bytes]
            self.places, self.bytes, self.kids = 256, bytearray(), every

    def children(self) -> list:
        """Children in byte order."""
        if self.places <= 16:
            return self.kids
        if self.places == 48:
            return [self.kids[i - 1] for i in self.bytes if i]
        return [k for k in self.kids if k is not None]


def _common(a: bytes, b: bytes) -> int:
    if b.startswith(a):
        return len(a)
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def insert(root: Inner, key: bytes, row: int) -> None:
    """Add a key that is not in the tree; the root's own path is empty."""
    parent, edge, node, rest = None, 0, root, key
    while True:
        same = _common(node.path, rest)
        if same < len(node.path):  # the path parts inside an edge
            fork = Inner(node.path[:same])
            byte, node.path = node.path[same], node.path[same + 1 :]
            fork.put(byte, node)
            if same == len(rest):
                fork.row = row
            else:
                fork.put(rest[same], Leaf(rest[same + 1 :], row))
            parent.put(edge, fork)
            return
        rest = rest[same:]
        if isinstance(node, Leaf):  # an older key ends where this one goes on
            longer = Inner(node.path, node.row)
            longer.put(rest[0], Leaf(rest[1:], row))
            parent.put(edge, longer)
            return
        if not rest:
            node.row = row
            return
        below = node.find(rest[0])
        if below is None:
            node.put(rest[0], Leaf(rest[1:], row))
            return
        parent, edge, node, rest = node, rest[0], below, rest[1:]


def build(keys: list[bytes]) -> Inner:
    root = Inner(b"")
    for row, key in enumerate(keys):
        insert(root, key, row)
    return root


class Below:
    """What is known of a subtree while its parent is still open."""

    __slots__ = ("low", "high", "conv", "convs", "leaves", "saved", "tops", "owned")

    def __init__(self):
        self.low, self.high, self.conv, self.convs, self.leaves, self.saved = None, -1, None, 0, 0, 0
        self.tops, self.owned = [], 0  # the topmost emitted nodes, and how many of them count as children here

    def add(self, other: Below) -> None:
        self.low = other.low if self.low is None else min(self.low, other.low)
        self.high = max(self.high, other.high)
        self.conv = other.conv if self.conv is None else min(self.conv, other.conv)
        self.convs, self.leaves, self.saved = self.convs + other.convs, self.leaves + other.leaves, self.saved + other.saved
        self.tops += other.tops
        self.owned += other.owned

    def add_key(self, row: int, conv: int, convs: int) -> None:
        self.low = row if self.low is None else min(self.low, row)
        self.high = max(self.high, row)
        self.conv = conv if self.conv is None else min(self.conv, conv)
        self.convs += convs


def nodes(keys: list[bytes], convs: list[int], copies: list[int], words: list, before: int = -1, after: int = -1) -> list[dict]:
    """The turn-aligned nodes of the trie of sorted distinct ``keys``.

    ``before`` and ``after`` are the turns that the first and the last key
    share with the neighbour shards, -1 without a neighbour.
    """
    found: list[dict] = []
    last = len(keys) - 1
    # (node, bytes before its path, end of its parent's path), then the same once its children are done
    stack: list[tuple] = [(build(keys), 0, -1, None, None)]
    while stack:
        node, start, above, mine, into = stack.pop()
        end = start + len(node.path)
        if mine is None:
            mine = Below()
            stack.append((node, start, above, mine, into))
            stack.extend((kid, end + 1, end, None, mine) for kid in node.children())
            continue
        if node.row is not None:
            mine.add_key(node.row, convs[node.row], copies[node.row])
        for depth in range(end // WIDTH, above // WIDTH, -1):  # the ends of turns on this node's path
            earlier = mine.low == 0 and depth <= before
            later = mine.high == last and depth <= after
            childless = not mine.tops and not later
            text = words[mine.low][depth - 1] if depth else 0
            mine.leaves += childless
            mine.saved += mine.convs * text - (0 if earlier else text)
            prefix = hashlib.sha256(keys[mine.low][: depth * WIDTH]).hexdigest() if earlier or later else None
            ends = node.row if node.row is not None and depth * WIDTH == end else None
            for top in mine.tops:
                top["parent_conv_id"], top["parent_prefix"] = mine.conv, prefix
            row = {
                "conv_id": mine.conv, "depth": depth, "parent_conv_id": None, "n_convs": mine.convs, "n_children": mine.owned,
                "n_leaves": mine.leaves, "saved_tokens": mine.saved, "ends": ends, "prefix": prefix, "parent_prefix": None,
            }
            found.append(row)
            mine.tops, mine.owned = [row], 0 if earlier else 1
        if into is not None:
            into.add(mine)
    return found


# -- conversations and keys -------------------------------------------------------


def turn_ids(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_id, words): turns in order, from 0 in each conversation; rows without conv_id are left out."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    both = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where("conv_id is not null").select(
        "conv_id", "turn", F.unhex(F.sha2(both.cast("binary"), 8 * WIDTH)).alias("turn_id"), word_count(text).alias("words")
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "turn_id")
    return turns.select("conv_id", (F.row_number().over(order) - 1).alias("pos"), "turn_id", "words")


def heads_taken(conv: Column) -> Column:
    """How many first turns a conversation takes from the first one of its family."""
    return (F.crc32(conv.cast("string").cast("binary")) % HEADS).cast("int")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, key, words): every conversation with the first turns of its family's first one instead of its own."""
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    known = turns.groupBy("conv_id").agg(F.lit(-1).alias("pos"))
    own = turns.where((F.col("pos") >= heads_taken(F.col("conv_id"))) | (base == F.col("conv_id")))
    firsts = turns.where((base == F.col("conv_id")) & (F.col("pos") < HEADS - 1)).withColumnRenamed("conv_id", "base")
    heads = known.select("conv_id", base.alias("base")).where("conv_id <> base").join(firsts, "base")
    heads = heads.where(F.col("pos") < heads_taken(F.col("conv_id")))
    # a row without a turn keeps conversations that end up without one
    none = known.select("conv_id", "pos", F.lit(None).cast("binary").alias("turn_id"), F.lit(None).cast("long").alias("words"))
    rows = own.unionByName(heads.drop("base")).unionByName(none)
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "turn_id", "words"))).alias("_t"))
    there = F.filter("_t", lambda t: t["turn_id"].isNotNull())
    key = F.unhex(F.array_join(F.transform(there, lambda t: F.hex(t["turn_id"])), ""))
    return listed.select("conv_id", key.alias("key"), F.transform(there, lambda t: t["words"]).alias("words"))


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks of one key, which follow each other, to one row per key."""
    now = None  # key id, key, words, smallest id, number, running hash

    def closed() -> tuple:
        return now[1], now[2], now[3], now[4], now[5].hexdigest()

    for batch in batches:
        done = []
        for key_id, key, words, ids in zip(batch["key_id"], batch["key"], batch["words"], batch["ids"], strict=True):
            text = ",".join(map(str, ids)).encode()
            if now is not None and now[0] == key_id:
                now[4] += len(ids)
                now[5].update(b"," + text)
                continue
            if now is not None:
                done.append(closed())
            now = [key_id, key, words, ids[0], len(ids), hashlib.sha256(text)]
        yield pd.DataFrame(done, columns=["key", "words", "conv_id", "copies", "ends_sha256"])
    if now is not None:
        yield pd.DataFrame([closed()], columns=["key", "words", "conv_id", "copies", "ends_sha256"])


def distinct_keys(convs: DataFrame) -> DataFrame:
    """(key, words, conv_id, copies, ends_sha256): a row per distinct key."""
    chunk = F.expr(f"conv_id div {ID_CHUNK}")
    chunks = convs.groupBy(F.sha2("key", 256).alias("key_id"), chunk.alias("chunk")).agg(
        F.first("key").alias("key"), F.first("words").alias("words"), F.sort_array(F.collect_list("conv_id")).alias("ids")
    )
    ordered = chunks.repartition("key_id").sortWithinPartitions("key_id", "chunk")
    return ordered.mapInPandas(_merged, "key binary, words array<long>, conv_id long, copies long, ends_sha256 string")


# -- shards and the whole trie -----------------------------------------------------

_NODE = (
    "shard int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, prefix string, parent_prefix string"
)


def _shared_turns(a, b) -> int:
    """Turns that two keys begin with alike; -1 if one is absent."""
    if a is None or b is None:
        return -1
    return _common(bytes(a), bytes(b)) // WIDTH


def _shard_nodes(shard: pd.DataFrame, bounds: pd.DataFrame) -> pd.DataFrame:
    shard = shard.sort_values("key", ignore_index=True)
    keys = [bytes(k) for k in shard["key"]]
    limits = bounds.iloc[0]
    found = nodes(
        keys, shard["conv_id"].tolist(), shard["copies"].tolist(), shard["words"].tolist(),
        _shared_turns(limits["last_before"], keys[0]), _shared_turns(keys[-1], limits["first_after"]),
    )
    out = pd.DataFrame(found)
    out["shard"] = shard["shard"].iloc[0]
    ends = shard["ends_sha256"].tolist()
    out["ends_sha256"] = [None if pd.isna(e) else ends[int(e)] for e in out["ends"]]
    out["parent_conv_id"] = out["parent_conv_id"].astype("Int64")
    return out[[c.split()[0] for c in _NODE.split(", ")]]


def prefix_trie(conversations: DataFrame, shard_bytes: int = SHARD_BYTES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) per distinct prefix.

    Columns used: conv_id, turn, role, text; others are not read.  Null roles
    and texts are empty, turns are ordered null first, equal turn numbers (also
    repeated rows) by their ids.  Rows without conv_id belong to no
    conversation; an empty table has no node, not even a root.
    """
    turns = store(turn_ids(conversations), "turns")
    keys = store(distinct_keys(rebuilt(turns)), "keys")
    size = keys.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("key") + 64).alias("bytes")).first()
    shards = max(1, -(-size["n"] // shard_keys), -(-(size["bytes"] or 0) // shard_bytes))
    dealt = store(keys.repartitionByRange(shards, "key").withColumn("shard", F.spark_partition_id()), "key-shards")
    release(keys, turns)
    # one row per shard from here on
    order = Window.partitionBy(F.lit(0)).orderBy("shard")
    ends = dealt.groupBy("shard").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    bounds = ends.select("shard", F.lag("last").over(order).alias("last_before"), F.lead("first").over(order).alias("first_after"))
    found = store(dealt.groupBy("shard").cogroup(bounds.groupBy("shard")).applyInPandas(_shard_nodes, _NODE), "trie-nodes")
    release(dealt)

    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    shared = store(
        found.where("prefix is not null").groupBy("prefix", "parent_prefix", "depth")
        .agg(F.min("conv_id").alias("conv_id"), *sums, F.max("ends_sha256").alias("ends_sha256")),
        "shared-nodes",
    )
    parents = shared.select(F.col("prefix").alias("parent_prefix"), F.col("conv_id").alias("parent_conv_id"))
    top = shared.join(parents, "parent_prefix", "left")
    # a shared prefix may have very many children, but each shard holds a bounded part of them
    in_shard = found.where("prefix is not null").select("shard", F.col("prefix").alias("parent_prefix")).join(parents, "parent_prefix")
    alone = found.where("prefix is null")
    hung = alone.where("parent_prefix is not null").drop("parent_conv_id").join(in_shard, ["shard", "parent_prefix"])
    whole = alone.where("parent_prefix is null").select(out).unionByName(hung.select(out)).unionByName(top.select(out))
    return whole.fillna({"ends_sha256": NO_IDS})
