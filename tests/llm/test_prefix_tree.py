"""The prefix trie against plain dictionaries."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from pairlab.llm import prefix_tree

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((-1 if turn is None else turn, role or "", text or ""))
    # equal turn numbers go by the turn's digest
    digest = lambda t: hashlib.sha256(f"{len(t[1])}:{t[1]}{t[2]}".encode()).digest()
    own = {c: [t[1:] for t in sorted(ts, key=lambda t: (t[0], digest(t)))] for c, ts in own.items()}
    members = defaultdict(list)
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        built = (own.get(conv - conv % 20, [])[:h] + turns[h:]) if conv % 20 else turns
        for d in range(len(built) + 1):
            members[tuple(built[:d])].append((conv, len(built)))
    children = defaultdict(list)
    for prefix in members:
        if prefix:
            children[prefix[:-1]].append(prefix)
    found, leaves, saved = [], {}, {}
    for prefix in sorted(members, key=len, reverse=True):
        leaves[prefix] = sum(leaves[c] for c in children[prefix]) or 1
        words = len(WORD.findall(prefix[-1][1])) if prefix else 0
        saved[prefix] = (len(members[prefix]) - 1) * words + sum(saved[c] for c in children[prefix])
    for prefix, convs in members.items():
        ends = ",".join(str(c) for c, n in sorted(convs) if n == len(prefix))
        parent = min(members[prefix[:-1]])[0] if prefix else None
        row = (min(convs)[0], len(prefix), parent, len(convs), len(children[prefix]), leaves[prefix], saved[prefix])
        found.append((*row, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=str)


def built(spark, rows, **kw):
    df = prefix_tree.prefix_trie(spark.createDataFrame(rows, SCHEMA), **kw)
    assert df.columns == NAMES
    return sorted((tuple(r) for r in df.collect()), key=str)


def rows_of(seed, convs, texts, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        n = rng.randint(1, longest)
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(texts)) for t in range(n)]
    rows += [(c + convs, t, r, x) for c, t, r, x in rows if c % 3 == 0]  # copies
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_keys", [1, 3, 50_000])
def test_trie_equals_a_plain_one(spark, shard_keys):
    rows = rows_of(1, 60, ["a", "a b", "", "c  d\te"], 6)
    assert built(spark, rows, shard_keys=shard_keys) == plain(rows)


def test_shards_may_cut_a_long_shared_conversation(spark):
    rows = [(c, t, "user", f"turn {t}") for c in (0, 20, 40, 60) for t in range(300 - c)] + [(1, 0, "user", "x")]
    assert built(spark, rows, shard_keys=1) == plain(rows)
    assert built(spark, rows, shard_bytes=1_000) == plain(rows)


def test_awkward_rows(spark):
    rows = [
        (21, 0, "user", "gone"), (22, 0, None, None), (22, None, "user", "first"), (None, 0, "user", "no conversation"),
        (40, 0, "a", "bc"), (41, 0, "ab", "c"), (60, 1, "user", "same"), (60, 1, "user", "same"), (60, 1, "user", "other"),
        (80, 0, "user", "word " * 30_000), (100, 0, "user", "é　ü\n"), (0, 0, "", ""),
    ]
    rows += [(c, 0, "user", "only turn") for c in range(201, 220)]  # some end up without a turn
    assert built(spark, rows) == built(spark, rows, shard_keys=2) == plain(rows)
    assert built(spark, []) == []


def test_columns_with_clashing_names_are_not_read(spark):
    rows = rows_of(2, 20, ["a", "b"], 3)
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA + ", pos int, key string, shard string")
    assert sorted((tuple(r) for r in prefix_tree.prefix_trie(df).collect()), key=str) == plain(rows)


def test_node_layouts_grow_and_keep_byte_order():
    for n in (3, 4, 5, 16, 17, 48, 49, 256):
        bytes_ = list(range(n))
        random.Random(n).shuffle(bytes_)
        node = prefix_tree.Inner(b"")
        for b in bytes_:
            node.put(b, prefix_tree.Leaf(b"", b))
        node.put(bytes_[0], prefix_tree.Leaf(b"new", bytes_[0]))
        assert node.places == next(p for p in (4, 16, 48, 256) if n <= p)
        assert [k.row for k in node.children()] == list(range(n))
        assert node.find(bytes_[0]).path == b"new" and (n == 256 or node.find(255) is None)
