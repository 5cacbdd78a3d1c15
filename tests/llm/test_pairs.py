"""SimHash, embeddings, neighbours and passages against brute force, with the awkward rows."""

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from pairlab.llm import common, embedding_dedup, neighbours, passages, simhash
from pairlab.llm.common import components, edge_roots

DOCS = "doc_id long, text string, fingerprint int, component_id string"


def roots_of(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r, seed=42) for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def sentence(rng, n):
    return " ".join(f"w{x}" for x in rng.integers(0, 500, n))


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    want = roots_of({x for e in links for x in e}, links)
    assert got == want
    nodes, roots = edge_roots(*np.array(links[:40]).T)
    assert dict(zip(nodes.tolist(), roots.tolist(), strict=True)) == {i: 0 for i in range(41)}


@pytest.mark.parametrize("shard", [3, None])
def test_simhash_equals_brute_force(spark, shard, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, sentence(rng, 60), None, "x") for i in range(30)]
    rows += [(100 + i, rows[i % 5][1] + f" tail{i}", 1, None) for i in range(25)]
    rows += [(200, None, 0, ""), (201, "", 0, ""), (202, " \n", 0, ""), (203, "One two", 0, ""), (204, "one TWO", 0, ""), (5, rows[5][1], 0, ""), (300, "long " * 30_000, 0, "")]
    if shard:
        whole = simhash.link_fingerprints
        monkeypatch.setattr(simhash, "link_fingerprints", lambda points, bits: whole(points, bits, shard))
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    prints = {i: plain_fingerprint(t) for i, t, _, _ in rows}
    ids = sorted(prints)
    links = [(a, b) for a in ids for b in ids if a < b and bin(prints[a] ^ prints[b]).count("1") <= 4]
    want = roots_of(ids, links)
    assert got == {(i, f"{prints[i]:016x}", want[i]) for i in ids}
    assert any(want[i] != i for i in ids)


def test_simhash_keeps_one_of_each_class(spark):
    docs = spark.createDataFrame([(3, "a b c d e", 1, "p"), (1, "A b c d e", 2, "q"), (1, "A b c d e", 2, "q"), (None, "a b c d e", 3, "r"), (9, "z", 4, "s")], DOCS)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 1), (False, 9), (True, None)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def brute_links(rows, least):
    links = []
    for i, (a, x, la) in enumerate(rows):
        for b, y, lb in rows[i + 1 :]:
            if la is None or la != lb or x is None or y is None or len(x) != len(y) or any(v is None or not np.isfinite(v) for v in [*x, *y]):
                continue
            x_, y_ = np.array(x, float), np.array(y, float)
            if x_.any() and y_.any() and x_ @ y_ / np.sqrt((x_ @ x_) * (y_ @ y_)) >= least:
                links.append((a, b))
    return links


@pytest.mark.parametrize("cell", [4, 1024])
def test_embedding_links_equal_brute_force(spark, cell, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", cell)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.25, 8)).astype(np.float32).tolist(), i % 2) for i in range(90)]
    rows += [(200 + i, rows[0][1], 0) for i in range(20)] + [(300, [2 * v for v in rows[0][1]], 0)]
    rows += [(400, None, 0), (401, [0.0] * 8, 0), (402, [float("nan")] * 8, 0), (403, [None] + [1.0] * 7, 0), (404, rows[0][1], None), (405, [], 0), (406, [1.0, 2.0], 0), (407, [float("inf")] + [1.0] * 7, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    links = brute_links(rows, 0.93)
    want = roots_of([r[0] for r in rows], links)
    count = {r[0]: sum(r[0] in e for e in links) for r in rows}
    got = embedding_dedup.near_duplicates(df).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(i, count[i], want[i], want[i] == i) for i in want}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_vectors_of_small_labels_are_not_dealt_again(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in rng.normal(size=6)], i % 20) for i in range(3_000)]
    stored = {}
    monkeypatch.setattr(embedding_dedup, "store", lambda df, name: stored.setdefault(name, common.store(df, name)))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_duplicates(df).count() == 3_000
    # a label fits in one cell, so every vector is written once, as wide as it was given
    assert stored["cells"].count() == 3_000
    assert {r[0] for r in stored["cells"].selectExpr("length(vector)").distinct().collect()} == {24}



def test_neighbours_reach_the_recall_and_break_ties_by_id(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    x = (centres[rng.integers(0, 20, 3_000)] + rng.normal(0, 0.5, (3_000, 16))).astype(np.float32)
    x[1000:1200] = x[0]  # two hundred copies of the first query
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5_000, None), (5_050, [0.0] * 16), (5_100, [float("nan")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.nearest(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3_000, 50):
        s = unit @ unit[q]
        s[q] = -2
        best = np.lexsort((np.arange(3_000), -np.round(s, 12)))[:5]
        assert sorted(got[q]) == [1, 2, 3, 4, 5]
        hits += len(set(best) & {v for v, _ in got[q].values()})
        assert all(abs(score - unit[q] @ unit[v]) < 1e-12 for v, score in got[q].values())
    assert len(got) == 60 and hits >= 0.9 * 300
    assert [got[0][k][0] for k in range(1, 6)] == [1000, 1001, 1002, 1003, 1004]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in neighbours.nearest(few, few.where("vec_id = 0")).collect()] == [(0, 1)]
    assert neighbours.nearest(few.limit(0), few.limit(0)).count() == 0


def test_compact_windows_hold_every_run():
    rng = np.random.default_rng(3)
    tokens = rng.integers(0, 40, 60).astype(np.uint64)
    starts, ends = np.array([0, 25, 25]), np.array([25, 25, 60])
    code = passages._mix(tokens + np.uint64(int(passages._ODD))) >> np.uint64(32)
    l, c, r = passages.compact_windows(tokens, starts, ends, 5, 0)
    for s, e in ((0, 25), (25, 60)):
        for i in range(s, e):
            for j in range(i + 4, e):
                least = i + int(np.argmin(code[i : j + 1]))
                assert ((l <= i) & (c == least) & (r >= j)).sum() == 1


def test_passages_are_found_and_clean_documents_are_left_alone(spark):
    rng = np.random.default_rng(4)
    shared, near = sentence(rng, 60), sentence(rng, 80).split()
    changed = near.copy()
    changed[40] = "other"
    rows = [(i, sentence(rng, 200)) for i in range(20)]
    rows += [(100 + i, sentence(rng, 30) + " " + shared.upper() + "\n" + sentence(rng, 30 + i)) for i in range(12)]
    rows += [(200, sentence(rng, 40) + " " + " ".join(near)), (201, " ".join(changed) + " " + sentence(rng, 55))]
    rows += [(300, None), (301, ""), (302, "short text"), (None, shared), (303, sentence(rng, 40) + " " + " ".join(shared.split()[:45]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = passages.near_passages(df).collect()
    assert {r.doc_id for r in got} == {*range(101, 112), 201}
    assert {100, 200} <= {r.of_doc_id for r in got} <= {200, *range(100, 112)} and all(r.of_doc_id < r.doc_id for r in got)
    assert all(r.n_words >= 50 and r.similarity >= 0.8 for r in got)
    assert all(r.start_word <= 32 and r.start_word + r.n_words >= 88 for r in got if r.doc_id < 200)
    cut = {r.doc_id: r.text for r in passages.keep_first(df).collect()}
    assert shared.upper() in cut[100] and not any(shared.upper() in cut[i] for i in range(101, 112))
    assert all(cut[i] == t for i, t in rows[:20]) and len(cut) == len(rows)
    assert passages.near_passages(df.limit(0)).count() == 0


def test_a_passage_goes_on_after_an_inserted_or_deleted_word(spark):
    rng = np.random.default_rng(6)
    base = sentence(rng, 204).split()
    longer, shorter = base[:64] + ["inserted"] + base[64:], base[:64] + base[65:]
    for other in (longer, shorter):
        a, b = (passages.shingle_hashes(" ".join(x).encode()) for x in (other, base))
        parts = passages.trimmed(a, b, 46, 0.8)
        assert [(lo, n) for lo, n, *_ in parts] == [(0, len(a))] and all(p[4] > 0.9 for p in parts)
    rows = [(1, " ".join(base) + " " + sentence(rng, 60)), (2, sentence(rng, 70) + " " + " ".join(longer)), (3, " ".join(shorter) + " " + sentence(rng, 30))]
    got = passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for doc, lo, hi in ((2, 70, 275), (3, 0, 203)):
        places = {w for r in got if r.doc_id == doc and r.of_doc_id == 1 for w in range(r.start_word, r.start_word + r.n_words)}
        assert len(places & set(range(lo, hi))) >= hi - lo - 6


def test_passages_changed_on_one_side_only_are_trimmed_by_the_jaccard_bound():
    x = np.arange(1, 2_001, dtype=np.uint32)
    # 8 words inserted between 40 and 40 matching shingles: 4 broken shingles on one side, 12 on the other, Jaccard 80 / 96
    short, long = np.concatenate([x[:40], x[100:104], x[40:80]]), np.concatenate([x[:40], x[200:212], x[40:80]])
    for a, b in ((short, long), (long, short)):
        assert passages.trimmed(a, b, 46, 0.8) == [(0, len(a), 0, len(b), 80 / 96)]
    # a whole in one run, its halves far apart in b: each half is a repeat of its own
    b = np.concatenate([x[:60], x[300:400], x[60:120]])
    assert sorted(p[:4] for p in passages.trimmed(x[:120], b, 46, 0.8)) == [(0, 60, 0, 60), (60, 60, 160, 60)]
    # misses on both sides: too many for the whole, few enough for a part
    a, b = np.concatenate([x[:60], x[400:413], x[60:80]]), np.concatenate([x[:60], x[500:513], x[60:80]])
    assert passages.trimmed(a, b, 46, 0.8)[0][:4] == (0, 60, 0, 60)


def test_the_older_side_of_a_candidate_holds_an_inserted_tail():
    links = {"doc": [2, 2, 2, 2], "of_doc": [1] * 4, "l": [0, 0, 20, 20], "c": [20, 21, 60, 61], "r": [80] * 4, "of_l": [0, 0, 28, 28], "of_c": [20, 21, 68, 69], "of_r": [90] * 4}
    doc, at, of_doc, of_at, size, of_size = (x.tolist() for x in passages._regions({k: np.array(v) for k, v in links.items()}, 46, 2))
    assert (doc, of_doc) == ([2], [1]) and at[0] == of_at[0] == 0 and size[0] == 81 and of_at[0] + of_size[0] == 89


def test_an_exact_repeat_is_found_beside_an_unrelated_first_document(spark):
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for i in range(0, 120, 3):
        shared = sentence(rng, 60).split()
        # the first holds 48 of the 60 words, too few for a passage
        rows += [(i, sentence(rng, 30) + " " + " ".join(shared[6:54]) + " " + sentence(rng, 30))]
        rows += [(i + k, sentence(rng, 20 + k) + " " + " ".join(shared) + " " + sentence(rng, 30)) for k in (1, 2)]
        want[i + 2] = (i + 1, 22)
    got = {}
    for r in passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault((r.doc_id, r.of_doc_id), set()).update(range(r.start_word, r.start_word + r.n_words))
    assert all(set(range(at, at + 60)) <= got.get((doc, of_doc), set()) for doc, (of_doc, at) in want.items())


def test_equal_runs_share_an_anchor_with_equal_surroundings_hashed_alike():
    rng = np.random.default_rng(9)
    shared = rng.integers(0, 2**63, 120).astype(np.uint64)
    texts = [np.concatenate([rng.integers(0, 2**63, n).astype(np.uint64), shared, rng.integers(0, 2**63, 30).astype(np.uint64)]) for n in (3, 77)]
    (at, key, around), (of_at, of_key, of_around) = (passages.anchors(t, 46) for t in texts)
    least = passages.ANCHOR + passages.AMONG - 1
    same = {(a, o) for a, k in zip(at.tolist(), key, strict=True) for o, f in zip(of_at.tolist(), of_key, strict=True) if k == f}
    assert all(any(s <= a - 3 == o - 77 and a - 3 + passages.ANCHOR <= s + least for a, o in same) for s in range(len(shared) - least + 1))
    whole = {k: h for a, k, h in zip(at, key, around, strict=True) if 49 <= a <= 3 + 120 - 46 - passages.ANCHOR}
    of_whole = dict(zip(of_key, of_around, strict=True))
    assert whole and all(of_whole[k] == h for k, h in whole.items())
    assert len(set(around.tolist())) == len(around)
    # a repeated word keeps few anchors
    assert len(passages.anchors(np.full(10_000, 7, np.uint64), 46)[0]) < 10_000 / 50


def test_a_near_repeat_is_found_whatever_the_windows_and_their_first_documents(spark):
    rng = np.random.default_rng(10)

    def changed(words, places):
        return [f"x{i}" if i in places else w for i, w in enumerate(words)]

    rows, want = [], {}
    for i in range(0, 480, 4):
        shared = sentence(rng, 140).split()
        # earlier documents hold 48 words of it each, too few for a passage, and so are first for the windows' keys
        rows += [(1_000 + i, " ".join(shared[2:50]) + " " + sentence(rng, 30) + " " + " ".join(shared[50:98]))]
        rows += [(1_001 + i, " ".join(shared[90:138]) + " " + sentence(rng, 30))]
        # three words changed: 121 of 151 shingles are common, a Jaccard similarity of 0.801
        rows += [(1_002 + i, sentence(rng, 20) + " " + " ".join(shared)), (1_003 + i, sentence(rng, 25) + " " + " ".join(changed(shared, {35, 70, 105})))]
        want[1_003 + i] = 1_002 + i
    got = {}
    for r in passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault((r.doc_id, r.of_doc_id), set()).update(range(r.start_word, r.start_word + r.n_words))
    lost = [doc for doc, of_doc in want.items() if len(got.get((doc, of_doc), set()) & set(range(25, 165))) < 130]
    assert not lost


def test_windows_are_linked_whatever_the_batches():
    rng = np.random.default_rng(5)
    words = [" ".join(f"w{n}" for n in rng.integers(0, 9_000, 120)) for _ in range(3)]
    texts = [(words[i % 3] + f" z{i}").encode() for i in range(12)]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(12)), pa.array(texts, pa.binary())], ["doc", "text"])
    run = passages._windows(46)
    whole = pa.Table.from_batches(run(iter([batch]))).to_pylist()
    assert pa.Table.from_batches(run(iter([batch.slice(at, 2) for at in range(0, 12, 2)]))).to_pylist() == whole


def test_pairs_that_share_little_are_rejected_before_they_are_aligned(monkeypatch):
    rng = np.random.default_rng(11)
    a, b = (rng.integers(0, 1 << 32, 320, dtype=np.uint32) for _ in range(2))
    b[100:160] = a[120:180]
    assert [p[:4] for p in passages.trimmed(a, b, 46, 0.8)] == [(120, 60, 100, 60)]
    b[130:160] = rng.integers(0, 1 << 32, 30, dtype=np.uint32)
    monkeypatch.setattr(passages, "_best_parts", None)
    assert passages.trimmed(a, b, 46, 0.8) == []
