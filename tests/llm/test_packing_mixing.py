"""Packing and mixing: exact round trips, bounds, targets, and the pipeline's stages."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from pairlab.llm import mixing, packing, tokens
from pairlab.llm.tokens import encoder

ODD = ["Ünï.. it's don't's a|b", "ΑΣ Σ. é, É! İx 12ab 3.14", "<|endoftext|> x y é ½ ß ẞ \x1c!a ..., |||", "", " \n", "a" * 3000, "日本語 text，混ぜ", "naïve.naïve! (x) [y]"]


def test_chunks_encode_like_whole_texts():
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for text, got in zip(ODD, encoder().encode([t.encode() for t in ODD]), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(4))
def test_plans_place_every_piece_once_and_without_gaps(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(4, 1, (5, 300, 3000, 40)[seed]).astype(int), 1, 256)
    counts = np.bincount(lengths, minlength=257)
    runs = packing.best_plan(counts, 256)
    used, places = defaultdict(set), defaultdict(list)
    for length, at, end, each, first, offset in runs.rows:
        for k in range(at, end):
            assert k not in used[length]
            used[length].add(k)
            places[first + (k - at) // each].append((offset + (k - at) % each * length, length))
    assert {n: len(k) for n, k in used.items()} == {n: c for n, c in enumerate(counts.tolist()) if c}
    assert len(places) == runs.next
    for rows in places.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 256
    best_fit = packing._Runs(256)
    for n in range(256, 0, -1):
        best_fit.best_fit(n, 0, int(counts[n])) if counts[n] else None
    assert runs.next <= best_fit.next + 1


def test_no_pieces_make_no_plan():
    assert packing.best_plan(np.zeros(65, np.int64), 64).rows == []


def test_packing_is_a_round_trip(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 99, int(n)))) for i, n in enumerate(rng.integers(1, 60, 50))]
    rows += [(100, None), (101, ""), (102, "long " * 500), (102, "long " * 500), (None, "x y")] + [(200 + i, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame([(a, b, "clash") for a, b in rows], "doc_id long, text string, length string")
    got = packing.pack(docs, capacity=64, with_ids=True).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, text in rows:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            want[(i, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for some in places.values():
        assert [o for o, _ in sorted(some)] == [0, *np.cumsum([n for _, n in sorted(some)])[:-1].tolist()]
        assert sum(n for _, n in some) <= 64
    assert packing.pack(docs.limit(0)).count() == 0


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, target = float(sum(sizes.values())), set(order), {}
    while True:
        share = left / (sum(weight[s] for s in open_) or 1)
        over = {s for s in open_ if weight[s] * share > most * sizes[s]}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
        if not over:
            return target | {s: weight[s] * share for s in open_}


def test_mixing_meets_its_targets(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(n)), ("b", "a", None, "hot", "hot", "hot", "tiny")[i % 7] if i % 70 else "tiny") for i, n in enumerate(rng.integers(0, 400, 700))]
    rows = [(i, t if s != "tiny" else "one two three four", s) for i, t, s in rows]
    rows += [(900, None, "a"), (900, None, "a"), (901, "", "empty"), (None, "x y z", "b"), (902, "long " * 20_000, "b"), (3, rows[3][1], rows[3][2])]
    docs = spark.createDataFrame([(a, b, c, "clash") for a, b, c in rows], "doc_id long, text string, source string, taken string")
    got = mixing.mix(docs, block_words=16).collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r["size"] for r in got)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want, names = plain_targets(sizes), {i: s for i, _, s in rows if i is not None}
    taken = Counter()
    for r in got:
        s = names.get(r.doc_id, "b")
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        taken[s] += r.taken
    for s, target in want.items():
        assert abs(taken[s] - target) <= 0.02 * target + 48
    again = mixing.mix(docs.repartition(5), block_words=16).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_permutations_are_permutations(spark):
    for n in (1, 2, 7, 100):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(9)).alias("p"))
        assert sorted(r.p for r in df.collect()) == list(range(n))


def test_mixed_documents_hold_the_taken_words(spark):
    rows = [(i, "\n".join(f"d{i}w{k}  x" for k in range(30)), "ab"[i % 2]) for i in range(40)] + [(99, None, "a"), (98, " ", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed, taken = mixing.mixed_documents(docs, block_words=8), mixing.mix(docs, block_words=8)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
    own = {i: (t or "").split() for i, t, _ in rows}
    assert sum(words.values()) > 0 and all(words[i] <= 3 * len(own[i]) for i in own)
    assert abs(sum(words.values()) - taken.agg(F.sum("taken")).first()[0]) <= 64


def test_pipeline_runs_stage_by_stage(spark):
    sf = contract.SMOKE_DIR
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "passages", "mixing", "packing"]
    odd = spark.createDataFrame([(10_000, None, None, None, None), (10_001, "", "en", "src1", 0), (None, "idiot", "en", "src1", 5)], docs.schema)
    stage_docs = docs.unionByName(odd)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        stage_docs = corpus_pipeline.store(stage(spark, stage_docs, sf), "test")
        assert stage_docs.columns == columns
        assert stage_docs.count() > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, stage_docs, sf)
    assert packed.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048


def test_empty_documents_pass_the_pipeline(spark):
    docs = spark.read.parquet(f"{contract.SMOKE_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.store(stage(spark, docs, contract.SMOKE_DIR), "empty")
        assert docs.count() == 0


def test_small_sources_reach_their_targets(spark):
    # sources of a few words: blocks are as short as the source needs
    rows = [(i, f"s{i:02}", " ".join(["w"] * n)) for i, n in enumerate([10] * 40 + [65] * 20 + [4_000] * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.max("target").alias("target"), F.sum("taken").alias("taken"), F.max("source_size").alias("size")).collect()
    assert all(abs(r.taken - r.target) <= max(2, 0.04 * r.target) for r in got), [(r.size, r.target, r.taken) for r in got]
    assert all(r.taken <= 3 * r.size for r in got)


def test_special_tokens_in_a_text_are_those_tokens():
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|><|startoftext|>", "x<|endoftext|>y Z", "<|endoftext", "plain, text"]
    for text, got in zip(texts, encoder().encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_forms_of_a_word_are_learned_once(monkeypatch):
    monkeypatch.setattr(tokens, "TOGETHER", 40)
    texts = ["word Word WORD, word. word!!", "Élan élan, ÉLAN", "word, İst Kelvin x1 \xe9lan", "", "||", "Word <|endoftext|> word"] * 3
    for cached in (tokens.CACHED, 2):
        monkeypatch.setattr(tokens, "CACHED", cached)
        held = tokens.ChunkEncoder(tokens.VOCABULARY)
        vocabulary, merged, known = held._tokenizer, [], held._merged
        monkeypatch.setattr(held, "_merged", lambda words, merged=merged, known=known: merged.extend(words) or known(words))
        found = list(held.encode([t.encode() for t in texts] + [None]))
        assert found == [np.array(vocabulary.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts] + [b""]
        if cached > 2:
            assert sorted(merged) == ["word", "élan"]
