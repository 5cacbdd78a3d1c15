"""Language, toxicity, language model and licenses on small tables, with the awkward rows."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pairlab.llm import common, language, licenses, lm, toxicity

EN, DE = "the quick brown fox jumps over the lazy dog and the cat", "der schnelle braune fuchs springt über den faulen hund und die katze"


def test_gram_counts_equal_a_plain_count():
    for text in (EN, "Ab  a1b!", "ß É", "x", "a" * 5, "1234 ..", "", None):
        words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        line = "_" + "_".join(words) + "_"
        want = Counter(c for c in line if c != "_") + Counter(g for n in (2, 3) for g in (line[i : i + n] for i in range(len(line) - n + 1)))
        codes, counts = language.gram_counts(None if text is None else text.encode())
        name = lambda c: "".join(chr(c >> s & 0x1FFFFF) for s in (42, 21, 0) if c >> s & 0x1FFFFF)
        assert {name(int(c)): int(n) for c, n in zip(codes, counts, strict=True)} == (dict(want) if words else {})


def test_long_texts_are_counted_in_parts_alike(monkeypatch):
    text = (EN + " " + DE + "  !! ").encode() * 40
    whole = language.gram_counts(text)
    monkeypatch.setattr(language, "STEP", 97)
    parts = language.gram_counts(text)
    assert (whole[0] == parts[0]).all()
    assert abs(whole[1] - parts[1]).max() <= 1  # an edge where two parts meet at a run of marks


def test_languages_are_told_apart(spark):
    rows = [(1, EN, "en", 0.5), (2, DE, "de", None), (3, EN, None, 1.0), (4, None, "en", 1.0), (5, "123 ...", "de", 1.0), (None, DE, "de", 0.0), (1, EN, "en", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    known = language.profiles(docs)
    assert set(known) == {"en", "de"}
    got = [(r.doc_id, r.lang_pred) for r in language.identify(docs, known).collect()]
    assert sorted(got, key=str) == sorted([(1, "en"), (1, "en"), (2, "de"), (3, "en"), (4, "und"), (5, "und"), (None, "de")], key=str)
    assert {r.lang_pred for r in language.identify(docs, {}).collect()} == {"und"}
    assert language.profiles(docs.limit(0)) == {} and language.identify(docs.limit(0), known).count() == 0


def toxic_rows(n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = [f"w{x}" for x in rng.integers(0, 300, rng.integers(5, 80))]
        bad = i % 4 == 0
        for _ in range(3 * bad):
            words.insert(int(rng.integers(0, len(words))), ("idiot", "Scum,", "trash.")[int(rng.integers(0, 3))])
        rows.append((i, " ".join(words), "en" if i % 3 else None, int(bad)))
    return rows


def test_toxicity_generalises_to_held_out_texts(spark):
    rows = toxic_rows(800, 0)
    docs = spark.createDataFrame([(a, b, c) for a, b, c, _ in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(a, d) for a, _, _, d in rows if a < 600] + [(7, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.predict(docs, model).collect()}
    held = [(got[a].predicted, d) for a, _, _, d in rows if a >= 600]
    assert sum(p == d for p, d in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    odd = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "", "x"), (None, "idiot " * 50_000, "x")], "doc_id long, text string, score string")
    odd = toxicity.predict(odd, model).collect()
    assert len(odd) == 4 and len({r.score for r in odd if r.doc_id}) == 1 and next(r.predicted for r in odd if r.doc_id is None) == 1


def test_toxicity_learns_from_every_labelled_text(spark):
    rows = toxic_rows(900, 3)
    docs = spark.createDataFrame([(a, b, c) for a, b, c, _ in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(a, d) for a, _, _, d in rows if a < 600], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, fit_rows=200)  # three shards of the 600 texts, of which 200 were once sampled
    own = [r for r in rows if r[0] < 600]
    whole = toxicity.train([r[1].encode() for r in own], [r[3] for r in own], [r[2] for r in own])
    assert np.array_equal(model.arrays["tongue"], whole.arrays["tongue"])
    assert ((model.arrays["emb"] != 0).any(axis=1) >= (whole.arrays["emb"] != 0).any(axis=1)).mean() > 0.99
    again = toxicity.fit(docs.repartition(5), labels.repartition(3), fit_rows=200)
    assert all(np.array_equal(a, again.arrays[n]) for n, a in model.arrays.items())
    got = {r.doc_id: r.predicted for r in toxicity.predict(docs, model).collect()}
    held = [(got[a], d) for a, _, _, d in rows if a >= 600]
    assert sum(p == d for p, d in held) >= 0.9 * len(held)
    # one kind of label gives the base rate, as in one task
    clean = toxicity.fit(docs, labels.withColumn("toxic", F.lit(0)), fit_rows=200)
    assert {r.predicted for r in toxicity.predict(docs, clean).collect()} == {0}


def test_toxicity_without_labels_of_both_kinds(spark):
    docs = spark.createDataFrame([(1, "a b", "en"), (2, "c", None)], "doc_id long, text string, lang string")
    for rows in ([], [(1, 0), (2, 0)]):
        model = toxicity.fit(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert {r.predicted for r in toxicity.predict(docs, model).collect()} == {0}
    assert toxicity.predict(docs.limit(0), model).count() == 0


def test_language_model_base_is_exact_and_probabilities_sum_to_one(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(("the cat", "a dog", "the dog", "a cat")[int(x)] + (" sat.", " ran.")[int(x) % 2] for x in rng.integers(0, 4, 30))) for i in range(80)]
    rows += [(200, None), (201, ""), (None, "The unseen"), (3, rows[3][1]), (202, "Word " * 3_000)]
    docs = spark.createDataFrame([(a, b, 1.0) for a, b in rows], "doc_id long, text string, score double")
    got = lm.score_texts(docs, "doc_id % 5 = 2").collect()
    train = [t for i, t in rows if i is None or i % 5 != 2]
    count = Counter(w for t in train for w in (t or "").encode().lower().split())
    tokens, distinct = sum(count.values()) + len(train), len(count) + 1
    want = []
    for i, t in rows:
        words = (t or "").encode().lower().split()
        base = sum(math.log10((c + 1) / (tokens + distinct + 1)) for c in [*(count[w] for w in words), len(train)])
        want.append((str(i), i is not None and i % 5 == 2, len(words) + 1, sum(count[w] > 0 for w in words) + 1, tokens, round(base, 6)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    regular = [r for r in got if r.held_out and r.doc_id < 100]
    assert sum(r.score for r in regular) > sum(r.base_score for r in regular)
    assert lm.score_texts(docs.limit(0), "false").count() == 0


def test_language_model_learns_from_every_training_document(spark):
    rng = np.random.default_rng(11)
    # 1,900 texts, more than the 1,500 that were once sampled; each has a number of its own
    rows = [(i, " ".join(["the cat", "a dog"][int(x)] for x in rng.integers(0, 2, 4)) + f" {i}") for i in range(1_900)]
    docs = spark.createDataFrame([(i, t.encode()) for i, t in rows], "doc_id long, text binary").selectExpr("doc_id", "false as fold", "text")
    encoded = docs.mapInArrow(lm._encoded(lm.VOCABULARY), "doc_id long, fold boolean, text binary, ids binary")
    for shard in (4_000, 1 << 20):
        model = lm._unpack(lm.learned(encoded, shard))
        ids = {int(i) for found in lm.encoder().encode([t.encode() for _, t in rows]) for i in np.frombuffer(found, "<u4")}
        fresh = lm.Attention.fresh(len(ids) + 3, int(model["classes"].max()) + 1).a["E"]
        number = model["number"][sorted(ids)]
        assert len(model["E"]) == len(ids) + 3 and number.max() < len(ids) + 2
        assert (model["E"][number] != fresh[number]).any(axis=1).all()
    again = lm._unpack(lm.learned(encoded.repartition(3), 4_000))
    first = lm._unpack(lm.learned(encoded, 4_000))
    assert all(np.array_equal(first[k], again[k]) for k in first)
    got = lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id % 5 = 2", shard=4_000).where("held_out").collect()
    assert len(got) == 380 and all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_ids_are_counted_a_few_rows_at_a_time_without_the_encoder(monkeypatch):
    rng = np.random.default_rng(3)
    rows = [rng.integers(0, 300, n).astype("<u2") for n in (5, 0, 9, 1, 40, 3, 7)]
    batch = pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary())], ["ids"])
    chain = lm._chain(rows)
    count = np.bincount(chain, minlength=lm.IDS)
    _, number, common = lm._numbered(count)
    wanted = np.bincount(lm._neighbours(chain, number, common))
    sizes, whole = [], lm._chain
    monkeypatch.setattr(lm, "AT_ONCE", 2)
    monkeypatch.setattr(lm, "_chain", lambda part: sizes.append(len(part)) or whole(part))
    for step in (lm._id_counts, lm._neighbour_counts(count)):
        lm.worker_cache("encoder", list)
        found = pa.Table.from_batches(list(step(iter([batch]))))
        expected = count if "id" in found.column_names else wanted
        assert found.column("n").to_pylist() == expected[expected > 0].tolist()
        assert found.column(0).to_pylist() == np.flatnonzero(expected).tolist()
        # what encoding left in the worker went
        assert lm.worker_cache("encoder", dict) == {}
    assert max(sizes) <= 2


def test_words_and_pairs_are_handed_on_while_they_are_counted(monkeypatch):
    texts = [b"a b a", b"", None, b"c a", b"b b c d"]
    ids = [np.arange(n, dtype="<u2") for n in (3, 0, 0, 2, 4)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array([i.tobytes() for i in ids], pa.binary())], ["text", "ids"])
    model = lm._pack(groups=np.arange(lm.IDS) % lm.GROUPS)
    taken, whole = [], lm._sequences
    monkeypatch.setattr(lm, "AT_ONCE", 2)
    monkeypatch.setattr(lm, "TOGETHER", 0)
    monkeypatch.setattr(lm, "_sequences", lambda part: taken.append(part.num_rows) or whole(part))
    step = lm._count(model)(iter([batch]))
    first = next(step)
    # the first pairs leave before the rest of the batch is read
    assert sum(taken) == 2 and first.column("code").null_count == 0
    rows = pa.Table.from_batches([first, *step])
    words, pairs = Counter(), Counter()
    for row in rows.to_pylist():
        if row["word"] is None:
            pairs[row["code"]] += row["n"]
        else:
            words[row["word"]] += row["n"]
    assert words == Counter(b" ".join(t or b"" for t in texts).split())
    groups = np.arange(lm.IDS) % lm.GROUPS
    assert pairs == Counter(int(groups[a]) * lm.IDS + int(b) for i in ids for a, b in zip([lm.BEGIN, *i], [*i, lm.END], strict=True))
    assert max(taken) <= 2


def test_next_id_probabilities_sum_to_one():
    texts = [b"the cat sat. the dog ran."] * 20
    model = lm.train(texts)
    ids = np.frombuffer(next(lm.encoder().encode(texts[:1])), "<u4").astype(np.int64)
    with np.load(lm.io.BytesIO(model)) as held:
        groups = held["groups"]
    code, n = np.unique(groups[np.concatenate([[lm.BEGIN], ids])] * lm.IDS + np.append(ids, lm.END), return_counts=True)
    order = np.argsort(code)
    scorer = lm.Scorer(model, code[order].astype(np.int32), n[order].astype(np.float32))
    scorer_of = lambda s: scorer.scores([np.array(s, np.int64)])[0]
    inputs, there, _, _ = lm.windows([ids[:2]])
    total = 0.0
    for k in range(scorer.classes.max() + 1):
        log = scorer.model.log_targets(scorer.number[inputs], there, np.full(lm.STEP, k))[2]
        inside = np.flatnonzero(scorer.classes == k)
        group = np.full(len(inside), groups[ids[1]], np.int64)
        total += math.exp(log) * np.exp(scorer.within_class(group, inside, np.full(len(inside), k))).sum()
    assert abs(total - 1) < 1e-3
    # a long text is read in several windows, each id scored once
    assert scorer_of(np.tile(ids, 10)) < scorer_of(ids) < 0


def test_licenses_are_stated_inherited_and_absent(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/x.py", "code\nmore code"), ("a/b/c/COPYING.txt", "intro\nThis work is licensed under the GNU General Public License, version 3."),
        ("a/b/c/y.py", "nothing"), ("a/b/c/z.py", "# licensed under the apache license, version 2.0"), ("q/n.py", "the work of the public"), ("top", None), (None, ""), ("a/b/x.py", "code\nmore code"),
    ]
    files = spark.createDataFrame([(i, p, t, "clash") for i, (p, t) in enumerate(rows)], "id long, path string, text string, license string")
    got = {r.file: (r.license, r.basis, r.license_dir) for r in licenses.scan(files, "id", "path", "text").collect()}
    assert got == {
        0: ("MIT", "own", None), 1: ("MIT", "inherited", "a"), 2: ("GPL-3.0", "own", None), 3: ("GPL-3.0", "inherited", "a/b/c"), 4: ("Apache-2.0", "own", None),
        5: (None, "none", None), 6: (None, "none", None), 7: (None, "none", None), 8: ("MIT", "inherited", "a"),
    }
    assert licenses.scan(files.limit(0), "id", "path", "text").count() == 0


def test_license_prefilter_loses_nothing():
    weights = {"a": 0.8, "b": 0.5, "c": 0.3, "d": 0.14}
    norm = math.sqrt(sum(v * v for v in weights.values()))
    weights = {w: v / norm for w, v in weights.items()}
    needed = licenses.needed_words(weights, 0.7)
    assert math.sqrt(sum(v * v for w, v in weights.items() if w not in needed)) < 0.7


def test_stored_steps_hand_small_batches_to_workers_and_back(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], ["size", "n"])

    before = spark.conf.get(common.BATCH_CONF)
    rows = spark.range(0, 3_000, 1, 1).select(F.expr("repeat('x', 4000)").alias("text"))
    got = common.store(rows.mapInArrow(common.tidy(sizes), "size long, n long"), "sizes").collect()
    assert sum(r.n for r in got) == 3_000 and max(r["size"] for r in got) < common.BATCH_BYTES + 10_000
    assert spark.conf.get(common.BATCH_CONF) == before
