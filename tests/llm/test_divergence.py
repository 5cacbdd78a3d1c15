"""Source divergence against exact arithmetic over plain counters."""

import random
import re
from collections import Counter, defaultdict

from pairlab.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, lang string, source string"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain(rows, least, top=50):
    docs = [(lang or "", source or "", Counter(lowered(t) for t in TERM.findall(text or ""))) for _, text, lang, source in rows]
    of_group, of_lang, having = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        for counter in (of_group[lang, source], of_lang[lang]):
            counter.update(terms)
        having[lang].update(terms.keys())
    kept = {lang: [t for t, n in seen.items() if n >= least] for lang, seen in having.items()}

    def shares(lang, counter):
        total, v = sum(counter[t] for t in kept[lang]), len(kept[lang])
        return {t: 1 + 10**9 * (counter[t] + 5) // (total + 5 * v) for t in kept[lang]}

    out = []
    for (lang, source), counter in of_group.items():
        p, q = shares(lang, counter), shares(lang, of_lang[lang])
        far = [(o, sum(abs(p[t] - x) for t, x in shares(lang, c).items())) for (other, o), c in of_group.items() if other == lang and o != source]
        own = [(t, p[t] - q[t]) for t in kept[lang] if counter[t] and p[t] > q[t]]
        for part, items, most in (("pair", far, None), ("term", own, top)):
            ranked = sorted(items, key=lambda i: (-i[1], i[0].encode()))
            out += [(lang, source, part, item, value, r) for r, (item, value) in enumerate(ranked, 1) if most is None or r <= most]
    return sorted(out)


def rows_of(seed, n, sources):
    rng = random.Random(seed)
    words = ["a", "The", "THE", "ﬂ", "straße", "İ", "x1y", "né", "don't", "\x7f", "_", "日本", "z"]
    return [
        (i, None if i % 11 == 0 else " ".join(rng.choices(words, k=rng.randint(0, 9))), rng.choice(["en", "de", None, "rare"][: 3 + (i % 40 == 0)]), rng.choice(sources))
        for i in range(n)
    ]


def test_audit_equals_exact_arithmetic(spark):
    rows = rows_of(1, 150, ["s1", "s10", "s2", None, "", "ß"])
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA), least=8)
    assert [f.dataType.simpleString() for f in got.schema] == ["string", "string", "string", "string", "bigint", "int"]
    assert sorted(map(tuple, got.collect())) == plain(rows, 8)


def test_blocks_and_task_sums_do_not_change_results(spark):
    rows = rows_of(2, 150, ["s1", "s10", "s2", None, "ß"])
    docs = spark.createDataFrame(rows, SCHEMA)
    counts = divergence.term_counts(docs, least=8, most_held=7)
    sizes = divergence.group_sizes(docs, counts)
    want = sorted((lang, min(s, i), max(s, i), v) for lang, s, part, i, v, _ in plain(rows, 8) if part == "pair" and s < i)
    for terms, sources in ((2, 256), (3, 2), (1, 1)):
        got = divergence.source_pairs(counts, sizes, terms, sources)
        assert sorted(map(tuple, got.collect())) == want


def test_fewer_terms_are_returned_and_ties_go_by_item(spark):
    rows = [(i, "a b c d é", "en", "x") for i in range(5)] + [(9, "q", "en", "y")] + [(10 + i, "q", "en", "y") for i in range(5)]
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA), least=3, top=2)
    assert sorted(map(tuple, got.collect())) == plain(rows, 3, 2)


def test_awkward_rows(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, None, None, None), (1, "", None, "s"), (1, "Word " * 40_000, "en", "s"), (1, "Word " * 40_000, "en", "s"), (2, "!!", "en", "t")]
    df = spark.createDataFrame([(*r, 1, 2, "c") for r in rows], SCHEMA + ", n int, place long, term string")
    assert sorted(map(tuple, divergence.audit(df, least=2).collect())) == plain(rows, 2)
    # nothing is kept: groups are compared, at distance 0
    assert {r.value for r in divergence.audit(df).collect()} == {0}
