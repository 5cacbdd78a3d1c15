"""Source divergence audit: how far the term distributions of a language's sources lie apart.

1. A translate table lowers A-Z and turns every separator byte into a blank in
   one pass over a text's UTF-8 bytes; ``bytes.split`` gives its terms and one
   Counter per document their numbers.  A task sums them per (lang, source)
   and hands the sums on whenever ``HELD`` entries are held.
2. One shuffle on (lang, term) sums occurrences and documents, and keeps the
   terms that enough documents of the language have.
3. Only counts above zero are stored.  A term that a source lacks has the same
   p for all such terms, so blocks of terms x blocks of sources fill them in:
   sum |p - q| = sum over the block's terms - terms |p0 - q0|, and V |p0 - q0|
   once, with p0 and q0 the values of count 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.llm.common import store

LEAST_DOCS = 30
TOP_TERMS = 50
HELD = 200_000
TERM_BLOCK, SOURCE_BLOCK = 2_048, 256
SCALE, SMOOTH = 1_000_000_000, 5

# ASCII letters become small letters, bytes of other letters stay, every other byte becomes a blank
LETTERS = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalpha() else 0x20 for b in range(256))


def document_terms(text: bytes) -> Counter:
    """How often each term occurs in a text."""
    return Counter(text.translate(LETTERS).split())


def _sums(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def emptied() -> Iterator[pa.RecordBatch]:
        for (lang, source), (times, docs) in held.items():
            if times:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(times)), pa.array([source] * len(times)),
                        pa.array(list(times), pa.binary()).cast(pa.string()),
                        pa.array(list(times.values()), pa.int64()), pa.array([docs[t] for t in times], pa.int64()),
                    ],
                    ["lang", "source", "term", "n", "docs"],
                )
        held.clear()

    size = 0
    for batch in batches:
        langs, sources, texts = (batch.column(i) for i in range(3))
        for lang, source, text in zip(langs.to_pylist(), sources.to_pylist(), texts, strict=True):
            times, docs = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(times)
            one = document_terms(text.as_py())
            times.update(one)
            docs.update(one.keys())
            size += len(times)
            if size > most:
                yield from emptied()
                size = 0
    yield from emptied()


def _named(docs: DataFrame, lang: str, source: str, *more: Column) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source"), *more)


def term_counts(
    docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST_DOCS, most_held: int = HELD
) -> DataFrame:
    """(lang, source, term, n, lang_n, leader): counts above zero of the terms in at least ``least`` documents of their language.

    ``lang_n`` is the term's number in the whole language; ``leader`` marks one row per (lang, term).
    Null texts, languages and sources are empty strings; every row is a document, also a repeated one.
    """
    rows = _named(docs, lang, source, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    sums = rows.mapInArrow(lambda batches: _sums(batches, most_held), "lang string, source string, term string, n long, docs long")
    # dealt by (lang, term), one shuffle serves the sums per source and those over all sources
    each = sums.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    everywhere = Window.partitionBy("lang", "term")
    known = each.select(
        "lang", "source", "term", "n",
        F.sum("n").over(everywhere).alias("lang_n"),
        F.sum("docs").over(everywhere).alias("lang_docs"),
        (F.min("source").over(everywhere) == F.col("source")).alias("leader"),
    )
    return known.where(F.col("lang_docs") >= least).drop("lang_docs")


def _share(count: str, total: str) -> Column:
    """1 + floor(SCALE (count + SMOOTH) / (total + SMOOTH V)) without rounding or overflow."""
    return F.expr(
        f"1L + (cast({count} + {SMOOTH} as decimal(20, 0)) * cast({SCALE} as decimal(10, 0))) div cast({total} + {SMOOTH} * v as decimal(20, 0))"
    )


def group_sizes(docs: DataFrame, counts: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, total, lang_total, v, p0, place): a row per occurring group; ``p0`` is the p of count 0."""
    per_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    per_lang = counts.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("leader").alias("v"))
    groups = _named(docs, lang, source).distinct()
    sizes = groups.join(per_group, ["lang", "source"], "left").join(per_lang, "lang", "left").fillna(0)
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    return sizes.select("*", F.when(F.col("v") > 0, _share("0", "total")).otherwise(0).alias("p0"), number.alias("place"))


def _distances(block: pd.DataFrame) -> pd.DataFrame:
    """Sums of |p - q| over the block's terms, for every pair of sources that belongs to the block."""
    own = block.drop_duplicates("place").sort_values("place")
    places, names, zero = own["place"].to_numpy(), own["source"].to_numpy(object), own["p0"].to_numpy(np.int64)
    known = block[block["term"].notna()]
    term, terms = pd.factorize(known["term"])
    shares = np.repeat(zero[:, None], len(terms), axis=1)
    shares[np.searchsorted(places, known["place"].to_numpy()), term] = known["p"].to_numpy(np.int64)
    # the first block of terms answers for all kept terms, every block takes its own back
    rest = (int(own["v"].iloc[0]) if block["part"].iloc[0] == 0 else 0) - len(terms)
    low, high = block["low"].iloc[0], block["high"].iloc[0]
    of = own["own"].to_numpy()
    lefts, rights, values = [], [], []
    for i in np.flatnonzero(of == low):
        other = np.flatnonzero((of == high) & (places > places[i]))
        away = np.abs(shares[other] - shares[i]).sum(axis=1) + rest * np.abs(zero[other] - zero[i])
        lefts += [names[i]] * len(other)
        rights += names[other].tolist()
        values += away.tolist()
    return pd.DataFrame({"lang": [own["lang"].iloc[0]] * len(values), "a": lefts, "b": rights, "value": values}, dtype=object)


def source_pairs(counts: DataFrame, sizes: DataFrame, term_block: int = TERM_BLOCK, source_block: int = SOURCE_BLOCK) -> DataFrame:
    """(lang, a, b, value): the distance of every two sources of a language, a before b."""
    parts = F.greatest(F.lit(1), F.expr(f"(v + {term_block - 1}) div {term_block}"))
    last = F.max("place").over(Window.partitionBy("lang"))
    groups = sizes.select(
        "*", parts.alias("parts"), F.expr(f"place div {source_block}").alias("own"), F.floor(last / source_block).alias("last")
    )
    keep = ["lang", "source", "place", "v", "p0", "own", "last"]
    known = counts.join(groups, ["lang", "source"]).select(
        *keep, F.pmod(F.xxhash64("term"), "parts").alias("part"), "term", _share("n", "total").alias("p")
    )
    # a row without a term makes every source known to every block of terms
    present = groups.select(
        *keep, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
        F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("p"),
    )
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("other")
    dealt = known.unionByName(present).select("*", other)
    dealt = dealt.select("lang", "source", "place", "v", "p0", "own", "part", "term", "p", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    blocks = dealt.groupBy("lang", "part", "low", "high").applyInPandas(_distances, "lang string, a string, b string, value long")
    return blocks.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(
    docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text",
    least: int = LEAST_DOCS, top: int = TOP_TERMS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): per group its distance to the language's other sources and its own terms.

    Part ``pair``: every other source of the language by distance, the
    farthest first.  Part ``term``: the ``top`` terms whose share in the
    group exceeds the language's share most.  Ties go by item.  A language
    without kept terms has distances 0; a language of one source has no
    pair; empty tables give no rows; columns beyond the three are not read.
    """
    counts = store(term_counts(docs, lang, source, text, least), "term-counts")
    sizes = store(group_sizes(docs, counts, lang, source), "group-sizes")
    pairs = source_pairs(counts, sizes)
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    far = pairs.select("lang", "value", both.alias("of")).select("lang", "of.source", F.lit("pair").alias("part"), "of.item", "value")
    own = (
        counts.join(sizes, ["lang", "source"])
        .select("lang", "source", F.col("term").alias("item"), _share("n", "total").alias("p"), _share("lang_n", "lang_total").alias("q"))
        .where("p > q")
        .select("lang", "source", F.lit("term").alias("part"), "item", (F.col("p") - F.col("q")).alias("value"))
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).alias("rank")
    return far.select("*", rank).unionByName(own.select("*", rank).where(F.col("rank") <= top))
