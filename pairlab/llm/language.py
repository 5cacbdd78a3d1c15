"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent n-grams (1 to 3 characters of words,
with word edges) in order.  A text goes to the language whose profile lies
least out of place: the sum over the text's n-grams of the difference of
ranks, an absent n-gram counting as the profile's length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm.common import store

PROFILE = 400
UNKNOWN = "und"
EDGE = ord("_")
STEP = 1 << 20  # characters counted at once


def _letter_table() -> np.ndarray:
    """Code point -> code point if it is a letter, else the edge mark."""
    table = np.full(0x110000, EDGE, np.uint64)
    for cp in range(0x110000):
        if chr(cp).isalpha():
            table[cp] = cp
    return table


_TABLE: list[np.ndarray] = []


def gram_counts(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of a text, ascending, and how often each occurs; none without a letter.

    Text is lower-cased, every run of other characters is one word edge, and
    an n-gram of edges alone does not count.
    """
    if not text:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    if not _TABLE:
        _TABLE.append(_letter_table())
    cps = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    found: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    for at in range(0, len(cps), STEP):
        marks = _TABLE[0][cps[max(0, at - 2) : at + STEP]]
        new = np.ones(len(marks), bool)
        new[: min(at, 2)] = False
        edge = np.uint64(EDGE)
        if at == 0:
            marks, new = np.concatenate([[edge], marks]), np.concatenate([[True], new])
        if at + STEP >= len(cps):
            marks, new = np.append(marks, edge), np.append(new, True)
        keep = np.ones(len(marks), bool)
        keep[1:] = (marks[1:] != edge) | (marks[:-1] != edge)
        marks, new = marks[keep], new[keep]
        one = marks[new & (marks != edge)]
        two = (marks[:-1] << np.uint64(21) | marks[1:])[new[1:]]
        three = (marks[:-2] << np.uint64(42) | marks[1:-1] << np.uint64(21) | marks[2:])[new[2:]]
        codes = np.concatenate([one, two[two != (edge << np.uint64(21) | edge)], three])
        codes.sort()
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.empty(0, np.int64)
        found.append(codes[first])
        counts.append(np.diff(np.append(first, len(codes))))
    if len(found) > 1:
        codes, inverse = np.unique(np.concatenate(found), return_inverse=True)
        total = np.bincount(inverse, np.concatenate(counts)).astype(np.int64)
    else:
        codes, total = found[0], counts[0]
    letters = codes[codes < np.uint64(1 << 21)]
    return (codes, total) if len(letters) else (codes[:0], total[:0])


def ranked(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The ``size`` most frequent n-grams, ties by code."""
    if len(codes) > 4 * size:
        floor = np.partition(counts, len(counts) - size)[len(counts) - size]
        codes, counts = codes[counts >= floor], counts[counts >= floor]
    return codes[np.argsort(-counts, kind="stable")[:size]]


def profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> dict[str, np.ndarray]:
    """The profile of every language, from n-gram counts over all of ``docs``.

    Rows without language or letters teach nothing.  Tasks count before the
    shuffle; at most ``size`` n-grams per language reach the driver.
    """
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("binary").alias("text"))

    def count(batches):
        for batch in batches:
            by: dict[str, list] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by.setdefault(lang, []).append(gram_counts(text))
            for lang, some in by.items():
                codes, inverse = np.unique(np.concatenate([c for c, _ in some]), return_inverse=True)
                total = np.bincount(inverse, np.concatenate([n for _, n in some])).astype(np.int64)
                if len(codes):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes.view(np.int64)), pa.array(total)], ["lang", "gram", "n"])

    grams = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # a language's grams are dealt over salts first, so that no task ranks a whole language
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(64))).orderBy(F.desc("n"), "gram")
    top = grams.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= size)
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = store(top.withColumn("r", F.row_number().over(best)).where(F.col("r") <= size).select("lang", "gram", "r"), "profiles")
    found: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "r").collect():
        found.setdefault(r["lang"], []).append(r["gram"])
    return {lang: np.array(grams, np.int64).view(np.uint64) for lang, grams in found.items()}


class Identifier:
    def __init__(self, known: dict[str, np.ndarray], size: int = PROFILE):
        self.names, self.size = sorted(known), size
        self.grams = np.unique(np.concatenate([known[n] for n in self.names])) if known else np.empty(0, np.uint64)
        # the rank of every known n-gram in each language; past the end where it is absent
        self.ranks = np.full((len(self.grams) + 1, len(self.names)), -1, np.int32)
        for k, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.grams, known[name]), k] = np.arange(len(known[name]))

    def identify(self, text: bytes | None) -> tuple[str, float]:
        codes, counts = gram_counts(text)
        if not len(codes) or not self.names:
            return UNKNOWN, 0.0
        own = ranked(codes, counts, self.size)
        at = np.searchsorted(self.grams, own)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != own)] = len(self.grams)
        there = self.ranks[at]
        away = np.where(there < 0, self.size, np.abs(there - np.arange(len(own))[:, None])).sum(axis=0)
        order = np.argsort(away, kind="stable")
        second = away[order[1]] if len(order) > 1 else len(own) * self.size
        return self.names[order[0]], float(1 - away[order[0]] / second) if second else 0.0


def identified(text: Column, known: dict[str, np.ndarray], size: int = PROFILE) -> Column:
    """Struct (lang_pred, score) of a text column.

    The score is how much nearer the best language is than the second, 0 to
    1.  Null texts and texts without a letter are ``und`` with score 0; of
    languages equally near the first by name is taken.
    """
    held: list[Identifier] = []

    @F.arrow_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def find(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(Identifier(known, size))
        rows = [held[0].identify(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], ["lang_pred", "score"])

    return find(text.cast("binary"))


def identify(docs: DataFrame, known: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row; other columns are not read, repeated rows and null ids stay."""
    return docs.select(F.col(id_col).alias("doc_id"), identified(F.col(text_col), known).alias("_found")).select("doc_id", "_found.*")
