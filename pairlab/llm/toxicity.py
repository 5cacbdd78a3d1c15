"""Toxicity: a convolutional text classifier over hashed words, trained in numpy.

A word's embedding is that of its hash plus that of its hashed first letters,
so that rare words learn from their family.  Filters of several widths pass
over them; each keeps its maximum over the whole text, and a logistic layer
weighs the maxima.
Filters are linear before the maximum, so scoring adds rows of one table per
filter offset.  It is fitted on every labelled document, in shards of about
``fit_rows`` side by side whose weights are averaged after every pass;
thresholds are then calibrated for every language on a part of
them that was not fitted, for recall at few false alarms, and the scores
shifted so that each language's threshold lies at ``cut``.  The language is guessed from the words as well.
"""

from __future__ import annotations

import io
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm.common import release, store, tidy, worker_cache

BUCKETS = 1 << 14
START = 5  # letters of a word's beginning, which words of one family share
DEPTH = 16
WIDTHS = (1, 2, 3)
FILTERS = 16
FIT_ROWS = 6_000  # labelled documents of a shard
FIT_WORDS = 1 << 22  # most words of a shard
BROADCAST = 1 << 20  # labels that travel to the documents; more are joined by shuffle
MERGED = 8  # shards whose weights are added at once
FINE = 256  # steps of a logit that shards tell apart when they count for a threshold
EPOCHS = 12
BATCH = 32
RARE = 4  # words of fewer fitted documents say nothing
DECAY = 2.0
TRUST = 0.7
CUT = 0.3
ALARMS = 0.05  # share of clean calibration documents that may lie above a threshold
PIECE = 1 << 15  # words of a text seen at once
TOGETHER = 1 << 17  # words seen at once
MARKS = b".,;:!?|\"'()[]{}#$%&*"
PAD = max(WIDTHS) - 1


class _Buckets(dict):
    """The buckets of a word and of its beginning in one number, marks at its ends left out; 0 is kept for padding."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        bare = word.strip(MARKS) or word
        start = bare.decode("utf-8", "replace")[:START].encode()
        self[word] = found = 1 + crc32(bare) % (BUCKETS - 1) + BUCKETS * (1 + crc32(start, 1) % (BUCKETS - 1))
        return found


def _both(rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """What a word and its beginning have in a table together."""
    return rows.take(ids % BUCKETS, axis=0) + rows.take(ids // BUCKETS, axis=0)


def bucket_ids(text: bytes | None) -> np.ndarray:
    words = (text or b"").lower().split()
    known = worker_cache("buckets", _Buckets)
    return np.fromiter(map(known.__getitem__, words), np.int32, len(words))


def _pieces(texts: list[np.ndarray]):
    """Groups of pieces (text number, ids with padding); a long text has several that overlap by the padding."""
    group, size = [], 0
    pad = np.zeros(PAD, np.int32)
    for number, ids in enumerate(texts):
        for at in range(0, max(1, len(ids)), PIECE):
            part = ids[at : at + PIECE + PAD]
            group.append((number, np.concatenate([part, pad])))
            size += len(part)
            if size >= TOGETHER:
                yield group
                group, size = [], 0
    if group:
        yield group


class Model:
    """Embeddings, filters, output layer, language table and calibrated thresholds."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays
        self._tables = None

    @classmethod
    def fresh(cls, seed: int = 42) -> Model:
        rng = np.random.default_rng(seed)
        arrays = {"emb": rng.normal(0, 0.05, (BUCKETS, DEPTH)), "out": rng.normal(0, 0.3, len(WIDTHS) * FILTERS), "bias": np.array([-2.0])}
        arrays["emb"][0] = 0
        for w in WIDTHS:
            arrays[f"w{w}"] = rng.normal(0, 0.25, (w, DEPTH, FILTERS))
            arrays[f"b{w}"] = np.zeros(FILTERS)
        return cls({k: v.astype(np.float32) for k, v in arrays.items()})

    def tables(self) -> list[list[np.ndarray]]:
        """For each width and offset: what a word in that place adds to every filter."""
        return [[self.arrays["emb"] @ self.arrays[f"w{w}"][k] for k in range(w)] for w in WIDTHS]

    def maxima(self, ids: np.ndarray, starts: np.ndarray, tables) -> list[np.ndarray]:
        """Of each filter, its maximum over every piece of the joined ``ids``."""
        found = []
        used, local = np.unique(ids, return_inverse=True)
        for w, table in zip(WIDTHS, tables, strict=True):
            n = len(ids) - w + 1
            sums = _both(table[0], used).take(local[:n], axis=0)
            for k in range(1, w):
                sums += _both(table[k], used).take(local[k : n + k], axis=0)
            found.append(np.maximum.reduceat(sums, starts, axis=0) + self.arrays[f"b{w}"])
        return found

    def logits(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Raw logits and guessed languages (numbers) of texts given as bucket ids."""
        if self._tables is None:
            self._tables = self.tables()
        best = np.full((len(texts), len(WIDTHS) * FILTERS), -np.inf, np.float32)
        tongue = self.arrays["tongue"]
        guess = np.zeros((len(texts), tongue.shape[1]), np.float32)
        for group in _pieces(texts):
            ids = np.concatenate([*(p for _, p in group), np.zeros(PAD, np.int32)])
            starts = np.cumsum([0] + [len(p) for _, p in group[:-1]])
            numbers = np.array([n for n, _ in group])
            np.maximum.at(best, numbers, np.concatenate(self.maxima(ids, starts, self._tables), axis=1))
            np.add.at(guess, numbers, np.add.reduceat(tongue[ids % BUCKETS], starts, axis=0))
        return np.maximum(best, 0) @ self.arrays["out"] + self.arrays["bias"][0], guess.argmax(axis=1)

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        raw, tongue = self.logits(texts)
        shifted = raw.astype(np.float64) - self.arrays["cuts"][tongue] + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(shifted, -500, 500)))

    def to_bytes(self) -> bytes:
        held = io.BytesIO()
        np.savez(held, **self.arrays)
        return held.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Model:
        with np.load(io.BytesIO(data)) as held:
            return cls({k: held[k] for k in held.files})


def _fit_step(model: Model, texts: list[np.ndarray], y: np.ndarray, moments: dict, step: int, rate: float, trust: float) -> None:
    a = model.arrays
    pad = np.zeros(PAD, np.int32)
    parts = [np.concatenate([t, pad]) for t in texts]
    ids = np.concatenate([*parts, pad])
    starts = np.cumsum([0] + [len(p) for p in parts])
    used, local = np.unique(ids, return_inverse=True)
    vectors = _both(a["emb"], used)
    tops, places = [], []
    for w in WIDTHS:
        n = len(ids) - w + 1
        sums = np.zeros((n, FILTERS), np.float32)
        for k in range(w):
            sums += (vectors @ a[f"w{w}"][k]).take(local[k : n + k], axis=0)
        at = np.stack([s + sums[s:e].argmax(axis=0) for s, e in zip(starts[:-1], starts[1:], strict=True)])
        places.append(at)
        tops.append(np.take_along_axis(sums, at, axis=0) + a[f"b{w}"])
    top = np.concatenate(tops, axis=1)
    z = np.maximum(top, 0) @ a["out"] + a["bias"][0]
    p = 1 / (1 + np.exp(-z))
    # labels the model finds hard to believe weigh less once it has learned something (generalised cross entropy)
    error = ((p - y) * np.where(y == 1, p, 1 - p) ** trust).astype(np.float32) / len(y)
    grads = {"out": error @ np.maximum(top, 0), "bias": np.array([error.sum()], np.float32), "emb": np.zeros_like(a["emb"])}
    down = error[:, None] * a["out"] * (top > 0)
    for i, w in enumerate(WIDTHS):
        g = down[:, i * FILTERS : (i + 1) * FILTERS]
        grads[f"b{w}"] = g.sum(axis=0)
        grads[f"w{w}"] = np.zeros_like(a[f"w{w}"])
        for k in range(w):
            words = ids[places[i] + k]
            grads[f"w{w}"][k] = np.einsum("bf,bfd->df", g, vectors[local[places[i] + k]])
            back = (g[:, :, None] * a[f"w{w}"][k].T[None]).ravel()
            for part in (words % BUCKETS, words // BUCKETS):
                np.add.at(grads["emb"].ravel(), (part.ravel()[:, None] * DEPTH + np.arange(DEPTH)).ravel(), back)
    known = moments["known"]
    grads["emb"] = grads["emb"][known]
    emb, a["emb"] = a["emb"], a["emb"][known]  # the other rows stay zero
    for name, grad in grads.items():  # Adam
        m, v = moments.setdefault(name, (np.zeros_like(grad), np.zeros_like(grad)))
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        # a large term in the divisor keeps words met once or twice from moving as far as common ones
        a[name] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + (1e-3 if name == "emb" else 1e-8))
    emb[known] = a["emb"] * np.float32(1 - DECAY * rate)
    a["emb"] = emb


def _cut(values: np.ndarray, bad: np.ndarray, clean: np.ndarray) -> float:
    """The logit above which recall exceeds false alarms most, with at most ``ALARMS`` of those; of equals that of the widest gap.

    ``values`` fall; ``bad`` and ``clean`` are the documents at each.
    """
    hits = np.cumsum(bad) / max(1, bad.sum())
    alarms = np.cumsum(clean) / max(1, clean.sum())
    gain = np.where(alarms <= ALARMS, hits - alarms, -1.0)
    cuts = np.append((values[:-1] + values[1:]) / 2, values.min() - 1)
    gaps = np.append(values[:-1] - values[1:], 0)
    good = np.flatnonzero(gain >= gain.max() - 1e-9)
    return float(cuts[good[gaps[good].argmax()]])


def _threshold(raw: np.ndarray, y: np.ndarray) -> float:
    order = np.argsort(-raw, kind="stable")
    return _cut(raw[order], y[order], 1 - y[order])


def _set_tongue(model: Model, counts: np.ndarray) -> None:
    """The language table of (bucket, language) counts."""
    table = np.log((1 + counts) / (1 + counts).sum(axis=0))
    table[0] = 0
    model.arrays["tongue"] = table.astype(np.float32)
    model.arrays["cuts"] = np.zeros(table.shape[1])


def _base_rate(model: Model, toxic: bool) -> Model:
    model.arrays["out"][:] = 0
    model.arrays["bias"][:] = 4 if toxic else -4
    model.arrays["cuts"][:] = np.log(CUT / (1 - CUT))
    return model


def _tongue_counts(ids: list[np.ndarray], langs: np.ndarray, n: int) -> np.ndarray:
    """Words of every bucket by language number; -1 is unknown."""
    counts = np.zeros((BUCKETS, max(1, n)))
    for t, g in zip(ids, langs, strict=True):
        if g >= 0:
            np.add.at(counts[:, g], t % BUCKETS, 1)
    return counts


def _seen(ids: list[np.ndarray]) -> np.ndarray:
    """Documents of every bucket."""
    found = [np.unique(np.concatenate([t % BUCKETS, t // BUCKETS])) for t in ids]
    return np.bincount(np.concatenate(found) if found else np.zeros(0, np.int64), minlength=BUCKETS)


def _known(model: Model, seen: np.ndarray) -> np.ndarray:
    """Numbers of the buckets of enough documents; the others say nothing from the start."""
    known = seen >= RARE
    known[0] = False
    model.arrays["emb"][~known] = 0
    return np.flatnonzero(known)


def _passes(model: Model, ids: list[np.ndarray], y: np.ndarray, fit: np.ndarray, moments: dict, rng, begin: int = 0, end: int = EPOCHS) -> None:
    """Passes ``begin`` to ``end`` of ``EPOCHS`` over the documents ``fit``."""
    step = begin * -(-len(fit) // BATCH)
    total = EPOCHS * (len(fit) // BATCH + 1)
    for epoch in range(begin, end):
        rng.shuffle(fit)
        for at in range(0, len(fit), BATCH):
            some = fit[at : at + BATCH]
            step += 1
            _fit_step(model, [ids[i] for i in some], y[some], moments, step, 0.01 * (1 - 0.9 * step / total), TRUST if epoch >= EPOCHS // 3 else 0.0)


def train(texts: list[bytes | None], toxic: list[int], langs: list[str | None], seed: int = 42) -> Model:
    """Fit on four fifths, calibrate on the rest; without labels of both kinds the base rate is the score."""
    model = Model.fresh(seed)
    ids = [bucket_ids(t) for t in texts]
    y = np.array(toxic, np.float32)
    names = sorted({g for g in langs if g is not None})
    _set_tongue(model, _tongue_counts(ids, np.array([-1 if g is None else names.index(g) for g in langs], np.int64), len(names)))
    if not len(y) or y.min() == y.max():
        return _base_rate(model, len(y) > 0 and y.max() > 0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(ids))
    held, fit = order[: len(order) // 5], order[len(order) // 5 :]
    moments = {"known": _known(model, _seen([ids[i] for i in fit]))}
    _passes(model, ids, y, fit, moments, rng)
    if not len(held) or y[held].min() == y[held].max():
        held = order
    raw, tongue = model.logits([ids[i] for i in held])
    overall = _threshold(raw, y[held])
    for k in range(len(model.arrays["cuts"])):
        own = tongue == k
        enough = y[held][own].sum() >= 20 and (1 - y[held][own]).sum() >= 20
        model.arrays["cuts"][k] = _threshold(raw[own], y[held][own]) if enough else overall
    return model


def _encoded(batches):
    """Texts as bucket ids."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1_000):
            some = batch.slice(at, 1_000)
            ids = pa.array([bucket_ids(t).tobytes() for t in some.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([some.column("place"), some.column("label"), some.column("lang"), ids], ["place", "label", "lang", "ids"])


def _packed(names: list[str]):
    """The documents of a shard as one row."""

    def run(key, frame):
        frame = frame.sort_values(["place", "ids", "label"], kind="stable")
        held = io.BytesIO()
        lengths = np.array([len(i) // 4 for i in frame["ids"]], np.int64)
        langs = np.array([names.index(g) if g in names else -1 for g in frame["lang"]], np.int64)
        np.savez(held, ids=np.frombuffer(b"".join(frame["ids"]), np.int32), lengths=lengths, y=frame["label"].to_numpy(np.float32), langs=langs)
        return pd.DataFrame([(key[0], held.getvalue())], columns=["shard", "data"])

    return run


def _by_shard(learn, seed: int):
    """``learn(shard, ids, labels, languages, calibration part, fitted part)`` over stored shards; it yields record batches."""

    def run(batches):
        for batch in batches:
            for shard, data in zip(batch.column("shard").to_pylist(), batch.column("data"), strict=True):
                with np.load(io.BytesIO(data.as_py())) as held:
                    ids, y, langs = np.split(held["ids"], np.cumsum(held["lengths"])[:-1]), held["y"], held["langs"]
                order = np.random.default_rng([seed, shard]).permutation(len(ids))
                yield from learn(shard, ids, y, langs, order[: len(order) // 5], order[len(order) // 5 :])

    return tidy(run)


def _array_row(shard: int, data: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([data.tobytes()], pa.binary())], ["shard", "data"])


def _total(rows: DataFrame, shards: int, kind: type) -> np.ndarray:
    """The sum of the shards' arrays, added in the order of the shards, ``MERGED`` at a time."""

    def added(key, frame):
        arrays = [np.frombuffer(d, kind) for d in frame.sort_values("shard")["data"]]
        return pd.DataFrame([(key[0], sum(arrays[1:], arrays[0]).tobytes())], columns=["shard", "data"])

    rows = store(rows, "toxicity-shards")
    found = rows
    while shards > 1:
        found = found.groupBy(F.floor(F.col("shard") / MERGED).alias("part")).applyInPandas(added, "shard long, data binary")
        shards = -(-shards // MERGED)
    whole = np.frombuffer(found.first()["data"], kind)
    release(rows)
    return whole


def _counted(model: bytes, every: bool):
    def learn(shard, ids, y, langs, held, fit):
        some = np.concatenate([held, fit]) if every else held
        raw, tongue = worker_model(model).logits([ids[i] for i in some]) if len(some) else (np.zeros(0), np.zeros(0, np.int64))
        step = np.rint(raw * FINE).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(tongue.astype(np.int64)), pa.array(step), pa.array(y[some].astype(np.int64))], ["tongue", "step", "label"])

    held_model: list[Model] = []

    def worker_model(data: bytes) -> Model:
        if not held_model:
            held_model.append(Model.from_bytes(data))
        return held_model[0]

    return learn


def _fit_shards(rows: DataFrame, fit_rows: int, seed: int = 42) -> Model:
    """A model of all ``rows`` (_id, text, lang, _label), fitted shard by shard; the driver holds one model and sums of counts.

    Every pass starts from the mean of the weights, and of the optimiser's
    moments, that the shards had after the last one.
    """
    rows = rows.select(F.xxhash64("_id", "text").alias("place"), F.col("_label").cast("int").alias("label"), "lang", "text")
    encoded = store(rows.mapInArrow(tidy(_encoded), "place long, label int, lang string, ids binary"), "toxicity-ids")
    n, words, low, high = encoded.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("ids") / 4), F.lit(0)), F.min("label"), F.max("label")).first()
    if not n:
        return train([], [], [], seed)
    names = sorted(r[0] for r in encoded.where("lang is not null").select("lang").distinct().collect())
    shards = int(max(-(-n // fit_rows), -(-words // FIT_WORDS)))
    dealt = encoded.withColumn("shard", F.pmod("place", F.lit(shards))).groupBy("shard")
    stored = store(dealt.applyInPandas(_packed(names), "shard long, data binary"), "toxicity-dealt")
    release(encoded)

    def count(shard, ids, y, langs, held, fit):
        parts = [_tongue_counts(ids, langs, len(names)).ravel(), _seen([ids[i] for i in fit]).astype(np.float64)]
        yield _array_row(shard, np.concatenate([*parts, [float(len(fit))]]))

    counts = _total(stored.mapInArrow(_by_shard(count, seed), "shard long, data binary"), shards, np.float64)
    model = Model.fresh(seed)
    weights = sorted(model.arrays)
    _set_tongue(model, counts[: -BUCKETS - 1].reshape(BUCKETS, -1))
    if low == high:
        release(stored)
        return _base_rate(model, high > 0)
    known, fitted = _known(model, counts[-BUCKETS - 1 : -1]), counts[-1]
    state = {name: np.zeros((3, *(model.arrays[name][known] if name == "emb" else model.arrays[name]).shape), np.float32) for name in weights}
    for name in weights:  # weights and both moments; of the embeddings the known rows
        state[name][0] = model.arrays[name][known] if name == "emb" else model.arrays[name]

    def one_pass(epoch, state):
        def learn(shard, ids, y, langs, held, fit):
            own = Model({name: state[name][0].copy() for name in weights})
            own.arrays["emb"] = np.zeros((BUCKETS, DEPTH), np.float32)
            own.arrays["emb"][known] = state["emb"][0]
            moments = {name: (state[name][1].copy(), state[name][2].copy()) for name in weights} | {"known": known}
            _passes(own, ids, y, fit, moments, np.random.default_rng([seed, shard, epoch]), epoch, epoch + 1)
            own.arrays["emb"] = own.arrays["emb"][known]
            parts = [a.ravel() for name in weights for a in (own.arrays[name], *moments[name])]
            yield _array_row(shard, np.float32(len(fit)) * np.concatenate(parts))

        return learn

    for epoch in range(EPOCHS):
        mean = _total(stored.mapInArrow(_by_shard(one_pass(epoch, state), seed), "shard long, data binary"), shards, np.float32) / np.float32(fitted)
        ends = np.cumsum([state[name].size for name in weights])
        state = {name: part.reshape(state[name].shape) for name, part in zip(weights, np.split(mean, ends[:-1]), strict=True)}
    for name in weights:
        if name == "emb":
            model.arrays[name][known] = state[name][0]
        else:
            model.arrays[name] = state[name][0]

    for every in (False, True):  # all documents, if those of the calibration part are of one kind
        found = stored.mapInArrow(_by_shard(_counted(model.to_bytes(), every), seed), "tongue long, step long, label long")
        found = found.groupBy("tongue", "step").agg(F.sum("label").alias("bad"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).toPandas()
        found["clean"] = found["n"] - found["bad"]
        if found["bad"].sum() and found["clean"].sum():
            break
    release(stored)

    def cut(some: pd.DataFrame) -> float:
        sums = some.groupby("step")[["bad", "clean"]].sum().sort_index(ascending=False)
        return _cut(sums.index.to_numpy() / FINE, sums["bad"].to_numpy(), sums["clean"].to_numpy())

    overall = cut(found)
    for k in range(len(model.arrays["cuts"])):
        own = found[found["tongue"] == k]
        model.arrays["cuts"][k] = cut(own) if own["bad"].sum() >= 20 and own["clean"].sum() >= 20 else overall
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """A model of ``labels`` (id, label 0/1), fitted on every labelled document; up to ``fit_rows`` labels in one task, more in shards of about that many.

    Documents are dealt by the hash of id and text, so the model is the same in every run.  Null
    ids and labels teach nothing; several labels of one id count as the largest.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label"))
    n = known.count()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.join(F.broadcast(known) if n <= BROADCAST else known, "_id")
    if n > fit_rows:
        return _fit_shards(rows, fit_rows)
    rows = rows.repartition(1).sortWithinPartitions("_id", "text")

    def learn(batches):
        texts, toxic, langs = [], [], []
        for b in batches:
            texts += b.column("text").to_pylist()
            toxic += b.column("_label").to_pylist()
            langs += b.column("lang").to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([train(texts, toxic, langs).to_bytes()], pa.binary())], ["model"])

    found = rows.mapInArrow(learn, "model binary").first()
    return Model.from_bytes(found[0]) if found else train([], [], [])


def scored(text: Column, model: Model) -> Column:
    """The score of a text column, 0 to 1; null and empty texts are scored as texts without words."""
    data = model.to_bytes()
    held: list[Model] = []

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(Model.from_bytes(data))
        # a thousand texts at a time are held as words
        parts = [held[0].scores([bucket_ids(t) for t in texts.slice(at, 1_000).to_pylist()]) for at in range(0, len(texts), 1_000)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score(text.cast("binary"))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row; other columns are not read, repeated rows and null ids stay.

    Null and empty texts score as texts without words, long ones whole in
    pieces, equal texts alike; an empty table gives no row.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), scored(F.col(text_col), model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
