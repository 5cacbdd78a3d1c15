"""Language-model scores: one layer of causal self-attention over subword ids.

P(id | past) = P(class of id | window) * P(id | its class, group of the id before).
The first factor is an attention model, the second comes from counts.  Both
learn from all training documents.  A text is read in windows of ``CONTEXT``
ids of context and ``STEP`` ids to score, so every id is scored once.

1. Every text is encoded once and stored with its ids.
2. Ids are counted, then their neighbours; one task clusters the ids by these
   sums, whose size depends on the vocabulary, not on the corpus.
3. The attention model is trained in numpy on shards of about ``SHARD`` ids
   that run side by side.  Every shard starts a round from one model and learns
   from its share of the documents; weighted means over the shards, an
   embedding's by the number of times the shard saw its id, start the next
   round.  Each document is in one shard and one round.  A corpus of a single
   shard is passed over ``EPOCHS`` times or more.

Beside it stands a unigram base over words, with counts over all training
documents: the counts of the ``FREQUENT`` most frequent words (a fixed bound)
travel to the tasks, all others are joined.
"""

from __future__ import annotations

import io
import uuid
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import give_back, release, store, tidy, worker_cache
from pairlab.llm.tokens import VOCABULARY, encoder

SHARD = 2_000_000  # ids that one task trains on
ROUNDS = 4  # times that the shards' models are averaged
BLOCK, MERGED = 4_096, 64  # embeddings of a row, and rows that are averaged at once
COMMON = 127  # ids whose places beside an id tell its class
FREQUENT = 131_072
CONTEXT, STEP = 16, 16
DEPTH, HIDDEN = 16, 24
CLASSES, GROUPS = 64, 1_024
END, BEGIN, IDS = 49_408, 49_409, 49_410
BATCH, EPOCHS, STEPS = 128, 3, 300  # windows of a step, least passes and steps
TOGETHER = 50_000  # ids scored at once
AT_ONCE = 1_000  # rows handed on at a time
DISTINCT = 100_000  # words that a task counts before it passes them on
LOG10 = np.log(10.0)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    x /= x.sum(axis=-1, keepdims=True)
    return x


def windows(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, which of them exist, targets and their sequence (-1 where there is none), a row per window.

    A sequence's inputs begin with BEGIN and its targets end with END.
    """
    sizes = np.array([len(s) + 1 for s in sequences])
    flat = np.concatenate([np.concatenate([[BEGIN], s]) for s in sequences]).astype(np.int64)
    goal = np.concatenate([np.append(s, END) for s in sequences]).astype(np.int64)
    first = np.cumsum(sizes) - sizes
    count = -(-sizes // STEP)
    owner = np.repeat(np.arange(len(sequences)), count)
    begin = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * STEP
    place = begin[:, None] + np.arange(-CONTEXT, STEP)
    there = (place >= 0) & (place < sizes[owner][:, None])
    at = np.where(there, place + first[owner][:, None], 0)
    scored = there[:, CONTEXT:]
    return flat[at], there, goal[at[:, CONTEXT:]], np.where(scored, owner[:, None], -1)


class Attention:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.a = arrays

    @classmethod
    def fresh(cls, seen: int, classes: int = CLASSES, seed: int = 42) -> Attention:
        rng = np.random.default_rng(seed)
        shapes = {"E": (seen, DEPTH), "P": (CONTEXT + STEP, DEPTH), "Q": (DEPTH, DEPTH), "K": (DEPTH, DEPTH), "V": (DEPTH, DEPTH), "Z": (DEPTH, HIDDEN), "O": (DEPTH, HIDDEN), "bz": (HIDDEN,), "U": (HIDDEN, classes), "bu": (classes,)}
        return cls({k: (np.zeros(s) if k[0] == "b" else rng.normal(0, s[-1] ** -0.5 if k != "E" else 0.5, s)).astype(np.float32) for k, s in shapes.items()})

    def _mask(self, there: np.ndarray) -> np.ndarray:
        causal = np.arange(CONTEXT + STEP)[None, :] <= np.arange(CONTEXT, CONTEXT + STEP)[:, None]
        return np.where(causal[None] & there[:, None, :], np.float32(0), np.float32(-1e9))

    def log_targets(self, inputs: np.ndarray, there: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Log probability (natural) of the class that stands at every place that is scored."""
        a = self.a
        if "EK" not in a:
            for n, factor in (("Q", DEPTH**-0.5), ("K", 1), ("V", 1), ("Z", 1)):
                a["E" + n], a["P" + n] = a["E"] @ a[n] * np.float32(factor), a["P"] @ a[n] * np.float32(factor)
            a["PZ"] += a["bz"]
        own = inputs[:, CONTEXT:]
        q = a["EQ"].take(own, axis=0)
        q += a["PQ"][CONTEXT:]
        k = a["EK"].take(inputs, axis=0)
        k += a["PK"]
        w = np.matmul(q, k.transpose(0, 2, 1))
        # what lies after a place is masked everywhere; what does not exist before it, only in a first window
        w += np.where(np.arange(CONTEXT + STEP) <= np.arange(CONTEXT, CONTEXT + STEP)[:, None], np.float32(0), np.float32(-1e9))
        short = np.flatnonzero(~there[:, 0])
        w[short] += np.where(there[short], np.float32(0), np.float32(-1e9))[:, None, :]
        np.minimum(w, np.float32(60), out=w)
        np.exp(w, out=w)
        v = a["EV"].take(inputs, axis=0)
        v += a["PV"]
        o = np.matmul(w, v)
        o /= w.sum(axis=2, keepdims=True)
        z = o.reshape(-1, DEPTH) @ a["O"]
        own_z = a["EZ"].take(own, axis=0)
        own_z += a["PZ"][CONTEXT:]
        z += own_z.reshape(-1, HIDDEN)
        np.maximum(z, 0, out=z)
        y = z @ a["U"]
        y += a["bu"]
        np.minimum(y, np.float32(80), out=y)
        found = y[np.arange(len(y)), classes]
        np.exp(y, out=y)
        return found - np.log(y.sum(axis=1))

    def learn(self, inputs, there, classes, moments, step, rate) -> float:
        """One Adam step on windows; ``classes`` holds -1 where nothing is scored.  Returns the mean loss."""
        a = self.a
        x = a["E"][inputs] + a["P"]
        own = x[:, CONTEXT:]
        q, k, v = own @ a["Q"], x @ a["K"], x @ a["V"]
        s = DEPTH**-0.5
        w = _softmax(np.matmul(q, k.transpose(0, 2, 1)) * np.float32(s) + self._mask(there))
        o = np.matmul(w, v)
        pre = own @ a["Z"] + o @ a["O"] + a["bz"]
        z = np.maximum(pre, 0).reshape(-1, HIDDEN)
        p = _softmax(z @ a["U"] + a["bu"])
        goal = classes.ravel()
        some = np.flatnonzero(goal >= 0)
        loss = -np.log(p[some, goal[some]] + 1e-30).mean()
        d = p.copy()
        d[some, goal[some]] -= 1
        d[goal < 0] = 0
        d /= len(some)
        g = {"U": z.T @ d, "bu": d.sum(axis=0)}
        dz = ((d @ a["U"].T) * (z > 0)).reshape(pre.shape)
        g["bz"] = dz.sum(axis=(0, 1))
        flat = dz.reshape(-1, HIDDEN)
        g["Z"], g["O"] = own.reshape(-1, DEPTH).T @ flat, o.reshape(-1, DEPTH).T @ flat
        do = dz @ a["O"].T
        dw = np.matmul(do, v.transpose(0, 2, 1))
        ds = w * (dw - (dw * w).sum(axis=-1, keepdims=True)) * np.float32(s)
        dv = np.matmul(w.transpose(0, 2, 1), do)
        dq, dk = np.matmul(ds, k), np.matmul(ds.transpose(0, 2, 1), q)
        g["Q"] = own.reshape(-1, DEPTH).T @ dq.reshape(-1, DEPTH)
        g["K"] = x.reshape(-1, DEPTH).T @ dk.reshape(-1, DEPTH)
        g["V"] = x.reshape(-1, DEPTH).T @ dv.reshape(-1, DEPTH)
        dx = dk @ a["K"].T + dv @ a["V"].T
        dx[:, CONTEXT:] += dq @ a["Q"].T + dz @ a["Z"].T
        g["P"] = dx.sum(axis=0)
        # only the embeddings of ids that occur move
        flat = inputs.ravel()
        order = np.argsort(flat, kind="stable")
        begin = np.flatnonzero(np.diff(flat[order], prepend=-1))
        rows = flat[order[begin]]
        g["E"] = np.add.reduceat(dx.reshape(-1, DEPTH)[order], begin, axis=0)
        for n, grad in g.items():
            held = moments.setdefault(n, (np.zeros_like(a[n]), np.zeros_like(a[n])))
            some = rows if n == "E" else slice(None)
            m, u = (x[some] for x in held)
            m = m + np.float32(0.1) * (grad - m)
            u = u + np.float32(0.01) * (grad * grad - u)
            held[0][some], held[1][some] = m, u
            a[n][some] -= np.float32(rate) * (m / np.float32(1 - 0.9**step)) / (np.sqrt(u / np.float32(1 - 0.99**step)) + np.float32(1e-8))
        return float(loss)


def _chain(sequences: list[np.ndarray]) -> np.ndarray:
    """All ids in a row, BEGIN and END around every sequence."""
    return np.concatenate([np.empty(0, np.int64), *[np.concatenate([[BEGIN], s, [END]]) for s in sequences]]).astype(np.int64)


def _numbered(count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The seen ids by falling count; of every id its number among them (the last for all others) and among the common."""
    by_count = np.argsort(-count, kind="stable")
    seen = by_count[: max(1, int((count > 0).sum()))]
    number = np.full(IDS, len(seen))
    number[seen] = np.arange(len(seen))
    common = np.full(IDS, COMMON)
    common[by_count[:COMMON]] = np.arange(COMMON)
    return seen, number, common


def _neighbours(chain: np.ndarray, number: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Codes number x 256 + place: which common id stands before (from 0) and after (from 128) an id."""
    inside = chain[:-1] != END  # what follows an END is another text
    past, next_ = chain[:-1][inside], chain[1:][inside]
    return np.concatenate([number[next_] * 256 + common[past], number[past] * 256 + 128 + common[next_]])


def _clustered(count: np.ndarray, profile: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every id: its number, class, and group as a left neighbour.  ``profile``: sums of neighbours, a row per seen id."""
    seen, number, _ = _numbered(count)
    profile = np.sqrt(profile / np.maximum(profile.sum(axis=1, keepdims=True), 1))
    rng = np.random.default_rng(7)
    k = min(CLASSES - 1, len(seen))
    centres = profile[rng.choice(len(seen), k, replace=False, p=count[seen] / count[seen].sum())] if k > 1 else profile[:1]
    near = np.zeros(len(seen), np.int64)
    weight = count[seen][:, None].astype(np.float32)
    for _ in range(10):
        near = ((centres**2).sum(axis=1) - 2 * (profile @ centres.T)).argmin(axis=1)
        held = [near == c for c in range(len(centres))]
        centres = np.stack([(profile[h] * weight[h]).sum(axis=0) / weight[h].sum() if h.any() else centres[c] for c, h in enumerate(held)])
    # only classes that hold ids count; those never seen are one more
    near = np.unique(near, return_inverse=True)[1]
    classes = np.full(IDS, near.max() + 1)
    classes[seen] = near
    groups = classes + (GROUPS - CLASSES)
    single = seen[: GROUPS - CLASSES]
    groups[single] = np.arange(len(single))
    return number, classes, groups


def _pack(**arrays: np.ndarray) -> bytes:
    held = io.BytesIO()
    np.savez(held, **arrays)
    return held.getvalue()


def _unpack(model: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(model)) as held:
        return {k: held[k] for k in held.files}


def _fit(model: Attention, number: np.ndarray, classes: np.ndarray, sequences: list[np.ndarray], seed: int, begin: float = 0.0, end: float = 1.0, once: bool = False) -> np.ndarray:
    """Train on the sequences, from the share ``begin`` of a whole training to ``end``; how often each embedding was read."""
    inputs, there, goal, owner = windows(sequences)
    inputs, target = number[inputs], np.where(owner >= 0, classes[goal], -1)
    rng = np.random.default_rng(seed)
    moments, step = {}, 0
    each = -(-len(inputs) // BATCH)
    epochs = 1 if once else max(EPOCHS, -(-STEPS // each))
    total = epochs * each
    for _ in range(epochs):
        order = rng.permutation(len(inputs))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            done = begin + (end - begin) * step / total
            step += 1
            model.learn(inputs[some], there[some], target[some], moments, step, 0.01 * (1 - 0.95 * done))
    return np.bincount(inputs[there], minlength=len(model.a["E"]))


def train(texts: list[bytes | None], vocabulary: str = VOCABULARY, seed: int = 42) -> bytes:
    """A model of texts that fit in memory."""
    sequences = [np.frombuffer(i, "<u4") for i in encoder(vocabulary).encode(texts)] or [np.empty(0, np.uint32)]
    chain = _chain(sequences)
    count = np.bincount(chain, minlength=IDS)
    seen, number, common = _numbered(count)
    profile = np.bincount(_neighbours(chain, number, common), minlength=len(seen) * 256).reshape(-1, 256).astype(np.float32)
    number, classes, groups = _clustered(count, profile)
    model = Attention.fresh(len(seen) + 1, int(classes.max()) + 1, seed)
    _fit(model, number, classes, sequences, seed)
    return _pack(number=number, classes=classes, groups=groups, **model.a)


def _sequences(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(i, "<u2") for i in batch.column("ids").to_pylist()]


def _encoded(vocabulary: str):
    """Rows with the ids of their text, as little-endian unsigned 16-bit numbers."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                found = [np.frombuffer(i, "<u4").astype("<u2").tobytes() for i in encoder(vocabulary).encode(part.column("text"))]
                yield part.append_column("ids", pa.array(found, pa.binary()))

    return run


def _parts(batches):
    """The ids of a few rows at a time, with nothing left in the worker of an earlier step, such as the encoder's chunks."""
    worker_cache("ids", dict)
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            yield _sequences(batch.slice(at, AT_ONCE))


def _id_counts(batches):
    count = np.zeros(IDS, np.int64)
    for sequences in _parts(batches):
        count += np.bincount(_chain(sequences), minlength=IDS)
    some = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], ["id", "n"])


def _neighbour_counts(count: np.ndarray):
    def run(batches):
        seen, number, common = _numbered(count)
        sums = np.zeros(len(seen) * 256, np.int32)
        for sequences in _parts(batches):
            np.add.at(sums, _neighbours(_chain(sequences), number, common), np.int32(1))
        for at in range(0, len(sums), 1 << 20):
            some = np.flatnonzero(sums[at : at + (1 << 20)]) + at
            for lo in range(0, len(some), 200_000):
                part = some[lo : lo + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(sums[part].astype(np.int64))], ["code", "n"])

    return run


def _cluster(count: np.ndarray):
    """The sums of all tasks to one packed table of numbers, classes and groups."""

    def run(batches):
        worker_cache("ids", dict)  # the encoder's chunks go
        profile = np.zeros(len(_numbered(count)[0]) * 256, np.float32)
        for batch in batches:
            profile[batch.column("code").to_numpy()] = batch.column("n").to_numpy()
        number, classes, groups = _clustered(count, profile.reshape(-1, 256))
        yield pa.RecordBatch.from_arrays([pa.array([_pack(number=number, classes=classes, groups=groups)], pa.binary())], ["model"])

    return run


SUMS = "block int, shard long, weight binary, data binary"


def _flat(model: Attention) -> np.ndarray:
    return np.concatenate([model.a[n].ravel() for n in sorted(model.a) if n != "E"])


def _train_shard(model: bytes, seed: int, begin: float, end: float, once: bool):
    """Documents of a shard to weights and weighted parameters: blocks of embeddings, all else as block -1."""

    def run(key, frame):
        worker_cache("ids", dict)  # the encoder's chunks go
        arrays = _unpack(model)
        number, classes, _ = (arrays.pop(k) for k in ("number", "classes", "groups"))
        found = Attention(arrays)
        sequences = [np.frombuffer(i, "<u2") for i in sorted(frame["ids"])]
        read = _fit(found, number, classes, sequences, seed, begin, end, once).astype(np.float32)
        n = np.float32(sum(len(s) + 1 for s in sequences))
        rows = [(-1, key[0], n.tobytes(), (n * _flat(found)).tobytes())]
        for at in range(0, len(read), BLOCK):
            weight = read[at : at + BLOCK]
            if weight.any():
                rows.append((at // BLOCK, key[0], weight.tobytes(), (weight[:, None] * found.a["E"][at : at + BLOCK]).tobytes()))
        return pd.DataFrame(rows, columns=["block", "shard", "weight", "data"])

    return run


def _added(key, frame):
    """Sums of the weights and of the weighted parameters of one block, in the order of the shards."""
    frame = frame.sort_values("shard")
    weight, data = (sum(np.frombuffer(x, np.float32) for x in frame[n]) for n in ("weight", "data"))
    return pd.DataFrame([(key[0], key[1], weight.tobytes(), data.tobytes())], columns=["block", "shard", "weight", "data"])


def learned(texts: DataFrame, shard: int = SHARD, seed: int = 42) -> bytes:
    """The packed model of all rows of ``texts`` (doc_id, ids)."""
    rows = texts.select("ids").mapInArrow(tidy(_id_counts), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # at most IDS rows
    count = np.zeros(IDS, np.int64)
    count[rows.column("id").to_numpy()] = rows.column("n").to_numpy()
    if not count.any():
        return train([], seed=seed)
    sums = texts.select("ids").mapInArrow(tidy(_neighbour_counts(count)), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    tables = _unpack(sums.repartition(1).mapInArrow(tidy(_cluster(count)), "model binary").first()[0])
    model = Attention.fresh(int((count > 0).sum()) + 1, int(tables["classes"].max()) + 1, seed)
    shards = int(-(-count.sum() // shard))
    rounds = ROUNDS if shards > 1 else 1
    place = F.pmod(F.xxhash64("ids", "doc_id"), F.lit(shards * rounds))
    dealt = texts.select("ids", F.floor(place / rounds).alias("shard"), (place % rounds).alias("round"))
    for r in range(rounds):
        packed = _pack(**tables, **model.a)
        fit = _train_shard(packed, seed + r, r / rounds, (r + 1) / rounds, shards > 1)
        found = dealt.where(F.col("round") == r).groupBy("shard").applyInPandas(fit, SUMS)
        left = shards
        while left > 1:
            found = found.groupBy("block", F.floor(F.col("shard") / MERGED).alias("shards")).applyInPandas(_added, SUMS)
            left = -(-left // MERGED)
        for row in found.collect():  # the size of one model
            weight, data = np.frombuffer(row["weight"], np.float32), np.frombuffer(row["data"], np.float32)
            if row["block"] < 0:
                mean, at = data / weight, 0
                for n in sorted(model.a):
                    if n != "E":
                        size = model.a[n].size
                        model.a[n] = mean[at : at + size].reshape(model.a[n].shape)
                        at += size
            else:
                some = np.flatnonzero(weight)
                model.a["E"][row["block"] * BLOCK + some] = data.reshape(-1, DEPTH)[some] / weight[some, None]
    return _pack(**tables, **model.a)


class Scorer:
    """The attention model with the corpus's counts of (group, id): sorted codes group x IDS + id and their numbers."""

    def __init__(self, model: bytes, codes: np.ndarray, n: np.ndarray, prior: float = 12.0):
        arrays = _unpack(model)
        self.number, self.classes, self.groups = (arrays.pop(k) for k in ("number", "classes", "groups"))
        self.model = Attention(arrays)
        self.codes, self.logs = codes, np.empty(len(codes), np.float32)
        total, both = np.zeros(IDS), np.zeros((GROUPS, CLASSES))
        steps = [slice(at, at + TOGETHER) for at in range(0, len(codes), TOGETHER)]
        for some in steps:  # a part of the pairs at a time, so that nothing as wide as all of them is held twice
            group, ids = np.divmod(codes[some].astype(np.int64), IDS)
            total += np.bincount(ids, n[some], IDS)
            np.add.at(both, (group, self.classes[ids]), n[some])
        in_class, size = np.bincount(self.classes, total, CLASSES), np.bincount(self.classes, minlength=CLASSES)
        share = (total + 0.05) / (in_class + 0.05 * size)[self.classes]  # P(id | class)
        for some in steps:
            group, ids = np.divmod(codes[some].astype(np.int64), IDS)
            self.logs[some] = np.log((n[some] + prior * share[ids]) / (both[group, self.classes[ids]] + prior))
        self.rare, self.both, self.prior = np.log(prior * share), np.log(both + prior), prior

    def within_class(self, group: np.ndarray, target: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Log probability of each target within its class after a group."""
        log = self.rare[target] - self.both[group, kind]
        if len(self.codes):
            code = (group * IDS + target).astype(self.codes.dtype)
            order = np.argsort(code)  # neighbours in the table are looked up one after the other
            at = np.empty(len(code), np.int64)
            at[order] = np.minimum(np.searchsorted(self.codes, code[order]), len(self.codes) - 1)
            seen = self.codes[at] == code
            log[seen] = self.logs[at[seen]]
        return log

    def scores(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Log10 probability of every sequence."""
        found = np.zeros(len(sequences))
        at = 0
        while at < len(sequences):
            some, size, begin = [], 0, at
            while at < len(sequences) and (not some or size < TOGETHER):
                some.append(sequences[at])
                size += len(sequences[at])
                at += 1
            inputs, there, goal, owner = windows(some)
            for lo in range(0, len(inputs), TOGETHER // STEP):
                part = slice(lo, lo + TOGETHER // STEP)
                ids, target, own = inputs[part], goal[part].ravel(), owner[part].ravel()
                group, kind = self.groups[ids[:, CONTEXT:]].ravel().astype(np.int64), self.classes[target]
                log = self.model.log_targets(self.number[ids], there[part], kind)
                log = log + self.within_class(group, target, kind)
                good = own >= 0
                found[begin : begin + len(some)] += np.bincount(own[good], log[good], len(some))
        return found / LOG10


def _word_rows(words: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.array([-1] * len(words), pa.int64()), pa.array(list(words.values()), pa.int64())], ["word", "code", "n"])


def _pair_rows(pairs: list[np.ndarray]) -> pa.RecordBatch:
    code, n = np.unique(np.concatenate(pairs), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.nulls(len(code), pa.binary()), pa.array(code), pa.array(n.astype(np.int64))], ["word", "code", "n"])


def _count(model: bytes):
    """Word counts and counts of (group, id), handed on whenever enough are held."""

    def run(batches):
        worker_cache("ids", dict)  # the encoder's chunks go
        groups = _unpack(model)["groups"]
        words: Counter = Counter()
        pairs, size = [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                for text, ids in zip(batch.column("text"), _sequences(batch), strict=True):
                    words.update((text.as_py() or b"").lower().split())
                    if len(words) > DISTINCT:
                        yield _word_rows(words)
                        words.clear()
                    ids = ids.astype(np.int64)
                    pairs.append(groups[np.concatenate([[BEGIN], ids])] * IDS + np.append(ids, END))
                    size += len(ids) + 1
                    if size > TOGETHER * 10:
                        yield _pair_rows(pairs)
                        pairs, size = [], 0
        yield _word_rows(words)
        if pairs:
            yield _pair_rows(pairs)

    return run


def _score(model: bytes, pairs: tuple, frequent: pa.Table):
    names = ["doc_id", "fold", "n_tokens", "known", "logs", "words", "ns", "score"]
    tag = f"scorer {uuid.uuid4().hex}"

    def run(batches):
        scorer = worker_cache(tag, lambda: Scorer(model, *pairs))
        log_of = dict(zip(frequent.column("word").to_pylist(), np.log10(frequent.column("n").to_numpy() + 1).tolist(), strict=True)).get
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                columns: list[list] = [[] for _ in range(5)]
                for text in batch.column("text"):
                    words = (text.as_py() or b"").lower().split()
                    logs = [log_of(w, 0.0) for w in words]  # a known word's is above zero
                    unknown = logs.count(0.0)
                    rare = Counter(w for w, x in zip(words, logs, strict=True) if not x) if unknown else {}
                    for c, v in zip(columns, (len(words), len(words) - unknown, sum(logs), list(rare), list(rare.values())), strict=True):
                        c.append(v)
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fold"), *arrays, pa.array(scorer.scores(_sequences(batch)), pa.float64())], names)
                give_back()

    return run


def score_texts(docs: DataFrame, held_out: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, shard: int = SHARD) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    ``held_out`` is a SQL condition; rows where it holds teach nothing, all
    others teach the model, its counts and the base.  A
    text's tokens are its words, A-Z in lower case, and one end; a null text
    is empty.  Null ids and repeated rows are scored and counted as rows of
    their own; other columns are not read.  Without training rows all counts
    are zero.  An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.expr(held_out), F.lit(False)).alias("fold"), F.col(text_col).cast("binary").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = store(rows.mapInArrow(tidy(_encoded(vocabulary)), f"doc_id {kind}, fold boolean, text binary, ids binary"), "encoded")
    training = rows.where("not fold")
    n_docs = training.count()
    model = learned(training, shard)
    counts = training.select("text", "ids").mapInArrow(tidy(_count(model)), "word binary, code long, n long").groupBy("word", "code").agg(F.sum("n").alias("n"))
    counts = store(counts, "counts")
    words = counts.where("word is not null").select("word", "n")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    tokens, distinct = total[0] + n_docs, total[1] + (n_docs > 0)
    # at most FREQUENT words, and at most GROUPS * IDS pairs whatever the corpus
    frequent = words.orderBy(F.desc("n"), "word").limit(FREQUENT).toArrow()
    pairs = counts.where("word is null").select("code", "n").toArrow()
    code = pairs.column("code").to_numpy()
    order = np.argsort(code)
    seen = code[order].astype(np.int32), pairs.column("n").to_numpy()[order].astype(np.float32)
    schema = f"doc_id {kind}, fold boolean, n_tokens long, known long, logs double, words array<binary>, ns array<long>, score double"
    scored = rows.mapInArrow(tidy(_score(model, seen, frequent)), schema).withColumn("row", F.monotonically_increasing_id())
    scored = store(scored, "scores")
    release(rows)
    rare = scored.select("row", F.explode(F.arrays_zip("words", "ns")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.ns").alias("times"))
    rare = rare.join(words, "word").groupBy("row").agg(F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_logs"))
    out = scored.drop("words", "ns").join(rare, "row", "left")
    n = F.col("n_tokens") + 1
    base = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0)) + F.lit(float(np.log10(n_docs + 1))) - n * F.lit(float(np.log10(tokens + distinct + 1)))
    return out.select(
        "doc_id", F.col("fold").alias("held_out"), n.alias("n_tokens"),
        (F.col("known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(n_docs > 0))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
    )
