"""Best-fit packing of documents into sequences by linear grouping.

1. One pass encodes every document and cuts those longer than a sequence.
2. Only the number of pieces of each length (at most ``capacity`` rows) goes
   to the driver.  There the lengths above a threshold are put in groups of
   equal cardinality and rounded up to the group's longest; a linear program
   over configurations of those few sizes is solved by column generation and
   rounded down; the configurations' slots are filled with actual lengths;
   what is left, and the small pieces, are placed best-fit, longest first.
3. The plan is a list of runs "pieces of length L with ranks a to b go to
   sequences from s on", whose size depends on the lengths, not on the rows.
   Spark ranks the pieces of each length and looks every piece up in it.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlab.llm.common import store, tidy
from pairlab.llm.tokens import VOCABULARY, encoder

CAPACITY = 2_048
END = (0).to_bytes(4, "little")  # id 0 closes a document
# (share of a sequence above which a piece is large, groups): the plan with fewest sequences is taken
SCHEMES = ((1 / 8, 64), (1 / 4, 128), (1 / 3, 96), (1 / 2, 64))


# -- the plan -------------------------------------------------------------------


def _configurations(sizes: np.ndarray, wanted: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Fractional numbers of each configuration that hold ``wanted`` items of each size in least sequences."""
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / (capacity // sizes))
    room = np.arange(capacity + 1)[None, :] - sizes[:, None]
    fits = room >= 0
    room = np.where(fits, room, 0)
    for _ in range(40 * k):
        x, price = (inverse * wanted).sum(axis=1), inverse.sum(axis=0)
        # best value of at most m items in every capacity, m = 1, 2, ...
        best, last = [np.zeros(capacity + 1)], []
        for _m in range(int(capacity // sizes.min())):
            value = np.where(fits, price[:, None] + best[-1][room], -1.0)
            pick = value.argmax(axis=0)
            top = value[pick, np.arange(capacity + 1)]
            better = top > best[-1] + 1e-12
            if not better[capacity]:
                break
            last.append(np.where(better, pick, -1))
            best.append(np.where(better, top, best[-1]))
        if best[-1][capacity] <= 1 + 1e-7:
            break
        column, left = np.zeros(k), capacity
        for pick in reversed(last):
            if pick[left] >= 0:
                column[pick[left]] += 1
                left -= sizes[pick[left]]
        step = (inverse * column).sum(axis=1)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = ratio.argmin()
        basis[:, out] = column
        inverse[out] /= step[out]
        others = np.arange(k) != out
        inverse[others] -= step[others, None] * inverse[out]
    x = (inverse * wanted).sum(axis=1)
    return [(basis[:, j].astype(int), float(x[j])) for j in range(k)]


class _Runs:
    """Runs (first rank, end, items per sequence, first sequence, offset) of each length, and open sequences by room."""

    def __init__(self, capacity: int):
        self.capacity, self.next = capacity, 0
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.some = np.zeros(capacity + 1, bool)

    def leave(self, room: int, first: int, count: int) -> None:
        if count and room:
            self.open[room].append((first, count))
            self.some[room] = True

    def put(self, length: int, at: int, end: int, each: int, first: int, offset: int) -> None:
        if end > at:
            self.rows.append((length, at, end, each, first, offset))

    def best_fit(self, length: int, at: int, end: int) -> None:
        """Items of one length into the tightest open sequences, then into new ones."""
        while at < end:
            tail = self.some[length:]
            room = length + int(tail.argmax())
            if not self.some[room]:
                room = self.capacity
                count = -(-(end - at) // (room // length))
                self.leave(room, self.next, count)
                self.next += count
            first, count = self.open[room].pop()
            self.some[room] = bool(self.open[room])
            each = room // length
            take = min(end - at, each * count)
            whole, rest = divmod(take, each)
            offset = self.capacity - room
            self.put(length, at, at + whole * each, each, first, offset)
            self.leave(room - each * length, first, whole)
            if rest:
                self.put(length, at + whole * each, at + take, rest, first + whole, offset)
                self.leave(room - rest * length, first + whole, 1)
            used = whole + bool(rest)
            self.leave(room, first + used, count - used)
            at += take


def plan(counts: np.ndarray, capacity: int = CAPACITY, share: float = 1 / 4, groups: int = 64) -> _Runs:
    """Runs that place ``counts[L]`` items of every length L from 1 to ``capacity``."""
    runs = _Runs(capacity)
    full = int(counts[capacity])
    runs.put(capacity, 0, full, 1, 0, 0)
    runs.next = full
    lengths = [n for n in range(capacity - 1, 0, -1) if counts[n]]
    large = [n for n in lengths if n > share * capacity]
    starts = np.cumsum([0] + [int(counts[n]) for n in large])  # ranks of the large ones, longest first
    total = int(starts[-1])
    left: dict[int, list[tuple[int, int]]] = {n: [(0, int(counts[n]))] for n in lengths}
    if total:
        # equal-cardinality groups; those rounded up to one size are one
        cuts = sorted({round(total * g / groups) for g in range(groups)} - {total})
        sizes, begins = [], []
        for cut in cuts:
            size = large[bisect_right(starts, cut) - 1]
            if not sizes or size < sizes[-1]:
                sizes.append(size)
                begins.append(cut)
        ends = [*begins[1:], total]
        wanted = np.array(ends) - np.array(begins)
        taken = list(begins)
        for column, amount in _configurations(np.array(sizes), wanted.astype(float), capacity):
            count = int(amount + 1e-6)
            slots = [g for g in range(len(sizes)) for _ in range(column[g])]
            for g in set(slots):
                count = min(count, (ends[g] - taken[g]) // int(column[g]))
            if count <= 0:
                continue
            begin = []
            for g in slots:
                begin.append(taken[g])
                taken[g] += count
            # cut where an actual length of any slot changes: within a part all sequences look alike
            edges = {0, count}
            for b in begin:
                lo, hi = bisect_right(starts, b), bisect_right(starts, b + count - 1)
                edges |= {int(s) - b for s in starts[lo:hi] if 0 < s - b < count}
            edges = sorted(edges)
            for lo, hi in zip(edges, edges[1:], strict=False):
                offset = 0
                for b in begin:
                    which = bisect_right(starts, b + lo) - 1
                    rank = b + lo - int(starts[which])
                    runs.put(large[which], rank, rank + hi - lo, 1, runs.next + lo, offset)
                    offset += large[which]
                runs.leave(capacity - offset, runs.next + lo, hi - lo)
            runs.next += count
        for n in large:
            left[n] = []
        for t, end in zip(taken, ends, strict=True):
            while t < end:
                which = bisect_right(starts, t) - 1
                stop = min(end, int(starts[which + 1]))
                left[large[which]].append((t - int(starts[which]), stop - int(starts[which])))
                t = stop
    for n in lengths:
        for at, end in left[n]:
            runs.best_fit(n, at, end)
    return runs


def best_plan(counts: np.ndarray, capacity: int = CAPACITY) -> _Runs:
    return min((plan(counts, capacity, *scheme) for scheme in SCHEMES), key=lambda r: r.next)


# -- Spark ------------------------------------------------------------------------


def _cut(vocabulary: str, capacity: int, with_ids: bool):
    def run(batches):
        for batch in batches:
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, found in enumerate(encoder(vocabulary).encode(batch.column("_text"))):
                found += END
                for number, at in enumerate(range(0, len(found), 4 * capacity)):
                    part = found[at : at + 4 * capacity]
                    rows.append(row)
                    piece.append(number)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            columns = [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _place(table: np.ndarray):
    keys = table["length"] << 44 | table["at"]

    def run(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            row = table[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            past = rank - row["at"]
            out = batch.drop_columns(["rank"])
            out = out.append_column("sequence_id", pa.array(row["first"] + past // row["each"]))
            yield out.append_column("offset", pa.array(row["offset"] + past % row["each"] * length))

    return run


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    vocabulary: str = VOCABULARY, with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents placed in sequences of at most ``capacity`` ids.

    (doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset).  A
    document is its ids and a closing 0; only a longer one than a sequence is
    cut.  Null and empty texts are the closing 0 alone.  Null ids and repeated
    rows are packed as rows of their own.  Other columns are not read.  An
    empty table gives no rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("_text"))
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    pieces = store(rows.mapInArrow(tidy(_cut(vocabulary, capacity, with_ids)), schema), "pieces")
    # ranks among the pieces of a length: offsets of hash buckets, then ranks within a bucket
    buckets = max(256, pieces.count() >> 16)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[r.length] = r.n
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        dealt.withColumn("rank", F.row_number().over(within))
        .join(offsets, ["length", "bucket"])
        .select(*pieces.columns, (F.col("before") + F.col("rank") - 1).alias("rank"))
    )
    kinds = [(n, np.int64) for n in ("length", "at", "end", "each", "first", "offset")]
    table = np.sort(np.array(best_plan(counts, capacity).rows, kinds), order=["length", "at"])
    return ranked.mapInArrow(_place(table), schema + ", sequence_id long, offset long")
