"""Subword ids of whole texts, encoded once per distinct blank-separated chunk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from pairlab.llm.common import give_back, worker_cache

VOCABULARY = "word_bpe_49k.json"
MARKS = ".,;:!?|"
PLAIN = "\u0130"  # letters below it are composed already and have plain lower case
CACHED = 200_000  # chunks that a worker remembers
TOGETHER = 1 << 23  # bytes of text looked up at once


def _strings(chunks: pa.Array) -> list[str]:
    """The chunks, which hold no blanks, as Python strings."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(chunks)], chunks), "\n")[0].as_py().split("\n") if len(chunks) else []


def _beyond(words: pa.Array) -> pa.Array:
    """Which words hold a letter from ``PLAIN`` on."""
    ascii_only = pc.string_is_ascii(words)
    found = ascii_only.to_numpy(zero_copy_only=False)
    some = np.flatnonzero(~found)
    beyond = np.zeros(len(words), bool)
    beyond[some] = [max(w) >= PLAIN for w in _strings(words.take(pa.array(some)))]
    return pa.array(beyond)


class ChunkEncoder:
    """Ids of a text as little-endian unsigned 32-bit bytes.

    The vocabulary drops blanks before it splits and every rule of it stays
    within one run of non-blanks, so a text's ids are its chunks' ids in a
    row.  Strings of special tokens stand for those tokens wherever they
    occur; a text that holds one is encoded whole by the vocabulary itself.
    """

    def __init__(self, vocabulary: str):
        self._tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._special = special
        self._known: dict[str, bytes] = {}
        # what the vocabulary's byte step makes of a byte: itself if it is printable, else the next free character
        free = iter(range(256, 512))
        self._letters = {b: b if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b else next(free) for b in range(256)}
        self._bytes_of = [i.to_bytes(4, "little") for i in range(self._tokenizer.get_vocab_size())]

    def _held(self, chunks: list[str], learn) -> pa.Array:
        """The ids of every chunk; those not known yet are learned together."""
        known = self._known
        missing = [c for c in chunks if c not in known]
        fresh = dict(zip(missing, learn(missing), strict=True))
        if len(known) + len(fresh) > CACHED:
            fresh = {c: fresh[c] if c in fresh else known[c] for c in chunks}
            known.clear()
        known.update(fresh)
        return pa.array(map(known.__getitem__, chunks), pa.large_binary(), size=len(chunks))

    def _merged(self, words: list[str]) -> list[bytes]:
        """The ids of words of plain lower-case letters."""
        merge, bytes_of, letters = self._tokenizer.model.tokenize, self._bytes_of, self._letters
        stood_for = [w if w.isascii() else w.encode().decode("latin-1").translate(letters) for w in words]
        return [b"".join([bytes_of[t.id] for t in merge(w)]) for w in stood_for]

    def _each(self, chunks: list[str]) -> list[bytes]:
        return [b"".join([self._bytes_of[i] for i in found.ids]) for found in self._tokenizer.encode_batch(chunks, add_special_tokens=False)]

    def _ids(self, chunks: pa.Array) -> pa.Array:
        """The ids of distinct chunks."""
        try:
            chunks.validate(full=True)
        except pa.ArrowInvalid:
            chunks = pa.array([c.decode("utf-8", "replace") for c in chunks.view(pa.binary()).to_pylist()], pa.string())
        # letters and closing marks are split apart before any merge
        words = pc.utf8_rtrim(chunks, MARKS)
        plain = pc.and_(pc.utf8_is_alpha(words), pc.invert(_beyond(words)))
        closed = pc.and_(plain, pc.not_equal(pc.binary_length(words), pc.binary_length(chunks)))
        bare = pc.utf8_lower(words.filter(plain)).dictionary_encode()
        found = self._held(_strings(bare.dictionary), self._merged).take(bare.indices)
        if pc.any(closed).as_py():
            size = pc.utf8_length(words.filter(closed)).to_pylist()
            marks = pa.array([c[n:] for c, n in zip(_strings(chunks.filter(closed)), size, strict=True)], pa.string()).dictionary_encode()
            marks = self._held(marks.dictionary.to_pylist(), self._each).take(marks.indices)
            has = closed.filter(plain)
            found = pc.replace_with_mask(found, has, pc.binary_join_element_wise(found.filter(has), marks, pa.scalar(b"", pa.large_binary())))
        rest = pc.invert(plain)
        others = self._held(_strings(chunks.filter(rest)), self._each)
        order = np.argsort(rest.to_numpy(zero_copy_only=False), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return pa.concat_arrays([found, others]).take(pa.array(place))

    def encode(self, texts: list[bytes | None] | pa.Array) -> Iterator[bytes]:
        """The ids of every text, in order; null counts as empty."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary()), b"")
        ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
        at = 0
        while at < len(texts):
            begin = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, begin + TOGETHER)))
            yield from self._encoded(texts.slice(at, stop - at))
            give_back()
            at = stop

    def _encoded(self, texts: pa.Array) -> Iterator[bytes]:
        whole = {}
        for i in {i for token in self._special for i in pc.indices_nonzero(pc.match_substring(texts, token)).to_pylist()}:
            whole[i] = self._plain(texts[i].as_py())
        if whole:
            texts = pa.array([b"" if i in whole else text for i, text in enumerate(texts.to_pylist())], pa.binary())
        chunks = pc.ascii_split_whitespace(texts.cast(pa.binary()).view(pa.string()))
        distinct = chunks.values.dictionary_encode()
        ids = self._ids(distinct.dictionary).take(distinct.indices)
        edges = np.frombuffer(ids.buffers()[1], np.int64)[chunks.offsets.to_numpy()] if len(ids) else np.zeros(len(texts) + 1, np.int64)
        data = memoryview(ids.buffers()[2] or b"")
        for i, (lo, hi) in enumerate(zip(edges.tolist(), edges[1:].tolist(), strict=False)):
            yield whole[i] if i in whole else bytes(data[lo:hi])

    def _plain(self, text: bytes) -> bytes:
        ids = self._tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
        return b"".join([self._bytes_of[i] for i in ids])


def encoder(vocabulary: str = VOCABULARY) -> ChunkEncoder:
    """One encoder per worker process."""
    return worker_cache(f"encoder {vocabulary}", lambda: ChunkEncoder(vocabulary))
