"""Byte-level BPE: encoding with tree concatenation of long unsplit pieces, and decoding."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from .shared import by_bytes, in_arrow, plain
from .words import SAME, HashIndex, U, raw, words

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of an unsplit piece that are encoded at once, tokens on each side of a join that are encoded first.
LEAF, REACH = 2048, 8
#: Words whose ids a worker remembers; longer words than LONG_WORD bytes are encoded each time.
REMEMBERED, LONG_WORD = 1_000_000, 64

NO_SPACE = np.arange(256) != 32
CHECK = np.random.default_rng(17).integers(0, 1 << 63, 256, dtype=U) | U(1)
_CODECS: dict[str, Codec] = {}
_POOL: list[ThreadPoolExecutor] = []


def joined(left: list[int], right: list[int], encode: Callable[[bytes], list[int]], tokens: list[bytes], reach: int = REACH) -> list[int]:
    """Ids of the concatenation of two texts, given each one's ids.

    The last and first ``reach`` tokens around the join are encoded anew; if the outermost tokens come out as they
    were, on both sides, they fit their neighbours as before, and the rest stands. Else the window doubles; a side
    that it covers whole needs no agreement.
    """
    if not left or not right:
        return left + right
    while True:
        a, b = left[-reach:], right[:reach]
        fresh = encode(b"".join([tokens[i] for i in a] + [tokens[i] for i in b]))
        if (len(a) == len(left) or fresh[0] == a[0]) and (len(b) == len(right) or fresh[-1] == b[-1]):
            return left[: len(left) - len(a)] + fresh + right[len(b) :]
        reach *= 2


class Codec:
    """One vocabulary: ``blob`` is a file of base64 tokens and ranks."""

    def __init__(self, blob: bytes):
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, blob.splitlines())}
        self.bpe = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(x) for x in self.tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.memory = _Memory()
        self.split = regex.compile(PATTERN)

    def piece(self, text: str, leaf: int = LEAF) -> list[int]:
        """Ids of a piece that the pattern doesn't split: a tree of halves, each level's halves in parallel."""
        if len(text) <= leaf:
            return self.bpe.encode_ordinary(text)
        parts = [text[i : i + leaf] for i in range(0, len(text), leaf)]
        if not _POOL:
            _POOL.append(ThreadPoolExecutor(2))
        level = list(_POOL[0].map(self.bpe.encode_ordinary, parts))
        again = self.bpe._core_bpe.encode_single_piece
        while len(level) > 1:
            pairs = [(level[i], level[i + 1] if i + 1 < len(level) else []) for i in range(0, len(level), 2)]
            level = [joined(a, b, again, self.tokens) for a, b in pairs]
        return level[0]

    def plain(self, text: str) -> list[int]:
        """Ids of any text; its long unsplit pieces go through the tree."""
        if len(text) <= LEAF:
            return self.bpe.encode_ordinary(text)
        out: list[int] = []
        start = 0
        for m in self.split.finditer(text):
            if m.end() - m.start() > LEAF:
                # up to a piece's end the text splits as it does within the whole
                out += self.bpe.encode_ordinary(text[start : m.start()])
                out += self.piece(m.group())
                start = m.end()
        return out + self.bpe.encode_ordinary(text[start:])

    def encode_many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): all ids in a row, and where each text's begin (one more at the end).

        A single space between two visible characters always begins a piece, so words are encoded each by itself, all
        of a batch at once and each distinct one once; texts with other spaces are encoded whole.
        """
        data, at = raw(texts)
        n = len(texts)
        odd = _odd(data, at)
        w = words(texts, NO_SPACE, SAME)
        size = w.end - w.start
        first = np.append(True, w.doc[1:] != w.doc[:-1]) if len(w.doc) else np.zeros(0, bool)
        weights = np.append(U(0), np.cumsum(CHECK[data], dtype=U))
        check = weights[w.end] - weights[w.start]
        easy = ~first & (size < LONG_WORD) & ~odd[w.doc]
        row = np.full(len(w.doc), -1, np.int64)
        row[easy] = self.memory.find(w.hash[easy], check[easy])
        new = np.flatnonzero(easy & (row < 0))
        known = self.memory.size
        if len(new):
            _, one, back = np.unique(w.hash[new], return_index=True, return_inverse=True)
            one = new[one]
            same = (check[one][back] == check[new]) & (size[one][back] == size[new])
            row[new] = np.where(same, known + back, -1)
            fresh, counts = self._fresh(data, w.start[one], size[one])
            ids, lens = np.concatenate([self.memory.ids, fresh]), np.concatenate([self.memory.counts, counts])
        else:
            ids, lens = self.memory.ids, self.memory.counts
        lone = np.flatnonzero((row < 0) & ~odd[w.doc])
        extra = [self.plain(bytes(data[s - (not f) : e]).decode("utf-8", "replace")) for s, e, f in zip(w.start[lone].tolist(), w.end[lone].tolist(), first[lone].tolist())]
        whole = np.flatnonzero(odd)
        rest = [self.plain(bytes(data[at[i] : at[i + 1]]).decode("utf-8", "replace")) for i in whole.tolist()]
        base = len(lens)
        row[lone] = base + np.arange(len(lone))
        # a text encoded whole is one word
        use = ~odd[w.doc]
        doc, row = np.concatenate([w.doc[use], whole]), np.concatenate([row[use], base + len(lone) + np.arange(len(whole))])
        if len(whole):
            order = np.argsort(doc, kind="stable")
            doc, row = doc[order], row[order]
        lists = extra + rest
        ids = np.concatenate([ids, np.fromiter(chain.from_iterable(lists), np.int32)])
        lens = np.concatenate([lens, np.fromiter(map(len, lists), np.int64, len(lists))])
        begins = np.cumsum(lens) - lens
        took = lens[row]
        ends = np.cumsum(took)
        out = ids[np.repeat(begins[row] - (ends - took), took) + np.arange(int(ends[-1]) if len(ends) else 0)]
        if len(new):
            self.memory.add(w.hash[one], check[one], fresh, counts)
        return out, np.append(0, np.cumsum(np.bincount(doc, took, n))).astype(np.int64)

    def _fresh(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each after a space, in one call: their bytes tell where each word's ids end."""
        take = size + 1
        ends = np.cumsum(take)
        place = np.repeat(start - 1 - (ends - take), take) + np.arange(int(ends[-1]))
        ids = np.array(self.bpe.encode_ordinary(data[place].tobytes().decode("utf-8", "replace")), np.int32)
        until = np.searchsorted(np.cumsum(self.lengths[ids]), ends, side="left") + 1
        return ids, np.diff(np.append(0, until))

    def decode_many(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """Texts of (ids, offsets); malformed UTF-8, which only ids that no text has can give, is replaced."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        place = np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        data = self.bytes[place]
        bounds = np.append(0, ends)[at].astype(np.int64)
        out = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        try:
            return out.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in out.to_pylist()], pa.string())


class _Memory:
    """Ids of words that followed a space, found by two hashes of their bytes; it stops growing at REMEMBERED."""

    def __init__(self):
        self.size = 0
        self.check, self.row = np.zeros(0, U), np.zeros(0, np.int64)
        self.index = HashIndex(np.zeros(0, U))
        self.ids, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, ...]] = []

    def find(self, hashes: np.ndarray, check: np.ndarray) -> np.ndarray:
        if not self.size:
            return np.full(len(hashes), -1, np.int64)
        at = self.index.find(hashes)
        return np.where((at >= 0) & (self.check[at] == check), self.row[at], -1)

    def add(self, hashes: np.ndarray, check: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        if self.size >= REMEMBERED:
            return
        self.waiting.append((hashes, check, ids, counts))
        if sum(len(x[0]) for x in self.waiting) < max(20_000, self.size // 6):
            return
        hashes, check, ids, counts = (np.concatenate(x) for x in zip(*self.waiting))
        self.waiting = []
        hashes, one = np.unique(hashes, return_index=True)
        begins = (np.cumsum(counts) - counts)[one]
        check, counts = check[one], counts[one]
        ends = np.cumsum(counts)
        ids = ids[np.repeat(begins - (ends - counts), counts) + np.arange(int(ends[-1]))]
        fresh = self.index.find(hashes) < 0 if self.size else np.ones(len(hashes), bool)
        keys = np.concatenate([self.index.keys, hashes[fresh]])
        order = np.argsort(keys, kind="stable")
        row = np.concatenate([self.row, self.size + np.flatnonzero(fresh)])[order]
        self.index, self.row, self.check = HashIndex(keys[order]), row, np.concatenate([self.check, check[fresh]])[order]
        self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        self.size += len(hashes)


def _odd(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which texts have a space beside other white space or at an end, or white space beyond ASCII."""
    n, size = len(at) - 1, len(data)
    out = np.zeros(n, bool)
    if not size:
        return out
    low = data <= 32
    low[127 == data] = True
    beside = np.zeros(size, bool)
    beside[1:] = low[1:] & low[:-1]
    beside &= (data == 32) | (np.append(0, data[:-1]) == 32)
    full = at[1:] > at[:-1]
    edge = np.concatenate([at[:-1][full], at[1:][full] - 1])
    beside[edge] |= data[edge] == 32
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if len(lead):
        a, b, c = (data[np.minimum(lead + i, size - 1)] for i in range(3))
        beside[lead] |= (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        beside[lead] |= (a == 0xE1) & (b == 0x9A) | (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        beside[lead] |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    out[np.searchsorted(at, np.flatnonzero(beside), side="right") - 1] = True
    return out


def codec(blob: bytes) -> Codec:
    key = hashlib.sha256(blob).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(blob)
    return _CODECS[key]


def _tokens(blob, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = codec(blob.value)
    for batch in by_bytes(batches, "text", 1 << 20):
        text = batch.column("text")
        ids, at = own.encode_many(text)
        mask = pa.array(text.is_null())
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()), mask=mask)
        back = own.decode_many(ids, at)
        if text.null_count:
            back = pa.compute.if_else(mask, pa.scalar(None, pa.string()), back)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.compute.list_value_length(lists), lists, back], ["doc_id", "n_tokens", "ids", "decoded"])


def vocabulary(docs: DataFrame, path: str):
    """The vocabulary file, of fixed size, as a broadcast variable."""
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def bpe(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): each text's byte-level BPE ids and the text decoded from them.

    Ids equal those of encoding the whole text at once. A null text gives nulls, an empty one no ids and an empty
    text; a null doc_id and repeated rows pass through, one row each; a very long text is encoded as a whole, by
    the tree where it has long unsplit pieces; further columns are ignored; an empty table gives an empty result. The work is one pass over the texts without an exchange.
    """
    rows = docs.select(plain(docs, "doc_id", "bigint").alias("doc_id"), plain(docs, "text", "string").alias("text"))
    return in_arrow(rows, partial(_tokens, vocabulary(docs, path)), "doc_id bigint, n_tokens int, ids array<int>, decoded string")
