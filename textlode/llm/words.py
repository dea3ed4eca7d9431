"""Words of many texts at once, hashed straight from Arrow buffers with numpy."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SEGMENT = 1 << 18


class Words(NamedTuple):
    doc: np.ndarray  # index of the text in the batch, ascending
    start: np.ndarray  # byte offsets within the batch
    end: np.ndarray
    hash: np.ndarray  # uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; those of a segment are kept, longer ones are made for the one word."""
    if n <= _SEGMENT and _POWERS:
        return _POWERS[0], _POWERS[1]
    n, out = max(n, _SEGMENT), []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, base, U)
        steps[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.cumprod(steps, out=steps))
    if n == _SEGMENT:
        _POWERS[:] = out
    return out[0], out[1]


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    alnum = np.zeros(256, bool)
    alnum[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    inked = np.zeros(256, bool)
    inked[33:] = True
    inked[127] = False
    same = np.arange(1, 257).astype(U)
    fold = same.copy()
    fold[65:91] = same[97:123]
    return alnum, inked, same, fold


ALNUM, INKED, SAME, FOLD = _tables()


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1, from 0) of a string or binary array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_null(texts.type):
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def words(texts: pa.Array, inside: np.ndarray = ALNUM, value: np.ndarray = FOLD) -> Words:
    """Runs of bytes that ``inside`` marks, hashed by ``value`` of their bytes.

    ALNUM with FOLD: runs of ASCII letters and digits and of all non-ASCII characters, ASCII case folded.
    INKED with SAME: runs of anything but ASCII white space and control characters.
    """
    data, at = raw(texts)
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, U))
    mask = inside[data]
    bounds = at[:-1][at[1:] > at[:-1]]  # first bytes of texts that have any
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = mask[:-1]
    before[bounds] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = mask[1:]
    after[bounds[1:] - 1] = False
    ends = np.flatnonzero(mask & ~after) + 1
    hashes = np.empty(len(starts), U)
    lo = first = 0
    while first < len(starts):
        lo = int(starts[first])
        last = int(np.searchsorted(ends, lo + _SEGMENT, side="right"))
        last = max(last, first + 1)  # a word longer than a segment is hashed whole
        hi = int(ends[last - 1])
        up, down = _powers(hi - lo)
        sums = np.empty(hi - lo + 1, U)
        sums[0] = 0
        np.cumsum(value[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        s, e = starts[first:last] - lo, ends[first:last] - lo
        hashes[first:last] = (sums[e] - sums[s]) * down[s]
        first = last
    doc = np.repeat(np.arange(len(at) - 1), np.diff(np.searchsorted(starts, at)))
    return Words(doc, starts, ends, mix(hashes ^ (ends - starts).astype(U)))


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) of each run of ``size`` words; a text of fewer words, but one at least, has one run of them all."""
    n = len(w.doc)
    if not n:
        return w.doc, w.hash
    counts = np.bincount(w.doc)
    if size == 1:
        return w.doc, w.hash
    own = n - size + 1
    docs, out = [], []
    if own > 0:
        acc = np.zeros(own, U)
        for i in range(size):
            acc = mix(acc + w.hash[i : i + own] * U(2 * i + 3))
        keep = w.doc[:own] == w.doc[size - 1 :]
        docs.append(w.doc[:own][keep])
        out.append(acc[keep])
    few = np.flatnonzero((counts > 0) & (counts < size))
    if len(few):
        first = np.searchsorted(w.doc, few)
        acc = np.zeros(len(few), U)
        for i in range(size - 1):
            there = counts[few] > i
            acc = np.where(there, mix(acc + w.hash[np.minimum(first + i, n - 1)] * U(2 * i + 3)), acc)
        docs.append(few)
        out.append(acc)
    return np.concatenate(docs), np.concatenate(out)


class HashIndex:
    """Sorted uint64 keys of a good hash with a directory by their first bits; finds many at once."""

    def __init__(self, keys: np.ndarray, starts: np.ndarray | None = None):
        """``starts``: the directory of an index of these keys, if one has been made."""
        self.keys = keys
        self.bits = max(1, int(len(keys)).bit_length())
        if starts is None:
            held = np.bincount((keys >> U(64 - self.bits)).astype(np.int64), minlength=1 << self.bits)
            starts = np.append(0, np.cumsum(held)).astype(np.int32 if len(keys) < 1 << 31 else np.int64)
        self.starts = starts

    def find(self, asked: np.ndarray) -> np.ndarray:
        """Places of the keys asked for, -1 where there is none."""
        bucket = (asked >> U(64 - self.bits)).astype(np.int64)
        at, stop = self.starts[bucket], self.starts[bucket + 1]
        found = np.full(len(asked), -1, np.int64)
        open_ = np.flatnonzero(at < stop)
        at = at[open_]
        while len(open_):
            hit = self.keys[at] == asked[open_]
            found[open_[hit]] = at[hit]
            more = ~hit & (at + 1 < stop[open_])
            open_, at = open_[more], at[more] + 1
        return found
