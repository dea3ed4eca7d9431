"""Tokens of many texts at once from Arrow buffers, with UTF-16 positions, without an exchange or a sort of rows."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LONGEST = 255


class Spans(NamedTuple):
    doc: np.ndarray  # index of the text, ascending
    token: pa.Array
    position: np.ndarray  # UTF-16 code units from the start of the text


def _raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and byte offsets of a string array; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def _units(data: np.ndarray) -> np.ndarray:
    """UTF-16 code units before each byte, one more at the end: a sequence counts at its first byte."""
    wide = np.ones(len(data), np.int8)
    wide[data >= 0xF0] = 2
    wide[(data & 0xC0) == 0x80] = 0
    return np.append(0, np.cumsum(wide, dtype=np.int64))


def _taken(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The byte ranges as strings."""
    ends = np.append(0, np.cumsum(size))
    place = np.repeat(start - ends[:-1], size) + np.arange(int(ends[-1]))
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[place])])


def _blank(data: np.ndarray) -> np.ndarray:
    """Bytes that belong to a white-space character, as text.WHITESPACE says."""
    n = len(data)
    out = ((data >= 9) & (data <= 13)) | ((data >= 28) & (data <= 32))
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if len(lead):
        a, b, c = (data[np.minimum(lead + i, n - 1)] for i in range(3))
        two = (a == 0xC2) & (b == 0xA0)
        three = (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        three |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        for i in range(3):
            out[lead[three] + i] = True
            if i < 2:
                out[lead[two] + i] = True
    return out


def whitespace_spans(texts: pa.Array) -> Spans:
    """Runs of anything but white space of fewer than 256 UTF-16 units."""
    data, at = _raw(texts)
    n = len(data)
    if not n:
        return Spans(np.zeros(0, np.int64), pa.array([], pa.large_string()), np.zeros(0, np.int64))
    mask = ~_blank(data)
    bounds = at[:-1][at[1:] > at[:-1]]
    before, after = np.append(False, mask[:-1]), np.append(mask[1:], False)
    before[bounds] = False
    after[bounds[1:] - 1] = False
    start, end = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    doc = np.repeat(np.arange(len(at) - 1), np.diff(np.searchsorted(start, at)))
    units = _units(data)
    short = units[end] - units[start] <= LONGEST
    doc, start, end = doc[short], start[short], end[short]
    return Spans(doc, _taken(data, start, end - start), units[start] - units[at[doc]])


def trigram_spans(texts: pa.Array) -> Spans:
    """Every three neighbouring code points."""
    data, at = _raw(texts)
    chars = np.flatnonzero((data & 0xC0) != 0x80)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(np.searchsorted(chars, at)))
    ends = np.append(chars[1:], len(data))
    if len(chars) < 3:
        return Spans(np.zeros(0, np.int64), pa.array([], pa.large_string()), np.zeros(0, np.int64))
    whole = np.flatnonzero(doc[:-2] == doc[2:])
    start, doc = chars[whole], doc[whole]
    units = _units(data)
    return Spans(doc, _taken(data, start, ends[whole + 2] - start), units[start] - units[at[doc]])


def grouped(spans: Spans) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(doc, token, ascending positions) of each distinct token of each text."""
    if not len(spans.doc):
        return spans.doc, spans.token, pa.array([], pa.list_(pa.int32()))
    coded = spans.token.dictionary_encode()
    code = coded.indices.to_numpy()
    key = spans.doc.astype(np.int64) * len(coded.dictionary) + code
    order = np.argsort(key, kind="stable")  # spans come by position
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(spans.position[order], pa.int32()))
    return spans.doc[order][first], coded.dictionary.take(pa.array(code[order][first])), lists


def _widths(texts: pa.Array) -> np.ndarray:
    """UTF-16 code units of each string."""
    data, at = _raw(texts)
    return np.diff(_units(data)[at])


def alternating(gaps: pa.ListArray, found: pa.ListArray | None, width: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) of each match of texts that are given as widths of the ``gaps`` between matches and what was
    ``found``, or by gaps alone if all matches are ``width`` UTF-16 units wide. A row of n gaps has n - 1 matches; a
    null row has none."""
    counts = pc.fill_null(pc.list_value_length(gaps), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    hits = np.maximum(counts - 1, 0)
    row = np.repeat(np.arange(len(gaps)), hits)
    first = np.cumsum(counts) - counts
    nth = np.arange(len(row)) - np.repeat(np.cumsum(hits) - hits, hits)
    before = gaps.flatten().to_numpy(zero_copy_only=False).astype(np.int64)[first[row] + nth]
    own = np.full(len(row), width, np.int64) if found is None else _widths(found.flatten())
    ends = np.cumsum(before + own)
    base = np.append(0, ends)[np.cumsum(hits) - hits]
    return row, ends - own - base[row]
