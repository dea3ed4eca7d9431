"""Token ids as Simple-8b words with escapes and offsets for each block."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import VOCABULARY, codec, vocabulary
from .shared import by_bytes, in_arrow, plain
from .words import U

BLOCK = 512
#: Ids in a word and bits of each, by selector; 0 is an escape: the word's low bits number the block's raw word.
COUNTS = np.array([1, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
WIDTHS = np.array([60, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
_GAP = 60


def _bit_length(ids: np.ndarray) -> np.ndarray:
    out = np.zeros(len(ids), np.uint8)
    top = int(ids.max()) if len(ids) else 0
    for b in range(top.bit_length()):
        out += ids >= U(1 << b)
    return out


def encode(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, bounds, offsets, raws) of many id sequences: ids[at[i]:at[i + 1]] is the i-th.

    Words of sequence i are words[bounds[i]:bounds[i + 1]]. ids fall into blocks of BLOCK that share no word; block j
    of a sequence begins at offsets, counted within the sequence's words, and its raw words begin at raws. offsets and
    raws lie in order of sequence; there are ceil(n / BLOCK) for n ids. A word takes as many ids as fit it.
    """
    ids = ids.astype(U)
    sizes = np.diff(at)
    blocks = -(-sizes // BLOCK)
    total = int(blocks.sum())
    whose = np.repeat(np.arange(len(sizes)), blocks)
    nth = np.arange(total) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    length = np.minimum(sizes[whose] - nth * BLOCK, BLOCK)
    row = BLOCK + _GAP
    flat = np.zeros(total * row + _GAP, U)
    flat[:-_GAP].reshape(total, row)[:, :BLOCK][np.arange(BLOCK) < length[:, None]] = ids
    bits = _bit_length(flat)
    # highest bit length among the next 1, 2, 4, ... ids
    peaks = {1: bits}
    for p in (1, 2, 4, 8, 16):
        last = peaks[p]
        peaks[2 * p] = last.copy()
        np.maximum(last[:-p], last[p:], out=peaks[2 * p][:-p])
    selector = np.ones(len(bits), np.uint8)
    selector[bits > 60] = 0
    for s in range(2, len(COUNTS)):
        n, width = int(COUNTS[s]), int(WIDTHS[s])
        p = 1 << (n.bit_length() - 1)
        fits = peaks[p] <= width
        if n > p:
            fits[: len(bits) - (n - p)] &= peaks[p][n - p :] <= width
        selector[fits] = s
    step = COUNTS[selector]
    heads, place = [], np.arange(total) * row
    live, ends = np.arange(total), np.arange(total) * row + length
    owner = []
    while len(live):
        heads.append(place[live])
        owner.append(live)
        place[live] += step[place[live]]
        live = live[place[live] < ends[live]]
    head = np.concatenate(heads) if heads else np.zeros(0, np.int64)
    block = np.concatenate(owner) if owner else np.zeros(0, np.int64)
    order = np.argsort(head, kind="stable")
    head, block = head[order], block[order]
    kind = selector[head]
    word = kind.astype(U) << U(60)
    for s in range(1, len(COUNTS)):
        those = np.flatnonzero(kind == s)
        if len(those):
            acc = np.zeros(len(those), U)
            for j in range(int(COUNTS[s])):
                acc |= flat[head[those] + j] << U(j * int(WIDTHS[s]))
            word[those] |= acc
    escaped = kind == 0
    mains = np.bincount(block, minlength=total)
    extra = np.bincount(block[escaped], minlength=total)
    begins = np.cumsum(mains + extra) - (mains + extra)
    main_at = begins[block] + np.arange(len(head)) - np.repeat(np.cumsum(mains) - mains, mains)
    words = np.zeros(int((mains + extra).sum()), U)
    if escaped.any():
        number = np.arange(int(escaped.sum())) - (np.cumsum(extra) - extra)[block[escaped]]
        word[escaped] |= number.astype(U)
        words[begins[block[escaped]] + mains[block[escaped]] + number] = flat[head[escaped]]
    words[main_at] = word
    per = np.bincount(whose, mains + extra, len(sizes)).astype(np.int64)
    bounds = np.append(0, np.cumsum(per))
    offsets = begins - bounds[whose]
    return words, bounds, offsets, offsets + mains


def decode(words: np.ndarray, n: int, offsets: np.ndarray, raws: np.ndarray) -> np.ndarray:
    """The ``n`` ids of one sequence, all words at once: selectors give counts, counts give places."""
    blocks = len(offsets)
    if not blocks:
        return np.zeros(0, U)
    main = np.zeros(len(words) + 1, np.int64)
    np.add.at(main, offsets, 1)
    np.add.at(main, raws, -1)
    keep = np.cumsum(main)[:-1] > 0
    places = np.flatnonzero(keep)
    block = np.searchsorted(offsets, places, side="right") - 1
    word = words[places]
    kind = (word >> U(60)).astype(np.int64)
    counts = COUNTS[kind]
    before = np.cumsum(counts) - counts
    first = np.searchsorted(block, np.arange(blocks))
    start = block * BLOCK + before - before[first][block]
    out = np.zeros(blocks * BLOCK + _GAP, U)
    for s in range(len(COUNTS)):
        those = np.flatnonzero(kind == s)
        if not len(those):
            continue
        if s == 0:
            out[start[those]] = words[raws[block[those]] + (word[those] & U((1 << 60) - 1)).astype(np.int64)]
            continue
        for j in range(int(COUNTS[s])):
            # a block's last word may have more room than ids; what it holds beyond them is zero
            value = word[those] >> U(j * int(WIDTHS[s])) & U((1 << int(WIDTHS[s])) - 1)
            inside = start[those] + j < np.minimum((block[those] + 1) * BLOCK, n)
            out[start[those][inside] + j] = value[inside]
    return out[:n]


def _coded(blob, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = codec(blob.value)
    for batch in by_bytes(batches, "text", 1 << 20):
        text = batch.column("text")
        ids, at = own.encode_many(text)
        words, bounds, offsets, raws = encode(ids, at)
        mask = pa.array(text.is_null())
        blocks = np.append(0, np.cumsum(-(-np.diff(at) // BLOCK)))
        lists = [pa.ListArray.from_arrays(pa.array(blocks, pa.int32()), pa.array(x, pa.int32()), mask=mask) for x in (offsets, raws)]
        data = pa.Array.from_buffers(pa.large_binary(), len(text), [None, pa.py_buffer(bounds * 8), pa.py_buffer(words.astype("<u8"))]).cast(pa.binary())
        n = pa.array(np.diff(at), pa.int32())
        if text.null_count:
            data = pa.compute.if_else(mask, pa.scalar(None, pa.binary()), data)
            n = pa.compute.if_else(mask, pa.scalar(None, pa.int32()), n)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, data, *lists], ["doc_id", "n_tokens", "words", "offsets", "raws"])


def token_output(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, words, offsets, raws): each text's BPE ids as little-endian Simple-8b words.

    ``decode`` gives the ids back. ``offsets`` says at which word each block of BLOCK ids begins, ``raws`` where its
    escaped ids (60 bits or more) lie as raw words, so any block is decoded by itself and all its words at once. A
    null text gives nulls, an empty one no words, a very long one as many blocks as it takes; a null doc_id and repeated rows pass through, one row each; further
    columns are ignored; an empty table gives an empty result. One pass, no exchange.
    """
    rows = docs.select(plain(docs, "doc_id", "bigint").alias("doc_id"), plain(docs, "text", "string").alias("text"))
    return in_arrow(rows, partial(_coded, vocabulary(docs, path)), "doc_id bigint, n_tokens int, words binary, offsets array<int>, raws array<int>")
