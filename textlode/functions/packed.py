"""Postings of many documents in one row, as differences in variable-length integers: what is exchanged and sorted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..workers import byte_sizes, sliced

#: ``doc_id`` is the first document of the row; ``docs`` has each document's distance from the one before and its
#: number of positions, ``places`` the positions as a first one and differences.
PACKED = "tok string, doc_id bigint, docs binary, places binary"
#: Bytes of packed rows that are unpacked together.
AT_ONCE = 1 << 18


def coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each number begins and the end) of numbers, seven bits a byte, lowest first."""
    rest = values.astype(np.int64).view(np.uint64)
    size, more = np.ones(len(rest), np.int64), rest >> np.uint64(7)
    while more.any():
        size += more > 0
        more >>= np.uint64(7)
    at = np.append(0, np.cumsum(size))
    out = np.empty(int(at[-1]), np.uint8)
    for i in range(int(size.max(initial=0))):
        long = np.flatnonzero(size > i)
        out[at[long] + i] = (rest[long] >> np.uint64(7 * i)) & np.uint64(0x7F) | np.where(size[long] > i + 1, 0x80, 0).astype(np.uint64)
    return out, at


def decoded(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 0x80)
    starts = np.append(0, ends[:-1] + 1) if len(ends) else ends
    size = ends - starts + 1
    out = np.zeros(len(ends), np.uint64)
    for i in range(int(size.max(initial=0))):
        long = np.flatnonzero(size > i)
        out[long] |= (data[starts[long] + i] & 0x7F).astype(np.uint64) << np.uint64(7 * i)
    return out.view(np.int64)


def _differences(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Differences between neighbours; those at ``first`` stay as they are."""
    out = np.diff(values, prepend=0)
    out[first] = values[first]
    return out


def _sums(values: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Running sums that begin anew at ``first``, each over ``counts`` numbers."""
    sums = np.cumsum(values)
    return sums - np.repeat(sums[first] - values[first], counts)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary array without nulls."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (tok, doc_id, ascending positions) as one row for each token of a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        tokens = batch.column("tok").dictionary_encode()
        code, doc = tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64), batch.column("doc_id").to_numpy(zero_copy_only=False)
        order = np.lexsort((doc, code))
        code, doc = code[order], doc[order]
        lists = batch.column("positions").take(pa.array(order))
        counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        distance = _differences(doc, row)
        distance[row] = 0
        docs, at = coded(np.stack([distance, counts], axis=1).ravel())
        ends = np.append(0, np.cumsum(counts))
        places, place_at = coded(_differences(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), ends[:-1][counts > 0]))
        edge = np.append(row, len(doc))
        yield pa.RecordBatch.from_arrays(
            [tokens.dictionary.take(pa.array(code[row])).cast(pa.string()), pa.array(doc[row]), _binary(docs, at[2 * edge]), _binary(places, place_at[ends[edge]])], ["tok", "doc_id", "docs", "places"]
        )


def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tok, doc_id, positions) again, in the order of the rows."""
    for batch in batches:
        for part in sliced(batch, byte_sizes(batch.column("docs")) + byte_sizes(batch.column("places")), AT_ONCE):
            data, at = _bytes(part.column("docs"))
            pairs = decoded(data).reshape(-1, 2)
            held = np.diff(np.append(0, np.cumsum(data < 0x80))[at]) // 2
            distance, counts = pairs[:, 0].copy(), pairs[:, 1]
            row = np.cumsum(held) - held
            distance[row] = part.column("doc_id").to_numpy(zero_copy_only=False)
            doc = _sums(distance, row, held)
            ends = np.append(0, np.cumsum(counts))
            some = counts > 0
            positions = _sums(decoded(_bytes(part.column("places"))[0]), ends[:-1][some], counts[some])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(positions, pa.int32()))
            tokens = part.column("tok").take(pa.array(np.repeat(np.arange(part.num_rows), held)))
            yield pa.RecordBatch.from_arrays([tokens, pa.array(doc), lists], ["tok", "doc_id", "positions"])
