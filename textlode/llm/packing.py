"""Packing of documents' token ids into windows, online and with bounded space."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import VOCABULARY, codec, vocabulary
from .shared import by_bytes, in_arrow, plain, written

#: Token ids of a window, open windows of a task, leftover windows that a task merges, the id after each text: the one
#: beyond the vocabulary's own.
WINDOW, OPEN, LEFTOVERS, SEPARATOR = 8192, 64, 1024, 50_256
#: Token ids in a batch that goes back; bytes of a row group of stored windows.
AT_ONCE, BLOCK = 1 << 18, 4 << 20
PACKED = "window bigint, fill int, doc_ids array<bigint>, starts array<int>, lengths array<int>, ids array<int>, open boolean"
NAMES = ["window", "fill", "doc_ids", "starts", "lengths", "ids", "open"]


class Piece(NamedTuple):
    """What is placed as a whole: stretches of texts and their ids."""

    doc_ids: list[int | None]
    starts: list[int]
    lengths: list[int]
    ids: list[np.ndarray]
    size: int


class Packer:
    """At most ``keep`` open windows. A piece goes where it leaves the least room; if it fits nowhere and no more may be
    open, the fullest window is emitted and a new one opened. A full window is emitted at once."""

    def __init__(self, window: int, keep: int):
        self.window, self.keep = window, keep
        self.room: list[tuple[int, int]] = []  # (free, window), least free first
        self.held: dict[int, list[Piece]] = {}
        self.number = 0
        self.done: list[tuple[int, list[Piece], bool]] = []

    def _emit(self, name: int, open_: bool = False) -> None:
        self.done.append((name, self.held.pop(name), open_))

    def add(self, piece: Piece) -> None:
        i = bisect_left(self.room, (piece.size, -1))
        if i < len(self.room):
            free, name = self.room.pop(i)
        else:
            if len(self.room) >= self.keep and piece.size < self.window:
                self._emit(self.room.pop(0)[1])
            free, name = self.window, self.number
            self.number += 1
            self.held[name] = []
        self.held[name].append(piece)
        free -= piece.size
        if free:
            insort(self.room, (free, name))
        else:
            self._emit(name)

    def close(self) -> None:
        for _, name in self.room:
            self._emit(name, True)
        self.room = []

    def taken(self) -> list[tuple[int, list[Piece], bool]]:
        out, self.done = self.done, []
        return out


def _batches(packer: Packer, pieces: Iterator[Piece], base: int) -> Iterator[pa.RecordBatch]:
    """Windows as they are emitted, some AT_ONCE ids together."""
    held: list[tuple[int, list[Piece], bool]] = []
    size = 0

    def out() -> pa.RecordBatch:
        rows = [(base + name, Piece(*(list(chain.from_iterable(getattr(p, c) for p in own)) for c in Piece._fields[:4]), sum(p.size for p in own)), open_) for name, own, open_ in held]
        held.clear()
        lists = [pa.array([getattr(p, c) for _, p, _ in rows], pa.list_(kind)) for c, kind in (("doc_ids", pa.int64()), ("starts", pa.int32()), ("lengths", pa.int32()))]
        at = np.append(0, np.cumsum([p.size for _, p, _ in rows])).astype(np.int32)
        ids = np.concatenate([x for _, p, _ in rows for x in p.ids]).astype(np.int32)
        columns = [pa.array([name for name, _, _ in rows], pa.int64()), pa.array(np.diff(at)), *lists, pa.ListArray.from_arrays(pa.array(at), pa.array(ids)), pa.array([open_ for _, _, open_ in rows])]
        return pa.RecordBatch.from_arrays(columns, NAMES)

    for piece in pieces:
        packer.add(piece)
        for window in packer.taken():
            held.append(window)
            size += sum(p.size for p in window[1])
        if size >= AT_ONCE:
            yield out()
            size = 0
    packer.close()
    held += packer.taken()
    if held:
        yield out()


def pieces_of(doc_id: int | None, ids: np.ndarray, window: int) -> Iterator[Piece]:
    """A text's ids in pieces of ``window``, the last one shorter."""
    for at in range(0, len(ids), window):
        part = ids[at : at + window]
        yield Piece([doc_id], [at], [len(part)], [part], len(part))


def _texts(blob, window: int, keep: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = codec(blob.value)

    def pieces() -> Iterator[Piece]:
        for batch in by_bytes(batches, "text", 1 << 20):
            ids, at = own.encode_many(batch.column("text"))
            for doc_id, i, j in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                if i < j:
                    yield from pieces_of(doc_id, np.append(ids[i:j], SEPARATOR).astype(np.int32), window)

    yield from _batches(Packer(window, keep), pieces(), TaskContext.get().partitionId() << 28)


def _leftovers(window: int, keep: int, round_: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def pieces() -> Iterator[Piece]:
        for batch in batches:
            ids = batch.column("ids")
            for k, (doc_ids, starts, lengths) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_ids", "starts", "lengths")))):
                yield Piece(doc_ids, starts, lengths, [ids[k].values.to_numpy()], len(ids[k]))

    yield from _batches(Packer(window, keep), pieces(), (round_ << 56) | (TaskContext.get().partitionId() << 28))


def pack(docs: DataFrame, window: int = WINDOW, keep: int = OPEN, leftovers: int = LEFTOVERS, path: str = VOCABULARY) -> DataFrame:
    """(window, fill, doc_ids, starts, lengths, ids): windows of at most ``window`` BPE token ids and what lies in them.

    A text is its ids and one SEPARATOR. The i-th stretch of a window is the ``lengths``[i] ids of document
    ``doc_ids``[i] from its id number ``starts``[i] on; the stretches' ids follow one another in ``ids``, ``fill`` in
    all. A text of more than a window is cut: its full pieces are windows of their own, its remainder is packed. Each
    task packs its texts as they come, by the rule of ``Packer`` with ``keep`` open windows. What is open at its end
    is merged in rounds, the fullest first and ``leftovers`` windows to a task, by the same rule, until one task holds
    all leftovers. So texts aren't exchanged; only leftovers are, at most ``keep`` windows of each task.

    A null or empty text has nothing to pack and is left out; a very long one is cut as said; a null doc_id and
    repeated rows are packed like others; of windows with the same room the older one is taken; further columns are
    ignored; an empty table gives an empty result.
    """
    if keep < 1 or leftovers < 2 * keep:
        raise ValueError("a merging task must take in twice the windows that it keeps open, so that rounds end")
    rows = docs.select(plain(docs, "doc_id", "bigint").alias("doc_id"), plain(docs, "text", "string").alias("text"))
    placed, _ = written(in_arrow(rows, partial(_texts, vocabulary(docs, path), window, keep), PACKED), "packed", BLOCK)
    done, round_, tasks = [placed.where("not open")], 0, 2
    while tasks > 1:
        left = placed.where("open")
        tasks, round_ = -(-left.count() // leftovers) or 1, round_ + 1
        laid = left.repartition(tasks, F.xxhash64("window")) if tasks > 1 else left.repartition(1)
        merged = in_arrow(laid.sortWithinPartitions(F.desc("fill"), "window"), partial(_leftovers, window, keep, round_), PACKED)
        placed, _ = written(merged, f"packed{round_}", BLOCK)
        done.append(placed if tasks == 1 else placed.where("not open"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("open")
