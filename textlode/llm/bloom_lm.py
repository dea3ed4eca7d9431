"""Language-model scores from n-gram counts of the whole corpus kept in a log-frequency Bloom filter."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_bytes, in_arrow, plain, stored_bytes, written
from .words import INKED, SAME, U, mix, raw, words

#: Counts are kept as levels, 1 + floor(log_BASE(count)); bits of filter for each (n-gram, level), hashes of each.
BASE, BITS, HASHES = 1.5, 8, 5
#: Weight of the unigram estimate, in occurrences of the word before; share of it that unknown words get.
ALPHA, UNSEEN = 40.0, 0.05
#: Text of one shard of the filter; grams that a task gathers before it hands them on; text that it looks at together,
#: and text whose grams it asks for together where the filter isn't broadcast.
SHARD_BYTES, GATHERED, AT_ONCE, ASKED_AT_ONCE = 8 << 20, 1_000_000, 1 << 20, 4 << 20
#: Shards beyond which they grow instead of becoming more, and how large they may grow.
SHARDS, LARGEST_SHARD = 4096, 128 << 20
#: Bytes of filter that may be broadcast; a larger one is probed where its shards lie.
BROADCAST = 192 << 20

_START = mix(np.array([0xABCD1234], U)) & ~U(1)


class Grams(NamedTuple):
    doc: np.ndarray
    one: np.ndarray  # even keys
    two: np.ndarray  # odd keys
    before: np.ndarray  # the word before, or the start mark


class Filter(NamedTuple):
    """Filters of several shards in one row of bytes: bits of each, and the bit at which each begins."""

    size: np.ndarray
    base: np.ndarray
    data: np.ndarray


def side_by_side(sizes: list[int], data: list[bytes]) -> Filter:
    ends = np.cumsum([0, *map(len, data)], dtype=U) * U(8)
    return Filter(np.array(sizes, U), ends[:-1], np.frombuffer(b"".join(data), np.uint8))


def grams(texts: pa.Array) -> Grams:
    """Keys of the words (runs between white space, case kept) and of the pairs that end in them."""
    w = words(texts, INKED, SAME)
    n = len(w.doc)
    one = mix(w.hash) & ~U(1)
    before = np.append(_START, one[:-1])[:n]
    before[np.append(True, w.doc[1:] != w.doc[:-1])[:n]] = _START[0]
    return Grams(w.doc, one, mix(before * U(3) + one) | U(1), before)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> U(32)) * U(shards) >> U(32)).astype(np.int64)


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with their sums."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _count(shards: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, keys, counts) of a task's texts, distinct within some GATHERED grams."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> pa.RecordBatch:
        keys, counts = merged(*(np.concatenate(x) for x in zip(*held)))
        held.clear()
        shard = shard_of(keys, shards)
        cuts = np.searchsorted(shard, np.arange(shards + 1))
        some = np.flatnonzero(np.diff(cuts))
        parts = [(keys[cuts[s] : cuts[s + 1]].tobytes(), counts[cuts[s] : cuts[s + 1]].astype(np.uint32).tobytes()) for s in some]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(x, pa.binary()) for x in zip(*parts))], ["shard", "keys", "counts"])

    for batch in by_bytes(batches, "text", AT_ONCE):
        g = grams(batch.column("text"))
        if not len(g.one):
            continue
        starts = np.full(len(np.unique(g.doc)), _START[0], U)
        keys = np.concatenate([g.one, g.two, starts])
        held.append(merged(keys, np.ones(len(keys), np.int64)))
        if sum(len(k) for k, _ in held) > GATHERED:
            yield out()
    if held:
        yield out()


def level(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(BASE) + 1e-9).astype(np.int64)


def expected(levels: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of those it holds; 0 for level 0."""
    low = np.ceil(BASE ** (levels - 1.0) - 1e-9)
    high = np.ceil(BASE ** (levels * 1.0) - 1e-9) - 1
    return np.where(levels > 0, np.maximum((low + np.maximum(high, low)) / 2, 1.0), 0.0)


def _hashes(keys: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(keys + U(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return h >> U(32), (h & U(0xFFFFFFFF)) | U(1)


def _place(a: np.ndarray, b: np.ndarray, i: int, size: np.ndarray) -> np.ndarray:
    """The i-th of the bits of a key in a filter of ``size`` < 2 ** 32 bits."""
    return ((a + U(i) * b & U(0xFFFFFFFF)) * size) >> U(32)


def build(parts: list[tuple[np.ndarray, np.ndarray]]) -> Filter:
    """Holds (key, 1), ..., (key, level of its count) for each key of the parts (keys, counts)."""
    levels = [level(counts) for _, counts in parts]
    size = max(64, sum(int(x.sum()) for x in levels) * BITS)
    bits = np.zeros(-(-size // 8) * 8, bool)
    for (keys, _), own in zip(parts, levels):
        live, step = np.arange(len(keys)), 1
        while len(live):
            a, b = _hashes(keys[live], step)
            for i in range(HASHES):
                bits[_place(a, b, i, U(size)).astype(np.int64)] = True
            step += 1
            live = live[own[live] >= step]
    return side_by_side([size], [np.packbits(bits, bitorder="little").tobytes()])


def probe(f: Filter, keys: np.ndarray, shard: np.ndarray | None = None) -> np.ndarray:
    """The level of each key: how many times in a row, from 1, its shard's filter says it holds (key, level).

    All shards are probed at once, so that the work doesn't grow with their number.
    """
    out = np.zeros(len(keys), np.int64)
    if shard is None:
        shard = np.zeros(len(keys), np.int64)
    live, size, base, step = np.arange(len(keys)), f.size[shard], f.base[shard], 1
    while len(live):
        a, b = _hashes(keys[live], step)
        for i in range(HASHES):
            at = base + _place(a, b, i, size)
            yes = (f.data[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1 > 0
            live, a, b, size, base = live[yes], a[yes], b[yes], size[yes], base[yes]
        out[live] = step
        step += 1
    return out


def _numbers(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """Numbers of a column of their bytes, without a copy where it is one chunk."""
    data = [raw(chunk)[0].view(kind) for chunk in column.chunks]
    return data[0] if len(data) == 1 else np.concatenate([*data, np.zeros(0, kind)])


def _build(key: tuple, table: pa.Table) -> pa.Table:
    keys, counts = _numbers(table.column("keys"), U), _numbers(table.column("counts"), np.uint32)
    slot, parts = (keys >> U(1)) & U(7), []
    for i in range(8):  # an eighth of the keys at a time
        own = np.flatnonzero(slot == i)
        parts.append(merged(keys[own], counts[own].astype(np.int64)))
    del keys, counts, slot
    f = build(parts)
    single = [c[(k & U(1) == 0) & (k != _START[0])] for k, c in parts]
    return pa.table({
        "shard": pa.array([key[0].as_py()], pa.int32()), "size": pa.array(f.size.astype(np.int64)), "data": pa.array([f.data.tobytes()], pa.binary()),
        "words": pa.array([sum(int(c.sum()) for c in single)]), "kinds": pa.array([sum(len(c) for c in single)]),
    })


class Scores(NamedTuple):
    """What turns levels into probabilities: words of the corpus, kinds of them."""

    words: int
    kinds: int

    def log_probability(self, one: np.ndarray, two: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Natural log of the word's probability after the word before, by the counts that levels stand for."""
        low = (1 - UNSEEN) * np.minimum(expected(one) / max(1, self.words), 1.0) + UNSEEN / (self.kinds + 1)
        context = expected(before)
        pair = np.minimum(expected(two), context)
        return np.log((pair + ALPHA * low) / (context + ALPHA))


def _rows(batch: pa.RecordBatch, g: Grams, logp: np.ndarray) -> pa.RecordBatch:
    n = batch.num_rows
    return _result(batch.column("doc_id"), np.bincount(g.doc, minlength=n), np.bincount(g.doc, logp, n))


def _result(ids: pa.Array, count: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    none, total = pa.array(count == 0), total.astype(np.float64)  # without any word bincount gives integers
    per = np.exp(-total / np.maximum(count, 1))
    return pa.RecordBatch.from_arrays([ids, pa.array(count), pa.array(total), pa.compute.if_else(none, pa.scalar(None, pa.float64()), pa.array(per))], ["doc_id", "n_words", "log_prob", "perplexity"])


def _levels(g: Grams, look: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Levels of one, two and before; each distinct key is looked up once."""
    keys, back = np.unique(np.concatenate([g.one, g.two, _START]), return_inverse=True)
    found = look(keys)[back]
    n = len(g.one)
    one, two, start = found[:n], found[n : 2 * n], found[-1]
    before = np.append(start, one[:-1])[:n]
    return one, two, np.where(g.before == _START[0], start, before)


def _scored(blob, shards: int, scores: Scores, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sizes, data = blob.value
    # an absent shard has no key: one bit that isn't set
    own = Filter(np.array(sizes[0], U), np.array(sizes[1], U) * U(8), np.frombuffer(data, np.uint8))
    for batch in by_bytes(batches, "text", AT_ONCE):
        g = grams(batch.column("text"))
        yield _rows(batch, g, scores.log_probability(*_levels(g, lambda keys: probe(own, keys, shard_of(keys, shards)))))


# The other way, for a filter too large to broadcast: probes travel to the shards, levels travel back.

_ASKED = "chunk string, shard int, place int, keys binary, ids array<bigint>, docs binary, ones binary, twos binary"


def _asked(shards: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk of texts: its shape, as places among its distinct keys, and those keys by shard."""
    task = TaskContext.get()
    for number, batch in enumerate(by_bytes(batches, "text", ASKED_AT_ONCE)):
        g = grams(batch.column("text"))
        keys, back = np.unique(np.concatenate([g.one, g.two, _START]), return_inverse=True)
        back = back.astype(np.uint32)
        n = len(g.one)
        cuts = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))
        some = np.flatnonzero(np.diff(cuts))
        chunk = f"{task.partitionId()}-{number}"
        m = len(some)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([chunk] * (m + 1)), pa.array([-1, *some.tolist()], pa.int32()), pa.array([len(keys), *cuts[some].tolist()], pa.int32()),
                pa.array([back[-1:].tobytes(), *(keys[cuts[s] : cuts[s + 1]].tobytes() for s in some)], pa.binary()),
                pa.array([batch.column("doc_id").to_pylist()] + [None] * m, pa.list_(pa.int64())),
                *(pa.array([x.tobytes()] + [None] * m, pa.binary()) for x in (g.doc.astype(np.uint32), back[:n], back[n : 2 * n])),
            ],
            ["chunk", "shard", "place", "keys", "ids", "docs", "ones", "twos"],
        )


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, each shard's filter first: levels of the keys asked for, those of a shard all at once."""
    shard, f = None, None
    for batch in batches:
        own = batch.column("shard").to_numpy()
        heads = batch.column("size").is_valid().to_numpy(zero_copy_only=False)
        cuts = np.append(np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | heads[1:] | heads[:-1])[: len(own)]), len(own))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if heads[i]:
                shard, f = own[i], side_by_side([batch.column("size")[i].as_py()], [batch.column("data")[i].as_py()])
                continue
            data, at = raw(batch.column("data").slice(i, j - i))
            keys = data.view(U)
            levels = probe(f, keys) if own[i] == shard else np.zeros(len(keys), np.int64)
            packed = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((at // 8).astype(np.int32)), pa.py_buffer(levels.astype(np.uint8))])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("chunk", "shard", "place")), packed], ["chunk", "shard", "place", "keys"])


def _assembled(scores: Scores, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk, its shape first, then its levels."""
    shape: dict | None = None
    levels = np.zeros(0, np.uint8)

    def out() -> pa.RecordBatch:
        doc, one, two = (np.frombuffer(shape[c], np.uint32).astype(np.int64) for c in ("docs", "ones", "twos"))
        found = levels.astype(np.int64)
        first = np.append(True, doc[1:] != doc[:-1])[: len(doc)]
        start = found[np.frombuffer(shape["keys"], np.uint32)[0]]
        before = np.where(first, start, np.append(start, found[one][:-1])[: len(doc)])
        logp = scores.log_probability(found[one], found[two], before)
        n = len(shape["ids"])
        return _result(pa.array(shape["ids"], pa.int64()), np.bincount(doc, minlength=n), np.bincount(doc, logp, n))

    for batch in batches:
        for row in batch.to_pylist():
            if row["shard"] < 0:
                if shape is not None:
                    yield out()
                shape, levels = row, np.zeros(row["place"], np.uint8)
            else:
                own = np.frombuffer(row["keys"], np.uint8)
                levels[row["place"] : row["place"] + len(own)] = own
    if shape is not None:
        yield out()


_RESULT = "doc_id bigint, n_words bigint, log_prob double, perplexity double"


def lm_scores(docs: DataFrame, limit: int = BROADCAST) -> DataFrame:
    """(doc_id, n_words, log_prob, perplexity) of each row under a bigram model of all of ``docs``.

    Words and pairs of words are counted over every text; tasks hand on sorted arrays of hashed keys, by shard of key,
    and each shard becomes a log-frequency Bloom filter: a count is found, up to its level, by probing for (key, 1),
    (key, 2), ... until one fails. P(w | v) = (c(v w) + ALPHA P(w)) / (c(v) + ALPHA), with P(w) smoothed by unseen
    words. A filter of up to ``limit`` bytes is broadcast; of a larger one, each task holds one shard at a time and
    the probes travel, with the same results: rows of keys by text chunk and shard, whose number is in proportion to
    the text as long as there are SHARDS shards, up to 0.5 TB; beyond that shards become more, and rows shorter. A very
    long text is read to its end and is a chunk of its own. A null, empty or wordless text has n_words 0, log_prob 0 and a null
    perplexity; a null doc_id and repeated rows pass through, one row each; further columns are ignored; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(plain(docs, "doc_id", "bigint").alias("doc_id"), plain(docs, "text", "string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, min(-(-total // SHARD_BYTES), max(SHARDS, -(-total // LARGEST_SHARD))))
    counts = in_arrow(rows.select("text"), partial(_count, shards), "shard int, keys binary, counts binary")
    made = counts.groupBy("shard").applyInArrow(_build, "shard int, size bigint, data binary, words bigint, kinds bigint")
    filters, path = written(made, "filter")
    sums = filters.agg(F.sum("words"), F.sum("kinds")).first()
    scores = Scores(int(sums[0] or 0), int(sums[1] or 0))
    if stored_bytes(spark, path) <= limit:
        sizes, starts, data = [1] * int(shards), [0] * int(shards), bytearray(1)
        for r in filters.select("shard", "size", "data").toLocalIterator():
            sizes[r["shard"]], starts[r["shard"]] = r["size"], len(data)
            data += r["data"]
        blob = spark.sparkContext.broadcast(((sizes, starts), bytes(data)))
        del data
        return in_arrow(rows, partial(_scored, blob, int(shards), scores), _RESULT)
    asked, _ = written(in_arrow(rows, partial(_asked, int(shards)), _ASKED), "asked")
    none = F.lit(None)
    probes = asked.where("shard >= 0").select("shard", none.cast("bigint").alias("size"), "chunk", "place", F.col("keys").alias("data"))
    heads = filters.select("shard", "size", none.cast("string").alias("chunk"), none.cast("int").alias("place"), "data")
    routed = heads.unionByName(probes).repartition(int(shards), "shard").sortWithinPartitions("shard", F.col("size").desc_nulls_last())
    answers = in_arrow(routed, _answered, "chunk string, shard int, place int, keys binary")
    whole = asked.where("shard < 0").unionByName(answers, allowMissingColumns=True)
    return in_arrow(whole.repartition("chunk").sortWithinPartitions("chunk", "shard"), partial(_assembled, scores), _RESULT)
