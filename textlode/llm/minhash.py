"""Near-duplicate removal with DartMinHash signatures and a banded join."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import ROWS_AT_ONCE, by_bytes, drop, in_arrow, located, matched, place, plain, without, written
from .words import U, mix, shingles, words

COORDINATES, ROWS, SHINGLE = 128, 3, 3
#: Weighted Jaccard similarity that is looked for: that of texts of equal length that share two thirds of their shingles,
#: as a copy does in which about one word in eight was replaced.
SIMILARITY = 0.5
#: Share of coordinates that must agree: two standard errors of the estimate (0.044) below SIMILARITY. A pair that just
#: agrees in as many shares one of the 42 bands of ROWS with 0.95, one of SIMILARITY with 0.99.
THRESHOLD = 0.41
#: Distinct signatures of a bucket that a task holds against each other; of more, each two blocks are a task's work.
BLOCK = 4096
#: Buckets so wide that a task shouldn't even number their rows are fewer than so many; bits of a bucket's hash by which
#: they are looked for first.
WIDEST, PREFIX = 20_000, 20


@cache
def _poisson(mean: float) -> np.ndarray:
    """Distribution function of Poisson(mean) at 0, 1, ..."""
    n = np.arange(1, int(mean + 12 * mean**0.5 + 24))
    return np.cumsum(np.exp(np.concatenate([[-mean], -mean + np.cumsum(np.log(mean / n))])))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> U(11)).astype(np.float64) * 2.0**-53


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of sum(counts) items its owner and its number within the owner."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _throw(best: np.ndarray, doc: np.ndarray, element: np.ndarray, weight: np.ndarray, total: np.ndarray, darts: float, k: int) -> None:
    """Throws about ``darts`` darts at each text and keeps the earliest of each coordinate in ``best`` (texts x k).

    An element's darts are a fixed Poisson process of one dart a unit area on (weight, rank), drawn by hash from
    rectangles: weights [0,1), [1,2), [2,4), ...; for each, ranks from a first band that makes the area 1, then bands
    that double. A text gets those below its element's weight and below the rank darts / total weight.
    """
    levels = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))), 0).astype(np.int64) + 1
    owner, level = _spread(levels)
    height = darts / total[doc[owner]]  # ranks of use
    base = 2.0 ** -np.maximum(level - 1, 0)
    bands = np.where(height > base, np.ceil(np.log2(np.maximum(height / base, 1))), 0).astype(np.int64) + 1
    part, band = _spread(bands)
    owner, level, base = owner[part], level[part], base[part]
    seed = mix(element[owner] ^ ((level * 64 + band + 1).astype(U) * U(0xD6E8FEB86659FD93)))
    count = np.zeros(len(seed), np.int64)
    chance = _unit(mix(seed + U(0x632BE59BD9B4E019)))
    for b in np.unique(band).tolist():
        those = band == b
        count[those] = np.searchsorted(_poisson(2.0 ** max(b - 1, 0)), chance[those])
    region, number = _spread(count)
    dart = mix(seed[region] + (number + 1).astype(U) * U(0x9E3779B97F4A7C15))
    owner, level, band, base = owner[region], level[region], band[region], base[region]
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    at = low + np.where(level > 0, low, 1.0) * _unit(dart)
    first = np.where(band > 0, base * 2.0 ** (band - 1), 0.0)
    other = mix(dart ^ U(0xA0761D6478BD642F))
    rank = first + np.where(band > 0, first, base) * _unit(other)
    whose = doc[owner]
    hit = (at < weight[owner]) & (rank < darts / total[whose])
    whose, rank, dart = whose[hit], rank[hit], mix(dart[hit] + U(0xE7037ED1A0B428DB))
    key = (rank.astype(np.float32).view(np.uint32).astype(U) << U(32)) | (dart >> U(32))
    np.minimum.at(best, whose * k + ((dart & U(0xFFFFFF)) % U(k)).astype(np.int64), key)


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int = COORDINATES) -> np.ndarray:
    """DartMinHash: an n x k array of uint16; two texts agree on a coordinate with the probability of their weighted
    Jaccard similarity (and by chance with 1 / 65536).

    (doc, element, weight): distinct elements of each text. A text without elements gets zeros.
    """
    best = np.full(n * k, np.iinfo(np.uint64).max, U)
    total = np.bincount(doc, weight, n)
    darts, todo = k * np.log(k) + 2 * k, np.flatnonzero(total > 0)
    while len(todo):  # a text that left a coordinate empty gets twice the darts; the earliest ones stay the same
        mine = np.isin(doc, todo) if len(todo) < n else slice(None)
        _throw(best, doc[mine], element[mine], weight[mine], np.maximum(total, 1e-300), darts, k)
        todo = todo[(best.reshape(n, k)[todo] == np.iinfo(np.uint64).max).any(axis=1)]
        darts *= 2
    out = (best & U(0xFFFF)).astype(np.uint16).reshape(n, k)
    out[total == 0] = 0
    return out


def weighted(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word shingles of each text with their numbers of occurrences: (doc, element, weight)."""
    doc, h = shingles(words(texts), size)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    if not len(h):
        return doc, h, np.zeros(0)
    new = np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h))).astype(np.float64)


def band_hashes(sigs: np.ndarray, rows: int) -> np.ndarray:
    """n x (k / rows) of int64, one for each band, the band's number hashed in."""
    n, k = sigs.shape
    bands = k // rows
    parts = sigs[:, : bands * rows].reshape(n, bands, rows).astype(U)
    acc = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U)), (n, bands)).copy()
    for r in range(rows):
        acc = mix(acc ^ (parts[:, :, r] + U(0x9E3779B97F4A7C15)))
    return acc.view(np.int64)


def _signed(k: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 1 << 18, ROWS_AT_ONCE):
            n = batch.num_rows
            doc, element, weight = weighted(batch.column("text"), size)
            sigs = signatures(doc, element, weight, n, k)
            any_ = np.bincount(doc, minlength=n) > 0
            whole = mix(band_hashes(sigs, k)[:, 0].view(U)).view(np.int64)
            rows = pa.array(np.arange(n)[any_])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(rows) for c in ("file", "row", "doc_id")), pa.array(whole[any_]), pa.array([x.tobytes() for x in sigs[any_]], pa.binary())],
                ["file", "row", "doc_id", "node", "sig"],
            )

    return run


def _banded(k: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, k)
            bands = band_hashes(sigs, rows)
            node = np.repeat(batch.column("node").to_numpy(), bands.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(bands.ravel()), pa.array(node)], ["band", "node"])

    return run


class _Union:
    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: int, those: np.ndarray) -> None:
        roots = np.unique(self.root[np.append(those, a)])
        self.root[np.isin(self.root, roots)] = roots[0]


def _agreeing(sigs: np.ndarray, one: np.ndarray) -> np.ndarray:
    """In how many coordinates each row agrees with ``one``."""
    same = sigs == one
    n, k = same.shape
    if k % 8 or k > 2040:
        return same.sum(axis=1)
    return same.view(np.uint64).sum(axis=1).view(np.uint8).reshape(n, 8).sum(axis=1)  # eight counts at once


def linked(sigs: np.ndarray, threshold: float, split: int = 0) -> list[tuple[int, int]]:
    """Edges that join those rows of ``sigs`` that chains of similar pairs connect; with ``split``, of pairs of a row
    before it and one from it on.

    Each row is held against all rows that aren't yet connected with it, so copies of one text cost one pass.
    """
    n, k = sigs.shape
    need = int(np.ceil(threshold * k))
    union, edges = _Union(n), []
    for a in range(split or n):
        first = max(a + 1, split)
        rest = first + np.flatnonzero(union.root[first:] != union.root[a])
        if not len(rest):
            if (union.root == union.root[a]).all():
                break
            continue
        if 2 * len(rest) > n - first:  # without copying the rows
            hits = rest[(_agreeing(sigs[first:], sigs[a]) >= need)[rest - first]]
        else:
            hits = rest[_agreeing(sigs[rest], sigs[a]) >= need]
        if len(hits):
            edges.extend((a, b) for b in hits.tolist())
            union.join(a, hits)
    return edges


def _compared(k: int, threshold: float):
    need = int(np.ceil(threshold * k))

    def bucket(band: np.ndarray, cell: np.ndarray, second: np.ndarray, node: np.ndarray, sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of whole cells; those of two members are compared all at once."""
        cuts = np.flatnonzero(np.append(True, (band[1:] != band[:-1]) | (cell[1:] != cell[:-1])))
        sizes = np.diff(np.append(cuts, len(band)))
        two = cuts[sizes == 2]
        two = two[(sigs[two] == sigs[two + 1]).sum(axis=1) >= need] if len(two) else two
        a, b = [node[two]], [node[two + 1]]
        for at, size in zip(cuts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            split = size - int(second[at : at + size].sum())  # the rows of the second block come last
            if pairs := linked(sigs[at : at + size], threshold, split % size):
                x, y = np.array(pairs).T
                a.append(node[at + x])
                b.append(node[at + y])
        a, b = np.concatenate(a), np.concatenate(b)
        return np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                a, b = bucket(*(np.concatenate(x) for x in zip(*held)))
                held.clear()
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("band", "cell", "second", "node")]
            columns.append(np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, k))
            band, cell = columns[:2]
            others = np.flatnonzero((band != band[-1]) | (cell != cell[-1]))
            last = int(others[-1]) + 1 if len(others) else 0  # the last cell may go on in the next batch
            if last:
                held.append(tuple(x[:last] for x in columns))
                yield from out()
            elif held and (held[-1][0][-1] != band[0] or held[-1][1][-1] != cell[0]):
                yield from out()
            held.append(tuple(x[last:] for x in columns))
        yield from out()

    return run


def _widest(bands: DataFrame, block: int) -> DataFrame:
    """(band, n): buckets of more rows than ``block`` and than one in WIDEST of all rows, so fewer than WIDEST.

    Rows are counted by a prefix of the bucket first, which takes little to exchange; a prefix that holds such a
    bucket has as many rows more than it would, so only few rows are counted by bucket.
    """
    prefix = F.shiftrightunsigned("band", 64 - PREFIX)
    counts, path = written(bands.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("n")), "near-prefixes")
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(block, total // WIDEST)
    some = F.broadcast(counts.where(F.col("n") > least).select("prefix"))  # fewer than WIDEST as well
    wide, _ = written(bands.join(some, prefix == F.col("prefix")).groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > least), "near-widest")
    drop(bands.sparkSession, path)
    return wide


def similar(nodes: DataFrame, k: int, rows: int, threshold: float, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect what chains of similar pairs connect among ``nodes``(node, sig), one row a signature,
    of pairs that share a band of ``rows`` coordinates.

    All pairs of a bucket count, however wide it is: one of more than ``block`` signatures is cut into blocks of about
    as many, and each pair of blocks is a cell that is compared by itself, wherever it comes to lie.
    """
    bands, _ = written(in_arrow(nodes.select("node", "sig"), _banded(k, rows), "band bigint, node bigint"), "near-bands")
    wide = F.broadcast(_widest(bands, block))
    # one exchange: rows of a band lie together, and only buckets of two or more signatures go on
    numbered = bands.join(wide, "band", "left_anti").withColumn("i", F.row_number().over((w := Window.partitionBy("band")).orderBy("node")) - 1)
    numbered = numbered.withColumn("n", F.count("*").over(w)).where("n > 1").withColumns({"own": F.floor(F.col("i") / block), "blocks": F.ceil(F.col("n") / block)}).drop("i", "n")
    # rows of the widest aren't brought together to be numbered: their blocks come by hash
    dealt = bands.join(wide, "band").withColumn("blocks", F.ceil(F.col("n") / block)).withColumn("own", F.pmod(F.xxhash64("node"), "blocks")).drop("n")
    shared = numbered.unionByName(dealt).select("band", "node", "own", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"))
    least, most = F.least("own", "other"), F.greatest("own", "other")
    cells = shared.select("band", (F.shiftleft(least, 32) + most).alias("cell"), (F.col("own") > F.col("other")).alias("second"), "node")
    members = cells.join(nodes.select("node", "sig"), "node").repartition("band", "cell").sortWithinPartitions("band", "cell", "second", "node")
    return in_arrow(members.select("band", "cell", "second", "node", "sig"), _compared(k, threshold), "a bigint, b bigint").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of the graph of ``edges``(a, b): root is the least node of the component.

    Each round hands every node the least root among its neighbours' and then that root's own root; both are joins on
    node, in which nodes of very many edges are broadcast. Each round is written to the shared folder, and rounds stop
    when none changes.
    """
    spark = edges.sparkSession
    both, both_path = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), f"{name}-edges")
    first = both.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"))
    roots, path = written(first.select(F.col("a").alias("node"), F.least("a", "low").alias("root"), "n"), name)
    while True:
        near = matched(both, roots.select(F.col("node").alias("b"), "root", "n"), "b").groupBy("a").agg(F.min("root").alias("near"))
        step = roots.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("n").alias("degree"), F.least("root", "near").alias("next"), F.col("root").alias("old"))
        step, step_path = written(step, name)
        if step.where("next <> old").isEmpty():
            drop(spark, path)
            drop(spark, both_path)
            return step.select("node", F.col("next").alias("root"))
        # few roots stand for many nodes, so the rows of a root are counted for the join as well
        above = roots.select(F.col("node").alias("next"), F.col("root").alias("above"))
        up = step.groupBy("next").agg(F.count("*").alias("n")).join(above, "next")
        new, new_path = written(matched(step, up, "next").select("node", F.least("next", "above").alias("root"), F.col("degree").alias("n")), name)
        drop(spark, path)
        drop(spark, step_path)
        roots, path = new, new_path


def near_groups(docs: DataFrame, k: int = COORDINATES, rows: int = ROWS, size: int = SHINGLE, threshold: float = THRESHOLD, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signed, nodes, groups): the rows of ``docs``, a ``located`` table, that have words as (file, row, doc_id, node);
    each signature with its first row and the number of rows as (node, n, first); and (node, root) of each signature
    that a chain of similar ones connects with another.

    Similar: as many as ``threshold`` of the ``k`` coordinates agree. Pairs come from bands of ``rows`` coordinates.
    """
    file, row = place(docs)
    placed = docs.select(file.alias("file"), row.alias("row"), plain(docs, "doc_id", "bigint").alias("doc_id"), plain(docs, "text", "string").alias("text"))
    signed, _ = written(in_arrow(placed, _signed(k, size), "file bigint, row bigint, doc_id bigint, node bigint, sig binary"), "signed")
    # copies meet here, before anything else is made of them
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "row")
    nodes, _ = written(signed.groupBy("node").agg(F.first("sig").alias("sig"), F.count("*").alias("n"), F.min(order).alias("first")), "near-nodes")
    edges, path = written(similar(nodes, k, rows, threshold, block), "near-edges")
    groups = components(edges)
    drop(docs.sparkSession, path)
    return signed.select("file", "row", "doc_id", "node"), nodes.select("node", "n", "first"), groups


def near_dedup(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, in all its columns.

    Near-duplicates: weighted word-shingle sets (case of ASCII letters and punctuation left out) whose signatures
    agree in ``threshold`` of their coordinates; groups are the connected components. The row with the least doc_id
    stays (a null doc_id comes last; of rows equal in doc_id the one that lies first stays). Rows whose text is null,
    empty or has no word all stay: nothing can be said about them. A very long text is read to its end and compared
    like others. Any further columns, whatever their names, pass through. An empty table gives an empty table. What
    isn't just a scan of Parquet files is written as such first.
    """
    docs = located(docs, "near-inbox")
    signed, nodes, groups = near_groups(docs, **how)
    # first rows come together by signature, then by group; rows that have no company aren't looked at again
    known, _ = written(nodes.join(groups, "node", "left").select("node", "n", "first", F.coalesce("root", "node").alias("root")), "near-known")
    best = known.groupBy("root").agg(F.min("first").alias("best"), F.sum("n").alias("rows"), F.count("*").alias("n")).where("rows > 1").drop("rows")
    company = matched(known.select("node", "root", F.col("n").alias("own")), best, "root").select("node", F.col("own").alias("n"), "best")
    doomed = matched(signed.select("file", "row", "node"), written(company, "near-company")[0], "node")
    return without(docs, doomed.where("not (file = best.file and row = best.row)").select("file", "row"), "near-dropped")
