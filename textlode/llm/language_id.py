"""Language identification by compression against per-language dictionaries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .labelled import labelled_sample
from .shared import by_bytes, in_arrow, plain

#: Labelled rows of a language looked at, characters of dictionary for each language, least characters of a text in it,
#: bytes compressed at once.
ROWS, DICTIONARY, PIECE, CHUNK = 1024, 64 << 10, 64, 4096
#: Compression levels; a text whose margin at the first is below SURE is looked at again at the second.
LEVELS, SURE = (1, 12), 0.06
#: The best must be smaller than the next by this share of it, or the text is rejected.
MARGIN = 0.01
GOLDEN = 0.6180339887498949

_PACKERS: dict[int, list[zstd.ZstdCompressor]] = {}


def dictionaries(docs: DataFrame, labels: DataFrame, rows: int = ROWS, size: int = DICTIONARY) -> dict[str, bytes]:
    """Raw dictionary content for each language: a piece of each of its texts among ``rows`` labelled good ones, in
    order of a hash of doc_id, as many characters of each as share ``size`` evenly, but PIECE at least, from places
    spread over whole texts. Pieces are cut where the texts lie, so the driver gets ``size`` characters or ``rows``
    times PIECE a language, and the order of rows doesn't matter. Languages without such a text have none."""
    sample = labelled_sample(docs, labels.where("quality = 1"), rows, by_language=True).where("text <> ''")
    own = Window.partitionBy("lang")  # of rows documents at most
    sample = sample.withColumn("i", F.row_number().over(own.orderBy(F.xxhash64("doc_id"), "doc_id")) - 1)
    each = F.greatest(F.lit(PIECE), F.floor(F.lit(size) / F.count("*").over(own)) - 1)  # and a line feed
    sample = sample.withColumn("each", each.cast("int")).withColumn("spare", F.greatest(F.lit(0), F.length("text") - F.col("each")))
    at = F.floor((F.col("i") * GOLDEN) % 1 * (F.col("spare") + 1)).cast("int")
    out: dict[str, list[tuple[int, str]]] = {}
    for r in sample.select("lang", "i", F.substring("text", at + 1, F.col("each")).alias("piece")).collect():
        out.setdefault(r["lang"], []).append((r["i"], r["piece"]))
    return {lang: "\n".join(piece for _, piece in sorted(out[lang])).encode() for lang in sorted(out)}


def _packers(contents: list[bytes], level: int) -> list[zstd.ZstdCompressor]:
    key = hash((tuple(contents), level))
    if key not in _PACKERS:
        made = []
        for content in contents:
            d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            made.append(zstd.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False))
        _PACKERS[key] = made
    return _PACKERS[key]


def packed_sizes(texts: list[bytes | None], contents: list[bytes], level: int = LEVELS[0], chunk: int = CHUNK) -> np.ndarray:
    """Compressed bytes of each whole text under each dictionary; each ``chunk`` bytes are compressed by themselves,
    so that the dictionary and not the text's own start is what they are held against."""
    packers = _packers(contents, level)
    out = np.zeros((len(texts), len(contents)), np.int64)
    for i, text in enumerate(texts):
        for at in range(0, len(text or b""), chunk):
            part = text[at : at + chunk]
            for j, packer in enumerate(packers):
                out[i, j] += len(packer.compress(part))
    return out


def _identified(names: list[str], contents: list[bytes], margin: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text"):
        n = batch.num_rows
        lang, gap = [None] * n, [None] * n
        if names:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            sizes = packed_sizes(texts, contents)
            if len(names) > 1:
                close = np.sort(sizes, axis=1)
                again = np.flatnonzero(close[:, 1] - close[:, 0] < SURE * close[:, 1])
                sizes[again] = packed_sizes([texts[i] for i in again.tolist()], contents, LEVELS[1])
            order = np.argsort(sizes, axis=1, kind="stable")
            best = sizes[np.arange(n), order[:, 0]]
            near = sizes[np.arange(n), order[:, 1]] if len(names) > 1 else best * 2
            some = best > 0
            share = np.where(some, (near - best) / np.maximum(near, 1), 0.0)
            gap = [x if s else None for x, s in zip(share.tolist(), some.tolist())]
            lang = [names[j] if s and x >= margin else None for j, x, s in zip(order[:, 0].tolist(), share.tolist(), some.tolist())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(gap, pa.float64())], ["doc_id", "language", "margin"])


def language_id(docs: DataFrame, labels: DataFrame, margin: float = MARGIN, **how) -> DataFrame:
    """(doc_id, language, margin), one row for each row of ``docs``.

    The language is that of the raw-content zstd dictionary under which the whole text takes the fewest bytes, margin
    by what share of the next it is smaller. language is null - rejected - if the margin is below ``margin``, and both
    are null for a null or empty text or if no language has a labelled text; equal sizes are a margin of 0. A very long
    text counts to its end. Language names come from the labelled rows' lang column only, never from the row's own. A
    null doc_id and repeated rows pass through; further columns are ignored; an empty table gives an empty result. One
    pass, no exchange; the dictionaries are of fixed size.
    """
    known = dictionaries(docs, labels, **how)
    rows = docs.select(plain(docs, "doc_id", "bigint").alias("doc_id"), plain(docs, "text", "string").alias("text"))
    run = partial(_identified, list(known), list(known.values()), margin)
    return in_arrow(rows, run, "doc_id bigint, language string, margin double")
