"""Lookups over postings and texts: one token, a substring by trigrams, a scan of the texts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spans import alternating
from ..functions.text import gap_widths, quoted, utf16_width
from ..workers import in_arrow
from .tokenizers import RegexTokenizer, TrigramTokenizer

HITS = "doc_id bigint, position int"


def token_hits(postings: DataFrame, term: str) -> DataFrame:
    """(doc_id, position) of the token equal to ``term``; the equality reaches the Parquet scan."""
    return postings.where(F.col("tok") == term).select("doc_id", F.explode("positions").alias("position"))


def phrase_hits(postings: DataFrame, query: str) -> DataFrame:
    """(doc_id, position) at which the trigrams of ``query`` all follow one another, overlapping hits included.

    Only the query's trigrams are read; one exchange by doc_id brings a document's position lists together, which are
    shifted by each trigram's own offset and intersected within the row.
    """
    grams = TrigramTokenizer().tokens_of(query)
    if not grams:
        return postings.select("doc_id", F.lit(0).alias("position")).where(F.lit(False))
    names = sorted({tok for tok, _ in grams})
    table = postings.sparkSession.createDataFrame(grams, "tok string, off int")
    found = postings.where(F.col("tok").isin(names)).join(F.broadcast(table), "tok")
    lists = found.groupBy("doc_id").agg(F.collect_list(F.expr("transform(positions, p -> p - off)")).alias("lists")).where(F.size("lists") == len(grams))
    common = F.aggregate(F.slice("lists", 2, max(1, len(grams) - 1)), F.get("lists", F.lit(0)), F.array_intersect)
    return lists.select("doc_id", F.explode(common).alias("position"))


def scan_hits(texts: DataFrame, term: str) -> DataFrame:
    """(doc_id, position) of the non-overlapping occurrences of ``term`` in ``texts``(doc_id, text).

    Texts that contain it are split at it by built-in functions; workers only sum the lengths of the pieces.
    """
    if not term:
        raise ValueError("an empty term would match everywhere")
    pieces = texts.where(F.contains("text", F.lit(term))).select(F.col("doc_id").cast("bigint"), gap_widths(F.col("text"), quoted(term)).alias("gaps"))
    return in_arrow(pieces, partial(_occurrences, utf16_width(term)), HITS)


def _occurrences(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, position = alternating(batch.column("gaps"), None, width)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(position, pa.int32())], ["doc_id", "position"])


def regex_hits(texts: DataFrame, pattern: str, postings: DataFrame | None = None) -> DataFrame:
    """(doc_id, position) of the matches of a Java regular expression; with trigram ``postings``, only texts that hold
    the longest literal that every match must hold are looked at."""
    literal = required_literal(pattern)
    if postings is not None and len(literal) >= 3:
        texts = texts.join(phrase_hits(postings, literal).select("doc_id").distinct(), "doc_id", "left_semi")
    return RegexTokenizer(pattern).tokenize(texts.where(F.col("text").rlike(pattern))).select("doc_id", "position")


def required_literal(pattern: str) -> str:
    """A longest run of plain characters that every match holds; "" for patterns with groups, classes of flags or
    alternatives, of which nothing is said."""
    if any(c in pattern for c in "|(){}\\"):
        return ""
    plain = re.sub(r"\[\^?\]?[^\]]*\][*+?]*|.[*?][+?]?", "\0", pattern)  # classes and what may be missing
    return max(re.split(r"[\0.^$+*?\[\]]", plain), key=len)


def live(hits: DataFrame, documents: DataFrame, term: str) -> DataFrame:
    """(term, doc_id, path, position) of the hits whose document is among the live ``documents``(doc_id, path)."""
    return hits.join(documents.select("doc_id", "path"), "doc_id").select(F.lit(term).alias("term"), "doc_id", "path", "position")


def by_document(hits: DataFrame) -> DataFrame:
    """(doc_id, positions): the hits of each document together, ascending."""
    return hits.groupBy("doc_id").agg(F.sort_array(F.collect_list("position")).alias("positions"))
