"""Tokenizers: DataFrames of texts to DataFrames of positioned tokens and of postings."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.packed import PACKED, pack
from ..functions.spans import Spans, alternating, grouped, trigram_spans, whitespace_spans
from ..functions.text import gap_widths, lenient_text, strict_text, utf16_width
from ..workers import byte_sizes, in_arrow, sliced

TOKENS = "doc_id bigint, tok string, position int"
POSTINGS = "tok string, doc_id bigint, positions array<int>"
#: Bytes of text that a worker looks at together.
AT_ONCE = 1 << 20


class Tokenizer(ABC):
    """Splits texts into tokens with 0-based positions in UTF-16 code units."""

    #: Whether files with malformed UTF-8 have no tokens instead of replaced characters.
    strict = False

    def decode(self, content: Column) -> Column:
        return strict_text(content) if self.strict else lenient_text(content)

    @abstractmethod
    def tokenize(self, docs: DataFrame) -> DataFrame:
        """(doc_id, tok, position) of ``docs``(doc_id, text)."""

    def postings(self, docs: DataFrame, only: list[str] | None = None) -> DataFrame:
        """(tok, doc_id, positions): each document's positions of each of its tokens, ascending; of the tokens ``only``
        if given, so that a single lookup doesn't carry the others along."""
        tokens = self.tokenize(docs)
        return group_postings(tokens if only is None else tokens.where(F.col("tok").isin(only)))

    def packed(self, docs: DataFrame) -> DataFrame:
        """The postings as rows of PACKED, each of many documents."""
        return in_arrow(self.postings(docs), pack, PACKED)

    def tokens_of(self, text: str) -> list[tuple[str, int]] | None:
        """Tokens of a short string on the driver, or None if this tokenizer has no such way."""
        return None


def group_postings(tokens: DataFrame) -> DataFrame:
    """Groups tokens by token and document; no order of arrival is relied on."""
    return tokens.groupBy("tok", "doc_id").agg(F.sort_array(F.collect_list("position")).alias("positions"))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from sliced(batch, byte_sizes(batch.column("text")), AT_ONCE)


def _tokens(spans: Callable[[pa.Array], Spans], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        found = spans(batch.column("text"))
        ids = batch.column("doc_id").take(pa.array(found.doc))
        yield pa.RecordBatch.from_arrays([ids, found.token.cast(pa.string()), pa.array(found.position, pa.int32())], ["doc_id", "tok", "position"])


def _postings(spans: Callable[[pa.Array], Spans], only: list[str] | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    wanted = None if only is None else pa.array(only, pa.large_string())
    for batch in _slices(batches):
        found = spans(batch.column("text"))
        if wanted is not None:
            at = np.flatnonzero(pc.is_in(found.token, wanted).to_numpy(zero_copy_only=False))
            found = Spans(found.doc[at], found.token.take(pa.array(at)), found.position[at])
        doc, token, lists = grouped(found)
        yield pa.RecordBatch.from_arrays([token.cast(pa.string()), batch.column("doc_id").take(pa.array(doc)), lists], ["tok", "doc_id", "positions"])


def _packed(spans: Callable[[pa.Array], Spans], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return pack(_postings(spans, None, batches))


class _Spanned(Tokenizer):
    """A tokenizer whose tokens come straight from Arrow buffers: one pass, no exchange, grouped within each text."""

    spans: Callable[[pa.Array], Spans]

    def tokenize(self, docs: DataFrame) -> DataFrame:
        return in_arrow(docs.select(F.col("doc_id").cast("bigint"), "text"), partial(_tokens, type(self).spans), TOKENS)

    def postings(self, docs: DataFrame, only: list[str] | None = None) -> DataFrame:
        return in_arrow(docs.select(F.col("doc_id").cast("bigint"), "text"), partial(_postings, type(self).spans, only), POSTINGS)

    def packed(self, docs: DataFrame) -> DataFrame:
        return in_arrow(docs.select(F.col("doc_id").cast("bigint"), "text"), partial(_packed, type(self).spans), PACKED)

    def tokens_of(self, text: str) -> list[tuple[str, int]]:
        found = type(self).spans(pa.array([text]))
        return list(zip(found.token.to_pylist(), found.position.tolist()))


class WhitespaceTokenizer(_Spanned):
    """Runs between white space, those of 256 UTF-16 units or more left out; malformed UTF-8 is replaced."""

    spans = staticmethod(whitespace_spans)


class TrigramTokenizer(_Spanned):
    """Every three neighbouring code points, across spaces and lines; malformed files have none."""

    strict = True
    spans = staticmethod(trigram_spans)


class RegexTokenizer(Tokenizer):
    """Leftmost non-overlapping matches of a Java regular expression; malformed UTF-8 is replaced.

    Matches and the gaps between them come from built-in functions; a position is the running length of both, which
    workers sum for a batch of texts at once. Nothing is exchanged. A pattern that can match nothing also yields empty
    tokens, for which a Python worker searches instead, with Python's syntax.
    """

    def __init__(self, pattern: str):
        self.pattern = pattern
        import regex

        self._found = regex.compile(pattern)
        self.may_be_empty = self._found.match("") is not None

    def tokenize(self, docs: DataFrame) -> DataFrame:
        docs = docs.select(F.col("doc_id").cast("bigint"), "text")
        if self.may_be_empty:
            return in_arrow(docs, partial(_searched, self.pattern), TOKENS)
        both = docs.select("doc_id", F.regexp_extract_all("text", F.lit(self.pattern), F.lit(0)).alias("found"), gap_widths(F.col("text"), self.pattern).alias("gaps"))
        return in_arrow(both, _matched, TOKENS)

    def tokens_of(self, text: str) -> list[tuple[str, int]]:
        return [(m.group(), utf16_width(text[: m.start()])) for m in self._found.finditer(text)]


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = batch.column("found")
        row, position = alternating(batch.column("gaps"), found)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), found.flatten(), pa.array(position, pa.int32())], ["doc_id", "tok", "position"])


def _searched(pattern: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import regex

    found = regex.compile(pattern)
    for batch in _slices(batches):
        ids, toks, places = [], [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            at = last = 0
            for m in found.finditer(text or ""):
                at += utf16_width(text[last : m.start()])
                last = m.start()
                ids.append(doc_id)
                toks.append(m.group())
                places.append(at)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(toks, pa.string()), pa.array(places, pa.int32())], ["doc_id", "tok", "position"])
