"""The engine's own operators as queries over whole tables, with SQL for the same rows."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..facade import TextIndex
from ..filters import EXTENSION
from ..functions.text import deltas, lenient_text, strict_text, undelta
from ..functions.varint import decode_varint, encode_varint
from ..index import InvertedIndex
from ..operators.resolvers import FullScanResolver, QueryResolver, RegexResolver, StandardResolver, TrigramResolver
from ..operators.search import by_document, live, phrase_hits, scan_hits, token_hits
from ..operators.tokenizers import RegexTokenizer, Tokenizer, TrigramTokenizer, WhitespaceTokenizer
from ..sources.changes import read_changes
from ..sources.walk import read_folders
from ..storage import scratch_path
from ..streaming.maintain import INDEX_UPDATED, maintain

WORD, PHRASE, SHORT, PATTERN = "the", "ing the", "aa", "[_0-9a-zA-Z]+"
EXPRESSION = "[a-z]+ing th[aeiou]"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")


def tok_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return WhitespaceTokenizer().tokenize(_documents(spark, sf_dir))


def tok_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RegexTokenizer(PATTERN).tokenize(_documents(spark, sf_dir))


def tok_trigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = TrigramTokenizer().postings(_documents(spark, sf_dir))
    total = F.aggregate("positions", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return lists.groupBy("tok").agg(F.count("*").alias("n_docs"), F.sum(F.size("positions")).alias("n_hits"), F.sum(total).alias("sum_position"))


def postings_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = WhitespaceTokenizer().postings(_documents(spark, sf_dir))
    return lists.select("tok", "doc_id", F.size("positions").cast("bigint").alias("n_positions"), F.array_min("positions").alias("first_position"), F.array_max("positions").alias("last_position"))


def postings_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delta lists, decoded again: the sum of a list's deltas is its last position."""
    coded = WhitespaceTokenizer().postings(_documents(spark, sf_dir)).select("tok", "doc_id", deltas(F.col("positions")).alias("d"))
    back = coded.select("tok", "doc_id", "d", undelta(F.col("d")).alias("p"))
    total = F.aggregate("p", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return back.select("tok", "doc_id", F.array_max("d").alias("largest_delta"), total.alias("sum_position"))


def token_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_hits(WhitespaceTokenizer().postings(_documents(spark, sf_dir), [WORD]), WORD)


def substring_trigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = TrigramTokenizer()
    return phrase_hits(tokenizer.postings(_documents(spark, sf_dir), [tok for tok, _ in tokenizer.tokens_of(PHRASE)]), PHRASE)


def fullscan_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_hits(_documents(spark, sf_dir), SHORT)


def results_by_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = by_document(scan_hits(_documents(spark, sf_dir), WORD))
    return grouped.select("doc_id", F.size("positions").cast("bigint").alias("n_hits"), F.array_min("positions").alias("first_hit"), F.array_max("positions").alias("last_hit"))


def live_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    alive = docs.where("lang <> 'de'").select("doc_id", F.col("doc_id").cast("string").alias("path"))
    return live(token_hits(WhitespaceTokenizer().postings(docs, ["in"]), "in"), alive, "in").select("term", "path", "position")


def ext_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    named = pages.select("page_id", F.concat("url", F.element_at(F.array(*map(F.lit, (".kt", ".KT", ".txt", ".bin", ".py", ".json.gz"))), (F.col("page_id") % 6 + 1).cast("int"))).alias("name"))
    return named.where(F.col("name").rlike(EXTENSION))


def _bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as bytes; Spanish ones end in a malformed one."""
    content = F.col("text").cast("binary")
    return _documents(spark, sf_dir).select("doc_id", F.when(F.col("lang") == "es", F.concat(content, F.unhex(F.lit("FF")))).otherwise(content).alias("content"))


def decode_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bytes(spark, sf_dir).select("doc_id", lenient_text(F.col("content")).alias("text"))


def decode_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bytes(spark, sf_dir).select("doc_id", strict_text(F.col("content")).alias("text"))


def _index(spark: SparkSession, sf_dir: str, tokenizer: Tokenizer) -> tuple[InvertedIndex, DataFrame]:
    docs = _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"), "text", "lang")
    index = InvertedIndex(spark, scratch_path(spark, "index"), tokenizer)
    index.add_batch(docs.select("path", "content"))
    return index, docs


def _found(index: InvertedIndex, resolver: QueryResolver, query: str) -> DataFrame:
    return resolver.search(index.snapshot(), query).select("term", "path", "position")


def index_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(_index(spark, sf_dir, WhitespaceTokenizer())[0], StandardResolver(), WORD)


def index_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(_index(spark, sf_dir, TrigramTokenizer())[0], TrigramResolver(), PHRASE)


def index_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(_index(spark, sf_dir, TrigramTokenizer())[0], TrigramResolver(), SHORT)


def index_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(_index(spark, sf_dir, WhitespaceTokenizer())[0], FullScanResolver(), PHRASE)


def delete_live_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, docs = _index(spark, sf_dir, WhitespaceTokenizer())
    index.delete(docs.where("lang = 'de'").select("path"))
    return _found(index, StandardResolver(), "in")


def update_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, docs = _index(spark, sf_dir, WhitespaceTokenizer())
    new = docs.where("lang = 'fr'").select("path", F.concat(F.lit("the end of "), "text").cast("binary").alias("content"))
    index.update(new.unionByName(spark.createDataFrame([("unknown", bytearray(b"the"))], "path string, content binary")))
    return _found(index, StandardResolver(), WORD)


def compact_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, docs = _index(spark, sf_dir, WhitespaceTokenizer())
    index.delete(docs.where("lang = 'de'").select("path"))
    index.compact()
    return _found(index, StandardResolver(), "in")


def regex_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A regular expression over a trigram index, which narrows the texts to those with its longest literal."""
    return _found(_index(spark, sf_dir, TrigramTokenizer())[0], RegexResolver(trigrams=True), EXPRESSION)


def raw_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of a token as they are stored, deleted documents' included."""
    index, docs = _index(spark, sf_dir, WhitespaceTokenizer())
    paths = index.snapshot().documents
    index.delete(docs.where("lang = 'de'").select("path"))
    return index.raw("in").join(paths, "doc_id").select("tok", "path", F.size("positions").cast("bigint").alias("n_positions"), F.array_max("positions").alias("last_position"))


def has_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether tokens are indexed: in an index of all texts, and in one of texts that are empty."""
    index, docs = _index(spark, sf_dir, WhitespaceTokenizer())
    bare = InvertedIndex(spark, scratch_path(spark, "index"), WhitespaceTokenizer())
    bare.add_batch(docs.select("path", F.lit("").cast("binary").alias("content")))
    return spark.createDataFrame([("all", index.has_documents()), ("empty", bare.has_documents())], "name string, tokens boolean")


def repeated_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that holds paths more than once: of their contents the greatest counts."""
    docs = _documents(spark, sf_dir)
    contents = docs.select(F.col("lang").alias("path"), F.col("text").cast("binary").alias("content"))
    index = InvertedIndex(spark, scratch_path(spark, "index"), WhitespaceTokenizer())
    index.add_batch(contents)
    return index.snapshot().texts.join(index.snapshot().documents, "doc_id").select("path", "text")


def long_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens on both sides of the greatest length, of characters of one and of two UTF-16 units."""
    own = F.concat(F.expr("repeat('x', cast(250 + doc_id % 10 as int))"), F.lit(" "), F.expr("repeat('\U0001f600', cast(124 + doc_id % 8 as int))"), F.lit(" y"))
    return WhitespaceTokenizer().tokenize(_documents(spark, sf_dir).withColumn("text", own))


def varints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of texts as variable-length integers, and decoded again."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [encode_varint(x) for x in batch.column("n").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.hex().upper() for x in data]), pa.array([decode_varint(x)[0] for x in data], pa.int32())], ["doc_id", "code", "decoded"])

    return _documents(spark, sf_dir).select("doc_id", F.length("text").alias("n")).mapInArrow(coded, "doc_id bigint, code string, decoded int")


SUFFIXES = (".kt", ".KT", ".txt", ".bin", ".py", ".json.gz")


def _files(spark: SparkSession, docs: DataFrame, base: str | None = None) -> str:
    """Writes ``docs``(name, text) as files below a folder in shared storage that executors have mounted; its path."""
    base = base or scratch_path(spark, "files").removeprefix("file://")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist()):
                path = f"{base}/{name}"
                os.makedirs(os.path.dirname(path), exist_ok=True)
                draft = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}"
                with open(draft, "wb") as f:
                    f.write(text.encode())
                os.replace(draft, path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    os.makedirs(base, exist_ok=True)
    docs.select("name", "text").mapInArrow(write, "n bigint").agg(F.sum("n")).collect()
    return base


def _named(docs: DataFrame, suffix: Column | None = None) -> DataFrame:
    """Documents as files in a few folders, one level or two below the root."""
    folder = F.expr("if(doc_id % 3 = 0, 'a/b', concat('c', doc_id % 5))")
    return docs.withColumn("name", F.concat(folder, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt") if suffix is None else suffix))


def _by_id(found: DataFrame) -> DataFrame:
    """Hits whose path is the number that the file is named by."""
    return found.withColumn("path", F.regexp_extract("path", r"([0-9]+)\.[^/]*$", 1))


def folder_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files below a folder: those of the types that are taken, outside hidden folders, with size and content."""
    docs = _documents(spark, sf_dir)
    kind = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("doc_id") % 6 + 1).cast("int"))
    named = _named(docs, kind).withColumn("name", F.concat(F.expr("if(doc_id % 7 = 0, '.hidden/', '')"), "name"))
    base = _files(spark, named)
    found = read_folders(spark, [base, f"{base}/missing"])
    return found.select(F.regexp_extract("path", r"([0-9]+)(\.[^/]*)$", 1).cast("bigint").alias("doc_id"), F.regexp_extract("path", r"(\.[a-zA-Z.]*)$", 1).alias("suffix"), "size", lenient_text(F.col("content")).alias("text"))


def _text_index(spark: SparkSession, roots: list[str], tokenizer: Tokenizer, resolver: QueryResolver) -> TextIndex:
    return TextIndex(spark, roots, scratch_path(spark, "text-index"), tokenizer, resolver)


def facade_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class for users: files are listed, read, indexed and searched; hits in order of document and position."""
    index = _text_index(spark, [_files(spark, _named(_documents(spark, sf_dir)))], WhitespaceTokenizer(), StandardResolver())
    percent: list[int] = []
    index.index(percent.append)
    assert percent[0] == 1 and percent[-1] == 100, percent
    return _by_id(index.query(WORD))


def facade_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by trigrams, over two roots of which one lies in the other, so that files are listed twice."""
    base = _files(spark, _named(_documents(spark, sf_dir)))
    index = _text_index(spark, [base, f"{base}/a"], TrigramTokenizer(), TrigramResolver())
    index.index()
    return _by_id(index.query(PHRASE))


def watched_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are created, modified and deleted after indexing, folded in by the stream in two steps."""
    docs = _named(_documents(spark, sf_dir))
    base = _files(spark, docs.where("lang <> 'fr'"))
    index, events = _text_index(spark, [base], WhitespaceTokenizer(), StandardResolver()), []
    index.index()
    changes = read_changes(spark, [base], index._listings)
    query = maintain(changes, index.inverted, f"{index.location}/checkpoint", events.append, "0 seconds")
    try:
        _files(spark, docs.where("lang = 'fr'"), base)
        query.processAllAvailable()
        _files(spark, docs.where("lang = 'es'").withColumn("text", F.concat(F.lit("the end of "), "text")), base)

        def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name in batch.column("name").to_pylist():
                    if os.path.exists(f"{base}/{name}"):  # a task may run twice
                        os.remove(f"{base}/{name}")
                yield batch

        docs.where("lang = 'de'").select("name").mapInArrow(remove, "name string").agg(F.count("*")).collect()
        query.processAllAvailable()
    finally:
        query.stop()
    assert INDEX_UPDATED in events
    return _by_id(index.query(WORD))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        token_lookup, tok_whitespace, tok_regex, tok_trigram, postings_build, postings_delta, substring_trigram, fullscan_short, results_by_doc, live_filter,
        ext_filter, decode_lenient, decode_strict, index_token, index_substring, index_short, index_scan, delete_live_filter, update_reindex, compact_index,
        regex_query, raw_token, has_documents, repeated_paths, long_tokens, varints, folder_source, facade_token, facade_substring, watched_changes,
    )
}


def _tokens(source: str = "documents") -> str:
    """CTEs up to tokens(doc_id, tok, position, lang) of white-space tokens."""
    return rf"""
WITH parts AS (
  SELECT doc_id, lang, string_split_regex(text, '[\t-\r\x{{1c}}-\x{{1f}}\p{{Z}}]') AS list FROM {source}
), pieces AS (
  SELECT doc_id, lang, unnest(list) AS tok, generate_subscripts(list, 1) AS i FROM parts
), placed AS (
  SELECT doc_id, lang, tok, CAST(coalesce(sum(length(tok) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS position FROM pieces
), tokens AS (
  SELECT * FROM placed WHERE tok <> '' AND length(tok) < 256
)"""


def _occurring(term: str) -> str:
    """CTEs up to hits(doc_id, position) of the non-overlapping occurrences of a term."""
    return f"""
WITH parts AS (
  SELECT doc_id, string_split(text, '{term}') AS list FROM documents WHERE contains(text, '{term}')
), pieces AS (
  SELECT doc_id, unnest(list) AS piece, generate_subscripts(list, 1) AS i, len(list) AS n FROM parts
), hits AS (
  SELECT doc_id, CAST(sum(length(piece) + {len(term)}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - {len(term)} AS INT) AS position, i, n
  FROM pieces QUALIFY i < n
)"""


_OVERLAPPING = f"""
WITH hits AS (
  SELECT doc_id, CAST(p AS INT) AS position
  FROM (SELECT doc_id, text, unnest(range(0, length(text) - {len(PHRASE) - 1})) AS p FROM documents WHERE contains(text, '{PHRASE}'))
  WHERE substr(text, p + 1, {len(PHRASE)}) = '{PHRASE}'
)"""
_TEXT = "CASE WHEN lang = 'es' THEN {} ELSE text END"

ORACLES: dict[str, str] = {
    "token_lookup": f"{_tokens()} SELECT doc_id, position FROM tokens WHERE tok = '{WORD}'",
    "tok_whitespace": f"{_tokens()} SELECT doc_id, tok, position FROM tokens",
    "tok_regex": f"""
WITH parts AS (
  SELECT doc_id, regexp_extract_all(text, '{PATTERN}') AS found, string_split_regex(text, '{PATTERN}') AS gaps FROM documents
), pieces AS (
  SELECT doc_id, unnest(found) AS tok, generate_subscripts(found, 1) AS i, gaps FROM parts
)
SELECT doc_id, tok, CAST(sum(length(gaps[i]) + length(tok)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(tok) AS INT) AS position
FROM pieces""",
    "tok_trigram": """
WITH grams AS (
  SELECT doc_id, p, substr(text, p + 1, 3) AS tok FROM (SELECT doc_id, text, unnest(range(0, length(text) - 2)) AS p FROM documents)
)
SELECT tok, count(DISTINCT doc_id) AS n_docs, count(*) AS n_hits, CAST(sum(p) AS BIGINT) AS sum_position FROM grams GROUP BY tok""",
    "postings_build": f"{_tokens()} SELECT tok, doc_id, count(*) AS n_positions, min(position) AS first_position, max(position) AS last_position FROM tokens GROUP BY tok, doc_id",
    "postings_delta": f"""{_tokens()}, steps AS (
  SELECT tok, doc_id, position, position - coalesce(lag(position) OVER (PARTITION BY tok, doc_id ORDER BY position), 0) AS d FROM tokens
)
SELECT tok, doc_id, CAST(max(d) AS INT) AS largest_delta, CAST(sum(position) AS BIGINT) AS sum_position FROM steps GROUP BY tok, doc_id""",
    "substring_trigram": f"{_OVERLAPPING} SELECT doc_id, position FROM hits",
    "fullscan_short": f"{_occurring(SHORT)} SELECT doc_id, position FROM hits",
    "results_by_doc": f"{_occurring(WORD)} SELECT doc_id, count(*) AS n_hits, min(position) AS first_hit, max(position) AS last_hit FROM hits GROUP BY doc_id",
    "live_filter": f"{_tokens()} SELECT tok AS term, CAST(doc_id AS VARCHAR) AS path, position FROM tokens WHERE tok = 'in' AND lang <> 'de'",
    "ext_filter": f"""
WITH named AS (SELECT page_id, url || (['.kt', '.KT', '.txt', '.bin', '.py', '.json.gz'])[page_id % 6 + 1] AS name FROM pages)
SELECT page_id, name FROM named WHERE regexp_matches(name, '{EXTENSION}')""",
    "decode_lenient": f"SELECT doc_id, {_TEXT.format("text || chr(65533)")} AS text FROM documents",
    "decode_strict": f"SELECT doc_id, {_TEXT.format("NULL")} AS text FROM documents",
    "index_token": f"{_tokens()} SELECT tok AS term, CAST(doc_id AS VARCHAR) AS path, position FROM tokens WHERE tok = '{WORD}'",
    "index_substring": f"{_OVERLAPPING} SELECT '{PHRASE}' AS term, CAST(doc_id AS VARCHAR) AS path, position FROM hits",
    "index_short": f"{_occurring(SHORT)} SELECT '{SHORT}' AS term, CAST(doc_id AS VARCHAR) AS path, position FROM hits",
    "index_scan": f"{_occurring(PHRASE)} SELECT '{PHRASE}' AS term, CAST(doc_id AS VARCHAR) AS path, position FROM hits",
    "delete_live_filter": f"{_tokens()} SELECT tok AS term, CAST(doc_id AS VARCHAR) AS path, position FROM tokens WHERE tok = 'in' AND lang <> 'de'",
    "compact_index": f"{_tokens()} SELECT tok AS term, CAST(doc_id AS VARCHAR) AS path, position FROM tokens WHERE tok = 'in' AND lang <> 'de'",
    "update_reindex": f"""{_tokens("(SELECT doc_id, lang, CASE WHEN lang = 'fr' THEN 'the end of ' || text ELSE text END AS text FROM documents)")}
SELECT tok AS term, CAST(doc_id AS VARCHAR) AS path, position FROM tokens WHERE tok = '{WORD}'""",
    "regex_query": f"""
WITH parts AS (
  SELECT doc_id, regexp_extract_all(text, '{EXPRESSION}') AS found, string_split_regex(text, '{EXPRESSION}') AS gaps FROM documents
), pieces AS (
  SELECT doc_id, unnest(found) AS tok, generate_subscripts(found, 1) AS i, gaps FROM parts
)
SELECT '{EXPRESSION}' AS term, CAST(doc_id AS VARCHAR) AS path, CAST(sum(length(gaps[i]) + length(tok)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(tok) AS INT) AS position
FROM pieces""",
    "raw_token": f"{_tokens()} SELECT tok, CAST(doc_id AS VARCHAR) AS path, count(*) AS n_positions, max(position) AS last_position FROM tokens WHERE tok = 'in' GROUP BY tok, doc_id",
    "has_documents": "SELECT 'all' AS name, count(*) > 0 AS tokens FROM documents UNION ALL SELECT 'empty', false",
    "repeated_paths": "SELECT lang AS path, max(text) AS text FROM documents GROUP BY lang",
    "long_tokens": """
WITH n AS (SELECT doc_id, CAST(250 + doc_id % 10 AS INT) AS x, CAST(124 + doc_id % 8 AS INT) AS e FROM documents)
SELECT doc_id, repeat('x', x) AS tok, 0 AS position FROM n WHERE x < 256
UNION ALL SELECT doc_id, repeat(chr(128512), e), x + 1 FROM n WHERE 2 * e < 256
UNION ALL SELECT doc_id, 'y', x + 2 * e + 2 FROM n""",
    "varints": """
WITH n AS (SELECT doc_id, CAST(length(text) AS INT) AS n FROM documents)
SELECT doc_id, CASE WHEN n < 128 THEN printf('%02X', n) WHEN n < 16384 THEN printf('%02X%02X', n % 128 + 128, n // 128)
  WHEN n < 2097152 THEN printf('%02X%02X%02X', n % 128 + 128, n // 128 % 128 + 128, n // 16384)
  ELSE printf('%02X%02X%02X%02X', n % 128 + 128, n // 128 % 128 + 128, n // 16384 % 128 + 128, n // 2097152) END AS code, n AS decoded FROM n""",
    "folder_source": f"""
WITH named AS (SELECT doc_id, text, ({list(SUFFIXES)})[doc_id % 6 + 1] AS suffix FROM documents)
SELECT doc_id, suffix, CAST(octet_length(encode(text)) AS BIGINT) AS size, text FROM named WHERE doc_id % 7 <> 0 AND suffix IN ('.kt', '.txt', '.py', '.json.gz')""",
    "facade_token": f"{_tokens()} SELECT tok AS term, CAST(doc_id AS VARCHAR) AS path, position FROM tokens WHERE tok = '{WORD}'",
    "facade_substring": f"{_OVERLAPPING} SELECT '{PHRASE}' AS term, CAST(doc_id AS VARCHAR) AS path, position FROM hits",
    "watched_changes": f"""{_tokens("(SELECT doc_id, lang, CASE WHEN lang = 'es' THEN 'the end of ' || text ELSE text END AS text FROM documents WHERE lang <> 'de')")}
SELECT tok AS term, CAST(doc_id AS VARCHAR) AS path, position FROM tokens WHERE tok = '{WORD}'""",
}
