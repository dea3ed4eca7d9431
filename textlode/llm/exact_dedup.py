"""Exact deduplication as a stateful stream whose keyed state lives on disk and never expires."""

from __future__ import annotations

import json
import os
from collections import OrderedDict, defaultdict
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import file_system
from .shared import drop, folder_of, in_arrow, plain, scratch_path, without, written

#: State in RocksDB; all its instances on an executor share 64 MB, and go soon after the stream has ended.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
}
#: Digests that one state key holds on average.
PER_KEY = 256
#: Texts that a task remembers because it met a copy of them, and the longest of those in bytes.
REMEMBERED, LONGEST = 256, 1 << 16
#: Hits of one digest that are compared in one place; rows of a file that one task fetches.
TOGETHER, STRETCH = 1000, 100_000
REDUCED = "digest binary, file string, row bigint, doc_id bigint, gone array<bigint>"
HIT = "digest binary, file string, row bigint, doc_id bigint, kept_file string, kept_row bigint, gone array<bigint>"
STATE = "digests binary, files array<string>, rows array<bigint>, ids array<bigint>"


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows (digest, file, row, doc_id, text) of a task, those that may be the first of their text; the rest,
    whose bytes equal an earlier one's, as lists of rows by file in ``gone``.

    So a text that a great part of all rows have comes to its state key a few times for each task. Copies are looked
    for within a batch, and across batches for texts that had one.
    """
    hot: OrderedDict[bytes, tuple[tuple, bytes]] = OrderedDict()
    for batch in batches:
        digests, files, rows, ids = (batch.column(c).to_pylist() for c in ("digest", "file", "row", "doc_id"))
        text = batch.column("text")
        rank = [(i is None, i or 0, f, r) for i, f, r in zip(ids, files, rows)]
        seen: dict[bytes, int] = {}
        stay, gone = [], defaultdict(list)
        for i in sorted(range(len(rows)), key=rank.__getitem__):
            first = seen.get(digest := digests[i])
            if first is None:
                old = hot.get(digest)
                same = old is not None and old[1] == text[i].as_buffer().to_pybytes()
                if same and old[0] <= rank[i]:
                    gone[files[i]].append(rows[i])
                    continue
                if same:
                    hot[digest] = (rank[i], old[1])
                seen[digest] = i
                stay.append(i)
            elif text[i].as_buffer().equals(text[first].as_buffer()):
                gone[files[i]].append(rows[i])
                if digest not in hot and text[i].as_buffer().size <= LONGEST:
                    hot[digest] = (rank[first], text[first].as_buffer().to_pybytes())
                    if len(hot) > REMEMBERED:
                        hot.popitem(last=False)
            else:
                stay.append(i)
        kept = batch.take(pa.array(stay, pa.int64())).select(["digest", "file", "row", "doc_id"])
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.nulls(len(stay), pa.list_(pa.int64()))], REDUCED_NAMES)
        if gone:
            n = len(gone)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.binary()), pa.array(list(gone)), pa.array([x[0] for x in gone.values()], pa.int64()), pa.nulls(n, pa.int64()), pa.array([sorted(x) for x in gone.values()], pa.list_(pa.int64()))], REDUCED_NAMES)


REDUCED_NAMES = ["digest", "file", "row", "doc_id", "gone"]


def _look(width: int):
    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        """Rows of one batch whose digest begins with the key: hits go out with the locator of the retained row. Lists
        of rows that are copies already come under any key and go straight through."""
        mine = []
        for part in parts:
            through = part["digest"].isna()
            if through.any():
                own = part[through]
                nothing = [None] * len(own)
                yield _frame(nothing, own["file"].tolist(), own["row"].tolist(), nothing, nothing, nothing, own["gone"].tolist())
                part = part[~through]
            if len(part):
                mine.append(part[["digest", "file", "row", "doc_id"]])
        if not mine:
            return
        new = (pd.concat(mine) if len(mine) > 1 else mine[0]).sort_values(["doc_id", "file", "row"], na_position="last")
        digests, files, rows, ids = state.get if state.exists else (b"", [], [], [])
        digests, files, rows, ids = bytes(digests), list(files), list(rows), list(ids)
        known = {digests[i * width : i * width + width]: i for i in range(len(rows))}
        fresh, hits = [digests], []
        for digest, file, row, doc_id in zip(map(bytes, new["digest"]), new["file"], new["row"].tolist(), new["doc_id"]):
            doc_id = None if pd.isna(doc_id) else int(doc_id)
            at = known.setdefault(digest, len(rows))
            if at == len(rows):
                fresh.append(digest)
                files.append(file)
                rows.append(row)
                ids.append(doc_id)
            else:
                hits.append((digest, file, row, doc_id, files[at], rows[at], None))
        if len(fresh) > 1:
            state.update((b"".join(fresh), files, rows, ids))
        if hits:
            yield _frame(*map(list, zip(*hits)))

    return run


def _frame(digest: list, file: list, row: list, doc_id: list, kept_file: list, kept_row: list, gone: list) -> pd.DataFrame:
    """A frame of HIT's columns, whose types don't depend on what is null."""
    strings = lambda x: pd.Series(x, dtype=object)
    numbers = lambda x: pd.Series(x, dtype="Int64")
    return pd.DataFrame({"digest": strings(digest), "file": strings(file), "row": numbers(row), "doc_id": numbers(doc_id), "kept_file": strings(kept_file), "kept_row": numbers(kept_row), "gone": strings(gone)})


def _opened(file: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a file as Spark names it, whether special characters are escaped or not."""
    if "://" in file and not file.startswith("file:"):
        scheme, rest = file.split("://", 1)
        return pyarrow.fs.FileSystem.from_uri(f"{scheme}://{quote(unquote(rest), safe='/:@')}")
    path = "/" + file.removeprefix("file:").lstrip("/")
    return pyarrow.fs.LocalFileSystem(), path if os.path.exists(path) else unquote(path)


def _fetch(places: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts by content locator: (digest, file, row, ...) sorted by file and row, with the text read from the file."""

    def read(file: str, part: pa.Table) -> Iterator[pa.RecordBatch]:
        fs, path = _opened(file)
        with fs.open_input_file(path) as handle:
            yield from read_from(pq.ParquetFile(handle), part)

    def read_from(source: pq.ParquetFile, part: pa.Table) -> Iterator[pa.RecordBatch]:
        wanted = part.column("row").to_numpy()
        first = 0
        for group in range(source.num_row_groups):
            last = first + source.metadata.row_group(group).num_rows
            lo, hi = wanted.searchsorted(first), wanted.searchsorted(last)
            if lo < hi:
                at = first
                for batch in source.iter_batches(1024, row_groups=[group], columns=["text"]):
                    a, b = wanted.searchsorted(at), wanted.searchsorted(at + batch.num_rows)
                    if a < b:
                        text = batch.column(0).take(pa.array(wanted[a:b] - at)).cast(pa.string())
                        own = part.slice(a, b - a).combine_chunks().to_batches()[0]
                        yield pa.RecordBatch.from_arrays([*own.columns, text], [*own.schema.names, "text"])
                    at += batch.num_rows
            first = last

    held: list[pa.RecordBatch] = []
    for batch in places:
        start = 0
        names = batch.column("file").to_pylist()
        for i in range(1, len(names) + 1):
            if i == len(names) or names[i] != names[start]:
                if held and held[0].column("file")[0].as_py() != names[start]:
                    yield from read(held[0].column("file")[0].as_py(), pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(start, i - start))
                start = i
    if held:
        yield from read(held[0].column("file")[0].as_py(), pa.Table.from_batches(held))


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def _settle(hits: DataFrame, batch: int, out: str) -> None:
    """Checks the hits of one batch byte for byte and writes the locators of rows that drop.

    A digest of many hits is dealt out, with its retained text, to as many places as TOGETHER asks for.
    """
    spark = hits.sparkSession
    hits, hits_path = written(hits, "hits")
    through = hits.where("digest is null").select("file", F.explode("gone").alias("row"))
    hits = hits.where("digest is not null").drop("gone")
    extra_path = f"{out}/extra"  # rows kept though their digest was known: their bytes differ from the retained row's
    extra = spark.read.parquet(extra_path).where(F.col("batch") != batch) if _exists(spark, extra_path) else None
    counts = hits.groupBy("digest").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("places"))
    none = F.lit(None).cast("bigint").alias("doc_id")
    retained = hits.groupBy("digest").agg(F.min("kept_file").alias("file"), F.min("kept_row").alias("row"))  # one for each digest
    places = hits.select("digest", "file", "row", "doc_id", F.lit(2).alias("kind")).unionByName(retained.select("digest", "file", "row", none, F.lit(0).alias("kind")))
    if extra is not None:
        places = places.unionByName(extra.join(counts.select("digest"), "digest", "left_semi").select("digest", "file", "row", "doc_id", F.lit(1).alias("kind")))
    schema = places.schema.simpleString()[7:-1] + ",text:string"
    laid = places.repartition("file", F.floor(F.col("row") / STRETCH)).sortWithinPartitions("file", "row")
    texts = in_arrow(laid, _fetch, schema.replace(":", " "))
    kept = texts.where("kind = 0").select("digest", F.col("text").alias("kept_text")).join(counts, "digest").withColumn("at", F.explode(F.expr("sequence(0, places - 1)"))).drop("places")
    found = texts.where("kind > 0").join(counts, "digest").withColumn("at", F.pmod(F.xxhash64("file", "row"), "places").cast("int")).drop("places")
    found = found.join(kept, ["digest", "at"])
    settled, path = written(found.select("digest", "file", "row", "doc_id", "kind", (F.col("text") == F.col("kept_text")).alias("same"), F.when(F.col("text") != F.col("kept_text"), F.col("text")).alias("other")), "settled")
    order = Window.partitionBy("digest", "other").orderBy("kind", F.col("doc_id").asc_nulls_last(), "file", "row")
    apart = settled.where("not same").withColumn("place", F.row_number().over(order))
    dropped = settled.where("kind = 2 and same").select("file", "row").unionByName(apart.where("kind = 2 and place > 1").select("file", "row"))
    dropped.unionByName(through).write.mode("overwrite").parquet(f"{out}/dropped/batch={batch}")
    if not settled.where("not same").isEmpty():
        apart.where("kind = 2 and place = 1").select("digest", "file", "row", "doc_id").write.mode("overwrite").parquet(f"{extra_path}/batch={batch}")
    for done in (hits_path, path):
        drop(spark, done)


def _layout(spark: SparkSession, out: str, asked: dict[str, int] | None) -> dict[str, int]:
    """How the state below ``out`` is keyed. What the first run wrote holds for later ones; asking for another way is
    an error, because keys of one way aren't found by the other."""
    fs, p = file_system(spark, f"{out}/layout.json")
    if fs.exists(p):
        stream = fs.open(p)
        stored = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
        if asked is not None and any(stored[k] != v for k, v in asked.items()):
            raise ValueError(f"the state below {out} is keyed by {stored}, not {asked}")
        return stored
    stream = fs.create(p, True)
    stream.write(bytearray(json.dumps(asked).encode()))
    stream.close()
    return asked


def dedup_stream(spark: SparkSession, source: str, out: str, schema: StructType, *, bits: int | None = None, digest_bits: int = 256, max_files: int | None = None) -> None:
    """Feeds what is new in the Parquet folder ``source`` through the deduplicating stream, then returns.

    The state, in RocksDB and checkpointed below ``out``, is keyed by ``bits`` leading bits of the SHA-256 digest; it
    retains for each distinct digest the digest, the doc_id and the content locator (file, row in file) of the row
    that came first, and never expires. Rows that hit it are compared with the retained row's bytes, fetched through
    both locators; equal ones are written to ``out``/dropped as (file, row). Within one micro-batch the least doc_id
    comes first, and copies that meet in a task are compared there. ``max_files`` bounds a micro-batch. ``bits`` is
    kept with the state: later runs may leave it out, and others than the first are refused; without it the first run
    takes ``state_bits`` of the rows there are. ``digest_bits`` below 256 is for tests of collisions only.
    """
    fs, place = file_system(spark, source)
    if bits is None and not _exists(spark, f"{out}/layout.json"):
        bits = state_bits(spark.read.schema(schema).parquet(source).count())
    asked = {"digest_bits": digest_bits} | ({} if bits is None else {"bits": bits})
    bits = _layout(spark, out, asked)["bits"]
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if fs.getFileStatus(place).isFile():  # a stream reads folders
        docs = reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
    else:
        docs = reader.parquet(source)
    width = digest_bits // 8
    rows = docs.where(F.col("text").isNotNull()).select(
        F.substring(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), 1, width).alias("digest"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), plain(docs, "doc_id", "bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"),
    )
    rows = in_arrow(rows, _reduced, REDUCED)
    lead = F.conv(F.substring(F.hex("digest"), 1, min(15, 2 * width)), 16, 10).cast("bigint")
    lead = F.shiftright(lead, max(0, 4 * min(15, 2 * width) - bits))
    keyed = rows.withColumn("lead", F.coalesce(lead, F.pmod(F.xxhash64("file", "row"), F.lit(1 << bits))))
    hits = keyed.groupBy("lead").applyInPandasWithState(_look(width), HIT, STATE, "append", "NoTimeout")
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():  # a stream takes its settings when it starts
        spark.conf.set(k, v)
    try:
        query = (
            hits.writeStream.foreachBatch(lambda part, batch: _settle(part, batch, out))
            .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
        )
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    query.awaitTermination()


def state_bits(rows: int) -> int:
    """Bits of digest in the state's key for a corpus of ``rows``, so that a key holds some PER_KEY digests."""
    return max(1, (max(rows, 1) // PER_KEY).bit_length())


def survivors(spark: SparkSession, source: str, out: str, schema: StructType) -> DataFrame:
    """Rows of the Parquet folder ``source`` that the stream that wrote ``out`` didn't drop."""
    docs = spark.read.schema(schema).parquet(source)
    path = f"{out}/dropped"
    if not _exists(spark, path):
        return docs
    return without(docs, spark.read.parquet(path).select(F.xxhash64("file").alias("file"), "row"), "exact-dropped")


def exact_dedup(docs: DataFrame | None = None, *, source: str | None = None, spark: SparkSession | None = None, out: str | None = None, **how) -> DataFrame:
    """One row of each distinct text, with all its columns: the one with the least doc_id (nulls come last).

    Give a DataFrame or the ``source`` path of a Parquet table, which is streamed where it lies. A DataFrame that isn't
    just a scan of a folder's Parquet files is first written to the shared folder so that its rows have locators. Texts
    are equal if their bytes are, however long; rows with an empty text are copies of each other; a row with a null
    text has no content and always stays. Of rows equal in doc_id too, the one that lies first stays. Further columns,
    whatever their names, pass through; an empty table gives an empty table. With ``max_files`` the corpus comes in
    several micro-batches, and copies in an earlier one win. With ``out``, a folder in shared storage, the state lasts:
    later calls with the same ``source`` look only at files that came to it since, and keep what they kept.
    """
    if source is None:
        spark = docs.sparkSession
        source, schema = folder_of(docs) or written(docs, "inbox")[1], docs.schema
    else:
        schema = spark.read.parquet(source).schema
    out = out or scratch_path(spark, "exact-dedup")
    dedup_stream(spark, source, out, schema, **how)
    return survivors(spark, source, out, schema)
