"""Scratch tables in the folder that all executors share, and rows known by their place in a table's files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import drop, file_system, scratch_path, scratch_root
from ..workers import give_back, in_arrow, small_batches

__all__ = ["drop", "give_back", "in_arrow", "scratch_path", "scratch_root", "small_batches"]

def stored_bytes(spark: SparkSession, path: str) -> int:
    fs, p = file_system(spark, path)
    return int(fs.getContentSummary(p).getLength())


_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, block: int | None = None, exchanged: bool = True) -> tuple[DataFrame, str]:
    """Writes ``df`` to a scratch table and returns the table, cut from its lineage, and its path.

    Unlike a local checkpoint it survives the loss of any executor. ``block`` bounds the bytes of a row group, and so
    what a writer gathers and how many long rows a reader takes at once. Without ``exchanged`` what was exchanged for
    it goes at once rather than when the driver collects its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write if block is None else df.write.option("parquet.block.size", block)
    old = spark.conf.get(_CLEANED, None)
    try:
        if not exchanged:
            spark.conf.set(_CLEANED, "true")
        writer.parquet(path)
    finally:
        if not exchanged:
            spark.conf.unset(_CLEANED) if old is None else spark.conf.set(_CLEANED, old)
    return spark.read.schema(df.schema).parquet(path), path


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with underscores until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def plain(df: DataFrame, name: str, kind: str) -> Column:
    """Column ``name`` as ``kind``; a null of that kind where ``df`` lacks it."""
    return df[f"`{name}`"].cast(kind) if name in df.columns else F.lit(None).cast(kind)


#: Keys with very many rows: those of at least so many rows, and of one in MOST_HOT of all, so fewer than that.
HOT, MOST_HOT = 100_000, 20_000


def matched(rows: DataFrame, facts: DataFrame, key: str, hot: int = HOT) -> DataFrame:
    """``rows`` joined with ``facts``, which has one row a key and says in ``n`` how many of ``rows`` have it.

    Keys with very many rows are joined by broadcast, so that their rows needn't meet in a task; by what they count
    they are fewer than MOST_HOT. ``n`` goes.
    """
    total, most = facts.agg(F.sum("n"), F.max("n")).first()
    least = max(hot, (total or 0) // MOST_HOT)
    if (most or 0) <= least:
        return rows.join(facts.drop("n"), key)
    many = facts.where(F.col("n") > least).drop("n")
    few = rows.join(F.broadcast(many.select(key)), key, "left_anti").join(facts.where(F.col("n") <= least).drop("n"), key)
    return few.unionByName(rows.join(F.broadcast(many), key))


def _fileformat(docs: DataFrame) -> str | None:
    """The file format that ``docs`` is a bare scan of."""
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return None
    return plan.relation().fileFormat().toString()


def located(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` as a scan of Parquet files, whose rows have places; what is one already isn't written again."""
    return docs if _fileformat(docs) == "Parquet" else written(docs, name)[0]


def folder_of(docs: DataFrame) -> str | None:
    """The folder all of whose Parquet files ``docs`` scans, all its columns being in them."""
    if _fileformat(docs) != "Parquet" or not docs._jdf.queryExecution().analyzed().relation().partitionSchema().isEmpty() or not (files := docs.inputFiles()):
        return None
    folder = files[0].rsplit("/", 1)[0]
    fs, p = file_system(docs.sparkSession, docs.sparkSession._jvm.java.net.URI(folder).getPath() if folder.startswith("file:") else folder)
    if {f.rsplit("/", 1)[0] for f in files} != {folder} or not fs.exists(p):
        return None
    names = {n for s in fs.listStatus(p) if not (n := s.getPath().getName()).startswith(("_", "."))}
    plain_names = {docs.sparkSession._jvm.java.net.URI(f).getPath().rsplit("/", 1)[1] for f in files}
    return p.toString() if names == plain_names else None


def place(docs: DataFrame) -> tuple[Column, Column]:
    """(file, row): 64 bits of hash of a row's file and its number in there; ``docs`` must be ``located``."""
    hidden = docs.metadataColumn("_metadata")
    return F.xxhash64(hidden["file_path"]), hidden["row_index"]


#: Files whose lists of dropped rows share a folder.
FILES_TOGETHER = 64


def _kept(path: str, folders: int, parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Whether each (file, row) isn't in the list of its file below ``path``; a task's rows come file by file."""
    fs, inner = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)
    known: dict[int, np.ndarray] = {}

    def rows_of(file: int) -> np.ndarray:
        if file not in known:
            folder = f"{inner}/folder={file % folders}"
            known.clear()
            known[file] = np.zeros(0, np.int64)
            if fs.get_file_info(folder).type == pyarrow.fs.FileType.Directory:
                found = pyarrow.dataset.dataset(folder, filesystem=fs, format="parquet").to_table(filter=pyarrow.dataset.field("file") == file)
                if found.num_rows:
                    known[file] = found.column("rows").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return known[file]

    for files, rows in parts:
        files, rows = files.to_numpy(), rows.to_numpy()
        out = np.ones(len(files), bool)
        cuts = [0, *(np.flatnonzero(files[1:] != files[:-1]) + 1).tolist(), len(files)]
        for i, j in zip(cuts[:-1], cuts[1:]):
            if i < j and len(gone := rows_of(int(files[i]))):
                at = np.searchsorted(gone, rows[i:j])
                out[i:j] = gone[np.minimum(at, len(gone) - 1)] != rows[i:j]
        yield pd.Series(out)


def without(docs: DataFrame, doomed: DataFrame, name: str) -> DataFrame:
    """``docs``, a ``located`` table, without the rows at the places ``doomed``(file bigint, row bigint).

    Each file's dropped rows are written as one list, as in a table format's deletion vectors; whoever scans the file
    reads its list. Texts aren't exchanged, and only places go to Python.
    """
    return _listed(docs, doomed, name, drop=True)


def within(docs: DataFrame, chosen: DataFrame, name: str) -> DataFrame:
    """The rows of ``docs``, a ``located`` table, at the places ``chosen``, found as ``without`` finds those it drops."""
    return _listed(docs, chosen, name, drop=False)


def _listed(docs: DataFrame, places: DataFrame, name: str, drop: bool) -> DataFrame:
    spark = docs.sparkSession
    folders = max(1, len(docs.inputFiles()) // FILES_TOGETHER)
    path = scratch_path(spark, name)
    small_batches(spark)
    lists = places.groupBy("file").agg(F.sort_array(F.collect_set("row")).alias("rows"))
    # a folder's lists are written by one task, so that whoever reads them opens one file
    lists.withColumn("folder", F.pmod("file", F.lit(folders))).repartition("folder").write.partitionBy("folder").parquet(path)

    @F.pandas_udf("boolean")
    def kept(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for own in _kept(path, folders, parts):
            yield own if drop else ~own

    return docs.where(kept(*place(docs))).select(*[docs[f"`{c}`"] for c in docs.columns])


#: Rows that a worker looks at together at most: some work takes as much for a short text as for a long one.
ROWS_AT_ONCE = 512


def cuts(text: pa.Array, limit: int, rows: int | None = None) -> list[int]:
    """Where to cut an array of texts so that slices have about ``limit`` bytes and at most ``rows`` texts; a longer
    text makes a slice of its own."""
    n = len(text)
    if text.nbytes <= limit and (rows is None or n <= rows):
        return [0, n]
    sizes = pa.compute.fill_null(pa.compute.binary_length(text), 0).to_numpy(zero_copy_only=False)
    out, held = [0], 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > limit or rows is not None and i - out[-1] >= rows:
            out.append(i)
            held = 0
        held += size
    return [*out, n]


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 22, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of the batches as ``cuts`` says."""
    for batch in batches:
        if batch.num_rows:
            at = cuts(batch.column(column), limit, rows)
            for i, j in zip(at[:-1], at[1:]):
                yield batch.slice(i, j - i)
