"""Labelled documents, all or a bounded sample of them, on which the classifiers are fitted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import located, place, plain, within, written

#: Tasks that rank the labelled documents of one language before their best are ranked together; chosen ids that are
#: broadcast at most.
SALTS, BROADCAST = 64, 200_000


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int | None, by_language: bool = False) -> DataFrame:
    """(doc_id, text, lang, quality) of at most ``rows`` labelled documents, the first in order of a hash of doc_id;
    with ``by_language`` of as many of each language, those without one left out, or of all of them if ``rows`` is None.

    A doc_id labelled more than once counts with its lowest quality; null ids and labels don't count. Of rows that
    share a doc_id, or with ``by_language`` both that and the language, the least text is taken, so that no document
    comes more often. Which ones are chosen doesn't depend on the order of rows.
    """
    ids = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    if rows is None:
        if not by_language:
            raise ValueError("all labelled documents are given by language only")
        return _all_labelled(docs, ids)
    own = docs.select(plain(docs, "doc_id", "bigint").alias("doc_id"), plain(docs, "text", "string").alias("text"), plain(docs, "lang", "string").alias("lang"))
    if not by_language:
        chosen = _with(own, ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), ["doc_id"])
        return chosen.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("lang").alias("lang"), F.min("quality").alias("quality"))
    known = own.select("doc_id", "lang").where("lang IS NOT NULL").distinct().join(ids, "doc_id").withColumn("hash", F.xxhash64("doc_id"))
    for by in (["lang", F.pmod("hash", F.lit(SALTS))], ["lang"]):  # the first of each salt hold the first of all
        known = known.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("hash", "doc_id"))).where(F.col("place") <= rows)
    chosen = _with(own, known.select("doc_id", "lang", "quality"), ["doc_id", "lang"])
    return chosen.groupBy("doc_id", "lang").agg(F.min("text").alias("text"), F.min("quality").alias("quality")).select("doc_id", "text", "lang", "quality")


def _all_labelled(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Every labelled document that has a language. Texts are exchanged only of ids that come more than once in a
    language; others stay where they lie, found by their places if their ids are too many to broadcast."""
    docs = located(docs, "labelled")
    file, row = place(docs)
    named = [plain(docs, "doc_id", "bigint").alias("doc_id"), plain(docs, "lang", "string").alias("lang")]
    known = docs.select(*named, file.alias("file"), row.alias("row")).where("lang IS NOT NULL").join(ids, "doc_id")
    places, _ = written(known, "labelled-places")
    by = ["doc_id", "lang"]
    chosen, _ = written(places.groupBy(*by).agg(F.min("quality").alias("quality"), F.count("*").alias("n")), "labelled-ids")
    many, repeated = chosen.count() > BROADCAST, chosen.where("n > 1").count()
    text = plain(docs, "text", "string").alias("text")
    columns = ["doc_id", "text", "lang", "quality"]

    def of(kept: DataFrame) -> DataFrame:
        """The rows of ``docs`` of these ids; those of a quality each if the ids aren't broadcast."""
        if not many:
            return docs.select(*named, text).join(F.broadcast(kept.select(*by, "quality")), by).select(*columns)
        found = [docs.select(*named, text, F.lit(0).alias("quality")).where(F.lit(False)).select(*columns)]
        for quality in [r["quality"] for r in kept.select("quality").distinct().collect()]:
            own = places.join(kept.where(F.col("quality") == quality).select(*by), by).select("file", "row")
            found.append(within(docs, own, "labelled-rows").select(*named, text).withColumn("quality", F.lit(quality)).select(*columns))
        return reduce(DataFrame.unionByName, found)

    single = of(chosen.where("n = 1"))
    if not repeated:
        return single
    least, _ = written(of(chosen.where("n > 1")).groupBy(*by).agg(F.min("text").alias("text"), F.min("quality").alias("quality")).select(*columns), "labelled-repeats", exchanged=False)
    return single.unionByName(least)


def _with(own: DataFrame, chosen: DataFrame, by: list[str]) -> DataFrame:
    """The texts of the chosen ids, which are counted first: texts are exchanged only if the ids are very many, as
    those of a great many languages may be."""
    chosen, _ = written(chosen, "chosen")
    return own.join(F.broadcast(chosen) if chosen.count() <= BROADCAST else chosen, by)
