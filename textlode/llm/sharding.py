"""Shards under a byte limit by extendible hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import plain, written

LIMIT = 16 << 20
#: Bits of hash in use, and how many beyond the expected depth one round looks at.
BITS, AHEAD = 52, 6


def hash_bits(docs: DataFrame) -> Column:
    """52 bits of MD5 over doc_id and text, so that rows without a doc_id spread as well."""
    key = F.concat(F.coalesce(plain(docs, "doc_id", "string"), F.lit("")), F.lit(":"), F.coalesce(plain(docs, "text", "string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, BITS // 4), 16, 10).cast("bigint")


def _prefix(h: Column, depth: int) -> Column:
    return F.shiftright(h, BITS - depth) if depth else F.lit(0).cast("bigint")


def shards(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, shard, depth, part, bytes), one row for each row of ``docs``.

    Extendible hashing: a bucket is a prefix of the hash's bits; one whose texts' UTF-8 bytes exceed ``limit`` splits
    on its next bit, the others don't. ``shard`` is the prefix in binary ("" if all fit one shard), ``depth`` its
    length. Rows equal in doc_id and text can't be told apart by hash: if they exceed the limit together they are
    dealt out in order to parts 0, 1, ... of their shard; else part is 0. One text above the limit is alone in its
    shard or part. A null text has 0 bytes; a null doc_id is allowed; further columns are ignored; an empty table
    gives an empty result; a very long text counts with all its bytes. The directory is a table, never gathered on the driver; bytes are summed once for each
    prefix some bits longer than expected, and only rows of prefixes that are still too large are looked at again.
    """
    size = F.coalesce(F.octet_length(plain(docs, "text", "string")), F.lit(0)).cast("bigint")
    rows, _ = written(docs.select(plain(docs, "doc_id", "bigint").alias("doc_id"), hash_bits(docs).alias("h"), size.alias("bytes")), "sizes")
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    depth = min(BITS, max(0, (total // limit).bit_length() + AHEAD))
    done: list[DataFrame] = []
    floor = 0
    while True:
        fine = rows.groupBy(_prefix(F.col("h"), depth).alias("fine")).agg(F.sum("bytes").alias("bytes"))
        levels = fine.withColumn("depth", F.explode(F.sequence(F.lit(floor), F.lit(depth))))
        sums = levels.groupBy("depth", F.expr(f"shiftright(fine, {depth} - depth)").alias("prefix")).agg(F.sum("bytes").alias("bytes"))
        # a bucket that fits has few prefixes below it, unlike the root
        below = F.expr(f"sequence(shiftleft(prefix, {depth} - depth), shiftleft(prefix + 1, {depth} - depth) - 1)")
        fits = sums.where(F.col("bytes") <= limit).select(F.explode(below).alias("fine"), "depth").groupBy("fine").agg(F.min("depth").alias("depth"))
        placed, _ = written(rows.withColumn("fine", _prefix(F.col("h"), depth)).join(fits, "fine", "left").drop("fine"), "placed")
        done.append(placed.where("depth is not null").withColumn("part", F.lit(0)))
        rest = placed.where("depth is null").drop("depth")
        if depth == BITS or rest.isEmpty():
            break
        rows, floor, depth = rest, depth + 1, min(BITS, depth + 8)
    # equal rows have equal sizes, so many to a part; they are counted and dealt out, not brought together
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("bytes", F.lit(1))))
    same = rest.groupBy("doc_id", "h", "bytes").agg(F.count("*").alias("n")).withColumn("each", each)
    parts = same.select("*", F.explode(F.expr("sequence(0, (n - 1) div each)")).alias("part")).repartition("h", "doc_id", "part")
    dealt = parts.select("doc_id", "h", "bytes", "part", F.explode(F.expr("sequence(1, least(each, n - part * each))")).alias("copy"))
    done.append(dealt.select("doc_id", "h", "bytes", F.lit(BITS).alias("depth"), F.col("part").cast("int").alias("part")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    bits = F.when(F.col("depth") > 0, F.lpad(F.bin(F.expr(f"shiftright(h, cast({BITS} - depth as int))")), F.col("depth"), F.lit("0"))).otherwise("")
    return out.select("doc_id", bits.alias("shard"), F.col("depth").cast("int").alias("depth"), F.col("part").cast("int").alias("part"), "bytes")


def oracle(limit: int = LIMIT) -> str:
    """SQL for the rows of ``shards`` over documents whose ids differ, while 32 bits are enough."""
    return f"""
WITH sized AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 13))::BIGINT AS h,
         coalesce(octet_length(encode(text)), 0)::BIGINT AS bytes
  FROM documents
), levels AS (
  SELECT s.*, d.depth, h >> ({BITS} - d.depth)::BIGINT AS prefix FROM sized s, (SELECT unnest(range(0, 33))::BIGINT AS depth) d
), summed AS (
  SELECT *, sum(bytes) OVER (PARTITION BY depth, prefix) AS held FROM levels
), fit AS (
  SELECT doc_id, h, bytes, min(depth) AS depth FROM summed WHERE held <= {limit} GROUP BY doc_id, h, bytes
)
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h >> ({BITS} - depth)), depth::INT, '0') END AS shard,
       depth::INT AS depth, 0::INT AS part, bytes
FROM fit
"""
