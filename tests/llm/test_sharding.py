from collections import Counter, defaultdict
from hashlib import md5

import duckdb
import pytest

from textlode.llm import sharding
from textlode.llm.queries import ORACLES, QUERIES

from .cases import SCHEMA, awkward, awkward_rows, empty, table


def brute(rows, limit):
    """Splits oversized buckets bit by bit; what can't be split is dealt out to parts."""
    items = []
    for r in rows:
        h = int(md5(f"{'' if r[0] is None else r[0]}:{r[1] or ''}".encode()).hexdigest()[: sharding.BITS // 4], 16)
        items.append((h, r[0], len((r[1] or "").encode())))
    out = []

    def split(bucket, depth):
        if sum(x[2] for x in bucket) <= limit:
            out.extend((i, f"{h >> (sharding.BITS - depth):0{depth}b}" if depth else "", depth, 0, b) for h, i, b in bucket)
        elif depth == sharding.BITS:
            seen = Counter()
            for h, i, b in bucket:
                out.append((i, f"{h:0{depth}b}", depth, seen[h, i, b] // max(1, limit // max(b, 1)), b))
                seen[h, i, b] += 1
        else:
            for bit in (0, 1):
                if half := [x for x in bucket if x[0] >> (sharding.BITS - depth - 1) & 1 == bit]:
                    split(half, depth + 1)

    split(items, 0)
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [30, 2_000, 1_000_000, 1 << 30])
def test_against_splitting_bit_by_bit(spark, limit):
    got = sharding.shards(awkward(spark), limit)
    assert table(got) == brute(awkward_rows(), limit)


def test_repeated_rows_beyond_the_limit(spark):
    rows = [(1, "abcdefghij", "en", "s", 1)] * 7 + [(2, "x", "en", "s", 1)]
    got = sharding.shards(spark.createDataFrame(rows, SCHEMA), 35)
    assert table(got) == brute(rows, 35)
    held = defaultdict(int)
    for r in got.collect():
        held[r.shard, r.part] += r.bytes
    assert max(held.values()) <= 35


def test_prefixes_that_stay_too_large_are_looked_at_again(spark, monkeypatch):
    monkeypatch.setattr(sharding, "AHEAD", 0)
    rows = [(i, "z" * (i % 40), "en", "s", 1) for i in range(400)]
    assert table(sharding.shards(spark.createDataFrame(rows, SCHEMA), 60)) == brute(rows, 60)


def test_empty_table(spark):
    assert sharding.shards(empty(spark)).collect() == []


@pytest.mark.parametrize("name", ["op10_sharding", "fine_shards"])
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, "/root/testdata/sf0.01")
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = con.sql(ORACLES[name])
    assert table(got, *want.columns) == sorted(want.fetchall(), key=repr)
    if name == "fine_shards":
        assert len({r.shard for r in got.collect()}) > 20 and len({r.depth for r in got.collect()}) > 1


def test_texts_above_the_limit_have_rows_that_sql_leaves_out(spark):
    source = "/root/testdata/sf0.1/documents.parquet"
    got = table(QUERIES["fine_shards"](spark, "/root/testdata/sf0.1"), "doc_id", "shard", "depth", "part", "bytes")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{source}'")
    want = con.sql(ORACLES["fine_shards"]).select("doc_id, shard, depth, part, bytes").fetchall()
    large = {r[0] for r in con.sql(f"SELECT doc_id FROM documents WHERE octet_length(encode(text)) > {64 << 10}").fetchall()}
    assert large and [r for r in got if r[0] not in large] == sorted(want, key=repr)
    assert {r[0] for r in got if r[0] in large} == large and all(r[2] == sharding.BITS for r in got if r[0] in large)
