import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textlode.functions.packed import coded, decoded, pack, unpack
from textlode.functions.text import deltas, lenient_text, quoted, strict_text, undelta, utf16_length
from textlode.functions.varint import decode_varint, encode_varint


@pytest.mark.parametrize(("value", "size"), [(1, 1), (127, 1), (1024, 2), (16000, 2), (2**31 - 1, 5), (-1, 5)])
def test_varint_sizes(value, size):
    data = encode_varint(value)
    assert len(data) == size and decode_varint(data) == (value, size)


@given(st.lists(st.integers(-(2**31), 2**31 - 1)))
def test_varint_round_trip(values):
    data, at, out = b"".join(map(encode_varint, values)), 0, []
    while at < len(data):
        value, at = decode_varint(data, at)
        out.append(value)
    assert out == values


def test_malformed_varint():
    with pytest.raises(ValueError):
        decode_varint(b"\xff" * 6)


def test_decoding(spark):
    rows = spark.createDataFrame([(bytearray(b"ab\xff\xc3("),), (bytearray(b"\xef\xbb\xbfx"),), (bytearray(b""),)], "content binary")
    got = rows.select(lenient_text(F.col("content")), strict_text(F.col("content"))).collect()
    assert [tuple(r) for r in got] == [("ab��(", None), ("﻿x", "﻿x"), ("", "")]


def test_utf16_length_and_quoting(spark):
    got = spark.range(1).select(utf16_length(F.lit("a\U0001f600b")), utf16_length(F.lit("é")), F.lit("x\\Ey").rlike("^" + quoted("x\\Ey") + "$")).first()
    assert tuple(got) == (4, 1, True)


def test_delta_lists(spark):
    rows = spark.createDataFrame([([1, 7, 20],), ([],), ([5],)], "p array<int>")
    got = rows.select(deltas(F.col("p")).alias("d")).select("d", undelta(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [([1, 6, 13], [1, 7, 20]), ([], []), ([5], [5])]


def test_packed_postings_come_back():
    rows = [("aa", 1 << 40, [5, 200, 70_000]), ("b", 3, [0]), ("aa", 7, []), ("é😀", 9, [1, 2]), ("aa", 8, [1 << 30]), ("b", 1, list(range(0, 9000, 3)))]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.list_(pa.int32()))], ["tok", "doc_id", "positions"])
    (packed,) = pack(iter([batch]))
    assert packed.num_rows == 3 and packed.column("doc_id").to_pylist() == [7, 1, 9]
    got = [(r["tok"], r["doc_id"], r["positions"]) for out in unpack(iter([packed, packed.slice(1, 2), packed.slice(0, 0)])) for r in out.to_pylist()]
    assert sorted(got[:6]) == sorted(rows) and sorted(got[6:]) == sorted(r for r in rows if r[0] != "aa")
    for numbers in ([], [0], [127, 128, 1 << 62, -1, 300]):
        assert decoded(coded(np.array(numbers, np.int64))[0]).tolist() == numbers
