import random
from collections import Counter

import numpy as np
import pytest
import zstandard

from textlode.llm import language_id as li

from .cases import SCHEMA, awkward, awkward_rows, empty, labels, prose, table

SF = "/root/testdata/sf0.1"
BASE = {"en": "the quick brown fox jumps over the lazy dog and then it rests in the shade of the tree ", "de": "der schnelle braune Fuchs springt über den faulen Hund und ruht sich dann im Schatten aus "}


def known(spark):
    rows = [(500 + 10 * j + i, text[i:] + text * 3, lang, "s", 1) for j, (lang, text) in enumerate(BASE.items()) for i in range(8)]
    return rows, labels(spark, [(r[0], 1, 0) for r in rows])


def test_held_out_accuracy(spark):
    """Rows of the corpus that no dictionary was built from: labels of odd ids are hidden."""
    docs, own = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in li.language_id(docs, own.where("doc_id % 2 = 0")).collect()}
    good = {r.doc_id for r in own.where("quality = 1 and doc_id % 2 = 1").collect()}
    rows = [(got[r.doc_id].language, r.lang) for r in docs.select("doc_id", "lang").collect() if r.doc_id in good]
    answered = [a == b for a, b in rows if a is not None]
    assert len(answered) > 0.97 * len(rows) and np.mean(answered) > 0.99


def test_smallest_wins_and_narrow_margins_are_rejected():
    texts = [(BASE["en"] * 2).encode(), (BASE["de"] * 2).encode(), b"", None, b"0101001"]
    sizes = li.packed_sizes(texts, [(v * 4).encode() for v in BASE.values()])
    assert sizes[0, 0] < sizes[0, 1] and sizes[1, 1] < sizes[1, 0]
    assert (sizes[2:4] == 0).all() and sizes[4, 0] == sizes[4, 1]


def test_whole_texts_count():
    """Each part adds to the size, the last as well."""
    contents = [(v * 4).encode() for v in BASE.values()]
    text = (BASE["en"] * 400).encode()
    parts = sum(li.packed_sizes([text[i : i + li.CHUNK]], contents) for i in range(0, len(text), li.CHUNK))
    assert (li.packed_sizes([text], contents) == parts).all()


def test_awkward_rows(spark):
    rows, own = known(spark)
    got = li.language_id(awkward(spark, awkward_rows() + rows), own)
    assert Counter(r.doc_id for r in got.collect()) == Counter(r[0] for r in awkward_rows() + rows)
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append((r.language, r.margin))
    assert by[3] == [(None, None)] * 2 and by[4] == [(None, None)] * 2
    assert {x[0] for i, own_ in by.items() if i and 500 <= i < 508 for x in own_} == {"en"}
    assert {x[0] for i, own_ in by.items() if i and 510 <= i < 518 for x in own_} == {"de"}
    assert by[1][0] == by[1][1] and all(m is None or m >= 0 for x in by.values() for _, m in x)
    assert all(lang is None for lang, m in by[11] if m is not None and m < li.MARGIN)


def test_without_labels(spark):
    got = table(li.language_id(awkward(spark), labels(spark)), "language", "margin")
    assert got == [(None, None)] * len(awkward_rows())
    one = li.language_id(spark.createDataFrame([(1, "just this", "en", "s", 1)], SCHEMA), labels(spark, [(1, 1, 0)]))
    assert table(one, "doc_id", "language") == [(1, "en")]


def test_empty_table(spark):
    assert li.language_id(empty(spark), labels(spark)).collect() == []


def test_every_text_of_the_sample_gives_a_piece(spark):
    """Whatever the order of the rows, and not only from the starts of texts."""
    rows = [(i, f"start{i:03d} " * 40 + f"end{i:03d} " * 40, "en", "s", 1) for i in range(300)]
    own = labels(spark, [(r[0], 1, 0) for r in rows])
    made = [li.dictionaries(spark.createDataFrame(x, SCHEMA), own)["en"] for x in (rows, rows[::-1])]
    assert made[0] == made[1] and len(made[0]) <= li.DICTIONARY
    again = li.dictionaries(spark.createDataFrame(rows, SCHEMA).repartition(7), own.repartition(5))["en"]
    assert again == made[0]
    assert all(f"start{i:03d}".encode() in made[0] or f"end{i:03d}".encode() in made[0] for i in range(300))
    assert 60 < sum(f"end{i:03d}".encode() in made[0] for i in range(300)) < 240


def spark_hash(spark, ids):
    return {r.i: r.h for r in spark.createDataFrame([(i,) for i in ids], "i bigint").selectExpr("i", "xxhash64(i) as h").collect()}


def test_against_a_plain_loop(spark):
    """Dictionaries cut by hand, every text compressed in parts by hand at one level or both, margins by hand."""
    rng = random.Random(9)
    vocabulary = {lang: [f"{lang}{rng.randrange(99)}ü" for _ in range(60)] for lang in ("aa", "bb", "cc")}
    rows = [(i, prose(rng, rng.randrange(0, 400), vocabulary[lang] + vocabulary["aa"][:20]), lang, "s", 1) for i in range(150) for lang in [rng.choice(list(vocabulary))]]
    good = [r[0] for r in rows if r[0] % 3]
    hashed = spark_hash(spark, good)
    contents = {}
    for lang in sorted(vocabulary):
        own = sorted([r for r in rows if r[2] == lang and r[0] in hashed and r[1]], key=lambda r: (hashed[r[0]], r[0]))[:20]
        each = max(li.PIECE, 3000 // len(own) - 1)
        cuts = [int(i * li.GOLDEN % 1 * (max(0, len(r[1]) - each) + 1)) for i, r in enumerate(own)]
        contents[lang] = "\n".join(r[1][at : at + each] for r, at in zip(own, cuts)).encode()
    docs, own = spark.createDataFrame(rows, SCHEMA).repartition(6), labels(spark, [(i, 1, 0) for i in good])
    assert li.dictionaries(docs, own, rows=20, size=3000) == contents

    def size(text, content, level):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packer = zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False)
        return sum(len(packer.compress(text[i : i + li.CHUNK])) for i in range(0, len(text), li.CHUNK))

    got = {r.doc_id: (r.language, r.margin) for r in li.language_id(docs, own, rows=20, size=3000).collect()}
    levels = Counter()
    for doc_id, text, *_ in rows:
        if not text:
            assert got[doc_id] == (None, None)
            continue
        for level in li.LEVELS:
            (best, lang), (near, _) = sorted((size(text.encode(), c, level), lang) for lang, c in contents.items())[:2]
            levels[level] += 1
            if near - best >= li.SURE * near:
                break
        margin = (near - best) / near
        assert got[doc_id] == (lang if margin >= li.MARGIN else None, pytest.approx(margin))
    assert 0 < levels[li.LEVELS[1]] < levels[li.LEVELS[0]]
