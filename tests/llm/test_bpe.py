import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textlode.llm import bpe, token_output
from textlode.llm.words import U

from .cases import awkward, awkward_rows, empty


@pytest.fixture(scope="module")
def codec():
    with open(bpe.VOCABULARY, "rb") as f:
        return bpe.codec(f.read())


def long_pieces():
    rng = random.Random(11)
    for alphabet in ("ab", "abcdefghijklmnopqrstuvwxyz", "é", "aé漢😀", " ", "\n", "=-", "0123456789"):
        for n in (bpe.LEAF - 1, bpe.LEAF + 1, 3 * bpe.LEAF + 17, 9 * bpe.LEAF + 5):
            yield "".join(rng.choice(alphabet) for _ in range(n))
    yield "the" * 10_000
    yield "x " + "ing" * 5000 + " y"


def test_tree_equals_encoding_at_once(codec):
    for text in long_pieces():
        assert codec.plain(text) == codec.bpe.encode_ordinary(text)


def test_small_leaves_equal_encoding_at_once(codec):
    rng = random.Random(12)
    for _ in range(200):
        text = "".join(rng.choice(["a", "an", "tion", "e", "s", "st", "é", "in"]) for _ in range(rng.randrange(1, 200)))
        for leaf in (1, 3, 16):
            assert codec.piece(text, leaf) == codec.bpe.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab Ticks'll \n\té😀　 .,!0")), max_size=60), max_size=8))
def test_batches_equal_encoding_at_once(texts):
    with open(bpe.VOCABULARY, "rb") as f:
        own = bpe.codec(f.read())
    ids, at = own.encode_many(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [own.bpe.encode_ordinary(t) for t in texts]
    assert own.decode_many(ids, at).to_pylist() == texts


def test_awkward_rows(spark, codec):
    got = sorted(((r.doc_id, r.n_tokens, r.ids, r.decoded) for r in bpe.bpe(awkward(spark)).collect()), key=repr)
    want = [(r[0], None, None, None) if r[1] is None else (r[0], len(ids := codec.bpe.encode_ordinary(r[1])), ids, r[1]) for r in awkward_rows()]
    assert got == sorted(want, key=repr)
    assert bpe.bpe(empty(spark)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=1300), max_size=4))
def test_simple8b_round_trip(lists):
    ids = np.array([x for own in lists for x in own], U)
    at = np.append(0, np.cumsum([len(own) for own in lists])).astype(np.int64)
    words, bounds, offsets, raws = token_output.encode(ids, at)
    first = 0
    for i, own in enumerate(lists):
        blocks = -(-len(own) // token_output.BLOCK)
        mine = words[bounds[i] : bounds[i + 1]]
        got = token_output.decode(mine, len(own), offsets[first : first + blocks], raws[first : first + blocks])
        assert got.tolist() == own
        for b in range(blocks):  # any block by itself
            stop = offsets[first + b + 1] if b + 1 < blocks else len(mine)
            start = offsets[first + b]
            part = own[b * token_output.BLOCK : (b + 1) * token_output.BLOCK]
            alone = token_output.decode(mine[start:stop], len(part), np.zeros(1, np.int64), raws[first + b : first + b + 1] - start)
            assert alone.tolist() == part
        first += blocks


def greedy(ids):
    """Words that a plain loop needs."""
    n = at = 0
    while at < len(ids):
        for s in range(14, 0, -1):
            count, width = int(token_output.COUNTS[s]), int(token_output.WIDTHS[s])
            if all(x < 1 << width for x in ids[at : at + count]):
                break
        else:
            n, count = n + 1, 1
        n, at = n + 1, at + count
    return n


def test_words_hold_as_many_ids_as_fit():
    rng = random.Random(2)
    ids = [rng.choice([0, 1, 5, 300, 50_000, 1 << 62]) for _ in range(500)]
    words, *_ = token_output.encode(np.array(ids, U), np.array([0, 500]))
    assert len(words) == greedy(ids)


def test_token_output_rows(spark, codec):
    rows = token_output.token_output(awkward(spark)).collect()
    got = []
    for r in rows:
        if r.words is None:
            assert r.n_tokens is None and r.offsets is None and r.raws is None
            got.append((r.doc_id, None))
        else:
            ids = token_output.decode(np.frombuffer(bytes(r.words), "<u8"), r.n_tokens, np.array(r.offsets, np.int64), np.array(r.raws, np.int64))
            got.append((r.doc_id, codec.bpe.decode(ids.tolist())))
    assert sorted(got, key=repr) == sorted(((r[0], r[1]) for r in awkward_rows()), key=repr)
    assert token_output.token_output(empty(spark)).collect() == []
