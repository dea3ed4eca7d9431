import random
import re

import pytest

from textlode.functions.text import utf16_width
from textlode.operators.tokenizers import RegexTokenizer, TrigramTokenizer, WhitespaceTokenizer, group_postings


def tokens(spark, tokenizer, *texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    rows = tokenizer.tokenize(docs).collect()
    return [sorted(((r.position, r.tok) for r in rows if r.doc_id == i)) for i in range(len(texts))]


def test_whitespace_golden(spark):
    got = tokens(spark, WhitespaceTokenizer(), "one two three", "one       two three", "one\ttwo\nthree", "", None)
    assert got == [[(0, "one"), (4, "two"), (8, "three")], [(0, "one"), (10, "two"), (14, "three")], [(0, "one"), (4, "two"), (8, "three")], [], []]


def test_whitespace_corners(spark):
    got = tokens(spark, WhitespaceTokenizer(), "a b\x1cc\u0085d  e", "x" * 255 + " " + "y" * 256 + " z", "\U0001f600" * 128 + " b", "a \U0001f600b c")
    assert got[0] == [(0, "a"), (2, "b"), (4, "c\u0085d"), (9, "e")]
    assert got[1] == [(0, "x" * 255), (513, "z")]
    assert got[2] == [(257, "b")]
    assert got[3] == [(0, "a"), (2, "\U0001f600b"), (6, "c")]


def test_trigram_golden(spark):
    got = tokens(spark, TrigramTokenizer(), "one two three", "on", "a\U0001f600bc")
    assert got[0] == list(enumerate(["one", "ne ", "e t", " tw", "two", "wo ", "o t", " th", "thr", "hre", "ree"]))
    assert got[1] == []
    assert got[2] == [(0, "a\U0001f600b"), (1, "\U0001f600bc")]


def test_regex_golden(spark):
    got = tokens(spark, RegexTokenizer("[_0-9a-zA-Z]+"), "one;two |three.four(six)[seven]{eight}", "\U0001f600one two")
    assert got[0] == [(0, "one"), (4, "two"), (9, "three"), (15, "four"), (20, "six"), (25, "seven"), (32, "eight")]
    assert got[1] == [(2, "one"), (6, "two")]


def test_regex_that_matches_nothing_too(spark):
    assert tokens(spark, RegexTokenizer("a*"), "baa") == [[(0, ""), (1, "aa"), (3, "")]]


def test_random_texts_against_brute_force(spark):
    rng = random.Random(5)
    alphabet = "ab \n\té \U0001f600\U00010348_1"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(60)]

    def brute(pattern, text):
        return [(utf16_width(text[: m.start()]), m.group()) for m in re.finditer(pattern, text)]

    blank = "[^\\t-\\r\\x1c-\\x20\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
    assert tokens(spark, WhitespaceTokenizer(), *texts) == [brute(blank, t) for t in texts]
    assert tokens(spark, RegexTokenizer("[a-z_]+"), *texts) == [brute("[a-z_]+", t) for t in texts]
    threes = [[(utf16_width(t[:i]), t[i : i + 3]) for i in range(len(t) - 2)] for t in texts]
    assert tokens(spark, TrigramTokenizer(), *texts) == threes


@pytest.mark.parametrize("tokenizer", [WhitespaceTokenizer(), TrigramTokenizer(), RegexTokenizer("[a-z]+")])
def test_postings_group_tokens(spark, tokenizer):
    docs = spark.createDataFrame([(1, "a b a aa a"), (2, "b"), (3, ""), (4, None)], "doc_id bigint, text string")
    got = {(r.tok, r.doc_id): r.positions for r in tokenizer.postings(docs).collect()}
    want = {(r.tok, r.doc_id): r.positions for r in group_postings(tokenizer.tokenize(docs)).collect()}
    assert got == want and got
    some = {(r.tok, r.doc_id): r.positions for r in tokenizer.postings(docs, ["a", "a b"]).collect()}
    assert some == {k: v for k, v in got.items() if k[0] in ("a", "a b")}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    for tokenizer in (WhitespaceTokenizer(), TrigramTokenizer(), RegexTokenizer("a")):
        assert tokenizer.tokenize(docs).count() == 0 and tokenizer.postings(docs).count() == 0
