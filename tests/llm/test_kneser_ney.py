import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from textlode.llm import kneser_ney as kn
from textlode.llm import labelled

from .cases import SCHEMA, awkward, awkward_rows, empty, labels, prose, table

SF = "/root/testdata/sf0.1"


class Brute:
    """Interpolated modified Kneser-Ney trigrams of one language, word by word."""

    def __init__(self, texts):
        self.c3 = Counter()
        for t in texts:
            w = ["<s>", "<s>", *t.split()]
            self.c3.update(zip(w, w[1:], w[2:]))
        self.c2 = Counter((b, c) for _, b, c in self.c3)
        self.c1 = Counter(c for _, c in self.c2)
        self.d = [self.discounts(c) for c in (self.c1, self.c2, self.c3)]

    @staticmethod
    def discounts(counts):
        n1, n2, n3, n4 = (sum(1 for c in counts.values() if c == i) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        d = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.75, 3 - 4 * y * n4 / n3 if n3 else 0.9)
        return [min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1)]

    def level(self, counts, order, context, key, lower):
        own = [c for k, c in counts.items() if k[:-1] == context]
        if not own:
            return lower
        den, d = sum(own), self.d[order - 1]
        gamma = sum(d[min(c, 3) - 1] for c in own) / den
        c = counts.get(key, 0)
        return (c - d[min(c, 3) - 1] if c else 0) / den + gamma * lower

    def p(self, a, b, c):
        den, d = sum(self.c1.values()), self.d[0]
        gamma = sum(d[min(n, 3) - 1] for n in self.c1.values()) / den
        n = self.c1.get(c, 0)
        one = (n - d[min(n, 3) - 1] if n else 0) / den + gamma / (len(self.c1) + 1)
        two = self.level(self.c2, 2, (b,), (b, c), one)
        return self.level(self.c3, 3, (a, b), (a, b, c), two)


def test_probabilities_against_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(30)]
    texts = {lang: [prose(rng, rng.randrange(1, 40), words[: 10 + 20 * (lang == "b")]) for _ in range(60)] for lang in "ab"}
    model = kn.train(spark.createDataFrame([(t, lang) for lang, own in texts.items() for t in own], "text string, lang string").repartition(4))
    shards = kn._load(model.path)
    asked = [prose(rng, 12, [*words, "never", "seen"]) for _ in range(20)]
    for lang, own in texts.items():
        brute = Brute(own)
        doc, logp = kn.log_probabilities(shards, model.unknown, pa.array(asked), [lang] * len(asked))
        want = [math.log(brute.p(*three)) for t in asked for w in [["<s>", "<s>", *t.split()]] for three in zip(w, w[1:], w[2:])]
        assert np.allclose(logp, want, atol=1e-4)
        every = [*brute.c1, "<unknown>"]
        for a, b in (("<s>", "<s>"), ("w1", "w2"), ("never", "w3")):
            assert abs(sum(brute.p(a, b, c) for c in every) - 1) < 1e-9


def test_thresholds_against_brute_force(spark):
    """Every held-out document scored word by word in plain Python, and the quantile taken by sorting."""
    rng = random.Random(12)
    vocabulary = {"en": [f"w{i}" for i in range(40)], "de": [f"v{i}" for i in range(25)]}
    rows = [(i, prose(rng, rng.randrange(1, 30), vocabulary[lang]), lang, "s", 1) for i in range(400) for lang in [rng.choice(["en", "de"])]]
    docs, own = spark.createDataFrame(rows, SCHEMA).repartition(5), labels(spark, [(i, 1, 0) for i in range(400)])
    model, got = kn.quality_model(docs, own, quantile=0.9)
    sample = kn.labelled_sample(docs, own, kn.ROWS, by_language=True)
    third = {r.doc_id: r.t for r in sample.selectExpr("doc_id", "pmod(xxhash64(3, doc_id), 3) as t").collect()}
    for lang in vocabulary:
        brute = Brute([t for i, t, x, *_ in rows if x == lang and third[i]])
        scores = []
        for i, t, x, *_ in rows:
            if x == lang and not third[i]:
                w = ["<s>", "<s>", *t.split()]
                scores.append((-sum(math.log(brute.p(*three)) for three in zip(w, w[1:], w[2:])), len(w) - 2))
        mean = sum(s for s, _ in scores) / sum(n for _, n in scores)
        averaged = sorted((s + kn.PRIOR * mean) / (n + kn.PRIOR) for s, n in scores)
        at = 0.9 * (len(averaged) - 1)
        want = averaged[int(at)] + (at - int(at)) * (averaged[min(int(at) + 1, len(averaged) - 1)] - averaged[int(at)])
        assert got[lang] == pytest.approx((mean, want), abs=1e-4)


def test_all_labelled_documents_count(spark):
    """More labelled documents of a language than a sample would take: each trains the model or sets the threshold."""
    rng, vocabulary = random.Random(13), [f"w{i}" for i in range(60)]
    rows = [(i, prose(rng, rng.randrange(1, 8), vocabulary), "en", "s", 1) for i in range(5000)]
    docs, own = spark.createDataFrame(rows, SCHEMA).repartition(5), labels(spark, [(i, 1, 0) for i in range(5000)])
    _, got = kn.quality_model(docs, own)
    held = {r.id for r in spark.range(5000).where("pmod(xxhash64(3, id), 3) = 0").collect()}
    brute, scores = Brute([t for i, t, *_ in rows if i not in held]), []
    for i, t, *_ in rows:
        if i in held:
            w = ["<s>", "<s>", *t.split()]
            scores.append((-sum(math.log(brute.p(*three)) for three in zip(w, w[1:], w[2:])), len(w) - 2))
    mean = sum(s for s, _ in scores) / sum(n for _, n in scores)
    want = np.quantile([(s + kn.PRIOR * mean) / (n + kn.PRIOR) for s, n in scores], kn.QUANTILE)
    assert got["en"] == pytest.approx((mean, want), abs=1e-5)


def test_more_shards_and_passes_change_nothing(spark, monkeypatch):
    """A model cut into many shards that are counted in several passes, of languages whose names begin alike."""
    rng = random.Random(14)
    texts = {lang: [prose(rng, rng.randrange(1, 40), [f"w{i}" for i in range(n)]) for _ in range(80)] for lang, n in (("language-a", 30), ("language-b", 45))}
    monkeypatch.setattr(kn, "SHARD_BYTES", 1000)
    model = kn.train(spark.createDataFrame([(t, lang) for lang, own in texts.items() for t in own], "text string, lang string").repartition(4))
    shards = kn._load(model.path)
    assert shards.bits > kn.LEAST_BITS
    asked = [prose(rng, 12, [*(f"w{i}" for i in range(45)), "never", "seen"]) for _ in range(20)]
    for lang, own in texts.items():
        brute = Brute(own)
        _, logp = kn.log_probabilities(shards, model.unknown, pa.array(asked), [lang] * len(asked))
        want = [math.log(brute.p(*three)) for t in asked for w in [["<s>", "<s>", *t.split()]] for three in zip(w, w[1:], w[2:])]
        assert np.allclose(logp, want, atol=1e-9)


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_all_labelled_by_language(spark, monkeypatch, broadcast):
    """Every labelled document with a language, the least text of those that come more than once, whether or not their
    ids are few enough to broadcast; all of them, some and none come once."""
    monkeypatch.setattr(labelled, "BROADCAST", broadcast)
    marks = [(i, i % 3 % 2, 0) for i in range(200)] + [(1, 0, 0), (None, 1, 0), (5, None, 0)]
    quality = {}
    for i, q, _ in marks:
        if i is not None and q is not None:
            quality[i] = min(q, quality.get(i, q))
    for rows in (awkward_rows(), [r for r in awkward_rows() if r[0] == 1], [r for r in awkward_rows() if r[0] and r[0] > 99], []):
        want: dict = {}
        for i, t, lang, *_ in rows:
            if i in quality and lang is not None:
                want[i, lang] = min((x for x in (want.get((i, lang)), t) if x is not None), default=None)
        got = table(kn.labelled_sample(awkward(spark, rows).repartition(3), labels(spark, marks), None, by_language=True))
        assert got == sorted(((i, t, lang, quality[i]) for (i, lang), t in want.items()), key=repr)


def test_sample_by_language(spark):
    """Each language has its own bound; which documents are taken doesn't depend on the order of rows."""
    rows = [(i, f"t{i}", "en" if i % 50 else "fr", "s", 1) for i in range(1000)]
    docs, own = spark.createDataFrame(rows, SCHEMA), labels(spark, [(i, 1, 0) for i in range(1000)])
    got = table(kn.labelled_sample(docs, own, 15, by_language=True), "lang", "doc_id")
    assert Counter(lang for lang, _ in got) == {"en": 15, "fr": 15}
    assert got == table(kn.labelled_sample(docs.repartition(7), own.repartition(3), 15, by_language=True), "lang", "doc_id")


def test_held_out_accuracy(spark):
    """Labelled rows that the model wasn't fitted on: half of the labels are hidden from it."""
    docs, own = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in kn.quality_filter(docs, own.where("doc_id % 2 = 0")).select("doc_id").collect()}
    hidden = own.where("doc_id % 2 = 1").collect()
    good = [r.doc_id in kept for r in hidden if r.quality == 1]
    bad = [r.doc_id in kept for r in hidden if r.quality == 0]
    assert np.mean(good) >= 0.985, np.mean(good)
    assert np.mean(bad) <= 0.5, np.mean(bad)


def trusted(spark, n=400):
    rng = random.Random(1)
    rows = [(1000 + i, prose(rng, rng.randrange(5, 80)), "en", "s", 1) for i in range(n)]
    return rows, labels(spark, [(r[0], 1, 0) for r in rows])


def test_awkward_rows(spark):
    rows, own = trusted(spark)
    docs = awkward(spark, awkward_rows() + rows)
    got = kn.quality_filter(docs, own, score="perplexity")
    assert got.columns == [*docs.columns, "perplexity"]
    kept = Counter(table(got, "doc_id", "text"))
    wordless = [r for r in awkward_rows() if not (r[1] or "").strip()]
    assert not any((r[0], r[1]) in kept for r in wordless)
    # no trusted text in these languages: they stay
    assert {i for i, t in kept if t == "no id here"} == {None} and kept[None, "no id here"] == 2
    assert kept[9, awkward_rows()[15][1]] == 1 and kept[2, "one two three four five"] == 1
    assert sum(kept[r[0], r[1]] for r in rows) >= 0.98 * len(rows)
    assert kept[5, awkward_rows()[11][1]] == 1


def test_nonsense_goes(spark):
    rows, own = trusted(spark)
    junk = [(1, " ".join(f"q{i}{j}" for j in range(60)), "en", "s", 1) for i in range(20)]
    kept = {r.text for r in kn.quality_filter(spark.createDataFrame(rows + junk, SCHEMA), own).collect()}
    assert not any(j[1] in kept for j in junk)


@pytest.mark.parametrize("own", [[], [(1, None, None), (None, 1, 0), (1, 0, 0)]])
def test_without_labels_only_wordless_rows_go(spark, own):
    got = kn.quality_filter(awkward(spark), labels(spark, own))
    assert got.count() == sum(bool((r[1] or "").strip()) for r in awkward_rows())


def test_empty_table(spark):
    assert kn.quality_filter(empty(spark), labels(spark, [(1, 1, 0)])).collect() == []
    assert kn.quality_filter(empty(spark), labels(spark)).collect() == []
