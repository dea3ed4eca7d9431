import math
import random
from collections import Counter

import numpy as np
import pytest

from textlode.llm import bloom_lm as lm
from textlode.llm.words import U, mix

from .cases import SCHEMA, awkward, awkward_rows, empty, prose


def test_filter_never_underestimates_and_seldom_errs():
    rng = np.random.default_rng(1)
    keys = mix(np.arange(1, 50_001, dtype=U))
    counts = np.minimum(rng.zipf(1.5, len(keys)), 10**6).astype(np.int64)
    f = lm.build([(keys[:20_000], counts[:20_000]), (keys[20_000:], counts[20_000:])])
    found, true = lm.probe(f, keys), lm.level(counts)
    assert (found >= true).all() and (found > true).mean() < 0.04
    assert (lm.probe(f, mix(np.arange(10**6, 10**6 + 50_000, dtype=U))) > 0).mean() < 0.04


def test_a_level_stands_for_its_counts():
    counts = np.arange(1, 5000)
    levels = lm.level(counts)
    assert levels[0] == 1 and (np.diff(levels) >= 0).all()
    for n in np.unique(levels):
        own = counts[levels == n]
        if own[-1] < 4000:
            assert lm.expected(np.array([n]))[0] == (own[0] + own[-1]) / 2
    assert lm.expected(np.array([0]))[0] == 0


def split(text):
    """Runs of anything but ASCII white space and control characters."""
    out = [""]
    for c in text:
        if ord(c) > 32 and ord(c) != 127:
            out[-1] += c
        elif out[-1]:
            out.append("")
    return [w for w in out if w]


def brute(rows):
    """Scores from exact counts, quantised as the filter does."""
    one, two, contexts = Counter(), Counter(), Counter()
    for r in rows:
        w = split(r[1] or "")
        one.update(w)
        pairs = list(zip([None, *w], w))
        two.update(pairs)
        contexts.update([None] if w else [])
    total, kinds = sum(one.values()), len(one)
    mid = lambda n: float(lm.expected(lm.level(np.array([n])))[0]) if n else 0.0
    out = []
    for r in rows:
        w = split(r[1] or "")
        logp = 0.0
        for v, x in zip([None, *w], w):
            low = (1 - lm.UNSEEN) * min(mid(one[x]) / total, 1) + lm.UNSEEN / (kinds + 1)
            context = mid(contexts[None] if v is None else one[v])
            logp += math.log((min(mid(two[v, x]), context) + lm.ALPHA * low) / (context + lm.ALPHA))
        out.append((r[0], len(w), logp))
    return out


def close(got, want):
    got = sorted(((r.doc_id, r.n_words, r.log_prob) for r in got), key=lambda r: (repr(r[0]), r[1], round(r[2], 1)))
    want = sorted(want, key=lambda r: (repr(r[0]), r[1], round(r[2], 1)))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    off = [abs(g[2] - w[2]) / max(1.0, abs(w[2])) for g, w in zip(got, want)]
    assert np.median(off) < 0.01 and np.quantile(off, 0.9) < 0.03 and max(off) < 0.35, (np.median(off), max(off))


def corpus():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)]
    return [(i, prose(rng, rng.randrange(5, 200), vocabulary[: rng.choice([20, 300])]), "en", "s", 1) for i in range(200)]


@pytest.mark.parametrize("shard_bytes", [lm.SHARD_BYTES, 5000])
def test_scores_against_exact_counts(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(lm, "SHARD_BYTES", shard_bytes)
    rows = corpus()
    close(lm.lm_scores(spark.createDataFrame(rows, SCHEMA)).collect(), brute(rows))


def test_probing_where_the_shards_lie_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_BYTES", 5000)
    docs = awkward(spark, awkward_rows()[:10] + corpus()).repartition(3)
    order = lambda df: sorted(((r.doc_id, r.n_words, round(r.log_prob, 6), r.perplexity and round(r.perplexity, 6)) for r in df.collect()), key=repr)
    assert order(lm.lm_scores(docs, 0)) == order(lm.lm_scores(docs))


def test_awkward_rows(spark):
    rows = awkward_rows()
    got = lm.lm_scores(awkward(spark)).collect()
    close(got, brute(rows))
    for r in got:
        assert (r.perplexity is None) == (r.n_words == 0) and (r.n_words or r.log_prob == 0)
    for limit in (lm.BROADCAST, 0):
        assert lm.lm_scores(empty(spark), limit).collect() == []
    only = spark.createDataFrame([(1, None, "en", "s", 1), (None, "", "en", "s", 1)], SCHEMA)
    assert [tuple(r)[1:] for r in lm.lm_scores(only).collect()] == [(0, 0.0, None)] * 2


def test_what_is_gathered_grows_with_the_corpus(spark, monkeypatch):
    seen = []
    plain = lm.written
    monkeypatch.setattr(lm, "written", lambda df, name: seen.append(plain(df, name)) or seen[-1])
    for n in (50, 200):
        lm.lm_scores(spark.createDataFrame([(i, f"new{i} words{i} here{i}", "en", "s", 1) for i in range(n)], SCHEMA)).collect()
    sizes = [df.selectExpr("sum(size)").first()[0] for df, _ in seen]
    assert sizes[1] > 3.5 * sizes[0]
