import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from textlode.llm import quality_rules as qr

from .cases import SCHEMA, awkward, awkward_rows, empty, labels, prose, table

SF = "/root/testdata/sf0.1"


def test_statistics_against_plain_python():
    rng = random.Random(2)
    texts = [prose(rng, rng.randrange(0, 300)) + rng.choice(["", "\n$$ 12 %%\n", " ???", "ABC"]) for _ in range(40)] + ["", None, "   ", "é"]
    got = qr.measure(pa.array(texts))
    for i, t in enumerate(texts):
        t = t or ""
        w, data = t.split(), t.encode()
        n = len(w)
        want = {
            "n_words": n, "word_length": sum(len(x.encode()) for x in w) / n if n else 0, "digits": sum(48 <= b < 58 for b in data) / len(data) if data else 0,
            "top_word": max(map(w.count, w)) / n if n else 0, "distinct_words": sum(len(set(w[k : k + qr.STRETCH])) for k in range(0, n, qr.STRETCH)) / n if n else 0,
            "lines": t.count("\n") / n if n else 0, "stops": sum(t.count(c) for c in ".?") / n if n else 0,
            "marked_words": sum(any(c in "#$%&*|!~^<>{}[]@=+_/\\" for c in x) for x in w) / n if n else 0,
            "bare_words": sum(not any(c.isalnum() for c in x) for x in w) / n if n else 0,
        }
        for name, value in want.items():
            assert got[name][i] == pytest.approx(value), (name, t[:60])


def synthetic(n=900, seed=0):
    rng = np.random.default_rng(seed)
    rows = pd.DataFrame({s: rng.random(n) for s in qr.STATISTICS})
    bad = (rows["symbols"] > 0.8) & (rows["upper"] <= 0.6) | (rows["digits"] > 0.9)
    return rows.assign(quality=(~bad).astype(int))


def test_rules_cover_what_is_bad():
    rules = qr.learn(synthetic())
    assert rules and len(rules) <= qr.MOST_RULES and all(len(r) <= qr.MOST_CONDITIONS for r in rules)
    fresh = synthetic(seed=1)
    hit = np.zeros(len(fresh), bool)
    for rule in rules:
        hit |= qr._covers(rule, fresh)
    bad = fresh["quality"].to_numpy() == 0
    assert (hit == bad).mean() > 0.97 and (hit & ~bad).sum() <= 0.03 * (~bad).sum()


def brute_learn(table, seed=7):
    """Sequential covering in plain loops over dictionaries: every cut of every statistic is counted anew."""
    random_, rules, failed = np.random.default_rng(seed), [], 0
    rows = sorted(table.to_dict("records"), key=lambda r: [r[s] for s in [*qr.STATISTICS, "quality"]])

    def holds(rule, r):
        return all((r[c.statistic] > c.cut) == c.above for c in rule)

    def tally(own):
        return sum(r["quality"] == 0 for r in own), sum(r["quality"] != 0 for r in own)

    def grow(own):
        rule = []
        while len(rule) < qr.MOST_CONDITIONS:
            live = [r for r in own if holds(rule, r)]
            p0, n0 = tally(live)
            if not p0 or not n0:
                break
            best = (1e-9, None)
            for name in qr.STATISTICS:
                values = sorted(r[name] for r in live)
                picks = sorted({values[int(np.floor(q * (len(values) - 1)))] for q in np.linspace(0, 1, qr.CUTS)})[:-1]
                for above in (False, True):
                    for v in picks:
                        cut = (v + min(x for x in values if x > v)) / 2
                        p, n = tally([r for r in live if (r[name] > cut) == above])
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))) if p else -np.inf
                        if gain > best[0]:
                            best = (gain, qr.Condition(name, above, cut))
            if best[1] is None:
                break
            rule.append(best[1])
        return rule

    while len(rules) < qr.MOST_RULES and failed < qr.TRIES and rows:
        rows = [rows[i] for i in random_.permutation(len(rows))]
        cut = int(len(rows) * qr.GROW)
        old, new = rows[:cut], rows[cut:]
        rule = grow(old)
        failed += 1
        if rule and tally(new)[0]:
            worth = []
            for k in range(1, len(rule) + 1):
                p, n = tally([r for r in new if holds(rule[:k], r)])
                worth.append(((p - n) / (p + n) if p + n else -1.0, k))
            rule = rule[: max(worth)[1]]
            p, n = tally([r for r in new if holds(rule, r)])
            if p >= qr.COVER and p >= qr.PRECISION * (p + n):
                rules.append(rule)
                rows = [r for r in rows if not holds(rule, r)]
                failed = 0
    return rules


@pytest.mark.parametrize("seed", [0, 3])
def test_learner_against_brute_force(seed):
    got, want = qr.learn(synthetic(240, seed)), brute_learn(synthetic(240, seed))
    assert got and [[(c.statistic, c.above) for c in r] for r in got] == [[(c.statistic, c.above) for c in r] for r in want]
    assert np.allclose([c.cut for r in got for c in r], [c.cut for r in want for c in r])


def test_order_of_rows_does_not_matter():
    rows = synthetic()
    assert qr.learn(rows) == qr.learn(rows.sample(frac=1, random_state=4))


def test_expression_equals_rules_tried_in_order(spark):
    rules, fresh = qr.learn(synthetic()), synthetic(300, seed=2)
    fresh.loc[:9, "n_words"] = 0.0
    got = spark.createDataFrame(fresh).select(*qr.STATISTICS, qr.decision(rules, {s: s for s in qr.STATISTICS}).alias("rule")).toPandas()
    for i in range(len(got)):
        row = got.iloc[[i]]
        want = 0 if row["n_words"].iloc[0] == 0 else next((k for k, rule in enumerate(rules, 1) if qr._covers(rule, row)[0]), None)
        assert (None if pd.isna(row["rule"].iloc[0]) else row["rule"].iloc[0]) == want


def test_held_out_accuracy(spark):
    docs, own = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in qr.quality_rules(docs, own.where("doc_id % 2 = 0")).select("doc_id").collect()}
    hidden = own.where("doc_id % 2 = 1").collect()
    good = [r.doc_id in kept for r in hidden if r.quality == 1]
    bad = [r.doc_id in kept for r in hidden if r.quality == 0]
    assert np.mean(good) >= 0.98, np.mean(good)
    assert np.mean(bad) <= 0.5, np.mean(bad)


def marked(spark):
    """Good prose and bad rows full of symbols, labelled."""
    rng = random.Random(4)
    rows = [(1000 + i, prose(rng, rng.randrange(20, 80)), "en", "s", 1) for i in range(300)]
    rows += [(2000 + i, " ".join(rng.choice(["$$", "##", "x|x"]) for _ in range(40)), "en", "s", 1) for i in range(100)]
    return rows, labels(spark, [(r[0], int(r[0] < 2000), 0) for r in rows])


def test_awkward_rows(spark):
    rows, own = marked(spark)
    docs = awkward(spark, awkward_rows() + rows)
    got = qr.quality_rules(docs, own)
    assert got.columns == docs.columns
    kept = table(got, "doc_id", "text")
    assert {i for i, _ in kept if i and 1000 <= i < 2000} == set(range(1000, 1300)) and not any(i and i >= 2000 for i, _ in kept)
    assert not any(not (t or "").strip() for _, t in kept)
    assert kept.count((1, "one two three four five")) == 2


def test_without_both_labels_only_wordless_rows_go(spark):
    for own in ([], [(1, 1, 0)], [(None, 0, 0), (1, None, None)]):
        got = qr.quality_rules(awkward(spark), labels(spark, own))
        assert got.count() == sum(bool((r[1] or "").strip()) for r in awkward_rows())


def test_empty_table(spark):
    assert qr.quality_rules(empty(spark), labels(spark, [(1, 1, 0)])).collect() == []
    measured, names = qr.with_statistics(empty(spark))
    assert measured.count() == 0 and set(names) == set(qr.STATISTICS)
