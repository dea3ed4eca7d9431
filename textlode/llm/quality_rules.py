"""Quality rules: a decision list learned by sequential covering, applied as Spark conditional expressions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import labelled_sample
from .shared import cuts, free_name, give_back, plain, small_batches
from .words import ALNUM, INKED, SAME, U, mix, raw, words

#: Labelled rows to learn from; share of them that rules grow on, the others prune them.
ROWS, GROW = 12_000, 2 / 3
#: A rule must be right on this share of the pruning rows it covers, and cover so many bad ones; cuts for a statistic.
PRECISION, COVER, CUTS, MOST_CONDITIONS, MOST_RULES = 0.97, 3, 48, 4, 24
#: Fresh splits on which a rule may fail in a row before covering ends.
TRIES = 4
#: Words within which distinct ones are counted; bytes of text that a worker looks at together.
STRETCH, AT_ONCE = 100, 1 << 19

STATISTICS = ["n_words", "word_length", "letters", "symbols", "upper", "digits", "bare_words", "marked_words", "distinct_words", "top_word", "stops", "lines"]


class Condition(NamedTuple):
    statistic: str
    above: bool
    cut: float

    def mask(self, rows: pd.DataFrame) -> np.ndarray:
        values = rows[self.statistic].to_numpy()
        return values > self.cut if self.above else values <= self.cut

    def column(self) -> Column:
        return F.col(self.statistic) > self.cut if self.above else F.col(self.statistic) <= self.cut

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = list[Condition]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*|!~^<>{}[]@=+_/\\"]] = True
_UPPER, _LOWER, _DIGIT = (np.isin(np.arange(256), [ord(c) for c in s]) for s in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"))


def _firsts(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (doc, h): their docs and how often each occurs."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return doc[new], np.diff(np.append(new, len(h)))


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The STATISTICS of each text, over all of it; 0 where there is nothing to divide by."""
    data, at = raw(texts)
    n = len(at) - 1

    def count(table: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(table[data], dtype=np.int64))
        return (sums[at[1:]] - sums[at[:-1]]).astype(np.float64)

    def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return np.divide(part, whole, out=np.zeros(n), where=whole > 0)

    w = words(texts, INKED, SAME)
    n_words, size = np.bincount(w.doc, minlength=n).astype(np.float64), np.diff(at).astype(np.float64)
    marks = np.append(0, np.cumsum(_SYMBOL[data], dtype=np.int64))
    marked = np.bincount(w.doc, marks[w.end] > marks[w.start], n)
    inner = np.append(0, np.cumsum(ALNUM[data], dtype=np.int64))
    bare = np.bincount(w.doc, inner[w.end] == inner[w.start], n)
    # distinct words are counted within each STRETCH words, so that long texts aren't taken for repetitive ones
    nth = np.arange(len(w.doc)) - (np.cumsum(n_words) - n_words).astype(np.int64)[w.doc]
    local = mix(w.hash + (nth // STRETCH).astype(U))
    apart = np.bincount(_firsts(w.doc, local)[0], minlength=n).astype(np.float64)
    doc, runs = _firsts(w.doc, w.hash)
    top = np.zeros(n)
    np.maximum.at(top, doc, runs)
    cased = count(_UPPER) + count(_LOWER)
    stops = np.zeros(256, bool)
    stops[[ord(c) for c in ".?"]] = True
    lines = np.zeros(256, bool)
    lines[10] = True
    return {
        "n_words": n_words, "word_length": share(np.bincount(w.doc, w.end - w.start, n), n_words), "letters": share(count(ALNUM), size),
        "symbols": share(count(_SYMBOL), size), "upper": share(count(_UPPER), cased), "digits": share(count(_DIGIT), size), "bare_words": share(bare, n_words),
        "marked_words": share(marked, n_words), "distinct_words": share(apart, n_words), "top_word": share(top, n_words),
        "stops": share(count(stops), n_words), "lines": share(count(lines), n_words),
    }


def _gain(p0: float, n0: float, p1: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """FOIL's information gain of narrowing (p0, n0) to (p1, n1)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p1 > 0, p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p0 / (p0 + n0))), -np.inf)


def _grow(rows: pd.DataFrame, bad: np.ndarray) -> Rule:
    rule: Rule = []
    live = np.ones(len(rows), bool)
    while len(rule) < MOST_CONDITIONS:
        p0, n0 = float((live & bad).sum()), float((live & ~bad).sum())
        if not n0 or not p0:
            break
        best: tuple[float, Condition | None] = (1e-9, None)
        for name in STATISTICS:
            values = rows[name].to_numpy()[live]
            truth = bad[live]
            cuts = np.unique(np.quantile(values, np.linspace(0, 1, CUTS), method="lower"))[:-1]
            if not len(cuts):
                continue
            nxt = np.array([values[values > c].min() for c in cuts])
            cuts = (cuts + nxt) / 2
            order = np.argsort(values)
            upto = np.searchsorted(values[order], cuts, side="right")
            low_p = np.append(0, np.cumsum(truth[order]))[upto].astype(float)
            low_n = upto - low_p
            for above, p1, n1 in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
                gains = _gain(p0, n0, p1, n1)
                i = int(np.argmax(gains))
                if gains[i] > best[0]:
                    best = (float(gains[i]), Condition(name, above, float(cuts[i])))
        if best[1] is None:
            break
        rule.append(best[1])
        live &= best[1].mask(rows)
    return rule


def _covers(rule: Rule, rows: pd.DataFrame) -> np.ndarray:
    out = np.ones(len(rows), bool)
    for condition in rule:
        out &= condition.mask(rows)
    return out


def _prune(rule: Rule, rows: pd.DataFrame, bad: np.ndarray) -> Rule:
    """The beginning of the rule that does best, by (p - n) / (p + n), on rows it hasn't seen."""

    def value(length: int) -> tuple[float, int]:
        hit = _covers(rule[:length], rows)
        p, n = float((hit & bad).sum()), float((hit & ~bad).sum())
        return ((p - n) / (p + n) if p + n else -1.0, length)

    return rule[: max(value(k) for k in range(1, len(rule) + 1))[1]]


def learn(rows: pd.DataFrame, seed: int = 7) -> list[Rule]:
    """An ordered list of rules that reject: each is a conjunction of thresholds grown on two thirds, drawn anew, of the
    rows that no earlier rule covers and pruned on the others; covering ends when TRIES draws in a row gave no rule that
    is precise enough and covers enough. ``rows`` holds STATISTICS and quality (0 bad, 1 good); their order and seed
    decide the draws, and rows are sorted first."""
    rules: list[Rule] = []
    random = np.random.default_rng(seed)
    rows = rows.sort_values([*STATISTICS, "quality"], kind="stable").reset_index(drop=True)
    failed = 0
    while len(rules) < MOST_RULES and failed < TRIES and len(rows):
        rows = rows.iloc[random.permutation(len(rows))].reset_index(drop=True)
        bad = (rows["quality"] == 0).to_numpy()
        cut = int(len(rows) * GROW)
        rule = _grow(rows[:cut], bad[:cut])
        if rule and bad[cut:].any():
            rule = _prune(rule, rows[cut:], bad[cut:])
            hit = _covers(rule, rows[cut:])
            right = int((hit & bad[cut:]).sum())
            if right >= COVER and right >= PRECISION * hit.sum():
                rules.append(rule)
                rows = rows[~_covers(rule, rows)].reset_index(drop=True)
                failed = 0
                continue
        failed += 1
    return rules


def decision(rules: list[Rule], names: dict[str, str]) -> Column:
    """Number of the first rule that holds, from 1; 0 for a text without a word; null for those to keep.

    ``names`` has what the statistics are called.
    """
    out = F.when(F.col(names["n_words"]) == 0, F.lit(0))
    for i, rule in enumerate(rules, 1):
        tests = [Condition(names[c.statistic], c.above, c.cut).column() for c in rule]
        out = out.when(reduce(and_, tests), F.lit(i))
    return out


def _measured(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    try:
        for text in texts:
            at = cuts(text, AT_ONCE)
            parts = [measure(text.slice(i, j - i)) for i, j in zip(at[:-1], at[1:])]
            yield pa.StructArray.from_arrays([pa.array(np.concatenate([p[s] for p in parts])) for s in STATISTICS], STATISTICS)
    finally:
        give_back()


def with_statistics(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with a struct of the STATISTICS of its text under a free name, and what each is called. Only texts go
    to the workers, and only numbers come back."""
    small_batches(docs.sparkSession)

    @F.arrow_udf(", ".join(f"{s} double" for s in STATISTICS))
    def statistics(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _measured(texts)

    name = free_name(docs, "_statistics")
    # said not to be deterministic so that filters on it don't compute it anew
    return docs.withColumn(name, statistics.asNondeterministic()(plain(docs, "text", "string"))), {s: f"`{name}`.`{s}`" for s in STATISTICS}


def learned_rules(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> list[Rule]:
    """Rules from at most ``rows`` labelled documents; none if either label is missing."""
    sample = labelled_sample(docs, labels, rows).select("quality", "text")
    measured, names = with_statistics(sample)
    table = measured.select("quality", *[F.col(names[s]).alias(s) for s in STATISTICS]).toPandas()
    return learn(table) if table["quality"].nunique() > 1 else []


def quality_rules(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """The rows of ``docs``, in all their columns, that no learned rule rejects.

    Rules are conjunctions of thresholds on STATISTICS, learned from at most ``rows`` labelled rows, tried in order as
    one CASE expression. A null, empty or wordless text is rejected; without labels of both kinds nothing else is. A
    very long text is measured to its end. A null doc_id or lang doesn't matter; repeated rows are decided alike, and
    a statistic that equals a threshold lies below it; further columns pass through whatever their names; an empty
    table gives an empty table. One pass, no exchange.
    """
    rules = learned_rules(docs, labels, rows)
    measured, names = with_statistics(docs)
    return measured.where(decision(rules, names).isNull()).select(*[F.col(f"`{c}`") for c in docs.columns])
