import base64
import random
from collections import Counter, defaultdict

import pytest
import tiktoken
from pyspark.sql import functions as F

from textlode.llm import packing
from textlode.llm.bpe import PATTERN, VOCABULARY
from textlode.llm.packing import SEPARATOR, Packer, Piece, pack

from .cases import SCHEMA, awkward, awkward_rows, empty, prose


def plain_codec():
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(rows):
    """(doc_id, ids and separator) of each row that has a text, encoded by the public library itself."""
    codec = plain_codec()
    return [(r[0], [*codec.encode_ordinary(r[1]), SEPARATOR]) for r in rows if r[1]]


def check(rows, windows, window):
    """Every id of every text, and one separator after it, lies in exactly one window; windows hold what they say."""
    want = Counter()
    for doc_id, ids in ids_of(rows):
        want.update((doc_id, at, tuple(ids[at : at + window])) for at in range(0, len(ids), window))
    got = Counter()
    for w in windows:
        assert 0 < w.fill == len(w.ids) == sum(w.lengths) <= window and len(w.doc_ids) == len(w.starts) == len(w.lengths)
        at = 0
        for doc_id, start, length in zip(w.doc_ids, w.starts, w.lengths):
            got[doc_id, start, tuple(w.ids[at : at + length])] += 1
            at += length
    assert got == want
    assert len({w.window for w in windows}) == len(windows)


def test_awkward_rows(spark):
    for window in (8, 64, 8192):
        check(awkward_rows(), pack(awkward(spark), window).collect(), window)


def brute(pieces, window, keep):
    """Best fit over (piece, size) with at most ``keep`` open windows, the fullest going out when nothing fits:
    (number, pieces, size, open) of each window."""
    open_, done, n = [], [], 0  # [free, number, pieces]
    for piece, size in pieces:
        fits = [w for w in open_ if w[0] >= size]
        if fits:
            w = min(fits, key=lambda w: (w[0], w[1]))
        else:
            if len(open_) == keep and size < window:
                out = min(open_, key=lambda w: (w[0], w[1]))
                open_.remove(out)
                done.append((*out[1:], window - out[0], False))
            w = [window, n, []]
            n += 1
            open_.append(w)
        w[2].append(piece)
        w[0] -= size
        if not w[0]:
            open_.remove(w)
            done.append((*w[1:], window, False))
    return done + [(*w[1:], window - w[0], True) for w in open_]


def test_one_task_against_brute_force():
    rng = random.Random(1)
    sizes = [rng.choice([100, rng.randrange(1, 100), rng.randrange(1, 20)]) for _ in range(800)]
    packer = Packer(100, 5)
    for i, size in enumerate(sizes):
        packer.add(Piece([i], [0], [size], [], size))
        assert len(packer.room) <= 5
    packer.close()
    got = [(name, [p.doc_ids[0] for p in own], sum(p.size for p in own), o) for name, own, o in packer.taken()]
    assert sorted(got) == sorted(brute(enumerate(sizes), 100, 5))


def test_rounds_of_merging_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randrange(0, 25)), "en", "s", 1) for i in range(700)]
    parts = spark.sparkContext.parallelize(rows, 9)
    window, keep, leftovers = 64, 4, 12
    got = {w.window: list(zip(w.doc_ids, w.starts, w.lengths)) for w in pack(parts.toDF(SCHEMA), window, keep, leftovers).collect()}
    ids, want, left = dict(ids_of(rows)), {}, {}
    for part, own in enumerate(parts.glom().collect()):
        pieces = [((r[0], at, len(x)), len(x)) for r in own if r[1] for at in range(0, len(ids[r[0]]), window) for x in [ids[r[0]][at : at + window]]]
        for number, held, size, open_ in brute(pieces, window, keep):
            (left if open_ else want)[part << 28 | number] = (held, size)
    round_, tasks = 0, 2
    while tasks > 1:
        tasks, round_ = -(-len(left) // leftovers), round_ + 1
        frame = spark.createDataFrame([(w,) for w in left], "window bigint")
        laid = frame.repartition(tasks, F.xxhash64("window")) if tasks > 1 else frame.repartition(1)
        of = defaultdict(list)
        for r in laid.select("window", F.spark_partition_id().alias("p")).collect():
            of[r.p].append(r.window)
        merged = {}
        for part, own in of.items():
            own.sort(key=lambda w: (-left[w][1], w))
            for number, held, size, open_ in brute([(w, left[w][1]) for w in own], window, keep):
                whole = ([x for w in held for x in left[w][0]], size)
                (merged if open_ and tasks > 1 else want)[round_ << 56 | part << 28 | number] = whole
        left = merged
    assert round_ >= 2 and {w: x for w, (x, _) in want.items()} == got


def test_windows_are_well_filled(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(1, 60)), "en", "s", 1) for i in range(900)]
    windows = pack(spark.createDataFrame(rows, SCHEMA), 256, keep=8, leftovers=64).collect()
    check(rows, windows, 256)
    assert sum(w.fill for w in windows) / (256 * len(windows)) > 0.9


def test_texts_of_whole_windows_only(spark):
    rows = [(i, " a" * (10 * i - 1), "en", "s", 1) for i in range(1, 5)]
    windows = pack(spark.createDataFrame(rows, SCHEMA), 10).collect()
    check(rows, windows, 10)
    assert all(w.fill == 10 for w in windows)


def test_empty_table(spark):
    assert pack(empty(spark)).collect() == []
    assert pack(spark.createDataFrame([(1, None, "en", "s", 1), (2, "", "en", "s", 1)], SCHEMA)).collect() == []


def test_rounds_must_end(spark):
    with pytest.raises(ValueError):
        pack(empty(spark), keep=10, leftovers=15)
