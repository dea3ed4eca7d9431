import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from textlode.llm import minhash as mh
from textlode.llm.shared import located, matched

from .cases import SCHEMA, awkward, awkward_rows, empty, prose, table


def bags(texts):
    doc, element, weight = mh.weighted(pa.array(texts))
    out = [Counter() for _ in texts]
    for d, e, w in zip(doc.tolist(), element.tolist(), weight.tolist()):
        out[d][e] = w
    return out


def jaccard(a, b):
    both = set(a) | set(b)
    return sum(min(a[x], b[x]) for x in both) / max(1, sum(max(a[x], b[x]) for x in both))


def test_agreement_estimates_weighted_similarity():
    rng = random.Random(1)
    base = [rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(400)]
    texts = []
    for share in (0, 0.02, 0.05, 0.1, 0.2, 0.5):
        texts.append(" ".join(w if rng.random() > share else f"new{rng.randrange(10**6)}" for w in base))
    texts += ["a b c " * 50, "a b c " * 100]  # the same shingles with other weights
    own = bags(texts)
    doc, element, weight = mh.weighted(pa.array(texts))
    sigs = mh.signatures(doc, element, weight, len(texts), 2048)
    for i, a in enumerate(own):
        for j, b in enumerate(own):
            assert abs((sigs[i] == sigs[j]).mean() - jaccard(a, b)) < 0.05


def test_signature_depends_on_the_text_alone():
    rng = random.Random(2)
    texts = [prose(rng, rng.randrange(0, 80)) for _ in range(40)]
    doc, element, weight = mh.weighted(pa.array(texts))
    whole = mh.signatures(doc, element, weight, len(texts))
    for i, t in enumerate(texts):
        d, e, w = mh.weighted(pa.array([t]))
        assert (mh.signatures(d, e, w, 1)[0] == whole[i]).all()


def planted(seed, groups=25, lonely=120):
    """Rows with near copies: words replaced, dropped or added."""
    rng = random.Random(seed)
    fresh = lambda n: " ".join("w" + str(rng.randrange(5000)) for _ in range(n))
    texts = [fresh(rng.randrange(30, 300)) for _ in range(lonely)]
    for _ in range(groups):
        base = fresh(rng.randrange(60, 400)).split()
        for _ in range(rng.randrange(2, 6)):
            rate = rng.choice([0, 0.01, 0.03, 0.05])
            texts.append(" ".join(w if rng.random() >= rate else rng.choice(["", "changed" + str(rng.randrange(99)), w + " extra"]) for w in base))
    rng.shuffle(texts)
    return [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]


def roots_of(n, pairs):
    root = list(range(n))
    for a, b in pairs:
        a, b = root[a], root[b]
        root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_recall_and_precision_against_brute_force(spark):
    rows = planted(4)
    own = bags([r[1] for r in rows])
    close = [(a, b, jaccard(own[a], own[b])) for a in range(len(rows)) for b in range(a)]
    signed, _, groups = mh.near_groups(located(spark.createDataFrame(rows, SCHEMA), "test"))
    root = {r.node: r.root for r in groups.collect()}
    of = {r.doc_id: root.get(r.node, r.node) for r in signed.collect()}
    want = [(a, b) for a, b, s in close if s >= 0.55]
    found = [of[a] == of[b] for a, b in want]
    assert len(want) > 40 and sum(found) >= 0.97 * len(want)
    apart = roots_of(len(rows), [(x, y) for x, y, t in close if t >= 0.3])
    assert all(apart[a] == apart[b] for a, b, _ in close if of[a] == of[b])


def test_one_row_of_each_group_stays(spark):
    rows = planted(5)
    own = bags([r[1] for r in rows])
    strong = roots_of(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if jaccard(own[a], own[b]) >= 0.6])
    kept = {r.doc_id for r in mh.near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {i for i, r in enumerate(strong) if r == i}
    assert len(kept & want) >= 0.97 * len(want) and len(kept - want) <= 0.03 * len(want)


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = mh.near_dedup(docs)
    assert got.columns == docs.columns
    kept, rows = table(got, "doc_id", "text"), awkward_rows()
    # rows without a word all stay, repeats included
    bare = [(r[0], r[1]) for r in rows if r[1] is None or not any(c.isalnum() or ord(c) > 127 for c in r[1])]
    assert Counter(x for x in kept if x in bare) == Counter(bare)
    assert [x for x in kept if x[1] == "one two three four five"] == [(1, "one two three four five")]
    assert [x for x in kept if x[1] == "no id here"] == [(None, "no id here")]
    assert sum(1 for x in kept if x[1] and len(x[1]) > 100_000) == 1
    assert {x for x in kept if x[0] == 11} == {(11, "tie"), (11, "other tie")}


def test_empty_table(spark):
    assert mh.near_dedup(empty(spark)).collect() == []
    only = spark.createDataFrame([(1, None, "en", "s", 1), (2, "", "en", "s", 1)], SCHEMA)
    assert mh.near_dedup(only).count() == 2


def test_many_copies(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(900)}" for _ in range(80)]
    rows = [(i, " ".join(w if j != i % 40 else f"z{i}" for j, w in enumerate(base)), "en", "s", 1) for i in range(600)]
    assert table(mh.near_dedup(spark.createDataFrame(rows, SCHEMA)), "doc_id") == [(0,)]


def test_wide_buckets_equal_comparing_all():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 16, (200, mh.COORDINATES), dtype=np.uint16)
    base[:, : mh.ROWS] = 7  # one band brings all together
    sigs = np.repeat(base, 3, axis=0)
    change = rng.random(sigs.shape) < 0.2
    change[:, : mh.ROWS] = False
    sigs[change] = rng.integers(0, 1 << 16, int(change.sum()), dtype=np.uint16)
    same = [(a, b) for a in range(len(sigs)) for b in range(a) if (sigs[a] == sigs[b]).mean() >= mh.THRESHOLD]
    assert roots_of(len(sigs), mh.linked(sigs, mh.THRESHOLD)) == roots_of(len(sigs), same)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101)], "a bigint, b bigint")
    got = dict((r.node, r.root) for r in mh.components(edges).collect())
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def one_band_in_common(seed, pairs=400):
    """Signatures that all share the first band, in pairs that agree in 59 to 70 coordinates and share no other."""
    rng = np.random.default_rng(seed)
    sigs = rng.integers(0, 1 << 16, (2 * pairs, mh.COORDINATES), dtype=np.uint16)
    sigs[:, : mh.ROWS] = 7
    free = [mh.ROWS * b + i for b in range(1, mh.COORDINATES // mh.ROWS) for i in range(mh.ROWS - 1)]
    for i in range(pairs):
        same = rng.choice(free, rng.integers(59, 71) - mh.ROWS, replace=False)
        sigs[i + pairs, same] = sigs[i, same]
    return sigs


def test_pairs_of_a_wide_bucket_that_share_one_band_only():
    sigs = one_band_in_common(6)
    assert {(i, i + 400) for i in range(400)} == set(mh.linked(sigs, 59 / 128))


def test_two_wide_bands_that_bring_the_same_rows_together():
    sigs = one_band_in_common(7)
    sigs[:, mh.ROWS : 2 * mh.ROWS] = 9
    pairs = set(mh.linked(sigs, 59 / 128))
    assert {(i, i + 400) for i in range(400)} == pairs


def test_wide_buckets_in_blocks(spark):
    sigs = one_band_in_common(8)
    signed = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(sigs)], "node bigint, sig binary")
    got = {(r.a, r.b) for r in mh.similar(signed, mh.COORDINATES, mh.ROWS, 59 / 128, block=90).collect()}
    assert got == {(i, i + 400) for i in range(400)}


@pytest.mark.parametrize("rows", [257, 5000])
def test_a_wide_bucket_of_pairs_that_share_one_band(spark, rows):
    """Wide and widest buckets, whose blocks come by number and by hash: all pairs of one band are found."""
    sigs = one_band_in_common(rows, (rows + 1) // 2)
    nodes = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(sigs)], "node bigint, sig binary").repartition(3)
    for block in (rows // 3, 4096):
        got = {(r.a, r.b) for r in mh.similar(nodes, mh.COORDINATES, mh.ROWS, 59 / 128, block=block).collect()}
        assert got == {(i, i + len(sigs) // 2) for i in range(len(sigs) // 2)}


def test_hot_keys_are_joined_like_others(spark):
    rows = spark.createDataFrame([(i, i % 3 and i) for i in range(90)], "row bigint, key bigint")
    facts = rows.groupBy("key").agg(mh.F.count("*").alias("n"), mh.F.min("row").alias("least")).where("key % 2 = 0")
    want = table(rows.join(facts.drop("n"), "key"), "key", "row", "least")
    assert table(matched(rows, facts, "key", hot=10), "key", "row", "least") == want == table(matched(rows, facts, "key"), "key", "row", "least")


def test_short_texts_take_little_memory():
    texts = pa.array([f"a{i} b{i % 7} c d{i % 11}" for i in range(10_000)])
    ids = pa.array(range(10_000), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, ids, texts], ["file", "row", "doc_id", "text"])
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in mh._signed(mh.COORDINATES, mh.SHINGLE)([batch])) == 10_000
        assert tracemalloc.get_traced_memory()[1] < 300e6
    finally:
        tracemalloc.stop()


def test_recall_of_pairs_down_to_the_similarity_looked_for():
    """Pairs of sets of known similarity, from those looked for up: nine of ten at least share a band and agree enough;
    so do nine of ten of those that only just agree enough share a band."""
    rng = np.random.default_rng(11)
    n, size = 400, 240
    for similarity in (0.5, 0.55, 0.6):
        both = round(2 * size * similarity / (1 + similarity))  # of each text's elements
        shared = rng.integers(0, 1 << 63, (n, both)).astype(mh.U)
        own = [np.concatenate([shared, rng.integers(0, 1 << 63, (n, size - both)).astype(mh.U)], axis=1) for _ in range(2)]
        doc = np.repeat(np.arange(n), size)
        a, b = (mh.signatures(doc, x.ravel(), np.ones(n * size), n) for x in own)
        met = (mh.band_hashes(a, mh.ROWS) == mh.band_hashes(b, mh.ROWS)).any(axis=1)
        agree = (a == b).mean(axis=1) >= mh.THRESHOLD
        assert (met & agree).mean() >= 0.9, (similarity, (met & agree).mean())
    least = int(np.ceil(mh.THRESHOLD * mh.COORDINATES))
    a, b = (rng.integers(0, 1 << 16, (2000, mh.COORDINATES), dtype=np.uint16) for _ in range(2))
    for x, y in zip(a, b):
        same = rng.choice(mh.COORDINATES, least, replace=False)
        y[same] = x[same]
    assert (mh.band_hashes(a, mh.ROWS) == mh.band_hashes(b, mh.ROWS)).any(axis=1).mean() >= 0.9
