"""The pipeline's stages against a brute-force reading of what each leaves, and all ten queries on a small table."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline
from textlode.llm import kneser_ney, packing, quality_rules
from textlode.llm.queries import QUERIES
from textlode.llm.shared import written

from .cases import awkward, awkward_rows, empty, labels, prose, table
from .test_exact_dedup import brute
from .test_packing import check

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "quality rules", "exact dedup", "near dedup", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, _ = written(stage(spark, docs, SF), "test")
        after = docs.collect()
        assert docs.columns == columns and not Counter(after) - Counter(before), name
        if name == "exact dedup":
            assert sorted(((r.doc_id, r.text) for r in after), key=repr) == brute([tuple(r) for r in before])
        assert after
        before = after
    check([tuple(r) for r in before], corpus_pipeline.run(spark, SF).collect(), packing.WINDOW)


def test_awkward_rows_and_clashing_columns(spark, tmp_path):
    """Nulls, empty and very long texts, ties, repeats and columns with the operators' own names, through all stages."""
    rng = random.Random(6)
    good = [(1000 + i, prose(rng, rng.randrange(5, 80)), "en", "s", 1) for i in range(300)]
    bad = [(2000 + i, " ".join(rng.choice(["$$", "##", "x|x"]) for _ in range(40)), "xx", "s", 1) for i in range(100)]
    awkward(spark, awkward_rows() + good + bad).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, [(r[0], int(r[0] < 2000), 0) for r in good + bad]).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, _ = written(stage(spark, docs, str(tmp_path)), "test")
        assert docs.columns == columns
        kept[name] = table(docs, "doc_id", "text")
    wordless = [r for r in awkward_rows() if not (r[1] or "").strip()]
    assert wordless and not any((r[0], r[1]) in kept["quality classifier"] for r in wordless)
    assert not any(i and i >= 2000 for i, _ in kept["quality rules"]) and sum(bool(i and 1000 <= i < 2000) for i, _ in kept["quality rules"]) >= 290
    assert kept["exact dedup"] == brute([(i, t) for i, t in kept["quality rules"]])
    assert len([i for i, t in kept["near dedup"] if t == "one two three four five"]) == 1 and set(kept["near dedup"]) <= set(kept["exact dedup"])
    windows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    check(kept["near dedup"], windows, packing.WINDOW)


def test_filters_depend_on_their_own_rows_only(spark):
    """A filtering stage decides each row by what it learned, whatever else is in the table."""
    docs, own = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rules = quality_rules.learned_rules(docs, own)
    measured, names = quality_rules.with_statistics(docs)
    want = {r.doc_id for r in measured.where(quality_rules.decision(rules, names).isNull()).collect()}
    assert {r.doc_id for r in quality_rules.quality_rules(docs, own).collect()} == want
    model, limits = kneser_ney.quality_model(docs, own)
    rated, name = kneser_ney.scored(docs, model)
    want = set()
    for r in rated.collect():
        mean, limit = limits.get(r.lang, (0, float("inf")))
        if r[name].n and (r[name].nll + kneser_ney.PRIOR * mean) / (r[name].n + kneser_ney.PRIOR) <= limit:
            want.add(r.doc_id)
    assert {r.doc_id for r in kneser_ney.quality_filter(docs, own).collect()} == want


def test_empty_documents(spark, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    empty(spark).select(*columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_runs_on_all_rows(spark, name):
    got = QUERIES[name](spark, SF)
    ids = {r.doc_id for r in got.select("doc_id" if "doc_id" in got.columns else F.explode("doc_ids").alias("doc_id")).collect()}
    every = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert ids <= every and len(ids) > 0.5 * len(every)


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(driver.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 11))
