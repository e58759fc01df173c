"""The pipeline's stages on a small table, each against a plain version on its own input."""

import brute
import corpus_pipeline
import numpy as np
import pytest

from tripleloom.llm import quality, stages
from tripleloom.llm.common import table, written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    out = [table(spark, SF, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), name.replace(" ", "-")))
    return out


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_keep_the_columns(steps):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(df.columns == steps[0].columns for df in steps[:-1])
    counts = [df.count() for df in steps[:-1]]
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[2]


def test_quality_stage(spark, steps):
    scores = {r["doc_id"]: r["score"] for r in quality.classify(steps[0], table(spark, SF, "labels")).collect()}
    assert texts_of(steps[1]).keys() == {d for d, s in scores.items() if s >= 0.3}


def test_one_of_each_group(steps):
    classes, _ = brute.classes(texts_of(steps[1]))
    assert texts_of(steps[2]).keys() == set(classes.values())


def test_one_row_of_each_group_when_ids_repeat(spark):
    """Unlike texts of one id all stay; of a group that several ids have, only the row of the least id goes on."""
    a, b, c, d = (" ".join(f"{name}{i}" for i in range(60)) for name in "abcd")
    rows = [(1, a), (1, b), (1, a), (2, b), (3, c), (3, a + " more"), (3, d), (None, a), (4, c.upper())]
    kept = stages.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted([(1, a), (1, b), (3, c), (3, d), (0, a)])


def test_repeats_go(steps):
    before, after = texts_of(steps[2]), texts_of(steps[3])
    covered = brute.covered_words(before)
    left = {d: brute.words(t) for d, t in after.items()}
    assert all(len(left.get(d, [])) <= len(brute.words(before[d])) - 0.9 * len(c) for d, c in covered.items() if c)
    assert all(after[d] == before[d] for d in before if d in after and len(left[d]) == len(brute.words(before[d])))
    assert all(r["n_chars"] == len(r["text"]) for r in steps[3].collect() if r["text"] != before[r["doc_id"]])


def test_benchmark_goes(spark, steps):
    items = {r["item_id"]: r["text"] for r in table(spark, SF, "benchmark").collect()}
    before = texts_of(steps[3])
    assert texts_of(steps[4]).keys() == {d for d, t in before.items() if not brute.contamination(t, items)[0]}


def test_packed_last(spark, steps):
    left = texts_of(steps[4])
    pieces = steps[5].collect()
    assert {r["doc_id"] for r in pieces} == left.keys()
    ends = [np.frombuffer(r["ids"], "<u4")[-1] for r in pieces if r["start"] + r["length"] == r["doc_tokens"]]
    assert len(ends) == len(left) and set(ends) == {1}


def test_run(spark, steps):
    columns = ["doc_id", "start", "length", "ids"]
    assert sorted(corpus_pipeline.run(spark, SF).select(columns).collect()) == sorted(steps[5].select(columns).collect())
