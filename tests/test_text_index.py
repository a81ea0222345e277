"""The stored text index against a scan of all texts, and what a search of it reads."""

import numpy as np
import pytest

from tessera.operators import usage
from tessera.sources import text_index

SCHEMA = "doc_id long, text string, section int, tf string"  # names that clash with those of the index


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(200)]
    share = 1 / np.arange(1, 201)
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(3, 120)), p=share / share.sum())), 1, "x") for i in range(1500)]
    rows += [(2000, None, 1, "x"), (2001, "", 1, "x"), (2002, "w150 " * 40_000 + "w0", 1, "x"), (2003, "W7, w7!", 1, "x"), (2003, "W7, w7!", 1, "x"), (2004, "W7, w7!", None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def best(docs, words, k):
    rows = usage.text_search(docs, words).collect()
    return sorted(((-round(r["score"], 9), r["doc_id"]) for r in rows))[:k]


@pytest.mark.parametrize("words, k", [(["w7"], 10), (["w0", "w150"], 5), (["w0", "w1", "w120"], 30), (["w150"], 2000), (["absent"], 5)])
def test_same_as_a_scan(spark, docs, tmp_path, words, k):
    text_index.write(docs, str(tmp_path), section=16)
    found = text_index.search(text_index.load(spark, str(tmp_path)), words, k)
    ours, theirs = sorted(found.rows.collect(), key=lambda r: r["rnk"]), best(docs, words, k)
    assert [r["doc_id"] for r in ours] == [i for _, i in theirs]
    assert np.allclose([r["score"] for r in ours], [-s for s, _ in theirs])
    if k < 50 and words != ["absent"]:
        assert found.read < found.known


def test_blocks_are_skipped(spark, docs, tmp_path):
    index = text_index.write(docs, str(tmp_path), section=16)
    found = text_index.search(index, ["w0", "w120"], 5)
    assert found.read < found.known / 2
    assert index.blocks().selectExpr("max(n)").first()[0] <= 16


def test_the_last_index_counts(spark, docs, tmp_path):
    first = text_index.write(docs, str(tmp_path))
    text_index.write(docs.where("doc_id >= 2003"), str(tmp_path))
    assert first.facts["total"] == 1506
    found = text_index.search(text_index.load(spark, str(tmp_path)), ["w7", "w7"], 5).rows.collect()
    assert [r["doc_id"] for r in sorted(found, key=lambda r: r["rnk"])] == [2003, 2003, 2004]
    assert text_index.search(first, ["w7"], 5).rows.count() == 5


def test_empty(spark, docs, tmp_path):
    with pytest.raises(ValueError):
        text_index.load(spark, str(tmp_path))
    index = text_index.write(docs.where("false"), str(tmp_path))
    assert text_index.search(index, ["w7"]).rows.count() == 0
