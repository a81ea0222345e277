"""Repeated doc_ids are judged by row; benchmark rows without id count as hits."""

import corpus_pipeline
from tessera.llm import decontaminate, jaccard

A, B, C = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")


def test_repeated_ids_with_several_texts(spark):
    rows = [(1, A, "x"), (2, B, "x"), (2, A, "x"), (3, C, "x"), (3, C, "y"), (4, C + " end", "x"), (None, A, "x"), (None, A, "x"), (5, None, "x"), (5, None, "y"), (6, B, "x")]
    kept = [tuple(r)[:2] for r in jaccard.keep_first(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()]
    assert sorted(kept, key=repr) == sorted([(1, A), (2, B), (3, C), (None, A), (None, A), (5, None)], key=repr)


def test_smallest_id_of_a_component_stays(spark):
    rows = [(7, A), (2, B), (2, A)]
    kept = sorted(tuple(r) for r in jaccard.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == [(2, A), (2, B)]


def test_benchmark_rows_without_id(spark, tmp_path):
    docs = spark.createDataFrame([(1, B + " " + A[:70] + " " + C), (2, C)], "doc_id long, text string")
    spark.createDataFrame([(None, A[:70]), (9, "not there")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in decontaminate.op7_decontamination(spark, str(tmp_path)).collect()}
    assert got[1]["contaminated"] and got[1]["n_hit"] == len(A[:70].split()) and got[1]["n_items"] == 0 and not got[2]["contaminated"]
    clean = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_benchmark_text(spark, docs, str(tmp_path)).collect()}
    assert "a3" not in clean[1].split() and "b3" in clean[1].split() and clean[2] == C
