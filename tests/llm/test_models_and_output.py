"""Learned operators by held-out accuracy, outputs by exact round trips, and the pipeline end to end."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import langid, packing, registry, rowmap, toxicity, training_order, vocab

SF = "/root/testdata/sf0.001"


def test_fast_ids_are_those_of_the_tokenizers_file(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = [r["text"] for r in rowmap.documents(spark, SF).limit(80).collect()] + ["", " ", "\n\n  x\t", "<|endoftext|>", "it's 12 ½ naïve — 漢字 🙂", "a" * 5000]
    for text in texts:
        assert vocab.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("open_windows", [1, 64])
def test_packing_keeps_every_id_once(spark, open_windows):
    docs = rowmap.documents(spark, SF).unionByName(spark.createDataFrame([(10_001, None), (10_002, "")], "doc_id long, text string"))
    pieces = packing.pack(docs, packing.PackSpec(window=256, open_windows=open_windows)).collect()
    of_doc, of_sequence = {}, {}
    for p in pieces:
        of_doc.setdefault(p["doc_id"], []).append(p)
        of_sequence.setdefault(p["sequence_id"], []).append(p)
    for r in docs.collect():
        ids = np.append(vocab.encode(r["text"] or ""), 1)
        own = sorted(of_doc[r["doc_id"]], key=lambda p: p["start"])
        assert np.concatenate([np.frombuffer(p["ids"], "<u4") for p in own]).tolist() == ids.tolist()
        assert [p["start"] for p in own] == np.cumsum([0] + [p["length"] for p in own])[:-1].tolist() and own[0]["doc_tokens"] == len(ids)
    padding = total = 0
    for s in of_sequence.values():
        s = sorted(s, key=lambda p: p["offset"])
        n = sum(p["length"] for p in s)
        assert [p["offset"] for p in s] == np.cumsum([0] + [p["length"] for p in s])[:-1].tolist() and n <= 256
        total += n
        padding += 0 if n & (n - 1) == 0 else 256 - n
    assert padding <= 0.04 * total  # a gap of up to eight of 256 ids stays
    assert packing.pack(docs.where("false")).count() == 0


def test_permutation_is_a_bijection():
    for n in (1, 2, 5, 64, 1000):
        slots = training_order.permute(np.arange(n), n, key=9)
        assert sorted(slots.tolist()) == list(range(n))
    assert (training_order.permute(np.arange(1000), 1000, 1) != training_order.permute(np.arange(1000), 1000, 2)).any()


def test_shards_hold_every_token_and_can_be_resumed(spark, tmp_path):
    spec = training_order.OrderSpec(length=256, per_shard=20)
    docs = rowmap.documents(spark, SF).repartition(3, "doc_id").transform(lambda d: rowmap.written(d, "three"))
    rows = training_order.write_shards(docs, str(tmp_path / "s"), spec).collect()
    n = len(rows)
    assert sorted(r["slot"] for r in rows) == list(range(n))
    ids = training_order.read_slots(str(tmp_path / "s"), 0, n + 5, spec)
    assert len(ids) == n and (training_order.read_slots(str(tmp_path / "s"), 33, 30, spec) == ids[33:63]).all()
    assert all(zlib.crc32(ids[r["slot"]].tobytes()) == r["ids_crc32"] for r in rows)
    total = sum(len(vocab.encode(r["text"] or "")) + 1 for r in docs.collect())
    assert sum(r["n_tokens"] for r in rows) == total
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "s").iterdir()}
    training_order.write_shards(docs, str(tmp_path / "s"), spec).count()
    assert {p.name: p.stat().st_mtime_ns for p in (tmp_path / "s").iterdir()} == before
    assert training_order.write_shards(docs.where("false"), str(tmp_path / "none"), spec).count() == 0


def test_language_held_out(spark):
    docs = rowmap.documents(spark, "/root/testdata/sf0.01", "doc_id", "text", "lang")
    model = langid.fit(docs.where(langid.is_training()))
    held = langid.predict(docs.where(~langid.is_training()), model)
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 + 3 = 15 !!"), (4, "é")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.predict(odd.withColumn("score", F.lit("clash")), model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[4]["lang_pred"] in model.languages
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.fit(docs.where("lang is null")) is None and langid.predict(odd, None).where("lang_pred = 'und'").count() == 4


def test_toxicity_held_out_and_ordered(spark):
    rng = random.Random(5)
    plain = ["w%d" % i for i in range(400)]
    rows = []
    for i in range(1200):
        grade = rng.choice([0, 0, 0, 1, 2])
        text = [rng.choice(plain) for _ in range(60)] + [rng.choice(["vileness", "scumbag", "vilest"]) for _ in range({0: 0, 1: 2, 2: 7}[grade])]
        rng.shuffle(text)
        rows.append((i, " ".join(text), grade))
    df = spark.createDataFrame(rows, "doc_id long, text string, truth int")
    labels = df.where("doc_id % 2 = 0").select("doc_id", (F.col("truth") > 0).cast("int").alias("toxic"))
    model = toxicity.fit(df, labels)
    assert (np.diff(model.thresholds) >= 0).all()
    held = toxicity.score(df.where("doc_id % 2 = 1"), model)
    assert held.where("toxic = (truth > 0)").count() >= 0.97 * held.count()
    means = [r[0] for r in held.groupBy("truth").agg(F.avg("expected_severity").alias("m")).orderBy("truth").select("m").collect()]
    assert means == sorted(means)
    odd = spark.createDataFrame([(1, None, 3), (2, "", 3), (3, "scumbag " * 50_000, 3)], "doc_id long, text string, grade int")
    got = {r["doc_id"]: r for r in toxicity.score(odd, model).collect()}
    assert got[1]["expected_severity"] == got[2]["expected_severity"] == 0 and got[3]["toxic"]
    assert toxicity.fit(df, labels.where("false")) is None and toxicity.score(odd, None).where("toxic").count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = rowmap.written(stage(spark, before, SF), name)
        if name != "packing":
            assert after.columns == docs.columns
            assert after.join(before, "doc_id", "left_anti").count() == 0
        if name == "jaccard_join":
            from tessera.llm import jaccard

            assert jaccard.near_duplicates(after, 5, 80).where("doc_id <> component_id").count() == 0
        if name == "decontamination":
            from tessera.llm import decontaminate

            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            touched = decontaminate.find_leaks(before, bench).where("size(items) > 0").select("doc_id")
            same = before.join(touched, "doc_id", "left_anti")
            assert same.select("doc_id", "text").exceptAll(after.select("doc_id", "text")).count() == 0
        if name == "secret_scan":
            from tessera.llm import secrets

            assert secrets.find_secrets(after).where("size(spans) > 0").count() == 0
        before = after
    assert before.select("doc_id").distinct().count() > 0.8 * docs.count()
    assert corpus_pipeline.run(spark, SF).count() == before.count()


def test_every_query_runs(spark):
    for name, query in registry.QUERIES.items():
        assert query(spark, SF).count(), name
