"""Texts and ids at the ends of what there is: very long runs, long headers, crafted words, large ids, every grade."""

import base64
import json
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import decontaminate, jaccard, langid, packing, rowmap, secrets, textblocks, toxicity, vocab

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
SF = "/root/testdata/sf0.01"


def mixed(n, seed=1):
    rng = random.Random(seed)
    return "".join(rng.choice(" \t\n\r\x0b\x0c\x85\xa0　") for _ in range(n))


@pytest.mark.parametrize("text", [
    "a" + " " * 3_000_000 + "b", "a" + " " * 1_100_000, "\n" * 1_100_000 + "x y", "hello" + mixed(600_000) + "<|endoftext|>" + mixed(1_100_000) + "word" + mixed(60_000) + "<|endoftext|>" + " \n" * 40_000, "a" * 1_500_000,
], ids=["spaces", "spaces at the end", "line feeds", "mixed", "letters"])
def test_ids_of_long_runs(text):
    assert vocab.document_ids(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_ids_of_short_runs_taken_apart(monkeypatch):
    monkeypatch.setattr(vocab, "LONGEST", 3)
    monkeypatch.setattr(vocab, "_RUNS", vocab.re.compile(f"[{vocab._SPACE}]{{3,}}"))
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice([" ", " ", "\n", "\t", "\xa0", "a", "'s", "<|endoftext|>", "!", "9", "\x1c"]) for _ in range(rng.randint(3, 40)))
        assert vocab.document_ids(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_of_a_long_run(spark):
    docs = spark.createDataFrame([(1, "a" + " " * 1_200_000 + "b"), (2, "x")], "doc_id long, text string")
    total = {r["doc_id"]: r["n"] for r in packing.pack(docs).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert total == {1: len(LIBRARY.encode("a" + " " * 1_200_000 + "b", add_special_tokens=False).ids) + 1, 2: 2}


def test_headers_of_any_length(spark):
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    token = part({"alg": "RS256", "x5c": ["M" * 60_000]}) + ".e30.c2ln"
    docs = spark.createDataFrame([(1, f"see {token} here"), (2, "eyJ" * 20_000)], "doc_id long, text string")
    assert [(s["kind"], s["start"], s["end"]) for s in secrets.find_secrets(docs).where("doc_id = 1").first()["spans"]] == [("jwt", 4, 4 + len(token))]
    assert {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()} == {1: "see [secret] here", 2: "eyJ" * 20_000}


def test_letters_of_all_planes(spark):
    lower, letter = langid._folding()
    assert letter.tolist() == [chr(c).isalpha() for c in range(0x110000)]
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    docs = spark.createDataFrame([(1, chr(0x32100) * 3), (2, "12 !"), (3, None)], "doc_id long, text string")
    found = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()}
    assert found[2] == found[3] == langid.UNKNOWN and found[1] != langid.UNKNOWN


def thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_crafted_words_have_hashes_of_their_own(spark):
    words = [thue_morse(4096, "a", "b"), thue_morse(4096, "b", "a"), thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"], r["n_links"]) for r in jaccard.near_duplicates(docs, k=3, percent=90).collect()) == [(i, i, 0) for i in range(4)]
    import pyarrow as pa

    text = " ".join(["x" * 63, "y" * 64, "z" * 65, "Z" * 65, "z" * 65])
    block = next(textblocks.blocks(pa.array(["q " + text, text])))
    h = textblocks.word_hashes(block, textblocks.Words(block, textblocks.SPACE))
    assert h[1:6].tolist() == h[6:].tolist() and h[3] == h[5] != h[4]
    assert len(set(textblocks.word_hashes(block, textblocks.Words(block, textblocks.SPACE), lower=True)[3:6].tolist())) == 1


@pytest.mark.parametrize("low", [2**63 - 40, -(2**63)])
def test_repeated_ids_at_the_ends_of_a_long(spark, low):
    text = " ".join(f"word{i}" for i in range(30))
    rows = [(low, text, "b"), (low, text, "a"), (low, "other " + text, "c"), (low + 1, text + " end", "d"), (low + 2, "alone", "e"), (None, text, "f"), (None, text, "f")]
    for parts in (1, 4):
        kept = jaccard.keep_first(spark.createDataFrame(rows, "doc_id long, text string, note string").repartition(parts)).collect()
        assert sorted((r["note"], r["doc_id"]) for r in kept if r["doc_id"] is None or r["note"] == "e") == [("e", low + 2), ("f", None), ("f", None)]
        assert [r["doc_id"] for r in kept if r["note"] in "abcd"] == [low] and not any(r["note"] == "b" for r in kept)


def test_small_blocks_of_similar_texts(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(60)] = f"v{rng.randrange(9)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(zip(t.split(), t.split()[1:], t.split()[2:])) for t in texts]
    links = [sum(100 * len(a & b) >= 90 * len(a | b) for b in sets) - 1 for a in sets]
    for block in (8, 1024):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        assert [r["n_links"] for r in sorted(jaccard.near_duplicates(docs, k=3, percent=90).collect())] == links


def test_every_grade_is_predicted(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert {r["grade"] for r in rows} == {0, 1, 2, 3} and all(r["toxic"] == (r["grade"] > 0) for r in rows)
    by = sorted((r["grade"], r["expected_severity"]) for r in rows)
    means = [np.mean([s for g, s in by if g == k]) for k in range(4)]
    assert means == sorted(means)


def test_grades_are_equal_parts_with_ties_in_order():
    examples = [(np.array([0]), np.array([float(c)])) for c in (10, 10, 10, 30, 30, 30)] + [(np.array([1]), np.array([1.0]))] * 6
    toxic = np.array([1] * 6 + [0] * 6)
    assert toxicity.severity_grades(examples, toxic, 3).tolist() == [1, 1, 2, 2, 3, 3] + [0] * 6
    assert toxicity.severity_grades(examples, np.zeros(12, int), 3).tolist() == [0] * 12


def test_windows_of_many_bytes_go_in_parts(spark, monkeypatch):
    bench = spark.createDataFrame([(i, " ".join(f"{'long' * 50}{i}x{j}" for j in range(14))) for i in range(5)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"a {bench.first()['text']} b"), (2, "clean words only")], "doc_id long, text string")
    whole = sorted(map(str, decontaminate.find_leaks(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "MAX_BYTES", 20_000)
    assert sorted(map(str, decontaminate.find_leaks(docs, bench).collect())) == whole


def test_one_scratch_folder(spark):
    assert rowmap.scratch(spark, "x").startswith(rowmap.ensure_checkpoint_dir(spark).rstrip("/"))
