"""Ids of texts with the vocabulary's added token, against `tokenizers` at its default settings."""

import numpy as np

from tessera.llm import packing, rowmap, training_order, vocab

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>", "x<|endoftext|>y<|endoftext", "  <|endoftext|>\n\n <|EndOfText|>", "it's <|endoftext|> 漢字 🙂 <|endoftext|>  ", "<<|endoftext|>>", "plain", ""]


def expected(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids


def test_ids_at_default_settings(spark):
    docs = [r["text"] for r in rowmap.documents(spark, "/root/testdata/sf0.001").collect()]
    for text in TEXTS + docs[:80]:
        assert vocab.document_ids(text).tolist() == expected(text)


def test_packing_and_shards_have_those_ids(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1)
    for p in packing.pack(docs).collect():
        assert p["doc_tokens"] == len(expected(TEXTS[p["doc_id"]])) + 1
        assert np.frombuffer(p["ids"], "<u4").tolist() == [*expected(TEXTS[p["doc_id"]]), 1][p["start"] : p["start"] + p["length"]]
    spec = training_order.OrderSpec(length=256)
    rows = training_order.write_shards(rowmap.written(docs, "added"), str(tmp_path / "s"), spec).collect()
    ids = training_order.read_slots(str(tmp_path / "s"), 0, len(rows), spec)
    assert sorted(ids[ids > 1].tolist()) == sorted(i for t in TEXTS for i in expected(t) if i > 1)
