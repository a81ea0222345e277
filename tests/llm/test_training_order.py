"""Training order: folders of another order, damaged and missing shards, ids too large, rows of every kind, against a plain rewrite."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import rowmap, training_order

SPEC = training_order.OrderSpec(length=64, per_shard=8)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"text number {i} " * (i % 40), "x") for i in range(120)] + [(None, "no id", "x"), (500, None, "x"), (501, "", "x"), (502, "word " * 60_000, "x"), (3, "same id", "x"), (503, "tie", "x"), (503, "tie", "x"), (504, "a <|endoftext|> b 漢", "x")]
    return rowmap.written(spark.createDataFrame(rows, "doc_id long, text string, SLOT string").repartition(3, "doc_id"), "order_docs")


def content(rows):
    return {(r["slot"], r["shard"], r["byte_offset"], r["n_tokens"], tuple(r["doc_ids"]), r["ids_crc32"]) for r in rows}


def test_against_a_plain_rewrite(docs, tmp_path):
    rows = training_order.write_shards(docs, str(tmp_path / "s"), SPEC).collect()
    library, want, parts = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), [], {}
    for r in docs.withColumn("_p", F.spark_partition_id()).collect():
        parts.setdefault(r["_p"], []).append(r)
    for p in sorted(parts):
        stream = [(r["doc_id"], i) for r in parts[p] for i in [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]]
        want += [stream[i : i + 64] for i in range(0, len(stream), 64)]
    n = len(want)
    slots = training_order.permute(np.arange(n), n, SPEC.key).tolist()
    expected = set()
    for s, piece in zip(slots, want):
        record = np.zeros(64, "<u2")
        record[: len(piece)] = [i for _, i in piece]
        expected.add((s, s // 8, s % 8 * 128, len(piece), tuple(dict.fromkeys(d for d, _ in piece if d is not None)), zlib.crc32(record.tobytes())))
    assert content(rows) == expected


def test_another_order_is_refused(docs, tmp_path):
    path = str(tmp_path / "s")
    training_order.write_shards(docs, path, SPEC).count()
    with pytest.raises(ValueError, match="another training order"):
        training_order.write_shards(docs, path, training_order.OrderSpec(length=64, per_shard=8, key=2))
    with pytest.raises(ValueError, match="another training order"):
        training_order.write_shards(docs.where("doc_id < 100"), path, SPEC)


def test_damaged_and_missing_shards_are_written_anew(docs, tmp_path):
    path = tmp_path / "s"
    first = training_order.write_shards(docs, str(path), SPEC).collect()
    whole = {p.name: p.read_bytes() for p in path.glob("*shard-*")}
    body = bytearray(whole["shard-00000001.bin"])
    body[5] ^= 1
    (path / "shard-00000001.bin").write_bytes(bytes(body))
    (path / "shard-00000003.bin").unlink()
    (path / "shard-00000004.arrow").write_bytes(b"broken")
    kept = {p.name: p.stat().st_mtime_ns for p in path.glob("shard-*") if p.name[6:14] not in ("00000001", "00000003", "00000004")}
    again = training_order.write_shards(docs, str(path), SPEC).collect()
    assert content(again) == content(first) and {p.name: p.read_bytes() for p in path.glob("*shard-*")} == whole
    assert {n: (path / n).stat().st_mtime_ns for n in kept} == kept
    assert content(training_order.write_shards(docs, str(path), SPEC).collect()) == content(first)


def test_a_restart_with_other_splits_goes_on(docs, tmp_path):
    path = tmp_path / "s"
    first = training_order.write_shards(docs, str(path), SPEC).collect()
    whole = {p.name: p.read_bytes() for p in path.glob("shard-*")}
    (path / "shard-00000002.bin").write_bytes(b"cut off")
    (path / "shard-00000005.arrow").unlink()
    other = docs.repartition(11, "text")
    assert content(training_order.write_shards(other, str(path), SPEC).collect()) == content(first)
    assert {p.name: p.read_bytes() for p in path.glob("shard-*")} == whole
    # sequences that were not written to their end are made anew, and then the shards must be of that order
    marks = list(path.glob("sequences-*"))
    assert len(marks) == 1
    (marks[0] / "_SUCCESS").unlink()
    with pytest.raises(ValueError, match="another training order"):
        training_order.write_shards(docs.repartition(5, "text"), str(path), SPEC)


def test_ids_that_do_not_fit(docs, tmp_path):
    with pytest.raises(Exception, match="does not fit"):
        training_order.write_shards(docs, str(tmp_path / "s"), training_order.OrderSpec(length=64, id_type="u1"))


def test_empty_table(docs, tmp_path):
    assert training_order.write_shards(docs.where("false"), str(tmp_path / "s"), SPEC).count() == 0
