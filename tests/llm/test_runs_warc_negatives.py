"""Periodic runs, WARC archives and hard negatives against brute force and SQL, with nulls, long rows, ties, copies and empty tables."""

import gzip
import hashlib
import io
import random
import re
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import hard_negatives, oracles, periodic_runs, registry, rowmap, warc
from tessera.llm.textblocks import SPACE, Words, blocks
from tests.test_oracle import rows as plain_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_warc", "op13_hard_negatives"])
def test_query_against_sql(spark, db, name):
    assert plain_rows(registry.QUERIES[name](spark, SF).toPandas()) == plain_rows(db.execute(registry.ORACLE_SQL[name]).df())


# periodic runs


def all_runs(w, least=6):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        x = 0
        while x < len(w) - q:
            low = x
            while x < len(w) - q and w[x] == w[x + q]:
                x += 1
            if x > low and x - low + q >= max(least, 4 * q):
                found.setdefault((low, x - low + q), q)
            x += x == low
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic_texts(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        k = rng.randint(0, 120)
        if i % 6 == 0:
            w = [rng.choice("ab") for _ in range(k)]
        elif i % 6 == 1:
            u = [rng.choice("abc") for _ in range(rng.randint(1, 25))]
            w = [rng.choice("abc") for _ in range(rng.randint(0, 9))] + (u * 12)[: rng.randint(1, 200)] + [rng.choice("abc") for _ in range(rng.randint(0, 9))]
        elif i % 6 == 2:  # runs inside runs
            u = [rng.choice("ab") for _ in range(rng.randint(1, 4))] * rng.randint(3, 8) + [rng.choice("abc")]
            w = (u * 9)[: rng.randint(5, 300)]
        elif i % 6 == 3:
            a, b = "a", "ab"
            for _ in range(rng.randint(3, 11)):
                a, b = b, b + a
            w = list(b)
        elif i % 6 == 4:
            w = ["x"] * k + ["y"] * (k // 2)
        else:
            w = []
            while len(w) < k:
                w += [rng.choice("ab") for _ in range(rng.randint(1, 3))] * rng.randint(1, 9)
        out.append(rng.choice([" ", "\t ", "\n"]).join(w))
    return out


@pytest.mark.parametrize("size", [1 << 19, 5000, 100])
def test_runs_against_brute_force(size):
    texts = periodic_texts(5, 1200)
    found = [r for block in blocks(pa.array(texts), size) for r in periodic_runs.block_runs(block, Words(block, SPACE))]
    assert found == [all_runs(t.split()) for t in texts]


def test_words_with_one_hash_are_told_apart(monkeypatch):
    real = periodic_runs.word_hashes
    monkeypatch.setattr(periodic_runs, "word_hashes", lambda block, words: real(block, words) % np.uint64(3))
    texts = periodic_texts(6, 60) + ["a b c d e f g h " * 5]
    found = [r for block in blocks(pa.array(texts)) for r in periodic_runs.block_runs(block, Words(block, SPACE))]
    for runs, text in zip(found, texts, strict=True):
        w = text.split()
        assert all(w[s : s + n - q] == w[s + q : s + n] for s, n, q in runs)


def test_a_text_of_one_word_and_a_long_period():
    word = ["w"] * 300_000
    rng = random.Random(2)
    passage = [str(rng.randrange(10**9)) for _ in range(40_000)]
    tail = ["other"] + passage * 5
    block = next(blocks(pa.array([" ".join(word), " ".join(tail)]), 1 << 30))
    assert periodic_runs.block_runs(block, Words(block, SPACE)) == [[(0, 300_000, 1)], [(1, 200_000, 40_000)]]


def test_collapse_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b " * 8), (4, "a b " * 8), (None, "z z z z z z"), (5, "é 漢 é 漢 é 漢 é 漢 x"), (6, "one two")]
    docs = spark.createDataFrame([(*r, "own", 1) for r in rows], "doc_id long, text string, RUNS string, other int")
    found = periodic_runs.collapse(docs).collect()
    assert [c.lower() for c in periodic_runs.collapse(docs).columns] == ["doc_id", "text", "other", "runs", "collapsed"]
    got = sorted(((r["doc_id"] or 0, [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found), key=repr)
    assert got == sorted([(1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 16, 2)], "a b"), (4, [(0, 16, 2)], "a b"), (0, [(0, 6, 1)], "z"), (5, [(0, 8, 2)], "é 漢 x"), (6, [], "one two")], key=repr)
    assert periodic_runs.collapse(docs.where("false")).count() == 0
    assert [len(r["runs"]) for r in periodic_runs.find_runs(docs, periodic_runs.RunSpec(least=17)).where("doc_id = 4").collect()] == [0, 0]


def test_query_on_edges(spark, tmp_path):
    spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "q " * 9, 1), (7, "q " * 9, 1), (7, "q " * 9, 1)], "doc_id long, text string, runs int").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(got) == 5 and {r["runs_sha256"] for r in got if r["doc_id"] in (1, 2)} == {empty}
    assert {(r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) for r in got if r["doc_id"] == 7} == {(1, 0, 9, 1, 9000)}
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert registry.QUERIES["op11_periodic_runs"](spark, str(tmp_path / "none")).count() == 0


# WARC

PAGES = [(1, "http://a", "same"), (2, "http://b", "same"), (5, "http://c\r\nX-Evil: 1", "same"), (3, None, None), (4, "http://d", ""), (9, "http://e", "alone é 漢"), (10, "http://f", "x" * 3_000_000), (None, "http://g", "alone é 漢"), (6, "http://h", "same"), (6, "http://h", "same")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "own") for p in PAGES], "page_id long, url string, html string, file string").repartition(3, "url")


def brute_records(least=0):
    best = {}
    for page, url, html in PAGES:
        body = (html or "").encode()
        best.setdefault(body, []).append(page)
    out = []
    for body, ids in best.items():
        order = sorted(ids, key=lambda x: (x is not None, x))
        out.append((order[-1], len(body), "response", None))
        for x in order[:-1]:
            out.append((x, len(body), "revisit", order[-1]) if len(body) >= least else (x, len(body), "response", None))
    return sorted(out, key=repr)


def records(df):
    return sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("spec", [warc.WarcSpec(), warc.WarcSpec(hot=1, file_bytes=300), warc.WarcSpec(least_bytes=5)])
def test_archives_against_brute_force(spark, pages, tmp_path, spec):
    a, b, c = (str(tmp_path / x) for x in "abc")
    first = warc.write_archives(pages, a, spec)
    assert first.agg(F.sum("records")).first()[0] == len(PAGES)
    if spec.file_bytes == 300:
        assert first.count() >= 5
    second = warc.deduplicate(first, a, b, spec)
    assert records(warc.read_headers(second, b)) == brute_records(spec.least_bytes)
    third = warc.deduplicate(second, b, c, spec)  # revisits stay with their originals
    assert records(warc.read_headers(third, c)) == brute_records(spec.least_bytes)


def test_files_as_another_reader_sees_them(spark, pages, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    manifest = warc.deduplicate(warc.write_archives(pages, a), a, b)
    seen = {}
    for name in (r["file"] for r in manifest.collect()):
        stream = io.BytesIO(gzip.open(f"{b}/{name}").read())
        while line := stream.readline():
            assert line == b"WARC/1.1\r\n"
            fields = {}
            while (line := stream.readline()) != b"\r\n":
                k, _, v = line.decode().rstrip("\r\n").partition(": ")
                fields[k] = v
            block = stream.read(int(fields["Content-Length"]))
            assert stream.read(4) == b"\r\n\r\n"
            seen[fields["WARC-Record-ID"]] = (fields, block)
    assert len(seen) == len(PAGES) + manifest.count()
    for fields, block in seen.values():
        assert "X-Evil" not in fields
        if fields["WARC-Type"] == "revisit":
            to, body = seen[fields["WARC-Refers-To"]]
            assert to["WARC-Type"] == "response" and to["WARC-Payload-Digest"] == fields["WARC-Payload-Digest"] and re.search(rb"\r\n\r\n$", block)
            assert to["WARC-Target-URI"] == fields["WARC-Refers-To-Target-URI"] if "WARC-Target-URI" in to else "WARC-Refers-To-Target-URI" not in fields


def test_a_revisit_without_its_original_stays(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    files = warc._Files(a, warc.WarcSpec(), "2024-01-01T00:00:00Z")
    files.fs.create_dir(a)
    files.add([("WARC-Type", "revisit"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Refers-To", "<urn:gone>"), ("WARC-Payload-Digest", "sha1:ABC")], b"")
    files.close()
    manifest = warc.deduplicate(spark.createDataFrame(files.done, warc.MANIFEST), a, b)
    got = warc.read_headers(manifest, b).collect()
    assert [(r["record_type"], r["refers_to_id"], r["payload_digest"], r["payload_bytes"]) for r in got] == [("revisit", "<urn:gone>", "ABC", None)]


def test_damage_is_an_error_and_empty_tables_are_none(spark, pages, tmp_path):
    a = str(tmp_path / "a")
    manifest = warc.write_archives(pages.limit(2), a)
    name = manifest.first()["file"]
    body = Path(a, name).read_bytes()
    with pytest.raises(ValueError, match="inside"):
        list(warc.members(io.BytesIO(body[:-5])))
    head, block = warc.parse(list(warc.members(io.BytesIO(body)))[-1][2])
    with pytest.raises(ValueError, match="not a WARC"):
        warc.parse(b"HTTP/1.1 200 OK\r\n\r\n")
    none = warc.write_archives(pages.where("false"), str(tmp_path / "n"))
    assert warc.read_headers(warc.deduplicate(none, str(tmp_path / "n"), str(tmp_path / "m")), str(tmp_path / "m")).count() == 0


# hard negatives


def brute_negatives(rows, spec):
    good = [(v, l, [int(x * spec.scale // 1) for x in e]) for v, l, e in rows if v is not None and l is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for n, (v, l, e) in enumerate(good):
        if v % spec.anchor_step:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(e, f, strict=True)), w, m) for w, m, f in good if len(f) == len(e)), key=lambda r: r[:2])
        for p, w, _ in [x for x in scored if x[2] == l and x[1] != v][: spec.positives]:
            inside = [x for x in scored if x[2] != l and spec.low * -p <= -100 * x[0] <= spec.high * -p][: spec.negatives]
            out += [(v, w, i + 1, x[1], -p, -x[0]) for i, x in enumerate(inside)]
    return sorted(out)


def vectors(seed, n, d, spread=1.0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(4, d)) * spread
    rows = [(i, int(rng.integers(4)), None) for i in range(n)]
    rows = [(i, label, [float(x) for x in np.round(centre[label % 2] + rng.normal(size=d), 2)]) for i, label, _ in rows]
    rows += [(n, None, rows[0][2]), (n + 1, 2, None), (n + 2, 2, [None] * d), (n + 3, 2, [float("nan")] * d), (n + 4, 1, [float("inf")] * d), (None, 1, rows[1][2])]
    return rows + [(n + 5 + i, rows[i][1], rows[i][2]) for i in range(8)]  # ties


SCHEMA = "vec_id long, label int, embedding array<double>"


@pytest.mark.parametrize("spec", [hard_negatives.MiningSpec(anchor_step=10), hard_negatives.MiningSpec(anchor_step=5, anchors_at_once=8, positives=3, negatives=4, low=10, high=70)])
def test_negatives_against_brute_force(spark, monkeypatch, spec):
    monkeypatch.setattr(hard_negatives, "TILE", (16, 3))
    rows = vectors(3, 150, 5) + [(1000, 0, [1.0, 2.0]), (1001, 0, [2.0, 2.0]), (1002, 1, [1.0, 1.0]), (1010, 1, [])]
    table = spark.createDataFrame([(*r, "own") for r in rows], SCHEMA + ", score string").repartition(4)
    got = sorted(tuple(r) for r in hard_negatives.mine(table, spec).collect())
    assert got == brute_negatives(rows, spec) and len(got) > 100


def test_large_components_and_repeated_anchors(spark):
    spec = hard_negatives.MiningSpec(anchor_step=100)
    rows = [(0, 0, [3.0e7, 1.0]), (1, 0, [2.0e5, 5.0]), (2, 1, [1.0e5, 7.0]), (3, 1, [1.5e5, 9.0])]
    assert sorted(tuple(r) for r in hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), spec).collect()) == brute_negatives(rows, spec)
    far = [(0, 0, [1e300]), (1, 0, [1e300]), (2, 1, [0.5])]  # a score beyond the long range counts as its end
    assert [tuple(r) for r in hard_negatives.positives(hard_negatives.usable(spark.createDataFrame(far, SCHEMA)), spec)[0].select("positive_id", "positive_score").collect()] == [(1, 2**63 - 1)]
    twice = [(0, 0, [1.0]), (0, 0, [1.0]), (1, 0, [4.0]), (2, 1, [2.0])]
    assert sorted(tuple(r) for r in hard_negatives.mine(spark.createDataFrame(twice, SCHEMA), spec).collect()) == [(0, 1, 1, 2, 4 * 65536, 2 * 65536)] * 2


def test_no_anchors_and_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hard_negatives.mine(empty).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(1, 1, [1.0]), (2, 0, [2.0])], SCHEMA)).count() == 0


def test_slots_keep_what_a_sort_keeps():
    rng = np.random.default_rng(4)
    kept, offered = hard_negatives.Slots(3, 2, 5), []
    for i in range(40):
        key, score, vec_id = rng.integers(0, 6, 50), rng.integers(0, 9, 50), rng.integers(0, 100, 50)
        kept.offer(key, score, vec_id, np.arange(50) + 50 * i)
        offered += list(zip(key.tolist(), score.tolist(), vec_id.tolist(), strict=True))
        if i % 7 == 0:
            kept.settle()
    want = [x for k in range(6) for x in sorted((x for x in offered if x[0] == k), key=lambda x: (-x[1], x[2]))[:5]]
    assert [tuple(x) for x in kept.settle()[:3].T.tolist()] == want


def test_sql_of_the_three_is_registered():
    assert {"op11_periodic_runs", "op12_warc", "op13_hard_negatives"} <= set(oracles.SQL)
    assert rowmap.folder("/tmp")[1] == "/tmp"
