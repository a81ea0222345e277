"""Benchmark decontamination: a broadcast set of hashes of normalised test n-grams.

Windows of n consecutive words of every test item (the whole item where it has fewer) are hashed; the
sorted hashes and the windows' words are broadcast, and every training text is scanned once: a bitmap
rules out most windows, a binary search finds the others, and the words decide. There is no shuffle
of the training texts.

The set is broadcast in parts of at most `max_windows` windows each. A larger benchmark takes several
scans, between which the texts are written to the shared folder, so that an executor never holds more
than one part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import rowmap
from tessera.llm.textblocks import LOWER, Words, blocks, gram_hashes, word_hashes

MAX_WINDOWS = 500_000
#: Of the words of a part, about.
MAX_BYTES = 128 << 20
#: Word characters: 0-9, a-z (after lower-casing) and whatever is not ASCII.
INSIDE = np.zeros(256, bool)
INSIDE[0x30:0x3A] = INSIDE[0x41:0x5B] = INSIDE[0x61:0x7B] = INSIDE[0x80:] = True
STATE = "n_words long, word_spans array<struct<s:long,e:long>>, byte_spans array<struct<s:long,e:long>>, items array<string>"


def benchmark_windows(benchmark: DataFrame, n: int, nameless: bool = False) -> DataFrame:
    """(item, n, h, words) of each distinct window of an item; items without words have none, nor those without id unless `nameless`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, rows = batch.column(0).to_pylist(), []
            for block in blocks(batch.column(1)):
                words = Words(block, INSIDE)
                h = word_hashes(block, words, lower=True)
                text = LOWER[block.data].tobytes()
                for i in range(block.rows):
                    a, b = int(words.bounds[i]), int(words.bounds[i + 1])
                    if a == b:
                        continue
                    k = min(n, b - a)
                    for at, g in zip(range(a, b - k + 1), gram_hashes(h[a:b], k).tolist(), strict=True):
                        rows.append((items[block.first + i], k, g - (1 << 64 if g >> 63 else 0), b" ".join(text[words.starts[j] : words.ends[j]] for j in range(at, at + k))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary())], ["item", "n", "h", "words"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    if not nameless:
        items = items.where("item is not null")
    return items.mapInArrow(run, "item string, n int, h long, words binary").distinct()


class Part:
    """A bounded part of the windows: sorted hashes by length, a bitmap over them, and words -> items."""

    def __init__(self, rows: list):
        self.items: dict[tuple[int, bytes], list[str]] = {}
        hashes: dict[int, set[int]] = {}
        for r in rows:
            self.items.setdefault((r.n, bytes(r.words)), []).append(r.item)
            hashes.setdefault(r.n, set()).add(r.h & ((1 << 64) - 1))
        self.by_length = {}
        for n, hs in hashes.items():
            h = np.sort(np.array(list(hs), np.uint64))
            bits = max(12, len(h).bit_length() + 4)
            seen = np.zeros(1 << bits, bool)
            seen[h >> np.uint64(64 - bits)] = True
            self.by_length[n] = (h, np.uint64(64 - bits), seen)

    def hits(self, block, words: Words) -> Iterator[tuple[int, int, int, list[str]]]:
        """(row, first word, end word, items) of each occurring window; words are counted from the row's first."""
        h, text = word_hashes(block, words, lower=True), None
        for n, (known, shift, seen) in self.by_length.items():
            g = gram_hashes(h, n)
            at = np.flatnonzero(seen[g >> shift]) if len(g) else np.zeros(0, np.int64)
            at = at[words.rows[at] == words.rows[at + n - 1]]
            if not len(at):
                continue
            found = np.searchsorted(known, g[at])
            at = at[known[np.minimum(found, len(known) - 1)] == g[at]]
            for i in at.tolist():
                text = LOWER[block.data].tobytes() if text is None else text
                items = self.items.get((n, b" ".join(text[words.starts[j] : words.ends[j]] for j in range(i, i + n))))
                if items:
                    row = int(words.rows[i])
                    first = i - int(words.bounds[row])
                    yield row, first, first + n, items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_windows: int = MAX_WINDOWS, nameless: bool = False) -> DataFrame:
    """docs with n_words, word_spans and byte_spans of the words inside occurring windows, and their items.

    Spans are maximal, in order, and end before `e`; items are distinct and sorted as strings. A null
    or empty text has no words; a text is read whole; a repeated row gets its own result; an empty
    benchmark hits nothing; columns of docs with the names of these, in any case, are replaced.
    With `nameless`, windows of items without id are hits too, which no item stands for.
    """
    windows = benchmark_windows(benchmark, n, nameless)
    windows = rowmap.written(windows, "windows")
    count, size = windows.agg(F.count("*"), F.coalesce(F.sum(F.length("words")), F.lit(0))).first()
    parts = max(1, -(-count // max_windows), -(-size // MAX_BYTES))
    windows = windows.withColumn("part", F.pmod(F.xxhash64("h", "item"), F.lit(parts)))
    for k in range(parts):
        part = docs.sparkSession.sparkContext.broadcast(windows.where(F.col("part") == k).drop("part").collect())
        if k:
            docs = rowmap.written(docs, "scanned")
        docs = _scan(docs, part, first=k == 0)
    return docs


_CACHE: dict = {}


def _scan(docs: DataFrame, shared, first: bool) -> DataFrame:
    before = [] if first else ["word_spans", "items"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared not in _CACHE:
            _CACHE.clear()
            _CACHE[shared] = Part(shared.value)
        part: Part = _CACHE[shared]
        for batch in batches:
            old = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in before]
            counts, word_spans, byte_spans, items = [], [], [], []
            for block in blocks(batch.column(batch.schema.get_field_index("text"))):
                words, by_row = Words(block, INSIDE), {}
                for row, s, e, names in part.hits(block, words):
                    x = by_row.setdefault(row, ([], set()))
                    x[0].append((s, e))
                    x[1].update(i for i in names if i is not None)
                counts += words.counts.tolist()
                for row in range(block.rows):
                    spans, names = by_row.get(row, ([], set()))
                    if before:
                        spans += [(x["s"], x["e"]) for x in old[0][block.first + row]]
                        names |= set(old[1][block.first + row])
                    spans = merge(spans)
                    base, low = int(words.bounds[row]), int(block.offsets[row])
                    word_spans.append([{"s": s, "e": e} for s, e in spans])
                    byte_spans.append([{"s": int(words.starts[base + s]) - low, "e": int(words.ends[base + e - 1]) - low} for s, e in spans])
                    items.append(sorted(names))
            span = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
            made = [pa.array(counts, pa.int64()), pa.array(word_spans, span), pa.array(byte_spans, span), pa.array(items, pa.list_(pa.string()))]
            kept = [c for c in batch.schema.names if c.lower() not in ("n_words", "word_spans", "byte_spans", "items")]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kept] + made, [*kept, "n_words", "word_spans", "byte_spans", "items"])

    clash = ("n_words", "word_spans", "byte_spans", "items")
    kept = [c for c in docs.columns if c.lower() not in clash]
    from pyspark.sql import types as T

    schema = T.StructType([docs.schema[c] for c in kept] + T._parse_datatype_string(STATE).fields)
    return (docs.select(*kept) if first else docs).mapInArrow(run, schema)


def hit_words() -> F.Column:
    return F.expr("aggregate(word_spans, 0L, (a, x) -> a + x.e - x.s)")


def cut_bytes(docs: DataFrame, spans: str = "byte_spans") -> DataFrame:
    """docs with their text less the spans (byte offsets, in order, which do not split a character)."""

    def compute(batch: pa.RecordBatch) -> pa.Array:
        texts, out = batch.column(batch.schema.get_field_index("text")), []
        for text, cuts in zip(texts, batch.column(batch.schema.get_field_index(spans)).to_pylist(), strict=True):
            if not cuts:
                out.append(text.as_py())
                continue
            raw, at, kept = text.as_py().encode(), 0, []
            for x in cuts:
                kept.append(raw[at : x["s"]])
                at = x["e"]
            out.append(b"".join([*kept, raw[at:]]).decode())
        return pa.array(out, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield pa.RecordBatch.from_arrays([compute(batch) if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def remove_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 10, drop_share: float = 0.5, nameless: bool = False) -> DataFrame:
    """docs without leaks: a document of which at least drop_share of the words are hit goes, of the others the hit spans.

    All columns stay as they are, whatever their names, but for text. Null and empty texts stay; texts
    are read whole; repeated rows are judged alike; an empty table stays empty, and an empty benchmark
    changes nothing. The words around a cut are not looked at again.
    """
    own, back = rowmap.set_aside(docs)
    found = find_leaks(own, benchmark, n, nameless=nameless)
    kept = found.where((hit_words() == 0) | (hit_words() < drop_share * F.col("n_words")))
    return back(cut_bytes(kept))


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    found = find_leaks(rowmap.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), nameless=True)
    return found.select("doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("word_spans") > 0).alias("contaminated"))
