"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Characters are lower-cased, and their n-grams (n = 1, 2, 3) hashed to a fixed number of buckets. The
inverse document frequencies count every training text; the weights are trained by
follow-the-regularised-leader (FTRL-proximal, L1 and L2 penalties) on a bounded sample of training
texts, a part of which is kept to fit the softmax temperature. Term frequencies are shares of a
text's n-grams, so that scoring is a sum of rows of one broadcast table (buckets x languages).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import rowmap
from tessera.llm.textblocks import Block, blocks

UNKNOWN = "und"


@dataclass(frozen=True)
class LangSpec:
    """per_language: expected texts of each language in the sample that the weights are fitted on."""

    orders: tuple[int, ...] = (1, 2, 3)
    buckets: int = 1 << 16
    per_language: int = 1000
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.01
    scale: float = 30.0
    calibration_share: float = 0.2


@dataclass
class LangModel:
    spec: LangSpec
    languages: list[str]
    weights: np.ndarray  # (buckets + 1, languages); the last row is of no n-gram
    bias: np.ndarray
    temperature: float


@lru_cache(maxsize=1)
def _folding() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of each character (where that is one character) and whether it is a letter."""
    lower = np.arange(0x110000, dtype=np.uint32)
    letter = np.zeros(0x110000, bool)
    for c in range(0x20000):
        x = chr(c)
        letter[c] = x.isalpha()
        if len(x.lower()) == 1:
            lower[c] = ord(x.lower())
    for c in range(0x20000, 0x110000):
        letter[c] = chr(c).isalpha()
    return lower, letter


def _characters(block) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a block, and where each row starts and the last ends."""
    points = np.frombuffer(block.data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    heads = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum((block.data & 0xC0) != 0x80, out=heads[1:])
    return points, np.minimum(heads[block.offsets], len(points))


def _gram_ids(points: np.ndarray, bounds: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """The bucket of the n-gram at each character; `buckets` where the text ends before it does."""
    out = np.full(len(points), buckets, np.int32)
    if len(points) < n:
        return out
    h = points[: len(points) - n + 1] * np.uint32(0x9E3779B1) + np.uint32(n)
    for j in range(1, n):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) + points[j : len(points) - n + 1 + j] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    out[: len(h)] = (h % np.uint32(buckets)).astype(np.int32)
    for j in range(1, n):
        ends = bounds[1:] - j
        out[ends[ends >= bounds[:-1]]] = buckets
    return out


#: Characters of a text that are looked at together; longer texts are taken in parts.
PART = 1 << 20


def _gram_parts(block, spec) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(characters, where each text starts and the last ends, buckets of the n-grams of each order that start at each character).

    A block of one long text comes in parts, in order.
    """
    lower, _ = _folding()
    if block.rows > 1 or len(block.data) <= PART:
        points, bounds = _characters(block)
        low = lower[points]
        yield points, bounds, [_gram_ids(low, bounds, n, spec.buckets) for n in spec.orders]
        return
    more = max(spec.orders) - 1
    heads = np.append(np.flatnonzero((block.data & 0xC0) != 0x80), len(block.data))
    for a in range(0, len(heads) - 1, PART):
        b = min(a + PART, len(heads) - 1)
        end = heads[min(b + more, len(heads) - 1)]
        points, bounds = _characters(Block(block.data[heads[a] : end], np.array([0, end - heads[a]]), 0))
        low = lower[points]
        yield points[: b - a], np.array([0, b - a]), [_gram_ids(low, bounds, n, spec.buckets)[: b - a] for n in spec.orders]


def is_training() -> F.Column:
    return (F.crc32(F.col("doc_id").cast("string")) % 4 != 2) & F.col("lang").isNotNull()


def _document_frequencies(docs: DataFrame, spec: LangSpec) -> DataFrame:
    """(bucket, df) over all docs; bucket -1 counts the docs. A partition gives a row for each bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, seen, total = np.zeros(spec.buckets + 1, np.int64), np.zeros(spec.buckets + 1, bool), 0
        for batch in batches:
            total += batch.num_rows
            for block in blocks(batch.column(0)):
                for part, (_, bounds, ids) in enumerate(_gram_parts(block, spec)):
                    ids = np.stack(ids, 1)
                    for i in range(len(bounds) - 1):
                        if part == 0:
                            at = np.flatnonzero(seen)
                            df[at] += 1
                            seen[at] = False
                        seen[ids[bounds[i] : bounds[i + 1]].ravel()] = True
        df[seen] += 1
        at = np.flatnonzero(df[: spec.buckets])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], total), pa.int64())], ["bucket", "df"])

    return docs.select("text").mapInArrow(run, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df"))


def _sample(docs: DataFrame, spec: LangSpec) -> list:
    """(lang, ids, counts) of a sample of texts, about per_language of each, chosen by a hash of doc_id."""
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    if not sizes:
        return []
    rate = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, spec.per_language / n))])
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1_000_003)) < rate[F.col("lang")] * 1_000_003)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_out, counts_out = [], []
            for block in blocks(batch.column(1)):
                sums = None  # of the parts of one long text
                for _, bounds, ids in _gram_parts(block, spec):
                    ids = np.stack(ids, 1)
                    if block.rows == 1:
                        own = np.bincount(ids.ravel(), minlength=spec.buckets + 1)
                        sums = own if sums is None else sums + own
                        continue
                    for i in range(block.rows):
                        own = ids[bounds[i] : bounds[i + 1]].ravel()
                        at, counts = np.unique(own[own < spec.buckets], return_counts=True)
                        ids_out.append(at.astype("<u4").tobytes())
                        counts_out.append(counts.astype("<u4").tobytes())
                if sums is not None:
                    at = np.flatnonzero(sums[: spec.buckets])
                    ids_out.append(at.astype("<u4").tobytes())
                    counts_out.append(sums[at].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ids_out, pa.binary()), pa.array(counts_out, pa.binary())], ["doc_id", "lang", "ids", "counts"])

    return chosen.select("doc_id", "text", "lang").mapInArrow(run, "doc_id long, lang string, ids binary, counts binary").collect()


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(docs: DataFrame, spec: LangSpec = LangSpec()) -> LangModel | None:
    """Learns from doc_id, text and lang of docs, all of which are training rows; None if there are none.

    Rows without text or lang teach nothing; a null doc_id is a value like others, and repeated rows count each.
    """
    docs = docs.where("text is not null and lang is not null")
    frequency = np.zeros(spec.buckets)
    total = 0
    for bucket, n in _document_frequencies(docs, spec).collect():
        if bucket < 0:
            total = n
        else:
            frequency[bucket] = n
    rows = sorted(_sample(docs, spec), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.lang, r.ids))
    rows = [r for r in rows if len(r.ids)]
    if not rows:
        return None
    idf = np.log((1 + total) / (1 + frequency)) + 1
    languages = sorted({r.lang for r in rows})
    k = len(languages)
    examples = []
    for r in rows:
        ids, counts = np.frombuffer(r.ids, "<u4").astype(np.int64), np.frombuffer(r.counts, "<u4").astype(float)
        examples.append((ids, spec.scale * counts / counts.sum() * idf[ids], languages.index(r.lang)))
    order = np.random.default_rng(8).permutation(len(examples))
    kept = max(1, int(len(order) * spec.calibration_share))
    held, train = order[:kept], order[kept:] if len(order) > kept else order
    z, n = np.zeros((spec.buckets, k)), np.zeros((spec.buckets, k))
    zb, nb = np.zeros(k), np.zeros(k)

    def leader(z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((spec.beta + np.sqrt(n)) / spec.alpha + spec.l2))

    for epoch in range(spec.epochs):
        for i in np.random.default_rng(epoch).permutation(train):
            ids, x, y = examples[i]
            w, b = leader(z[ids], n[ids], spec.l1), leader(zb, nb, 0.0)
            p = _softmax(x @ w + b)
            p[y] -= 1
            for weights, sums, squares, g in ((w, z, n, x[:, None] * p), (b, zb, nb, p)):
                at = ids if sums is z else slice(None)
                old = squares[at]
                new = old + g * g
                sums[at] += g - (np.sqrt(new) - np.sqrt(old)) / spec.alpha * weights
                squares[at] = new
    weights, bias = leader(z, n, spec.l1), leader(zb, nb, 0.0)
    logits = np.array([examples[i][1] @ weights[examples[i][0]] + bias for i in held])
    truth = np.array([examples[i][2] for i in held])
    loss = lambda t: -np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean()
    temperature = min(np.geomspace(0.25, 4, 65), key=loss)
    table = np.zeros((spec.buckets + 1, k), np.float32)
    table[:-1] = spec.scale * idf[:, None] * weights
    return LangModel(spec, languages, table, bias, float(temperature))


def predict(docs: DataFrame, model: LangModel | None) -> DataFrame:
    """docs with lang_pred and score, the calibrated probability of that language.

    A text that is null or has no letter is `und` with score 0, and so is every text without a model.
    A tie goes to the first language by name. Texts are read whole; repeated rows are judged alike; an
    empty table stays empty. Columns of docs with these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(texts: pa.Array) -> list[pa.Array]:
        m: LangModel | None = shared.value
        _, letter = _folding()
        names, scores = [], []
        for block in blocks(texts):
            k = len(m.languages) if m is not None else 1
            has, sums, grams = np.zeros(block.rows, bool), np.zeros((block.rows, k)), np.zeros(block.rows, np.int64)
            for points, bounds, ids in _gram_parts(block, m.spec if m is not None else LangSpec()):
                some = np.flatnonzero(np.diff(bounds))
                if len(some):
                    has[some] |= np.logical_or.reduceat(letter[points], bounds[some])
                if m is not None and len(some):
                    rows = sum(np.take(m.weights, x, axis=0) for x in ids)
                    sums[some] += np.add.reduceat(rows, bounds[some], axis=0)
                    grams[some] += sum(np.add.reduceat((x < m.spec.buckets).astype(np.int64), bounds[some]) for x in ids)
            if m is None or not has.any():
                names += [UNKNOWN] * block.rows
                scores += [0.0] * block.rows
                continue
            p = _softmax((sums / np.maximum(grams, 1)[:, None] + m.bias) / m.temperature)
            best = p.argmax(1)
            names += [m.languages[b] if ok else UNKNOWN for b, ok in zip(best, has, strict=True)]
            scores += np.where(has, p[np.arange(len(p)), best], 0.0).tolist()
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    return rowmap.with_columns_from_text(docs, "lang_pred string, score double", compute)


def op8_langid(spark, sf_dir: str) -> DataFrame:
    model = fit(rowmap.documents(spark, sf_dir, "doc_id", "text", "lang").where(is_training()))
    found = predict(rowmap.documents(spark, sf_dir), model)
    # a document without doc_id is not learned from, and not held out
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
