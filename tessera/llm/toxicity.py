"""Toxicity: cumulative-link ordinal regression on sparse word features.

One weight vector serves all ordered thresholds: P(grade > k) = sigmoid(w . x - theta_k) with theta
increasing. Features are the logarithms of the counts of words and of the first bytes of longer words
(abuse is inflected), by 64-bit hashes; the vocabulary and the weights come from a bounded sample of labelled texts, trained by FTRL-proximal
with an L1 penalty, so that only telling words keep a weight and the length of a text has no say.
The model is a sorted list of hashes with weights, broadcast to score every text in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import rowmap
from tessera.llm.decontaminate import INSIDE
from tessera.llm.textblocks import LOWER, Words, blocks, prefix_hashes, range_hashes


@dataclass(frozen=True)
class ToxSpec:
    """per_grade: expected texts of each label in the sample that the model is fitted on; min_texts: of a feature, in it; levels: grades of toxic texts; gap: between thresholds at first."""

    per_grade: int = 4000
    min_texts: int = 5
    levels: int = 3
    gap: float = 3.0
    epochs: int = 6
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 2.0
    l2: float = 0.1


@dataclass
class ToxModel:
    hashes: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray


PREFIXES = (4, 5, 6)


def feature_hashes(block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, row) of every word and of the prefixes of every longer word, with repeats, a kind at a time."""
    words = Words(block, INSIDE)
    c = prefix_hashes(LOWER[block.data])
    yield range_hashes(c, words.starts, words.ends), words.rows
    for n in PREFIXES:
        longer = np.flatnonzero(words.ends - words.starts > n)
        starts = words.starts[longer]
        yield range_hashes(c, starts, starts + n) ^ np.uint64(n), words.rows[longer]


def _features(block) -> Iterator[np.ndarray]:
    """For each row the hashes of its features, with repeats."""
    kinds = [(h, np.searchsorted(rows, np.arange(block.rows + 1))) for h, rows in feature_hashes(block)]
    for i in range(block.rows):
        yield np.concatenate([h[at[i] : at[i + 1]] for h, at in kinds])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def severity_grades(examples: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, levels: int = 3) -> np.ndarray:
    """Grades 0 (not toxic) and 1 to `levels` of labelled texts: toxic ones in equal parts by their number of telling words, ties in order.

    Telling: a feature at least ten times as frequent among the toxic texts as among the others.
    """
    if not toxic.any():
        return np.zeros(len(toxic), int)
    inside, rest = (np.concatenate([e[0] for e, t in zip(examples, toxic, strict=True) if t == side] or [np.zeros(0, np.int64)]) for side in (1, 0))
    size = int(max(inside.max(initial=0), rest.max(initial=0))) + 1
    a, b = np.bincount(inside, minlength=size), np.bincount(rest, minlength=size)
    telling = (a >= 10) & (a / toxic.sum() >= 10 * (b + 0.5) / max(1, (toxic == 0).sum()))
    weight = np.array([counts[telling[ids]].sum() for ids, counts in examples])
    grades, own = np.zeros(len(toxic), int), np.flatnonzero(toxic == 1)
    grades[own[np.argsort(weight[own], kind="stable")]] = 1 + np.arange(len(own)) * levels // len(own)
    return grades


def _labelled_sample(docs: DataFrame, labels: DataFrame, spec: ToxSpec) -> tuple[np.ndarray, list]:
    """The features kept, in order, and (doc_id, toxic, their numbers, counts) of about per_grade texts of each label, chosen by a hash of doc_id."""
    flags = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in flags.groupBy("toxic").count().collect()}
    if not sizes:
        return np.zeros(0, np.uint64), []
    rate = F.create_map(*[F.lit(x) for flag, n in sizes.items() for x in (flag, min(1.0, spec.per_grade / n))])
    chosen = flags.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_003)) < rate[F.col("toxic")] * 1_000_003)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_out, counts_out = [], []
            for block in blocks(batch.column(2)):
                for own in _features(block):
                    at, counts = np.unique(own, return_counts=True)
                    ids_out.append(at.astype("<u8").tobytes())
                    counts_out.append(counts.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids_out, pa.binary()), pa.array(counts_out, pa.binary())], ["doc_id", "toxic", "ids", "counts"])

    # the sample is bounded by the specification, and so may be broadcast
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    sample = rowmap.written(rows.mapInArrow(run, "doc_id long, toxic int, ids binary, counts binary"), "labelled")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(ids)], ["id"])

    # only features of enough texts leave the executors; the bounded sample bounds them
    frequent = sample.select("ids").mapInArrow(listed, "id long").groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= spec.min_texts)
    kept = np.sort(np.array([r["id"] for r in frequent.select("id").collect()], np.int64).view(np.uint64))
    shared = docs.sparkSession.sparkContext.broadcast(kept)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            ids_out, counts_out = [], []
            for ids, counts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                ids, counts = np.frombuffer(ids, "<u8"), np.frombuffer(counts, "<u4")
                at = np.minimum(np.searchsorted(known, ids), max(0, len(known) - 1))
                has = known[at] == ids if len(known) else np.zeros(len(ids), bool)
                ids_out.append(at[has].astype("<u4").tobytes())
                counts_out.append(counts[has].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids_out, pa.binary()), pa.array(counts_out, pa.binary())], ["doc_id", "toxic", "ids", "counts"])

    return kept, sample.mapInArrow(own, "doc_id long, toxic int, ids binary, counts binary").collect()


def train(examples: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_features: int, spec: ToxSpec) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds that maximise the likelihood of the grades, with an elastic net on the weights."""
    top = max(1, int(grades.max(initial=0)))
    theta, squares = 0.5 + spec.gap * np.arange(top), np.full(top, 1.0)
    z, n = np.zeros(n_features), np.zeros(n_features)

    def leader(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= spec.l1, 0.0, -(z - np.sign(z) * spec.l1) / ((spec.beta + np.sqrt(n)) / spec.alpha + spec.l2))

    for epoch in range(spec.epochs):
        for i in np.random.default_rng(epoch).permutation(len(examples)):
            (ids, x), y = examples[i], int(grades[i])
            w = leader(z[ids], n[ids])
            s = x @ w
            above = _sigmoid(theta - s)  # P(grade <= k)
            high = above[y] if y < top else 1.0
            low = above[y - 1] if y > 0 else 0.0
            p = max(high - low, 1e-9)
            slope = above * (1 - above)
            g_theta = np.zeros(top)
            if y < top:
                g_theta[y] -= slope[y] / p
            if y > 0:
                g_theta[y - 1] += slope[y - 1] / p
            g_theta = np.clip(g_theta, -4, 4)
            g = np.clip(-g_theta.sum(), -4, 4) * x
            squares += g_theta**2
            theta = np.maximum.accumulate(theta - 0.5 * g_theta / np.sqrt(squares) + 1e-9 * np.arange(top))
            new = n[ids] + g * g
            z[ids] += g - (np.sqrt(new) - np.sqrt(n[ids])) / spec.alpha * w
            n[ids] = new
    return leader(z, n), theta


def fit(docs: DataFrame, labels: DataFrame, spec: ToxSpec = ToxSpec()) -> ToxModel | None:
    """labels: doc_id and toxic (0 or 1; the largest counts where a doc_id has several). None without labelled texts.

    Rows without doc_id, text or label teach nothing; an empty text has no features; repeated rows count each.
    """
    hashes, rows = _labelled_sample(docs.where("text is not null"), labels, spec)
    if not len(hashes):
        return None
    rows = sorted(rows, key=lambda r: (r.doc_id, r.ids, r.counts))
    examples = [(np.frombuffer(r.ids, "<u4").astype(np.int64), np.frombuffer(r.counts, "<u4").astype(float)) for r in rows]
    grades = severity_grades(examples, np.array([r.toxic for r in rows]), spec.levels)
    weights, thresholds = train([(i, 1 + np.log(c)) for i, c in examples], grades, len(hashes), spec)
    used = np.flatnonzero(weights)
    return ToxModel(hashes[used], weights[used], thresholds)


def score(docs: DataFrame, model: ToxModel | None) -> DataFrame:
    """docs with expected_severity (0 to the top grade), grade (the median one: P(grade > k) >= 0.5 for each k below it) and toxic (grade > 0).

    A null or empty text, and every text without a model, has severity 0 and grade 0. Texts are read whole; repeated rows are scored alike; an empty table stays
    empty; columns of docs with these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(texts: pa.Array) -> list[pa.Array]:
        m: ToxModel | None = shared.value
        expected, grades, flags = [], [], []
        for block in blocks(texts):
            sums, has = np.zeros(block.rows), np.zeros(block.rows, bool)
            words = Words(block, INSIDE)
            has = words.counts > 0
            if m is not None and len(m.hashes):
                bits = max(12, len(m.hashes).bit_length() + 4)
                seen = np.zeros(1 << bits, bool)
                shift = np.uint64(64 - bits)
                seen[m.hashes >> shift] = True
                rows, ids = [], []
                for g, own in feature_hashes(block):
                    at = np.flatnonzero(seen[g >> shift])
                    where = np.minimum(np.searchsorted(m.hashes, g[at]), len(m.hashes) - 1)
                    hit = m.hashes[where] == g[at]
                    rows.append(own[at][hit])
                    ids.append(where[hit])
                keys, counts = np.unique(np.concatenate(rows) * np.int64(len(m.hashes)) + np.concatenate(ids), return_counts=True)
                np.add.at(sums, keys // len(m.hashes), (1 + np.log(counts)) * m.weights[keys % len(m.hashes)])
            if m is None:
                more = np.zeros((block.rows, 1))
            else:
                more = _sigmoid(sums[:, None] - m.thresholds) * has[:, None]
            expected += more.sum(1).tolist()
            grades += (more >= 0.5).sum(1).tolist()
            flags += (more[:, 0] >= 0.5).tolist()
        return [pa.array(expected, pa.float64()), pa.array(grades, pa.int32()), pa.array(flags, pa.bool_())]

    return rowmap.with_columns_from_text(docs, "expected_severity double, grade int, toxic boolean", compute)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = rowmap.documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", "expected_severity", "grade", "toxic")
