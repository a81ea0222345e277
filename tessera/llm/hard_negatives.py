"""Hard-negative mining by slot-decomposed selection.

An anchor's positives are its best rows of the same label. Each positive has a window of scores, a share
of its own score, from which the best rows of other labels are wanted. The windows of an anchor overlap,
but their upper limits cut the scores into disjoint slots: a row belongs to the slot of the least upper
limit that it does not exceed. One pass keeps the best k rows of every slot, as a combiner does, first
inside each task and then per anchor and slot. The best k rows below an upper limit are then those of its
slot and of all lower ones merged, and a window's lower limit only cuts off their end.

Anchors are a stated share of the rows. They are written once and broadcast in parts of at most
`anchors_at_once`; each part meets every partition of the rows in place, as products of matrices, and only
the best rows of each slot leave a task. So no row of the table is shuffled, and what is shuffled is
bounded by tasks, anchors, slots and k.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import rowmap


@dataclass(frozen=True)
class MiningSpec:
    """A window: low * positive_score <= 100 * negative_score <= high * positive_score, in hundredths.

    scale: a component x counts as floor(scale * x). anchor_step: rows whose vec_id it divides are anchors.
    """

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    scale: int = 256
    anchor_step: int = 100
    anchors_at_once: int = 1 << 14


#: Scores looked at together: rows of one tile and anchors of one tile.
TILE = (2048, 1024)
_LONG = np.iinfo(np.int64)


def usable(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, vec array<double> of whole numbers) of the rows that take part: none with a null or a component that is not finite."""
    good = F.expr("vec_id is not null and label is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    vec = F.transform("embedding", lambda x: _floor(x.cast("double") * scale))
    return rows.where(good).select(F.col("vec_id").cast("long"), F.col("label").cast("long"), vec.alias("vec"))


def _floor(x):
    """floor as a double: whole numbers of any size, where Spark's own gives a long."""
    return F.when(F.abs(x) < F.lit(2.0**53), F.floor(x).cast("double")).otherwise(x)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers; ones beyond the long range count as its ends."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = [np.array([[int(x) for x in r] for r in m], object) for m in (a, b)]
    return np.clip(whole[0] @ whole[1].T, _LONG.min, _LONG.max).astype(np.int64)


class Slots:
    """The best k rows of each (anchor, slot), the highest score first and ties by vec_id."""

    def __init__(self, anchors: int, slots: int, k: int):
        self.k, self.slots = k, slots
        self.held = np.zeros((4, 0), np.int64)  # anchor * slots + slot, score, vec_id, and a number of the row
        self.waiting: list[np.ndarray] = []
        self.size = 0
        self.least = np.full(anchors * slots, _LONG.min)  # of full slots, the score that a row must reach

    def offer(self, key: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray) -> None:
        good = score >= self.least[key]
        if good.any():
            self.waiting.append(np.stack([key[good], score[good], vec_id[good], row[good]]))
            self.size += int(good.sum())
            if self.size > 1 << 20:
                self.settle()

    def settle(self) -> np.ndarray:
        every = np.concatenate([self.held, *self.waiting], axis=1)
        key, score, vec_id, row = every
        by = np.lexsort((row, vec_id, ~score, key))
        heads = np.flatnonzero(np.diff(key[by], prepend=-1))
        rank = np.arange(len(by)) - np.repeat(heads, np.diff(np.append(heads, len(by))))
        self.held, self.waiting, self.size = every[:, by[rank < self.k]], [], 0
        full = by[rank == self.k - 1]
        self.least[key[full]] = score[full]
        return self.held


def _parts(rows: DataFrame, spec: MiningSpec) -> tuple[DataFrame, list[int]]:
    """The anchors, numbered and written, with the part of each; and the parts, of anchors_at_once rows at most."""
    anchors = rows.where(F.col("vec_id") % spec.anchor_step == 0)
    anchors = rowmap.written(anchors, "anchors")
    count = anchors.count()
    dealt = anchors.repartition(max(1, -(-count // spec.anchors_at_once)))
    numbered = rowmap.written(dealt.withColumn("anchor", F.monotonically_increasing_id()).withColumn("part", F.expr(f"anchor div {spec.anchors_at_once}")), "numbered")
    return numbered, sorted(r["part"] for r in numbered.select("part").distinct().collect())


def _best_of_part(rows: DataFrame, known: dict[int, tuple], pairs: Callable, slots: int, k: int) -> DataFrame:
    """(anchor, slot, score, vec_id) of the best k rows in each slot of each task.

    known: by dimension (anchor, vec_id, label, vectors, limits). pairs(scores, vec_ids, labels, part of
    known) gives the slot of each pair, or -1.
    """
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        kept = {d: Slots(len(of[0]), slots, k) for d, of in known.items()}
        seen = 0
        for batch in batches:
            column = batch.column(2)
            sizes = np.diff(column.offsets.to_numpy())
            for d, of in known.items():
                own = np.flatnonzero(sizes == d)
                for low in range(0, len(own), TILE[0]):
                    at = own[low : low + TILE[0]]
                    part = batch.take(pa.array(at))
                    ids, labels = part.column(0).to_numpy(), part.column(1).to_numpy()
                    m = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)
                    for a in range(0, len(of[0]), TILE[1]):
                        anchors = [x[a : a + TILE[1]] for x in of]
                        score = inner(m, anchors[3])
                        slot = pairs(score, ids, labels, anchors)
                        r, c = np.nonzero(slot >= 0)
                        kept[d].offer((a + c) * slots + slot[r, c], score[r, c], ids[r], seen + at[r])
            seen += batch.num_rows
        for d, of in known.items():
            key, score, vec_id, _ = kept[d].settle()
            yield pa.RecordBatch.from_arrays([pa.array(of[0][key // slots]), pa.array(key % slots, pa.int32()), pa.array(score), pa.array(vec_id)], ["anchor", "slot", "score", "vec_id"])

    return rows.select("vec_id", "label", "vec").mapInArrow(run, "anchor long, slot int, score long, vec_id long")


def _collected(part: DataFrame, limits: dict[int, list] | None = None, n: int = 0) -> dict[int, tuple]:
    """The anchors of a part by dimension; limits: of each anchor the n upper and the lower limits of its windows."""
    table = part.select("anchor", "vec_id", "label", "vec").toArrow().combine_chunks()  # anchors_at_once rows at most
    sizes = pc.list_value_length(table.column("vec")).to_numpy()
    none, out = [(_LONG.min, _LONG.max)] * n, {}
    for d in np.unique(sizes).tolist():
        of = table.filter(pa.array(sizes == d))
        anchor, vec_id, label = (of.column(c).to_numpy() for c in ("anchor", "vec_id", "label"))
        vec = pc.list_flatten(of.column("vec")).to_numpy().reshape(len(of), d)
        own = [((limits or {}).get(a, []) + none)[:n] for a in anchor.tolist()]
        out[d] = (anchor, vec_id, label, vec, np.array(own, np.int64).reshape(len(of), n, 2))
    return out


def _first(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _same_label(score, ids, labels, of):
    return np.where((labels[:, None] == of[2][None]) & (ids[:, None] != of[1][None]), 0, -1)


def _slot(score, ids, labels, of):
    """The number of upper limits that a score of another label does not exceed, less one."""
    slot = np.full(score.shape, -1)
    for j in range(of[4].shape[1]):
        slot += score <= of[4][:, j, 0][None]
    # below every lower limit a row is in no window
    return np.where((labels[:, None] != of[2][None]) & (score >= of[4][:, :, 1].min(1)[None]), slot, -1)


def positives(rows: DataFrame, spec: MiningSpec = MiningSpec()) -> tuple[DataFrame, DataFrame, list[int]]:
    """(anchor, part, anchor_id, positive_id, positive_score, place) of every anchor's best rows of its label; the anchors; their parts."""
    anchors, parts = _parts(rows, spec)
    found = None
    for part in parts:
        own = anchors.where(F.col("part") == part)
        best = _best_of_part(rows, _collected(own), _same_label, 1, spec.positives)
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = rows.select(F.lit(0).cast("long").alias("anchor"), F.lit(0).alias("slot"), F.lit(0).cast("long").alias("score"), "vec_id").where("false")
    best = _first(found, ["anchor"], spec.positives)
    named = best.join(anchors.select("anchor", "part", F.col("vec_id").alias("anchor_id")), "anchor")
    named = named.select("anchor", "part", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("place"))
    return rowmap.written(named, "positives"), anchors, parts


def mine(rows: DataFrame, spec: MiningSpec = MiningSpec()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): each positive's hard negatives, the best first.

    rows: vec_id, label, embedding, and other columns, which are ignored. Rows with a null in any of the
    three or a component that is null, NaN or infinite take no part, and rows of different dimensions
    have no score with each other. Ties go to the smaller vec_id. Every row is one of its own: an anchor
    whose vec_id repeats has windows for each of its rows, none of which is a positive of the others. A
    positive with no row in its window has none here; an empty table gives none.
    """
    rows = usable(rows, spec.scale)
    good, anchors, parts = positives(rows, spec)
    found = None
    for part in parts:
        limits: dict[int, list] = {}
        own = good.where(F.col("part") == part)
        for r in own.select("anchor", "positive_score", "place").orderBy("anchor", "place").collect():  # positives of a part's anchors
            s = r["positive_score"]
            # a window between low * s and high * s that ends before it begins holds nothing
            limits.setdefault(r["anchor"], []).append((spec.high * s // 100, -(-spec.low * s // 100)) if spec.low * s <= spec.high * s else (_LONG.min, _LONG.max))
        best = _best_of_part(rows, _collected(anchors.where(F.col("part") == part), limits, spec.positives), _slot, spec.positives, spec.negatives)
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = rows.select(F.lit(0).cast("long").alias("anchor"), F.lit(0).alias("slot"), F.lit(0).cast("long").alias("score"), "vec_id").where("false")
    return windows(_first(found, ["anchor", "slot"], spec.negatives).drop("rank"), good, spec)


def windows(slots: DataFrame, good: DataFrame, spec: MiningSpec = MiningSpec()) -> DataFrame:
    """Every window's best rows out of the best of each slot, merged from the lowest slot upwards."""
    below = slots.withColumn("place", F.explode(F.expr("sequence(1, slot + 1)")))  # k rows a slot at most
    merged = _first(below, ["anchor", "place"], spec.negatives)
    p, score = (F.col(c).cast("decimal(20,0)") for c in ("positive_score", "score"))
    inside = (spec.low * p <= 100 * score) & (100 * score <= spec.high * p)
    return merged.join(good, ["anchor", "place"]).where(inside).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved))
