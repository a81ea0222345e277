"""Exact medians of every component of the vectors of many groups, by selection: no sample, and no group held in memory.

A group of at most `hold` rows is one group of a shuffle. Larger ones are narrowed in rounds: for every
(group, component) an interval of values is known that holds the two middle ranks; a pass counts, inside
each task, how many values fall into each of BUCKETS equal parts of it, with the least and the greatest
value of each part, and the part (or the two parts) of the middle ranks is the next interval. Parts are
equal in the order of the bits of a double, so a round takes eight bits off an interval and seven rounds
suffice whatever the values; it ends earlier where least and greatest agree or few values are left, which
are then sorted. What a task holds and what it sends depends on groups, components and BUCKETS only.

There are at most a million large groups, since `hold` grows with the number of rows; they are taken
`at_once` in a pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256
_SIGN = np.uint64(1 << 63)
_COUNTS = "slot long, bucket int, n long, low double, high double"


def _keys(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers in the same order; -0.0 counts as 0.0."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def _merged(rows: list[np.ndarray]) -> np.ndarray:
    """Records (slot, bucket, n, low, high), one of each slot and bucket."""
    every = np.concatenate(rows)
    every = every[np.lexsort((every["bucket"], every["slot"]))]
    head = np.flatnonzero((np.diff(every["slot"], prepend=-1) != 0) | (np.diff(every["bucket"], prepend=-1) != 0))
    out = every[head].copy()
    if len(head):
        out["n"] = np.add.reduceat(every["n"], head)
        out["low"], out["high"] = np.minimum.reduceat(every["low"], head), np.maximum.reduceat(every["high"], head)
    return out


_RECORD = np.dtype([("slot", np.int64), ("bucket", np.int32), ("n", np.int64), ("low", np.float64), ("high", np.float64)])


def _inside(batch: pa.RecordBatch, groups: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of the batch that lie in their slot's interval; slot = place of the group * components + component."""
    key = batch.column(0).to_numpy(zero_copy_only=False)
    at = np.minimum(np.searchsorted(groups, key), len(groups) - 1)
    own = np.flatnonzero(groups[at] == key)
    part = batch.column(1).take(pa.array(own))
    d = low.shape[1]
    if len(own) and not np.all(np.diff(part.offsets.to_numpy()) == d):
        raise ValueError(f"vectors of {d} components were expected")
    m = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), d)
    slots = at[own][:, None] * d + np.arange(d)
    good = (m >= low[at[own]]) & (m <= high[at[own]])
    return slots[good], m[good]


def _bucket(slots: np.ndarray, values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The part of its slot's interval that each value lies in."""
    a, b = _keys(low.ravel())[slots], _keys(high.ravel())[slots]
    return ((_keys(values) - a) // ((b - a) // np.uint64(BUCKETS) + np.uint64(1))).astype(np.int32)


def _counts(rows: DataFrame, groups: np.ndarray, low: np.ndarray, high: np.ndarray, split: bool) -> DataFrame:
    """(slot, bucket, n, low, high) of the values in the intervals; all in bucket 0 without `split`."""
    shared = rows.sparkSession.sparkContext.broadcast((groups, low, high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, low, high = shared.value
        held, size = [np.zeros(0, _RECORD)], 0
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                slots, values = _inside(batch.slice(first, 4096), groups, low, high)
                made = np.zeros(len(slots), _RECORD)
                made["slot"], made["n"], made["low"], made["high"] = slots, 1, values, values
                if split:
                    made["bucket"] = _bucket(slots, values, low, high)
                held.append(_merged([made]))
                size += len(held[-1])
                if size > 1 << 20:
                    held = [_merged(held)]
                    size = 0
                    if len(held[0]) > 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0][c]) for c in _RECORD.names], list(_RECORD.names))
                        held = [np.zeros(0, _RECORD)]
        last = _merged(held)
        yield pa.RecordBatch.from_arrays([pa.array(last[c]) for c in _RECORD.names], list(_RECORD.names))

    found = rows.mapInArrow(run, _COUNTS)
    return found.groupBy("slot", "bucket").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def _middle(counts: DataFrame, ranks: np.ndarray) -> np.ndarray:
    """(slot, below, n, low, high) of the one or two parts of each slot that hold its ranks (from 0, the lower and the upper)."""
    spark = counts.sparkSession
    slots = np.flatnonzero(ranks[:, 0] >= 0)
    wanted = spark.createDataFrame(pa.table({"slot": slots, "first": ranks[slots, 0], "last": ranks[slots, 1]}))
    w = Window.partitionBy("slot").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("below", F.coalesce(F.sum("n").over(w), F.lit(0)))  # BUCKETS rows of a slot at most
    found = placed.join(wanted, "slot").where("below <= last and below + n > first").select("slot", "below", "n", "low", "high")
    return found.orderBy("slot", "below").toArrow()


def _large(rows: DataFrame, groups: np.ndarray, sizes: np.ndarray, d: int, enough: int) -> np.ndarray:
    """The medians (group, component) of some large groups."""
    n = len(groups)
    shape = (n, d)
    low, high = np.full(shape, -np.inf), np.full(shape, np.inf)
    every = _counts(rows, groups, low, high, False).toArrow()
    at = every.column("slot").to_numpy()
    low.ravel()[at], high.ravel()[at] = every.column("low").to_numpy(), every.column("high").to_numpy()
    left = np.repeat(sizes, d)
    ranks = np.stack([(left - 1) // 2, left // 2], 1)
    ends = np.stack([low.ravel(), high.ravel()], 1)  # of slots that are known: the two middle values
    done = ends[:, 0] == ends[:, 1]
    while (~done & (left > enough)).any():
        busy = ~done & (left > enough)
        mask = busy.reshape(shape)
        found = _middle(_counts(rows, groups, np.where(mask, low, np.inf), np.where(mask, high, -np.inf), True), np.where(busy[:, None], ranks, -1))
        slot, below, count, a, b = (found.column(c).to_numpy() for c in ("slot", "below", "n", "low", "high"))
        second = np.append(False, slot[1:] == slot[:-1])
        first = ~second & ~np.append(second[1:], False)
        # one part holds both ranks: it is the next interval; of two, the ends that meet are the middle values
        s = slot[first]
        low.ravel()[s], high.ravel()[s], left[s] = a[first], b[first], count[first]
        ranks[s] -= below[first][:, None]
        ends[s] = np.stack([a[first], b[first]], 1)
        s = slot[second]
        ends[s] = np.stack([b[np.flatnonzero(second) - 1], a[second]], 1)
        done[s] = True
        done |= ends[:, 0] == ends[:, 1]
    if not done.all():
        few = ~done.reshape(shape)
        shared = rows.sparkSession.sparkContext.broadcast((groups, np.where(few, low, np.inf), np.where(few, high, -np.inf)))

        def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                slots, values = _inside(batch, *shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(values)], ["slot", "x"])

        slots = np.flatnonzero(~done)
        wanted = rows.sparkSession.createDataFrame(pa.table({"slot": slots, "first": ranks[slots, 0] + 1, "last": ranks[slots, 1] + 1}))
        listed = rows.mapInArrow(rest, "slot long, x double").groupBy("slot").agg(F.sort_array(F.collect_list("x")).alias("x"))  # `enough` values of a slot at most
        found = listed.join(wanted, "slot").select("slot", F.expr("element_at(x, cast(first as int)) as a"), F.expr("element_at(x, cast(last as int)) as b")).toArrow()
        ends[found.column("slot").to_numpy()] = np.stack([found.column("a").to_numpy(), found.column("b").to_numpy()], 1)
    return ends.mean(1).reshape(shape)


def group_medians(rows: DataFrame, group: str, column: str, hold: int = 1 << 16, enough: int = 4096, at_once: int = 4096) -> DataFrame:
    """(group, medians): of each group the median of every component of its vectors, the mean of the middle two.

    rows: stored, since they are read several times; the group a long, the vectors arrays of doubles of
    one length without nulls or NaN. Null groups are left out. An empty table gives no rows.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(group).cast("long").alias("g"), F.col(column).cast("array<double>").alias("v")).where("g is not null and v is not null")
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    hold = max(hold, total // 1_000_000)
    large = sizes.where(F.col("n") > hold).orderBy("g").toArrow()  # fewer than a million
    groups, n = large.column("g").to_numpy(), large.column("n").to_numpy()

    def held(table: pa.Table) -> pa.Table:
        v = table.column("v").combine_chunks()
        m = np.median(v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1), 0)
        return pa.table({"g": table.column("g")[:1], "medians": pa.array([m], pa.list_(pa.float64()))})

    small = rows if not len(groups) else rows.join(F.broadcast(large_table(spark, groups)), "g", "left_anti")
    out = small.groupBy("g").applyInArrow(held, "g long, medians array<double>")
    if len(groups):
        d = rows.select(F.size("v")).first()[0]
        for i in range(0, len(groups), at_once):
            m = _large(rows, groups[i : i + at_once], n[i : i + at_once], d, enough)
            table = pa.table({"g": pa.array(groups[i : i + at_once], pa.int64()), "medians": pa.array(list(m), pa.list_(pa.float64()))})
            out = out.unionByName(spark.createDataFrame(table))
    return out.select(F.col("g").alias(group), "medians")


def large_table(spark, groups: np.ndarray) -> DataFrame:
    return spark.createDataFrame(pa.table({"g": pa.array(groups, pa.int64())}))
