"""Finds the passages of a corpus that may repeat, without comparing texts with one another.

Every window of `window` consecutive units (bytes or words) is owned by one of its grams of `gram`
units: the one with the smallest hash, the leftmost among equals. Equal windows therefore have the
same owner. Consecutive windows of a text with the same owner form an occurrence, with the
owner's hash (the anchor), a hash of the units that the windows span (the passage), and its place.
A row holds the places that a passage has in a document, so that an anchor has a row for each document
and passage at most, however often a document repeats itself. There are about 2 / (window - gram + 2)
rows for each unit.

Two windows can only be equal if their anchors are. `shared_occurrences` keeps the rows of the anchors
that more than one document (or place) has. Every anchor has a key, made of the stretch of text where it
occurs first, so that what neighbours there goes to the same shard, and neighbouring occurrences of a
copy are one segment of text. Groups are never gathered: everything about an anchor is a sum, a minimum
or a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.textblocks import SPACE, Words, blocks, gram_hashes, mix, next_hashes, powers, prefix_hashes, range_hashes, sliding, word_hashes

_CHUNK = 1 << 22
_SEGMENT = 256
#: The stretches of text that give anchors their keys, in windows.
_RANGE = 4
#: A place is start * PLACE + windows.
PLACE = 1 << 24
MOST_WINDOW = 1 << 22
#: Distinct passages of an anchor, beyond which its windows become anchors.
MOST_PASSAGES = 20_000
_LOW = np.uint64((1 << 24) - 1)
_WORD_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_INVERSE = pow(_WORD_BASE, -1, 1 << 64)

Units = Callable[[object], tuple[np.ndarray, np.ndarray, Callable]]


def byte_units(gram: int):
    """Grams, row bounds and range hashes of a block's bytes."""

    def make(block):
        c = prefix_hashes(block.data)
        n = max(0, len(block.data) - gram + 1)
        grams = next_hashes(c, n, gram)
        return grams, block.offsets, lambda s, e: range_hashes(c, s, e)

    return make


def word_units(gram: int):
    """Grams, row bounds and range hashes of a block's words."""

    def make(block):
        words = Words(block, SPACE)
        h = word_hashes(block, words)
        c = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * powers(_WORD_BASE, len(h)), out=c[1:])
        back = powers(_WORD_INVERSE, len(h) + 1)
        return gram_hashes(h, gram), words.bounds, lambda s, e: mix((c[e] - c[s]) * back[s])

    return make


def block_occurrences(block, units, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, start, windows, anchor, passage) arrays of a block; start counts from the row's first unit."""
    grams, bounds, passage = units(block)
    wide = window - gram + 1
    found = []
    total = int(bounds[-1])
    for low in range(0, max(1, total), _CHUNK):  # long texts in chunks that overlap by a window
        part = grams[low : low + _CHUNK + wide - 1]
        if len(part) < wide:
            continue
        keyed = (part & ~_LOW) | np.arange(len(part), dtype=np.uint64)
        owner = (sliding(np.minimum, keyed, wide) & _LOW).astype(np.int64) + low
        s = np.arange(low, low + len(owner))
        row = np.searchsorted(bounds, s, "right") - 1
        inside = s + window <= bounds[row + 1]
        new = np.ones(len(s), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (row[1:] != row[:-1]) | (inside[1:] != inside[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(s))
        good = inside[first]
        first, last = first[good], last[good]
        found.append((row[first], s[first], last - first, grams[owner[first]]))
    if not found:
        zero = np.zeros(0, np.int64)
        return zero, zero, zero, zero.astype(np.uint64), zero.astype(np.uint64)
    row, s, n, anchor = (np.concatenate(x) for x in zip(*found, strict=True))
    return row, s - bounds[row], n, anchor, passage(s, s + n - 1 + window)


COLUMNS = "anchor long, passage long, doc_id long, places array<long>"


def _gathered(ids: np.ndarray, row: np.ndarray, s: np.ndarray, n: np.ndarray, anchor: np.ndarray, passage: np.ndarray) -> pa.RecordBatch:
    """A row for each document (row) and passage, with all its places, in the order of the first."""
    place = s * PLACE + n
    key = anchor ^ mix(passage + row.astype(np.uint64) * np.uint64(_WORD_BASE))
    _, first, inverse, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    if len(first) < len(key):
        place = place[np.argsort(first[inverse], kind="stable")]
        by = np.argsort(first)
        first, counts = first[by], counts[by]
    else:
        first = np.arange(len(key))
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    columns = [pa.array(c, pa.int64()) for c in (anchor[first].view(np.int64), passage[first].view(np.int64), ids[row[first]])]
    return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, pa.array(place, pa.int64()))], ["anchor", "passage", "doc_id", "places"])


def occurrences(docs: DataFrame, units, window: int, gram: int) -> DataFrame:
    """(anchor, passage, doc_id, places) of docs; a place is start * PLACE + windows. Rows without doc_id or text have none."""

    if not 0 < gram <= window <= MOST_WINDOW:
        raise ValueError(f"a window has from one to {MOST_WINDOW} units")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for block in blocks(batch.column(1)):
                yield _gathered(ids[block.first : block.first + block.rows], *block_occurrences(block, units, window, gram))

    rows = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")
    return rows.mapInArrow(run, COLUMNS)


def shared_occurrences(found: DataFrame, in_two_documents: bool, window: int, most_passages: int) -> DataFrame:
    """(doc_id, places, key, rep, passage, n, first, crowded): the rows of anchors that two documents, or else two places, have.

    key: a hash of the smallest document that has the anchor and of the stretch of _RANGE windows' length
    that the anchor's first place there is in. rep: whether the row represents its passage; only such rows
    have its hash and n, the number of its places. crowded: the anchor has more than most_passages of them.

    The rows are dealt out by their anchor once: the sums read the same exchange as the join (they ask
    for every column, since a narrower exchange would be another one), and the windows keep to it.
    """
    dealt = found.repartition(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), "anchor")
    sums = dealt.groupBy("anchor").agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min_by(F.col("places")[0], "doc_id").alias("at"), F.sum(F.size("places")).alias("m"), F.min("passage").alias("p"), F.max("passage").alias("q")
    )
    several = sums.where((F.col("lo") < F.col("hi")) if in_two_documents else ((F.col("m") > 1) & F.col("hi").isNotNull()))
    key = F.xxhash64("lo", F.floor(F.col("at") / (PLACE * _RANGE * window)))
    several = several.where("m > 0").select(F.col("anchor").alias("_anchor"), key.alias("key"), "lo", (F.col("p") == F.col("q")).alias("_alone"))
    kept = dealt.join(several.hint("shuffle_hash"), F.col("anchor") == F.col("_anchor"))
    same = Window.partitionBy("anchor", "passage")
    kept = kept.withColumn("rep", F.row_number().over(same.orderBy("doc_id")) == 1).withColumn("n", F.sum(F.size("places")).over(same))
    passages = F.sum(F.col("rep").cast("int")).over(Window.partitionBy("anchor"))
    kept = kept.withColumn("crowded", ~F.col("_alone") & (passages > most_passages))
    only = lambda c: F.when(F.col("rep"), F.col(c)).alias(c)
    return kept.select("doc_id", "places", "key", "rep", only("passage"), only("n"), (F.col("doc_id") == F.col("lo")).alias("first"), "crowded")


def _with_text(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(doc_id, text, items) of the documents of places (doc_id, place and others); items are its rows as structs, place first."""
    others = [c for c in places.columns if c not in ("doc_id", "place")]
    items = places.groupBy("doc_id").agg(F.collect_list(F.struct("place", *others)).alias("items"))
    return docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null").join(items, "doc_id")


def _items(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """The row of every item of a batch of `_with_text`, and the items' fields."""
    lists = batch.column(2)
    rows = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    flat = lists.flatten()
    return rows, *(flat.field(i).to_numpy(zero_copy_only=False) for i in range(flat.type.num_fields))


def single_windows(docs: DataFrame, places: DataFrame, units, window: int) -> DataFrame:
    """Occurrences of one window each for the windows of `places`: a window's own hash is its anchor and its passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, place = _items(batch)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for block in blocks(batch.column(1)):
                _, bounds, passage = units(block)
                own = (rows >= block.first) & (rows < block.first + block.rows)
                n = place[own] % PLACE
                start = np.repeat(place[own] // PLACE, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row = np.repeat(rows[own] - block.first, n)
                good = start + window <= bounds[row + 1] - bounds[row]
                row, start = row[good], start[good]
                h = passage(bounds[row] + start, bounds[row] + start + window)
                order = np.lexsort((start, row))
                row, start, h = row[order], start[order], h[order]
                yield _gathered(ids[block.first : block.first + block.rows], row, start, np.ones(len(row), np.int64), h, h)

    return _with_text(docs, places.select("doc_id", "place")).mapInArrow(run, COLUMNS)


SEGMENTS = "key long, doc_id long, start long, body binary, passages array<long>, rels array<long>, windows array<long>, ns array<long>"


def _runs(rows: np.ndarray, key: np.ndarray, start: np.ndarray, end: np.ndarray, most: int | None) -> np.ndarray:
    """Where, in items ordered by row and start, a new segment begins: items of one key that overlap or touch make one, of `most` units at most before its last item."""
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (key[1:] != key[:-1]) | (start[1:] > end[:-1])
    if most is not None:
        new[1:] |= start[1:] // most != start[:-1] // most
    return np.flatnonzero(new)


def passage_texts(docs: DataFrame, passages: DataFrame, cut: Callable, window: int) -> DataFrame:
    """Segments of text with the passages in them; cut(block) gives a function of row, start and end (in units) for the body.

    The passages of a document that have one key and overlap or touch make one segment, which ends after
    _SEGMENT units at the latest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, place, key, passage, n = _items(batch)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            order = np.lexsort((place, rows))
            rows, key, passage, n, place = (x[order] for x in (rows, key, passage, n, place))
            start, count = place // PLACE, place % PLACE
            end = start + count - 1 + window
            first = _runs(rows, key, start, end, _SEGMENT)
            offsets = np.append(first, len(rows))
            stop = np.maximum.reduceat(end, first) if len(first) else end
            for block in blocks(batch.column(1)):
                a, b = np.searchsorted(rows[first], [block.first, block.first + block.rows])
                if a == b:
                    continue
                low, high = offsets[a], offsets[b]
                body = cut(block)
                bodies = [body(r, s, e) for r, s, e in zip((rows[first[a:b]] - block.first).tolist(), start[first[a:b]].tolist(), stop[a:b].tolist(), strict=True)]
                rel = start[low:high] - np.repeat(start[first[a:b]], np.diff(offsets[a : b + 1]))
                at = pa.array((offsets[a : b + 1] - low).astype(np.int32))
                listed = [pa.ListArray.from_arrays(at, pa.array(x, pa.int64())) for x in (passage[low:high], rel, count[low:high], n[low:high])]
                columns = [pa.array(x, pa.int64()) for x in (key[first[a:b]], ids[rows[first[a:b]]], start[first[a:b]])]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(bodies, pa.binary()), *listed], ["key", "doc_id", "start", "body", "passages", "rels", "windows", "ns"])

    return _with_text(docs, passages.select("doc_id", F.col("places")[0].alias("place"), "key", "passage", "n")).mapInArrow(run, SEGMENTS)


TEXTS = "role int, key long, doc_id long, start long, body binary"


def document_texts(docs: DataFrame, asked: DataFrame, cut: Callable, window: int, most: int | None) -> DataFrame:
    """Of every document the text that the windows of asked (doc_id, places, key, roles) cover, in segments of one role and key each.

    roles: bit 0 for the first place of a row, bit 1 for all, which give segments of roles 0 and 1. With
    `most`, a segment ends after so many units, where a window isn't cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, key, roles, head = _lists(batch)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            segments = []
            for role, own in ((0, head & (roles & 1 > 0)), (1, roles & 2 > 0)):
                r, p, k = rows[own], places[own], key[own]
                order = np.lexsort((p, r))
                r, p, k = r[order], p[order], k[order]
                start = p // PLACE
                end = start + p % PLACE - 1 + window
                at = _runs(r, k, start, end, most)
                segments.append((role, r[at], k[at], start[at], np.maximum.reduceat(end, at) if len(at) else end))
            for block in blocks(batch.column(1)):
                body = None
                for role, r, k, start, stop in segments:
                    a, b = np.searchsorted(r, [block.first, block.first + block.rows])
                    if a == b:
                        continue
                    body = cut(block) if body is None else body
                    bodies = [body(x, s, e) for x, s, e in zip((r[a:b] - block.first).tolist(), start[a:b].tolist(), stop[a:b].tolist(), strict=True)]
                    columns = [pa.array(x, pa.int64()) for x in (k[a:b], ids[r[a:b]], start[a:b])]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, role), pa.int32()), *columns, pa.array(bodies, pa.binary())], ["role", "key", "doc_id", "start", "body"])

    return _with_text(docs, asked.select("doc_id", F.col("places").alias("place"), "key", "roles")).mapInArrow(run, TEXTS)


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Row, place, key and roles of all places of a batch of `_with_text`, whose items hold lists of places, and whether it is a list's first."""
    lists = batch.column(2)
    rows = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    flat = lists.flatten()
    places = flat.field(0)
    n = pc.list_value_length(places).to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(n)), n)
    head = np.ones(len(of), bool)
    head[1:] = of[1:] != of[:-1]
    return rows[of], places.flatten().to_numpy(zero_copy_only=False), *(flat.field(i).to_numpy(zero_copy_only=False)[of] for i in (1, 2)), head


class Segments:
    """A shard of segments: their bodies as a block, and their passages as arrays (`text` is the segment of each)."""

    def __init__(self, shard: pa.Table, window: int):
        shard = shard.combine_chunks()
        column = lambda c: shard.column(c).combine_chunks()
        self.window = window
        self.key, self.doc, self.start = (column(c).to_numpy() for c in ("key", "doc_id", "start"))
        self.block = next(blocks(column("body"), 1 << 62), None)
        self.text = np.repeat(np.arange(len(self.doc)), pc.list_value_length(column("passages")).to_numpy())
        self.passage, self.rel, self.windows, self.n = (column(c).flatten().to_numpy() for c in ("passages", "rels", "windows", "ns"))

    def keep(self, passage: Callable, bounds: np.ndarray) -> None:
        """Leaves passages out where the text isn't their own (another row with the same doc_id)."""
        s = bounds[self.text] + self.rel
        e = s + self.windows - 1 + self.window
        good = np.flatnonzero(e <= bounds[self.text + 1])
        own = good[passage(s[good], e[good]).view(np.int64) == self.passage[good]]
        self.text, self.passage, self.rel, self.windows, self.n = (x[own] for x in (self.text, self.passage, self.rel, self.windows, self.n))

    def each_window(self) -> tuple[np.ndarray, np.ndarray]:
        """For each window of each passage: the passage's number, and its start in the segment."""
        item = np.repeat(np.arange(len(self.text)), self.windows)
        inside = np.arange(len(item)) - np.repeat(np.cumsum(self.windows) - self.windows, self.windows)
        return item, self.rel[item] + inside


def shared_text(docs: DataFrame, units, window: int, gram: int, in_two_documents: bool, most_passages: int = MOST_PASSAGES) -> DataFrame:
    """What `shared_occurrences` finds, with every window of a crowded anchor as an anchor of its own, so that a shard stays bounded whatever the texts are."""
    from tessera.llm import rowmap

    found = lambda rows, name, most: rowmap.written(shared_occurrences(rows, in_two_documents, window, most), name)
    shared = found(occurrences(docs, units, window, gram), "shared", most_passages)
    crowded = shared.where("crowded")
    if not crowded.head(1):
        return shared
    # equal windows have one passage, so that none of these anchors is crowded
    single = found(single_windows(docs, crowded.select("doc_id", F.explode("places").alias("place")), units, window), "single", most_passages)
    return shared.where("not crowded").unionByName(single)


def streamed_spans(docs: DataFrame, shared: DataFrame, roles: F.Column, asked: Callable | None, cut: Callable, locate: Callable, window: int, per_shard: int, most: int | None) -> DataFrame:
    """(doc_id, spans) of documents with windows that also start earlier; spans are (s, e) in units, and may overlap.

    What is looked for are the segments of role 0 (see `document_texts`; roles tells those of a row of
    shared), or what asked(shard) makes as rows (key, doc_id, start, body), given a column that is the
    shard of a key. Segments of role 1 are streamed: a task gets what is asked of a shard and segments with
    about per_shard places, and a shard with more of them has as many tasks as that takes, dealt by
    document. locate(table) gives the spans (doc_id, s, e) found there.
    """
    from tessera.llm import rowmap

    wanted = shared.withColumn("roles", roles).where("roles > 0")
    streamed = F.when(F.col("roles") >= 2, F.size("places")).otherwise(0)
    total = wanted.agg(F.sum(streamed)).first()[0] or 0
    shards = max(1, -(-total // per_shard))
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")
    loads = rowmap.written(wanted.groupBy(shard).agg(F.greatest(F.lit(1), F.ceil(F.sum(streamed) / per_shard)).alias("parts")), "loads")
    texts = document_texts(docs, wanted, cut, window, most)
    if asked is not None:
        texts = texts.unionByName(asked(shard).withColumn("role", F.lit(0)))
    every, own = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), F.array(F.pmod(F.xxhash64("doc_id"), "parts"))
    dealt = texts.withColumn("shard", shard).join(loads, "shard").withColumn("part", F.explode(F.when(F.col("role") == 0, every).otherwise(own)))
    found = dealt.select("shard", "part", "role", "doc_id", "start", "body").groupBy("shard", "part").applyInArrow(locate, "doc_id long, s long, e long")
    return rowmap.written(found, "located").groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def coverage(spans: pa.ListArray, first: int, bounds: np.ndarray) -> np.ndarray:
    """Which units of a block the spans of its rows cover; bounds are the rows' in the block, whose first row is `first`."""
    rows = len(bounds) - 1
    part = spans.slice(first, rows)
    n = pc.list_value_length(part).fill_null(0).to_numpy(zero_copy_only=False)
    flat = part.flatten()
    s, e = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    low, high = np.repeat(bounds[:-1], n), np.repeat(bounds[1:], n)
    change = np.zeros(int(bounds[-1]) + 1, np.int64)
    np.add.at(change, np.minimum(low + s, high), 1)
    np.add.at(change, np.minimum(low + e, high), -1)
    return np.cumsum(change[:-1]) > 0
