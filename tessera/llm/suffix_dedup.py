"""Substring deduplication by a run-length index.

Passages that may repeat (see `anchors`) are dealt out to shards. One representative of each distinct
passage of a shard is indexed by their run-compressed Burrows-Wheeler transform with the text positions
of run ends (an r-index). The text of every document that may repeat one is then streamed through the
index from its end: one backward step a byte keeps a longest match (its length, one place of it, and its
row), jumping to the nearer run end when the preceding byte differs. Matches of at least the minimum
length are marked with the smallest document of the rows that share them, and those of a smaller document
than the streamed one are removed. Lengths are counted up to the minimum, which is all that is asked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import rowmap
from tessera.llm.anchors import MOST_PASSAGES, byte_units, coverage, shared_text, streamed_spans
from tessera.llm.textblocks import Block, blocks

MIN_LENGTH = 50
GRAM = 20
PER_SHARD = 32768
#: Bytes of a segment at most, since a step is one byte of every segment.
MOST_SEGMENT = 1024
_PACKED_BITS = 63
_SORT_BITS = 63


class Marks:
    """A bit vector of places with counts, which tells how many marked places stand before a place without a search."""

    def __init__(self, at: np.ndarray, size: int):
        """at are the marked places below size, in order; there is one at least."""
        word = at >> 6
        head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        self.words = np.zeros((size >> 6) + 1, np.uint64)
        self.words[word[head]] = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), head)
        self.counts = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.counts[1:])

    def before(self, places: np.ndarray) -> np.ndarray:
        """Number of marked places below each of places, which are `size` at most."""
        word = places >> 6
        return self.counts[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)))

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.counts.nbytes


class RunLengthIndex:
    """An r-index over some texts, each at least one byte long.

    What stays after building: for each run its first and last row, symbol, samples and mapping, with marks
    at the first rows of runs, and at the runs of each symbol; marks at the rows where groups of `depth` equal
    symbols begin, with the least owner of each; and, to compare places, the first symbols at each place and
    its rank among the suffixes by some powers of symbols. Symbols are the bytes that occur, numbered from 1.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, depth: int, owner: np.ndarray | None = None, most: int | None = None):
        """data holds the texts one after the other; `owner` is a number of each (itself by default); with `most`, longer matches count as so long."""
        lengths, self.most = np.diff(offsets), most
        ends = np.cumsum(lengths + 1) - 1  # of each text, where its terminator stands
        n = int(ends[-1]) + 1
        has = np.bincount(data, minlength=256) > 0
        symbols = int(has.sum())
        self.symbol = np.where(has, np.cumsum(has), symbols + 1)  # of each byte; one number for all that don't occur
        self.bits = symbols.bit_length()
        text = np.zeros(n, np.int64)  # terminators are 0
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = self.symbol[data]
        sa = self._sort(text)
        self.size = n
        same = self.equal(sa[1:], sa[:-1], depth)
        self.group_start = np.flatnonzero(np.concatenate([[True], ~same]))
        self.groups = Marks(self.group_start, n)
        of_row = np.repeat(np.arange(len(lengths)) if owner is None else owner, lengths + 1)[sa]
        self.least_owner = np.minimum.reduceat(of_row, self.group_start)
        bwt = text[sa - 1]
        starts = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        self.run_start, self.run_char = starts, bwt[starts]
        self.run_marks = Marks(starts, n)
        run_length = np.diff(np.append(starts, n))
        self.run_last = starts + run_length - 1
        self.first_sample, self.last_sample = sa[starts], sa[self.run_last]
        order = np.argsort(self.run_char.astype(np.int16), kind="stable")  # runs by symbol, then place
        before = np.concatenate([[0], np.cumsum(run_length[order])[:-1]])
        self.lf = np.empty(len(starts), np.int64)  # row that the first row of each run maps to
        self.lf[order] = before
        self.by_char, self.char_marks = order, Marks(self.run_char[order] * len(starts) + order, (symbols + 2) * len(starts))

    def owners(self, rows: np.ndarray) -> np.ndarray:
        """The least owner of the texts that have the first `depth` symbols of each row."""
        return self.least_owner[self.groups.before(rows + 1) - 1]

    def _sort(self, text: np.ndarray) -> np.ndarray:
        """Suffix array by doubling, of which only the suffixes still equal are sorted again; ranks by at most `most` symbols stay, to compare places."""
        n, self.width = len(text), _PACKED_BITS // self.bits
        padded = np.concatenate([text, np.zeros(self.width, np.int64)])
        key = np.zeros(n, np.int64)
        for j in range(self.width):
            key <<= self.bits
            key |= padded[j : j + n]
        #: the first `width` symbols of each suffix in one number
        self.packed = np.append(key, 0)
        bits = n.bit_length()
        low, small = (1 << bits) - 1, 3 * bits <= _SORT_BITS
        if small:  # numbers that end in their places: sorting them is several times as fast as ordering places by them
            both = (key & ~low) | np.arange(n)
            both.sort()
            sa, apart = both & low, (both[1:] ^ both[:-1]) > low
        else:
            sa = np.argsort(key)
            apart = np.diff(key[sa]) != 0
        head = np.concatenate([[True], apart])
        rank = np.empty(n + 1, np.int64)  # of a suffix, the first row of those equal so far; -1 past the end
        rank[n] = -1
        rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))

        def split(after: Callable) -> bool:
            """Orders the suffixes still equal by a number of each, n at most; False if there are none."""
            rows = np.flatnonzero(~(head & np.append(head[1:], True)))
            if not len(rows):
                return False
            at = sa[rows]
            if small:
                both = (rank[at] << 2 * bits) | (after(at) << bits) | np.arange(len(at))
                both.sort()
                order, apart = both & low, (both[1:] ^ both[:-1]) > low
            else:
                both = rank[at] * (n + 1) + after(at)
                order = np.argsort(both)
                apart = np.diff(both[order]) != 0
            sa[rows] = at = at[order]
            head[rows] = fresh = np.concatenate([[True], apart])
            rank[at] = np.maximum.accumulate(np.where(fresh, rows, 0))
            return True

        if small:
            split(lambda at: key[at] & low)
        self.ranks: list[tuple[int, np.ndarray]] = [(self.width, rank.astype(np.int32))]
        step = self.width
        while split(lambda at: rank[np.minimum(at + step, n)] + 1):
            step *= 2
            if self.most is None or step <= self.most:
                self.ranks.append((step, rank.astype(np.int32)))
        return sa

    def equal(self, p: np.ndarray, q: np.ndarray, depth: int) -> np.ndarray:
        """Whether `depth` symbols from p and q agree."""
        if depth < self.width:
            rest = self.bits * (self.width - depth)
            return self.packed[p] >> rest == self.packed[q] >> rest
        step, rank = max((x for x in self.ranks if x[0] <= depth), key=lambda x: x[0])
        last = len(rank) - 1
        out = rank[p] == rank[q]
        for done in range(step, depth, step):
            at, still = min(done, depth - step), np.flatnonzero(out)
            out[still] = rank[np.minimum(p[still] + at, last)] == rank[np.minimum(q[still] + at, last)]
        return out

    def common(self, p: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix at p and q, `most` at most; no terminator stands within `most` of p."""
        out = self._packed_common(p, q)
        more = np.flatnonzero((out == self.width) & (most > self.width))
        if len(more):
            p, q, last, far = p[more], q[more], self.size, np.full(len(more), self.width)
            for step, rank in reversed([x for x in self.ranks if x[0] <= int(most[more].max())]):
                at, to = np.minimum(p + far, last), np.minimum(q + far, last)
                far += step * (rank[at] == rank[to])
            out[more] = far + self._packed_common(np.minimum(p + far, last), np.minimum(q + far, last))
        return np.minimum(out, most)

    def _packed_common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix at p and q, `width` at most."""
        differ = self.packed[p] ^ self.packed[q]
        differ &= ~(differ >> 1)  # so that no rounding changes the highest bit
        return (self.bits * self.width - np.frexp(differ.astype(np.float64))[1]) // self.bits

    def matching_statistics(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Streams texts from their ends, all at once; each step gives (text, place, match length, row) arrays.

        The match is the longest prefix of what follows `place` that occurs in the index, counted up to
        `most`; `row` is the rank of a suffix at which it does.
        """
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        ends, sizes = offsets[1:][order], lengths[order]
        row, length, place = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64), np.full(len(order), self.first_sample[0])
        runs, shorter = len(self.run_start), -sizes
        for step in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(shorter, -step, "left"))
            c = self.symbol[data[ends[:live] - 1 - step]]
            r = self.run_marks.before(row[:live] + 1) - 1
            ahead = row[:live] - self.run_start[r]
            sample = place[:live]
            size = length[:live]
            off = np.flatnonzero(self.run_char[r] != c)
            if len(off):
                to = self.char_marks.before(c[off] * runs + r[off])
                has_up = to > 0
                up = self.by_char[np.maximum(to - 1, 0)]
                has_up &= self.run_char[up] == c[off]
                has_down = to < runs
                down = self.by_char[np.minimum(to, runs - 1)]
                has_down &= self.run_char[down] == c[off]
                near = np.where(has_up, self.common(sample[off], self.last_sample[up], size[off]), -1)
                other = np.where(has_down, self.common(sample[off], self.first_sample[down], size[off]), -1)
                lower = other > near
                some = np.maximum(near, other) >= 0
                pick = np.where(lower, down, up)
                r[off] = np.where(some, pick, 0)
                ahead[off] = np.where(some & ~lower, self.run_last[pick] - self.run_start[pick], 0)
                sample[off] = np.where(some, np.where(lower, self.first_sample[pick], self.last_sample[pick]), self.first_sample[0])
                size[off] = np.maximum(near, other)  # -1 becomes a match of no bytes
                lost = off[~some]
            else:
                lost = off
            row[:live] = self.lf[r] + ahead
            sample -= 1
            size += 1
            if self.most is not None:
                np.minimum(size, self.most, out=size)
            if len(lost):  # the byte does not occur: start again
                row[lost], sample[lost], size[lost] = 0, self.first_sample[0], 0
            yield order[:live], ends[:live] - 1 - step, size, row[:live]


def _locate(min_length: int):
    def run(shard: pa.Table) -> pa.Table:
        shard = shard.combine_chunks()
        role, doc, start = (shard.column(c).to_numpy() for c in ("role", "doc_id", "start"))
        bodies = shard.column("body").combine_chunks()
        known, asked = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        out = [np.zeros(0, np.int64)] * 3
        if len(known) and len(asked):
            # copies are streamed once
            distinct = bodies.take(pa.array(asked)).dictionary_encode()
            texts, of = distinct.dictionary, distinct.indices.to_numpy()
            a, b = (next(blocks(x, 1 << 62)) for x in (bodies.take(pa.array(known)), texts))
            first = mark_matches(a.data, a.offsets, doc[known], b.data, b.offsets, min_length)
            sizes = np.diff(b.offsets)[of]
            base = np.cumsum(sizes) - sizes
            item = np.repeat(np.arange(len(asked)), sizes)
            rel = np.arange(len(item)) - base[item]
            hit = first[b.offsets[of][item] + rel] < doc[asked][item]
            new = hit & ~np.concatenate([[False], hit[:-1] & (item[1:] == item[:-1])])
            last = hit & ~np.concatenate([hit[1:] & (item[1:] == item[:-1]), [False]])
            i = item[new]
            s = start[asked][i] + rel[new]
            out = [doc[asked][i], s, start[asked][i] + rel[last] + min_length]
        return pa.table({k: pa.array(x, pa.int64()) for k, x in zip(("doc_id", "s", "e"), out, strict=True)})

    return run


NONE = np.iinfo(np.int64).max


def mark_matches(known: np.ndarray, known_offsets: np.ndarray, doc: np.ndarray, data: np.ndarray, offsets: np.ndarray, min_length: int) -> np.ndarray:
    """For each byte of data the smallest document of those whose known text has the min_length bytes from there on; NONE where there is none."""
    index = RunLengthIndex(known, known_offsets, min_length, doc, min_length)
    marks = np.full(len(data) + 1, NONE)
    for _, place, length, row in index.matching_statistics(data, offsets):
        long = length >= min_length
        marks[place[long]] = index.owners(row[long])
    return marks


def _cut(block: Block):
    offsets, data = block.offsets.tolist(), block.data.tobytes()
    return lambda row, s, e: data[offsets[row] + s : min(offsets[row] + e, offsets[row + 1])]


def find_repeats(docs: DataFrame, min_length: int = MIN_LENGTH, per_shard: int = PER_SHARD, most_passages: int = MOST_PASSAGES) -> DataFrame:
    """(doc_id, spans): bytes covered by strings of min_length bytes that also start in a document with a smaller doc_id.

    Texts are their UTF-8 bytes, read whole, null as empty; matches lie within one document; documents
    without repeats, without doc_id or shorter than min_length have no row, nor has an empty table any.
    Other columns are ignored. doc_id names a document: rows that repeat it do not repeat one another.
    """
    gram = min(GRAM, max(1, min_length // 2))
    shared = shared_text(docs, byte_units(gram), min_length, gram, True, most_passages)
    # the first document that has an anchor has nothing of it to lose
    roles = F.when(F.col("rep"), 1).otherwise(0) + F.when(F.col("first"), 0).otherwise(2)
    return streamed_spans(docs, shared, roles, None, _cut, _locate(min_length), min_length, per_shard, max(MOST_SEGMENT, 4 * min_length))


def remove_repeats(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal runs removed) and `kept`, the bytes that stay, of every row of docs.

    A null text has no bytes; a row without doc_id keeps all of its own; rows that repeat a doc_id are the
    same places and lose the same; texts are read whole; other columns are left out; an empty table gives no rows.
    """
    joined = docs.select(F.col("doc_id").cast("long"), "text").join(find_repeats(docs, min_length), "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, spans = batch.column(0), batch.column(2)
            for block in blocks(batch.column(1)):
                gone = coverage(spans, block.first, block.offsets)
                head = gone.copy()
                head[1:] &= ~gone[:-1]
                inner = block.offsets[:-1][np.diff(block.offsets) > 0]
                head[inner] = gone[inner]
                count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[block.offsets])
                kept = block.data[~gone].tobytes()
                stay = np.concatenate([[0], np.cumsum(~gone)])[block.offsets].tolist()
                bodies = [kept[a:b] for a, b in zip(stay, stay[1:])]
                yield pa.RecordBatch.from_arrays([ids.slice(block.first, block.rows), pa.array(np.diff(block.offsets)), pa.array(count(gone), pa.int64()), pa.array(count(head), pa.int64()), pa.array(bodies, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(rowmap.documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
