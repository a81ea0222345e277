"""Bounded-space online packing of token sequences.

Every input partition keeps a fixed number of open windows. A document's whole windows are emitted as
they are; what is left of it goes to the open window that it fills best. When none has room and none
may be opened, the fullest is emitted: if its gap is worth it, the document is cut so as to fill it.
Windows that are still open at the end of the partition are merged, again with cuts, into full
windows; the last, shorter one is cut at powers of two, which need no padding.

The job has no shuffle and its memory is that of the open windows. A lost task gives the same pieces
again, since a partition's rows and their order come from the scan.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import rowmap, vocab

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


@dataclass(frozen=True)
class PackSpec:
    """slack: a gap of so many tokens at most is padded rather than filled by cutting a document."""

    window: int = 2048
    open_windows: int = 64
    slack: int = 8
    end_id: int = 1
    vocabulary: str = vocab.DEFAULT


class Packer:
    """The windows of one partition. `emit` collects (doc_id, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, spec: PackSpec, first_sequence: int = 0):
        self.spec, self.sequence, self.out = spec, first_sequence, []
        self.open: list[tuple[int, int]] = []  # (gap, number of the window), in order of the gap
        self.held: dict[int, list] = {}
        self.number = 0

    def _emit(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, ids, total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def add(self, doc: int, ids: np.ndarray) -> None:
        window, total, start = self.spec.window, len(ids), 0
        while total - start >= window:
            self._emit([(doc, start, ids[start : start + window], total)])
            start += window
        while start < total:
            rest = total - start
            at = bisect_left(self.open, (rest, -1))
            if at < len(self.open):
                gap, number = self.open.pop(at)
            elif len(self.open) < self.spec.open_windows:
                gap, number = window, self.number
                self.number += 1
                self.held[number] = []
            else:
                gap, number = self.open.pop(0)
                if gap <= self.spec.slack:
                    self._emit(self.held.pop(number))
                    continue
            n = min(gap, rest)
            self.held[number].append((doc, start, ids[start : start + n], total))
            start += n
            if n == gap:
                self._emit(self.held.pop(number))
            else:
                insort(self.open, (gap - n, number))

    def close(self) -> None:
        """Merges the windows that are still open, the fullest first."""
        left = [piece for _, number in self.open for piece in self.held[number]]
        rest, window = sum(len(p[2]) for p in left), self.spec.window
        self.open, self.held = [], {}
        while rest:
            want = window if rest >= window else 1 << (rest.bit_length() - 1)
            rest -= want
            pieces = []
            while want:
                doc, start, ids, total = left.pop(0)
                if len(ids) > want:
                    left.insert(0, (doc, start + want, ids[want:], total))
                    ids = ids[:want]
                pieces.append((doc, start, ids, total))
                want -= len(ids)
            self._emit(pieces)

    def drain(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        long = lambda i: pa.array([r[i] for r in rows], pa.int64())
        columns = [long(0), long(1), pa.array([len(r[2]) for r in rows], pa.int64()), long(3), long(4), long(5)]
        columns.append(pa.array([r[2].astype("<u4").tobytes() for r in rows], pa.binary()))
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])


def pack(docs: DataFrame, spec: PackSpec = PackSpec()) -> DataFrame:
    """One row per piece, with its ids as little-endian unsigned 32-bit integers.

    docs: doc_id, text, and other columns, which are ignored. A null or empty text is the end id alone;
    a null doc_id is kept as null; repeated rows are packed each. An empty table gives no rows. A text
    of any length is cut into windows. Of windows with equal gaps the one opened first is filled, and the
    first of the fullest is emitted. Sequence ids are unique, not dense.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(spec, TaskContext.get().partitionId() << 36)
        end = np.array([spec.end_id], np.uint32)
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), vocab.column_ids(batch.column(1), spec.vocabulary), strict=True):
                packer.add(doc, np.concatenate([ids, end]))
                if len(packer.out) >= 2000:
                    yield packer.drain()
        packer.close()
        if packer.out:
            yield packer.drain()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and the sequence's ids, joined in order, out of rows of `pack`; those of documents without doc_id count too, no rows give none."""
    rows = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return rows.select("sequence_id", "n_tokens", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return pack(rowmap.documents(spark, sf_dir)).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
