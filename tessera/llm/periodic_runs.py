"""Runs of repeated words, found with string synchronising sets at dyadic scales.

At scale t a synchronising set holds the positions i whose windows of t words, those that start at
i .. i + t, have their least hash at i or at i + t. Whether i belongs to it depends on the 2 t words from
i on alone, so equal contexts are chosen alike, wherever they are. Windows inside a run of period t / 4 or
less are left out of the choice: the set stays sparse there, and what it omits are small periods, which
the smaller scales have found. Everywhere else each t consecutive positions hold one that is chosen.

In a run of period q, t <= q < 2 t, and length 4 q or more, some chosen i lies so early that i + q, which
has the same context, is chosen too, and nothing between them has that context (else the run had a
smaller period). So the pairs of neighbours with equal contexts, at distances of t .. 2 t - 1, propose all
periods of that scale; each is extended in both directions as far as it holds. The scales go from t = 1
upwards, and the runs of the scales before give a scale its highly periodic regions.

All of this is local to a document: the job has no shuffle, and many documents are looked at in one
array, with a separator after each that equals nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import rowmap
from tessera.llm.textblocks import SPACE, Words, blocks, mix, sliding, word_hashes

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS = "runs array<struct<start:long,length:long,period:long>>"
_NONE = np.uint64((1 << 64) - 1)
_LEFT, _RIGHT, _APART = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0xA0761D6478BD642F)


@dataclass(frozen=True)
class RunSpec:
    """A run has `least` words at least, and its period `times` times at least; times is 4 or more."""

    least: int = 6
    times: int = 4


def _reach(codes: np.ndarray, at: int, q: int) -> tuple[int, int]:
    """The longest stretch [low, high) around `at` where codes[x] == codes[x + q]; empty if that fails at `at`."""
    low, high, step = at, at, 64
    while True:
        n = min(step, len(codes) - q - high)
        apart = np.flatnonzero(codes[high : high + n] != codes[high + q : high + q + n])
        high += int(apart[0]) if len(apart) else n
        if len(apart) or n < step:
            break
        step *= 4
    step = 64
    while high > at:
        n = min(step, low)
        apart = np.flatnonzero(codes[low - n : low] != codes[low - n + q : low + q])
        low -= n - 1 - int(apart[-1]) if len(apart) else n
        if len(apart) or n < step:
            break
        step *= 4
    return low, high


def _runs(codes: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all stretches with a smallest period q, 4 q long or longer, that neither neighbour extends.

    codes: the words of documents, each followed by a code that occurs once; ends, sizes: of each
    position, where its document ends (the place of that code) and how long it is.
    """
    found: list[tuple[int, int, int]] = []
    place = np.arange(len(codes))  # of what is left, where it was
    unlike = mix(place.astype(np.uint64) * _APART + np.uint64(1))
    window, t = mix(codes + _LEFT), 1  # hashes of the t words from each position on
    while True:
        long = sizes >= 4 * t
        if not long.any():
            return found
        if long.sum() < 0.8 * len(codes):  # shorter documents have no run of this scale or a larger one
            kept = np.cumsum(long) - 1
            codes, place, window, unlike, sizes, ends = codes[long], place[long], window[long], unlike[long], sizes[long], kept[ends[long]]
        n, key = len(codes), window.copy()
        spot = None
        for start, length, q in found:
            if 4 * q <= t <= length:
                spot = np.searchsorted(place, start)
                if spot < n and place[spot] == start:
                    key[spot : spot + length - t + 1] = _NONE
        least = sliding(np.minimum, key, t + 1)
        chosen = np.flatnonzero(((key[: len(least)] == least) | (key[t:][: len(least)] == least)) & (least != _NONE))
        context = unlike.copy()
        context[: n - t] = mix(window[: n - t] * _LEFT + window[t:] * _RIGHT)
        chosen = chosen[chosen + 2 * t <= ends[chosen]]
        order = chosen[np.argsort(context[chosen], kind="stable")]
        a, b = order[:-1], order[1:]
        near = (context[a] == context[b]) & (ends[a] == ends[b]) & (b - a >= t) & (b - a < 2 * t)
        a, q = a[near], (b - a)[near]
        by = np.lexsort((a, q))
        past = (0, 0)  # the last period, and where its stretch ends
        for at, period in zip(a[by].tolist(), q[by].tolist(), strict=True):
            if past[0] == period and at < past[1]:
                continue
            low, high = _reach(codes, at, period)
            past = (period, high)
            if high - low >= 3 * period:
                found.append((int(place[low]), high - low + period, period))
        window, t = context, 2 * t


def _exact_codes(words: list[bytes]) -> np.ndarray:
    numbers: dict[bytes, int] = {}
    return np.array([numbers.setdefault(w, len(numbers)) for w in words], np.uint64)


def _lay_out(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """codes, ends and sizes as `_runs` wants them, and where each document starts there."""
    counts, rows = np.diff(bounds), np.arange(len(bounds) - 1)
    laid = mix(np.arange(len(codes) + len(rows), dtype=np.uint64) * _APART + _RIGHT)
    laid[np.arange(len(codes)) + np.repeat(rows, counts)] = codes
    stops = bounds[1:] + rows
    return laid, np.repeat(stops, counts + 1), np.repeat(counts, counts + 1), bounds[:-1] + rows


def block_runs(block, words: Words, spec: RunSpec = RunSpec()) -> list[list[tuple[int, int, int]]]:
    """Of each text of a block its runs (start, length, period) in words, by start and then period."""
    out: list[list] = [[] for _ in range(block.rows)]
    codes, ends, sizes, first = _lay_out(word_hashes(block, words), words.bounds)
    for start, length, q in _runs(codes, ends, sizes):
        row = int(np.searchsorted(first, start, "right")) - 1
        out[row].append((start - int(first[row]), length, q))
    for row, runs in enumerate(out):
        if not runs:
            continue
        own = block.text(row).split()
        if any(own[s : s + n - q] != own[s + q : s + n] for s, n, q in runs):  # two words with one hash
            own = _exact_codes(own)
            runs = _runs(*_lay_out(own, np.array([0, len(own)]))[:3])
        out[row] = sorted((r for r in runs if r[1] >= max(spec.least, spec.times * r[2])), key=lambda r: (r[0], r[2]))
    return out


def _listed(rows: list[list[tuple[int, int, int]]]) -> pa.Array:
    flat = [r for runs in rows for r in runs]
    fields = [pa.array([r[i] for r in flat], pa.int64()) for i in range(3)]
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, rows)]).astype(np.int32), pa.StructArray.from_arrays(fields, fields=list(RUN)))


def find_runs(docs: DataFrame, spec: RunSpec = RunSpec()) -> DataFrame:
    """docs with `runs`: start, length and smallest period (in words) of each maximal repetition, by start and then period.

    Words are what [^\\x20\\x09-\\x0D]+ matches. A null text has none, nor has an empty one; texts are read
    whole, whatever their length; repeated rows get the same runs each; an empty table stays empty; a
    column of docs named runs, in any case, is replaced. Two runs never have the same place and length.
    """

    def compute(texts: pa.Array) -> list[pa.Array]:
        return [_listed([runs for block in blocks(texts) for runs in block_runs(block, Words(block, SPACE), spec)])]

    return rowmap.with_columns_from_text(docs, RUNS, compute)


def joined_words(block, words: Words, kept: np.ndarray) -> pa.Array:
    """Of each text of a block the words that the mask keeps, joined by a space."""
    at = np.flatnonzero(kept)
    sizes = words.ends[at] - words.starts[at] + 1
    stops = np.cumsum(sizes)
    total = int(stops[-1]) if len(stops) else 0
    body = np.append(block.data, np.uint8(0x20))[np.arange(total) + np.repeat(words.starts[at] - (stops - sizes), sizes)]
    body[stops - 1] = 0x20
    limits = np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum(kept)])[words.bounds]]
    return pa.array([body[a : max(a, b - 1)].tobytes().decode() for a, b in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True)], pa.string())


def collapse(docs: DataFrame, spec: RunSpec = RunSpec()) -> DataFrame:
    """docs with `runs` as of `find_runs` and `collapsed`: the words that no run has beyond its first period, joined by a space.

    A null or empty text collapses to the empty one. All else as `find_runs` says, for both columns.
    """

    def compute(texts: pa.Array) -> list[pa.Array]:
        rows, bodies = [], [pa.array([], pa.string())]
        for block in blocks(texts):
            words = Words(block, SPACE)
            found = block_runs(block, words, spec)
            kept = np.ones(len(words.starts), bool)
            for row, runs in enumerate(found):
                low = int(words.bounds[row])
                for start, length, q in runs:
                    kept[low + start + q : low + start + length] = False
            rows += found
            bodies.append(joined_words(block, words, kept))
        return [_listed(rows), pa.concat_arrays(bodies)]

    return rowmap.with_columns_from_text(docs, f"{RUNS}, collapsed string", compute)


def stretched(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) where a tenth of the texts repeats a passage to its end, as the query wants them.

    With h the CRC-32 of the decimal doc_id and n words: if h % 10 is 0 and n is not, word i >= a becomes
    word a + (i - a) % p. A null doc_id has no h, and its text stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = 1 if doc is None else zlib.crc32(str(doc).encode())
                words = text.as_py().encode().split() if h % 10 == 0 and text.is_valid else []
                if words:
                    n, g = len(words), h // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    words[a:] = (words[a : a + p] * (-(-(n - a) // p)))[: n - a]
                texts.append(b" ".join(words).decode() if words else text.as_py())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, text string")


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = collapse(stretched(rowmap.documents(spark, sf_dir)))
    best = F.array_max(F.expr("transform(runs, x -> struct(x.length as length, -x.start as start, -x.period as period))"))
    rows = F.expr(r"concat_ws('', transform(runs, x -> concat(x.start, ',', x.length, ',', x.period, '\n')))")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "runs", "collapsed", best.alias("best")).select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(rows, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
