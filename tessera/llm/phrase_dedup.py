"""Removal of recurring passages by sharded Aho-Corasick automata over words.

Passages that may recur (see `anchors`) are dealt out to shards. In a shard the windows of `window`
words that occur at least twice are confirmed on one representative of each distinct passage, and
consecutive ones that always occur together are joined to phrases, with the place of their first
occurrence. pyahocorasick compiles a shard's phrases, as sequences of word numbers, to an automaton, and
all text of all documents that may hold one of them is streamed through it: what the automaton finds,
but for a phrase's first place, is removed. A shard that is asked by very many documents is compiled in
several tasks, each of which streams a part of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import rowmap
from tessera.llm.anchors import MOST_PASSAGES, Segments, coverage, passage_texts, shared_text, streamed_spans, word_units
from tessera.llm.decontaminate import merge
from tessera.llm.textblocks import SPACE, Block, Words, blocks

WINDOW = 20
GRAM = 8
PER_SHARD = 10_000


def _cut(block: Block):
    words, data = Words(block, SPACE), block.data.tobytes()
    starts, ends, bounds = words.starts.tolist(), words.ends.tolist(), words.bounds.tolist()

    def body(row: int, s: int, e: int) -> bytes:
        s, e = bounds[row] + s, min(bounds[row] + e, bounds[row + 1])
        return b" ".join(data[starts[s] : ends[e - 1]].split()) if s < e else b""

    return body


def _confirm(window: int):
    def run(shard: pa.Table) -> pa.Table:
        segments = Segments(shard, window)
        _, bounds, passage = word_units(1)(segments.block)
        segments.keep(passage, bounds)
        item, rel = segments.each_window()
        texts = [segments.block.text(i).split() for i in range(segments.block.rows)]
        found = phrases(texts, segments.text[item], rel, segments.doc, segments.start, segments.n[item], window)
        columns = [[int(segments.key[f[0]]) for f in found], *([f[i] for f in found] for i in (3, 4)), [b" ".join(texts[t][r : r + size - 1 + window]) for t, r, size, _, _ in found]]
        return pa.table({k: pa.array(c, pa.binary() if k == "body" else pa.int64()) for k, c in zip(("key", "doc_id", "start", "body"), columns, strict=True)})

    return run


def phrases(texts: list[list[bytes]], text: np.ndarray, rel: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray, window: int) -> list[tuple[int, int, int, int, int]]:
    """The recurring phrases among windows (text, rel), n of which are alike in the corpus: text, rel, windows, and the first place.

    doc and start: the place of each text. Windows are in order of their texts.
    """
    numbers: dict[bytes, int] = {}
    ids = [tuple([numbers.setdefault(w, len(numbers)) for w in words]) for words in texts]
    classes: dict[tuple, int] = {}
    flat = np.array([classes.setdefault(ids[t][r : r + window], len(classes)) for t, r in zip(text.tolist(), rel.tolist(), strict=True)], np.int64)
    if not classes:
        return []
    count = np.bincount(flat, weights=n).astype(np.int64)
    order = np.lexsort((start[text] + rel, doc[text], flat))
    head = order[np.flatnonzero(np.diff(flat[order], prepend=-1))]
    first_doc, first_start = doc[text[head]], start[text[head]] + rel[head]  # by class, in order
    # class a is always followed by class b, and b preceded by a: they are in one phrase
    follows = np.flatnonzero((text[1:] == text[:-1]) & (rel[1:] == rel[:-1] + 1) & (n[1:] == n[:-1]))
    pairs, inverse = np.unique(flat[follows] * np.int64(len(classes)) + flat[follows + 1], return_inverse=True)
    together = np.bincount(inverse, weights=n[follows], minlength=len(pairs)).astype(np.int64)
    a, b = pairs // len(classes), pairs % len(classes)
    bound = (together == count[a]) & (together == count[b]) & (a != b)
    joined = np.zeros(len(flat), bool)  # this window belongs to the phrase of the one before it
    joined[follows + 1] = bound[inverse]
    heads = np.flatnonzero((count[flat] > 1) & ~joined)
    stops = np.append(np.flatnonzero(~joined), len(flat))
    sizes = stops[np.searchsorted(stops, heads, "right")] - heads
    known: set[int] = set()
    out = []
    for t, r, size, c in zip(text[heads].tolist(), rel[heads].tolist(), sizes.tolist(), flat[heads].tolist(), strict=True):
        if c not in known:
            known.add(c)
            out.append((t, r, size, int(first_doc[c]), int(first_start[c])))
    return out


def _locate(window: int):
    def run(shard: pa.Table) -> pa.Table:
        role, body, doc, start = (shard.column(c).to_pylist() for c in ("role", "body", "doc_id", "start"))
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        numbers: dict[bytes, int] = {}
        for r, text, d, s in zip(role, body, doc, start, strict=True):
            if r == 0:
                words = text.split(b" ")
                automaton.add_word(tuple([numbers.setdefault(w, len(numbers) + 1) for w in words]), (len(words), d, s))
        out: list[tuple[int, int, int]] = []
        if numbers:
            automaton.make_automaton()
            for r, text, d, s in zip(role, body, doc, start, strict=True):
                if r == 1:
                    spans = []
                    for last, (n, fd, fs) in automaton.iter(tuple([numbers.get(w, 0) for w in text.split(b" ")])):
                        end = s + last + 1
                        if d > fd or (d == fd and end - n > fs):
                            spans.append((end - n, end))
                    out += [(d, a, b) for a, b in merge(spans)]
        return pa.table({k: pa.array([x[j] for x in out], pa.int64()) for j, k in enumerate(("doc_id", "s", "e"))})

    return run


def find_recurring(docs: DataFrame, window: int = WINDOW, per_shard: int = PER_SHARD, most_passages: int = MOST_PASSAGES) -> DataFrame:
    """(doc_id, spans): words covered by a window whose words also start earlier.

    Words are what the pattern [^\\x20\\x09-\\x0D]+ matches; earlier is a smaller doc_id, or the same one
    and an earlier start. A null text has no words; documents without repeats or without doc_id have
    no row, nor has an empty table any. Texts are read whole, and other columns ignored. doc_id names a
    document: rows that repeat it count as the same places.
    """
    gram = min(GRAM, max(1, window // 2))
    shared = shared_text(docs, word_units(gram), window, gram, False, most_passages)

    def confirmed(shard: F.Column) -> DataFrame:
        texts = passage_texts(docs, shared.where("rep"), _cut, window)
        return rowmap.written(texts.groupBy(shard).applyInArrow(_confirm(window), "key long, doc_id long, start long, body binary"), "phrases")

    return streamed_spans(docs, shared, F.lit(2), confirmed, _cut, _locate(window), window, per_shard, None)


def remove_recurring(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and `kept`, the words that stay joined by one space, of every row of docs.

    The automata read all text that windows shared by several places cover; no other text can hold a
    recurring passage. A null text has no words; a row without doc_id keeps all of its own; rows that
    repeat a doc_id lose the same; texts are read whole; other columns are left out; an empty table gives no rows.
    """
    joined = docs.select(F.col("doc_id").cast("long"), "text").join(find_recurring(docs, window), "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, spans = batch.column(0), batch.column(2)
            for block in blocks(batch.column(1)):
                words = Words(block, SPACE)
                gone = coverage(spans, block.first, words.bounds)
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.bounds])
                bodies = []
                for i in range(block.rows):
                    all_words = block.text(i).split()
                    if removed[i]:
                        mask = gone[words.bounds[i] : words.bounds[i + 1]].tolist()
                        all_words = [w for w, g in zip(all_words, mask, strict=True) if not g]
                    bodies.append(b" ".join(all_words))
                yield pa.RecordBatch.from_arrays([ids.slice(block.first, block.rows), pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(bodies, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")


def op6_phrase_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_recurring(rowmap.documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
