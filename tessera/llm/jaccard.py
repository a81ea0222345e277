"""N-gram Jaccard join by T-occurrence search.

Documents are sets of word shingles. Equal sets are one entry with its number of copies. Two sets that
reach the threshold share several of their rarest shingles (prefix filter; rarity is estimated from a
sketch of word counts of the whole corpus, and any order would be right). Every set lives in the
bucket of the most widely shared shingle of its prefix, which most of a group of near copies have in
common, and is sent as a query to the buckets with whose
sets it shares as many prefix shingles as any linked set would. In a bucket the DivideSkip search counts, for
each query, in how many of its inverted lists each set occurs: the short lists are merged with a heap,
and the sets that can still reach the required overlap are looked up in the long lists by binary search. A bucket
with many sets or queries is split into blocks of both.

A pair is met in one bucket only, so that links can be counted there; for the classes a bucket returns
one edge for each of its documents, and the components of all edges are found by joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heapreplace
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import rowmap
from tessera.llm.components import components
from tessera.llm.textblocks import SPACE, Words, blocks, gram_hashes, mix, word_hashes

SKETCH_BITS = 16
BLOCK = 1024
ROWS_PER_SHARD = 1000
#: The cost of a binary search step against that of a merge step, for the choice of the long lists.
PROBE_COST = 0.001


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text: its distinct shingle hashes in order, a position of each, and the hashes of its words."""
    for block in blocks(column):
        words = Words(block, SPACE)
        h = word_hashes(block, words, lower=True)
        grams = gram_hashes(h, k)
        for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
            if b - a >= k:
                found, at = np.unique(grams[a : b - k + 1], return_index=True)
            elif b > a:
                found, at = gram_hashes(h[a:b], b - a) ^ np.uint64(b - a), np.zeros(1, np.int64)
            else:
                found, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            yield found, at, h[a:b]


def describe(docs: DataFrame, k: int) -> DataFrame:
    """Rows of kind 0: (doc_id, k1, k2, n) of each text, k1 and k2 being hashes of its set; of kind 1: (word bucket, count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, shift = np.zeros(1 << SKETCH_BITS, np.int64), np.uint64(64 - SKETCH_BITS)
        names = ["kind", "a", "k1", "k2", "n"]
        for batch in batches:
            keys = []
            for found, _, words in shingle_sets(batch.column(1), k):
                sketch += np.bincount(words >> shift, minlength=len(sketch)) if len(words) > 1000 else 0
                if len(words) <= 1000:
                    np.add.at(sketch, words >> shift, 1)
                one = mix(found ^ np.uint64(0x5851F42D4C957F2D))
                keys.append((int(one.sum(dtype=np.uint64).view(np.int64)), int(mix(one).sum(dtype=np.uint64).view(np.int64)), len(found)))
            columns = [pa.array(np.zeros(len(keys)), pa.int32()), batch.column(0), *(pa.array([x[i] for x in keys], pa.int64()) for i in range(3))]
            yield pa.RecordBatch.from_arrays(columns, names)
        at = np.flatnonzero(sketch)
        empty = pa.array(np.zeros(len(at)), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(at)), pa.int32()), pa.array(at, pa.int64()), empty, empty, pa.array(sketch[at], pa.int64())], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "kind int, a long, k1 long, k2 long, n long")


def least_overlap(n: int, percent: int) -> int:
    """Of a set of n shingles, how many at least any linked set has."""
    return -(-percent * n // 100)


def prefix_share(n: int) -> int:
    """How many prefix shingles two linked sets of n shingles at least have in common; it grows with n."""
    return max(1, n // 20)


def _prefix_share_of_linked(n: F.Column, percent: int) -> F.Column:
    """What a set of n shingles shares at least with any linked one, which has percent % of n at least."""
    return F.greatest(F.lit(1), F.floor(F.ceil(n * percent / 100) / 20).cast("long"))


def prefixes(docs: DataFrame, k: int, percent: int, levels) -> DataFrame:
    """(token, doc_id, n): of every set the rarest shingles, of which any linked set has some among its own (see prefix_share)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, shift = levels.value, np.uint64(64 - SKETCH_BITS)
        for batch in batches:
            tokens, sizes, ids = [], [], batch.column(0).to_numpy(zero_copy_only=False)
            lengths = []
            for found, at, words in shingle_sets(batch.column(1), k):
                n = len(found)
                keep = n - least_overlap(n, percent) + prefix_share(n) if n else 0
                if n > 1:
                    own = np.concatenate([[0], np.cumsum(level[words >> shift])])
                    # in whole steps, so that an estimate and not its noise decides; the hash does among equals
                    rare = np.lexsort((found, (own[at + k] - own[at]) // 32))[:keep]
                    found = found[rare]
                tokens.append(found)
                lengths.append(len(found))
                sizes.append(n)
            lengths = np.array(lengths, np.int64)
            columns = [np.concatenate(tokens).view(np.int64) if tokens else [], np.repeat(ids, lengths), np.repeat(np.array(sizes, np.int64), lengths)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["token", "doc_id", "n"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "token long, doc_id long, n long")


def list_runs(begin: np.ndarray, entries: np.ndarray) -> tuple[list[int], list[int]]:
    """Runs of consecutive entries: where each list's begin (one more for the end), and of all runs in order the first entry and the one after the last."""
    new = np.ones(len(entries), bool)
    new[1:] = entries[1:] != entries[:-1] + 1
    new[begin[:-1]] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(entries)) - 1
    bounds = np.stack([entries[first], entries[last] + 1], 1).ravel() if len(first) else entries
    return (2 * np.searchsorted(first, begin)).tolist(), bounds.tolist()


def merge_short(lists: list[list[int]], need: int) -> tuple[np.ndarray, np.ndarray]:
    """(entries, in how many lists) of the entries that are in `need` of the ordered lists at least.

    A list is given by the bounds of its runs (see `list_runs`), so that where most sets have a token it
    is short. A heap holds the next bound of each list; between bounds the lists that are inside a run
    stay the same.
    """
    n, at = len(lists), [0] * len(lists)
    heap = [own[0] * n + i for i, own in enumerate(lists) if own]
    heapify(heap)
    starts, ends, counts, inside, since = [], [], [], 0, 0
    while heap:
        here = heap[0] // n
        if inside >= need:
            starts.append(since)
            ends.append(here)
            counts.append(inside)
        since, stop = here, (here + 1) * n
        while heap and heap[0] < stop:
            i = heap[0] % n
            inside += -1 if at[i] & 1 else 1
            at[i] += 1
            if at[i] < len(lists[i]):
                heapreplace(heap, lists[i][at[i]] * n + i)
            else:
                heappop(heap)
    sizes = np.array(ends, np.int64) - np.array(starts, np.int64)
    shift = np.repeat(np.array(starts, np.int64) - np.cumsum(sizes) + sizes, sizes)
    return shift + np.arange(len(shift)), np.repeat(np.array(counts, np.int64), sizes)


def divide_skip(lists: tuple[np.ndarray, np.ndarray, np.ndarray], query: np.ndarray, need: int, runs: tuple[list[int], list[int]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(entries, in how many of the query's lists) of the entries that are in `need` of them at least.

    lists: the tokens in order, where the list of each begins (one more entry for the end), and the
    lists' entries in order; runs: `list_runs` of them, if it is at hand.
    """
    tokens, begin, entries = lists
    at = np.searchsorted(tokens, query)
    at = at[tokens[np.minimum(at, len(tokens) - 1)] == query] if len(tokens) else at[:0]
    if len(at) < need:
        return at[:0], at[:0]
    sizes = begin[at + 1] - begin[at]
    n_long = min(int(need / (PROBE_COST * log2(max(2, int(sizes.max()))) + 1)), need - 1)
    order = np.argsort(sizes, kind="stable")
    short, long = at[order[: len(at) - n_long]], at[order[len(at) - n_long :]]
    at, bounds = list_runs(begin, entries) if runs is None else runs
    found, counts = merge_short([bounds[at[i] : at[i + 1]] for i in short.tolist()], need - n_long)
    for i, left in zip(long.tolist(), range(n_long - 1, -1, -1), strict=True):
        if not len(found):
            break
        one = entries[begin[i] : begin[i + 1]]
        counts += one[np.minimum(np.searchsorted(one, found), len(one) - 1)] == found
        kept = counts >= need - left
        found, counts = found[kept], counts[kept]
    return found, counts


def _views(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The sets of a binary column, without copies."""
    out: list[np.ndarray] = []
    for chunk in column.chunks:
        if not len(chunk):
            continue
        chunk = chunk.cast(pa.large_binary())
        at = np.frombuffer(chunk.buffers()[1], np.int64)[chunk.offset : chunk.offset + len(chunk) + 1].tolist()
        body = np.frombuffer(chunk.buffers()[2], np.uint8)
        out += [body[a:b].view(np.uint64) for a, b in zip(at, at[1:])]
    return out


def _search(percent: int):
    def shard(table: pa.Table) -> pa.Table:
        key, doc, copies, role = (table.column(c).to_numpy() for c in ("key", "doc_id", "copies", "role"))
        sets = _views(table.column("tokens"))
        out_doc, out_root, out_links = [], [], []
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order], prepend=key[order[:1]])) if len(order) else []
        for rows in np.split(order, cuts) if len(order) else []:
            members, queries = rows[role[rows] == 0], rows[role[rows] == 1]
            if not len(members) or not len(queries):
                continue
            flat = np.concatenate([sets[i] for i in members])
            owner = np.repeat(np.arange(len(members)), [len(sets[i]) for i in members])
            by = np.lexsort((owner, flat))
            tokens, begin = np.unique(flat[by], return_index=True)
            lists = (tokens, np.append(begin, len(flat)), owner[by])
            runs = list_runs(*lists[1:])
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while parent.setdefault(x, x) != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            member_docs, sizes, weight = doc[members], np.array([len(sets[i]) for i in members]), copies[members]
            for q in queries.tolist():
                n = len(sets[q])
                found, common = divide_skip(lists, sets[q], least_overlap(n, percent), runs)
                linked = found[(100 * common >= percent * (n + sizes[found] - common)) & (member_docs[found] != doc[q])]
                out_links.append((int(doc[q]), int(weight[linked].sum())))
                a = root(int(doc[q]))
                for r in member_docs[linked].tolist():
                    b = root(r)
                    if a != b:
                        a, b = min(a, b), max(a, b)
                        parent[b] = a
            for x in parent:
                if root(x) != x:
                    out_doc.append(x)
                    out_root.append(root(x))
        nodes = [x for x, _ in out_links] + out_doc
        return pa.table({
            "doc_id": pa.array(nodes, pa.int64()),
            "root": pa.array([None] * len(out_links) + out_root, pa.int64()),
            "links": pa.array([x for _, x in out_links] + [0] * len(out_doc), pa.int64()),
        })

    return shard


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row of docs.

    A set holds the distinct k-word shingles of the lower-cased (A-Z) words of a text, or its whole
    sequence if it has fewer words. Documents link if percent % at least of the union of their sets is
    common; component_id is the smallest doc_id reachable, n_links the number of other documents linked
    to. Sets are equal if a 128-bit hash of their shingles is. A text without words has an empty set and no links. Rows without doc_id have none either; rows
    that repeat a doc_id are the same document. Texts are read whole; an empty table gives no rows; other
    columns of docs are ignored.
    """
    spark = docs.sparkSession
    described = rowmap.written(describe(docs, k), "described")
    rows = described.where("kind = 0").select(F.col("a").alias("doc_id"), "k1", "k2", "n")
    counts = np.zeros(1 << SKETCH_BITS)
    for bucket, n in described.where("kind = 1").groupBy("a").agg(F.sum("n")).collect():
        counts[bucket] = n
    levels = spark.sparkContext.broadcast(np.rint(16 * np.log2(counts + 1)).astype(np.int64))  # whole numbers, so that sums are exact
    sets = rows.where("doc_id is not null and n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("copies"))
    sets = rowmap.written(sets, "sets")
    whole = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")
    reps = sets.select(F.col("rep").alias("doc_id"), "copies")

    # dealt out by token once: the counts read the same exchange as the join, since they ask for every column
    dealt = prefixes(whole.join(reps, "doc_id", "left_semi"), k, percent, levels).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "token")
    counted = dealt.groupBy("token").agg(F.count("*").alias("m"), F.max("doc_id").alias("d"), F.max("n").alias("s")).where("m > 1 and d is not null and s is not null")
    several = counted.select(F.col("token").alias("_token"), "m").hint("shuffle_hash")
    shared = rowmap.written(dealt.join(several, F.col("token") == F.col("_token")).drop("_token"), "prefixes")
    homes = shared.groupBy("doc_id", "n").agg(F.max(F.struct("m", "token")).alias("most"), F.count("*").alias("has"))
    homes = rowmap.written(homes.where(F.col("has") >= _prefix_share_of_linked(F.col("n"), percent)).select("doc_id", "n", F.col("most.token").alias("home")), "homes")
    housed = shared.drop("m").join(homes, ["doc_id", "n"])

    at = housed.groupBy("token", "home").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    fits = (100 * F.col("most") >= percent * F.col("n")) & (percent * F.col("least") <= 100 * F.col("n"))
    asks = housed.drop("home").join(at, "token").where(fits).groupBy("doc_id", "n", "home").agg(F.count("*").alias("has"))
    queries = rowmap.written(asks.where(F.col("has") >= _prefix_share_of_linked(F.col("n"), percent)).select("doc_id", "home").distinct(), "queries")
    # buckets that hold more than one document, or are asked by another
    members = homes.select("doc_id", "home").distinct()
    size = members.groupBy("home").agg(F.count("*").alias("members")).join(queries.groupBy("home").agg(F.count("*").alias("asked")), "home").where("asked > 1")
    size = rowmap.written(size.select("home", F.ceil(F.col("members") / BLOCK).cast("int").alias("mb"), F.ceil(F.col("asked") / BLOCK).cast("int").alias("qb")), "buckets")
    own_block = lambda blocks_of: F.pmod(F.xxhash64("doc_id"), F.col(blocks_of)).cast("int")
    every = lambda blocks_of: F.explode(F.sequence(F.lit(0), F.col(blocks_of) - 1))
    as_members = members.join(size, "home").select("doc_id", "home", own_block("mb").alias("x"), every("qb").alias("y"), F.lit(0).alias("role"))
    as_queries = queries.join(size, "home").select("doc_id", "home", every("mb").alias("x"), own_block("qb").alias("y"), F.lit(1).alias("role"))
    routes = rowmap.written(as_members.unionByName(as_queries).select("doc_id", F.xxhash64("home", "x", "y").alias("key"), "role"), "routes")
    shards = max(1, -(-routes.count() // ROWS_PER_SHARD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            lists = batch.column(names.index("routes")).to_pylist()
            ids, copies = batch.column(names.index("doc_id")).to_pylist(), batch.column(names.index("copies")).to_pylist()
            made, held = [], 0
            for i, (found, _, _) in enumerate(shingle_sets(batch.column(names.index("text")), k)):
                body = found.tobytes()
                for x in lists[i]:
                    made.append((x["key"], ids[i], copies[i], x["role"], body))
                    held += len(body)
                if held > 1 << 24:
                    yield _route_batch(made)
                    made, held = [], 0
            yield _route_batch(made)

    listed = routes.groupBy("doc_id").agg(F.collect_list(F.struct("key", "role")).alias("routes"))
    sent = whole.join(listed, "doc_id").join(reps, "doc_id").mapInArrow(run, "key long, doc_id long, copies long, role int, tokens binary")
    found = sent.groupBy(F.pmod("key", F.lit(shards)).alias("shard")).applyInArrow(_search(percent), "doc_id long, root long, links long")
    found = rowmap.written(found, "links")
    labels = components(found.where("root is not null").select(F.col("doc_id").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("doc_id").agg(F.sum("links").alias("links"))
    classes = sets.join(labels, sets.rep == labels.node, "left").join(links, sets.rep == links.doc_id, "left").select(
        "k1", "k2", "n", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    out = rows.join(classes, ["k1", "k2", "n"], "left")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"))


def _route_batch(rows: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["key", "doc_id", "copies", "role", "tokens"])


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component, that of the smallest doc_id; rows without doc_id stay.

    Rows are judged by their own text: where a doc_id repeats with several texts, each is a document. Of
    rows with the same doc_id and text one stays, the least by its other columns as JSON. Null and empty texts are like nothing else. All columns
    stay as they are, whatever their names; an empty table stays empty.
    """
    docs, back = rowmap.set_aside(docs)
    key = F.col("doc_id").cast("long")
    repeated = docs.where(key.isNotNull()).groupBy(key.alias("_id")).agg(F.count("*").alias("m")).where("m > 1").select("_id")
    repeated = rowmap.written(repeated, "repeated")
    if repeated.isEmpty():
        gone = near_duplicates(docs, k, percent).where("doc_id <> component_id").select("doc_id").distinct()
        return back(docs.join(gone, "doc_id", "left_anti"))
    # of rows with the same doc_id and text the least of the others' columns stays, which any order of the input gives
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    again = docs.join(repeated, key == F.col("_id"), "left_semi")
    again = again.groupBy("doc_id", "text").agg(F.min_by(F.struct(*rest), F.to_json(F.struct(*rest))).alias("_least")).select("doc_id", "text", "_least.*") if rest else again.dropDuplicates()
    # a number of its own for every row: rows are many fewer than the numbers of a long
    rows = docs.join(repeated, key == F.col("_id"), "left_anti").unionByName(again.select(*docs.columns))
    rows = rowmap.written(rows.withColumn("_row", F.when(key.isNotNull(), F.monotonically_increasing_id())), "again")
    found = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), k, percent).where("doc_id is not null").select(F.col("doc_id").alias("_row"), "component_id")
    judged = found.join(rows.select("_row", key.alias("_id")), "_row")
    kept = judged.groupBy("component_id").agg(F.min(F.struct("_id", "_row"))["_row"].alias("_row")).select("_row")
    gone = judged.select("_row").join(kept, "_row", "left_anti")
    return back(rows.join(gone, "_row", "left_anti"))


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(rowmap.documents(spark, sf_dir), k=3, percent=90)
