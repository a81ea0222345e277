"""Training-order materialisation: a keyed permutation gives every token sequence a global slot.

Every input partition's texts, each closed by the end id, are one stream of ids, cut into sequences of
a fixed length; the last is padded. The sequences are written to the shared folder, many to a row, and
their numbers in each partition give every sequence an index in 0 .. N - 1. A Feistel network over the
next power of four, with cycle-walking, permutes these indices: the slots are dense, and the order
depends on the key alone, not on a sort. Sequences are dealt to range partitions of slots, a shard each,
sorted there and written as records of one size: slot s is record s % per_shard of shard s // per_shard,
so that a reader can start anywhere and go on sequentially.

The sequences stay in the folder, under a checksum of the texts that doesn't hang on how they are read: a
job that goes on there, with other settings or on another cluster, takes the sequences as they are and so
the same order. A manifest names the specification, that checksum, and the number and a checksum of the
sequences: a folder of another order is refused. A shard is written under another name and then renamed, with an
index beside it that has a checksum for each record. Shards that agree with their index are kept and
their sequences not shuffled again; damaged or missing ones are written anew.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import rowmap, vocab
from tessera.llm.textblocks import mix

SCHEMA = "slot long, shard long, byte_offset long, n_tokens long, doc_ids array<long>, ids_crc32 long"


@dataclass(frozen=True)
class OrderSpec:
    length: int = 2048
    per_shard: int = 4096
    key: int = 20_240_117
    rounds: int = 6
    end_id: int = 1
    pad_id: int = 0
    vocabulary: str = vocab.DEFAULT
    id_type: str = "<u2"  # of the ids in a record; <u4 for larger vocabularies

    @property
    def stride(self) -> int:
        return self.length * np.dtype(self.id_type).itemsize


def permute(index: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """Slots of the indices (each below n), a bijection of 0 .. n - 1 for every key."""
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    low = (np.uint64(1) << half) - np.uint64(1)
    keys = np.random.default_rng(key).integers(1, 1 << 63, rounds, dtype=np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> half, x & low
        for k in keys:
            a, b = b, a ^ (mix(b + k) & low)
        return (a << half) | b

    out = once(index.astype(np.uint64))
    while len(at := np.flatnonzero(out >= np.uint64(n))):  # walk the cycle until it is inside again
        out[at] = once(out[at])
    return out.astype(np.int64)


def _streams(batches: Iterator[pa.RecordBatch], spec: OrderSpec) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Of some documents after the other: their doc_ids, all their ids in a row, and where each document's begin."""
    end, most = np.array([spec.end_id], np.uint32), np.iinfo(spec.id_type).max
    for batch in batches:
        for low in range(0, batch.num_rows, 64):
            found = [x for ids in vocab.column_ids(batch.column(1).slice(low, 64), spec.vocabulary) for x in (ids, end)]
            sizes = np.array([len(x) for x in found], np.int64).reshape(-1, 2).sum(1)
            flat = np.concatenate(found)
            if int(flat.max()) > most:
                raise ValueError(f"id {int(flat.max())} does not fit {spec.id_type}")
            yield batch.column(0).slice(low, 64).to_pylist(), flat, np.cumsum(sizes) - sizes


#: Sequences in a row of `sequences`.
ROW = 64
ROWS = "part long, first long, sizes array<long>, docs array<array<long>>, crc long, body binary"


def sequences(docs: DataFrame, path: str, spec: OrderSpec = OrderSpec()) -> DataFrame:
    """The sequences of docs (doc_id, text), written to the folder `path` unless it has them: up to ROW of a partition in a row.

    first: the number of the row's first sequence in the partition; sizes, docs: of each its ids without
    padding and its documents; body: the ids, compressed. A null text is the end id alone; a document
    without doc_id keeps its ids and is missing from docs; repeated rows are in the order each; other
    columns are ignored; a text of any length is cut; an empty table has no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack, length = zstandard.ZstdCompressor(level=9), spec.length
        part, index = TaskContext.get().partitionId(), 0
        ids, first, owner = np.zeros(0, np.uint32), np.zeros(0, np.int64), []  # what is left, and the documents in it

        def cut(n: int) -> pa.RecordBatch:
            nonlocal index, ids, first, owner
            own, end = ids[: n * length], n * length
            low = np.maximum(np.searchsorted(first, np.arange(n) * length, "right") - 1, 0)
            high = np.searchsorted(first, np.arange(1, n + 1) * length)
            docs_of = [list(dict.fromkeys(d for d in owner[low[i] : high[i]] if d is not None)) for i in range(n)]
            sizes = np.minimum(len(own) - np.arange(n) * length, length).tolist()
            row = (part, index, sizes, docs_of, zlib.crc32(own), pack.compress(own.astype(spec.id_type).tobytes()))
            keep = int(np.searchsorted(first, end, "right")) - 1 if len(ids) > end else len(first)
            index, ids, first, owner = index + n, ids[end:], np.maximum(first[keep:] - end, 0), owner[keep:]
            long = pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int64(), long, pa.list_(long), pa.int64(), pa.binary()), strict=True)], ["part", "first", "sizes", "docs", "crc", "body"])

        for docs_, flat, at in _streams(batches, spec):
            first, owner, ids = np.concatenate([first, len(ids) + at]), owner + docs_, np.concatenate([ids, flat])
            while len(ids) >= ROW * length:
                yield cut(ROW)
        if len(ids):
            yield cut(-(-len(ids) // length))

    return rowmap.kept(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ROWS), path)


def fingerprint(docs: DataFrame, spec: OrderSpec) -> str:
    """A checksum of the rows (doc_id, text), in any order, and of what makes sequences of them."""
    low, high = (F.xxhash64("doc_id", "text", F.lit(seed)).cast("decimal(38,0)") for seed in (1, 2))
    rows = docs.select(F.col("doc_id").cast("long"), "text").agg(F.count("*"), F.sum(low), F.sum(high)).first()
    return hashlib.sha256(repr((tuple(rows), spec.length, spec.end_id, spec.vocabulary, spec.id_type)).encode()).hexdigest()


def assign_slots(rows: DataFrame, starts: dict[int, int], total: int, spec: OrderSpec, done: np.ndarray) -> DataFrame:
    """(slot, n_tokens, doc_ids, body) of the sequences in rows of `sequences` whose shards are not in `done`, a sorted array.

    starts: how many sequences the partitions before each have; body: the record, compressed.
    """
    shared = rows.sparkSession.sparkContext.broadcast((starts, done))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack, unpack = zstandard.ZstdCompressor(level=5), zstandard.ZstdDecompressor()
        starts, done = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["sizes"])
                ids = np.frombuffer(unpack.decompress(row["body"]), spec.id_type)
                records = np.full(n * spec.length, spec.pad_id, spec.id_type)
                records[: len(ids)] = ids
                index = starts[row["part"]] + row["first"]
                slots = permute(np.arange(index, index + n), total, spec.key, spec.rounds)
                own = np.flatnonzero(~np.isin(slots // spec.per_shard, done)).tolist()
                bodies = [pack.compress(records[i * spec.length : (i + 1) * spec.length].tobytes()) for i in own]
                yield pa.RecordBatch.from_arrays([pa.array(slots[own]), pa.array([row["sizes"][i] for i in own], pa.int64()), pa.array([row["docs"][i] for i in own], pa.list_(pa.int64())), pa.array(bodies, pa.binary())], ["slot", "n_tokens", "doc_ids", "body"])

    return rows.select("part", "first", "sizes", "docs", "body").mapInArrow(run, "slot long, n_tokens long, doc_ids array<long>, body binary")


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def index_name(shard: int) -> str:
    return f"shard-{shard:08d}.arrow"


def _put(to, name: str, body: bytes) -> None:
    """Writes a file that is there whole or not at all."""
    part = posixpath.join(posixpath.dirname(name), f".{posixpath.basename(name)}.{uuid.uuid4().hex}")
    with to.open_output_stream(part) as sink:
        sink.write(body)
    to.move(part, name)


def _index(to, folder: str, shard: int, spec: OrderSpec) -> pa.Table | None:
    """The index of a shard, if both are there and every record has its checksum."""
    name, index = (posixpath.join(folder, f(shard)) for f in (shard_name, index_name))
    if any(x.type.name != "File" for x in to.get_file_info([name, index])):
        return None
    try:
        with to.open_input_file(index) as f:
            rows = pa.ipc.open_file(f).read_all()
        with to.open_input_stream(name) as f:
            if any(zlib.crc32(f.read(spec.stride)) != crc for crc in rows.column("ids_crc32").to_pylist()) or f.read(1):
                return None
    except (OSError, pa.ArrowInvalid):
        return None
    return rows


def _kept(spark, path: str, total: int, spec: OrderSpec) -> np.ndarray:
    """The shards that are there and right, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, folder = rowmap.folder(path)
        for batch in batches:
            good = [s for s in batch.column(0).to_pylist() if (rows := _index(to, folder, s, spec)) is not None and len(rows) == min(spec.per_shard, total - s * spec.per_shard)]
            yield pa.RecordBatch.from_arrays([pa.array(good, pa.int64())], ["shard"])

    shards = spark.range(0, -(-total // spec.per_shard)).mapInArrow(run, "shard long")
    return np.array(sorted(r[0] for r in shards.collect()), np.int64)


def write_shards(docs: DataFrame, path: str, spec: OrderSpec = OrderSpec()) -> DataFrame:
    """Writes the shards to the folder `path` as the result is computed: (slot, shard, byte_offset, n_tokens, doc_ids, ids_crc32).

    path: a URI that pyarrow and Spark can write to, or a local path, shared by the executors. A folder that
    holds another order (another specification or other texts) raises ValueError. For rows of docs see
    `sequences`; an empty table gives no rows and no shards.
    """
    spark = docs.sparkSession
    to, folder = rowmap.folder(path)
    to.create_dir(folder, recursive=True)
    manifest = posixpath.join(folder, "manifest.json")
    held = None
    if to.get_file_info(manifest).type.name == "File":
        with to.open_input_stream(manifest) as f:
            held = f.read()
    mark = fingerprint(docs, spec)
    if held is not None and json.loads(held)["input"] != mark:
        raise ValueError(f"{path} holds another training order")
    rows = sequences(docs, posixpath.join(path, f"sequences-{mark[:32]}"), spec)
    # a row for each partition
    parts = sorted(tuple(r) for r in rows.groupBy("part").agg(F.sum(F.size("sizes")).alias("n"), F.bit_xor(F.xxhash64("first", "crc")).alias("crc")).collect())
    starts, total = {}, 0
    for part, n, _ in parts:
        starts[part] = total
        total += n
    said = json.dumps({"spec": asdict(spec), "input": mark, "sequences": total, "order": hashlib.sha256(repr(parts).encode()).hexdigest()}, sort_keys=True).encode()
    done = np.zeros(0, np.int64)
    if held is not None:
        if held != said:
            raise ValueError(f"{path} holds another training order")
        done = _kept(spark, path, total, spec)
    else:
        _put(to, manifest, said)
    shards = max(1, -(-total // spec.per_shard))

    def old(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, folder = rowmap.folder(path)
        for batch in batches:
            for s in batch.column(0).to_pylist():
                rows = _index(to, folder, s, spec)
                if rows is None:
                    raise RuntimeError(f"shard {s} was there and is gone")
                yield from rows.to_batches()

    kept = spark.createDataFrame([(int(s),) for s in done], "shard long").mapInArrow(old, SCHEMA)
    if total and len(done) == shards:
        return kept
    rows = assign_slots(rows, starts, total, spec, done)
    shard = F.floor(F.col("slot") / spec.per_shard).cast("long")
    dealt = rows.withColumn("shard", shard).repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("slot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        to, folder = rowmap.folder(path)
        shard = part = sink = None
        made = []
        for batch in batches:
            slots, shard_of = batch.column(0).to_numpy(), batch.column(4)
            crcs = []
            for body in batch.column(3).to_pylist():
                if sink is None:
                    shard = shard_of[0].as_py()
                    part = posixpath.join(folder, f".{shard_name(shard)}.{uuid.uuid4().hex}")
                    sink = to.open_output_stream(part)
                record = unpack.decompress(body)
                crcs.append(zlib.crc32(record))
                sink.write(record)
            made.append(pa.RecordBatch.from_arrays([batch.column(0), shard_of, pa.array(slots % spec.per_shard * spec.stride), batch.column(1), batch.column(2), pa.array(crcs, pa.int64())], ["slot", "shard", "byte_offset", "n_tokens", "doc_ids", "ids_crc32"]))
            yield made[-1]
        if sink is not None:
            sink.close()
            to.move(part, posixpath.join(folder, shard_name(shard)))
            index = pa.BufferOutputStream()
            with pa.ipc.new_file(index, made[0].schema) as f:
                for x in made:
                    f.write_batch(x)
            _put(to, posixpath.join(folder, index_name(shard)), index.getvalue())

    new = dealt.select("slot", "n_tokens", "doc_ids", "body", "shard").mapInArrow(run, SCHEMA)
    return kept.unionByName(new) if len(done) else new


def read_slots(path: str, first: int, count: int, spec: OrderSpec = OrderSpec()) -> np.ndarray:
    """The ids of `count` consecutive slots from `first` on, one row each; fewer at the end of the order."""
    source, folder = rowmap.folder(path)
    out = []
    while count > 0:
        name = posixpath.join(folder, shard_name(first // spec.per_shard))
        if source.get_file_info(name).type.name != "File":
            break
        with source.open_input_file(name) as f:
            at = first % spec.per_shard
            n = min(count, spec.per_shard - at, f.size() // spec.stride - at)
            if n <= 0:
                break
            out.append(np.frombuffer(f.read_at(n * spec.stride, at * spec.stride), spec.id_type).reshape(n, spec.length))
        first, count = first + n, count - n
    return np.concatenate(out) if out else np.zeros((0, spec.length), spec.id_type)


def op9_training_order(spark, sf_dir: str) -> DataFrame:
    return write_shards(rowmap.documents(spark, sf_dir), rowmap.scratch(spark, "shards"))
