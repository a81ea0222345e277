"""Binary point and vector files as Spark data sources: `points` (four layouts), `fvecs`, `ivecs`, `rawfvecs` and `spfvecs`.

    binary.register(spark)
    spark.read.format("points").option("layout", "siftgeo").load("/data/*.siftgeo")

A file is split at record borders where records have one size (vwgeo, vwsgeo, and the others once the
first record tells the dimension), so that large files are read by many tasks. Paths are URIs that
pyarrow can open, or local paths, and may end in a pattern. Counting rows needs only sizes. The option
`first` reads no more than so many records of each file. The option `keep` names comparisons of stored
numbers with constants ("cornerness > 100 and x <= 320"), which are made on the records before rows are
made of them. (Filters of a plan are left to Spark: where a frame is used with several filters, Spark 4.1
goes on with those that it has pushed down to a Python source first.)
"""

from __future__ import annotations

import fnmatch
import posixpath
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

GEOMETRY = ("x", "y", "scale", "angle", "mi11", "mi12", "mi21", "mi22", "cornerness")
#: Fixed formats: fields before the descriptor, in order.
LAYOUTS = {
    "siftgeo": [(g, "<f4") for g in GEOMETRY],
    "vwgeo": [("vw", "<i4")] + [(g, "<f4") for g in GEOMETRY],
    "vwsgeo": [("vw", "<i4")] + [(g, "<f4") for g in GEOMETRY] + [("binsign", "<i8")],
    "siftbin": [("unused1", "<i4"), ("unused2", "<i4"), ("x", "<f4"), ("y", "<f4"), ("scale", "<f4"), ("angle", "<f4")],
}
WITH_DESCRIPTOR = ("siftgeo", "siftbin")
SPLIT_BYTES = 64 << 20


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def files(path: str) -> list[str]:
    from pyarrow import fs

    source, inner = _open(path)
    if any(c in inner for c in "*?["):
        folder, pattern = posixpath.split(inner)
        found = source.get_file_info(fs.FileSelector(folder))
        return sorted(f.path for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(posixpath.basename(f.path), pattern))
    info = source.get_file_info(inner)
    if info.type == fs.FileType.Directory:
        return sorted(f.path for f in source.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.File and not posixpath.basename(f.path).startswith((".", "_")))
    return [inner]


def point_type(layout: str, dim: int) -> np.dtype:
    fields = LAYOUTS[layout]
    return np.dtype(fields + ([("d", "<i4"), ("desc", "u1", (dim,))] if layout in WITH_DESCRIPTOR else []))


def decode_points(body: bytes, layout: str) -> np.ndarray:
    """Records of one layout; the dimension is that of the first."""
    dim = 0
    if layout in WITH_DESCRIPTOR and body:
        at = np.dtype(LAYOUTS[layout]).itemsize
        dim = int(np.frombuffer(body[at : at + 4], "<i4")[0])
    kind = point_type(layout, dim)
    if len(body) % kind.itemsize:
        raise ValueError(f"{len(body)} bytes are not whole {layout} records of {kind.itemsize}")
    out = np.frombuffer(body, kind)
    if dim and (out["d"] != dim).any():
        raise ValueError("records of more than one dimension in a file")
    return out


def encode_points(rows: list[dict], layout: str) -> bytes:
    dim = len(rows[0]["desc"]) if rows and layout in WITH_DESCRIPTOR else 0
    out = np.zeros(len(rows), point_type(layout, dim))
    for name in out.dtype.names:
        if name == "d":
            out["d"] = dim
        elif not name.startswith("unused"):
            out[name] = [r[name] for r in rows]
    return out.tobytes()


class Piece(InputPartition):
    def __init__(self, path: str, start: int, size: int, first: int, width: int):
        self.path, self.start, self.size, self.first, self.width = path, start, size, first, width


def pieces(path: str, width_of, first: int | None = None) -> list[Piece]:
    source, _ = _open(path)
    out = []
    for name in files(path):
        size = source.get_file_info(name).size
        if not size:
            continue
        with source.open_input_file(name) as f:
            width = width_of(f)
        if size % width:
            raise ValueError(f"{name}: {size} bytes are not whole records of {width}")
        if first is not None:
            size = min(size, first * width)
        step = max(1, SPLIT_BYTES // width) * width
        out += [Piece(name, at, min(step, size - at), at // width, width) for at in range(0, size, step)]
    return out


def _body(path: str, piece: Piece) -> bytes:
    source, _ = _open(path)
    with source.open_input_file(piece.path) as f:
        return f.read_at(piece.size, piece.start)


class PointSource(DataSource):
    """Options: layout, first, keep. Rows: file, pt (place in the file), vw and binsign where the layout has them, geometry, desc."""

    @classmethod
    def name(cls) -> str:
        return "points"

    def schema(self) -> str:
        layout = self.options.get("layout", "siftgeo")
        extra = {"vwgeo": ", vw int", "vwsgeo": ", vw int, binsign long"}.get(layout, "")
        return "file string, pt long" + extra + "".join(f", {g} float" for g in GEOMETRY) + (", desc binary" if layout in WITH_DESCRIPTOR else "")

    def reader(self, schema) -> DataSourceReader:
        return _PointReader(self.options["path"], self.options.get("layout", "siftgeo"), _first(self.options), self.options.get("keep"))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _PointWriter(self.options["path"], self.options.get("layout", "siftgeo"))


def _first(options) -> int | None:
    return int(options["first"]) if "first" in options else None


_COMPARE = {"=": np.equal, "<>": np.not_equal, ">": np.greater, ">=": np.greater_equal, "<": np.less, "<=": np.less_equal}
_TEST = re.compile(r"\s*(\w+)\s*(<=|>=|<>|=|<|>)\s*([-+.\deE]+)\s*")


def tests(said: str | None, layout: str) -> list[tuple[str, str, float]]:
    """(field, comparison, number) of the option `keep`; all have to hold."""
    stored = {name for name, _ in LAYOUTS[layout] if not name.startswith("unused")}
    out = []
    for part in re.split(r"\sand\s", said, flags=re.IGNORECASE) if said else []:
        m = _TEST.fullmatch(part)
        if not m or m[1] not in stored:
            raise ValueError(f"{part.strip()!r} does not compare a field of {layout} with a number")
        out.append((m[1], m[2], float(m[3])))
    return out


class _PointReader(DataSourceReader):
    def __init__(self, path: str, layout: str, first: int | None = None, keep: str | None = None):
        self.path, self.layout, self.first, self.tests = path, layout, first, tests(keep, layout)

    def _kept(self, rows: np.ndarray) -> np.ndarray:
        """Places of the records that pass the tests; NaN is larger than any number, as in Spark."""
        keep = np.ones(len(rows), bool)
        for name, kind, value in self.tests:
            x = rows[name].astype(np.float64)
            keep &= _COMPARE[kind](np.where(np.isnan(x), np.inf, x), value)
        return np.flatnonzero(keep)

    def partitions(self) -> list[Piece]:
        base = np.dtype(LAYOUTS[self.layout]).itemsize

        def width(f) -> int:
            return base + 4 + int(np.frombuffer(f.read_at(4, base), "<i4")[0]) if self.layout in WITH_DESCRIPTOR else base

        return pieces(self.path, width, self.first)

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        rows = decode_points(_body(self.path, partition), self.layout)
        kept = self._kept(rows)
        for low in range(0, len(kept), 20_000):
            at = kept[low : low + 20_000]
            part = rows[at]
            columns = {"file": pa.array([partition.path] * len(part)), "pt": pa.array(partition.first + at)}
            for c, kind in (("vw", pa.int32()), ("binsign", pa.int64())):
                if c in part.dtype.names:
                    columns[c] = pa.array(part[c].copy(), kind)
            for g in GEOMETRY:
                default = 1.0 if g in ("mi11", "mi22") else 0.0
                columns[g] = pa.array(part[g].copy() if g in part.dtype.names else np.full(len(part), default), pa.float32())
            if "desc" in part.dtype.names:
                columns["desc"] = pa.array([d.tobytes() for d in part["desc"]], pa.binary())
            yield pa.RecordBatch.from_pydict(columns)


class _Written(WriterCommitMessage):
    def __init__(self, temporary: str, final: str):
        self.temporary, self.final = temporary, final


class _FileWriter(DataSourceArrowWriter):
    """A file for each task, under a hidden name until the job commits."""

    suffix = "bin"

    def __init__(self, path: str):
        self.path = path

    def encode(self, batch: pa.RecordBatch) -> bytes:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        to, folder = _open(self.path)
        to.create_dir(folder, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:8]}.{self.suffix}"
        temporary = posixpath.join(folder, f".{name}")
        with to.open_output_stream(temporary) as f:
            for batch in iterator:
                if batch.num_rows:
                    f.write(self.encode(batch))
        return _Written(temporary, posixpath.join(folder, name))

    def commit(self, messages) -> None:
        to, _ = _open(self.path)
        for m in messages:
            if m is not None:
                to.move(m.temporary, m.final)

    def abort(self, messages) -> None:
        to, _ = _open(self.path)
        for m in messages:
            if m is not None:
                to.delete_file(m.temporary)


class _PointWriter(_FileWriter):
    def __init__(self, path: str, layout: str):
        super().__init__(path)
        self.layout = self.suffix = layout

    def encode(self, batch: pa.RecordBatch) -> bytes:
        rows = batch.to_pylist()
        for r in rows:
            if "desc" in r:
                r["desc"] = np.frombuffer(r["desc"], np.uint8)
        return encode_points(rows, self.layout)


class _VectorReader(DataSourceReader):
    def __init__(self, path: str, kind: str, first: int | None = None, dim: int | None = None):
        """dim: of files that don't tell it."""
        self.path, self.kind, self.first, self.dim = path, kind, first, dim

    def partitions(self) -> list[Piece]:
        if self.dim is not None:
            return pieces(self.path, lambda f: 4 * self.dim, self.first)
        return pieces(self.path, lambda f: 4 + 4 * int(np.frombuffer(f.read_at(4, 0), "<i4")[0]), self.first)

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        raw = np.frombuffer(_body(self.path, partition), "<i4").reshape(-1, partition.width // 4)
        if self.dim is None and (raw[:, 0] != raw.shape[1] - 1).any():
            raise ValueError("vectors of more than one dimension in a file")
        values = raw[:, 0 if self.dim is not None else 1 :].copy().view(self.kind)
        kind = pa.float32() if self.kind == "<f4" else pa.int32()
        offsets = pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32))
        yield pa.RecordBatch.from_pydict({"file": pa.array([partition.path] * len(values)), "id": pa.array(np.arange(partition.first, partition.first + len(values))), "vec": pa.ListArray.from_arrays(offsets, pa.array(values.ravel(), kind))})


class _SparseReader(DataSourceReader):
    """A file of sparse vectors is one piece, since its records have no common size."""

    def __init__(self, path: str, dim: int, first: int | None = None):
        self.path, self.dim, self.first = path, dim, first

    def partitions(self) -> list[Piece]:
        source, _ = _open(self.path)
        return [Piece(name, 0, source.get_file_info(name).size, 0, 1) for name in files(self.path)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        source, _ = _open(self.path)
        with source.open_input_stream(partition.path) as f:
            number, held = 0, []
            while (self.first is None or number < self.first) and (head := f.read(4)):
                n = int(np.frombuffer(head, "<i4")[0])
                at, again, values = np.frombuffer(f.read(4 * n), "<i4"), int(np.frombuffer(f.read(4), "<i4")[0]), np.frombuffer(f.read(4 * n), "<f4")
                if again != n or len(values) != n or (n and (at.min() < 0 or at.max() >= self.dim)):
                    raise ValueError(f"{partition.path}: record {number} is broken")
                row = np.zeros(self.dim, np.float32)
                row[at] = values
                held.append(row)
                number += 1
                if len(held) == 1000:
                    yield self._batch(partition.path, number, held)
                    held = []
            if held:
                yield self._batch(partition.path, number, held)

    def _batch(self, path: str, number: int, rows: list[np.ndarray]) -> pa.RecordBatch:
        offsets = pa.array(np.arange(0, len(rows) * self.dim + 1, self.dim, dtype=np.int32))
        return pa.RecordBatch.from_pydict({"file": pa.array([path] * len(rows)), "id": pa.array(np.arange(number - len(rows), number)), "vec": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(rows)))})


class _SparseWriter(_FileWriter):
    """Records: how many entries are not 0, their places, the number again, the entries."""

    suffix = "spfvecs"

    def encode(self, batch: pa.RecordBatch) -> bytes:
        out = []
        for row in batch.column(batch.schema.get_field_index("vec")).to_pylist():
            row = np.array(row, "<f4")
            at = np.flatnonzero(row).astype("<i4")
            n = np.array([len(at)], "<i4").tobytes()
            out += [n, at.tobytes(), n, row[at].tobytes()]
        return b"".join(out)


class _VectorWriter(_FileWriter):
    def __init__(self, path: str, kind: str, suffix: str):
        super().__init__(path)
        self.kind, self.suffix = kind, suffix

    def encode(self, batch: pa.RecordBatch) -> bytes:
        vecs = batch.column(batch.schema.get_field_index("vec"))
        m = vecs.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(self.kind)
        if self.suffix == "rawfvecs":
            return m.tobytes()
        head = np.full((len(m), 1), m.shape[1], "<i4")
        return np.hstack([head, m.view("<i4")]).tobytes()


class FloatVectorSource(DataSource):
    """fvecs: each record a dimension (int32) and its float32 values. Rows: file, id (place in the file), vec."""

    kind, element = "<f4", "float"

    @classmethod
    def name(cls) -> str:
        return "fvecs"

    def schema(self) -> str:
        return f"file string, id long, vec array<{self.element}>"

    def reader(self, schema) -> DataSourceReader:
        return _VectorReader(self.options["path"], self.kind, _first(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _VectorWriter(self.options["path"], self.kind, self.name())


class IntVectorSource(FloatVectorSource):
    kind, element = "<i4", "int"

    @classmethod
    def name(cls) -> str:
        return "ivecs"


class RawVectorSource(FloatVectorSource):
    """float32 values and nothing else; the option `dim` tells how many make a vector."""

    @classmethod
    def name(cls) -> str:
        return "rawfvecs"

    def reader(self, schema) -> DataSourceReader:
        return _VectorReader(self.options["path"], self.kind, _first(self.options), int(self.options["dim"]))


class SparseVectorSource(FloatVectorSource):
    """Vectors of which the entries other than 0 are stored; the option `dim` is the length of those read."""

    @classmethod
    def name(cls) -> str:
        return "spfvecs"

    def reader(self, schema) -> DataSourceReader:
        return _SparseReader(self.options["path"], int(self.options["dim"]), _first(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _SparseWriter(self.options["path"])


def register(spark) -> None:
    for source in (PointSource, FloatVectorSource, IntVectorSource, RawVectorSource, SparseVectorSource):
        spark.dataSource.register(source)
