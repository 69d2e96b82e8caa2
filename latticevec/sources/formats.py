"""Vector files as a Spark data source.

``spark.read.format("vectors").option("kind", ...).load(path)`` reads a file, or
all files of a folder in the order of their names, and gives (id, vec): ids are
row numbers over all files. Without ``kind`` the name's ending decides. Files
are read in ranges of rows, each a partition, from any file system that Arrow
knows by the path. All numbers are little-endian.

Writing gives a folder with one file for each partition, each of them whole;
order the rows by id first. A file of its own can be made of a folder by
:func:`merge`.

| kind | rows | layout |
|-|-|-|
| fvecs, ivecs, bvecs | float, int32, byte | for each row an int32 of its components, and these |
| fbin | float | int32 rows, int32 components, and all rows |
| hvecs, hh | float | int32 components, and all rows |
| nsw | int32 | rows only; the option ``rows`` tells how many there are |
| txt | float | a line "rows components", then a line of numbers between commas for each row |
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

KINDS = ("fvecs", "ivecs", "bvecs", "fbin", "hvecs", "hh", "nsw", "txt")
_INTS = ("ivecs", "nsw")
_NUMBER = {"bvecs": np.dtype("u1"), "ivecs": np.dtype("<i4"), "nsw": np.dtype("<i4")}
#: Bytes of a partition, about.
PART_BYTES = 64_000_000


def kind_of(path: str, options: dict[str, str]) -> str:
    kind = options.get("kind") or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in KINDS:
        raise ValueError(f"unknown kind of vector file: {kind}; known are {', '.join(KINDS)}")
    return kind


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a path, and the path there."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), unquote(urlparse(path).path)
    if "://" in path:
        return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return pafs.LocalFileSystem(), path


def files_of(path: str) -> tuple[pafs.FileSystem, list[pafs.FileInfo]]:
    fs, at = filesystem(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return fs, [info]
    found = fs.get_file_info(pafs.FileSelector(at))
    return fs, sorted((f for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)


@dataclass
class Layout:
    """Where the rows of a file are."""

    rows: int
    dims: int
    offset: int  # of the first row
    stride: int  # bytes from row to row
    lead: int  # bytes of a row before its components


def layout(fs: pafs.FileSystem, info: pafs.FileInfo, kind: str, rows: int | None) -> Layout:
    """By a file's head and size; a size that isn't a whole number of rows is an error."""
    number = _NUMBER.get(kind, np.dtype("<f4")).itemsize
    with fs.open_input_file(info.path) as f:
        head = np.frombuffer(f.read(8), "<i4") if info.size >= 8 else np.frombuffer(f.read(4), "<i4") if info.size >= 4 else np.zeros(0, "<i4")
        if kind == "txt":
            f.seek(0)
            line = f.read(64).split(b"\n", 1)[0].split() if info.size else [b"0", b"0"]
            return Layout(int(line[0]), int(line[1]), 0, 0, 0)
    if kind == "nsw":
        if not rows:
            raise ValueError("a graph file needs the option rows")
        dims = info.size // (number * rows)
        out = Layout(rows, dims, 0, dims * number, 0)
    elif not len(head):
        return Layout(0, 0, 0, 0, 0)
    elif kind == "fbin":
        out = Layout(int(head[0]), int(head[1]), 8, int(head[1]) * number, 0)
    elif kind in ("hvecs", "hh"):
        d = int(head[0])
        out = Layout((info.size - 4) // (d * number) if d else 0, d, 4, d * number, 0)
    else:
        d = int(head[0])
        out = Layout(info.size // (4 + d * number), d, 0, 4 + d * number, 4)
    if out.offset + out.rows * out.stride != info.size:
        raise ValueError(f"{info.path}: {info.size} bytes are no whole number of {kind} rows of {out.dims} components")
    return out


def parse(data: bytes, kind: str, shape: Layout) -> np.ndarray:
    """(row, component) of the bytes of whole rows."""
    kind_number = _NUMBER.get(kind, np.dtype("<f4"))
    raw = np.frombuffer(data, np.uint8).reshape(-1, shape.stride)
    if shape.lead and (np.ascontiguousarray(raw[:, :4]).view("<i4") != shape.dims).any():
        raise ValueError("rows have different numbers of components")
    return np.ascontiguousarray(raw[:, shape.lead :]).view(kind_number)


@dataclass
class Part(InputPartition):
    path: str
    first: int  # row of the file
    count: int
    id: int  # of the first row
    shape: Layout


class VectorReader(DataSourceReader):
    def __init__(self, path: str, kind: str, options: dict[str, str]):
        self.path, self.kind = path, kind
        self.n_rows = int(options["rows"]) if "rows" in options else None
        self.part_bytes = int(options.get("part_bytes", PART_BYTES))

    def partitions(self) -> list[Part]:
        fs, infos = files_of(self.path)
        out, at, dims = [], 0, None
        for info in infos:
            shape = layout(fs, info, self.kind, self.n_rows)
            if shape.rows and dims not in (None, shape.dims):
                raise ValueError(f"{info.path} has {shape.dims} components, files before it {dims}")
            dims = shape.dims if shape.rows else dims
            step = shape.rows if self.kind == "txt" else max(1, self.part_bytes // max(1, shape.stride))
            out += [Part(info.path, k, min(step, shape.rows - k), at + k, shape) for k in range(0, shape.rows, max(1, step))]
            at += shape.rows
        return out or [Part("", 0, 0, 0, Layout(0, 0, 0, 0, 0))]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        fs, _ = files_of(self.path)
        number = pa.int32() if self.kind in _INTS else pa.float32()
        with fs.open_input_file(partition.path) as f:
            if self.kind == "txt":
                yield from self._text(f, partition)
                return
            f.seek(partition.shape.offset + partition.first * partition.shape.stride)
            step = max(1, 4_000_000 // max(1, partition.shape.stride))
            for k in range(0, partition.count, step):
                n = min(step, partition.count - k)
                x = parse(f.read(n * partition.shape.stride), self.kind, partition.shape)
                flat = pa.array(x.ravel().astype(np.int32 if self.kind in _INTS else np.float32), number)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * partition.shape.dims), flat)
                ids = np.arange(partition.id + k, partition.id + k + n)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists], ["id", "vec"])

    def _text(self, f: pa.NativeFile, partition: Part) -> Iterator[pa.RecordBatch]:
        lines = pa.BufferedInputStream(f, 1 << 20)
        rest, row, first = b"", 0, True
        while row < partition.count:
            chunk = lines.read(1 << 20)
            parts = (rest + chunk).split(b"\n")
            rest = parts.pop() if chunk else b""
            made = [[float(v) for v in line.rstrip(b", \r").split(b",")] for line in (parts[1:] if first and parts else parts) if line.strip()]
            first = first and not parts
            made = made[: partition.count - row]
            if any(len(m) != partition.shape.dims for m in made):
                raise ValueError(f"{partition.path}: a row hasn't {partition.shape.dims} components")
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(range(partition.id + row, partition.id + row + len(made)), pa.int64()), pa.array(made, pa.list_(pa.float32()))], ["id", "vec"])
            row += len(made)
            if not chunk:
                break
        if row < partition.count:
            raise ValueError(f"{partition.path} ends after {row} of {partition.count} rows")


def dump(x: np.ndarray, kind: str) -> bytes:
    """A whole file of (row, component)."""
    number = _NUMBER.get(kind, np.dtype("<f4"))
    head = lambda *n: np.array(n, "<i4").tobytes()
    body = np.ascontiguousarray(x.astype(number))
    if kind == "txt":
        return b"\n".join([b"%d %d" % x.shape, *[",".join(repr(float(v)) for v in row.astype(np.float32)).encode() for row in x], b""])
    if kind == "fbin":
        return head(*x.shape) + body.tobytes()
    if kind in ("hvecs", "hh"):
        return head(x.shape[1]) + body.tobytes()
    if kind == "nsw":
        return body.tobytes()
    lead = np.full((len(x), 1), x.shape[1], "<i4").view(np.uint8)
    return np.concatenate([lead, body.view(np.uint8).reshape(len(x), -1)], axis=1).tobytes() if len(x) else b""


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class VectorWriter(DataSourceWriter):
    def __init__(self, path: str, kind: str, overwrite: bool):
        self.path, self.kind, self.overwrite = path, kind, overwrite

    def _fs(self) -> tuple[pafs.FileSystem, str]:
        return filesystem(self.path)

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        rows = [r["vec"] for r in iterator]
        if not rows:
            return Written(None)
        context = TaskContext.get()
        fs, at = self._fs()
        fs.create_dir(at, recursive=True)
        name = f"{at}/.part-{context.partitionId():05d}-{context.taskAttemptId()}.{self.kind}"
        with fs.open_output_stream(name) as f:
            f.write(dump(np.array(rows), self.kind))
        return Written(name)

    def commit(self, messages: list[Written]) -> None:
        """Files get their names when all are written, so a task that ran twice leaves one."""
        fs, _ = self._fs()
        if self.overwrite:
            for info in files_of(self.path)[1]:
                fs.delete_file(info.path)
        for m in messages:
            if m is not None and m.path:
                folder, name = m.path.rsplit("/", 1)
                fs.move(m.path, f"{folder}/{name[1:].split('-')[0]}-{name.split('-')[1]}.{self.kind}")

    def abort(self, messages: list[Written]) -> None:
        fs, _ = self._fs()
        for m in messages:
            if m is not None and m.path:
                fs.delete_file(m.path)


class VectorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vectors"

    def _at(self) -> tuple[str, str]:
        path = self.options.get("path")
        if not path:
            raise ValueError("a path is needed")
        return path, kind_of(path, self.options)

    def schema(self) -> str:
        return "id bigint, vec array<int>" if self._at()[1] in _INTS else "id bigint, vec array<float>"

    def reader(self, schema) -> VectorReader:
        path, kind = self._at()
        return VectorReader(path, kind, dict(self.options))

    def writer(self, schema, overwrite: bool) -> VectorWriter:
        path, kind = self._at()
        return VectorWriter(path, kind, overwrite)


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("vectors")`` known to a session."""
    spark.dataSource.register(VectorSource)


def merge(folder: str, target: str) -> None:
    """One file of all files in a folder that Spark wrote; heads are put together and rows copied a piece at a time."""
    kind = kind_of(target, {})
    fs, infos = files_of(folder)
    shapes = [layout(fs, i, kind, None) for i in infos] if kind != "nsw" else []
    out_fs, at = filesystem(target)
    with out_fs.open_output_stream(at) as out:
        rows, dims = sum(s.rows for s in shapes), next((s.dims for s in shapes if s.rows), 0)
        out.write({"fbin": np.array([rows, dims], "<i4").tobytes(), "hvecs": np.array([dims], "<i4").tobytes(), "hh": np.array([dims], "<i4").tobytes(), "txt": b"%d %d\n" % (rows, dims)}.get(kind, b""))
        for info in infos:
            with fs.open_input_file(info.path) as f:
                f.seek(next((s.offset for s, i in zip(shapes, infos, strict=False) if i is info), 0))
                if kind == "txt":
                    while f.read(1) not in (b"\n", b""):
                        pass
                while chunk := f.read(1 << 22):
                    out.write(chunk)


#: Boxes that a task reads.
BOXES_A_TASK = 4096


def read_boxes(spark: SparkSession, path: str, nodes: int):
    """(box_id, lo, hi, members) of a box file: int32 boxes and members a box, six floats a box, and the members as int32, padded by ``nodes``, the number of points. Tasks read ranges of boxes."""
    fs, infos = files_of(path)
    with fs.open_input_file(infos[0].path) as f:
        head = f.read(8)
        n, size = (int(x) for x in np.frombuffer(head, "<i4")) if len(head) == 8 else (0, 0)
        if f.size() != 8 + 4 * n * (6 + size):
            raise ValueError(f"{path}: {f.size()} bytes are not {n} boxes of {size} members")
    point = pa.struct([(a, pa.float64()) for a in "xyz"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, infos = files_of(path)
        for batch in batches:
            for a in (BOXES_A_TASK * x for x in batch.column(0).to_pylist()):
                count = min(BOXES_A_TASK, n - a)
                with fs.open_input_file(infos[0].path) as f:
                    f.seek(8 + 24 * a)
                    sides = np.frombuffer(f.read(24 * count), "<f4").reshape(count, 6).astype(float)
                    f.seek(8 + 24 * n + 4 * a * size)
                    members = np.frombuffer(f.read(4 * count * size), "<i4").reshape(count, size).astype(np.int64)
                own = members != nodes
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, own.sum(axis=1).cumsum()).astype(np.int32)), pa.array(members[own]))
                corner = lambda k: pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(sides[:, k + j])) for j in range(3)], fields=list(point))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + count, dtype=np.int32)), corner(0), corner(3), lists], ["box_id", "lo", "hi", "members"])

    tasks = -(-n // BOXES_A_TASK)
    shape = "struct<x: double, y: double, z: double>"
    return spark.range(0, tasks, 1, max(1, tasks)).mapInArrow(read, f"box_id int, lo {shape}, hi {shape}, members array<bigint>")


def write_boxes(boxes, path: str, nodes: int) -> None:
    """A box file of (box_id, lo, hi, members), padded by ``nodes``, the number of points. Tasks write parts beside it, which are put together a piece at a time."""
    facts = boxes.selectExpr("count(*) AS n", "coalesce(max(size(members)), 0) AS size").first()
    n, size, folder = facts["n"], facts["size"], f"{path}-parts-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, (fs, at) = TaskContext.get(), filesystem(folder)
        name = f"{at}/{context.partitionId():06d}-{context.taskAttemptId()}"
        fs.create_dir(at, recursive=True)
        with fs.open_output_stream(f"{name}.sides") as one, fs.open_output_stream(f"{name}.members") as two:
            for batch in batches:
                corners = [np.stack([batch.column(s).field(k).to_numpy() for k in range(3)], axis=1) for s in ("lo", "hi")]
                one.write(np.concatenate(corners, axis=1).astype("<f4").tobytes())
                lists = batch.column("members")
                sizes, padded = np.asarray(lists.value_lengths().fill_null(0)), np.full((batch.num_rows, size), nodes, "<i4")
                padded[np.arange(size) < sizes[:, None]] = np.asarray(lists.flatten())
                two.write(padded.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([context.partitionId()]), pa.array([name])], ["part", "name"])

    ordered = boxes.select("box_id", "lo", "hi", "members").repartitionByRange("box_id").sortWithinPartitions("box_id")
    parts = [r["name"] for r in sorted(ordered.mapInArrow(write, "part long, name string").collect())]  # a row for each partition
    fs, at = filesystem(path)
    with fs.open_output_stream(at) as out:
        out.write(np.array([n, size], "<i4").tobytes())
        for end in ("sides", "members"):
            for name in parts:
                with fs.open_input_file(f"{name}.{end}") as f:
                    while chunk := f.read(1 << 22):
                        out.write(chunk)
    fs.delete_dir(filesystem(folder)[1])
