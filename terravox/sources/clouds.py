"""Point clouds in files of one header and one body: ASCII, binary and compressed bodies, read in ranges and written in one commit.

``spark.dataSource.register(PointCloud)``, then ``spark.read.format("pcd").load(path)`` and ``df.write.format("pcd").mode("overwrite").save(path)``.
Fields of every kind of number become columns; a field that counts several values becomes that many columns. A binary body is read in
ranges of rows and an ASCII one in ranges of bytes, each by a task; a compressed body is one stream, so it is one task's work, column by column.

Options: ``rows`` and ``bytes`` per range; ``data`` ("binary", "ascii" or "compressed") of what is written. Paths are local, or URIs that
Arrow's file systems know; a written path must be one that driver and executors share.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

ROWS, BYTES, COPY = 1 << 20, 32 << 20, 1 << 20
#: The format's number kinds, as its TYPE and SIZE, with the columns' types.
KINDS = {("F", 4): ("<f4", "float"), ("F", 8): ("<f8", "double"), ("I", 1): ("<i1", "byte"), ("I", 2): ("<i2", "short"), ("I", 4): ("<i4", "int"), ("I", 8): ("<i8", "long"),
         ("U", 1): ("<u1", "short"), ("U", 2): ("<u2", "int"), ("U", 4): ("<u4", "long"), ("U", 8): ("<u8", "decimal(20,0)")}
WRITTEN = {"float": ("F", 4), "double": ("F", 8), "byte": ("I", 1), "short": ("I", 2), "integer": ("I", 4), "long": ("I", 8)}


def store_of(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Header:
    """Columns as (name, kind of numpy, type of Spark), points, kind of body and where it begins."""

    columns: tuple[tuple[str, str, str], ...]
    points: int
    data: str
    begin: int

    @property
    def row(self) -> np.dtype:
        return np.dtype([(f"f{i}", kind) for i, (_, kind, _) in enumerate(self.columns)])


def read_header(path: str) -> Header:
    store, at = store_of(path)
    told: dict[str, list[str]] = {}
    with store.open_input_file(at) as f:
        raw, done = b"", 0
        while "DATA" not in told:
            end = raw.find(b"\n", done)
            if end < 0:
                more = f.read(4096)
                if not more and len(raw) == done:
                    raise ValueError(f"{path}: no DATA line")
                raw += more or b"\n"
                continue
            cells = raw[done:end].decode("ascii", "replace").split()
            done = end + 1
            if cells and not cells[0].startswith("#"):
                told[cells[0].upper()] = cells[1:]
    names = told.get("FIELDS") or told.get("COLUMNS")
    if not names:
        raise ValueError(f"{path}: no FIELDS line")
    data = told["DATA"][0]
    n = len(names)
    sizes, types, counts = (told.get(k, [default] * n) for k, default in (("SIZE", "4"), ("TYPE", "F"), ("COUNT", "1")))
    columns = []
    for name, size, kind, count in zip(names, map(int, sizes), types, map(int, counts)):
        if (kind, size) not in KINDS:
            raise ValueError(f"{path}: {name} is of an unknown kind, {kind} of {size} bytes")
        columns += [(name if count == 1 else f"{name}_{i}", *KINDS[kind, size]) for i in range(count)]
    size = [int(told[k][0]) for k in ("WIDTH", "HEIGHT") if k in told]
    points = int(told["POINTS"][0]) if "POINTS" in told else size[0] * size[1] if len(size) == 2 else -1
    return Header(tuple(columns), points, data, done)


def unpacked(data: bytes, size: int) -> bytes:
    """The bytes of an LZF stream: literals, and copies of what came before, which may overlap with what they write."""
    out = bytearray()
    at, end = 0, len(data)
    while at < end:
        control = data[at]
        at += 1
        if control < 32:
            out += data[at : at + control + 1]
            at += control + 1
            continue
        length = control >> 5
        if length == 7:
            length += data[at]
            at += 1
        length += 2
        back = len(out) - ((control & 31) << 8) - data[at] - 1
        at += 1
        if back < 0:
            raise ValueError("a compressed cloud refers to what lies before it")
        if back + length <= len(out):
            out += out[back : back + length]
        else:
            # What is copied repeats itself.
            part = bytes(out[back:])
            out += (part * (length // len(part) + 1))[:length]
    if len(out) != size:
        raise ValueError(f"a compressed cloud holds {len(out)} bytes, not {size}")
    return bytes(out)


def packed(data: bytes) -> bytes:
    """An LZF stream of some bytes: the last place of every three bytes is looked up, and copies are as long as they can be."""
    out, seen, at, pending = bytearray(), {}, 0, 0

    def literals(lo: int, hi: int) -> None:
        for p in range(lo, hi, 32):
            part = data[p : min(p + 32, hi)]
            out.append(len(part) - 1)
            out.extend(part)

    while at < len(data):
        key = data[at : at + 3]
        before = seen.get(key) if len(key) == 3 else None
        seen[key] = at
        if before is None or at - before > 8192:
            at += 1
            continue
        length, most = 3, min(264, len(data) - at)
        while length < most and data[before + length] == data[at + length]:
            length += 1
        literals(pending, at)
        gap, short = at - before - 1, length - 2
        out.append(min(short, 7) << 5 | gap >> 8)
        if short >= 7:
            out.append(short - 7)
        out.append(gap & 255)
        at += length
        pending = at
    literals(pending, len(data))
    return bytes(out)


def _arrow(columns, arrays) -> pa.RecordBatch:
    made = []
    for (_, _, kind), a in zip(columns, arrays):
        widened = {"short": "<i2", "int": "<i4", "long": "<i8"}.get(kind)
        made.append(pa.array([int(v) for v in a], pa.decimal128(20, 0)) if kind.startswith("decimal") else pa.array(np.ascontiguousarray(a.astype(widened) if widened else a)))
    return pa.RecordBatch.from_arrays(made, names=[c[0] for c in columns])


@dataclass
class _Range(InputPartition):
    lo: int
    hi: int


class PointCloud(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcd"

    def schema(self) -> str:
        return ", ".join(f"`{name}` {kind}" for name, _, kind in read_header(self.options["path"]).columns)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("rows", ROWS)), int(self.options.get("bytes", BYTES)), [f.name for f in schema.fields])

    def writer(self, schema: StructType, overwrite: bool):
        return _Writer(self.options["path"], self.options.get("data", "binary"), overwrite, schema)


class _Reader(DataSourceReader):
    def __init__(self, path: str, rows: int, size: int, wanted: list[str]):
        self.path, self.rows, self.size, self.head, self.wanted = path, rows, size, read_header(path), wanted
        if self.head.data not in ("ascii", "binary", "binary_compressed"):
            raise ValueError(f"{path}: {self.head.data} data is not read")
        if missing := set(wanted) - {c[0] for c in self.head.columns}:
            raise ValueError(f"{path}: no fields {sorted(missing)}")

    def partitions(self) -> list[_Range]:
        store, at = store_of(self.path)
        end = store.get_file_info(at).size
        if self.head.data == "binary":
            n = (end - self.head.begin) // self.head.row.itemsize
            if self.head.points > n:
                raise ValueError(f"{self.path}: {n} points of {self.head.points} are there")
            n = n if self.head.points < 0 else self.head.points
            return [_Range(lo, min(n, lo + self.rows)) for lo in range(0, n, self.rows)] or [_Range(0, 0)]
        if self.head.data == "ascii":
            return [_Range(lo, min(end, lo + self.size)) for lo in range(self.head.begin, end, self.size)] or [_Range(end, end)]
        return [_Range(self.head.begin, end)]

    def _columns(self, arrays: list[np.ndarray]) -> pa.RecordBatch:
        at = {c[0]: i for i, c in enumerate(self.head.columns)}
        picked = [at[n] for n in self.wanted]
        return _arrow([self.head.columns[i] for i in picked], [arrays[i] for i in picked])

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        store, at = store_of(self.path)
        with store.open_input_file(at) as f:
            yield from getattr(self, f"_{self.head.data}")(f, partition)

    def _binary(self, f, part: _Range) -> Iterator[pa.RecordBatch]:
        kind, step = self.head.row, 1 << 16
        for lo in range(part.lo, part.hi, step):
            f.seek(self.head.begin + lo * kind.itemsize)
            rows = np.frombuffer(f.read((min(part.hi, lo + step) - lo) * kind.itemsize), kind)
            yield self._columns([rows[n] for n in kind.names])

    def _binary_compressed(self, f, part: _Range) -> Iterator[pa.RecordBatch]:
        f.seek(part.lo)
        small, large = np.frombuffer(f.read(8), "<u4").tolist() if part.hi - part.lo >= 8 else (0, 0)
        n = large // self.head.row.itemsize
        if self.head.points >= 0 and n != self.head.points:
            raise ValueError(f"{self.path}: {n} points of {self.head.points} are there")
        body, lo, arrays = unpacked(f.read(small), large), 0, []
        for _, kind, _ in self.head.columns:
            arrays.append(np.frombuffer(body, kind, n, lo))
            lo += n * np.dtype(kind).itemsize
        for lo in range(0, n, 1 << 16):
            yield self._columns([a[lo : lo + (1 << 16)] for a in arrays])

    def _ascii(self, f, part: _Range) -> Iterator[pa.RecordBatch]:
        """The lines that begin in a range: the first is found behind the end of the line before, the last may reach beyond."""
        f.seek(part.lo - 1)
        raw = io.BufferedReader(_Plain(f), 1 << 16)
        at = part.lo
        if part.lo > self.head.begin:
            at = part.lo - 1 + len(raw.readline())
        else:
            raw.read(1)
        lines: list[list[bytes]] = []
        while at < part.hi:
            line = raw.readline()
            if not line:
                break
            at += len(line)
            if cells := line.split():
                lines.append(cells)
            if len(lines) >= 1 << 14:
                yield self._columns(self._parsed(lines))
                lines = []
        if lines:
            yield self._columns(self._parsed(lines))

    def _parsed(self, lines: list[list[bytes]]) -> list[np.ndarray]:
        if any(len(cells) < len(self.head.columns) for cells in lines):
            raise ValueError(f"{self.path}: a line has fewer values than there are fields")
        # Whole numbers are read as such, so that large ones keep all their digits.
        whole = lambda kind: kind[1] in "iu"
        return [np.array([int(cells[i]) if whole(kind) else float(cells[i]) for cells in lines], kind) for i, (_, kind, _) in enumerate(self.head.columns)]


class _Plain(io.RawIOBase):
    """An Arrow file as one of Python's."""

    def __init__(self, f):
        self.f = f

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        got = self.f.read(len(b))
        b[: len(got)] = got
        return len(got)


@dataclass
class _Part(WriterCommitMessage):
    place: int
    path: str
    points: int


@dataclass
class _Writer(DataSourceArrowWriter):
    """Tasks write bodies beside the path; the commit puts the header and all bodies into one file and takes the bodies away.

    A body that a lost task has left is in no message, so it is taken away with the rest.
    """

    path: str
    data: str
    overwrite: bool
    schema: StructType
    run: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __post_init__(self):
        if self.data not in ("ascii", "binary", "compressed"):
            raise ValueError(f"{self.data} data is not written")
        kinds = [f.dataType.typeName() for f in self.schema.fields]
        if unknown := [k for k in kinds if k not in WRITTEN]:
            raise ValueError(f"{unknown} are no kinds of numbers of a cloud")
        self.kinds = [WRITTEN[k] for k in kinds]
        store, at = store_of(self.path)
        from pyarrow import fs

        if not self.overwrite and store.get_file_info(at).type != fs.FileType.NotFound:
            raise ValueError(f"{self.path} is there already")
        # Made here and not by tasks: one that is still at work when a write is given up cannot bring it back.
        store.create_dir(f"{at}.parts-{self.run}", recursive=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Part:
        from pyspark import TaskContext

        store, at = store_of(self.path)
        place = TaskContext.get().partitionId()
        where, n = f"{at}.parts-{self.run}/{place}-{uuid.uuid4().hex}", 0
        dtype = np.dtype([(f"f{i}", KINDS[k][0]) for i, k in enumerate(self.kinds)])
        with store.open_output_stream(where) as f:
            for batch in batches:
                columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                if any(c.null_count for c in batch.columns):
                    raise ValueError("a cloud has no nulls")
                if self.data == "ascii":
                    f.write("".join(" ".join(map(repr, row)) + "\n" for row in zip(*(c.tolist() for c in columns))).encode())
                else:
                    rows = np.empty(batch.num_rows, dtype)
                    for name, c in zip(dtype.names, columns):
                        rows[name] = c
                    f.write(rows.tobytes())
                n += batch.num_rows
        return _Part(place, where, n)

    def _head(self, points: int) -> bytes:
        names = " ".join(f.name for f in self.schema.fields)
        sizes, types = " ".join(str(s) for _, s in self.kinds), " ".join(t for t, _ in self.kinds)
        data = "binary_compressed" if self.data == "compressed" else self.data
        lines = ["# .PCD v0.7", "VERSION 0.7", f"FIELDS {names}", f"SIZE {sizes}", f"TYPE {types}", f"COUNT {' '.join('1' for _ in self.kinds)}", f"WIDTH {points}", "HEIGHT 1", "VIEWPOINT 0 0 0 1 0 0 0", f"POINTS {points}", f"DATA {data}"]
        return ("\n".join(lines) + "\n").encode()

    def commit(self, messages: list[_Part | None]) -> None:
        store, at = store_of(self.path)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.place)
        half = f"{at}.half-{self.run}"
        with store.open_output_stream(half) as out:
            out.write(self._head(sum(p.points for p in parts)))
            if self.data == "compressed":
                out.write(self._compressed(store, parts))
            else:
                for p in parts:
                    with store.open_input_stream(p.path) as f:
                        while some := f.read(COPY):
                            out.write(some)
        store.move(half, at)
        self._clear(store, at)

    def _compressed(self, store, parts: list[_Part]) -> bytes:
        """The format asks for one stream, column by column, with lengths of 32 bits: such a cloud is put together at once."""
        dtype = np.dtype([(f"f{i}", KINDS[k][0]) for i, k in enumerate(self.kinds)])
        bodies = []
        for p in parts:
            with store.open_input_stream(p.path) as f:
                bodies.append(np.frombuffer(f.read(), dtype))
        rows = np.concatenate(bodies) if bodies else np.empty(0, dtype)
        if rows.nbytes >= 1 << 31:
            raise ValueError("a compressed cloud holds under 2 GB: write binary data")
        body = b"".join(np.ascontiguousarray(rows[n]).tobytes() for n in dtype.names)
        small = packed(body)
        return np.array([len(small), len(body)], "<u4").tobytes() + small

    def abort(self, messages: list[_Part | None]) -> None:
        self._clear(*store_of(self.path))

    def _clear(self, store, at: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{at}.parts-{self.run}").type != fs.FileType.NotFound:
            store.delete_dir(f"{at}.parts-{self.run}")
