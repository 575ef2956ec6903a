"""File formats that Spark has no reader for, as Python data sources: spark.read.format(<name>).load(<folder>).

    loomtext_charset      path, text                          option charset (shift_jis)
    loomtext_safetensors  path, name, dtype, shape, data
    loomtext_npy          path, row, values                   two dimensions, numbers, rows as they lie in the file
    loomtext_float32      path, row, values                   option width; little-endian, no header

Files are found by PyArrow's file systems at and below the folder (or the one file), in name order; what begins with a dot or
an underscore is passed over. Each file is a partition; those of fixed row size are cut into ranges of rows of `split` bytes
(64 MB). Filters on path are pushed down to the list of files. The same formats write: loomtext_charset (path, text) and
loomtext_npy (path, values; one file for each path, of rows that come together). A task writes to names that
readers pass over; when all tasks have ended, the driver moves them into place, and removes them if the job fails.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from loomtext.sources.formats import parse_safetensors

SPLIT = 64 << 20


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@dataclass
class Rows(InputPartition):
    path: str
    first: int = 0
    count: int = -1
    start: int = 0  # byte where row `first` begins
    width: int = 0
    dtype: str = ""


class _Reader(DataSourceReader):
    """Lists files, with filters on their paths; a format says how a file is cut and read."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)
        self.tests: list = []

    def pushFilters(self, filters):
        for f in filters:
            known = getattr(f, "attribute", None) == ("path",)
            if known and isinstance(f, EqualTo):
                self.tests.append(("in", (f.value,)))
            elif known and isinstance(f, In):
                self.tests.append(("in", tuple(f.value)))
            elif known and isinstance(f, StringStartsWith):
                self.tests.append(("starts", f.value))
            elif known and isinstance(f, StringEndsWith):
                self.tests.append(("ends", f.value))
            elif known and isinstance(f, StringContains):
                self.tests.append(("contains", f.value))
            elif not (known and isinstance(f, IsNotNull)):
                yield f

    def wanted(self, path: str) -> bool:
        check = {"in": lambda v: path in v, "starts": path.startswith, "ends": path.endswith, "contains": lambda v: v in path}
        return all(check[kind](value) for kind, value in self.tests)

    def files(self) -> list[tuple[str, int]]:
        from pyarrow import fs

        system, root = _system(self.options["path"])
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        shown = lambda p: not any(x.startswith((".", "_")) for x in p[len(root) :].split("/"))
        return sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and shown(x.path) and self.wanted(x.path))

    def open(self, path: str):
        return _system(self.options["path"])[0].open_input_file(path)

    def partitions(self) -> list[Rows]:
        return [p for path, size in self.files() for p in self.cut(path, size)] or [Rows("")]

    def cut(self, path: str, size: int) -> list[Rows]:
        return [Rows(path)]

    def read(self, partition: Rows) -> Iterator:
        return self.rows(partition) if partition.path else iter(())

    def ranges(self, path: str, rows: int, start: int, width: int, dtype: np.dtype) -> list[Rows]:
        step = max(1, int(self.options.get("split", SPLIT)) // max(1, width * dtype.itemsize))
        return [Rows(path, k, min(step, rows - k), start + k * width * dtype.itemsize, width, dtype.str) for k in range(0, rows, step)]

    def numbers(self, p: Rows) -> Iterator:
        """Record batches of path, row and values, some thousand rows at a time."""
        import pyarrow as pa

        size, step = np.dtype(p.dtype).itemsize * p.width, max(1, (4 << 20) // max(1, 4 * p.width))
        with self.open(p.path) as f:
            f.seek(p.start)
            for k in range(0, p.count, step):
                n = min(step, p.count - k)
                x = np.frombuffer(f.read(n * size), p.dtype).astype(np.float32)
                if len(x) != n * p.width:
                    raise ValueError(f"{p.path} ends inside row {p.first + k + len(x) // max(1, p.width)}")
                values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * p.width), pa.array(x))
                yield pa.RecordBatch.from_arrays([pa.array([p.path] * n), pa.array(np.arange(p.first + k, p.first + k + n)), values], names=["path", "row", "values"])


class _CharsetReader(_Reader):
    def rows(self, p: Rows) -> Iterator:
        with self.open(p.path) as f:
            yield p.path, f.read().decode(self.options.get("charset", "shift_jis"))


class _SafetensorsReader(_Reader):
    def rows(self, p: Rows) -> Iterator:
        with self.open(p.path) as f:
            content = f.read()
        for tensor in parse_safetensors(content):
            yield p.path, *tensor


class _NpyReader(_Reader):
    def cut(self, path: str, size: int) -> list[Rows]:
        with self.open(path) as f:
            version = np.lib.format.read_magic(f)
            read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}
            if version not in read:
                raise ValueError(f"{path} has format {version}")
            shape, by_column, dtype = read[version](f)
            start = f.tell()
        if len(shape) != 2 or by_column or dtype.kind not in "fiu":
            raise ValueError(f"{path} is {shape} of {dtype}, by column: {by_column}; rows of numbers are read")
        if size != start + shape[0] * shape[1] * dtype.itemsize:
            raise ValueError(f"{path} has {size} bytes, not those of {shape} of {dtype}")
        return self.ranges(path, shape[0], start, shape[1], dtype)

    rows = _Reader.numbers


class _Float32Reader(_Reader):
    def cut(self, path: str, size: int) -> list[Rows]:
        width = int(self.options["width"])
        if size % (4 * width):
            raise ValueError(f"{path} has {size} bytes, which are no rows of {width} numbers")
        return self.ranges(path, size // (4 * width), 0, width, np.dtype("<f4"))

    rows = _Reader.numbers


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]] = field(default_factory=list)


class _Writer(DataSourceWriter):
    """Writes files under names that begin with a dot, and moves them when all are there."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)

    def target(self, name: str) -> tuple[str, str]:
        root = _system(self.options["path"])[1].rstrip("/")
        if name.startswith(("/", ".", "_")) or "/." in name or "/_" in name:
            raise ValueError(f"{name} is no name that is read again")
        folder, _, last = f"{root}/{name}".rpartition("/")
        return f"{folder}/.{uuid.uuid4().hex}-{last}", f"{root}/{name}"

    def save(self, name: str, chunks: list[bytes], done: Written) -> None:
        system, draft, final = _system(self.options["path"])[0], *self.target(name)
        system.create_dir(draft.rpartition("/")[0], recursive=True)
        with system.open_output_stream(draft) as f:
            for x in chunks:
                f.write(x)
        done.moves.append((draft, final))

    def commit(self, messages) -> None:
        system = _system(self.options["path"])[0]
        moves = [m for x in messages if x for m in x.moves]
        if len({final for _, final in moves}) < len(moves):
            self.abort(messages)
            raise ValueError("two tasks wrote the same file; rows of a file have to come together")
        for draft, final in moves:
            system.move(draft, final)

    def abort(self, messages) -> None:
        system = _system(self.options["path"])[0]
        for draft in (d for x in messages if x for d, _ in x.moves):
            system.delete_file(draft)


class _CharsetWriter(_Writer):
    def write(self, iterator) -> Written:
        done = Written()
        for row in iterator:
            self.save(row["path"], [(row["text"] or "").encode(self.options.get("charset", "shift_jis"))], done)
        return done


class _NpyWriter(_Writer):
    def write(self, iterator) -> Written:
        done, name, rows = Written(), None, []

        def close() -> None:
            import io

            if name is not None:
                head, x = io.BytesIO(), np.array(rows, "<f4")
                np.lib.format.write_array_header_1_0(head, np.lib.format.header_data_from_array_1_0(x))
                self.save(name, [head.getvalue(), x.tobytes()], done)

        for row in iterator:
            if row["path"] != name:
                close()
                name, rows = row["path"], []
            rows.append(np.asarray(row["values"], "<f4"))
        close()
        return done


class _Source(DataSource):
    format = fields = ""
    reads: type[_Reader]
    writes: type[_Writer] | None = None

    @classmethod
    def name(cls) -> str:
        return cls.format

    def schema(self) -> str:
        return self.fields

    def reader(self, schema) -> _Reader:
        return self.reads(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        if self.writes is None:
            raise ValueError(f"{self.format} is read only")
        return self.writes(self.options)


class Charset(_Source):
    format, fields, reads, writes = "loomtext_charset", "path string, text string", _CharsetReader, _CharsetWriter


class Safetensors(_Source):
    format, fields, reads = "loomtext_safetensors", "path string, name string, dtype string, shape array<long>, data binary", _SafetensorsReader


class Npy(_Source):
    format, fields, reads, writes = "loomtext_npy", "path string, row long, values array<float>", _NpyReader, _NpyWriter


class Float32(_Source):
    format, fields, reads = "loomtext_float32", "path string, row long, values array<float>", _Float32Reader


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, and have it push filters down to them."""
    for source in (Charset, Safetensors, Npy, Float32):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
