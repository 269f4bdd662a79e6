"""Runs of page, chunk and state files as a data source: batch and stream, both ways.

    register(spark)
    spark.read.format("quern_pages").load(root)                   # the newest crawl under root, or option("run", name)
    pages.write.format("quern_pages").mode("append").save(root)   # a new run, seen as a whole or not at all
    spark.readStream.format("quern_pages").load(root)             # each run once, when it is committed

A run is a folder under root. Who writes one through here marks it as open first; tasks write files of their own, and the
commit writes a list of them, after which the run is there. Files of tasks that failed or ran twice are on no list, and an
open run without a list is not looked at. A folder that another program wrote has neither mark: it counts with all its files
in a batch, and in a stream not at all, as nothing says when it is complete.

Besides a kind's fields a row has `file` (under root), `pos` (the byte where its text begins) and `failure`: what is no JSON
object is a row with a failure and no fields, and stops nothing else. Fields of another type than the schema's are null, as
are missing ones; a number or list in a text field is its JSON. Lone surrogates become U+FFFD. An empty file is a failure;
empty lines are none. A schema that names some columns only makes those. A task reads one file, or a stretch of a large
file of lines, and makes batches bounded in bytes. Files are reached through Arrow's file systems: local, HDFS, S3 and GCS.
"""

from __future__ import annotations

import io
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, DataType, FractionalType, IntegerType, IntegralType, StringType, StructType

from quern.config import run_name
from quern.operators.crawl import STATE
from quern.sources.files import CHUNK, PAGE

LIST, OPEN = "_committed.json", "_open"
PLACE = "file string, pos long, failure string"
#: Bytes of a file of lines that a task reads, and of texts that a batch holds before it is closed.
STRETCH, BATCH_BYTES = 128 << 20, 16 << 20
#: Rows of a written file.
PER_FILE = 1000
#: Nanoseconds by which a run may be seen later than its list's time says.
SLACK = 3600 * 10**9


@dataclass(frozen=True)
class Piece(InputPartition):
    """A file under root, as a whole or its lines that begin in [start, end); chunks may be nested in its objects."""

    file: str
    start: int = 0
    end: int | None = None
    nested: bool = False


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    rows: int


def store_of(root: str) -> tuple[stores.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    scheme, mark, rest = root.partition("://")
    if mark and scheme != "file":
        return stores.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}".rstrip("/"))
    path = root.removeprefix("file:") if root.startswith("file:") else root
    return stores.LocalFileSystem(), os.path.abspath("/" + path.lstrip("/") if root.startswith("file:") else path)


def write_files(rows: DataFrame, root: str) -> int:
    """Write each of rows (name, value), whose names are distinct, to a file of its own in root; the number of files.

    All lie in one folder, written by the tasks where they stay: neither a folder for each nor a move by the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = store_of(root)
        for batch in batches:
            for name, value in zip(batch.column("name").to_pylist(), batch.column("value").to_pylist()):
                with fs.open_output_stream(f"{folder}/{name}") as out:
                    out.write(value.encode())
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    fs, folder = store_of(root)
    fs.create_dir(folder, recursive=True)
    return rows.select("name", "value").mapInArrow(run, "n long").agg({"n": "sum"}).first()[0] or 0


def _exists(fs: stores.FileSystem, path: str) -> bool:
    return fs.get_file_info(path).type != stores.FileType.NotFound


def _put(fs: stores.FileSystem, path: str, value: object) -> None:
    """A small JSON file, there as a whole or not at all."""
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(json.dumps(value, sort_keys=True).encode())
    fs.move(part, path)


def committed(fs: stores.FileSystem, root: str, prefix: str, foreign: bool = False) -> list[tuple[int, str]]:
    """(time, name) of runs, oldest first: those with a list by its time, and foreign ones, if asked for, by their folder's."""
    out = []
    for d in fs.get_file_info(stores.FileSelector(root, allow_not_found=True)):
        if d.type == stores.FileType.Directory and d.base_name.startswith(prefix):
            listed, begun = fs.get_file_info([f"{d.path}/{LIST}", f"{d.path}/{OPEN}"])
            if listed.type == stores.FileType.File:
                out.append((listed.mtime_ns or 0, d.base_name))
            elif foreign and begun.type == stores.FileType.NotFound:
                out.append((d.mtime_ns or 0, d.base_name))
    return sorted(out)


def _plain(text: str) -> str:
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def conform(value: object, kind: DataType) -> object:
    """A JSON value as one of a column's type; null where it is of another."""
    if value is None:
        return None
    if isinstance(kind, StringType):
        return _plain(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False))
    if isinstance(kind, BooleanType):
        return value if isinstance(value, bool) else None
    if isinstance(kind, ArrayType):
        return [conform(x, kind.elementType) for x in value] if isinstance(value, list) else None
    if isinstance(kind, StructType):
        return {f.name: conform(value.get(f.name), f.dataType) for f in kind} if isinstance(value, dict) else None
    if not isinstance(value, (int, float)) or isinstance(value, bool):
        return None
    if isinstance(kind, FractionalType):
        return float(value)
    if not isinstance(value, int) or not isinstance(kind, IntegralType):
        return None
    bits = 31 if isinstance(kind, IntegerType) else 63
    return value if -(1 << bits) <= value < 1 << bits else None


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON")


def _object(raw: bytes) -> dict | None:
    try:
        value = json.loads(raw.decode(), parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _lines(fs: stores.FileSystem, path: str, start: int, end: int | None) -> Iterator[tuple[int, bytes]]:
    with fs.open_input_file(path) as raw, io.BufferedReader(raw, 1 << 20) as f:
        at = start
        if start:
            f.seek(start - 1)
            at = start - 1 + len(f.readline())
        while (end is None or at < end) and (line := f.readline()):
            if line.strip():
                yield at, line
            at += len(line)


def _objects(fs: stores.FileSystem, path: str, piece: Piece) -> Iterator[tuple[int, dict | None]]:
    """(place, object or None): of each line, if the first one is an object or the piece is a stretch of lines; else of the file as a whole."""
    rows = _lines(fs, path, piece.start, piece.end)
    if piece.end is None:
        first = next(rows, None)
        if first is None or _object(first[1]) is None:
            rows.close()
            with fs.open_input_stream(path) as f:
                yield 0, _object(f.read())
            return
        yield first[0], _object(first[1])
    for at, line in rows:
        yield at, _object(line)


def _records(fs: stores.FileSystem, root: str, piece: Piece, what: str) -> Iterator[tuple[dict, int]]:
    """(record with place and failure, bytes of its text or so)."""
    for at, found in _objects(fs, f"{root}/{piece.file}", piece):
        place = {"file": piece.file, "pos": at}
        if found is None:
            yield {**place, "failure": f"not a JSON {what}"}, 64
        elif not piece.nested:
            yield {**found, **place, "failure": None}, sum(len(v) for v in found.values() if isinstance(v, (str, list)))
        else:
            inner = found.get("chunks")
            for chunk in inner if isinstance(inner, list) else []:
                if isinstance(chunk, dict):
                    yield {**chunk, "document_id": chunk.get("document_id") or found.get("document_id"), **place, "failure": None}, len(str(chunk.get("text", "")))


class _Reading:
    """What batch and stream readers share: a piece becomes batches of the asked columns."""

    def __init__(self, source: Runs, schema: StructType):
        self.root, self.run, self.schema, self.source = source.options["path"], source.options.get("run"), schema, type(source)

    def read(self, piece: Piece | None) -> Iterator[pa.RecordBatch]:
        if piece is None:  # what Spark asks for where there are no pieces
            return
        fs, root = store_of(self.root)
        arrow, held, size = to_arrow_schema(self.schema), [], 0
        for record, width in _records(fs, root, piece, self.source.what):
            held.append(conform(record, self.schema))
            size += width + 64
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(held, arrow)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, arrow)

    def pieces(self, fs: stores.FileSystem, root: str, run: str) -> list[Piece]:
        """A piece a file, of large files of lines one a stretch: of the run's list, or of the first of the kind's places that is there."""
        if _exists(fs, listing := f"{root}/{run}/{LIST}"):
            with fs.open_input_stream(listing) as f:
                names = json.loads(f.read())["files"]
            return [p for info, name in zip(fs.get_file_info([f"{root}/{n}" for n in names]), names) for p in self._cut(name, info.size)]
        for place, lined, nested in self.source.places:
            at = fs.get_file_info(f"{root}/{run}/{place}" if place else f"{root}/{run}")
            if at.type == stores.FileType.NotFound:
                continue
            inside = [at] if at.type == stores.FileType.File else fs.get_file_info(stores.FileSelector(at.path))
            kept = sorted((i.path, i.size) for i in inside if i.type == stores.FileType.File and i.base_name[0] not in "._" and (lined or i.base_name.endswith(".json")))
            names = [(path[len(root) + 1 :], size) for path, size in kept]
            return [p for n, size in names for p in (self._cut(n, size) if lined else [Piece(n, nested=nested)])]
        raise FileNotFoundError(f"no {self.source.what} files in {root}/{run}")

    @staticmethod
    def _cut(name: str, size: int) -> list[Piece]:
        return [Piece(name, i, min(i + STRETCH, size)) for i in range(0, size, STRETCH)]


class RunReader(_Reading, DataSourceReader):
    """The named run, or the newest one; without any, files that lie in root itself, where the kind allows that, or nothing."""

    def partitions(self) -> list[Piece]:
        fs, root = store_of(self.root)
        if self.run is not None:
            if _exists(fs, f"{root}/{self.run}/{OPEN}") and not _exists(fs, f"{root}/{self.run}/{LIST}"):
                raise FileNotFoundError(f"{root}/{self.run} is not complete")
            return self.pieces(fs, root, self.run)
        if runs := committed(fs, root, self.source.prefix, foreign=True):
            return self.pieces(fs, root, runs[-1][1])
        if self.source.needs_run:
            raise FileNotFoundError(f"no {self.source.prefix} folder under {root}")
        inside = fs.get_file_info(stores.FileSelector(root, allow_not_found=True))
        return [Piece(i.base_name) for i in sorted(inside, key=lambda i: i.path) if i.type == stores.FileType.File and i.base_name.endswith(".json")]


class RunStreamReader(_Reading, DataSourceStreamReader):
    """Committed runs, each once.

    An offset is the time of the newest run and the names of those of the hour before it, so that one that is seen late, or
    whose writer's clock is behind by less than that, is not passed over. What is older counts as read.
    """

    def initialOffset(self) -> dict:
        return {"time": 0, "names": []}

    def latestOffset(self) -> dict:
        fs, root = store_of(self.root)
        runs = committed(fs, root, self.source.prefix)
        last = runs[-1][0] if runs else 0
        return {"time": last, "names": [n for at, n in runs if at > last - SLACK]}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        fs, root = store_of(self.root)
        upto = lambda at, name, mark: at <= mark["time"] - SLACK or name in mark["names"]
        new = [n for at, n in committed(fs, root, self.source.prefix) if upto(at, n, end) and not upto(at, n, start)]
        return [p for name in new for p in self.pieces(fs, root, name)]


class _Writing:
    """What batch and stream writers share: a task's rows become files of its own under a folder that is marked as open."""

    def __init__(self, source: Runs, folder: str):
        self.uri, self.folder, self.place = source.options["path"], folder, source.places[0][0]
        fs, root = store_of(self.uri)
        fs.create_dir(f"{root}/{folder}/{self.place}", recursive=True)
        with fs.open_output_stream(f"{root}/{folder}/{OPEN}") as f:
            f.write(b"{}")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = store_of(self.uri)
        out, rows, f = Written([], 0), 0, None
        try:
            for batch in batches:
                for i in range(batch.num_rows):
                    if f is None:
                        out.files.append(f"{self.folder}/{self.place}/part-{uuid.uuid4().hex}.json")
                        f, rows = fs.open_output_stream(f"{root}/{out.files[-1]}"), 0
                    (row,) = batch.slice(i, 1).to_pylist()
                    f.write(json.dumps({k: v for k, v in row.items() if v is not None}, ensure_ascii=False, default=str).encode() + b"\n")
                    rows, out.rows = rows + 1, out.rows + 1
                    if rows == PER_FILE:
                        f.close()
                        f = None
        finally:
            if f is not None:
                f.close()
        return out

    def _list(self, run: str, messages: list[Written | None]) -> None:
        fs, root = store_of(self.uri)
        done = [m for m in messages if m is not None]
        fs.create_dir(f"{root}/{run}", recursive=True)
        _put(fs, f"{root}/{run}/{LIST}", {"files": sorted(n for m in done for n in m.files), "rows": sum(m.rows for m in done)})

    def _drop(self, messages: list[Written | None]) -> None:
        fs, root = store_of(self.uri)
        for m in messages:
            for name in m.files if m is not None else []:
                if _exists(fs, f"{root}/{name}"):
                    fs.delete_file(f"{root}/{name}")


class RunWriter(_Writing, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self._list(self.folder, messages)

    def abort(self, messages: list[Written | None]) -> None:
        self._drop(messages)


class RunStreamWriter(_Writing, DataSourceStreamArrowWriter):
    """A run a batch, named by the stream and the batch's number: a batch that comes again after its commit changes nothing."""

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        fs, root = store_of(self.uri)
        run = f"{self.folder}_{batchId:010d}"
        if _exists(fs, f"{root}/{run}/{LIST}"):
            self._drop(messages)
        else:
            self._list(run, messages)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self._drop(messages)


class Runs(DataSource):
    """A kind of files: its runs' prefix, and the places in a run where they may be as (folder or file, lines, nested)."""

    what, prefix, fields, needs_run = "", "", "", False
    places: tuple[tuple[str, bool, bool], ...] = ()

    @classmethod
    def name(cls) -> str:
        return f"quern_{cls.what}s"

    def schema(self) -> str:
        return f"{self.fields}, {PLACE}"

    def reader(self, schema: StructType) -> RunReader:
        return RunReader(self, schema)

    def streamReader(self, schema: StructType) -> RunStreamReader:
        return RunStreamReader(self, schema)

    def writer(self, schema: StructType, overwrite: bool) -> RunWriter:
        """Under option run, or a new name. A run is written once: overwriting is an error, as is a run that is there."""
        run = self.options.get("run") or f"{run_name(self.prefix.rstrip('_'))}_{uuid.uuid4().hex[:8]}"
        fs, root = store_of(self.options["path"])
        if overwrite or _exists(fs, f"{root}/{run}/{LIST}"):
            raise FileExistsError(f"{root}/{run} can't be written again")
        return RunWriter(self, run)

    def streamWriter(self, schema: StructType, overwrite: bool) -> RunStreamWriter:
        """Under option stream, a name that stays with the stream's checkpoint."""
        return RunStreamWriter(self, self.prefix + self.options["stream"])


class Pages(Runs):
    what, prefix, fields = "page", "crawl_", PAGE
    places = (("pages", False, False),)


class Chunks(Runs):
    what, prefix, fields, needs_run = "chunk", "process_", CHUNK, True
    places = (("chunks.jsonl", True, False), ("documents", False, True))


class States(Runs):
    what, prefix, fields = "state", "state_", STATE
    places = (("urls", True, False),)


def register(spark: SparkSession) -> None:
    """The formats quern_pages, quern_chunks and quern_states, in this session."""
    for kind in (Pages, Chunks, States):
        spark.dataSource.register(kind)
