"""Files read in pieces: the elements of JSON arrays one by one, and digests of files of any size.

Both are Spark data sources with one partition for each file. A task holds one
piece of a file and one element, however large the file is. Files are opened
through pyarrow, so a path may name any store that it knows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes that are read at once, and rows of a batch.
PIECE, ROWS = 1 << 20, 1000
_MARK = re.compile(rb'["\[\]{},]')
_STRING_END = re.compile(rb'["\\]')
_BLANK = b" \t\r\n"


def _store(path: str) -> tuple[stores.FileSystem, str]:
    return stores.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (stores.LocalFileSystem(), path)


def found(path: str) -> list[str]:
    """The files at a path: itself, or those below a folder at any depth, without hidden ones, in order."""
    store, place = _store(path)
    info = store.get_file_info(place)
    if info.type == stores.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == stores.FileType.File:
        return [path]
    base = path.rstrip("/")
    inside = [f.path[len(place.rstrip("/")) :] for f in store.get_file_info(stores.FileSelector(place, recursive=True)) if f.type == stores.FileType.File]
    return sorted(base + p for p in inside if not any(part.startswith((".", "_")) for part in p.split("/")))


def pieces(path: str, size: int = PIECE) -> Iterator[bytes]:
    store, place = _store(path)
    with store.open_input_stream(place, compression=None) as f:
        while piece := f.read(size):
            yield piece


def elements(parts: Iterator[bytes]) -> Iterator[str | None]:
    """The elements of a JSON array as they stand, from its text in pieces; None where the text is no array or goes wrong, after which nothing follows.

    What lies inside an element is not looked at beyond its strings and brackets.
    """
    parts = iter(parts)
    buf, at, start, depth, opened, comma = b"", 0, 0, 0, False, False
    inside = False  # of a string
    while True:
        if inside:
            m = _STRING_END.search(buf, at)
            if m and (m[0] == b'"' or m.end() < len(buf)):
                inside, at = (False, m.end()) if m[0] == b'"' else (True, m.end() + 1)
                continue
            at = m.start() if m else len(buf)
        elif m := _MARK.search(buf, at):
            mark, at = m[0], m.end()
            if not opened:
                if mark != b"[" or buf[: m.start()].strip(_BLANK).removeprefix(b"\xef\xbb\xbf"):
                    yield None
                    return
                opened, depth, start = True, 1, at
            elif mark == b'"':
                inside = True
            elif mark in b"[{":
                depth += 1
            elif mark in b"]}" and depth > 1:
                depth -= 1
            elif depth == 1 and mark in b",]":
                text = buf[start : m.start()].strip(_BLANK)
                if not text and (mark == b"," or comma):
                    yield None
                    return
                if text:
                    try:
                        yield text.decode()
                    except UnicodeDecodeError:
                        yield None
                        return
                comma = mark == b","
                if mark == b"]":
                    rest = buf[at:].strip(_BLANK) or b"".join(p.strip(_BLANK)[:1] for p in parts)
                    if rest:
                        yield None
                    return
                buf, at, start = buf[at:], 0, 0
            elif depth == 1:
                yield None
                return
            continue
        else:
            at = len(buf)
        piece = next(parts, b"")
        if not piece:
            yield None  # it ends too early, or holds nothing
            return
        buf += piece


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> Sequence[InputPartition]:
        return [_File(f) for f in found(self.path)] or [_File("")]


class _Elements(_Reader):
    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for place, value in enumerate(elements(pieces(partition.path))) if partition.path else ():
            rows.append((partition.path, place if value is not None else None, value))
            size += len(value or "")
            if len(rows) >= ROWS or size >= PIECE:
                yield _batch(rows, ("file", pa.string()), ("place", pa.int64()), ("value", pa.string()))
                rows, size = [], 0
        if rows:
            yield _batch(rows, ("file", pa.string()), ("place", pa.int64()), ("value", pa.string()))


class _Digests(_Reader):
    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if partition.path:
            digest, length = hashlib.sha256(), 0
            for piece in pieces(partition.path):
                digest.update(piece)
                length += len(piece)
            yield _batch([(partition.path, length, digest.hexdigest())], ("path", pa.string()), ("length", pa.int64()), ("sha256", pa.string()))


def _batch(rows: list[tuple], *fields: tuple[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, (_, kind) in zip(zip(*rows), fields)], [n for n, _ in fields])


class JsonElements(DataSource):
    """file, place (from 0) and value of each element; a null place and value where a file is no array from there on."""

    @classmethod
    def name(cls) -> str:
        return "veldra_json_elements"

    def schema(self) -> str:
        return "file string, place long, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Elements(self.options["path"])


class FileDigests(DataSource):
    """path, length and SHA-256 of each file."""

    @classmethod
    def name(cls) -> str:
        return "veldra_file_digests"

    def schema(self) -> str:
        return "path string, length long, sha256 string"

    def reader(self, schema) -> DataSourceReader:
        return _Digests(self.options["path"])


def json_elements(spark: SparkSession, path: str) -> DataFrame:
    """The elements of the JSON arrays in a file, or in all files below a folder, as they stand. Elements before a fault are there; an empty array gives no rows."""
    spark.dataSource.register(JsonElements)
    return spark.read.format("veldra_json_elements").load(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """Path, length and SHA-256 of a file, or of all files below a folder."""
    spark.dataSource.register(FileDigests)
    return spark.read.format("veldra_file_digests").load(path)
