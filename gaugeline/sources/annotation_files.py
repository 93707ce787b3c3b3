"""A Spark data source for folders of many small annotation files: ``<camera>/.../<name>.<suffix>``.

The reader lists the tree once, drops files by the filters that Spark pushes down, and packs what is left into tasks by
bytes; each file also costs ``openBytes``, so that a million files of forty bytes are still dealt over many tasks.  Line
files beyond a task's share are cut into byte ranges, and a line belongs to the range that its first byte is in.  The tree
is listed level by level; a level of more than ``driverFolders`` folders is not opened by the driver: its folders are dealt
to tasks, each of which lists and reads what lies in its own, whole files only.  The writer puts every row into the file
it names; a task that runs again writes the same files again.

Options: ``path``; ``kind`` (``listing`` reads no contents and has null values, ``lines`` gives one row per line, ``text``
one row per file); ``taskBytes``, ``openBytes`` and ``driverFolders``.  Paths may carry any scheme that ``pyarrow.fs`` knows.  Names with a
leading dot or underscore are left out.  Bytes that are not UTF-8 are replaced.  Folders without files give no rows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringEndsWith, StringStartsWith, WriterCommitMessage,
)

NAME = "annotation_files"
SCHEMA = "camera string, rel_path string, suffix string, length bigint, modified timestamp, value string"
KINDS = ("listing", "lines", "text")
TASK_BYTES = 32 << 20
OPEN_BYTES = 64 << 10
BATCH_ROWS, BATCH_BYTES = 8192, 4 << 20
READ_BYTES = 1 << 20
#: Folders of one level that the driver lists itself; tasks that the folders of a wider level are dealt to, about, from the least to the most.
DRIVER_FOLDERS, FOLDER_TASKS = 4096, (128, 2048)


def open_root(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


def describe(rel_path: str) -> dict[str, str]:
    """The columns that come from a path alone; filters on them need no file."""
    suffix = re.search(r"\.([A-Za-z0-9]+)$", rel_path)
    return {"camera": re.sub("^[a-z]+=", "", rel_path.split("/")[0]), "rel_path": rel_path, "suffix": suffix[1].lower() if suffix else ""}


@dataclass(frozen=True)
class Piece:
    """A file, or the bytes from `start` to `end` of one."""

    rel_path: str
    length: int
    modified: object
    start: int
    end: int


@dataclass
class Pack(InputPartition):
    pieces: tuple[Piece, ...]
    folders: tuple[str, ...] = ()


def cut(piece: Piece, most: int) -> list[Piece]:
    starts = range(0, max(piece.length, 1), most)
    return [Piece(piece.rel_path, piece.length, piece.modified, s, min(s + most, piece.length)) for s in starts]


def pack(pieces: list[Piece], most: int, open_bytes: int) -> list[Pack]:
    """Tasks in the order of paths, each filled until the next piece would go over its share."""
    packs, held, filled = [], [], 0
    for piece in pieces:
        cost = piece.end - piece.start + open_bytes
        if held and filled + cost > most:
            packs.append(Pack(tuple(held)))
            held, filled = [], 0
        held.append(piece)
        filled += cost
    return packs + [Pack(tuple(held))]


def deal(folders: list[str], least: int) -> list[Pack]:
    """Tasks of neighbouring folders: of `least` each, of up to four times that once there are tasks for many cores, then of more."""
    few, many = FOLDER_TASKS
    share = max(1, least, min(4 * least, len(folders) // few), -(-len(folders) // many))
    return [Pack((), tuple(folders[i:i + share])) for i in range(0, len(folders), share)]


def understood(condition: Filter) -> tuple[str, str, tuple] | None:
    """(column, relation, values) of a filter that a path alone answers, else null."""
    relations = {EqualTo: "in", In: "in", StringStartsWith: "starts", StringEndsWith: "ends", IsNotNull: "known"}
    relation = relations.get(type(condition))
    column = condition.attribute[0] if relation and len(condition.attribute) == 1 else None
    if column not in ("camera", "rel_path", "suffix"):
        return None
    value = getattr(condition, "value", None)
    return column, relation, tuple(value) if isinstance(value, (list, tuple)) else (value,)


def holds(columns: dict[str, str], tests: list[tuple[str, str, tuple]]) -> bool:
    relations = {
        "in": lambda have, wanted: have in wanted, "starts": lambda have, wanted: have.startswith(wanted),
        "ends": lambda have, wanted: have.endswith(wanted), "known": lambda have, wanted: True,
    }
    return all(relations[relation](columns[column], values) for column, relation, values in tests)


def lines_of(stream, start: int, end: int) -> Iterator[bytes]:
    """Lines whose first byte is in [start, end), read in blocks."""
    at, rest = start, b""
    if start:
        # the byte before tells whether a line begins here
        stream.seek(start - 1)
        at = start - 1
        while True:
            block = stream.read(READ_BYTES)
            cut_at = block.find(b"\n")
            if not block:
                return
            if cut_at >= 0:
                at, rest = at + cut_at + 1, block[cut_at + 1:]
                break
            at += len(block)
            if at >= end:
                return
    else:
        stream.seek(0)
    while at < end:
        cut_at = rest.find(b"\n")
        parts = [rest]
        while cut_at < 0:
            block = stream.read(READ_BYTES)
            if not block:
                break
            cut_at = block.find(b"\n")
            parts.append(block)
        whole = b"".join(parts)
        if cut_at < 0:
            if whole:
                yield whole.removesuffix(b"\r")
            return
        line_end = len(whole) - len(parts[-1]) + cut_at
        yield whole[:line_end].removesuffix(b"\r")
        at, rest = at + line_end + 1, whole[line_end + 1:]


def lines_of_whole(data: bytes) -> list[str]:
    """Lines of a file that is held whole."""
    lines = data.split(b"\n")
    if not lines[-1]:
        lines.pop()
    if b"\r" in data:
        lines = [line.removesuffix(b"\r") for line in lines]
    return [line.decode("utf-8", "replace") for line in lines]


class AnnotationReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.kind = options.get("kind", "listing")
        self.task_bytes, self.open_bytes = int(options.get("taskBytes", TASK_BYTES)), int(options.get("openBytes", OPEN_BYTES))
        self.driver_folders = int(options.get("driverFolders", DRIVER_FOLDERS))
        self.tests: list[tuple[str, str, tuple]] = []
        if self.kind not in KINDS:
            raise ValueError(f"kind must be one of {', '.join(KINDS)}")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for condition in filters:
            test = understood(condition)
            if test is None:
                yield condition
            else:
                self.tests.append(test)

    def listed(self, files, root: str, folder: str, recursive: bool) -> tuple[list[Piece], list[str]]:
        """The files in a folder that pass the filters, and the folders in it whose files may."""
        from pyarrow import fs

        kept, below, tests = [], [], [test for test in self.tests if test[0] == "camera"]
        for info in files.get_file_info(fs.FileSelector(f"{root}/{folder}".rstrip("/") or "/", recursive=recursive)):
            rel_path = info.path[len(root):].lstrip("/")
            if any(part[:1] in "._" for part in rel_path.split("/")):
                continue
            if info.type == fs.FileType.File and (not self.tests or holds(describe(rel_path), self.tests)):
                kept.append(Piece(rel_path, info.size, info.mtime, 0, info.size))
            elif info.type == fs.FileType.Directory and (not tests or holds(describe(rel_path), tests)):
                below.append(rel_path)
        kept.sort(key=lambda piece: piece.rel_path)
        return kept, below

    def partitions(self) -> list[Pack]:
        files, root = open_root(self.root)
        kept, level = [], [""]
        while level and len(level) <= self.driver_folders:
            found = [self.listed(files, root, folder, False) for folder in level]
            kept += [piece for pieces, _ in found for piece in pieces]
            level = [folder for _, folders in found for folder in folders]
        kept.sort(key=lambda piece: piece.rel_path)
        if self.kind == "lines":
            kept = [part for piece in kept for part in cut(piece, self.task_bytes)]
        elif self.kind == "listing":
            kept = [Piece(piece.rel_path, piece.length, piece.modified, 0, 0) for piece in kept]
        apart = deal(sorted(level), self.task_bytes // (self.open_bytes or OPEN_BYTES))
        return apart + pack(kept, self.task_bytes, self.open_bytes) if kept or not apart else apart

    def values(self, files, root: str, piece: Piece) -> Iterator[list[str | None]]:
        if self.kind == "listing":
            yield [None]
            return
        with files.open_input_file(f"{root}/{piece.rel_path}") as stream:
            if self.kind == "text":
                yield [stream.read().decode("utf-8", "replace")]
            elif piece.start == 0 and piece.end == piece.length <= READ_BYTES:
                yield lines_of_whole(stream.read(piece.length))
            else:
                for line in lines_of(stream, piece.start, piece.end):
                    yield [line.decode("utf-8", "replace")]

    def read(self, partition: Pack) -> Iterator:
        import numpy as np
        import pyarrow as pa

        text = pa.string()
        schema = pa.schema([
            ("camera", text), ("rel_path", text), ("suffix", text), ("length", pa.int64()), ("modified", pa.timestamp("us", tz="UTC")), ("value", text),
        ])
        files, root = open_root(self.root)

        def pieces() -> Iterator[Piece]:
            yield from partition.pieces
            for folder in partition.folders:
                yield from self.listed(files, root, folder, True)[0]

        def batch() -> pa.RecordBatch:
            """What is held, the columns of a file once per value."""
            of = pa.RecordBatch.from_pylist([describe(p.rel_path) | {"length": p.length, "modified": p.modified} for p in held], schema=schema.remove(5))
            of = of.take(pa.array(np.repeat(np.arange(len(held)), counts)))
            return pa.RecordBatch.from_arrays([*of.columns, pa.array(values, text)], schema=schema)

        held, counts, values, size = [], [], [], 0
        for piece in pieces():
            held.append(piece)
            counts.append(0)
            for found in self.values(files, root, piece):
                counts[-1] += len(found)
                values += found
                size += sum(map(len, filter(None, found)))
                if len(values) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield batch()
                    held, counts, values, size = [piece], [0], [], 0
        if values:
            yield batch()


class AnnotationWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        files, root = open_root(self.root)
        made = set()
        for batch in iterator:
            for rel_path, value in zip(batch.column("rel_path").to_pylist(), batch.column("value").to_pylist()):
                if not rel_path or rel_path.startswith("/") or ".." in rel_path.split("/"):
                    raise ValueError(f"not a path below the root: {rel_path!r}")
                folder, _, name = f"{root}/{rel_path}".rpartition("/")
                if folder not in made:
                    files.create_dir(folder, recursive=True)
                    made.add(folder)
                # hidden until whole; the second run of a task replaces what the first one left
                part = f"{folder}/.{name}.{uuid.uuid4().hex[:8]}"
                with files.open_output_stream(part) as stream:
                    stream.write((value or "").encode("utf-8"))
                files.move(part, f"{folder}/{name}")
        return WriterCommitMessage()


class AnnotationFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> AnnotationReader:
        return AnnotationReader(self.options)

    def writer(self, schema, overwrite: bool) -> AnnotationWriter:
        if overwrite:
            raise ValueError("files are replaced one by one: write with mode append")
        return AnnotationWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets Spark push filters into sources written in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(AnnotationFiles)


def read_files(spark: SparkSession, root: str, kind: str, **options: int) -> DataFrame:
    register(spark)
    return spark.read.format(NAME).options(kind=kind, **options).load(root)


def write_files(spark: SparkSession, rows: DataFrame, root: str) -> None:
    """One file per row: `rel_path` names it below the root, `value` is its text (null: empty). A task writes in the order of paths."""
    register(spark)
    rows.select("rel_path", "value").sortWithinPartitions("rel_path").write.format(NAME).mode("append").save(root)
