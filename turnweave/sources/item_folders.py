"""A data source for folders ``<root>/<item>/`` with the documents ``timeline.json`` and ``convert_info.json``.

Spark names the files of its own writers itself, so exact names need a writer of their own. Rows are pieces of documents in
their order: the writer appends piece after piece to the open file, so a document of any length takes the memory of one piece.

A write has two phases. Tasks write below a hidden staging folder, each attempt in a folder of its own; the commit
records the attempts that count, an abort removes the staging folder. ``publish`` then moves the items of committed attempts
to their places in a distributed job that can be run again after a failure: what has been moved is no longer staged.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT = "item_folders"
COMMITTED = "_committed.json"
DOCUMENTS = ("timeline", "convert_info")
ITEMS_PER_TASK = 500
PIECES = "item_id string, document string, piece bigint, text string"
READ = "item_id string, document string, document_path string, modified_at timestamp, text string"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _folder_name(item: str) -> str:
    """The id itself, but for what would make another folder of it or hide it."""
    if not item:
        raise ValueError("An item without an id has no folder.")
    name = item.replace("%", "%25").replace("/", "%2F")
    return f"%2E{name[1:]}" if name.startswith(".") else name


class ItemFolders(DataSource):
    """``path`` is the root; a write also needs ``staging``, the name of its hidden folder below the root.

    A read gives both documents of items that hold both. With ``first``, a list of files separated by commas, it gives of
    every item the first of these files that exists, by its place below the item.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> DataSourceReader:
        first = self.options.get("first")
        return _FirstReader(self.options["path"], first.split(",")) if first else _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(f"{self.options['path'].rstrip('/')}/{self.options['staging']}")


@dataclass
class Attempt(WriterCommitMessage):
    folder: str
    documents: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, staging: str):
        self.staging = staging

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        files, root = _opened(self.staging)
        task = TaskContext.get()
        attempt = f"{task.partitionId()}-{task.taskAttemptId()}"
        held, out, documents = None, None, 0
        try:
            for batch in iterator:
                items, names, _, texts = (column.to_pylist() for column in batch.columns)
                for item, name, text in zip(items, names, texts):
                    if (item, name) != held:
                        if out is not None:
                            out.close()
                        folder = f"{root}/{attempt}/{_folder_name(item)}"
                        files.create_dir(folder, recursive=True)
                        out, held, documents = files.open_output_stream(f"{folder}/{name}.json"), (item, name), documents + 1
                    out.write(text.encode())
        finally:
            if out is not None:
                out.close()
        return Attempt(attempt, documents)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = _opened(self.staging)
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/{COMMITTED}") as out:
            out.write(json.dumps([m.folder for m in messages if m is not None and m.documents]).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        _removed(self.staging)


@dataclass
class _Names(InputPartition):
    names: list[str]


class _Reader(DataSourceReader):
    """One row per document of every item that holds both documents and is not hidden."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        files, root = _opened(self.path)
        names = sorted(f.base_name for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.type == fs.FileType.Directory)
        names = [n for n in names if not n.startswith(".")]
        return [_Names(names[k : k + ITEMS_PER_TASK]) for k in range(0, len(names), ITEMS_PER_TASK)] or [_Names([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        files, root = _opened(self.path)
        for name in partition.names:
            found = [files.get_file_info(f"{root}/{name}/{document}.json") for document in DOCUMENTS]
            if all(f.type == fs.FileType.File for f in found):
                for document, info in zip(DOCUMENTS, found):
                    with files.open_input_stream(info.path) as stream:
                        text = stream.readall().decode("utf-8-sig", errors="replace")
                    yield unquote(name), document, info.path, info.mtime, text


class _FirstReader(_Reader):
    """One row per item that is not hidden: the first of several files that exists. The others are not read."""

    def __init__(self, path: str, places: list[str]):
        super().__init__(path)
        self.places = places

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        files, root = _opened(self.path)
        for name in partition.names:
            for place in self.places:
                info = files.get_file_info(f"{root}/{name}/{place}")
                if info.type == fs.FileType.File:
                    with files.open_input_stream(info.path) as stream:
                        yield unquote(name), place, info.path, info.mtime, stream.readall().decode("utf-8-sig", errors="replace")
                    break


def _removed(path: str) -> None:
    files, folder = _opened(path)
    if files.get_file_info(folder).type == fs.FileType.Directory:
        files.delete_dir(folder)


def _moved(root: str, staging: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _opened(root)
        for batch in batches:
            for attempt in batch.column(0).to_pylist():
                moved = 0
                for item in files.get_file_info(fs.FileSelector(f"{base}/{staging}/{attempt}", allow_not_found=True)):
                    files.create_dir(f"{base}/{item.base_name}", recursive=True)
                    for document in files.get_file_info(fs.FileSelector(item.path)):
                        files.move(document.path, f"{base}/{item.base_name}/{document.base_name}")
                        moved += 1
                yield pa.RecordBatch.from_arrays([pa.array([moved], pa.int64())], names=["moved"])

    return run


def publish(spark: SparkSession, root: str, staging: str) -> int:
    """Move the items of a committed write to their places, and remove what it staged; without a commit only the latter.

    Returns the number of documents moved by this call.
    """
    files, base = _opened(root.rstrip("/"))
    marker = f"{base}/{staging}/{COMMITTED}"
    moved = 0
    if files.get_file_info(marker).type == fs.FileType.File:
        with files.open_input_stream(marker) as stream:
            attempts = json.loads(stream.readall())
        if attempts:
            # One row per task of the write.
            rows = spark.createDataFrame([(a,) for a in attempts], "attempt string").repartition(len(attempts), "attempt")
            moved = rows.mapInArrow(_moved(root.rstrip("/"), staging), "moved long").agg(F.sum("moved")).first()[0]
    _removed(f"{root.rstrip('/')}/{staging}")
    return moved or 0


def write_pieces(pieces: DataFrame, root: str) -> int:
    """Write documents given as (item_id, document, piece, text) rows. Documents of other items, and documents that
    are not given, stay as they are; a given one replaces its predecessor as a whole. Returns their number."""
    spark = pieces.sparkSession
    spark.dataSource.register(ItemFolders)
    staging = f".staging-{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = pieces.select("item_id", "document", "piece", "text").repartition(parts, "item_id")
    rows = rows.sortWithinPartitions("item_id", "document", "piece")
    rows.write.format(FORMAT).mode("append").option("path", root).option("staging", staging).save()
    return publish(spark, root, staging)


def read_pieces(spark: SparkSession, root: str) -> DataFrame:
    """(item_id, document, document_path, modified_at, text) of every item folder with both documents."""
    spark.dataSource.register(ItemFolders)
    return spark.read.format(FORMAT).option("path", root).load()


def read_first(spark: SparkSession, root: str, places: Sequence[str]) -> DataFrame:
    """(item_id, document, document_path, modified_at, text): of every item folder the first of the files that exists."""
    spark.dataSource.register(ItemFolders)
    return spark.read.format(FORMAT).option("path", root).option("first", ",".join(places)).load()
