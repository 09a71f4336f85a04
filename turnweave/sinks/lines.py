"""Many small text files, one per folder."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, Row

from turnweave.sources.files import qualified


def write_lines(rows: DataFrame, root: str) -> None:
    """A text file ``part-0.txt`` in every ``folder`` below ``root``, with a line per ``value``; null is an empty line.

    Spark's own writer gives each file a task's folder, a checksum and renames of its own, on local disks with a process for each
    change of access rights, which takes far longer than the few bytes. Here a task writes its files in place, one line at a time.
    Rows of a folder are in one task and in order, so a task that is repeated writes the same file again. As for
    ``hash_files``, the file system must be one that Arrow knows.
    """
    spark = rows.sparkSession
    base = qualified(spark, root)
    filesystem, inner = FileSystem.from_uri(base)
    filesystem.create_dir(inner)

    def write(part: Iterator[Row]) -> None:
        filesystem, inner = FileSystem.from_uri(base)
        for folder, lines in groupby(part, key=lambda row: row["folder"]):
            filesystem.create_dir(f"{inner}/{folder}")
            with filesystem.open_output_stream(f"{inner}/{folder}/part-0.txt") as stream:
                for line in lines:
                    stream.write(f"{line['value'] or ''}\n".encode())

    # A fixed number of tasks: adaptive execution would give so few bytes to a single one.
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(partitions, "folder").sortWithinPartitions("folder", "value").foreachPartition(write)
