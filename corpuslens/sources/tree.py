"""File trees: a listing by levels, and the read of file contents inside tasks.

Spark's own file sources leave out hidden, ``_``-prefixed and empty files and have no rows for
directories; a catalogue needs them all. The file system must be one every executor sees. Where
there is none, read a table instead (``sources.tables``).
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime, timezone
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpuslens.functions.text import file_text
from corpuslens.operators.bounded import checkpointed
from corpuslens.schema import CATALOGUE

# A listing row of a directory that could not be opened says so here; null for all others.
LISTING = T.StructType([*CATALOGUE.fields, T.StructField("listing_error", T.StringType())])
PENDING = T.StructField("pending", T.BooleanType())
LISTED_ROWS = 10_000
READ_BATCH_BYTES = 32 * 1024 * 1024
READ_BATCH_FILES = 1000


def _moment(seconds: float) -> datetime:
    return datetime.fromtimestamp(seconds, timezone.utc)


def _suffix(name: str) -> str:
    dot = name.rfind(".")
    return name[dot:] if 0 <= dot < len(name) - 1 else ""


def _row(path: str, is_directory: bool, status: os.stat_result, error: str | None = None) -> tuple:
    name = os.path.basename(path)
    born = getattr(status, "st_birthtime", None)
    return (
        path, name,
        None if is_directory else _suffix(name),
        None if is_directory else status.st_size,
        _moment(born) if born is not None else None,
        _moment(status.st_mtime),
        is_directory,
        error,
    )


def _listed(directory: str) -> tuple[list[str], Iterator[tuple], str | None]:
    """Sub-directories and file rows of one directory; an error text where it cannot be read."""
    folders: list[str] = []
    try:
        entries = os.scandir(directory)
    except FileNotFoundError:
        return folders, iter(()), "not found"
    except OSError:
        return folders, iter(()), "denied"

    def files() -> Iterator[tuple]:
        with entries:
            for entry in entries:
                try:
                    if entry.is_dir(follow_symlinks=False):
                        folders.append(entry.path)
                        continue
                    if entry.is_dir():
                        yield _row(entry.path, True, entry.stat())
                        continue
                    yield _row(entry.path, False, entry.stat())
                except OSError:
                    # A dangling link, or a file that just vanished: listed, and unreadable later.
                    yield _row(entry.path, False, entry.stat(follow_symlinks=False))
    return folders, files(), None


def _directory_row(path: str, error: str | None) -> Iterator[tuple]:
    try:
        yield _row(path, True, os.stat(path), error)
    except OSError:
        yield (path, os.path.basename(path), None, None, None, None, True, error or "not found")


def _level(root: str):
    """Lists a batch of directories: their own rows, their files, and directories still to list."""
    names = [*LISTING.names, "pending"]
    types = to_arrow_schema(T.StructType([*LISTING.fields, PENDING]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for directory in batch.column(0).to_pylist():
                folders, files, error = _listed(directory)
                for row in files:
                    held.append((*row, False))
                    if len(held) >= LISTED_ROWS:
                        yield _record_batch(held, names, types)
                        held = []
                if directory != root:
                    held += [(*row, False) for row in _directory_row(directory, error)]
                held += [(folder, "", None, None, None, None, True, None, True)
                         for folder in folders]
        yield _record_batch(held, names, types)
    return rows


def _record_batch(rows: list[tuple], names: list[str], types: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, types)], names=names)


def list_tree(spark: SparkSession, root: str, tasks: int | None = None) -> DataFrame:
    """Every file and directory below ``root`` (itself left out), with ``listing_error``.

    One job for each level of the tree: tasks list the directories of a level, spread evenly, and
    the sub-directories that they find are the next level. The driver only asks whether there is
    a next one.
    """
    if not os.path.isdir(root):
        raise ValueError(f"not a directory: {root}")
    root = os.path.abspath(root)
    tasks = tasks or max(spark.sparkContext.defaultParallelism,
                         int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = T.StructType([*LISTING.fields, PENDING])
    frontier = spark.createDataFrame([(root,)], "path string")
    levels: list[DataFrame] = []
    while True:
        listed = checkpointed(frontier.repartition(tasks).mapInArrow(_level(root), schema))
        levels.append(listed.filter(~F.col("pending")).select(*LISTING.names))
        frontier = listed.filter("pending").select("path")
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, levels)


def files_of(listing: DataFrame) -> DataFrame:
    """The file rows of a listing, with the modification time in microseconds."""
    return (listing.filter(~F.col("is_directory"))
            .withColumn("mtime_us", F.unix_micros("modified_time")))


def _read_files(limit: int | None):
    def read(path: str, wanted: bool) -> bytes | None:
        if not wanted:
            return None
        try:
            with open(path, "rb") as stream:
                return stream.read() if limit is None else stream.read(limit)
        except OSError:
            return None

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            start, held, contents = 0, 0, []
            wanted = table.column("wanted").to_pylist()
            table = table.drop_columns(["wanted"])
            for row, path in enumerate(table.column("path").to_pylist()):
                contents.append(read(path, wanted[row]))
                held += len(contents[-1] or b"")
                full = held >= READ_BATCH_BYTES or len(contents) >= READ_BATCH_FILES
                if full or row == table.num_rows - 1:
                    part = table.slice(start, len(contents))
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array(contents, pa.binary())],
                        names=[*part.schema.names, "content"])
                    start, held, contents = row + 1, 0, []
    return batches


def with_content(files: DataFrame, head: int | None = None,
                 wanted: Column | None = None) -> DataFrame:
    """Add ``content``, the bytes of each file (the first ``head`` ones), null if unreadable.

    Files for which ``wanted`` is not true are not opened.

    The rows are spread evenly first: one directory may hold most files, and the listing leaves
    them in one partition. Only metadata moves; contents are read where they are then used.
    """
    schema = T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType())])
    tasks = max(files.sparkSession.sparkContext.defaultParallelism,
                int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asked = F.lit(True) if wanted is None else F.coalesce(wanted, F.lit(False))
    return (files.withColumn("wanted", asked).repartition(tasks)
            .mapInArrow(_read_files(head), schema))


@F.pandas_udf(T.BooleanType())
def is_file(paths: pd.Series) -> pd.Series:
    """True for a path that names a file now."""
    return paths.map(os.path.isfile)


def with_text(files: DataFrame) -> DataFrame:
    """Add ``content`` and its decoded ``text``."""
    return with_content(files).withColumn("text", file_text(F.col("content")))
