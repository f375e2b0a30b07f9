"""Whole files written and read in tasks, so that neither their bytes nor their names pass through the driver.

A file is written below ``_attempts`` under a name of its attempt and moved into place when
it is whole: a reader never sees part of a file, a task that is run again or twice writes
the same files over, and what a failed attempt leaves goes with the job.  Names that begin
with an underscore are hidden from Spark's readers.

Tasks reach files by ``pyarrow.fs`` (local and shared folders, HDFS, S3, GCS).  Where it
does not know a scheme, reading goes through Spark's own reader instead, and writing raises.
"""

from __future__ import annotations

import contextlib
import functools
import os
import posixpath
import re
import stat
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import staged

#: Bytes of content that a batch holds, besides its last file.
BATCH = 16 << 20
#: Bytes that a reading task is dealt, about.
TASK = 128 << 20
_KNOWN = ("", "file", "hdfs", "s3", "s3a", "gs", "gcs")


def scheme(location: str) -> str:
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", location)
    return found[1].lower() if found else ""


def reachable(location: str) -> bool:
    """Whether tasks can open files of this location's file system by themselves."""
    return scheme(location) in _KNOWN


@functools.lru_cache(maxsize=8)
def _system(start: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a scheme and authority, and the path of its top."""
    return (pafs.LocalFileSystem(), "/") if not start else pafs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", start) + "/")


def filesystem(location: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a location, and the location's path in it."""
    kind = scheme(location)
    if kind in ("", "file"):
        return _system("")[0], re.sub(r"^file:/*(?=/)", "", location)
    if kind not in _KNOWN:
        raise ValueError(f"tasks can't open files of {kind}:")
    start = re.match(r"[^:]+://[^/]*", location)[0]
    found, top = _system(start)
    return found, posixpath.join(top, location[len(start) :].lstrip("/"))


def qualified(spark: SparkSession, root: str) -> str:
    """A root with its scheme and authority, by Spark's default file system where it names none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def _put(where: pafs.FileSystem, content: pa.Buffer | bytes, attempt: str, target: str) -> None:
    with where.open_output_stream(attempt) as out:
        out.write(content)
    if not isinstance(where, pafs.LocalFileSystem) and where.get_file_info(target).type == pafs.FileType.File:
        where.delete_file(target)  # a local move replaces; others may not
    where.move(attempt, target)


def _put_each(named: Iterable[tuple[str, pa.Buffer | bytes | None]], root: str, attempts: str, overwrite: bool, made: set[str]) -> pa.RecordBatch:
    """Write files one at a time; ``made`` holds the folders that are there."""
    where, base = filesystem(root)
    files = size = kept = 0
    for path, content in named:
        target = posixpath.normpath(f"{base}/{path}")
        if not target.startswith(base.rstrip("/") + "/"):
            raise ValueError(f"{path} is not below {root}")
        if content is None:
            continue
        if not overwrite and where.get_file_info(target).size:
            kept += 1
            continue
        folder = posixpath.dirname(target)
        if folder not in made:
            where.create_dir(folder, recursive=True)
            made.add(folder)
        _put(where, content, f"{base}/{attempts}/{uuid.uuid4().hex}", target)
        files, size = files + 1, size + len(content)
    return pa.RecordBatch.from_pydict({"files": [files], "bytes": [size], "kept": [kept]})


def _prepared(root: str, attempts: str) -> None:
    where, base = filesystem(root)
    where.create_dir(f"{base}/{attempts}", recursive=True)


def put_batches(batches: Iterator[pa.RecordBatch], root: str, attempts: str, overwrite: bool) -> Iterator[pa.RecordBatch]:
    """Write rows (``path`` below the root, ``content``); yields the numbers of files and bytes written, and of files kept, by batch."""
    _prepared(root, attempts)
    made: set[str] = set()
    for batch in batches:
        content = (c.as_buffer() if c.is_valid else None for c in batch.column(1))
        yield _put_each(zip(batch.column(0).to_pylist(), content, strict=True), root, attempts, overwrite, made)


def make_batches(batches: Iterator[pa.RecordBatch], make: Callable[..., tuple[str, bytes | None]], root: str, attempts: str, overwrite: bool) -> Iterator[pa.RecordBatch]:
    """As ``put_batches``, of files that ``make`` gives for a row's values: each is written before the next is made."""
    _prepared(root, attempts)
    made: set[str] = set()
    for batch in batches:
        yield _put_each((make(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)), root, attempts, overwrite, made)


def _written(rows: DataFrame, root: str, put: Callable[[Iterator[pa.RecordBatch], str], Iterator[pa.RecordBatch]]) -> dict[str, int]:
    attempts = f"_attempts/{uuid.uuid4().hex}"
    _prepared(root, attempts)  # an unknown scheme raises before the job
    done = rows.mapInArrow(lambda batches: put(batches, attempts), "files long, bytes long, kept long")
    try:
        sums = done.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in done.columns]).first()
    finally:
        where, base = filesystem(root)
        if where.get_file_info(f"{base}/{attempts}").type == pafs.FileType.Directory:
            with contextlib.suppress(FileNotFoundError):  # a task that is being stopped may still move its file; the job's error counts
                where.delete_dir(f"{base}/{attempts}")
    return sums.asDict()


def write_files(rows: DataFrame, root: str, path: str = "path", content: str = "content", overwrite: bool = True) -> dict[str, int]:
    """Write a file for each row; the numbers of ``files`` and ``bytes`` written and of files ``kept``.

    Without ``overwrite`` a file that exists and is not empty stays.  Rows of null content
    write none.  Paths must tell rows apart (of two rows with one path either may stay).
    """
    put = lambda batches, attempts: put_batches(batches, root, attempts, overwrite)
    return _written(rows.select(F.col(path).cast("string"), F.col(content).cast("binary")), root, put)


def write_made(rows: DataFrame, make: Callable[..., tuple[str, bytes | None]], root: str, overwrite: bool = True) -> dict[str, int]:
    """As ``write_files``, of the path and bytes that ``make`` gives for the values of a row's columns.

    Bytes are made where they are written, so a task holds one file, however large the
    files and however many rows a batch has.
    """
    return _written(rows, root, lambda batches, attempts: make_batches(batches, make, root, attempts, overwrite))


#: Folders that a listing task is dealt, about.
FOLDERS = 1_000
#: Files and folders that a listing task holds at a time.
LISTED = 10_000


def _entries(location: str) -> Iterator[tuple[str, bool, int]]:
    """Name, whether it is a folder, and size of what a folder holds.

    A local or shared folder is read as it goes, however many files it has; of others
    ``pyarrow.fs`` gives one list.
    """
    where, at = filesystem(location)
    if not isinstance(where, pafs.LocalFileSystem):
        yield from ((f.base_name, f.type == pafs.FileType.Directory, f.size or 0) for f in where.get_file_info(pafs.FileSelector(at)))
        return
    with os.scandir(at) as found:
        for f in found:
            try:
                kind = f.stat()
            except FileNotFoundError:  # a link to nothing, or gone meanwhile
                continue
            yield f.name, stat.S_ISDIR(kind.st_mode), kind.st_size if stat.S_ISREG(kind.st_mode) else 0


def list_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``location``, ``length`` and whether it is a ``folder``, of what the folders of a column hold; a batch is given before the next is read."""
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            shown = (e for e in _entries(folder) if not _hidden(e[0]) and (e[1] or e[2]))
            while part := list(islice(shown, LISTED)):
                names, folders, sizes = zip(*part, strict=True)
                yield pa.RecordBatch.from_pydict(
                    {"location": pa.array([f"{folder.rstrip('/')}/{name}" for name in names], pa.string()), "length": pa.array(sizes, pa.int64()), "folder": pa.array(folders, pa.bool_())}
                )


def list_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """``location`` and ``length`` of the files below a root that tasks can reach, listed in tasks: a round for each depth of folders.

    As Spark's readers, without empty files and without names that begin with a dot or an
    underscore (unless they hold "="), of files and folders alike.
    """
    where, base = filesystem(root)
    if where.get_file_info(base).type == pafs.FileType.NotFound:
        raise FileNotFoundError(root)

    folders, n, found = spark.range(1).select(F.lit(root).alias("location")), 1, []
    while n:
        dealt = folders.repartition(max(spark.sparkContext.defaultParallelism, n // FOLDERS + 1), "location") if found else folders
        level = staged(dealt.mapInArrow(list_batches, "location string, length long, folder boolean"), "listing")
        found.append(level.filter("not folder").select("location", "length"))
        folders = level.filter("folder").select("location")
        n = folders.count() if recursive else 0
    return reduce(DataFrame.unionByName, found)


def _hidden(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def delete_folder(root: str) -> None:
    """A folder goes with all that is below it."""
    where, base = filesystem(root)
    where.delete_dir(base)


def read_files(rows: DataFrame, location: str = "location", length: str = "length", column: str = "content") -> DataFrame:
    """``rows`` with the bytes of their files, read in tasks that get about ``TASK`` bytes each; only these files are opened.

    A file that is gone fails its task, and in the end the query.
    """
    total = rows.agg(F.coalesce(F.sum(length), F.lit(0))).first()[0]
    names = rows.columns
    dealt = rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, int(total) // TASK + 1), location)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, start, size = [], 0, 0
            for i, at in enumerate(batch.column(names.index(location)).to_pylist()):
                content = None
                if at is not None:
                    where, name = filesystem(at)
                    with where.open_input_stream(name) as stream:
                        content = stream.read()
                found.append(content)
                size += len(content or b"")
                if size >= BATCH or i == len(batch) - 1:
                    part = batch.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], names=[*names, column])
                    found, start, size = [], i + 1, 0

    return dealt.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(column, T.BinaryType())]))
