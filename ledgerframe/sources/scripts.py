"""Script files and written corpora."""

from __future__ import annotations

import contextlib
import os
import posixpath
import stat
import uuid
from collections.abc import Iterator
from itertools import islice, takewhile

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerframe.session import materialize

#: Files a task reads at most, and bytes after which it hands on what it has read.
TASK_FILES, BATCH_BYTES = 5_000, 8 << 20


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def read_script_listing(spark: SparkSession, path: str) -> DataFrame:
    """(name, ts) of the scripts directly in a folder; contents are not read."""
    return read_scripts(spark, path).select("name", "ts")


def read_scripts(spark: SparkSession, path: str, bundled: DataFrame | None = None) -> DataFrame:
    """(name, text, ts) of every ``*.sql`` file directly in a folder, as UTF-8.

    Contents are not read when only names are selected. Bytes that are not UTF-8
    become U+FFFD. When ``bundled`` scripts exist they are used instead of the folder.
    """
    if bundled is not None and not bundled.isEmpty():
        return bundled.select("name", "text", "ts")
    listed = listed_scripts(spark, path)
    if listed is None:
        return scanned_scripts(spark, path)
    text = F.make_valid_utf8(_content()("file").cast("string"))
    return listed.select("name", text.alias("text"), F.timestamp_millis("ms").alias("ts"))


def listed_scripts(spark: SparkSession, path: str) -> DataFrame | None:
    """(file, name, length, ms) of the scripts in a folder of a file system that tasks have mounted.

    A task lists the folder as a stream and writes the listing to the shared folder; the driver learns
    the number of files and bytes alone, and deals the files out in tasks by both. None for paths on other
    file systems, and for those that stand for nothing.
    """
    system, found = _matches(spark, path)
    if not found or system.getUri().getScheme() != "file":
        return None
    jvm = spark._jvm
    found = jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(found))
    roots = [(os.fsencode(root.removeprefix("file:")),) for root in found.mkString("\0").split("\0")]

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hidden(name):
            return name.startswith(b".") or name.startswith(b"_") and b"=" not in name

        def scripts(root):
            with contextlib.ExitStack() as opened:
                if os.path.isdir(root):
                    files = ((e.name, e.path) for e in opened.enter_context(os.scandir(root)))
                else:
                    files = [(os.path.basename(root), root)]
                for name, file in files:
                    if name.endswith(b".sql"):
                        try:
                            about = os.stat(file)
                        except FileNotFoundError:
                            continue
                        # a scan passes over hidden files, but empty ones were always told
                        if stat.S_ISREG(about.st_mode) and not (about.st_size and hidden(name)):
                            yield file, name.decode("utf-8", "replace"), about.st_size, about.st_mtime_ns // 1_000_000

        kinds = pa.binary(), pa.string(), pa.int64(), pa.int64()
        for batch in batches:
            for root in batch.column(0).to_pylist():
                rows = scripts(root)
                while some := list(islice(rows, 10_000)):
                    columns = [pa.array(c, t) for c, t in zip(zip(*some, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, ["file", "name", "length", "ms"])

    told = spark.createDataFrame(roots, "root binary").mapInArrow(listing, "file binary, name string, length bigint, ms bigint")
    told = materialize(told, "listing")
    size = told.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    tasks = max(-(-size.files // TASK_FILES), -(-size.bytes // most), min(size.files, spark.sparkContext.defaultParallelism), 1)
    return told.repartition(tasks, "file")


def _content():
    """A function that reads files, in batches of few bytes. Not deterministic, so that no file is read for a filter as well."""

    @F.arrow_udf("binary")
    def content(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts, size = [], 0
            for file in batch.to_pylist():
                with open(file, "rb") as f:
                    texts.append(f.read())
                size += len(texts[-1])
                if size >= BATCH_BYTES:
                    yield pa.array(texts, pa.binary())
                    texts, size = [], 0
            yield pa.array(texts, pa.binary())

    return content.asNondeterministic()


def scanned_scripts(spark: SparkSession, path: str) -> DataFrame:
    """(name, text, ts) of the scripts in a folder of any file system, by a scan that Spark lists on the driver."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sql").load(path)
    read = files.where("length > 0").select(
        file_name(F.col("path")).alias("name"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("text"),
        F.col("modificationTime").alias("ts"),
    )
    return read.unionByName(empty_scripts(spark, path))


def _matches(spark: SparkSession, path: str):
    """The file system of a path, and what the path or pattern stands for there."""
    given = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = given.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system, system.globStatus(given)


def empty_scripts(spark: SparkSession, path: str) -> DataFrame:
    """(name, text, ts) of the scripts of length zero, which file scans pass over.

    They come from the folder's listing, which Spark makes on the driver for a scan anyway. The
    JVM sorts it by length, so that what passes to Python is the empty ones alone, not the folder.
    """
    jvm = spark._jvm
    system, folders = _matches(spark, path)
    rows = []
    if folders is not None:
        found = system.listStatus(jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(folders))
        scala, util = jvm.scala, jvm.java.util
        by_length = util.ArrayList(scala.jdk.javaapi.CollectionConverters.asJava(scala.collection.immutable.ArraySeq.unsafeWrapArray(found)))
        util.Collections.sort(by_length, util.Comparator.comparingLong(_file_length(jvm)))
        for status in takewhile(lambda s: s.getLen() == 0, by_length):
            name = status.getPath().getName()
            if name.endswith(".sql") and status.isFile():
                rows.append((name, "", status.getModificationTime()))
    frame = spark.createDataFrame(rows, "name string, text string, ms bigint")
    return frame.selectExpr("name", "text", "timestamp_millis(ms) as ts")


def _file_length(jvm):
    """The length of a listed file as a function of the JVM."""
    lang = jvm.java.lang
    load, handles = lang.Thread.currentThread().getContextClassLoader().loadClass, lang.invoke
    returns = handles.MethodType.methodType(lang.Long.TYPE)
    length = handles.MethodHandles.publicLookup().findVirtual(load("org.apache.hadoop.fs.FileStatus"), "getLen", returns)
    return handles.MethodHandleProxies.asInterfaceInstance(load("java.util.function.ToLongFunction"), length)


def write_corpus(documents: DataFrame, root: str, mode: str = "overwrite") -> None:
    """Write (path, text), and part if there is one, as parquet, one folder per directory of the paths.

    Rows are written where they are, without a shuffle, so a directory that has most
    of the documents is written by all tasks.
    """
    folder = F.regexp_replace("path", r"/?[^/]*\z", "")
    part = [c for c in documents.columns if c == "part"]
    placed = documents.select("path", *part, "text", folder.alias("directory"))
    placed.write.mode(mode).partitionBy("directory").parquet(root)


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """What ``write_corpus`` wrote, without the folders."""
    return spark.read.parquet(root).drop("directory")


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a URI, on the file system Spark itself would use for it."""
    if "://" in path:
        return path
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    uri = hadoop_path.makeQualified(system.getUri(), system.getWorkingDirectory()).toString()
    return uri if "://" in uri else uri.replace(":/", ":///", 1)


def write_files(documents: DataFrame, root: str) -> DataFrame:
    """Write each document as its own file below ``root``; returns (path, bytes).

    Without a ``part`` column a row is a document. With one, the rows of a path are its
    parts: they are brought together by path and appended in the order of the parts, one
    after the other. A file is written under a temporary name and moved into place, so a
    retried or repeated task leaves one whole file.
    """
    target = qualified(documents.sparkSession, root)
    parted = "part" in documents.columns

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as arrow_fs

        system, base = arrow_fs.FileSystem.from_uri(target)
        made: set[str] = set()
        path = out = draft = None
        size, done = 0, []

        def close():
            if out is not None:
                out.close()
                system.move(draft, posixpath.join(base, path))
                done.append((path, size))

        for batch in batches:
            for name, text in zip(batch["path"], batch["text"], strict=True):
                if out is None or not parted or name != path:
                    close()
                    folder = posixpath.dirname(posixpath.join(base, name))
                    if folder not in made:
                        system.create_dir(folder, recursive=True)
                        made.add(folder)
                    path, size, draft = name, 0, f"{folder}/.{uuid.uuid4().hex}.tmp"
                    out = system.open_output_stream(draft)
                data = (text or "").encode("utf-8")
                out.write(data)
                size += len(data)
            yield pd.DataFrame(done, columns=["path", "bytes"])
            done.clear()
        close()
        yield pd.DataFrame(done, columns=["path", "bytes"])

    rows = documents.select("path", "text")
    if parted:
        rows = documents.repartition("path").sortWithinPartitions("path", "part").select("path", "text")
    return rows.mapInPandas(write, "path string, bytes bigint")
