"""A Spark data source that lists and reads the supported files of a folder, hidden names included."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import content_hash
from ..session import ship
from ..settings import Settings

#: Bytes of files that one task reads, about.
PARTITION_BYTES = 32 << 20


class _Group(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.extensions = tuple(x for x in options.get("extensions", "").lower().split(",") if x)
        self.ignored = {x for x in options.get("ignored", "").split(",") if x}

    def _walk(self) -> Iterator[tuple[str, int]]:
        for folder, inner, names in os.walk(self.root):
            inner[:] = sorted(d for d in inner if d not in self.ignored)
            for n in names:
                full = os.path.join(folder, n)
                if n.lower().endswith(self.extensions) and os.path.splitext(n)[1] and os.path.isfile(full):
                    yield os.path.relpath(full, self.root), os.path.getsize(full)

    def partitions(self) -> list[_Group]:
        groups, size = [[]], 0
        for path, n in self._walk():
            if size + n > PARTITION_BYTES and groups[-1]:
                groups.append([])
                size = 0
            groups[-1].append(path)
            size += n
        return [_Group(g) for g in groups]

    def read(self, partition: _Group) -> Iterator[tuple[str, bytes]]:
        for path in partition.paths:
            with open(os.path.join(self.root, path), "rb") as f:
                yield path.replace(os.sep, "/"), f.read()


class RepositoryFiles(DataSource):
    """Options: path (shared by driver and executors), extensions and ignored (comma-separated)."""

    @classmethod
    def name(cls) -> str:
        return "repository_files"

    def schema(self) -> str:
        return "file_path string, content binary"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def discover(spark: SparkSession, root: str, settings: Settings | None = None) -> DataFrame:
    """file_path, content of the supported files below root.

    Folders of ignored names are skipped wherever they lie below root; what root itself is called
    does not matter.  Extensions are compared in lower case.  A root with a scheme (hdfs://, s3a://, ...)
    is read by Spark's own source of whole files, which passes over names that begin with _ or a dot.
    """
    s = settings or Settings()
    if "://" in root:
        return _in_store(spark, root.rstrip("/"), s)
    ship(spark)
    spark.dataSource.register(RepositoryFiles)
    options = {"path": os.path.abspath(root), "extensions": ",".join(s.supported_extensions), "ignored": ",".join(s.ignored_dirs)}
    return spark.read.format("repository_files").options(**options).load()


def _in_store(spark: SparkSession, root: str, s: Settings) -> DataFrame:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    full = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    either_case = ("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in x) for x in s.supported_extensions)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*{" + ",".join(either_case) + "}").load(root)
    rows = found.select(F.substring("path", len(full) + 2, 1 << 20).alias("file_path"), "content")
    return rows.filter(~F.arrays_overlap(F.split("file_path", "/"), F.array(*map(F.lit, s.ignored_dirs))))


def in_path_order(files: DataFrame) -> DataFrame:
    """By path, folder by folder: `a/z` comes before `a.b`."""
    return files.orderBy(F.split("file_path", "/"))


def with_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("content_hash", content_hash(F.col("content")))
