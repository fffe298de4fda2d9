"""Index tables as immutable versions: each change writes a new version, then marks it.

Readers of a version never see it change; a writer that dies leaves the old version in force.
"""

from __future__ import annotations

import json
import os
import uuid
from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import MetadataFilters, filtered
from ..operators import maintenance
from ..operators.vector import vector_search
from ..schema import CHUNK, CONFIG, MANIFEST, VECTOR, VECTOR_METADATA


#: Written into a version's folder when all of the version is there; readers of Parquet skip the name.
_DONE = "_DONE"


def located(folder: str) -> str:
    """A folder as an address for Spark and Hadoop: paths without a scheme are this machine's."""
    return folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}"


class VersionedTable:
    """A Parquet table below a folder that driver and executors share, in any file system that Spark writes.

    A version counts from the moment its mark is there, which is one creation of an empty file; the last
    marked one is in force.  Nothing is renamed, so object stores will do.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, partition_by: tuple[str, ...] = ()):
        self.spark, self.folder, self.schema, self.partition_by = spark, located(folder), schema, partition_by

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    @property
    def _files(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[str]:
        """Names of the marked versions, oldest first."""
        fs = self._files
        found = fs.globStatus(self._path("*", _DONE)) or []
        return sorted(status.getPath().getParent().getName() for status in found)

    def version(self) -> str | None:
        return (self.versions() or [None])[-1]

    def read(self) -> DataFrame:
        v = self.version()
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/{v}") if v else self.spark.createDataFrame([], self.schema)

    def has_data(self) -> bool:
        return not self.read().isEmpty()

    def replace(self, rows: DataFrame) -> None:
        """Write rows as a new version and mark it; versions before the last are deleted."""
        old = self.versions()
        number = int(old[-1].split("-")[0]) + 1 if old else 1
        new = f"{number:012d}-{uuid.uuid4().hex}"
        rows.select(self.schema.names).write.partitionBy(*self.partition_by).parquet(f"{self.folder}/{new}")
        fs = self._files
        fs.create(self._path(new, _DONE), True).close()
        for name in old[:-1]:
            fs.delete(self._path(name, _DONE), False)  # no reader may find half a version
            fs.delete(self._path(name), True)


class ChunkStore:
    """All chunks with their content."""

    def __init__(self, spark: SparkSession, folder: str):
        self.table = VersionedTable(spark, folder, CHUNK)

    def all_chunks(self, filters: MetadataFilters | None = None) -> DataFrame:
        return filtered(self.table.read(), filters)

    def get(self, chunk_id: str) -> dict | None:
        row = self.table.read().filter(F.col("id") == chunk_id).first()
        return row.asDict() if row else None

    def has_data(self) -> bool:
        return self.table.has_data()

    def add(self, chunks: DataFrame) -> None:
        self.table.replace(maintenance.upsert(self.table.read(), chunks))

    def delete(self, ids: DataFrame) -> None:
        if not ids.isEmpty():
            self.table.replace(maintenance.delete(self.table.read(), ids))


class VectorStore(ABC):
    @abstractmethod
    def add(self, vectors: DataFrame) -> None: ...

    @abstractmethod
    def delete(self, ids: DataFrame) -> None: ...

    @abstractmethod
    def search(self, questions: DataFrame, k: int, filters: MetadataFilters | None = None) -> DataFrame: ...

    @abstractmethod
    def all_vectors(self, filters: MetadataFilters | None = None) -> DataFrame: ...

    @abstractmethod
    def has_data(self) -> bool: ...


class ParquetVectorStore(VectorStore):
    """Vectors with the columns that filters need and no content; exact search with either metric."""

    def __init__(self, spark: SparkSession, folder: str, metric: str = "cosine"):
        self.table, self.metric = VersionedTable(spark, folder, VECTOR), metric

    def all_vectors(self, filters: MetadataFilters | None = None) -> DataFrame:
        return filtered(self.table.read(), filters)

    def has_data(self) -> bool:
        return self.table.has_data()

    def add(self, vectors: DataFrame) -> None:
        kept = self.table.read().join(vectors.select("id"), "id", "left_anti").select(VECTOR.names)
        self.table.replace(kept.unionByName(vectors.select(VECTOR.names)))

    def delete(self, ids: DataFrame) -> None:
        if not ids.isEmpty():
            self.table.replace(maintenance.delete(self.table.read(), ids))

    def search(self, questions: DataFrame, k: int, filters: MetadataFilters | None = None) -> DataFrame:
        return vector_search(self.all_vectors(filters), questions, k, self.metric)


#: Stores by name.  `chroma` and `simple` are the names that existing scripts use for the two scores.
STORES = {"cosine": "cosine", "l2": "l2", "simple": "cosine", "chroma": "l2"}


def build_vector_store(spark: SparkSession, kind: str, indexes_dir: str, name: str) -> ParquetVectorStore:
    if kind not in STORES:
        raise ValueError(f"unknown store {kind!r}: one of {', '.join(sorted(STORES))}")
    return ParquetVectorStore(spark, f"{indexes_dir}/{name}/vectors", STORES[kind])


def build_chunk_store(spark: SparkSession, indexes_dir: str, name: str) -> ChunkStore:
    return ChunkStore(spark, f"{indexes_dir}/{name}/chunks")


def vector_metadata(chunks: DataFrame, *more: Column) -> DataFrame:
    """id, place and the filter columns of chunks, and columns that are made of them; missing texts are empty."""
    text = {f.name for f in CHUNK.fields if isinstance(f.dataType, T.StringType)}
    return chunks.select("id", *more, *[F.coalesce(c, F.lit("")).alias(c) if c in text else F.col(c) for c in (*VECTOR_METADATA, "ord")])


class Manifest:
    """Which files are indexed, with their hashes and chunk ids, and the settings that made the index."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.table = VersionedTable(spark, f"{folder}/manifest", MANIFEST)
        self.settings = VersionedTable(spark, f"{folder}/settings", CONFIG)

    def files(self) -> DataFrame:
        return self.table.read()

    def config(self) -> dict:
        row = self.settings.read().first()
        return json.loads(row["config"]) if row else {}

    def save(self, files: DataFrame, config: dict) -> None:
        self.table.replace(files)
        self.settings.replace(self.spark.createDataFrame([(json.dumps(config, sort_keys=True),)], CONFIG))
