"""Incremental indexing of a folder by Structured Streaming: each micro-batch of files is merged in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..chunking.parse import create_chunks, in_file_order
from ..functions.text import TokenCount, token_counter
from ..operators import maintenance
from ..operators.models import Embedder, build_embedder
from ..plans.index import embed_chunks, fingerprint, open_index
from ..schema import FILES
from ..settings import Settings


def merge_files(spark: SparkSession, files: DataFrame, name: str, store: str = "cosine", settings: Settings | None = None, embedder: Embedder | None = None, count: TokenCount | None = None) -> None:
    """Replace what the index holds of these files(file_path, content); other files stay as they are.

    The same files again change nothing, so a batch that is repeated after a failure is harmless.
    """
    s = settings or Settings()
    ix = open_index(spark, s, store, name)
    embedder = embedder or build_embedder(s)
    hashed = files.withColumn("content_hash", F.sha2("content", 256)).persist()
    listed = ix.manifest.files()
    seen = hashed.select("file_path", "content_hash")
    fresh = seen.join(listed.select("file_path", "content_hash"), ["file_path", "content_hash"], "left_anti").select("file_path").distinct()
    chunks = in_file_order(create_chunks(hashed.join(fresh, "file_path", "left_semi").select("file_path", "content"), s, None, count)).persist()
    stale = listed.join(fresh, "file_path", "left_semi").select(F.explode("chunk_ids").alias("id"))
    ix.chunks.table.replace(maintenance.upsert(maintenance.delete(ix.chunks.table.read(), stale), chunks))
    renewed = ix.chunks.table.read().join(chunks.select("id").distinct(), "id", "left_semi")
    old = maintenance.delete(ix.vectors.table.read(), stale).join(chunks.select("id"), "id", "left_anti")
    ix.vectors.table.replace(old.unionByName(embed_chunks(renewed, embedder, s).select(old.columns)))
    ids = maintenance.chunks_by_file(chunks.select("file_path", "id", "ord"))
    rows = seen.join(fresh, "file_path", "left_semi").join(ids, "file_path", "left").withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast("array<string>")))
    ix.manifest.save(listed.join(fresh, "file_path", "left_anti").unionByName(rows), fingerprint(s, store))
    chunks.unpersist()
    hashed.unpersist()


def stream_files(spark: SparkSession, folder: str, checkpoint: str, name: str, store: str = "cosine", settings: Settings | None = None, **options) -> StreamingQuery:
    """Follow a folder of Parquet files of (file_path, content) and keep the index up to date."""
    source = spark.readStream.schema(FILES).parquet(folder)

    def merge(batch: DataFrame, _: int) -> None:
        merge_files(batch.sparkSession, batch.dropDuplicates(["file_path"]), name, store, settings, **options)

    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
