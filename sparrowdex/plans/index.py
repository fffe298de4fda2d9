"""Building, updating and checking an index."""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..chunking.parse import create_chunks, in_file_order
from ..functions.text import TokenCount, token_counter
from ..operators import maintenance
from ..operators.models import Embedder, build_embedder
from ..settings import Settings
from ..sources import files as source_files
from ..sources.repository import current_commit, index_name, load_repository
from ..sources.stores import STORES, ChunkStore, Manifest, ParquetVectorStore, build_chunk_store, build_vector_store, vector_metadata

_SHOWN = 20
_log = logging.getLogger(__name__)


@dataclass
class Index:
    name: str
    chunks: ChunkStore
    vectors: ParquetVectorStore
    manifest: Manifest


def open_index(spark: SparkSession, settings: Settings, store: str, name: str) -> Index:
    folder = f"{settings.indexes_dir}/{name}"
    return Index(name, build_chunk_store(spark, settings.indexes_dir, name), build_vector_store(spark, store, settings.indexes_dir, name), Manifest(spark, folder))


def fingerprint(settings: Settings, store: str) -> dict:
    """What an index depends on: if any of it changes, everything is indexed anew."""
    return {
        "store": STORES[store],
        "embedding_model": settings.embedding_model,
        "embedding_dimensions": settings.embedding_dimensions,
        "max_chunk_tokens": settings.max_chunk_tokens,
        "chunk_overlap_tokens": settings.chunk_overlap_tokens,
        "token_counter": settings.token_counter,
        "supported_extensions": list(settings.supported_extensions),
        "searchable_chunk_types": list(settings.searchable_chunk_types),
    }


def embed_chunks(chunks: DataFrame, embedder: Embedder, settings: Settings) -> DataFrame:
    wanted = chunks.filter(F.col("chunk_type").isin(*settings.searchable_chunk_types))
    return vector_metadata(wanted, embedder.column(F.col("content")).alias("embedding"))


def index_repository(
    spark: SparkSession,
    repo: str,
    store: str = "cosine",
    settings: Settings | None = None,
    name: str | None = None,
    embedder: Embedder | None = None,
    count: TokenCount | None = None,
) -> int:
    """Bring the index of a repository up to date; the number of chunks it then holds.

    Only files that are new or have changed are parsed and embedded.  Vectors and chunks are new
    versions; the manifest comes last, so a run that dies is repeated by the next one.
    """
    s, began = settings or Settings(), time.monotonic()
    name = name or index_name(repo)
    root = load_repository(repo, s.repositories_dir)
    ix = open_index(spark, s, store, name)
    embedder = embedder or build_embedder(s)
    found = source_files.with_hash(source_files.discover(spark, root, s))
    hashes = found.select("file_path", "content_hash")
    config, listed = fingerprint(s, store), ix.manifest.files()
    known = ix.manifest.config()
    diff = maintenance.manifest_diff(listed, hashes)
    if known and known != config:
        diff = diff.withColumn("status", F.when(F.col("status") == "same", "changed").otherwise(F.col("status")))
    diff = diff.persist()
    try:
        stale = maintenance.stale_ids(listed, diff)
        fresh = diff.filter(F.col("status").isin("added", "changed")).select("file_path")
        todo = found.select("file_path", "content").join(fresh, "file_path", "left_semi")
        chunks = in_file_order(create_chunks(todo, s, current_commit(root), count)).persist()
        kept = maintenance.delete(ix.chunks.table.read(), stale)
        ix.chunks.table.replace(maintenance.upsert(kept, chunks))
        old = maintenance.delete(ix.vectors.table.read(), stale).join(chunks.select("id"), "id", "left_anti")
        renewed_chunks = ix.chunks.table.read().join(chunks.select("id").distinct(), "id", "left_semi")
        ix.vectors.table.replace(old.unionByName(embed_chunks(renewed_chunks, embedder, s).select(old.columns)))
        ids = maintenance.chunks_by_file(chunks.select("file_path", "id", "ord"))
        renewed = hashes.join(fresh, "file_path", "left_semi").join(ids, "file_path", "left").withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast("array<string>")))
        same = listed.join(diff.filter("status = 'same'").select("file_path"), "file_path", "left_semi")
        ix.manifest.save(same.unionByName(renewed), config)
        chunks.unpersist()
    finally:
        diff.unpersist()
    n = ix.chunks.table.read().count()
    _log.info("index %s: %d chunks after %.2f s", name, n, time.monotonic() - began)
    return n


def index_info(spark: SparkSession, settings: Settings, store: str, name: str) -> dict:
    ix = open_index(spark, settings, store, name)
    row = maintenance.counts(ix.chunks.table.read(), ix.vectors.table.read(), ix.manifest.files(), settings.searchable_chunk_types).first()
    return {"index_name": name, "store": store, **row.asDict(), "embedding_model": settings.embedding_model, "embedding_dimensions": settings.embedding_dimensions, "has_manifest": bool(ix.manifest.config())}


def format_info(info: dict) -> str:
    return "\n".join(f"{k}: {v}" for k, v in info.items())


@dataclass
class Health:
    """Offending ids by check: how many, and the first of them in order."""

    index_name: str
    found: dict[str, tuple[int, list[str]]]
    has_manifest: bool
    has_chunks: bool

    @property
    def ok(self) -> bool:
        return self.has_manifest and self.has_chunks and not any(n for n, _ in self.found.values())


def check_health(spark: SparkSession, settings: Settings, store: str, name: str, repo: str | None = None) -> Health:
    """Compare manifest, chunks, vectors and, where a repository is given, its files."""
    ix = open_index(spark, settings, store, name)
    chunks, vectors, listed = ix.chunks.table.read(), ix.vectors.table.read(), ix.manifest.files()
    checks = maintenance.health(chunks, vectors, listed, settings.embedding_dimensions, settings.searchable_chunk_types)
    if repo:
        root = load_repository(repo, settings.repositories_dir)
        now = source_files.with_hash(source_files.discover(spark, root, settings)).select("file_path", "content_hash")
        checks["stale_files"] = maintenance.stale_files(listed, now).select(F.col("file_path").alias("id"))
    config = ix.manifest.config()
    found = {k: (df.count(), [r[0] for r in df.orderBy("id").limit(_SHOWN).collect()]) for k, df in checks.items()}
    found["config"] = (int(bool(config) and config != fingerprint(settings, store)), [])
    return Health(name, found, bool(config), ix.chunks.has_data())


def format_health(h: Health) -> str:
    out = [f"index: {h.index_name}", f"status: {'ok' if h.ok else 'problems found'}"]
    if not h.has_manifest:
        out.append("manifest: missing")
    if not h.has_chunks:
        out.append("chunks: none")
    for k, (n, shown) in h.found.items():
        out.append(f"{k.replace('_', ' ')}: {n}")
        out += [f"  - {x}" for x in shown]
        if n > len(shown) and shown:
            out.append(f"  ... and {n - len(shown)} more")
    return "\n".join(out)
