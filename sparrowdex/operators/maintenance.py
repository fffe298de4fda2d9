"""Index maintenance: differences, upserts, deletions and consistency checks as set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import SEARCHABLE_TYPES


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """file_path, status (added, changed, deleted, same) of two tables of file_path, content_hash."""
    both = old.select("file_path", F.col("content_hash").alias("o")).join(new.select("file_path", F.col("content_hash").alias("n")), "file_path", "full_outer")
    status = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").when(F.col("o") != F.col("n"), "changed").otherwise("same")
    return both.select("file_path", status.alias("status"))


def stale_ids(manifest: DataFrame, diff: DataFrame) -> DataFrame:
    """Chunk ids of files that changed or went."""
    gone = diff.filter(F.col("status").isin("changed", "deleted"))
    return manifest.join(gone, "file_path", "left_semi").select(F.explode("chunk_ids").alias("id"))


def delete(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("id").distinct(), "id", "left_anti").select(*rows.columns)


def upsert(rows: DataFrame, new: DataFrame) -> DataFrame:
    """rows with new ones added; an id that is there keeps its place (ord), with the new content.

    Within `new` the last of an id wins and the first gives the place.  New ids go behind all others.
    """
    last = Window.partitionBy("id").orderBy(F.desc("ord"))
    fresh = (
        new.withColumns({"_k": F.row_number().over(last), "_first": F.min("ord").over(Window.partitionBy("id"))})
        .filter("_k = 1")
        .drop("_k")
    )
    top = rows.agg(F.coalesce(F.max("ord") + 1, F.lit(0)).alias("_top"))
    places = rows.select("id", F.col("ord").alias("_old"))
    placed = fresh.join(places, "id", "left").join(top).withColumn("ord", F.coalesce("_old", F.col("_top") + F.col("_first")))
    return rows.join(new.select("id").distinct(), "id", "left_anti").select(*rows.columns).unionByName(placed.select(*rows.columns))


def missing(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ids of left that right lacks."""
    return left.select("id").distinct().join(right.select("id"), "id", "left_anti")


def chunks_by_file(chunks: DataFrame) -> DataFrame:
    """file_path, chunk_ids in insertion order: a row for each file, as large as the file."""
    rows = F.sort_array(F.collect_list(F.struct("ord", "id")))
    return chunks.groupBy("file_path").agg(rows.alias("_rows")).select("file_path", F.transform("_rows", lambda r: r["id"]).alias("chunk_ids"))


def health(chunks: DataFrame, vectors: DataFrame, manifest: DataFrame, dimensions: int, types: tuple[str, ...] = SEARCHABLE_TYPES) -> dict[str, DataFrame]:
    """Frames of offending ids by check; all are empty for a sound index."""
    noted = manifest.select(F.explode("chunk_ids").alias("id"))
    return {
        "missing_chunks": missing(noted, chunks),
        "unlisted_chunks": missing(chunks, noted),
        "missing_vectors": missing(chunks.filter(F.col("chunk_type").isin(*types)), vectors),
        "orphan_vectors": missing(vectors, chunks),
        "wrong_dimensions": vectors.filter(F.size("embedding") != dimensions).select("id"),
    }


def stale_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Listed files that are gone or differ.  New files are not stale."""
    return manifest_diff(manifest, files).filter(F.col("status").isin("changed", "deleted")).select("file_path", "status")


def counts(chunks: DataFrame, vectors: DataFrame, manifest: DataFrame, types: tuple[str, ...] = SEARCHABLE_TYPES) -> DataFrame:
    """One row: n_chunks, n_searchable, n_vectors, n_files."""
    c = chunks.agg(F.count("*").alias("n_chunks"), F.count_if(F.col("chunk_type").isin(*types)).alias("n_searchable"))
    return c.join(vectors.agg(F.count("*").alias("n_vectors"))).join(manifest.agg(F.count("*").alias("n_files")))
