"""Hybrid retrieval: normalised vector and keyword candidates, fused, reranked, with their neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.predicates import MetadataFilters, filtered, searchable
from ..settings import Settings
from .keyword import keyword_search
from .models import Reranker
from .vector import vector_search


def candidate_depth(k: int) -> int:
    """Candidates that each side brings for k results."""
    return max(4 * k, 20)


def _over_best(best: Column) -> Column:
    return F.when(best <= 0, F.lit(0.0)).otherwise(F.col("score") / best)


def max_normalize(scores: DataFrame) -> DataFrame:
    """Scores over the best of their question; all 0 if that is not above 0.  Negative scores stay negative.

    For candidates: a question's rows meet in one task, and a search leaves candidate_depth() of them.
    """
    return scores.withColumn("score", _over_best(F.max("score").over(Window.partitionBy("qid"))))


def max_normalize_all(scores: DataFrame) -> DataFrame:
    """The same for any number of rows a question: the best is a partial aggregate that is joined back."""
    best = scores.groupBy("qid").agg(F.max("score").alias("_best"))
    return scores.join(best, "qid").withColumn("score", _over_best(F.col("_best"))).drop("_best")


def fuse(vector: DataFrame, keyword: DataFrame, vector_weight: float = 0.25, keyword_weight: float = 0.75) -> DataFrame:
    """qid, id, score, both sides' normalised scores and ranks, of candidates of either side.

    One aggregate over the union instead of an outer join: a single shuffle.  A missing side counts 0.
    """
    side = lambda df, v, k: df.select("qid", "id", *[F.col(c).alias(f"{s}_{c}") if s == use else F.lit(None).cast(t).alias(f"{s}_{c}") for s, use in (("vector", v), ("keyword", k)) for c, t in (("score", "double"), ("rank", "int"))])
    both = side(max_normalize(vector), "vector", "").union(side(max_normalize(keyword), "", "keyword"))
    return both.groupBy("qid", "id").agg(
        (vector_weight * F.coalesce(F.max("vector_score"), F.lit(0.0)) + keyword_weight * F.coalesce(F.max("keyword_score"), F.lit(0.0))).alias("score"),
        F.coalesce(F.max("vector_score"), F.lit(0.0)).alias("vector_score"),
        F.coalesce(F.max("keyword_score"), F.lit(0.0)).alias("keyword_score"),
        F.max("vector_rank").alias("vector_rank"),
        F.max("keyword_rank").alias("keyword_rank"),
    )


def ranked(candidates: DataFrame) -> DataFrame:
    """Fused candidates in order: at equal scores those of the vector side come first, in its order."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("keyword_rank"), "id")
    return candidates.withColumn("rank", F.row_number().over(order))


def hydrate(candidates: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Candidates with their chunk's columns; where the chunk is gone, with the vector row's and no content."""
    own = [c for c in chunks.columns if c != "id"]
    spare = [c for c in vectors.columns if c in own]
    kept = vectors.select("id", *[F.col(c).alias(f"_v_{c}") for c in spare])
    joined = candidates.join(chunks.withColumn("_found", F.lit(True)), "id", "left").join(kept, "id", "left")
    filled = {c: F.when(F.col("_found"), F.col(c)).otherwise(F.col(f"_v_{c}")) if c in spare else F.col(c) for c in own}
    filled["content"] = F.coalesce(F.col("content"), F.lit(""))
    return joined.withColumns(filled).drop("_found", *[f"_v_{c}" for c in spare])


def keep_first(rows: DataFrame) -> DataFrame:
    """The first row of each id within its question, in order of (hit_rank, part_index), ranked anew."""
    first = Window.partitionBy("qid", "id").orderBy("hit_rank", "part_index")
    order = Window.partitionBy("qid").orderBy("hit_rank", "part_index")
    return rows.withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k").withColumn("rank", F.row_number().over(order))


def expand_neighbours(hits: DataFrame, chunks: DataFrame, window: int = 1) -> DataFrame:
    """Hits that are parts of a split chunk bring the parts around them, in their order, with their score.

    A part's id is made from its parent's, so neighbours are looked up by equality, never by range.
    """
    marked = hits.withColumns({"is_context_expansion": F.lit(False), "context_source_chunk_id": F.lit(None).cast("string"), "hit_rank": F.col("rank")})
    if window <= 0:
        return marked.drop("hit_rank")
    split = F.coalesce("is_chunk_part", F.lit(False)) & (F.coalesce("parent_chunk_id", F.lit("")) != "") & (F.coalesce("part_index", F.lit(0)) > 0) & (F.coalesce("part_count", F.lit(0)) > 0)
    whole = marked.filter(~split).withColumn("part_index", F.coalesce("part_index", F.lit(0)))
    parts = marked.filter(split)
    around = F.sequence(F.greatest(F.lit(1), F.col("part_index") - window), F.least(F.col("part_count"), F.col("part_index") + window))
    scores = [c for c in hits.columns if c not in chunks.columns and c != "rank"]
    wanted = parts.select(*scores, "hit_rank", F.col("id").alias("_hit"), "parent_chunk_id", F.explode(around).alias("_at"))
    wanted = wanted.select(*scores, "hit_rank", "_hit", F.concat_ws(":", "parent_chunk_id", F.lit("part"), F.col("_at").cast("string")).alias("id"))
    other = (
        wanted.filter("id <> _hit")
        .join(chunks, "id")
        .withColumns({"is_context_expansion": F.lit(True), "context_source_chunk_id": F.col("_hit"), "rank": F.col("hit_rank")})
        .drop("_hit")
    )
    return keep_first(whole.unionByName(parts).unionByName(other)).drop("hit_rank")


def retrieve(
    chunks: DataFrame,
    vectors: DataFrame,
    questions: DataFrame,
    k: int = 5,
    filters: MetadataFilters | None = None,
    settings: Settings | None = None,
    reranker: Reranker | None = None,
    metric: str = "cosine",
) -> DataFrame:
    """Ranked chunks for each of questions(qid, question, qvec): qid, rank, score, debug scores, chunk columns.

    Filters apply before corpus statistics and before vector scoring.  There may be more than k rows
    for a question, as hits bring their neighbours.
    """
    s = settings or Settings()
    depth = candidate_depth(k)
    by_vector = vector_search(filtered(vectors, filters), questions, depth, metric)
    by_keyword = keyword_search(searchable(chunks, filters, s.searchable_chunk_types), questions, depth)
    merged = ranked(fuse(by_vector, by_keyword, s.vector_weight, s.keyword_weight)).withColumnsRenamed(
        {"vector_score": "debug_vector_score", "keyword_score": "debug_keyword_score"}
    )
    merged = merged.withColumn("debug_combined_score", F.col("score")).drop("vector_rank", "keyword_rank")
    if reranker is None:
        hits = hydrate(merged.filter(F.col("rank") <= k), chunks, vectors).withColumn("debug_reranker_score", F.lit(None).cast("double"))
    else:  # all candidates are seen; the model's score replaces the fused one
        hits = reranker.rerank(hydrate(merged, chunks, vectors), questions.select("qid", "question"), k)
    return expand_neighbours(hits, chunks, s.context_window_parts)
