"""Exact vector search over batches of questions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keyword import top_k

#: Questions that meet a vector at once, about; that many are sent to every task, more are dealt to blocks.
QUESTION_BLOCK = 512


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """cosine: the dot product, cosine for unit vectors; l2: 1 / (1 + squared distance)."""
    if metric == "cosine":
        return dot(a, b)
    if metric == "l2":
        square = F.aggregate(
            F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x
        )
        return 1 / (1 + square)
    raise ValueError(f"unknown metric {metric!r}: cosine or l2")


def vector_scores(vectors: DataFrame, questions: DataFrame, metric: str = "cosine", carry: tuple[str, ...] = ()) -> DataFrame:
    """qid, id, score of every vector(id, embedding) for every question(qid, qvec).

    A stated set of questions against all rows: a block of questions is one row, so a vector meets as many
    rows as there are blocks.  One block is broadcast, its size being bounded; vectors are then scanned where
    they lie and nothing is shuffled.  More blocks are met in Spark's own way, and never pass the driver.
    """
    blocks = max(1, -(-questions.count() // QUESTION_BLOCK))
    block = F.pmod(F.xxhash64("qid"), F.lit(blocks)).alias("_block")
    row = F.struct("qid", F.col("qvec").cast("array<float>").alias("qvec"))
    asked = questions.select(block, row.alias("q")).groupBy("_block").agg(F.collect_list("q").alias("asked")).select("asked")
    pairs = vectors.select("id", *carry, "embedding").crossJoin(F.broadcast(asked) if blocks == 1 else asked)
    scored = pairs.select("id", *carry, "embedding", F.explode("asked").alias("q"))
    return scored.select("q.qid", "id", *carry, similarity(F.col("embedding"), F.col("q.qvec"), metric).alias("score"))


def vector_search(vectors: DataFrame, questions: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """The k nearest of each question; equal scores in insertion order where vectors have it (ord), else by id."""
    carry = ("ord",) if "ord" in vectors.columns else ()
    return top_k(vector_scores(vectors, questions, metric, carry), k, *(carry or ("id",))).drop(*carry)
