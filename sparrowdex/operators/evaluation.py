"""Retrieval quality over batches of questions, in long form: one row for each question and cut."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SELECTOR_FIELDS = ("file_path", "symbol", "chunk_type")


def resolve_relevant(selectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """qid, id of chunks that some selector of the question names; fields a selector lacks are free.

    Selectors fall in at most seven patterns of given fields; each is an equality join.
    """
    found = []
    for bits in range(1, 1 << len(SELECTOR_FIELDS)):
        given = [f for k, f in enumerate(SELECTOR_FIELDS) if bits >> k & 1]
        free = [f for f in SELECTOR_FIELDS if f not in given]
        shape: Column = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in given] + [F.col(f).isNull() for f in free])
        found.append(selectors.filter(shape).select("qid", *given).join(chunks.select("id", *given), given).select("qid", "id"))
    return reduce(DataFrame.union, found).distinct()


def question_metrics(questions: DataFrame, relevant: DataFrame, retrieved: DataFrame, ks: list[int]) -> DataFrame:
    """qid, k, n_relevant, n_retrieved, recall, precision, ndcg, reciprocal_rank.

    questions(qid), relevant(qid, id), retrieved(qid, id, rank).  Precision divides by k, whatever was
    returned; the reciprocal rank looks at the whole list; questions without relevant rows score 0.
    """
    cuts = sorted({k for k in ks if k > 0})
    marked = retrieved.join(relevant.select("qid", "id", F.lit(True).alias("hit")).distinct(), ["qid", "id"], "left")
    wanted = relevant.groupBy("qid").agg(F.countDistinct("id").alias("n_relevant"))
    gain = 1 / F.log2(F.col("rank") + 1)
    sums = []
    for k in cuts:
        inside = F.col("hit") & (F.col("rank") <= k)
        # a set of hits: an id that is returned twice counts once
        sums += [F.countDistinct(F.when(inside, F.col("id"))).alias(f"h{k}"), F.sum(F.when(inside, gain)).alias(f"g{k}")]
    seen = marked.groupBy("qid").agg(F.count("*").alias("n_retrieved"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"), *sums)
    both = questions.select("qid").distinct().join(wanted, "qid", "left").join(seen, "qid", "left")
    n = F.coalesce("n_relevant", F.lit(0))
    hits = lambda k: F.coalesce(F.col(f"h{k}"), F.lit(0))

    def ideal(k: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n, F.lit(k)).cast("int"))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))

    rows = F.array(
        *[
            F.struct(
                F.lit(k).alias("k"),
                F.when(n > 0, hits(k) / n).otherwise(0.0).alias("recall"),
                (hits(k) / k).alias("precision"),
                F.when(n > 0, F.coalesce(F.col(f"g{k}"), F.lit(0.0)) / ideal(k)).otherwise(0.0).alias("ndcg"),
            )
            for k in cuts
        ]
    )
    out = both.select("qid", n.alias("n_relevant"), F.coalesce("n_retrieved", F.lit(0)).alias("n_retrieved"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), F.explode(rows).alias("m"))
    return out.select("qid", "m.k", "n_relevant", "n_retrieved", "m.recall", "m.precision", "m.ndcg", "reciprocal_rank")


def mean_metrics(metrics: DataFrame) -> DataFrame:
    """k, recall, precision, ndcg, mrr: means over questions."""
    return metrics.groupBy("k").agg(F.avg("recall").alias("recall"), F.avg("precision").alias("precision"), F.avg("ndcg").alias("ndcg"), F.avg("reciprocal_rank").alias("mrr"))


def metric_names(ks: list[int]) -> list[str]:
    return ["mrr", *(f"{m}@{k}" for k in sorted(ks) for m in ("recall", "precision", "ndcg"))]


def named_means(metrics: DataFrame, ks: list[int]) -> dict[str, float]:
    """The means by name; 0 where there was no question."""
    out = dict.fromkeys(metric_names(ks), 0.0)
    for r in mean_metrics(metrics).collect():  # one row for each cut
        if r["k"] not in ks:
            raise KeyError(r["k"])
        out["mrr"] = r["mrr"]
        for m in ("recall", "precision", "ndcg"):
            out[f"{m}@{r['k']}"] = r[m]
    return out
