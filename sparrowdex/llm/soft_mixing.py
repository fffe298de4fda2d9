"""Mixing documents to target weights of domains, with soft membership.

A classifier learned from a small labelled table gives every document a posterior over domains.  A
rate is then fitted for every document, so that the expected tokens of each domain - the sum over
documents of rate * tokens * posterior - match the targets, by least squares, weighted by the inverse
of the posteriors' Gram matrix, plus NEARNESS times the squared distance of the rates from their start.

The fit is by projected gradients.  All steps that the rates have taken add up to one number a domain,
so a rate is the projection max(bound, start + posterior . numbers), and needs no storing.  A step is the
gradient of the misfit, scaled by the Gram matrix of the documents whose rates are above their bound: the
first one is a plain projected gradient step; unscaled ones would need thousands where bounds bind, as a
step then moves part of the documents only.  A line search keeps each step a gain, and steps go on until
the gradient is nothing but rounding.  A step is one aggregate over some fifty bytes a document: it gives
value, gradient and scale, and leaves no lineage.

The classifier is naive Bayes over hashed word ends; a document's score is the mean log likelihood of its
words times n * E / (n + E) for n words and E = evidence: the same rule for all lengths, by which a long
document counts as E words and keeps a soft membership.

Built-in functions only, no shuffle but of aggregates of a fixed number of rows.  Null and empty texts
have no tokens, even posteriors, and take the rates that these give.  A very long text costs its words as
one array in one row.  Repeated rows get equal rates; rows without an id are like others.  Labels that no
target names are left out; with no labelled rows all posteriors are even; empty tables give empty ones.
Columns other than id and text are not read by soft_mixing() and kept by mixed(), whatever their names.
Targets that no rates can reach are met as nearly as least squares allow.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, written

BUCKETS = 4_096
#: Words that a very long document counts as, see above.
EVIDENCE = 16.0
LABELLED_ROWS = 4_000
#: Weight of the distance from the start: decides between rates that fit alike.
NEARNESS = 1e-6
#: Length of the gradient, in shares of all tokens, at which the fit has converged.
TOLERANCE = 1e-7
#: A guard that ends a fit which rounding keeps from converging.
MOST_PASSES = 300
#: Sums of one aggregate; more are taken by rows of (place, value).
MOST_SUMS = 128
#: Copies of a row that one array lists.
COPIES = 1_024
_BLANK = "[\\x20\\x09-\\x0D]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _BLANK), lambda w: w != "")


def _bucket(word: Column) -> Column:
    """Hash of a word's last letters."""
    return F.pmod(F.hash(F.lower(F.substring(word, -3, 3))), F.lit(BUCKETS))


def label_sample(labels: DataFrame, docs: DataFrame, domain_col: str, rows: int = LABELLED_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text, domain of the `rows` labelled ids that come first by hash, and of all documents that have one of them."""
    ids = labels.select(F.col(id_col).alias("_id")).filter("_id is not null").distinct()
    drawn = ids.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    # at most `rows` ids: bounded whatever the tables' sizes
    hit = docs.join(F.broadcast(drawn), docs[id_col] == F.col("_id"), "left_semi")
    return hit.select(F.col(text_col).alias("text"), F.col(domain_col).alias("domain"))


def fit_classifier(labelled: DataFrame, domains: list[str]) -> list[list[float]]:
    """Log likelihood of each bucket for each domain, from labelled(text, domain)."""
    known = labelled.filter(F.col("domain").isin(domains))
    rows = known.select("domain", F.explode(_words(F.col("text"))).alias("w")).select("domain", _bucket(F.col("w")).alias("b")).groupBy("domain", "b").count().collect()
    counts = np.full((len(domains), BUCKETS), 0.5)
    for r in rows:  # at most domains * BUCKETS
        counts[domains.index(r["domain"]), r["b"]] += r["count"]
    taught = counts.sum(axis=1) > 0.5 * BUCKETS
    logs = np.log(counts / counts.sum(axis=1, keepdims=True))
    logs[~taught] = math.log(1e-9)  # never likelier than a domain with examples
    if not taught.any():
        logs[:] = 0.0
    return np.round(logs, 9).tolist()


def _looked_up(weights: Column):
    return lambda total, bucket: total + F.get(weights, bucket)


def _table(values: list[float]) -> Column:
    """Numbers as one text that the optimizer turns into one constant array: no node in the plan for each."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def with_posteriors(docs: DataFrame, weights: list[list[float]], text_col: str = "text", evidence: float = EVIDENCE) -> DataFrame:
    """docs with _tokens and the array _post of posteriors, in the order of the domains."""
    buckets = docs.withColumn("_buckets", F.transform(_words(F.col(text_col)), _bucket))
    n = F.size("_buckets")
    sums = [F.aggregate("_buckets", F.lit(0.0), _looked_up(_table(w))) for w in weights]
    # sum / n * (n * E / (n + E))
    scored = buckets.select(*docs.columns, n.cast("long").alias("_tokens"), F.array(*[s * evidence / (n + evidence) for s in sums]).alias("_sums"))
    shifted = scored.withColumn("_sums", F.transform("_sums", lambda x: F.exp(x - F.array_max("_sums"))))
    total = F.aggregate("_sums", F.lit(0.0), lambda a, x: a + x)
    return shifted.withColumn("_post", F.transform("_sums", lambda x: x / total)).drop("_sums")


def _rate(steps: list[list[float]], start: float, least: float) -> Column:
    rate = F.greatest(F.lit(least), F.lit(start))
    for v in steps:
        move = sum((F.get("_post", F.lit(k)) * F.lit(float(x)) for k, x in enumerate(v)), F.lit(0.0))
        rate = F.greatest(F.lit(least), rate + move)
    return rate


def _sums(rows: DataFrame, values: list[Column]) -> np.ndarray:
    """Sums of the values over all rows; 0 where there are none."""
    if len(values) <= MOST_SUMS:
        got = rows.agg(*[F.coalesce(F.sum(v), F.lit(0.0)).cast("double") for v in values]).first()
        return np.array(got, dtype=float)
    out = np.zeros(len(values))
    # partial sums before the shuffle, of as many rows as there are values
    placed = rows.select(F.posexplode(F.array(*[v.cast("double") for v in values])).alias("k", "v"))
    for r in placed.groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r["k"]] = r["v"] or 0.0
    return out


def fit_rates(posteriors: DataFrame, targets: list[float], start: float = 1.0, least: float = 0.0) -> list[list[float]]:
    """What the steps of all domains add up to, as the one step of _rate.  posteriors has _tokens and _post."""
    k = len(targets)
    p = [F.get("_post", F.lit(i)) for i in range(k)]
    t = F.col("_tokens")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def gram(values) -> np.ndarray:
        out = np.zeros((k, k))
        for (i, j), v in zip(pairs, values, strict=True):
            out[i, j] = out[j, i] = v
        return out

    first = _sums(posteriors, [t, *[t * p[i] * p[j] for i, j in pairs]])
    tokens = float(first[0])
    if tokens <= 0:
        return []
    values, vectors = np.linalg.eigh(gram(first[1:]) / tokens)
    known = values > 1e-9 * values[-1]
    basis = vectors[:, known] / np.sqrt(values[known])  # here the Gram matrix of all documents is the identity
    goal = basis.T @ (np.array(targets, dtype=float) / tokens)

    def look(y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Value, gradient and scale where the steps add up to y."""
        free = sum((x * F.lit(float(v)) for x, v in zip(p, basis @ y, strict=True)), F.lit(float(start)))
        at = posteriors.select("_tokens", "_post", free.alias("_free")).withColumn("_rate", F.greatest(F.lit(float(least)), "_free"))
        moves = F.when(F.col("_free") > least, t).otherwise(0)
        row = _sums(at, [t * F.col("_rate") * (F.col("_free") - F.col("_rate") / 2), *[F.col("_rate") * t * x for x in p], *[moves * p[i] * p[j] for i, j in pairs]]) / tokens
        value = goal @ y - NEARNESS / 2 * (y @ y) - row[0]
        return value, goal - NEARNESS * y - basis.T @ row[1 : k + 1], NEARNESS * np.eye(len(y)) + basis.T @ gram(row[k + 1 :]) @ basis

    y = np.zeros(len(goal))
    value, slope, scale = look(y)
    passes = 1
    while np.linalg.norm(slope) > TOLERANCE and passes < MOST_PASSES:
        way = np.linalg.solve(scale, slope)
        rise, size = float(slope @ way), 1.0
        while passes < MOST_PASSES:
            new = look(y + size * way)
            passes += 1
            bend = float(new[1] @ way)
            if new[0] >= value - 1e-12 * abs(value) and bend >= -rise / 2:
                break
            # the value is concave in y: its top on this line is where its slope crosses zero
            size *= min(0.5, max(0.05, rise / max(rise - bend, 1e-300)))
        y = y + size * way
        value, slope, scale = new
    return [(basis @ y).tolist()]


def totals(posteriors: DataFrame, k: int) -> list[float]:
    """Tokens of each domain at rate 1."""
    return _sums(posteriors, [F.col("_tokens") * F.get("_post", F.lit(i)) for i in range(k)]).tolist()


def soft_mixing(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, a posterior p_<domain> each, and rate, of every row of docs.

    The targets are `weights` (scaled to sum 1) of all tokens.
    """
    domains = sorted(weights)
    share = [weights[d] / sum(weights.values()) for d in domains]
    model = fit_classifier(labelled, domains)
    table = with_posteriors(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    table = written(table.select("doc_id", "_tokens", "_post"), "posteriors")
    total = sum(totals(table, len(domains)))
    steps = fit_rates(table, [total * s for s in share])
    return table.select(
        "doc_id",
        F.col("_tokens").alias("n_tokens"),
        *[F.get("_post", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(domains)],
        F.round(_rate(steps, 1.0, 0.0), 9).alias("rate"),
    )


def mixed(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with each row as often as its rate says, at least once; same columns.

    The budget is the least for which no domain is above its target at rate 1, so targets are met by
    repeating documents, never by dropping them.  The part of a rate after the point is a chance, drawn
    by a hash of the id.
    """
    domains = sorted(weights)
    share = [weights[d] / sum(weights.values()) for d in domains]
    model = fit_classifier(labelled, domains)
    # the whole rows are scored twice: cheaper than to store them once more
    small = written(with_posteriors(docs.select(F.col(text_col).alias("text")), model).select("_tokens", "_post"), "posteriors")
    natural = totals(small, len(domains))
    budget = max((n / s for n, s in zip(natural, share, strict=True) if s > 0), default=0.0)
    steps = fit_rates(small, [budget * s for s in share], least=1.0)
    discard(small)
    names = docs.columns
    renamed = docs.toDF(*[f"c{i}" for i in range(len(names))])
    scored = with_posteriors(renamed, model, f"c{names.index(text_col)}")
    rate = F.round(_rate(steps, 1.0, 1.0), 9)
    chance = F.pmod(F.xxhash64(f"c{names.index(id_col)}", F.lit(29)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = scored.withColumn("_rate", rate).withColumn("_copies", F.floor("_rate") + F.when(chance < F.col("_rate") - F.floor("_rate"), 1).otherwise(0))
    # in two steps, so that no array lists more than COPIES of them
    blocks = copies.withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / COPIES))))
    inside = F.least(F.lit(COPIES), F.col("_copies") - F.col("_block") * COPIES)
    return blocks.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), inside))).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
