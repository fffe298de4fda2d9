"""Approximate nearest neighbours by cosine with cross-polytope hashing.

A vector is turned by a fast pseudo-rotation (three times: random signs, then a Hadamard transform)
and assigned to the nearest signed axis.  TABLES independent tables hold such assignments, of one
rotation up to LOAD vectors a cell, of several concatenated ones beyond.  A query probes the cells of
least distance loss in each table.  Candidates of a cell are scored by a matrix product, the best of
them again, one by one, in double precision, so that equal vectors have equal scores.

How many cells a query probes is measured: for SAMPLE queries the true neighbours among all vectors are
found in one pass, and the number is the least for which WANTED of them lie in a probed cell.  The sample
sets that number alone; every vector is indexed and every query is answered from the tables.

Cells are dealt to places of about BLOCK vectors; a query goes to a place once, with the cells it probes
there.  Places are cut into blocks of a bounded number of vectors and of queries, so no cell is ever
gathered in one task.  Of identical vectors only the smallest ids can be among the nearest, and only these
are indexed.  Queries for which the cells hold too few candidates are compared with all vectors, in blocks.

Vectors keep their type: floats as such, all else as doubles; scores are of the original numbers.  Vectors
that are null, zero or hold a null or non-finite component take no part, neither do rows without an id.
Vectors of another length than a query's have no cosine with it: each length is searched by itself, rare
ones exactly.  Ties go to the smaller id.  Rows that repeat id and vector count once; an id with several
vectors is found by its nearest.  A very long vector is one row.  Columns other than id and vector, whatever
their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import ship, written

TABLES = 3
LOAD = 512  # mean vectors of a cell from which a further rotation begins to split cells
BLOCK = 4_096
SAMPLE = 128  # queries of each length for which the number of probes is measured
WANTED = 0.97
MOST_LENGTHS = 8  # lengths that get tables, the most frequent ones
_LOSSES = 1 << 30  # losses that the driver looks at when it measures, but for SAMPLE pairs at least
_VALUES = 1 << 22  # numbers that a task holds of a batch's probes
_SEED = 20_231


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of each row; their length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


class Hashes:
    """Cells of all tables: `widths` are the numbers of axes of a table's rotations."""

    def __init__(self, dim: int, widths: list[int], tables: int = TABLES):
        self.size = 1 << max(1, (dim - 1).bit_length())
        self.widths, self.tables = widths, tables
        rng = np.random.default_rng(_SEED)
        self.signs = rng.choice([-1.0, 1.0], (tables, len(widths), 3, self.size))

    def _axes(self, x: np.ndarray, table: int) -> list[np.ndarray]:
        """For each rotation the values at all signed axes, + before - of each axis."""
        padded = np.zeros((len(x), self.size))
        padded[:, : x.shape[1]] = x
        out = []
        for signs, width in zip(self.signs[table], self.widths, strict=True):
            y = padded
            for s in signs:
                y = hadamard(y * s)
            out.append(np.stack([y[:, :width], -y[:, :width]], axis=2).reshape(len(x), 2 * width))
        return out

    def cells(self, x: np.ndarray, table: int) -> np.ndarray:
        code = np.zeros(len(x), dtype=np.int64)
        for v in self._axes(x, table):
            code = code * v.shape[1] + v.argmax(axis=1)
        return code

    def probes(self, x: np.ndarray, table: int, count: int) -> np.ndarray:
        """The `count` cells of each row that lose least, by summed squares below each rotation's best value."""
        code = loss = None
        for v in self._axes(x, table):
            short = min(count, v.shape[1])
            best = np.argsort(-v, axis=1, kind="stable")[:, :short]
            fall = (v.max(axis=1, keepdims=True) - np.take_along_axis(v, best, 1)) ** 2
            if code is None:
                code, loss = best.astype(np.int64), fall
                continue
            code = (code[:, :, None] * v.shape[1] + best[:, None, :]).reshape(len(x), -1)
            loss = (loss[:, :, None] + fall[:, None, :]).reshape(len(x), -1)
            keep = np.argsort(loss, axis=1, kind="stable")[:, :count]
            code, loss = np.take_along_axis(code, keep, 1), np.take_along_axis(loss, keep, 1)
        return code


    def rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For each row of x, probes after which the cell of the same row of y is reached, in the best table."""
        best = np.full(len(x), math.prod(2 * w for w in self.widths))
        for t in range(self.tables):
            falls = [(v.max(axis=1, keepdims=True) - v) ** 2 for v in self._axes(x, t)]
            own = [v.argmax(axis=1) for v in self._axes(y, t)]
            for i in range(len(x)):
                loss = np.zeros(1)
                for f in falls:  # losses of all cells
                    loss = (loss[:, None] + f[i][None, :]).reshape(-1)
                best[i] = min(best[i], int((loss < sum(f[i, o[i]] for f, o in zip(falls, own, strict=True))).sum()) + 1)
        return best


def widths_for(dim: int, vectors: int, load: int = LOAD) -> list[int]:
    """Widths of a table's rotations for so many vectors: cells grow with the vectors."""
    size = 1 << max(1, (dim - 1).bit_length())
    widths, cells = [size], 2 * size
    while vectors / cells > load and len(widths) < 4:
        width = min(size, 1 << max(0, math.ceil(math.log2(vectors / cells / load)) - 1))
        widths.append(width)
        cells *= 2 * width
    return widths


class Plan(NamedTuple):
    """How vectors of one length are searched; no widths: all with all."""

    widths: list[int]
    probes: int
    places: int

    def hashes(self, dim: int) -> Hashes:
        return Hashes(dim, self.widths)


ALL = Plan([], 1, 1)


def _matrix(blobs, kind: str) -> np.ndarray:
    return np.stack([np.frombuffer(b, dtype=kind) for b in blobs]).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)
    y = x / big
    return y / np.sqrt((y * y).sum(axis=1, keepdims=True))


def _even(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two, so that its largest component is near 1: exact, and safe to square."""
    _, power = np.frexp(np.abs(x).max(axis=1, keepdims=True))
    return np.ldexp(x, -power)


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of x with the same row of y; a row's value depends on that row alone."""
    x, y = _even(x), _even(y)
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


Pairs = tuple[np.ndarray, np.ndarray, np.ndarray]


def _top_of(q: np.ndarray, v: np.ndarray, score: np.ndarray, top: int) -> Pairs:
    """The `top` best of each query, each vector id once by its best."""
    order = np.lexsort((v, -score, q))
    q, v, score = q[order], v[order], score[order]
    if len(q):
        by_id = np.lexsort((-score, v, q))  # stable: the first of an id is its best
        again = np.zeros(len(q), dtype=bool)
        again[by_id[1:]] = (q[by_id[1:]] == q[by_id[:-1]]) & (v[by_id[1:]] == v[by_id[:-1]])
        q, v, score = q[~again], v[~again], score[~again]
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < top
    return q[keep], v[keep], score[keep]


def best_pairs(q_ids: np.ndarray, q: np.ndarray, v_ids: np.ndarray, v: np.ndarray, top: int) -> Pairs:
    """For each query its `top` nearest of v but itself: query ids, vector ids, scores."""
    found: tuple[list, list, list] = ([], [], [])
    u = _unit(v)
    spare = len(v_ids) - len(np.unique(v_ids))  # rows that may repeat an id
    for lo in range(0, len(q), 256):
        part = q[lo : lo + 256]
        rough = _unit(part) @ u.T
        rough[q_ids[lo : lo + 256, None] == v_ids[None, :]] = -np.inf
        k = min(top + spare, rough.shape[1])
        least = np.partition(rough, -k, axis=1)[:, -k]
        a, b = np.nonzero((rough >= least[:, None] - 1e-9) & np.isfinite(rough))
        for out, x in zip(found, _top_of(lo + a, v_ids[b], cosine(part[a], v[b]), top), strict=True):
            out.append(x)
    at, ids, scores = (np.concatenate(x) if x else np.zeros(0) for x in found)
    return q_ids[at.astype(np.int64)], ids, scores


def _usable(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, str]:
    """id, dim, blob of all vectors that take part, and the numpy type of the numbers in a blob."""
    e = F.col(vector_col)
    single = isinstance(rows.schema[vector_col].dataType.elementType, T.FloatType)
    kind = "<f4" if single else "<f8"
    numbers = e if single else e.cast("array<double>")
    finite = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col(id_col).isNotNull() & e.isNotNull()).filter(finite & F.exists(numbers, lambda x: x != 0))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pa.compute.list_value_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = np.ascontiguousarray(b.column(1).flatten().to_numpy(zero_copy_only=False), dtype=kind)
            ends = np.cumsum(sizes)
            blobs = [flat[z - n : z].tobytes() for z, n in zip(ends, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes.astype(np.int32)), pa.array(blobs, pa.binary())], names=["id", "dim", "blob"])

    same = rows.select(F.col(id_col).cast("long").alias("id"), numbers.alias("v"))
    return same.mapInArrow(pack, "id long, dim int, blob binary"), kind


def _indexed(vectors: DataFrame, top: int) -> DataFrame:
    """id, dim, blob of the vectors that can be among the nearest of others.

    Of more than top + 1 identical ones, those of the smallest ids.  Only such groups are moved, as ids.
    """
    marked = vectors.withColumn("h", F.unhex(F.md5("blob")))
    many = written(marked.groupBy("h").count().filter(F.col("count") > top + 1).select("h"), "frequent-vectors")
    if many.isEmpty():
        return vectors
    # a rank that is cut to a bound is cut in each task before it is shuffled
    rank = F.dense_rank().over(Window.partitionBy("h").orderBy("id"))
    ids = marked.select("h", "id").join(many, "h", "left_semi").withColumn("r", rank).filter(F.col("r") <= top + 1).groupBy("h").agg(F.collect_set("id").alias("ids"))
    blobs = marked.join(many, "h", "left_semi").groupBy("h").agg(F.any_value("dim").alias("dim"), F.any_value("blob").alias("blob"))
    kept = blobs.join(ids, "h").select(F.explode("ids").alias("id"), "dim", "blob")
    return marked.join(many, "h", "left_anti").select("id", "dim", "blob").union(kept)


def _neighbours(index: DataFrame, sample: list, kind: str, top: int) -> dict[int, list]:
    """For each length the true neighbours of the sampled queries: (query vector, neighbour's vector)."""
    asked: dict[int, list] = {}
    for r in sample:
        asked.setdefault(r["dim"], []).append((r["id"], bytes(r["blob"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(1).to_numpy()
            for dim, queries in asked.items():
                part = b.filter(pa.array(dims == dim))
                if len(part):
                    blobs = np.array(part.column(2).to_pylist(), dtype=object)
                    place = np.arange(len(part))
                    q = _matrix([x for _, x in queries], kind)
                    ids = part.column(0).to_numpy()
                    at, where, score = best_pairs(np.arange(len(q)), q, -1 - place, _matrix(blobs, kind), top + 1)
                    where = (-1 - where).astype(np.int64)
                    other = ids[where] != np.array([i for i, _ in queries])[at.astype(np.int64)]
                    at, where, score = at[other], where[other], score[other]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), dim, np.int32)), pa.array(at.astype(np.int32)), pa.array(ids[where]), pa.array(score), pa.array(blobs[where].tolist(), pa.binary())],
                        names=["dim", "q", "id", "score", "blob"],
                    )

    near = index.mapInArrow(run, "dim int, q int, id long, score double, blob binary")
    rank = F.row_number().over(Window.partitionBy("dim", "q").orderBy(F.desc("score"), "id"))
    rows = near.withColumn("r", rank).filter(F.col("r") <= top).collect()  # at most MOST_LENGTHS * SAMPLE * top
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(r["dim"], []).append((asked[r["dim"]][r["q"]][1], bytes(r["blob"])))
    return out


def plans_for(index: DataFrame, queries: DataFrame, kind: str, top: int, load: int = LOAD) -> dict[int, Plan]:
    """A plan for each length that has more than BLOCK vectors, the MOST_LENGTHS most frequent of them."""
    sizes = index.groupBy("dim").count().filter(F.col("count") > BLOCK).orderBy(F.desc("count"), "dim").limit(MOST_LENGTHS).collect()
    large = {r["dim"]: r["count"] for r in sizes}
    if not large:
        return {}
    first = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("id"), "id", "blob"))
    sample = queries.filter(F.col("dim").isin(list(large))).withColumn("k", first).filter(F.col("k") <= SAMPLE).collect()
    pairs = _neighbours(index, sample, kind, top)
    out = {}
    for dim, n in large.items():
        hashes = Hashes(dim, widths_for(dim, n, load))
        probes = 1
        if dim in pairs:
            most = max(SAMPLE, _LOSSES // math.prod(2 * w for w in hashes.widths))
            x, y = (_unit(_matrix(side, kind)) for side in zip(*pairs[dim][:most], strict=True))
            probes = int(np.quantile(hashes.rank(x, y), WANTED, method="higher"))
        out[dim] = Plan(hashes.widths, probes, -(-n // BLOCK))
    return out


def _spread(side: DataFrame, other: str, own: str) -> DataFrame:
    """Rows of one side, each in its own block and against all blocks of the other side."""
    return side.withColumn(own, F.pmod(F.xxhash64("id"), F.col(own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))


def _score(top: int, kind: str):
    def run(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        found: list[Pairs] = []
        if len(q) and len(v):
            q_ids, v_ids, x, y = q["id"].to_numpy(), v["id"].to_numpy(), _matrix(q["blob"], kind), _matrix(v["blob"], kind)
            probed = np.concatenate(q["cells"].to_list())
            who = np.repeat(np.arange(len(q)), q["cells"].map(len))
            order = np.argsort(probed, kind="stable")
            probed, who = probed[order], who[order]
            cells = v["cell"].to_numpy()
            for c in np.unique(cells):
                a, b = np.searchsorted(probed, [c, c + 1])
                if a < b:
                    inside = cells == c
                    found.append(best_pairs(q_ids[who[a:b]], x[who[a:b]], v_ids[inside], y[inside], top))
        columns = _top_of(*(np.concatenate(p) for p in zip(*found, strict=True)), top) if found else ([], [], [])
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns, strict=True))).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


_FOUND = "query_id long, vec_id long, score double"


def _best(found: DataFrame, top: int) -> DataFrame:
    """The `top` nearest of each query.  Rows of a query are bounded by tables, probes and blocks."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= top)


def _placed(plans: dict[int, Plan], kind: str, probing: bool):
    """Rows of vectors or, if probing, of queries, by table and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = {dim: plan.hashes(dim) for dim, plan in plans.items()}
        for b in batches:
            dims = b.column(1).to_numpy()
            for dim in np.unique(dims):
                same, plan = b.filter(pa.array(dims == dim)), plans.get(int(dim), ALL)
                wide = max(plan.widths, default=1) * 2 * (plan.probes if probing and len(plan.widths) > 1 else 1)
                step = max(1, min(2048, _VALUES // wide))
                for lo in range(0, len(same), step):
                    rows = same.slice(lo, step)
                    x = _unit(_matrix(rows.column(2).to_pylist(), kind)) if plan.widths else None
                    for t in range(hashes[dim].tables if plan.widths else 1):
                        if not plan.widths:
                            cells = np.zeros((len(rows), 1), dtype=np.int64)
                        else:
                            cells = hashes[dim].probes(x, t, plan.probes) if probing else hashes[dim].cells(x, t)[:, None]
                        yield shape(rows, t, cells, plan.places)

    def shape(rows: pa.RecordBatch, t: int, cells: np.ndarray, places: int) -> pa.RecordBatch:
        who = np.repeat(np.arange(len(rows)), cells.shape[1])
        flat = cells.reshape(-1)
        place = flat % places
        names = ["dim", "tab", "place", "id", "blob", "cells" if probing else "cell"]
        if not probing:
            at, last = who, pa.array(flat)
        else:  # the cells that a query probes in a place are one row
            order = np.lexsort((flat, place, who))
            who, flat, place = who[order], flat[order], place[order]
            fresh = np.ones(len(who), dtype=bool)
            fresh[1:] = (who[1:] != who[:-1]) | (place[1:] != place[:-1])
            starts = np.flatnonzero(fresh)
            at, place = who[starts], place[starts]
            last = pa.ListArray.from_arrays(pa.array(np.append(starts, len(flat)).astype(np.int32)), pa.array(flat))
        at = pa.array(at)
        columns = [rows.column(1).take(at), pa.array(np.full(len(at), t, np.int32)), pa.array(place), rows.column(0).take(at), rows.column(2).take(at), last]
        return pa.RecordBatch.from_arrays(columns, names=names)

    return run


def nearest(rows: DataFrame, is_query: Column, top: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", load: int = LOAD) -> DataFrame:
    """query_id, rank, vec_id, score: the `top` nearest found for each row where is_query, of the column `id`, holds."""
    ship(rows.sparkSession)
    vectors, kind = _usable(rows, id_col, vector_col)
    index = written(_indexed(vectors, top), "index")
    queries = written(vectors.filter(is_query).distinct(), "queries")
    plans = plans_for(index, queries, kind, top, load)
    schema = "dim int, tab int, place long, id long, blob binary, "
    placed = index.mapInArrow(_placed(plans, kind, False), schema + "cell long")
    asked = queries.mapInArrow(_placed(plans, kind, True), schema + "cells array<long>")
    at = ["dim", "tab", "place"]
    blocks = lambda df, name: df.groupBy(*at).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias(name))
    sizes = written(blocks(asked, "qb").join(blocks(placed, "vb"), at), "places")
    run = _score(top, kind)
    found = _spread(asked.join(sizes, at), "vb", "qb").groupBy(*at, "qb", "vb").cogroup(_spread(placed.join(sizes, at), "qb", "vb").groupBy(*at, "qb", "vb")).applyInPandas(run, _FOUND)
    found = written(found, "found")
    # Too few candidates in the cells: all vectors of the length, in blocks.
    held = found.groupBy("query_id").agg(F.countDistinct("vec_id").alias("held"))
    ids = index.groupBy("dim").agg(F.count("*").alias("n"))
    few = queries.join(held, queries["id"] == held["query_id"], "left").join(ids, "dim").filter(F.coalesce("held", F.lit(0)) < F.least(F.lit(top), F.col("n") - 1))
    short = written(few.select("id", "dim", "blob", "n"), "short")
    if not short.isEmpty():
        q = short.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("qb"), F.ceil(F.max("n") / F.lit(BLOCK)).cast("int").alias("vb"))
        q = written(q, "short-places")
        one = F.lit(0).cast("long")
        ours = _spread(short.join(q, "dim").withColumn("cells", F.array(one)), "vb", "qb").groupBy("dim", "qb", "vb")
        theirs = _spread(index.join(q, "dim").withColumn("cell", one), "qb", "vb").groupBy("dim", "qb", "vb")
        found = found.union(ours.cogroup(theirs).applyInPandas(run, _FOUND))
    return _best(found, top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
