import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

cp = pytest.importorskip("sparrowdex.llm.cross_polytope")
from pyspark.sql import functions as F  # noqa: E402


def brute(rows, is_query, top=5):
    """All nearest, by exact cosine; rows of usable vectors only."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    out = []
    for i in np.flatnonzero([is_query(k) for k in ids]):
        score = cp.cosine(np.repeat(x[i : i + 1], len(x), 0), x)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:top]
        out += [(int(ids[i]), r + 1, int(ids[j]), float(score[j])) for r, j in enumerate(order)]
    return out


def random_rows(n, dim=64, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    return [(i, v.tolist()) for i, v in enumerate(x)]


def test_recall_and_scores(spark):
    rows = random_rows(3000)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("blob", F.lit("clash"))
    got = [tuple(r) for r in cp.nearest(df, F.col("id") % 50 == 0).collect()]
    want = brute(rows, lambda k: k % 50 == 0)
    assert len(got) == len(want) == 300
    hits = {(q, v) for q, _, v, _ in got} & {(q, v) for q, _, v, _ in want}
    assert len(hits) >= 0.9 * len(want)
    score = {(q, v): s for q, _, v, s in want}
    for q, r, v, s in got:
        assert 1 <= r <= 5 and ((q, v) not in score or math.isclose(s, score[q, v], rel_tol=1e-14))


def share_found(spark, rows, load, monkeypatch, **bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(cp, name, value)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4).cache()
    got = {(r.query_id, r.vec_id) for r in cp.nearest(df, F.col("id") % 50 == 0, load=load).collect()}
    want = {(q, v) for q, _, v, _ in brute(rows, lambda k: k % 50 == 0)}
    return len(got & want) / len(want)


@pytest.mark.parametrize("seed", [5, 6])
def test_more_rotations_keep_recall(spark, seed, monkeypatch):
    assert len(cp.widths_for(64, 3000, 4)) == 2
    assert share_found(spark, random_rows(3000, seed=seed), 4, monkeypatch, BLOCK=256) >= 0.9


def test_recall_beyond_one_rotation(spark, tmp_path):
    """More vectors than one rotation has cells for: 70,000, with 100 queries against brute force."""
    n = 70_000
    assert len(cp.widths_for(64, n)) == 2
    x = np.random.default_rng(9).normal(size=(n, 64)).astype(np.float32)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 64 * n + 1, 64, dtype=np.int32)), pa.array(x.reshape(-1)))
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": lists}), tmp_path / "v.parquet")
    df = spark.read.parquet(str(tmp_path / "v.parquet"))
    got = {(r.query_id, r.vec_id) for r in cp.nearest(df, F.col("id") % 700 == 0).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = u[::700] @ u.T
    score[np.arange(100), np.arange(0, n, 700)] = -2
    want = {(700 * i, int(j)) for i, row in enumerate(score) for j in np.argpartition(-row, 5)[:5]}
    assert len(got & want) >= 0.9 * len(want)


def test_doubles_stay_doubles(spark):
    """Numbers that are no floats take part, whatever their size, and scores are of the numbers given."""
    r = np.random.default_rng(3)
    x = r.normal(size=(120, 8))
    x[1::4] *= 1e300
    x[2::4] *= 1e-300
    x[3::4] += 1e-9
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = cp.nearest(df, F.col("id") % 50 == 0).collect()
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
    for q in (0, 50, 100):
        score = unit @ unit[q]
        order = [j for j in np.argsort(-score) if j != q][:5]
        rows = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.vec_id for r in rows] == order
        assert all(math.isclose(r.score, score[r.vec_id], rel_tol=1e-12, abs_tol=1e-15) for r in rows)
    whole = df.select("vec_id", F.transform("embedding", lambda v: F.signum(v).cast("int")).alias("embedding")).filter("vec_id < 51")
    assert cp.nearest(whole, F.col("id") % 50 == 0).count() == 10


def test_lengths_are_searched_by_themselves(spark, monkeypatch):
    monkeypatch.setattr(cp, "BLOCK", 16)
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=(4, 6, 6, 9)[i % 4]).astype(np.float32).tolist()) for i in range(200)] + [(250, [1.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r.rank, r.vec_id) for r in cp.nearest(df, F.col("id") % 25 == 0).collect()}
    want = set()
    for dim in (4, 6, 9):
        want |= {w[:3] for w in brute([x for x in rows if len(x[1]) == dim], lambda k: k % 25 == 0)}
    assert len(got & want) >= 0.95 * len(want) and {q for q, _, _ in got} == {q for q, _, _ in want}


def test_ids_with_several_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [1.0, 0.01]), (1, [0.0, 1.0]), (2, [1.0, 0.5]), (2, [1.0, 0.5]), (3, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.rank, r.vec_id) for r in cp.nearest(df, F.col("id") == 0, 2).collect()]
    assert sorted(got) == [(1, 1), (2, 2)]


def test_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(cp, "BLOCK", 16)
    one = [1.0, 2.0, 0.0, 1.0]
    rows = [(i, one) for i in range(100, 160)] + [(50, one), (0, [0.0, 0.0, 0.0, 1.0]), (1, [0.5, 0.0, 0.0, 1.0])]
    bad = [(150_000, None), (2, [0.0] * 4), (3, [1.0, None, 0.0, 0.0]), (4, [float("nan")] * 4), (5, [float("inf"), 1.0, 1.0, 1.0]), (6, [1.0]), (None, one), (7, [])]
    df = spark.createDataFrame(rows + rows[:3] + bad, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in cp.nearest(df, F.col("id") % 50 == 0).collect())
    want = sorted(brute(rows, lambda k: k % 50 == 0))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(math.isclose(a[3], b[3], rel_tol=1e-14) for a, b in zip(got, want, strict=True))


def test_few_and_none(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert cp.nearest(none, F.col("id") % 50 == 0).collect() == []
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in cp.nearest(few, F.col("id") % 50 == 0).collect()] == [(0, 1, 1, 0.0)]
