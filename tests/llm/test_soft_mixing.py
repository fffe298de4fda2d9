import numpy as np
import pytest

mix = pytest.importorskip("sparrowdex.llm.soft_mixing")
from pyspark.sql import functions as F  # noqa: E402

TEXTS = {"en": "the house and the garden with them", "fr": "la maison avec les fleurs bleues", "de": "nicht alle Häuser haben einen Garten"}


def rows(n=60):
    out = []
    for i in range(n):
        d = ("en", "en", "en", "fr", "de")[i % 5]
        out.append((i, " ".join([TEXTS[d]] * (1 + i % 7)), d))
    return out


def brute(post, tokens, targets, least=0.0, rounds=20_000):
    """Projected gradient with small steps on the same objective, in numpy."""
    r = np.ones(len(tokens))
    gram = (post * tokens[:, None]).T @ post
    for _ in range(rounds):
        left = targets - (post * (r * tokens)[:, None]).sum(axis=0)
        r = np.maximum(least, r + 0.2 * post @ (np.linalg.pinv(gram) @ left))
    return r


def frames(spark, extra=()):
    docs = spark.createDataFrame([(*r, 0.5) for r in [*rows(), *extra]], "doc_id long, text string, lang string, rate double").repartition(3)
    labels = docs.filter("doc_id is not null").select("doc_id").distinct()
    return docs, mix.label_sample(labels, docs, "lang")


@pytest.mark.parametrize("weights", [{"en": 0.2, "fr": 0.5, "de": 0.3}, {"en": 0.98, "fr": 0.01, "de": 0.01}])
def test_targets_and_brute_force(spark, weights):
    docs, labelled = frames(spark, [(None, "the house", None), (90, None, "en"), (91, " ", "fr"), (3, rows()[3][1], "fr")])
    got = mix.soft_mixing(docs, labelled, weights).collect()
    assert len(got) == 64
    post = np.array([[r[f"p_{d}"] for d in sorted(weights)] for r in got])
    tokens, rate = np.array([float(r.n_tokens) for r in got]), np.array([r.rate for r in got])
    assert np.allclose(post.sum(axis=1), 1) and (rate >= 0).all()
    targets = np.array([weights[d] for d in sorted(weights)]) * tokens.sum()
    want = brute(post, tokens, targets)
    assert np.allclose((post * (rate * tokens)[:, None]).sum(axis=0), (post * (want * tokens)[:, None]).sum(axis=0), rtol=1e-3)
    assert np.allclose((post * (rate * tokens)[:, None]).sum(axis=0), targets, rtol=1e-3)
    best = {r.doc_id: sorted(weights)[int(np.argmax(post[i]))] for i, r in enumerate(got)}
    assert all(best[i] == d for i, _, d in rows())
    assert all(np.allclose(post[i], 1 / 3) for i, r in enumerate(got) if r.n_tokens == 0)


def test_mixed_drops_nothing(spark):
    docs, labelled = frames(spark)
    weights = {"en": 0.3, "fr": 0.4, "de": 0.3}
    out = mix.mixed(docs, labelled, weights)
    assert out.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert set(counts) == set(range(60))
    tokens = {r.lang: r.n for r in out.withColumn("n", F.size(F.split("text", " "))).groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    assert abs(tokens["fr"] / sum(tokens.values()) - 0.4) < 0.06


def test_empty_and_unlabelled(spark):
    docs, _ = frames(spark)
    none = docs.limit(0)
    assert mix.soft_mixing(none, none.select("text", F.col("lang").alias("domain")), {"en": 1.0}).collect() == []
    got = mix.soft_mixing(docs, none.select("text", F.col("lang").alias("domain")), {"en": 0.5, "fr": 0.5}).collect()
    assert all(r.p_en == 0.5 and abs(r.rate - 1) < 1e-6 for r in got)


@pytest.mark.parametrize(("least", "weights"), [(0.0, {"de": 0.35, "en": 0.25, "fr": 0.4}), (1.0, {"de": 0.15, "en": 0.8, "fr": 0.15})])
def test_binding_bounds_against_brute_force(spark, least, weights):
    """A hot domain cut to a quarter by rates of 0 or more, and targets near to the natural shares with rates of 1 or more."""
    r = np.random.default_rng(3)
    hot = r.random(200) < 0.9
    raw = r.random((200, 3)) * 0.3 + np.where(hot[:, None], [0.0, 3.0, 0.0], [1.0, 0.0, 1.0]) * r.random((200, 1))
    post, tokens = raw / raw.sum(axis=1, keepdims=True), r.integers(5, 400, 200)
    table = spark.createDataFrame([(int(n), p.tolist()) for n, p in zip(tokens, post, strict=True)], "_tokens long, _post array<double>")
    targets = np.array([weights[d] for d in sorted(weights)]) * tokens.sum()
    steps = mix.fit_rates(table, targets.tolist(), least=least)
    rate = np.array([x.rate for x in table.select(mix._rate(steps, 1.0, least).alias("rate")).collect()])
    want = brute(post, tokens.astype(float), targets, least=least, rounds=20_000)
    inverse = np.linalg.pinv((post * tokens[:, None]).T @ post)
    left = [targets - (post * (x * tokens)[:, None]).sum(axis=0) for x in (rate, want)]
    size = [x @ inverse @ x for x in left]
    assert (rate >= least).all() and (rate == least).sum() > 20
    # the fit is as good as the brute force's, whatever way it took
    assert size[0] <= size[1] * (1 + 1e-3) + 1e-6 * tokens.sum()
    assert np.allclose(left[0], left[1], atol=1e-3 * tokens.sum())


def simulated(seed, n=400):
    """Two domains, soft posteriors, any shares and targets, also such that most rates are at their bound."""
    r = np.random.default_rng(seed)
    hot, sharp = r.uniform(0.05, 0.98), r.uniform(0.5, 6)
    raw = np.exp(sharp * np.where(r.random(n) < hot, 1, -1) + r.normal(size=n))
    post = np.stack([raw / (1 + raw), 1 / (1 + raw)], axis=1)
    share = float(r.choice([0.001, 0.02, 0.1, 0.3, 0.5, 0.85, 0.98, 0.999]))
    return post, r.integers(1, 500, n), [share, 1 - share]


@pytest.mark.parametrize("seed", range(5))
def test_two_soft_domains_reach_the_best_objective(spark, seed):
    post, tokens, share = simulated(seed)
    table = spark.createDataFrame([(int(n), p.tolist()) for n, p in zip(tokens, post, strict=True)], "_tokens long, _post array<double>").coalesce(1).cache()
    targets = np.array(share) * tokens.sum()
    for least in (0.0, 1.0):
        steps = mix.fit_rates(table, targets.tolist(), least=least)
        rate = np.maximum(least, 1 + post @ np.array(steps[0]))
        want = brute(post, tokens.astype(float), targets, least=least, rounds=5_000)
        inverse = np.linalg.pinv((post * tokens[:, None]).T @ post)
        size = [(left := targets - (post * (x * tokens)[:, None]).sum(axis=0)) @ inverse @ left for x in (rate, want)]
        assert size[0] <= size[1] * (1 + 1e-3) + 1e-6 * tokens.sum()


def test_many_domains(spark, monkeypatch):
    r = np.random.default_rng(8)
    post = r.dirichlet(np.full(6, 0.3), 300)
    tokens = r.integers(5, 90, 300)
    table = spark.createDataFrame([(int(n), p.tolist()) for n, p in zip(tokens, post, strict=True)], "_tokens long, _post array<double>").coalesce(1).cache()
    targets = (r.dirichlet(np.full(6, 3.0)) * tokens.sum()).tolist()
    direct = mix.fit_rates(table, targets)
    monkeypatch.setattr(mix, "MOST_SUMS", 5)
    assert np.allclose(mix.fit_rates(table, targets), direct, rtol=1e-6, atol=1e-9)


def test_sample_does_not_depend_on_order_or_repeats(spark):
    docs, _ = frames(spark)
    ids = [(i,) for i in range(60)]
    one = spark.createDataFrame(ids, "doc_id long")
    hot = spark.createDataFrame([(7,)] * 500 + ids[::-1] + [(None,)], "doc_id long").repartition(5)
    pick = lambda labels: sorted((r.text, r.domain) for r in mix.label_sample(labels, docs, "lang", rows=20).collect())
    assert pick(one) == pick(hot) and len(pick(one)) == 20


def test_mixed_edge_cases(spark, monkeypatch):
    docs, labelled = frames(spark, [(None, "the house", "en"), (70, None, "en"), (71, "", None), (72, "la maison " * 20_000, "fr"), (3, rows()[3][1], "fr")])
    clashing = docs.withColumnsRenamed({"rate": "_tokens", "lang": "c0"})
    out = mix.mixed(clashing, labelled, {"en": 0.3, "fr": 0.4, "de": 0.3})
    assert out.columns == clashing.columns
    assert set(map(repr, out.select("doc_id", "text").collect())) == set(map(repr, clashing.select("doc_id", "text").collect()))
    assert mix.mixed(clashing.limit(0), labelled, {"en": 0.5, "fr": 0.5}).collect() == []
    monkeypatch.setattr(mix, "COPIES", 3)
    rare = {"en": 0.05, "fr": 0.9, "de": 0.05}
    few = mix.mixed(docs, labelled, rare).groupBy("doc_id").count()
    monkeypatch.setattr(mix, "COPIES", 1_024)
    assert sorted(map(tuple, few.na.fill(-1).collect())) == sorted(map(tuple, mix.mixed(docs, labelled, rare).groupBy("doc_id").count().na.fill(-1).collect()))
    assert max(r["count"] for r in few.collect()) > 3
