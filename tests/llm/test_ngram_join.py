import random
import re

import pytest

ngram = pytest.importorskip("sparrowdex.llm.ngram_join")
from pyspark.sql import functions as F  # noqa: E402

from sparrowdex.llm.components import components  # noqa: E402
from sparrowdex.llm.signature_tree import SignatureTree  # noqa: E402


def brute_rows(rows):
    return brute(rows, by_row=True)


def brute(rows, num=80, den=100, by_row=False):
    """doc_id -> (set size, component) by comparing all pairs."""

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return set(zip(*(w[i:] for i in range(5)), strict=False)) if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (a, x) in enumerate(sets):
        for j in range(i):
            b, y = sets[j]
            if a is not None and b is not None and x and y and den * len(x & y) >= num * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for i, (a, _) in enumerate(sets):
        if a is not None:
            least[find(i)] = min(least.get(find(i), a), a)
    if by_row:
        return [(a, len(x), find(i)) for i, (a, x) in enumerate(sets)]
    return sorted((a, len(x), least.get(find(i))) if a is not None else (-1, len(x), None) for i, (a, x) in enumerate(sets))


def corpus(seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [r.choice(words) for _ in range(40)]
    rows = []
    for k in range(25):
        base = [r.choice(words) for _ in range(r.randint(30, 200))]
        for c in range(r.choice([1, 1, 2, 8])):
            text = list(base)
            for _ in range(r.randint(0, 3)):
                text[r.randrange(len(text))] = r.choice(words)
            if r.random() < 0.3:
                text += passage
            rows.append((1000 * k + c, r.choice([" ", "\n", " \t "]).join(text).upper() if r.random() < 0.2 else " ".join(text)))
    many = [r.choice(words) for _ in range(120)]
    for c in range(60):  # a chain: near copies of near copies
        many[r.randrange(len(many))] = r.choice(words)
        rows.append((50_000 + c, " ".join(many)))
    rows += [(7, None), (8, ""), (9, " \n "), (10, "one two"), (11, "ONE two"), (12, "one two three"), (13, "café É x y z q"), (14, "café é x y z q")]
    rows += [(None, "one two"), (20, "a b c d e f"), (20, "a b c d e f"), (20, "other text here with words"), (21, "a b c d e f"), (22, "x" * 300 + " y"), (23, "x" * 300 + " y")]
    return rows


def got(df):
    return sorted((-1 if r[0] is None else r[0], r[1], r[2]) for r in df.select("doc_id", "n_shingles", "component_id").collect())


#: Small bounds, so that what is for large tables is met on a small one.
BLOCKS = {"FAMILY_SETS": 8, "BUCKET_SETS": 6, "GROUP_SHINGLES": 500, "FLUSH_SHINGLES": 2_000}
FREQUENT = {"FEW": 2, "FREQUENT": 4, "WINDOW_SHINGLES": 5_000}
TWO_STEPS = {"GROUP_SHINGLES": 500, "FLUSH_SHINGLES": 300, "PARTS_AT_ONCE": 3}


@pytest.mark.parametrize("bounds", [{}, BLOCKS, TWO_STEPS, BLOCKS | FREQUENT | TWO_STEPS])
def test_matches_brute_force(spark, bounds, monkeypatch):
    for name, value in bounds.items():
        monkeypatch.setattr(ngram, name, value)
    rows = corpus()
    # rows that share an id count as documents of their own here and there
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, k1 string").repartition(3)
    assert got(ngram.ngram_components(df)) == brute(rows)


@pytest.mark.parametrize("parts", [1, 7, 58, 3000])
def test_labels_lie_in_partitions_of_their_own(spark, parts):
    labels = ngram._even_labels(parts)
    rows = spark.createDataFrame([(int(x), i) for i, x in enumerate(labels)], "label int, part int")
    places = [tuple(r) for r in rows.select("part", F.pmod(F.hash("label"), F.lit(parts))).collect()]
    assert len(set(labels.tolist())) == parts and all(a == b for a, b in places)


def test_frequent_shingles_go_by_node(spark, monkeypatch):
    """A passage in every document: its shingles are in no group of shingles, and links that hang on it are found."""
    for name, value in {"FEW": 2, "FREQUENT": 50, "WINDOW_SHINGLES": 3_000, "FAMILY_SETS": 16, "BUCKET_SETS": 20}.items():
        monkeypatch.setattr(ngram, name, value)
    r = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    passage = [r.choice(words) for _ in range(30)]
    rows = [(i, " ".join(passage + [r.choice(words) for _ in range(r.choice((3, 4, 5, 40)))])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    keyed = ngram.shingle_keys(df.selectExpr("doc_id", "text", "xxhash64(text) text_key")).cache()
    found, times = ngram.frequent_shingles(keyed, 1)
    assert len(found) >= 26 and (times >= 50).all() and keyed.filter("n_shingles >= 0").count() == 400
    assert got(ngram.ngram_components(df)) == brute(rows)


def test_one_row_very_often(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near = text + " end"
    often = spark.range(100_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    few = spark.createDataFrame([(4, near), (6, "other words in a text of their own"), (5, "the same id with another text")], "doc_id long, text string")
    out = ngram.ngram_components(often.union(few))
    counts = {tuple(r)[:3]: r["n"] for r in out.groupBy("doc_id", "n_shingles", "component_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {(5, 56, 4): 100_000, (4, 57, 4): 1, (6, 4, 6): 1, (5, 2, 5): 1}


def test_drop_linked_keeps_one_of_each_component(spark):
    rows = [*corpus(), (1, "first text of a shared id here"), (1, "second text, not like it at all"), (1, "second text, not like it at all"), (9, " \n "), (9, None)]
    df = spark.createDataFrame([(i, t, k % 3) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _first int").repartition(3)
    kept = ngram.drop_linked(df)
    assert kept.columns == df.columns
    out = [(r.doc_id, r.text) for r in kept.collect()]
    distinct = sorted({(i, t) for i, t in rows if i is not None}, key=repr)
    # all rows as documents of their own: a component keeps one of those with its smallest id
    whole = {k: c for k, (_, _, c) in zip(range(len(distinct)), brute_rows(distinct), strict=True)}
    heads = {}
    for k, c in whole.items():
        heads.setdefault(c, []).append(distinct[k])
    assert len([x for x in out if x[0] is not None]) == len(heads) and out.count((None, "one two")) == 1
    for group in heads.values():
        least = min(i for i, _ in group)
        assert len([x for x in out if x in group and x[0] == least]) == 1
    assert ngram.drop_linked(df.limit(0)).collect() == []


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert got(ngram.ngram_components(df)) == []


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (4, 4), (9, 8), (8, 7), (7, 6), (6, 3), (11, 10), (11, 10), (12, None)]
    found = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert found == {**dict.fromkeys([1, 2, 3, 6, 7, 8, 9], 1), 4: 4, 5: 4, 10: 10, 11: 10}


def test_tree_prunes(spark):
    import numpy as np

    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 2**63, 300, dtype=np.uint64)) for _ in range(200)]
    tree = SignatureTree(sets + [np.unique(np.append(sets[5][4:], np.uint64(9)))], 80, 100)
    roots = tree.roots()
    assert roots[5] == roots[200] and len(set(roots)) == 200
    assert tree.compared < 50
