import random

import numpy as np
import pytest

lang = pytest.importorskip("sparrowdex.llm.language_id")
from pyspark.sql import functions as F  # noqa: E402

SYLLABLES = {"en": "the and ing ion ent her for tha nth was".split(), "de": "der die und ein sch ich ung gen ßen über".split(), "fr": "les que ent ion eau oux éra ais ès ment".split()}


def corpus(n=300, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        k = r.choice(["en", "en", "en", "de", "fr"])
        rows.append((i, " ".join("".join(r.choice(SYLLABLES[k]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(3, 80))), k))
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"held_out": lang.held_out(), "score": F.lit("clash")})
    model = lang.train(df, ~F.col("held_out"), **kw)
    return lang.identify(df, model, ["doc_id", "held_out", "lang"]).collect()


def test_held_out_accuracy_and_edges(spark):
    rows = corpus()
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "123 !? ☃", "en"), (1003, "the and " * 30_000, None), (None, rows[0][1], "xx"), (rows[0][0], rows[0][1], rows[0][2])]
    got = run(spark, rows + odd)
    assert len(got) == len(rows) + len(odd)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    assert len(held) > 30 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    by_id = {r.doc_id: r for r in got}
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert by_id[1003].lang_pred == "en" and by_id[None].lang_pred == rows[0][2]
    assert all(0 <= r.score <= 1 for r in got)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)


def test_labels_of_held_out_rows_do_not_teach(spark):
    rows = corpus()
    import zlib

    lied = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else k) for i, t, k in rows]
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in run(spark, x, per_language=50)} for x in (rows, lied))
    assert a == b


def test_nothing_to_learn(spark):
    assert {r.lang_pred for r in run(spark, [(1, "abc", None), (2, "x", None)])} == {"und"}
    assert run(spark, []) == []


def plain_grams(text):
    """The n-grams of a text as (length, bucket), one by one."""
    data = [b if b >= 128 or 97 <= b <= 122 else 32 for b in text.lower().encode()]
    out = set()
    for n, width in lang._WIDTHS.items():
        for k in range(len(data) - n + 1):
            code = 0
            for b in data[k : k + n]:
                code = (code << 8 | b) & 0xFFFFFFFF
            out.add((n, code if n == 1 else ((code * 0x9E3779B1 & 0xFFFFFFFF) >> 8) % width))
    return out


def plain_kernel(a, b):
    return len(a & b) / (len(a) * len(b)) ** 0.5


def test_against_kernel_ridge_regression_by_hand():
    """Scores of the one matrix product are those of the kernel expansion, from sets of n-grams and a solved system."""
    rows = sorted(corpus(90), key=lambda r: (r[2], r[0]))
    taught, asked = [(k, t) for _, t, k in rows], [t for _, t, _ in corpus(30, seed=8)]
    names, n, m = sorted({k for k, _ in taught}), len(taught), 40
    grams = [plain_grams(t) for _, t in taught]
    marks = [grams[i] for i in np.unique(np.linspace(0, n - 1, m).astype(int))]
    values, vectors = np.linalg.eigh(np.array([[plain_kernel(a, b) for b in marks] for a in marks]))
    keep = values > 1e-6 * values[-1]
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    feature = lambda g: np.append(np.array([plain_kernel(g, b) for b in marks]) @ whiten, 1.0)
    phi = np.stack([feature(g) for g in grams])
    weight = np.array([1 / sum(k == x for x, _ in taught) for k, _ in taught])
    weight /= weight.mean()
    model = lang.fit([(k, np.packbits(lang.presence([t])[0]).tobytes()) for k, t in taught], landmarks=m)
    found, scores = lang.predict(model, asked)
    system = (phi * weight[:, None]).T @ phi + lang.RIDGE * n / len(names) * np.eye(phi.shape[1])
    f = np.stack([np.linalg.solve(system, (phi * weight[:, None]).T @ np.array([1.0 if k == c else -1.0 for k, _ in taught])) for c in names], axis=1)
    for text, name, score in zip(asked, found, scores, strict=True):
        want = feature(plain_grams(text)) @ f
        assert name == names[int(want.argmax())] and score == pytest.approx(min(max((want.max() + 1) / 2, 0), 1), abs=2e-3)
    assert found == [lang.predict(model, [t])[0][0] for t in asked]


def test_presence_in_segments(monkeypatch):
    texts = [t for _, t, _ in corpus(20)] + ["", "é", "ab"]
    whole = lang.presence(texts)
    assert [set(np.flatnonzero(r)) for r in whole] == [{sum(w for k, w in lang._WIDTHS.items() if k < n) + b for n, b in plain_grams(t)} for t in texts]
    monkeypatch.setattr(lang, "_SEGMENT", 7)
    assert (lang.presence(texts) == whole).all()


def test_many_languages(spark):
    """Seventy languages, of which each has its own syllables, are all learned."""
    r = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = {f"l{k:02d}": ["".join(r.choice(letters) for _ in range(3)) for _ in range(4)] for k in range(70)}
    rows = [(i, " ".join(r.choice(own[k]) for _ in range(20)), k) for i, k in enumerate(list(own) * 8)]
    got = run(spark, rows)
    assert {x.lang_pred for x in got} == set(own) and sum(x.lang == x.lang_pred for x in got) > 0.9 * len(got)


def test_sample_is_the_same_in_any_order_and_for_any_repeats(spark, monkeypatch):
    rows = corpus(200)
    hot = [next(r for r in rows if r[2] == "fr")] * 3000
    taken = []
    monkeypatch.setattr(lang, "fit", lambda rows: taken.append(rows))
    for table, parts in ((rows, 2), (rows[::-1], 5), (rows + hot, 7)):
        df = spark.createDataFrame(table, "doc_id long, text string, lang string").repartition(parts)
        lang.train(df, F.lit(True), per_language=10)
    assert taken[0] == taken[1] == taken[2] and len(taken[0]) == 30
