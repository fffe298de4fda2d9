import random
import re

import pytest

rules = pytest.importorskip("sparrowdex.llm.quality_rules")


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    where = {}
    for i in range(len(w) - 2):
        where.setdefault(tuple(w[i : i + 3]), []).append(i)
    cover = {k for v in where.values() if len(v) > 1 for i in v for k in (i, i + 1, i + 2)}
    n = len(w)
    m = {
        "n_words": n, "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(cover), "n_lines": len(lines),
        "n_bullet_lines": sum(bool(re.match(r"[\x20\x09-\x0D]*(?:[-*•]|[0-9]+[.)])[\x20\x09]", x)) for x in lines), "n_ellipsis_lines": sum(bool(re.search(r"(?:\.\.\.|…)[\x20\x09-\x0D]*\Z", x)) for x in lines),
        "n_stop_words": sum(x.lower() in set(rules.STOP_WORDS) for x in w),
    }
    m["base_failed"] = n < 50 or 100 * m["n_repeat_words"] > 50 * n
    bad = []
    for name, left, rel, bound, right in rules.THRESHOLDS:
        a, b = eval(left, {}, m), bound * eval(right, {}, m)
        if a < b if rel == "<" else a > b:
            bad.append(name)
    return m | {"broken_rules": bad, "kept": not m["base_failed"] and not bad}


def test_matches_brute_force(spark):
    r = random.Random(4)
    words = "the and of house der die la que x** 12 a|b # é日本 - • 1. ... … long-word-here".split(" ") + ["w%d" % i for i in range(30)]
    texts = [None, "", " \n\t\r", "one", "a b", "a b c", "a a a a", "x y z x y z x y z", "\n\nline\nline\n \nline", "word " * 30_000, "y" * 100_000, "\x0bq\x0c", "the\xa0and"]
    texts += ["".join(r.choice(words) + r.choice([" ", " ", " ", "\n", "  ", "\t"]) for _ in range(r.randint(1, 150))) for _ in range(150)]
    rows = [(i % 160, t, 7) for i, t in enumerate(texts)] + [(None, texts[-1], 7)]
    got = rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, n_words int"))
    assert got.count() == len(rows)
    found = sorted((repr((x.doc_id, {k: x[k] for k in brute("")})) for x in got.collect()))
    assert found == sorted(repr((i, brute(t))) for i, t, _ in rows)
    assert any(brute(t)["kept"] for t in texts) and rules.quality_rules(got.limit(0).selectExpr("doc_id", "'' text")).collect() == []


def test_plan_has_no_exchange_and_no_python(spark):
    plan = rules.quality_rules(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_each_rule_is_broken_alone(spark):
    words = lambda n, size=5, tag="": " ".join(f"{tag}{i:0{size - len(tag)}d}" for i in range(n))
    lines = lambda n, end="", start="": "\n".join(f"{start}the and {words(5, tag=chr(97 + i))}{end}" for i in range(n))
    texts = {
        None: lines(12),
        "mean_word_short": "the and of to in " + words(75, 2),
        "mean_word_long": "the and of in " + words(60, 14),
        "symbol_ratio": "the and of in is " + words(60) + " |" * 9,
        "dup_line_ratio": lines(12) + "\nx" * 11,
        "bullet_line_ratio": lines(12, start="- "),
        "ellipsis_line_ratio": lines(8) + "\n" + "\n".join(f"{words(3, tag='z' + chr(97 + i))} ..." for i in range(5)),
        "stop_word_ratio": "the of " + words(60),
    }
    assert set(texts) - {None} == {r[0] for r in rules.THRESHOLDS}
    rows = [(i, t) for i, t in enumerate(texts.values())]
    got = rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.broken_rules, r.base_failed) for r in got] == [([] if k is None else [k], False) for k in texts]
