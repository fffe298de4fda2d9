import hashlib
import os
import random
import re
import subprocess
import sys

import pytest

pipe = pytest.importorskip("corpus_pipeline")
import public_tokenizers  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from sparrowdex.llm.byte_bpe import coder  # noqa: E402

SYLLABLES = {"en": "the and ing ion ent her for tha nth was".split(), "de": "der die und ein sch ich ung gen ber".split(), "fr": "les que ent ion eau oux ais ment".split(), "es": "que los cion ado ente ara las".split()}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(7)
    at = tmp_path_factory.mktemp("tables")
    rows = []
    for i in range(220):
        k = r.choice(["en"] * 6 + ["de", "fr", "es"])
        text = " ".join("".join(r.choice(SYLLABLES[k]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(30, 90)))
        if i % 11 == 0:
            text += f" mail a{i}@host.com now"
        rows.append([i, text, k, f"src{i % 3}", len(text)])
    for i in range(40):  # near and exact copies
        text = rows[i][1].split(" ")
        if i % 2:
            text[len(text) // 2] = "changed"
        rows.append([300 + i, " ".join(text), rows[i][2], "src9", 0])
    rows += [[400, None, "en", "s", 0], [401, "", None, "s", 0], [402, "123 456 !!", "en", "s", 0], [None, rows[3][1], "en", "s", 1], [5, rows[5][1], rows[5][2], "src2", 1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("extra", F.lit("x"))
    docs.repartition(3).write.parquet(f"{at}/documents.parquet")
    docs.filter("doc_id % 2 = 0").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{at}/labels.parquet")
    return str(at), rows


def components(rows):
    def sets(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    kept, root = {i: sets(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in kept.items():
        for j, b in kept.items():
            if j < i and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {find(i) for i in kept}


def test_stages(spark, folder):
    at, rows = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    first = pipe.language(spark, docs, at)
    assert tuple(first.columns) == pipe.COLUMNS
    ids = {r.doc_id for r in first.collect()}
    assert ids == {r[0] for r in rows} - {400, 401, 402}  # what has no letters goes, all else stays
    second = pipe.near_duplicates(spark, first, at).cache()
    stay = components([(i, t) for i, t in {(r[0], r[1]) for r in rows} if i is not None and i not in (400, 401, 402)])
    got = [r.doc_id for r in second.collect()]
    assert sorted(i for i in got if i is not None) == sorted(stay) and got.count(None) == 1
    third = pipe.personal_data(spark, second, at).cache()
    texts = {r.doc_id: r for r in third.collect()}
    assert not any("@" in r.text for r in texts.values()) and all(r.n_chars == len(r.text) for r in texts.values())
    before = {r.doc_id: r.text for r in second.collect()}
    assert all(re.sub(r"\S+@host\.com", "[EMAIL]", before[i]) == r.text for i, r in texts.items())
    fourth = pipe.mixing(spark, third, at).cache()
    assert {r.doc_id for r in fourth.collect()} == set(texts) and tuple(fourth.columns) == pipe.COLUMNS
    n = {r.lang: r.n for r in fourth.withColumn("n", F.size(F.split("text", " "))).groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    assert abs(n["en"] / sum(n.values()) - pipe.WEIGHTS["en"]) < 0.08
    c = coder(pipe.RANKS, public_tokenizers.PATTERN)
    for r in pipe.encoding(spark, fourth, at).limit(40).collect():
        assert "".join(c.decode_stream(r.ids)) == texts[r.doc_id].text and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].text.encode()).hexdigest()


def test_run_takes_all_stages(spark, folder):
    at, _ = folder
    assert [f for _, f in pipe.STAGES] == [pipe.language, pipe.near_duplicates, pipe.personal_data, pipe.mixing, pipe.encoding]
    out = pipe.run(spark, at)
    assert out.columns == ["doc_id", "ids", "n_tokens", "decoded_sha256"] and out.count() > 150
    assert os.path.isdir(at)


FOREIGN = [
    "Быстрая коричневая лиса прыгает через ленивую собаку и бежит дальше в лес",
    "敏捷的棕色狐狸跳过懒狗然后跑进森林",
    "いろはにほへとちりぬるを わかよたれそつねならむ",
    "Η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί",
    "الثعلب البني السريع يقفز فوق الكلب الكسول",
    "zzzz qqqq xxxx vvvv kkkk",
    "0f3a9c 7b 1ff ac09 12c",
]


def test_foreign_scripts_and_gibberish_go(spark, folder):
    at, rows = folder
    docs = spark.read.parquet(f"{at}/documents.parquet").drop("extra")
    planted = spark.createDataFrame([(1000 + i, t, None, "s", len(t)) for i, t in enumerate(FOREIGN)], docs.schema)
    got = {r.doc_id for r in pipe.language(spark, docs.union(planted), at).collect()}
    assert got == {r[0] for r in rows} - {400, 401, 402}


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.selectExpr("doc_id", "1 quality", "0 toxic").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipe.run(spark, str(tmp_path)).collect() == []


def test_unrelated_texts_under_one_id_and_a_long_text(spark, folder):
    at, rows = folder
    docs = spark.read.parquet(f"{at}/documents.parquet").drop("extra")
    texts = [" ".join(reversed(rows[2][1].split())), " ".join(rows[4][1].split()[::2]), (rows[6][1] + " ") * 2_000]
    planted = spark.createDataFrame([(2, texts[0], "en", "s", 1), (2, texts[1], "en", "s", 1), (2, texts[1], "en", "s", 1), (900, texts[2], "en", "s", 1)], docs.schema)
    kept = pipe.near_duplicates(spark, docs.union(planted).filter("doc_id is not null and text <> ''"), at)
    assert sorted(r.text for r in kept.filter("doc_id = 2").collect()) == sorted([rows[2][1], *texts[:2]])
    out = pipe.encoding(spark, pipe.personal_data(spark, planted.filter("doc_id = 900"), at), at).first()
    assert out.n_tokens > 100_000


def test_freed_memory_goes_back_after_masking_and_encoding(spark, folder, monkeypatch):
    docs, given = spark.read.parquet(f"{folder[0]}/documents.parquet").limit(1), []
    for stage, module in ((pipe.personal_data, "pii_crf"), (pipe.encoding, "byte_bpe")):
        monkeypatch.setattr(f"sparrowdex.llm.{module}.give_back", lambda m=module: given.append(m))
        runs = []
        with monkeypatch.context() as m:
            m.setattr(type(docs), "mapInArrow", lambda self, run, schema: runs.append(run) or self)
            stage(spark, docs, folder[0])
        assert list(runs[0](iter([]))) == [] and given[-1:] == [module]


def test_freed_memory_is_given_back():
    code = """
import re
from sparrowdex.llm.shared import give_back
def held():
    return int(re.search(r"Anonymous:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) // 1024
many = [b"x" * 2_000 + bytes([i % 256]) for i in range(50_000)]
full, last = held(), many[-1]
del many
give_back()
print(full - held())
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env=os.environ)
    assert int(out.stdout) > 60
