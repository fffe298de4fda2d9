import json
import logging
import os
import random

import pytest
from pyspark.sql import functions as F

from sparrowdex import http, logs
from sparrowdex.functions import text as tx
from sparrowdex.functions.predicates import MetadataFilters, path_prefix, searchable
from sparrowdex.operators import evaluation, hybrid, keyword, vector
from sparrowdex.operators.models import ColumnReranker, FunctionReranker, HashedWords, KeywordEmbedder, build_embedder, build_reranker, in_batches
from sparrowdex.operators.prompt import format_matches, matches_json, preview, prompts
from sparrowdex.plans import ask as asking
from sparrowdex.plans import index as indexing
from sparrowdex.schema import MANIFEST
from sparrowdex.settings import Settings, load_settings
from sparrowdex.sources.files import discover, in_path_order
from sparrowdex.sources.golden import cuts, golden_set, load_report, write_report
from sparrowdex.sources.repository import index_name
from sparrowdex.sources.stores import VersionedTable

CHUNK_SCHEMA = "id string, content string, file_path string, symbol string, qualified_symbol string, chunk_type string, language string, start_line int, end_line int, is_chunk_part boolean, part_index int, part_count int, parent_chunk_id string, ord long"


def chunk(i, content, path="a.py", symbol="s", kind="function", part=None, ord=0):
    at, n, parent = part or (None, None, None)
    return (i, content, path, symbol, None, kind, "python", 1, 9, bool(part), at, n, parent, ord)


def harbour(spark):
    """Two chunks whose vectors point apart, and a question that is near the first."""
    rows = [chunk("c-crane", "def lift(load): hook and winch", "dock/crane.py", "lift", ord=0), chunk("c-toll", "def levy(ship): fee by tonnage", "dock/toll.py", "levy", ord=1)]
    chunks = spark.createDataFrame(rows, CHUNK_SCHEMA)
    vectors = spark.createDataFrame([("c-crane", [1.0, 0.0], "dock/crane.py", 0), ("c-toll", [0.0, 1.0], "dock/toll.py", 1)], "id string, embedding array<float>, file_path string, ord long")
    asked = spark.createDataFrame([(0, "which winch can lift it")], "qid int, question string").withColumn("qvec", KeywordEmbedder("winch").column(F.col("question")))
    return chunks, vectors, asked


def test_hybrid_and_reranker(spark):
    chunks, vectors, asked = harbour(spark)
    s = Settings()
    found = hybrid.retrieve(chunks, vectors, asked, 1, settings=s).collect()
    assert [(r.id, r.score, r.debug_vector_score) for r in found] == [("c-crane", pytest.approx(1.0), 1.0)]
    other = ColumnReranker(lambda c: F.length(c["symbol"]) + F.when(c["id"] == "c-toll", 3.5).otherwise(0.0))
    found = hybrid.retrieve(chunks, vectors, asked, 1, settings=s, reranker=other).collect()
    assert [(r.id, r.score, r.debug_reranker_score) for r in found] == [("c-toll", 7.5, 7.5)]
    model = FunctionReranker(lambda: lambda pairs: [float(t.count("fee")) - q.count("?") for q, t in pairs])
    assert hybrid.retrieve(chunks, vectors, asked, 2, settings=s, reranker=model).orderBy("rank").first().id == "c-toll"
    gone = hybrid.retrieve(chunks.filter("id = 'c-toll'"), vectors, asked, 2, settings=s).filter("id = 'c-crane'").first()
    assert gone.content == "" and gone.file_path == "dock/crane.py"


def test_neighbours(spark):
    ids = [f"log:part:{i}" for i in range(1, 6)]
    rows = [chunk(i, "winch oil" if k == 3 else "calm", part=(k, 5, "log"), ord=k) for k, i in enumerate(ids, 1)]
    chunks = spark.createDataFrame(rows, CHUNK_SCHEMA)
    vectors = spark.createDataFrame([(i, [1.0, 0.0] if k == 3 else [0.0, 1.0], k) for k, i in enumerate(ids, 1)], "id string, embedding array<float>, ord long")
    asked = spark.createDataFrame([(0, "winch")], "qid int, question string").withColumn("qvec", KeywordEmbedder("winch").column(F.col("question")))
    got = hybrid.retrieve(chunks, vectors, asked, 1, settings=Settings(context_window_parts=2)).orderBy("rank").collect()
    assert [(r.id, r.is_context_expansion, r.context_source_chunk_id) for r in got] == [(i, i != ids[2], None if i == ids[2] else ids[2]) for i in ids]
    assert len({r.score for r in got}) == 1
    assert [hybrid.retrieve(chunks, vectors, asked, 1, settings=Settings(context_window_parts=w)).count() for w in (0, 1)] == [1, 3]


def test_blocks_of_questions(spark, monkeypatch):
    r = random.Random(3)
    vec = lambda: [r.uniform(-1, 1) for _ in range(4)]
    vectors = spark.createDataFrame([(f"v{i}", vec()) for i in range(40)], "id string, embedding array<float>")
    asked = spark.createDataFrame([(i, vec()) for i in range(25)], "qid int, qvec array<float>")
    shape = lambda: sorted(map(tuple, vector.vector_search(vectors, asked, 3).select("qid", "id", "rank").collect()))
    one = shape()
    monkeypatch.setattr(vector, "QUESTION_BLOCK", 4)
    assert shape() == one and len(one) == 75
    assert vector.vector_scores(vectors, asked.limit(0)).collect() == []


def test_filters(spark):
    paths = spark.createDataFrame([("quay/east/rail.py",)], "p string")
    for prefix, want in (("quay", True), ("quay/east/rail.py", True), ("/quay/east/", True), ("qua", False), ("quay/east/rail", False), ("/", True)):
        assert paths.select(path_prefix(F.col("p"), prefix)).first()[0] is want
    rows = spark.createDataFrame([chunk("a", "x", kind="method"), chunk("b", "x", kind="file_metadata")], CHUNK_SCHEMA)
    assert [r.id for r in searchable(rows).collect()] == ["a"]
    assert [r.id for r in searchable(rows, MetadataFilters(chunk_type="file_metadata")).collect()] == ["b"]


def test_normalise_and_keyword_edge_cases(spark):
    s = spark.createDataFrame([(0, "a", -2.0), (0, "b", -1.0), (1, "a", 4.0), (1, "b", -2.0)], "qid int, id string, score double")
    for normalize in (hybrid.max_normalize, hybrid.max_normalize_all):
        assert {(r.qid, r.id): r.score for r in normalize(s).collect()} == {(0, "a"): 0.0, (0, "b"): 0.0, (1, "a"): 1.0, (1, "b"): -0.5}
    chunks, _, _ = harbour(spark)
    none = spark.createDataFrame([(0, "?!")], "qid int, question string")
    assert keyword.keyword_scores(chunks, none).count() == 0
    assert keyword.keyword_scores(chunks.limit(0), none.withColumn("question", F.lit("winch"))).count() == 0
    # a term of the path alone finds the chunk
    asked = none.withColumn("question", F.lit("toll"))
    assert [r.id for r in keyword.keyword_scores(chunks, asked).collect()] == ["c-toll"]


def test_text_functions(spark):
    samples = ["", "a", "a\n", "a\n\n", "\n", "a\r\nb", "a\x0bb\x1cc\u2028d\x85", "x\ny\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(samples)], "i int, t string")
    got = {r.i: r.l for r in df.select("i", tx.split_lines(F.col("t")).alias("l")).collect()}
    assert [got[i] for i in range(len(samples))] == [t.splitlines() for t in samples]
    one = spark.createDataFrame([("café 2FA_x İK", " \t x \n")], "a string, b string").select(tx.terms(F.col("a")).alias("t"), tx.strip(F.col("b")).alias("s")).first()
    import re

    assert one.t == re.findall(tx.TERM, "café 2FA_x İK".lower()) and one.s == "x"
    assert index_name("https://github.com/Owner/My.Repo.git") == "my-repo" and index_name("///") == "repository"


def test_prompt(spark):
    asked = spark.createDataFrame([(0, "q?"), (1, "none?")], "qid int, question string")
    rows = [(0, 1, 0.99, True, "long " * 40, "f.py", 1, 2, "function", "n"), (0, 2, 0.5, False, "short", "f.py", 3, 4, "function", "m"), (0, 3, 0.4, False, "tiny", "g.py", 1, 1, "text_file", None)]
    matches = spark.createDataFrame(rows, "qid int, rank int, score double, is_context_expansion boolean, content string, file_path string, start_line int, end_line int, chunk_type string, symbol string")
    got = {r.qid: r for r in prompts(asked, matches, 45, tx.word_tokens).collect()}
    assert (got[0].n_blocks, got[0].n_omitted) == (2, 1) and (got[1].n_blocks, got[1].n_omitted) == (0, 0)
    p = got[0].prompt
    assert "[Chunk 1] score=0.5000\nRole: retrieved match\nLocation: f.py:3-4\nSymbol: m\nType: function\nContent:\nshort" in p
    assert "\n\n---\n\n[Chunk 2] score=0.4000" in p and "Symbol: None" not in p and "Note: 1 retrieved" in p
    assert "Note" not in got[1].prompt and prompts(asked, matches, 0).filter("qid = 0").first().n_blocks == 3
    assert preview("  ab \n c  ", 3) == "   | ab..." and preview("x", 0) == "" and preview("", 5) == "   |"


def test_listings():
    row = {"id": "i", "score": 0.25, "content": "one\ntwo", "file_path": "p/q.md", "start_line": 4, "end_line": 7, "chunk_type": "markdown_section", "symbol": "Tides", "debug_vector_score": -0.125, "debug_keyword_score": None, "debug_combined_score": 0.5, "rank": 1, "language": None}
    assert format_matches([row, row]).splitlines() == ["1. score=0.2500 p/q.md:4-7", "   markdown_section Tides", "2. score=0.2500 p/q.md:4-7", "   markdown_section Tides"]
    assert format_matches([row], True, debug_scores=True).splitlines()[2:] == ["   debug: vector=-0.1250 keyword=0.0000 combined=0.5000", "   | one", "   | two"]
    assert format_matches([row | {"debug_reranker_score": 2.0}], debug_scores=True).endswith(" combined=0.5000 reranker=2.0000")
    (got,) = json.loads(matches_json([row]))
    assert got["metadata"] == {k: v for k, v in row.items() if k not in ("id", "score", "content", "rank", "language", "debug_keyword_score")}


def test_metrics(spark):
    q = spark.createDataFrame([(0,), (1,)], "qid int")
    rel = spark.createDataFrame([(0, "a"), (0, "b")], "qid int, id string")
    got = spark.createDataFrame([(0, "a", 1), (0, "x", 2), (0, "b", 3), (1, "a", 1)], "qid int, id string, rank int")
    m = {(r.qid, r.k): r for r in evaluation.question_metrics(q, rel, got, [5, 1, 2, 0]).collect()}
    assert [m[0, k].recall for k in (1, 2, 5)] == [0.5, 0.5, 1.0] and [m[0, k].precision for k in (1, 2, 5)] == [1.0, 0.5, 0.4]
    assert m[0, 5].ndcg == pytest.approx((1 + 0.5) / (1 + 0.6309297535714575)) and m[0, 1].reciprocal_rank == 1.0
    assert (m[1, 5].recall, m[1, 5].precision, m[1, 5].ndcg, m[1, 5].reciprocal_rank) == (0.0, 0.0, 0.0, 0.0)
    assert evaluation.metric_names([5, 1]) == ["mrr", "recall@1", "precision@1", "ndcg@1", "recall@5", "precision@5", "ndcg@5"]


GOLDEN = {"name": "g", "repo": ".", "questions": [{"question": "q", "relevant": [{"symbol": "s"}]}]}


@pytest.mark.parametrize("change", [{"name": ""}, {"repo": None}, {"questions": []}, {"questions": [{"question": "", "relevant": [{"symbol": "s"}]}]}, {"questions": [{"question": "q", "relevant": []}]}, {"questions": [{"question": "q", "relevant": [{"nope": "s"}]}]}, {"top_k": [0]}, {"top_k": ["3"]}])
def test_golden_validation(change):
    golden_set(GOLDEN)
    with pytest.raises(ValueError):
        golden_set(GOLDEN | change)
    assert cuts([5, 3, 5]) == (3, 5)


def test_settings(tmp_path, monkeypatch):
    env = tmp_path / ".env"
    env.write_text("# c\nexport RAG_MAX_CHUNK_TOKENS='50'\nRAG_RERANKER_ENABLED=off\nRAG_STORE=simple\nRAG_TOKEN_COUNTER=words\nRAG_COLLECTION_NAME=\n")
    monkeypatch.setenv("RAG_MAX_CHUNK_TOKENS", "60")
    s = load_settings(env, embedding_dimensions=8)
    assert (s.max_chunk_tokens, s.reranker_enabled, s.embedding_dimensions, s.token_counter) == (60, False, 8, "words")
    assert (s.store, s.index_name, s.collection_name) == ("simple", None, Settings().collection_name)


def test_logging(capsys, monkeypatch):
    monkeypatch.setenv(logs.LEVEL_VARIABLE, "warning")
    logs.set_up()
    logging.getLogger("coast").info("not this")
    logs.set_up("debug")
    logging.getLogger("coast").debug("but this")
    logging.getLogger("py4j").info("nor this")
    assert [line.split(" | ")[1:] for line in capsys.readouterr().err.splitlines()] == [["DEBUG   ", "coast", "but this"]]
    assert logs.level_of("no level") == logging.INFO and logs.level_of(10) == 10


MODELS = """
import numpy as np

class SentenceTransformer:
    def __init__(self, name):
        self.name = name

    def encode(self, texts, convert_to_numpy, normalize_embeddings, show_progress_bar):
        assert normalize_embeddings and len(texts) <= 64
        return np.array([[len(t), len(self.name)] for t in texts], dtype=np.float32)

class CrossEncoder(SentenceTransformer):
    def predict(self, pairs, show_progress_bar):
        return np.array([len(t) - len(q) for q, t in pairs])
"""


def test_library_models(spark, tmp_path):
    (tmp_path / "sentence_transformers.py").write_text(MODELS)
    spark.sparkContext.addPyFile(str(tmp_path / "sentence_transformers.py"))
    s = Settings(embedding_model="m/x", reranker_model="r/y")
    rows = spark.createDataFrame([(k, "t" * (k % 7)) for k in range(300)], "k int, t string")
    got = rows.select("k", build_embedder(s).column(F.col("t")).alias("v")).collect()
    assert all(r.v == [r.k % 7, 3.0] for r in got)
    chunks, vectors, asked = harbour(spark)
    best = hybrid.retrieve(chunks, vectors, asked, 1, settings=s, reranker=build_reranker(s)).first()
    head = f"file: {best.file_path}\nsymbol: {best.symbol}\ntype: {best.chunk_type}\n\n{best.content}"
    assert best.score == len(head) - len("which winch can lift it")
    assert build_reranker(Settings(reranker_enabled=False)) is None
    assert len(list(in_batches(lambda x: [len(x)], list("abcde"), 2))) == 3 and list(in_batches(lambda x: [len(x)], list("abcde"), 0)) == [5]


def test_hashed_words(spark):
    got = spark.createDataFrame([("fog Fog horn",), ("",), (None,)], "t string").select(HashedWords(16).column(F.col("t")).alias("v")).collect()
    assert sorted(abs(x) for x in got[0].v if x) == [pytest.approx(5**-0.5), pytest.approx(2 * 5**-0.5)] or len([x for x in got[0].v if x]) == 1
    assert got[1].v == got[2].v == [0.0] * 16


def test_discover(spark, tmp_path):
    for p in (".git/c.txt", "pkg/__pycache__/c.py", "pkg/__init__.py", "_x/a.py", "README.MD", "UPPER.TXT", "a/b/deep.py", "skip.css", "Makefile", "a.b/z.py"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x = 1\n")
    got = [r.file_path for r in in_path_order(discover(spark, str(tmp_path))).collect()]
    assert got == ["README.MD", "UPPER.TXT", "_x/a.py", "a/b/deep.py", "a.b/z.py", "pkg/__init__.py"]


def test_index_lifecycle(spark, tmp_path):
    repo = tmp_path / "My Repo"
    repo.mkdir()
    (repo / "crane.py").write_text("def lift():\n    return wind_up(hook)\n")
    (repo / "toll.py").write_text("def levy():\n    return fee(ship)\n")
    s = Settings(indexes_dir=str(tmp_path / "ix"), embedding_dimensions=2, reranker_enabled=False)
    model = KeywordEmbedder("lift", "lower")
    build = lambda: indexing.index_repository(spark, str(repo), "cosine", s, embedder=model)
    assert build() == 4
    name = "my-repo"
    ix = indexing.open_index(spark, s, "cosine", name)
    first = {r.id: r.ord for r in ix.chunks.all_chunks().collect()}
    assert build() == 4 and {r.id: r.ord for r in ix.chunks.all_chunks().collect()} == first
    health = indexing.check_health(spark, s, "cosine", name, str(repo))
    assert health.ok, health
    (repo / "crane.py").write_text("def lift():\n    return 1\n\ndef lower():\n    return 2\n")
    (repo / "toll.py").unlink()
    bad = indexing.check_health(spark, s, "cosine", name, str(repo))
    assert not bad.ok and bad.found["stale_files"][0] == 2 and "stale files: 2" in indexing.format_health(bad)
    assert build() == 3
    assert sorted(r.symbol for r in ix.chunks.all_chunks().collect()) == ["crane.py", "lift", "lower"]
    assert ix.vectors.all_vectors().count() == 2 and indexing.check_health(spark, s, "cosine", name, str(repo)).ok
    found = asking.query(spark, "how to lower it?", name, "cosine", s, 1, embedder=model).collect()
    assert [r.symbol for r in found] == ["lower"]
    assert "def lower" in asking.ask(spark, str(repo), "how to lower it?", "cosine", s, embedder=model)
    info = indexing.index_info(spark, s, "cosine", name)
    assert (info["n_chunks"], info["n_searchable"], info["n_vectors"], info["n_files"]) == (3, 2, 2, 1)
    from dataclasses import replace

    changed = replace(s, max_chunk_tokens=99)
    assert not indexing.check_health(spark, changed, "cosine", name).ok
    golden = golden_set({"name": "g", "repo": str(repo), "top_k": [1, 3], "questions": [{"question": "what can lift?", "relevant": [{"symbol": "lift"}]}, {"question": "lower the hook", "relevant": [{"file_path": "crane.py", "symbol": "lower"}]}]})
    report = asking.run_eval(spark, golden, s, embedder=model)
    assert report["metrics"]["recall@3"] == 1.0 and len(report["questions"]) == 2
    assert load_report(write_report(report, str(tmp_path / "out"))) == json.loads(json.dumps(report))
    status, payload = http.respond(spark, s, "POST", "/query", {"question": "lift", "index_name": name, "top_k": 1})
    assert status == 200 and len(payload["matches"]) == 1
    assert http.respond(spark, s, "POST", "/index", {})[0] == 422 and http.respond(spark, s, "GET", "/health", {})[0] == 200
    with pytest.raises(ValueError):
        indexing.open_index(spark, s, "nope", name)
    # one version before the last stays for its readers
    assert len(ix.chunks.table.versions()) == 2 == len(os.listdir(tmp_path / "ix" / name / "chunks"))


def test_addresses_with_a_scheme(spark, tmp_path):
    for p in ("a/B.PY", "a/skip.css", "dist/x.py", "n.md"):
        (tmp_path / "src" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / p).write_text("x = 1\n")
    assert sorted(r.file_path for r in discover(spark, f"file://{tmp_path}/src/").collect()) == ["a/B.PY", "n.md"]
    t = VersionedTable(spark, f"file://{tmp_path}/t", MANIFEST)
    assert t.version() is None and t.read().count() == 0
    t.replace(spark.createDataFrame([("f", "h", ["i"])], MANIFEST))
    unmarked = tmp_path / "t" / "999999999999-x"
    unmarked.mkdir()
    assert t.read().first().file_path == "f" and t.version().startswith("000000000001-")
