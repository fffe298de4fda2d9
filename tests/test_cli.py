import json

import pytest

from sparrowdex import cli
from sparrowdex.settings import Settings
from sparrowdex.sources.golden import golden_set


def test_commands(spark, tmp_path, monkeypatch):
    repo = tmp_path / "Demo.Repo"
    repo.mkdir()
    (repo / "a.py").write_text("def anchor():\n    return 1\n")
    (repo / "b.md").write_text("# Bills\n\nPay the bill.\n")
    s = Settings(indexes_dir=str(tmp_path / "ix"), eval_results_dir=str(tmp_path / "out"), eval_golden_dir=str(tmp_path), embedding_dimensions=16)
    go = lambda *a: cli.run(cli.parser(s).parse_args(a), spark, s)
    assert go("index", "--repo", str(repo)) == "Indexed 3 chunks in demo-repo"
    name = ("--index-name", "demo-repo")
    assert "a.py:1-2" in go(*name, "query", "--question", "anchor", "--top-k", "1", "--show-content")
    found = json.loads(go(*name, "--no-reranker", "query", "--question", "bill", "--language", "markdown", "--json"))
    assert [m["metadata"]["symbol"] for m in found] == ["Bills"]
    assert "# Bills" in go(*name, "query", "--question", "bill", "--prompt", "--path", "b.md")
    assert "status: ok" in go(*name, "health", "--repo", str(repo))
    assert "n_chunks: 3" in go(*name, "info")
    golden = tmp_path / "sample.json"
    golden.write_text(json.dumps({"name": "g", "repo": str(repo), "questions": [{"question": "anchor", "relevant": [{"symbol": "anchor"}]}]}))
    assert "recall@3: 1.0000" in go(*name, "eval", "--top-k", "3,1")
    assert "def anchor" in go("ask", "--repo", str(repo), "--question", "anchor")


def test_flags(capsys):
    a = cli.parser(Settings()).parse_args(["-v", "--embedding-model", "m", "--reranker-model", "r", "--store", "chroma", "info"])
    s = cli.settings_of(a, Settings())
    assert (a.log_level, s.embedding_model, s.reranker_model, s.reranker_enabled, a.store) == ("DEBUG", "m", "r", True, "chroma")
    with pytest.raises(SystemExit):
        cli.parser(Settings()).parse_args(["--store", "nope", "info"])
    with open(cli.parser(Settings()).parse_args(["eval"]).golden) as f:
        golden_set(json.load(f))
