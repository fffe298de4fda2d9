from sparrowdex.operators.models import KeywordEmbedder
from sparrowdex.plans.index import open_index
from sparrowdex.settings import Settings
from sparrowdex.streaming.files import stream_files


def test_stream_merges_files(spark, tmp_path):
    s = Settings(indexes_dir=str(tmp_path / "ix"), embedding_dimensions=2)
    drop = lambda rows: spark.createDataFrame([(p, t.encode()) for p, t in rows], "file_path string, content binary").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go = lambda: stream_files(spark, str(tmp_path / "in"), str(tmp_path / "cp"), "x", settings=s, embedder=KeywordEmbedder("login")).awaitTermination()
    drop([("a.py", "def f():\n    return 1\n"), ("b.md", "# One\ntext\n")])
    go()
    ix = open_index(spark, s, "cosine", "x")
    assert sorted(r.symbol for r in ix.chunks.all_chunks().collect()) == ["One", "a.py", "f"]
    drop([("a.py", "def g():\n    return 1\n\ndef h():\n    pass\n")])
    go()
    assert sorted(r.symbol for r in ix.chunks.all_chunks().collect()) == ["One", "a.py", "g", "h"]
    assert sorted(r.symbol for r in ix.vectors.all_vectors().collect()) == ["One", "g", "h"]
    assert ix.manifest.files().count() == 2
