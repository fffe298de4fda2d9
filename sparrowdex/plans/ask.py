"""Answering batches of questions over an index: ranked rows, prompts, evaluation."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import MetadataFilters
from ..functions.text import TokenCount, token_counter
from ..operators import evaluation
from ..operators.hybrid import retrieve
from ..operators.models import Embedder, Reranker, build_embedder, build_reranker
from ..operators.prompt import prompts
from ..settings import Settings
from ..sources.golden import GoldenSet
from ..sources.repository import index_name
from .index import index_repository, open_index


def query(
    spark: SparkSession,
    questions: DataFrame | str,
    name: str,
    store: str = "cosine",
    settings: Settings | None = None,
    k: int = 5,
    filters: MetadataFilters | None = None,
    embedder: Embedder | None = None,
    reranker: Reranker | None = None,
    rerank: bool = True,
) -> DataFrame:
    """Ranked chunks for questions(qid, question), or for one question."""
    s = settings or Settings()
    if isinstance(questions, str):
        questions = spark.createDataFrame([(0, questions)], "qid int, question string")
    embedder = embedder or build_embedder(s)
    asked = questions.withColumn("qvec", embedder.column(F.col("question")))
    ix = open_index(spark, s, store, name)
    model = (reranker or build_reranker(s)) if rerank else None
    return retrieve(ix.chunks.table.read(), ix.vectors.table.read(), asked, k, filters, s, model, ix.vectors.metric)


def ask(spark: SparkSession, repo: str, question: str, store: str = "cosine", settings: Settings | None = None, name: str | None = None, count: TokenCount | None = None, **options) -> str:
    """A prompt for a question; the repository is indexed first if it has no index."""
    s = settings or Settings()
    name = name or index_name(repo)
    ix = open_index(spark, s, store, name)
    if not (ix.chunks.has_data() and ix.vectors.has_data()):
        index_repository(spark, repo, store, s, name, options.get("embedder"), count)
    asked = spark.createDataFrame([(0, question)], "qid int, question string")
    return prompts(asked, query(spark, asked, name, store, s, **options), s.max_prompt_context_tokens, count or token_counter(s.token_counter)).first()["prompt"]


def run_eval(spark: SparkSession, golden: GoldenSet, settings: Settings | None = None, store: str | None = None, ks: tuple[int, ...] | None = None, count: TokenCount | None = None, **options) -> dict:
    """Evaluate all questions of a golden set in one plan; a report that can be written as JSON."""
    s = settings or Settings()
    store, ks = store or golden.store, tuple(sorted(set(ks or golden.top_k)))
    name = golden.index_name or index_name(golden.repo)
    ix = open_index(spark, s, store, name)
    if not ix.chunks.has_data():
        index_repository(spark, golden.repo, store, s, name, options.get("embedder"), count)
    asked = golden.question_frame(spark)
    relevant = evaluation.resolve_relevant(golden.selector_frame(spark), ix.chunks.table.read()).persist()
    got = query(spark, asked, name, store, s, k=max(ks), **options).select("qid", "id", "rank").persist()
    metrics = evaluation.question_metrics(asked, relevant, got, list(ks)).persist()
    texts = dict(enumerate(q for q, _ in golden.questions))
    rows: dict[int, dict] = {}
    for r in metrics.orderBy("qid", "k").collect():  # questions of a golden set, times cuts
        q = rows.setdefault(r["qid"], {"question": texts[r["qid"]], "n_relevant": r["n_relevant"], "n_retrieved": r["n_retrieved"], "mrr": r["reciprocal_rank"]})
        q |= {f"{m}@{r['k']}": r[m] for m in ("recall", "precision", "ndcg")}
    report = {
        "name": golden.name,
        "repo": golden.repo,
        "store": store,
        "index_name": name,
        "top_k": list(ks),
        "timestamp": datetime.now().strftime("%Y%m%d-%H%M%S"),
        "metrics": evaluation.named_means(metrics, list(ks)),
        "questions": [rows[k] for k in sorted(rows)],
    }
    for df in (relevant, got, metrics):
        df.unpersist()
    return report


def format_report(report: dict) -> str:
    out = [f"{report['name']} ({report['store']}, {len(report['questions'])} questions)"]
    out += [f"  {k}: {v:.4f}" for k, v in report["metrics"].items()]
    for q in report["questions"]:
        out.append(f"- {q['question']}: mrr {q['mrr']:.4f}, {q['n_relevant']} relevant, {q['n_retrieved']} retrieved")
    return "\n".join(out)
