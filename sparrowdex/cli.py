"""Command line: index, query, ask, eval, health, info."""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import replace

from pyspark.sql import SparkSession

from .functions.predicates import MetadataFilters
from .functions.text import token_counter
from .logs import LEVEL_VARIABLE, set_up
from .operators.models import HASHED_WORDS, TERM_OVERLAP
from .operators.prompt import format_matches, matches_json, prompts
from .plans import ask as asking
from .plans import index as indexing
from .settings import Settings, load_settings
from .sources.golden import cuts, load_golden_set, write_report
from .sources.repository import index_name
from .sources.stores import STORES


def parser(defaults: Settings | None = None) -> argparse.ArgumentParser:
    """Flags come before settings, which come from the environment, a .env file and built-in values, in this order."""
    d = defaults or load_settings()
    p = argparse.ArgumentParser(prog="sparrowdex", description=__doc__, epilog=parser.__doc__)
    p.add_argument("--store", choices=sorted(STORES), default=d.store)
    p.add_argument("--index-name", default=d.index_name, help="the repository's name by default, that of the collection without one")
    p.add_argument("--embedding-model", default=d.embedding_model, help=f"{HASHED_WORDS}, or a sentence-transformers model")
    p.add_argument("--reranker-model", default=d.reranker_model, help=f"{TERM_OVERLAP}, or a cross-encoder")
    p.add_argument("--no-reranker", action="store_true", default=not d.reranker_enabled)
    p.add_argument("--log-level", help=f"by default that of {LEVEL_VARIABLE}, else INFO")
    p.add_argument("-v", "--verbose", action="store_const", const="DEBUG", dest="log_level")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("index").add_argument("--repo", required=True)
    for name in ("query", "ask"):
        q = sub.add_parser(name)
        q.add_argument("--repo", required=name == "ask")
        q.add_argument("--question", required=True)
        q.add_argument("--top-k", type=int, default=5)
        for f in ("--language", "--chunk-type", "--path"):
            q.add_argument(f)
        if name == "query":
            for f in ("--show-content", "--json", "--debug-scores", "--prompt"):
                q.add_argument(f, action="store_true")
            q.add_argument("--content-chars", type=int, default=700)
    e = sub.add_parser("eval")
    e.add_argument("--golden", default=os.path.join(d.eval_golden_dir, "sample.json"))
    e.add_argument("--top-k", help="numbers with commas between, instead of the golden set's")
    sub.add_parser("health").add_argument("--repo")
    sub.add_parser("info")
    return p


def settings_of(a: argparse.Namespace, settings: Settings) -> Settings:
    return replace(settings, embedding_model=a.embedding_model, reranker_model=a.reranker_model, reranker_enabled=not a.no_reranker)


def filters_of(a: argparse.Namespace) -> MetadataFilters | None:
    f = MetadataFilters(a.language, a.chunk_type, a.path)
    return f if f.active else None


def run(a: argparse.Namespace, spark: SparkSession, settings: Settings) -> str:
    s = settings_of(a, settings)
    name = a.index_name or (index_name(a.repo) if getattr(a, "repo", None) else s.collection_name)
    if a.command == "index":
        return f"Indexed {indexing.index_repository(spark, a.repo, a.store, s, name)} chunks in {name}"
    if a.command == "ask":
        return asking.ask(spark, a.repo, a.question, a.store, s, name, k=a.top_k, filters=filters_of(a))
    if a.command == "query":
        asked = spark.createDataFrame([(0, a.question)], "qid int, question string")
        found = asking.query(spark, asked, name, a.store, s, a.top_k, filters_of(a))
        if a.prompt:
            return prompts(asked, found, s.max_prompt_context_tokens, token_counter(s.token_counter)).first()["prompt"]
        rows = [r.asDict() for r in found.orderBy("rank").collect()]  # a few per question
        return matches_json(rows) if a.json else format_matches(rows, a.show_content, a.content_chars, a.debug_scores)
    if a.command == "eval":
        golden = load_golden_set(a.golden)
        ks = cuts(list(map(int, a.top_k.split(",")))) if a.top_k else None
        report = asking.run_eval(spark, replace(golden, index_name=a.index_name or golden.index_name), s, ks=ks)
        return asking.format_report(report) + "\nwritten to " + write_report(report, s.eval_results_dir)
    if a.command == "health":
        h = indexing.check_health(spark, s, a.store, name, a.repo)
        return indexing.format_health(h)
    return indexing.format_info(indexing.index_info(spark, s, a.store, name))


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    set_up(a.log_level)
    spark = SparkSession.builder.appName("sparrowdex").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    print(run(a, spark, load_settings()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
