"""Packing ranked chunks into a prompt of bounded tokens."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ModelTokens, TokenCount, quarter_tokens

SEPARATOR = "\n\n---\n\n"


def greedy_budget(rows: Column, tokens: Callable[[Column], Column], budget: int) -> Column:
    """The rows of an array, in order, that fit: one that does not is skipped, later ones may still fit.

    A fold, as a running sum would stop at the first that does not fit.  Budgets of 0 or less hold all.
    """
    if budget <= 0:
        return rows
    spent = F.aggregate(
        rows,
        F.struct(F.array().cast("array<boolean>").alias("fit"), F.lit(0).cast("long").alias("used")),
        lambda s, r: F.struct(
            F.concat(s["fit"], F.array(s["used"] + tokens(r) <= budget)).alias("fit"),
            (s["used"] + F.when(s["used"] + tokens(r) <= budget, tokens(r)).otherwise(0)).cast("long").alias("used"),
        ),
        lambda s: s["fit"],
    )
    return F.filter(rows, lambda r, i: F.get(spent, i))


def _fixed4(value: Column) -> Column:
    """A score with four decimals, halves to even on the binary value, as printf writes it."""

    @F.pandas_udf("string")
    def render(s):
        return s.map(lambda x: f"{x:.4f}")

    return render(value)


def context_blocks(matches: DataFrame) -> DataFrame:
    """qid, at (1-based, in order of priority), block: hits first, then neighbours, by score."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("qid").orderBy(F.coalesce("is_context_expansion", F.lit(False)), F.desc("score"), "rank")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    head = F.concat(F.lit("[Chunk "), F.col("at").cast("string"), F.lit("] score="), _fixed4(F.col("score")))
    role = F.when(F.coalesce("is_context_expansion", F.lit(False)), "neighbor context").otherwise("retrieved match")
    place = F.concat(F.lit("Location: "), text("file_path"), F.lit(":"), text("start_line"), F.lit("-"), text("end_line"))
    symbol = F.when(F.coalesce("symbol", F.lit("")) != "", F.concat(F.lit("Symbol: "), F.col("symbol")))
    block = F.concat_ws("\n", head, F.concat(F.lit("Role: "), role), place, symbol, F.concat(F.lit("Type: "), text("chunk_type")), F.lit("Content:"), F.coalesce("content", F.lit("")))
    return matches.withColumn("at", F.row_number().over(order)).select("qid", "at", block.alias("block"))


def prompts(questions: DataFrame, matches: DataFrame, budget: int = 3000, count: TokenCount = quarter_tokens) -> DataFrame:
    """qid, prompt, n_blocks, n_omitted for every question, also those without matches."""
    gathered = context_blocks(matches).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("at", "block"))).alias("blocks"))
    both = questions.join(gathered, "qid", "left").withColumn("blocks", F.coalesce("blocks", F.array().cast("array<struct<at:int,block:string>>")))
    texts = F.transform("blocks", lambda r: r["block"])
    sizes = count.each(texts) if isinstance(count, ModelTokens) else F.transform(texts, count)
    sized = both.withColumn("_sizes", sizes).withColumn("blocks", F.zip_with("blocks", "_sizes", lambda r, n: F.struct(r["block"].alias("block"), n.cast("long").alias("n"))))
    kept = sized.withColumn("kept", greedy_budget(F.col("blocks"), lambda r: r["n"], budget))
    omitted = F.size("blocks") - F.size("kept")
    note = F.when(omitted > 0, F.concat(F.lit("\n\nNote: "), omitted.cast("string"), F.lit(" retrieved context chunk(s) were omitted due to the prompt token budget."))).otherwise("")
    prompt = F.concat(
        # fixed values: the prompt's wording
        F.lit("You are answering questions about a GitHub repository.\nUse only the retrieved context below. Cite file paths and line numbers when possible.\n\nQuestion:\n"),
        "question",
        F.lit("\n\nRetrieved context:\n"),
        F.array_join(F.transform("kept", lambda r: r["block"]), SEPARATOR),
        note,
        F.lit("\n\nAnswer:\n"),
    )
    return kept.select("qid", prompt.alias("prompt"), F.size("kept").alias("n_blocks"), omitted.alias("n_omitted"))


def preview(content: str, chars: int = 700) -> str:
    """The first characters of a text, each line behind a bar; nothing if no characters are wanted."""
    if chars <= 0:
        return ""
    shown = content.strip()
    shown = shown if len(shown) <= chars else shown[:chars].rstrip() + "..."
    return "\n".join(f"   | {line}" for line in shown.splitlines()) or "   |"


#: The scores that a listing may show, and how a listing names a chunk.
DEBUG_SCORES = ("vector", "keyword", "combined", "reranker")
_PLACE = "{file_path}:{start_line}-{end_line}"
_KIND = "{chunk_type} {symbol}"


def listing(row: dict, number: int, chars: int = 0, debug: bool = False) -> str:
    """One ranked row as a few lines: score and place, kind, then scores and text as asked for."""
    known = defaultdict(lambda: None, row)
    scores = {name: row.get(f"debug_{name}_score") for name in DEBUG_SCORES} if debug else {}
    # a search without a reranker has no score of one; the others count as 0 where they are missing
    if scores and scores["reranker"] is None:
        del scores["reranker"]
    parts = (
        f"{number}. score={row['score']:.4f} {_PLACE.format_map(known)}",
        f"   {_KIND.format_map(known)}",
        "   debug: " + " ".join(f"{name}={value or 0:.4f}" for name, value in scores.items()) if scores else "",
        preview(row.get("content") or "", chars),
    )
    return "\n".join(filter(None, parts))


def format_matches(rows: Sequence[dict], show_content: bool = False, content_chars: int = 700, debug_scores: bool = False) -> str:
    return "\n".join(listing(row, k + 1, content_chars if show_content else 0, debug_scores) for k, row in enumerate(rows))


#: Columns of a result that are no metadata of the chunk.
_OUTSIDE = {"id", "score", "content", "qid", "rank", "ord"}


def matches_json(rows: Sequence[dict]) -> str:
    def record(row: dict) -> dict:
        about = {k: v for k, v in row.items() if k not in _OUTSIDE and v is not None}
        return {k: row.get(k) for k in ("id", "score", "content")} | {"metadata": about}

    return json.dumps(list(map(record, rows)), indent=2, sort_keys=True, default=str)
