"""Keyword search: fielded BM25 over batches of questions.

Only terms that some question holds are counted per document, so what leaves a scan is bounded by the
questions' terms; lengths and corpus statistics need no term rows at all.  Filters belong below the
statistics: apply them to `docs` first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import terms

K1 = 1.5
B = 0.75
SYMBOL_BONUS = 2.0
PATH_BONUS = 0.75


def search_text(path: Column, symbol: Column, kind: Column, content: Column) -> Column:
    """The text that stands for a chunk: fields weigh by how often they are repeated in it."""
    p, s, k, c = (F.coalesce(x.cast("string"), F.lit("")) for x in (path, symbol, kind, content))
    return F.concat_ws("\n", p, p, s, s, s, k, c)


def term_frequencies(docs: DataFrame, text: Column, wanted: DataFrame | None = None) -> DataFrame:
    """id, term, tf; with wanted(term), of those terms only."""
    rows = docs.select("id", F.explode(terms(text)).alias("term"))
    if wanted is not None:
        rows = rows.join(wanted.select("term").distinct(), "term", "left_semi")
    return rows.groupBy("id", "term").agg(F.count("*").alias("tf"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(docs: DataFrame, text: Column) -> DataFrame:
    """One row: n_docs, avg_len (0 for no documents)."""
    return docs.select(F.size(terms(text)).alias("n")).agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_len"))


def question_terms(questions: DataFrame) -> DataFrame:
    """qid, term, qtf of questions(qid, question)."""
    return questions.select("qid", F.explode(terms(F.col("question"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


#: Stands for the document itself among its terms; no term is empty.
_DOCUMENT = ""


def bm25(docs: DataFrame, questions: DataFrame, text: Column, k1: float = K1, b: float = B, carry: tuple[str, ...] = ()) -> DataFrame:
    """qid, id, score of all documents(id, ...) that share a term with a question; repeated question terms count again.

    Columns to carry depend on the id; they go along without a join.  Texts are read and cut into terms
    once: each document also gives one row for itself, so that frequencies, document frequencies and
    statistics are three readings of one exchange.
    """
    asked = question_terms(questions)
    held = docs.select("id", *carry, terms(text).alias("_terms")).select("id", *carry, F.size("_terms").alias("dl"), "_terms")
    wanted = asked.select("term").distinct().union(docs.sparkSession.range(1).select(F.lit(_DOCUMENT).alias("term")))
    rows = held.select("id", *carry, "dl", F.explode(F.concat(F.array(F.lit(_DOCUMENT)), "_terms")).alias("term"))
    rows = rows.withColumn("term", F.coalesce("term", F.lit(_DOCUMENT)))  # never null: else a join's filter on nulls would be pushed below
    tf = rows.join(wanted, "term", "left_semi").groupBy("id", *carry, "dl", "term").agg(F.count("*").alias("tf"))
    itself = F.col("term") == _DOCUMENT
    # no filters here: they would be pushed below the exchange, and its result could not be read again
    df = tf.groupBy("term").agg(F.sum(F.when(~itself & (F.col("tf") > 0), 1)).alias("df"))
    stats = tf.agg(F.sum(F.when(itself, F.col("tf"))).alias("n_docs"), F.coalesce(F.avg(F.when(itself & (F.col("tf") > 0), F.col("dl"))), F.lit(0.0)).alias("avg_len"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.greatest(F.col("avg_len"), F.lit(1.0)))
    # one row joined to the table of wanted terms: the statistics travel with the frequencies
    weights = asked.join(df, "term").join(stats).select("qid", "term", (F.col("qtf") * idf).alias("w"), "avg_len")
    scored = tf.join(weights, "term").select("qid", "id", *carry, (F.col("w") * F.col("tf") * (k1 + 1) / norm).alias("s"))
    return scored.groupBy("qid", "id", *carry).agg(F.sum("s").alias("score"))


def metadata_bonus(docs: DataFrame, questions: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """qid, id, bonus of documents whose symbol or path holds a question's terms (each counted once)."""
    asked = question_terms(questions).select("qid", "term")
    field = lambda c, w: docs.select("id", *carry, F.explode(F.array_distinct(terms(c))).alias("term"), F.lit(w).alias("bonus"))
    held = field(F.col("symbol"), SYMBOL_BONUS).union(field(F.col("file_path"), PATH_BONUS))
    return held.join(asked, "term").groupBy("qid", "id", *carry).agg(F.sum("bonus").alias("bonus"))


def keyword_scores(docs: DataFrame, questions: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """qid, id, score > 0: fielded BM25 and bonus of chunks(id, file_path, symbol, chunk_type, content)."""
    text = search_text(F.col("file_path"), F.col("symbol"), F.col("chunk_type"), F.col("content"))
    both = bm25(docs, questions, text, carry=carry).union(metadata_bonus(docs, questions, carry))
    return both.groupBy("qid", "id", *carry).agg(F.sum("score").alias("score")).filter("score > 0")


def top_k(scores: DataFrame, k: int, *ties: Column | str) -> DataFrame:
    """The k best of each question with their rank.  Spark cuts each task's rows to k before the shuffle."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), *(ties or ("id",)))
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def keyword_search(docs: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """The k best chunks of each question; equal scores in insertion order where docs have it (ord), else by id."""
    carry = ("ord",) if "ord" in docs.columns else ()
    return top_k(keyword_scores(docs, questions, carry), k, *(carry or ("id",))).drop(*carry)
