"""Pluggable models: embedders and rerankers, with defaults that need no download."""

from __future__ import annotations

import hashlib
import re
from abc import ABC, abstractmethod
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache, lru_cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import TERM, terms
from ..session import ship
from ..settings import Settings


class Embedder(ABC):
    dimensions: int

    @abstractmethod
    def column(self, text: Column) -> Column:
        """Unit vectors array<float> of a text column."""


#: Texts that a model is given in one call.
EMBEDDING_BATCH = 64


def in_batches(model: Callable[[list], list], items: list, size: int) -> Iterator:
    """model's results for all items, `size` of them a call; 0 or less: all in one."""
    size = size if size > 0 else max(1, len(items))
    for lo in range(0, len(items), size):
        yield from model(items[lo : lo + size])


class FunctionEmbedder(Embedder):
    """Any function from a batch of texts to vectors; `load` makes it once in each task."""

    def __init__(self, load: Callable[[], Callable[[list[str]], list]], dimensions: int, batch: int = EMBEDDING_BATCH):
        self.load, self.dimensions, self.batch = load, dimensions, batch

    def column(self, text: Column) -> Column:
        load, size = self.load, self.batch
        ship(SparkSession.active())

        @F.pandas_udf("array<float>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                yield pd.Series([[float(x) for x in v] for v in in_batches(model, texts.fillna("").tolist(), size)], dtype=object)

        return embed(text)


@cache
def _library_model(kind: str, name: str):
    """A model of the sentence-transformers package, loaded once in each worker process."""
    try:
        import sentence_transformers
    except ImportError as error:
        raise RuntimeError(f"the model {name!r} needs the sentence-transformers package") from error
    return getattr(sentence_transformers, kind)(name)


def _sentence_vectors(name: str) -> Callable[[list[str]], list]:
    model = _library_model("SentenceTransformer", name)
    return lambda texts: list(model.encode(texts, convert_to_numpy=True, normalize_embeddings=True, show_progress_bar=False))


def _pair_scores(name: str) -> Callable[[list[tuple[str, str]]], list[float]]:
    model = _library_model("CrossEncoder", name)
    return lambda pairs: list(model.predict(pairs, show_progress_bar=False))


class SentenceEmbedder(FunctionEmbedder):
    """Unit vectors of a sentence-transformers model, by name or folder; workers load it when first needed."""

    def __init__(self, name: str, dimensions: int):
        super().__init__(partial(_sentence_vectors, name), dimensions)


def _hashed_words(dimensions: int):
    """Terms hashed by the first eight hex digits of their MD5: the lowest bit is the sign, the others the place."""

    @lru_cache(1 << 16)
    def place(word: str) -> tuple[int, int]:
        h = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
        return (h >> 1) % dimensions, 1 if h & 1 else -1

    def model(texts: list[str]) -> list:
        out = np.zeros((len(texts), dimensions))
        for row, text in zip(out, texts, strict=True):
            for w, n in Counter(re.findall(TERM, text.lower())).items():
                at, sign = place(w)
                row[at] += n * sign
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return list(out / np.where(length > 0, length, 1))

    return model


class HashedWords(FunctionEmbedder):
    """Signed feature hashing of terms, to unit length: needs no model file."""

    def __init__(self, dimensions: int = 384):
        super().__init__(partial(_hashed_words, dimensions), dimensions)


class KeywordEmbedder(Embedder):
    """Two dimensions: whether one of some words is in the text, for tests and examples."""

    dimensions = 2

    def __init__(self, *words: str):
        self.words = words

    def column(self, text: Column) -> Column:
        hit = F.lit(False)
        for w in self.words:
            hit = hit | F.lower(text).contains(w)
        return F.when(hit, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).cast("array<float>")


def rerank_text(path: Column, symbol: Column, kind: Column, content: Column) -> Column:
    """What a reranker reads of a chunk: a head of its place, a blank line, its content."""
    # fixed values: the head's wording
    return F.concat_ws("\n", F.concat(F.lit("file: "), path), F.concat(F.lit("symbol: "), symbol), F.concat(F.lit("type: "), kind), F.lit(""), content)


class Reranker(ABC):
    @abstractmethod
    def score(self, question: Column, text: Column, row: dict[str, Column]) -> Column:
        """A score for each pair of question and chunk text."""

    def rerank(self, candidates: DataFrame, questions: DataFrame, k: int) -> DataFrame:
        """The k best candidates by this model; its score replaces theirs, ties keep their order."""
        blank = lambda c: F.coalesce(F.col(c), F.lit(""))
        symbol = F.when(blank("qualified_symbol") != "", F.col("qualified_symbol")).otherwise(blank("symbol"))
        text = rerank_text(blank("file_path"), symbol, blank("chunk_type"), blank("content"))
        pairs = candidates.join(questions, "qid").withColumn("_text", text)
        scored = pairs.withColumn("_new", self.score(F.col("question"), F.col("_text"), {c: F.col(c) for c in candidates.columns})).drop("question", "_text")
        order = Window.partitionBy("qid").orderBy(F.desc("_new"), "rank")
        best = scored.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k)
        return best.withColumns({"score": F.col("_new"), "debug_reranker_score": F.col("_new"), "rank": F.col("_rank")}).drop("_new", "_rank")


class TermOverlap(Reranker):
    """Share of the question's terms that the text holds; built-in functions only."""

    def score(self, question: Column, text: Column, row: dict[str, Column]) -> Column:
        asked = F.array_distinct(terms(question))
        return F.size(F.array_intersect(asked, terms(text))) / F.greatest(F.size(asked), F.lit(1))


class ColumnReranker(Reranker):
    """A score from an expression over the candidate's columns."""

    def __init__(self, expression: Callable[[dict[str, Column]], Column]):
        self.expression = expression

    def score(self, question: Column, text: Column, row: dict[str, Column]) -> Column:
        return self.expression(row)


class FunctionReranker(Reranker):
    """Any function from batches of (question, text) pairs to scores; `load` makes it once in each task."""

    def __init__(self, load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]):
        self.load = load

    def score(self, question: Column, text: Column, row: dict[str, Column]) -> Column:
        load = self.load
        ship(SparkSession.active())

        @F.pandas_udf("double")
        def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = load()
            for q, t in batches:
                yield pd.Series([float(x) for x in model(list(zip(q, t, strict=True)))], dtype=float)

        return score(question, text)


class CrossEncoderReranker(FunctionReranker):
    """Scores of a sentence-transformers cross-encoder, by name or folder."""

    def __init__(self, name: str):
        super().__init__(partial(_pair_scores, name))


#: Models that need no download, by the name that a setting gives; any other name is a library model's.
HASHED_WORDS = "hashed-words"
TERM_OVERLAP = "term-overlap"


def build_embedder(settings: Settings) -> Embedder:
    name, n = settings.embedding_model, settings.embedding_dimensions
    return HashedWords(n) if name == HASHED_WORDS else SentenceEmbedder(name, n)


def build_reranker(settings: Settings) -> Reranker | None:
    if not settings.reranker_enabled:
        return None
    name = settings.reranker_model
    return TermOverlap() if name == TERM_OVERLAP else CrossEncoderReranker(name)
