"""Token counts through a digest cache.

Contents are reduced to a normal form that has the same token count, and joined by digest to a table
of stored counts (cache key: tokenizer version digest, content digest).  Only distinct contents
without a stored count are encoded; their counts are appended to the cache.

Null text counts as empty (0 tokens).  Repeated texts are encoded once, whatever their number: the
texts that are moved are one per distinct miss, chosen by row id, so a group of copies is never
gathered in one task.  Rows with a null id are kept and counted, rows that share an id each by their own
text; there is nothing to tie.  A very long text is counted whole, as a batch of its own.  An empty table
gives an empty one and leaves the cache as it is.  Columns other than id and text, whatever their names,
are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import cut
from .shared import fresh_path, ship, written

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"

#: Texts of these characters only: case folding and normal form C act on each character alone, and
#: Python's classes \w \d \s agree with the tokenizer's \p{L} \p{N} \s on each of them.
_PLAIN = re.compile("[\\x09-\\x0d\\x20-\\x7e\\xa1-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u012f\\u0131-\\u024f]*")
_BLANK = re.compile(r"[\x20\x09-\x0D]+")
_MEMO = 1 << 17


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


class Counter:
    """Counts tokens as the library of the vocabulary file does, without added special tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.plain = None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        import json

        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_padding()
        tok.no_truncation()
        self.encode = lambda texts: [len(x) for x in tok.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path) as f:
            spec = json.load(f)
        pieces = self._piecewise(spec)
        if pieces:
            self.plain = re.compile(pieces)
            self.special = [x["content"] for x in spec["added_tokens"]]
            self.memo: dict[str, int] = {}

    @staticmethod
    def _piecewise(spec: dict) -> str | None:
        """A Python pattern for the vocabulary's word split, if that split is the known one.

        BPE never joins across pieces, so the count of a text is the sum over its pieces.
        """
        norm = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        known = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
        if norm == ["NFC", "Replace", "Lowercase"] and pre.get("pattern", {}).get("Regex") == known and pre.get("invert"):
            return r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+"
        return None

    def normal(self, text: str) -> str:
        """A form with the same tokens: where the tokenizer itself folds blanks, runs become one."""
        return _BLANK.sub(" ", text).strip(" ") if self.plain else text

    def count(self, texts: list[str]) -> list[int]:
        out: list[int] = [0] * len(texts)
        rest = []
        for i, t in enumerate(texts):
            if self.plain and _PLAIN.fullmatch(t) and not any(s in t for s in self.special):
                out[i] = self._by_piece(t)
            else:
                rest.append(i)
        if rest:
            for i, n in zip(rest, self.encode([texts[i] for i in rest]), strict=True):
                out[i] = n
        return out

    def _by_piece(self, text: str) -> int:
        memo = self.memo
        pieces = self.plain.findall(text.lower())
        try:
            return sum(map(memo.__getitem__, pieces))
        except KeyError:
            new = list({p for p in pieces if p not in memo})
            if len(memo) + len(new) > _MEMO:
                memo.clear()
                new = list(set(pieces))
            memo.update(zip(new, self.encode(new), strict=True))
            n = sum(map(memo.__getitem__, pieces))
            return n


_counters: dict[str, Counter] = {}


def _counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def read_cache(spark: SparkSession, cache_path: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException:
        return spark.createDataFrame([], CACHE_SCHEMA)


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    cache_path: str | None = None,
    text_col: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row of docs; new counts are appended to cache_path.

    Without a cache_path a fresh cache in the shared folder is used.
    """
    spark = docs.sparkSession
    ship(spark)
    cache_path = cache_path or fresh_path(spark, "token-cache")
    version = tokenizer_digest(tokenizer_path)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _counter(tokenizer_path)
        for b in cut(batches, 1):
            texts = b.column(1).to_pylist()
            raw = [(t or "").encode() for t in texts]
            norm = [c.normal(t or "").encode() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([hashlib.sha256(x).digest()[:16] for x in norm], pa.binary()), pa.array([len(x) for x in raw], pa.int64())],
                names=["doc_id", "key", "digest", "n_bytes"],
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    # rows are known by id and a hash of the text, so that rows without an id, or that share one, keep apart
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    keyed = written(source.mapInArrow(digests, f"doc_id {id_type}, key long, digest binary, n_bytes long"), "token-digests")
    stored = read_cache(spark, cache_path).filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    # One row for each distinct content that the cache lacks.
    misses = (
        keyed.groupBy("digest")
        .agg(F.min(F.struct("doc_id", "key")).alias("row"))
        .join(stored, "digest", "left_anti")
        .select("digest", F.col("row.doc_id").alias("_id"), F.col("row.key").alias("_key"))
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _counter(tokenizer_path)
        done: dict[bytes, None] = {}  # rows that repeat an id and its text lie together
        for b in cut(batches, 0):
            texts, digests = [], []
            for t, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = c.normal(t or "")
                d = hashlib.sha256(t.encode()).digest()[:16]
                if d == wanted and d not in done:  # an id may be that of other texts too
                    done[d] = None
                    if len(done) > 1 << 16:
                        done.pop(next(iter(done)))
                    texts.append(t)
                    digests.append(d)
            yield pa.RecordBatch.from_arrays(
                [pa.array([version] * len(texts), pa.string()), pa.array(digests, pa.binary()), pa.array(c.count(texts), pa.int64())],
                names=["tokenizer", "digest", "n_tokens"],
            )

    # merged at every size: the chosen ids grow with the corpus, so they are no side to broadcast
    chosen = source.join(misses.hint("merge"), (F.col("key") == F.col("_key")) & source["doc_id"].eqNullSafe(F.col("_id")))
    chosen.select("text", "digest").mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    counts = read_cache(spark, cache_path).filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    # written, so that the join below reads plain tables and a group of copies can be split
    counts = written(counts, "token-counts").hint("merge")
    return keyed.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")


