"""Column expressions over text; all of them run in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = "[A-Za-z_][A-Za-z0-9_]*"
_BREAK = "\r\n|[\n\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"

TokenCount = Callable[[Column], Column]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: it is bound to the variable of a lambda over one element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def terms(text: Column) -> Column:
    """Lower-cased identifiers of a text, in order, with repeats."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def split_lines(text: Column) -> Column:
    """Lines without their ends; a final line end opens no further line, the empty text has none."""
    # \z, not $: the latter also matches before a last line end and would take two
    body = F.regexp_replace(text, f"(?:{_BREAK})\\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, _BREAK, -1))


def strip(text: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+\\z", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)\\s+\\z", "")


def quarter_tokens(text: Column) -> Column:
    """A token for each four characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def word_tokens(text: Column) -> Column:
    """A token for each word between blanks."""
    return F.size(F.filter(F.split(text, "(?U)\\s+"), lambda w: w != "")).cast("int")


class ModelTokens:
    """Counts by a tokenizer that Python workers load; special tokens are left out.

    `load` gives a function from a batch of texts to their numbers of tokens.  each() counts all texts
    of an array, as no lambda can call Python.
    """

    def __init__(self, load: Callable[[], Callable[[list[str]], list[int]]]):
        self.load = load

    def __call__(self, text: Column) -> Column:
        load = self.load

        @F.pandas_udf("int")
        def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                yield pd.Series(model(texts.fillna("").tolist()), dtype="int32")

        return count(text)

    def each(self, texts: Column) -> Column:
        load = self.load

        @F.pandas_udf("array<int>")
        def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for lists in batches:
                flat = iter(model([t or "" for ts in lists if ts is not None for t in ts]))
                yield pd.Series([None if ts is None else [next(flat) for _ in ts] for ts in lists], dtype=object)

        return count(texts)


def _library_tokens(name: str) -> Callable[[list[str]], list[int]]:
    """Counts of a tokenizer file (.json), or of a model's own tokenizer, whose weights are not loaded."""
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(name)
        model.no_padding()
        model.no_truncation()
        return lambda texts: [len(x) for x in model.encode_batch(texts, add_special_tokens=False)]
    try:
        from transformers import AutoTokenizer
    except ImportError as error:
        raise RuntimeError(f"token counter {name!r} needs the transformers package") from error
    model = AutoTokenizer.from_pretrained(name)
    return lambda texts: [len(x) for x in model(texts, add_special_tokens=False, padding=False, truncation=False)["input_ids"]] if texts else []


#: Counters by name, as the setting token_counter names them; any other name is that of a tokenizer.
TOKEN_COUNTERS: dict[str, TokenCount] = {"quarter": quarter_tokens, "words": word_tokens}


def token_counter(name: str) -> TokenCount:
    return TOKEN_COUNTERS.get(name) or ModelTokens(partial(_library_tokens, name))


def module_name(path: Column) -> Column:
    """Dotted module of a source path: without extension, package and index files naming their folder."""
    bare = F.regexp_replace(path, r"\.(py|jsx?|tsx?)\z", "")
    parts = F.split(bare, "/")
    last = F.element_at(parts, -1)
    drop = (path.endswith(".py") & (last == "__init__")) | (path.rlike(r"\.(jsx?|tsx?)\z") & (last == "index"))
    return F.array_join(F.when(drop, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts), ".")


def qualified_symbol(module: Column, symbol: Column) -> Column:
    return F.when(F.coalesce(module, F.lit("")) != "", F.concat_ws(".", module, symbol)).otherwise(symbol)


def chunk_id(commit: Column, path: Column, kind: Column, symbol: Column, start: Column, end: Column) -> Column:
    """The identity of a chunk: its place, not its content.  A missing commit counts as "None"."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.sha1(F.concat_ws("|", *map(text, (commit, path, kind, symbol, start, end))))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def index_name(repo: Column) -> Column:
    """Name of a repository's index: its last path part, without .git, in lower case with dashes."""
    base = F.regexp_replace(F.substring_index(F.regexp_replace(repo, "/+\\z", ""), "/", -1), "\\.git\\z", "")
    slug = F.lower(F.regexp_replace(F.regexp_replace(base, "[^A-Za-z0-9]+", "-"), "^-+|-+\\z", ""))
    return F.when(slug == "", F.lit("repository")).otherwise(slug)
