"""Cutting oversized chunks into parts of whole lines with overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ModelTokens, TokenCount, bound, quarter_tokens, split_lines
from ..schema import SPLITTABLE_TYPES


def line_groups(counts: Column, max_tokens: int, overlap_tokens: int) -> Column:
    """array<struct<first, last>> (0-based, inclusive) of the groups that lines with these token counts fall in.

    Lines are taken in order while they fit; a group that is full is closed and the next begins with
    the last lines of it that fit in the overlap, one at least if any overlap is wanted.  Lines are
    never cut.  A fold over one row's lines: nothing is shuffled.  The counts are bound to a lambda
    variable first, as the fold looks back at them: an expression would be computed again for each line.
    """
    return bound(counts, lambda c: _fold_groups(c, max_tokens, overlap_tokens))


def _fold_groups(counts: Column, max_tokens: int, overlap_tokens: int) -> Column:
    span = "struct<first:int,last:int>"
    start = F.struct(F.array().cast(f"array<{span}>").alias("done"), F.lit(-1).alias("first"), F.lit(0).alias("sum"), F.lit(0).alias("at"))

    def overlap_first(first: Column, at: Column) -> Column:
        """First line of the next group: how far back from line `at` the overlap reaches."""
        if overlap_tokens <= 0:
            return at
        back = F.reverse(F.slice(counts, first + 1, at - first))
        kept = F.aggregate(
            back,
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("sum"), F.lit(True).alias("open")),
            lambda s, c: F.when(s["open"] & ((s["n"] == 0) | (s["sum"] + c <= overlap_tokens)), F.struct((s["n"] + 1).alias("n"), (s["sum"] + c).alias("sum"), F.lit(True).alias("open"))).otherwise(
                F.struct(s["n"].alias("n"), s["sum"].alias("sum"), F.lit(False).alias("open"))
            ),
            lambda s: s["n"],
        )
        return at - kept

    def step(s: Column, c: Column) -> Column:
        full = (s["first"] >= 0) & (s["sum"] + c > max_tokens)
        begin = overlap_first(s["first"], s["at"])
        carried = F.aggregate(F.slice(counts, begin + 1, s["at"] - begin), F.lit(0), lambda a, x: a + x)
        closed = F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), (s["at"] - 1).alias("last"))))
        return F.when(
            full, F.struct(closed.alias("done"), begin.alias("first"), (carried + c).alias("sum"), (s["at"] + 1).alias("at"))
        ).otherwise(
            F.struct(s["done"].alias("done"), F.greatest(s["first"], F.lit(0)).alias("first"), (s["sum"] + c).alias("sum"), (s["at"] + 1).alias("at"))
        )

    def close(s: Column) -> Column:
        return F.when(s["first"] < 0, s["done"]).otherwise(F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), (s["at"] - 1).alias("last")))))

    return F.aggregate(counts, start, step, close)


def _parts(lines: Column, counts: Column, max_tokens: int, overlap_tokens: int) -> Column:
    """array<struct<k, n, first, last, text>>: the parts of a chunk, one of no lines if it stays whole."""
    part = lambda k, n, first, last, text: F.struct(k.cast("int").alias("k"), n.cast("int").alias("n"), first.cast("int").alias("first"), last.cast("int").alias("last"), text.alias("text"))
    none = F.lit(None)

    def rows(groups: Column) -> Column:
        several = F.transform(groups, lambda g, i: part(i + 1, F.size(groups), g["first"], g["last"], F.array_join(F.slice(lines, g["first"] + 1, g["last"] - g["first"] + 1), "\n")))
        return F.when(F.size(groups) > 1, several).otherwise(F.array(part(F.lit(1), F.lit(1), none, none, none.cast("string"))))

    return bound(line_groups(counts, max_tokens, overlap_tokens), rows)


def split_oversized(
    chunks: DataFrame,
    max_tokens: int = 700,
    overlap_tokens: int = 100,
    count: TokenCount = quarter_tokens,
    types: tuple[str, ...] = SPLITTABLE_TYPES,
) -> DataFrame:
    """chunks with each oversized one of a splittable type replaced by its parts.

    Lines and groups live inside the generator's argument alone: whatever is filtered or selected
    afterwards, a text is split once.
    """
    if max_tokens <= 0:
        return chunks
    large = F.col("chunk_type").isin(*types) & (count(F.col("content")) > max_tokens)
    lines = F.when(large, split_lines(F.col("content"))).otherwise(F.array().cast("array<string>"))
    if isinstance(count, ModelTokens):  # counted in Python, which no lambda can call
        chunks_and = chunks.withColumn("_lines", lines).withColumn("_counts", count.each(F.col("_lines")))
        parts = _parts(F.col("_lines"), F.col("_counts"), max_tokens, overlap_tokens)
    else:
        chunks_and = chunks
        parts = bound(lines, lambda ls: _parts(ls, F.transform(ls, count), max_tokens, overlap_tokens))
    out = chunks_and.select("*", F.explode(parts).alias("_p"))
    p, part = F.col("_p"), F.col("_p.n") > 1
    first = F.coalesce("start_line", F.lit(1))
    changed = {
        "parent_chunk_id": F.when(part, F.col("id")).otherwise(F.col("parent_chunk_id")),
        "id": F.when(part, F.concat_ws(":", "id", F.lit("part"), p["k"].cast("string"))).otherwise(F.col("id")),
        "content": F.when(part, p["text"]).otherwise(F.col("content")),
        "start_line": F.when(part, first + p["first"]).otherwise(F.col("start_line")),
        "end_line": F.when(part, first + p["last"]).otherwise(F.col("end_line")),
        "is_chunk_part": F.when(part, F.lit(True)).otherwise(F.col("is_chunk_part")),
        "part_index": F.when(part, p["k"]).otherwise(F.col("part_index")),
        "part_count": F.when(part, p["n"]).otherwise(F.col("part_count")),
    }
    if "ord" in chunks.columns:  # parts follow each other in the parent's place
        changed["ord"] = F.col("ord") * 1_000_000 + p["k"] - 1
    return out.withColumns(changed).select(*chunks.columns)
