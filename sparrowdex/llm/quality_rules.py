"""Quality rules: a threshold table compiled into one Spark projection.

Null and empty texts have no words and fail the base rule.  Repeated rows give repeated results; ties do not
arise, as each row is judged by its own counts.  A very long text costs its words as arrays in one row, and an
empty table gives an empty one.  All other columns of the input, whatever their names, are ignored.  Every expression is a built-in one (no user function)
and works inside a single row, so the plan is a scan and a projection: no shuffle, no skew.
Repeats inside a text are found by sorting its windows, n log n in its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound

_BLANK = "[\\x20\\x09-\\x0D]+"
_SYMBOLS = "#*$%&|<>"

#: Frequent function words of the languages that the corpus holds.
STOP_WORDS = (
    "the of and to in is that it for with was as on be by this are or from at an which have not "
    "der die das und ist nicht ein eine mit von zu im den auf sich für des dem "
    "le la les de des et un une est que qui dans pour par sur du au avec en "
    "el los las y que en por con para una es del se no lo como su"
).split()

#: (rule, left side, relation, bound, right side): a text breaks the rule if left REL bound * right.
#: All sides are counts, so the comparison is exact in integers.  Documents of 50 or more words at sf0.1:
#: - mean word length 3 to 10, the usual range; those of quality 1 have 4.2 to 6.3;
#: - a symbol for 10 words, the usual bound; quality 1 has none, a group of quality 0 has about 0.4 a word;
#: - repeated lines 0.4 of all: quality 1 has up to 0.33, and the usual 0.3 would drop 10 such documents;
#: - bullet lines 0.9 and lines with an ellipsis 0.3, the usual bounds; no document comes near;
#: - stop words 0.06 of all words, well below any language's share; quality 1 has 0.11 or more, most of quality 0 under 0.01.
THRESHOLDS = (
    ("mean_word_short", "word_chars", "<", 3, "n_words"),
    ("mean_word_long", "word_chars", ">", 10, "n_words"),
    ("symbol_ratio", "10 * n_symbols", ">", 1, "n_words"),
    ("dup_line_ratio", "10 * n_dup_lines", ">", 4, "n_lines"),
    ("bullet_line_ratio", "10 * n_bullet_lines", ">", 9, "n_lines"),
    ("ellipsis_line_ratio", "10 * n_ellipsis_lines", ">", 3, "n_lines"),
    ("stop_word_ratio", "100 * n_stop_words", "<", 6, "n_words"),
)


def base_columns(text: Column) -> dict[str, Column]:
    """Arrays that the counts are taken from: words and lines with a word."""
    return {
        "_words": F.filter(F.split(text, _BLANK), lambda w: w != ""),
        "_lines": F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(F.translate(x, "\t\v\f\r", "    "))) > 0),
    }


def repeat_words(words: Column, n: Column) -> Column:
    """Words lying in a 3-word window that occurs twice or more in the text.

    Windows are known by 64-bit hashes of their words' hashes.  Only where some agree are they sorted with
    their positions: neighbours that agree are repeats, and the covered words are summed over their positions.
    """

    def covered(s: Column) -> Column:
        hit = F.filter(
            F.transform(
                s,
                lambda x, k: F.when(
                    F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)),
                    x["i"],
                ),
            ),
            lambda i: i.isNotNull(),
        )
        return F.aggregate(
            F.sort_array(hit),
            F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end")),
            lambda acc, i: F.struct(
                (acc["sum"] + i + 3 - F.greatest(acc["end"], i)).alias("sum"), (i + 3).alias("end")
            ),
            lambda acc: acc["sum"],
        )

    def counted(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bound(placed, covered))

    windows = lambda a: F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(a, i), F.get(a, i + 1), F.get(a, i + 2)))
    return F.when(n < 3, F.lit(0)).otherwise(bound(bound(F.transform(words, lambda w: F.xxhash64(w)), windows), counted))


def measure(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """All counts of the rules, one row per input row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text")).select("doc_id", "_text", *(c.alias(k) for k, c in base_columns(F.col("_text")).items()))
    words, lines = F.col("_words"), F.col("_lines")
    n = F.size(words)
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", _BLANK, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeat_words(words, n).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*(?:[-*•]|\d+[.)])[\x20\x09]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter(lines, lambda x: x.rlike(r"(?:\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter(F.split(F.lower("_text"), _BLANK), lambda w: w.isin(*dict.fromkeys(STOP_WORDS)))).cast("long").alias("n_stop_words"),
    )


def compile_rules(thresholds=THRESHOLDS) -> dict[str, Column]:
    """One boolean column per row of the table: true where the text breaks the rule."""
    return {name: F.expr(f"({left}) {rel} {bound} * ({right})") for name, left, rel, bound, right in thresholds}


def quality_rules(docs: DataFrame, thresholds=THRESHOLDS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Counts, base verdict, broken rules and final verdict of every row of docs.

    kept is false if the base rule fails, else true exactly if no rule of the table is broken.
    """
    broken = compile_rules(thresholds)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    named = [F.when(c, F.lit(k)) for k, c in broken.items()]
    return (
        measure(docs, text_col, id_col)
        .withColumns({"base_failed": failed, "broken_rules": F.array_compact(F.array(*named)) if named else F.array().cast("array<string>")})
        .withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))
    )
