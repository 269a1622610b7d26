"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import SEPARATORS, WORD, whole_text

SYMBOLS = "#*$%&|<>"
WINDOW = 8
# Frequent function words of the four languages; compared with whole lower-case words.
STOP_WORDS = (
    "the of and to in a is that for it on was with be as by this are from or an at "
    "der die das und den von zu mit sich des auf ist nicht ein eine dem im "
    "le la les et des un une du que en est pour par dans sur au "
    "el los las y de se por con para su al lo una del"
).split()


@dataclass(frozen=True)
class Rule:
    """A document breaks the rule if ``feature`` lies outside ``low`` to ``high``."""

    name: str
    feature: str
    low: float | None = None
    high: float | None = None

    def broken(self) -> Column:
        value, tests = F.col(self.feature), []
        if self.low is not None:
            tests.append(value < F.lit(self.low))
        if self.high is not None:
            tests.append(value > F.lit(self.high))
        return F.coalesce(tests[0] if len(tests) == 1 else tests[0] | tests[1], F.lit(False))


# Base rules, then those of this method.
BASE_RULES = (
    Rule("few_words", "n_words", low=20),
    Rule("repeated_words", "repeat_percent", high=30),
)
RULES = (
    Rule("word_length", "mean_word_length", low=2, high=20),
    Rule("symbols", "symbols_per_word", high=0.1),
    Rule("stop_words", "stop_word_ratio", low=0.03),
    Rule("duplicate_lines", "dup_line_ratio", high=0.3),
    Rule("bullets", "bullet_line_ratio", high=0.9),
    Rule("ellipses", "ellipsis_line_ratio", high=0.3),
)


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with the counts and ratios that the rules look at.

    A null text counts as empty. All ratios of an empty text are null, and a null breaks no rule.
    """
    text = F.col("_t")
    base = docs.select(F.col(id_col).alias(id_col), whole_text(text_col).alias("_t"))
    split = base.select(
        id_col, "_t",
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_w"),
        F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD)).alias("_l"),
    )
    words, lines = F.col("_w"), F.col("_l")
    starts = F.when(F.size(words) >= WINDOW, F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)))
    counted = split.select(
        id_col, "_w",
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(lines, lambda x: x.rlike(rf"^[{SEPARATORS}]*[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter(lines, lambda x: x.rlike(rf"(\.\.\.|…)[{SEPARATORS}]*$"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter(F.transform(words, F.lower), lambda x: x.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW))).alias("_h"),
    )
    # Windows are compared as words only where their hashes show that some may be equal.
    hashes = F.col("_h")
    may_repeat = F.size(F.array_distinct(hashes)) < F.size(hashes)
    keyed = F.transform(hashes, lambda h, i: F.struct(F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("k"), i.alias("p")))
    windows = counted.withColumn("_s", F.when(may_repeat, F.sort_array(keyed))).drop("_w", "_h")
    repeated = F.filter(
        F.col("_s"),
        lambda x, i: ((i > 0) & (F.get(F.col("_s"), F.greatest(i - 1, F.lit(0)))["k"] == x["k"]))
        | F.coalesce(F.get(F.col("_s"), i + 1)["k"] == x["k"], F.lit(False)),
    )
    places = windows.withColumn("_p", F.sort_array(F.transform(repeated, lambda x: x["p"]))).drop("_s")
    # A word is counted once: each window adds the words up to the next repeated window.
    covered = F.aggregate(
        F.transform(F.col("_p"), lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_p"), i + 1) - p, F.lit(WINDOW)))),
        F.lit(0), lambda total, n: total + n,
    )
    return places.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_p").select(
        "*",
        (F.lit(100) * F.col("n_repeat_words") / F.nullif("n_words", F.lit(0))).alias("repeat_percent"),
        (F.col("word_chars") / F.nullif("n_words", F.lit(0))).alias("mean_word_length"),
        (F.col("n_symbols") / F.nullif("n_words", F.lit(0))).alias("symbols_per_word"),
        (F.col("n_stop_words") / F.nullif("n_words", F.lit(0))).alias("stop_word_ratio"),
        (F.col("n_dup_lines") / F.nullif("n_lines", F.lit(0))).alias("dup_line_ratio"),
        (F.col("n_bullet_lines") / F.nullif("n_lines", F.lit(0))).alias("bullet_line_ratio"),
        (F.col("n_ellipsis_lines") / F.nullif("n_lines", F.lit(0))).alias("ellipsis_line_ratio"),
    )


def apply_rules(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Features of each document, the names of the rules it breaks, ``base_failed`` and ``kept``."""
    names = F.array_compact(F.array(*[F.when(rule.broken(), F.lit(rule.name)) for rule in (*base, *rules)]))
    failed = F.lit(False)
    for rule in base:
        failed = failed | rule.broken()
    return text_features(docs, id_col, text_col).select(
        "*", names.alias("broken_rules"), failed.alias("base_failed"), (F.size(names) == 0).alias("kept")
    )
