"""Template stage: remembered patterns first, then a pattern per group, retries of what it misses, and a memory that grows.

Groups of lines are tried all at once, round by round. Each round looks every line that is left up in the memory, makes
one pattern per group from a few sample lines, keeps the lines in which it is found, and remembers the pattern. The
lines of a group that its pattern misses form finer groups in the next round. A round's lines and memory are written
before the next one starts, so no round repeats the scans of an earlier one. Lines are written as compressed columns,
sorted by group inside their part.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions import patterns
from logloom.functions.regexes import (
    clean_generated,
    escape,
    fit_regex,
    regex_to_template,
    says_too_little,
    template_to_regex,
    tidy_regex,
    without_commas,
)
from logloom.functions.text import WILDCARD, event_id, has_digit, tokens
from logloom.operators import memory as memories
from logloom.operators.sampling import hashed_order
from logloom.operators.skew import first_rows, lookup_join
from logloom.operators.templates import generalise
from logloom.session import durable, stored

# What tells that a line holds variable parts, besides digits.
VARIABLE_MARKS = (" is ", "=", " to ", "_", "-", ":", ".")
ROUNDS = 3
SAMPLES = 3
# Hexadecimal digits of a digest that order contents as a number, and buckets whose least ones bound the samples.
PLACE_DIGITS, BUCKETS = 15, 16

Generator = Callable[[list[str]], str]


@dataclass
class Stage:
    """What a stage found: each line with its pattern, a row per round, and the memory after it."""

    lines: DataFrame
    rounds: DataFrame
    memory: DataFrame


def is_static(content: Column, n: Column) -> Column:
    """A group whose lines are all equal and show no variable part; its pattern is the line itself."""
    marked = has_digit(content)
    for mark in VARIABLE_MARKS:
        marked = marked | content.contains(mark)
    return (n == 1) & ~marked


def is_long(content: Column, pattern: str, words: int = 100) -> Column:
    """A line of more than ``words`` words that holds a pattern known for such lines."""
    return (F.size(tokens(content)) > words) & F.rlike(without_commas(content), F.lit(without_commas_text(pattern)))


def without_commas_text(pattern: str) -> str:
    return patterns.java_pattern(pattern.replace(",", "")) or "(?!)"


def asked(generator: Generator):
    """The generator's answer for a group's samples; after a failure it is asked with one sample less, at last NULL."""

    @F.pandas_udf(T.StringType())
    def ask(groups: pd.Series) -> pd.Series:
        answers = []
        for samples in groups:
            answer, left = None, list(samples)
            while left and not answer:
                try:
                    answer = generator(left)
                except Exception:  # noqa: BLE001 - a user's function may fail in any way
                    answer = None
                left.pop()
            answers.append(answer or None)
        return pd.Series(answers, dtype=object)

    return ask


def _candidates(rest: DataFrame, groups: list[str], turn: int, samples: int) -> DataFrame:
    """A few contents per group, among them the first ``samples`` by digest; only a group of one content has a single one.

    The least digests of a group's buckets bound what is looked at, so no group is sorted or gathered.
    """
    place = F.conv(F.substring(hashed_order(["content"], turn)[0], 1, PLACE_DIGITS), 16, 10).cast("long")
    dealt = rest.select(*groups, place.alias("_place"))
    least = dealt.groupBy(*groups, F.pmod("_place", F.lit(max(BUCKETS, 4 * samples)))).agg(F.min("_place").alias("_place"))
    nth = F.try_element_at(F.array_sort(F.collect_list("_place")), F.lit(max(samples, 2)))
    bounds = least.groupBy(*groups).agg(F.coalesce(nth, F.lit(2**63 - 1)).alias("_bound"))
    near = lookup_join(rest.select(*groups, "content", "line_id", place.alias("_place")), bounds, groups, "inner")
    return near.filter("_place <= _bound").groupBy(*groups, "content").agg(F.min("line_id").alias("line_id"))


def _group_patterns(
    rest: DataFrame, groups: list[str], turn: int, samples: int, generator: Generator | None, refine: bool
) -> tuple[DataFrame, DataFrame]:
    """One row per group: template, regex, whether it is static, and the pattern as ``patterns.prepared`` gives it.

    Also what the memory keeps of each regex.
    """
    near = durable(_candidates(rest, groups, turn, samples))
    picked = first_rows(near, groups, hashed_order(["content"], turn) + [F.col("line_id")], samples)
    listed = picked.groupBy(*groups).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rank", "content"))), lambda s: s["content"]).alias("_samples")
    )
    sizes = near.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    plain = generalise(picked.withColumn("tokens", tokens(F.col("content"))), groups).withColumnRenamed("template", "_plain")
    made = listed.join(sizes, groups).join(plain, groups)
    made = made.withColumn("_first", F.element_at("_samples", 1)).withColumn("static", is_static(F.col("_first"), F.col("_n")))
    given = F.lit(None).cast("string") if generator is None else clean_generated(asked(generator)(F.col("_samples")))
    made = made.withColumn("_given", given)
    made = durable(made.withColumn("template", F.when(F.col("static"), F.col("_first")).otherwise(F.coalesce("_given", "_plain"))))
    limits = {} if refine else {"run_limit": None, "wildcard_limit": None}
    regex = template_to_regex(F.col("template"), **limits)
    if refine:
        regex = fit_regex(tidy_regex(regex), F.col("_first"))
    made = made.withColumn("regex", F.when(F.col("static"), escape(F.col("_first"))).otherwise(regex))
    # One row per group. Written here, because the long expression of the regex would be copied to each of its uses.
    kept = durable(made.select(*groups, "template", "regex", "static"))
    described = durable(memories.described(kept.select("regex").distinct()))
    # A pattern that says next to nothing would be found in every line.
    able = F.when(~says_too_little(F.col("regex")), without_commas(F.col("regex")))
    made = kept.withColumn("_made", patterns.prepared(able))
    made = made.withColumn("_made", F.col("_made").withField("java", patterns.runnable(F.col("_made.java"))))
    memory = described.select("regex", F.struct("pattern", "keys", "literal").alias("_kept"))
    return made.join(memory, "regex", "left"), described


def fit_stage(
    lines: DataFrame,
    keys: list[str],
    memory: DataFrame | None = None,
    generator: Generator | None = None,
    rounds: int = ROUNDS,
    samples: int = SAMPLES,
    refine: bool = True,
) -> Stage:
    """Patterns for all lines (``keys``, line_id, content).

    Result lines have ``round``, ``way``, ``template``, ``regex`` and ``event_id``; ``way`` says how a line got its
    pattern: from the ``memory``, as a ``static`` line, ``fitted`` with its group, or as its ``own`` after the last
    round. ``generator`` makes a template from a group's sample lines; where there is none, or it fails for all
    numbers of samples, the samples are generalised by position. ``refine`` widens numbers, merges wildcards and fits
    the pattern to a sample line. The first try and ``rounds`` more are made; from the second on, groups are split by
    token count and first token. No lines give no rows.

    Lines are not shuffled where memory and groups are small: each is tried where it is, beside the lines of its group,
    so that a pattern is compiled once for all of them. The rows per round count distinct lines, when they are read.
    """
    every = lines.withColumn("content", F.coalesce("content", F.lit("")))
    names = every.columns
    left = every
    known = memory
    parts, remembered = [], []
    for turn in range(rounds + 1):
        groups = list(keys)
        if turn:
            words = tokens(F.col("content"))
            first = F.coalesce(F.try_element_at(words, F.lit(1)), F.lit(""))
            route = F.when(has_digit(first), WILDCARD).otherwise(first)
            left = left.withColumns({"_n_tokens": F.size(words), "_route": route})
            groups += ["_n_tokens", "_route"]
        recalled = left.withColumn("regex", F.lit(None).cast("string")) if known is None else memories.recall(left, known)
        recalled = stored(recalled.sortWithinPartitions(*groups), "recalled")
        rest = recalled.filter("regex IS NULL").drop("regex")
        made, described = _group_patterns(rest, groups, turn, samples, generator, refine)
        tried = lookup_join(rest, made, groups).withColumn("_hit", patterns.found_in(F.col("content"), F.col("_made")))
        shown = [F.when(F.col("_hit"), F.col(c)).alias(c) for c in ("template", "regex", "static")]
        whole = (F.col("_hit") & memories.fits(F.col("content"), F.col("_kept"))).alias("_whole")
        tried = stored(tried.select(*names, *shown, "_hit", whole), "tried")
        round_ = F.lit(turn).alias("round")
        way = F.when(F.col("static"), "static").otherwise("fitted").alias("way")
        parts.append(tried.filter("_hit").select(*names, round_, way, "template", "regex"))
        if known is not None:
            named = recalled.filter("regex IS NOT NULL")
            template = regex_to_template(F.col("regex")).alias("template")
            parts.append(named.select(*names, round_, F.lit("memory").alias("way"), template, "regex"))
        learned = tried.filter("_whole").groupBy("regex").agg(F.min("line_id").alias("seq"))
        known = durable(memories.merged(known, memories.placed(learned, described)))
        remembered.append(known.count())
        left = tried.filter("NOT _hit").select(*names)
        if left.isEmpty():
            break
    result = left.select(
        *names, F.lit(rounds + 1).alias("round"), F.lit("own").alias("way"), F.col("content").alias("template"),
        escape(F.col("content")).alias("regex"),
    )
    for part in reversed(parts):
        result = part.unionByName(result)
    shown = [*keys, "content", *[c for c in names if c not in (*keys, "content")]]
    found = result.select(*shown, "round", "way", "template", "regex").withColumn("event_id", event_id(F.col("template")))
    # A line without a key has no group.
    return Stage(found.dropna(subset=keys), _report(result.select(*keys, "content", "round", "way"), remembered), known)


def _report(result: DataFrame, remembered: list[int]) -> DataFrame:
    """A row per round: how many distinct lines of a key it tried, and what became of them."""
    at = F.col("round")

    def told(turn: int, n_known: int) -> Column:
        counts = {
            "tried": at >= turn, "recalled": (at == turn) & (F.col("way") == "memory"),
            "static": (at == turn) & (F.col("way") == "static"), "fitted": (at == turn) & (F.col("way") == "fitted"),
            "missed": at > turn,
        }
        cells = [F.count_if(hit).alias(name) for name, hit in counts.items()]
        return F.struct(F.lit(turn).alias("round"), *cells, F.lit(n_known).cast("long").alias("remembered"))

    rows = F.array(*[told(turn, n_known) for turn, n_known in enumerate(remembered)])
    return result.distinct().agg(rows.alias("_rows")).select(F.inline("_rows"))
