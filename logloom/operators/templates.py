"""Line templates: preprocessing, position-wise generalisation, groups and their listing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.text import (
    WILDCARD,
    event_id,
    has_digit,
    is_blank,
    tokens,
    with_mask,
    with_timestamp,
)
from logloom.operators.skew import Lookup, lookup, lookup_join, number_within
from logloom.session import durable

ROUTE = ["source", "n_tokens", "route"]
# Line numbers of one cluster are listed in arrays of at most this many.
LISTING_CHUNK = 4096
# Stands between the words of a folded line; it separates words, so none holds it.
WORD_MARK = "\x1f"
# Characters of groups that a task keeps before it sends them on.
GROUP_BYTES = 32 * 1024 * 1024


def preprocess(lines: DataFrame) -> DataFrame:
    """Non-blank lines with their timestamp split off; purely row-local."""
    kept = lines.filter(~is_blank(F.col("original_content")))
    rest = [c for c in lines.columns if c != "original_content"]
    return with_timestamp(kept, "original_content").select(*rest, "timestamp", "content", "original_content")


def routed(lines: DataFrame, masked: bool = True) -> DataFrame:
    """Token array, its size and the routing token (wildcard when it holds a digit)."""
    lines = with_mask(lines, "content", "_masked") if masked else lines.withColumn("_masked", F.col("content"))
    first = F.try_element_at("tokens", F.lit(1))
    return (
        lines.withColumn("tokens", tokens(F.col("_masked")))
        .drop("_masked")
        .withColumn("n_tokens", F.size("tokens"))
        .withColumn("route", F.when(has_digit(first), WILDCARD).otherwise(F.coalesce(first, F.lit(""))))
    )


def _merged(kept: list[str], text: str) -> list[str]:
    """Words that both have at the same place; other places, and those that only one has, become wildcards."""
    words = text.split(WORD_MARK) if text else []
    both = [a if a == b else WILDCARD for a, b in zip(kept, words)]
    return both + [WILDCARD] * (max(len(kept), len(words)) - len(both))


def _packed(groups: dict[tuple, list], schema: pa.Schema) -> pa.RecordBatch:
    rows = [(*key, text if words is None else WORD_MARK.join(words), n, first) for key, (text, words, n, first) in groups.items()]
    return pa.RecordBatch.from_arrays([pa.array(cells, field.type) for cells, field in zip(zip(*rows), schema)], schema=schema)


def _folded(in_order: bool):
    """Rows (keys, text, n, first) with equal keys folded into one.

    Rows in the order of their keys are folded for good, and only the last group stays open. Otherwise as many groups are
    kept as the limit of bytes allows, and what is left of a key is folded after the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, size, schema = {}, 0, None
        for batch in batches:
            schema = batch.schema
            *keys, texts, counts, firsts = (column.to_pylist() for column in batch.columns)
            for key, text, n, first in zip(zip(*keys), texts, counts, firsts):
                group = groups.get(key)
                if group is None:
                    if size > GROUP_BYTES:
                        yield _packed(groups, schema)
                        groups, size = {}, 0
                    groups[key] = [text, None, n, first]
                    size += len(text) + 100
                    continue
                if group[1] is not None or group[0] != text:
                    group[1] = _merged((group[0].split(WORD_MARK) if group[0] else []) if group[1] is None else group[1], text)
                group[2] += n
                group[3] = group[3] if first is None else first if group[3] is None else min(group[3], first)
            if in_order and len(groups) > 1:
                last, open_group = groups.popitem()
                yield _packed(groups, schema)
                groups = {last: open_group}
                size = len(open_group[0]) + 100
        if groups:
            yield _packed(groups, schema)

    return run


def fold(rows: DataFrame, keys: list[str], first: str, column: str = "tokens") -> DataFrame:
    """One row per key: its ``template``, the ``count`` of its rows and the least ``first`` of them.

    A token stays where every row has it, else it becomes a wildcard; shorter rows count as different at their missing
    positions. Rows are folded before the shuffle, so a hot key sends a few rows per task, and a key of one row its text;
    no token becomes a row of its own.
    """
    text = F.array_join(F.col(column), WORD_MARK).alias("_text")
    sent = rows.select(*keys, text, F.lit(1).cast("long").alias("count"), F.col(first).alias("_first"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in sent.schema])
    dealt = sent.mapInArrow(_folded(False), schema).repartition(*keys).sortWithinPartitions(*keys)
    template = F.replace("_text", F.lit(WORD_MARK), F.lit(" ")).alias("template")
    return dealt.mapInArrow(_folded(True), schema).select(*keys, template, "count", F.col("_first").alias("first_line"))


def generalise(rows: DataFrame, keys: list[str], column: str = "tokens") -> DataFrame:
    """One template per key, as ``fold`` makes it."""
    return fold(rows.withColumn("_none", F.lit(0)), keys, "_none", column).select(*keys, "template")


def discover(lines: DataFrame, masked: bool = True) -> DataFrame:
    """Templates per (source, token count, routing token), with the lines they stand for and the first of them."""
    found = fold(routed(lines.filter(F.col("source").isNotNull()), masked), ROUTE, "line_id")
    return found.withColumn("event_id", event_id(F.col("template")))


def assign(lines: DataFrame, templates: Lookup, masked: bool = True) -> DataFrame:
    """Each line with the template and event id of its group."""
    side = Lookup(templates.table.select(*ROUTE, "template", "event_id"), templates.small)
    return lookup_join(routed(lines, masked), side, ROUTE).drop("tokens", "route")


def parse(lines: DataFrame, masked: bool = True) -> tuple[DataFrame, DataFrame]:
    """Assigned lines and the templates behind them."""
    found = lookup(discover(lines, masked))
    return assign(lines, found, masked), found.table


def group_counts(parsed: DataFrame, columns: tuple[str, ...] = ("content", "event_id", "template")) -> DataFrame:
    return parsed.groupBy(*columns).agg(F.count(F.lit(1)).alias("count"))


def template_count(parsed: DataFrame, column: str = "template") -> DataFrame:
    return parsed.agg(F.count_distinct(column).alias("event_count"))


def ordered_groups(parsed: DataFrame) -> DataFrame:
    """Event groups by the word count of their first line, then by event id."""
    groups = parsed.groupBy("source", "event_id").agg(
        F.min_by(F.size(tokens(F.col("content"))), F.col("line_id")).alias("words"),
        F.count(F.lit(1)).alias("count"),
    )
    return groups.orderBy("words", "event_id", "source")


def split_small(parsed: DataFrame, least: int = 5) -> tuple[DataFrame, DataFrame]:
    """Lines of groups with at least ``least`` lines, and the lines of smaller groups."""
    sizes = parsed.groupBy("source", "event_id").agg(F.count(F.lit(1)).alias("_size"))
    sized = lookup_join(parsed, sizes, ["source", "event_id"], "inner")
    return sized.filter(F.col("_size") >= least).drop("_size"), sized.filter(F.col("_size") < least).drop("_size")


def sized_lines(lines: DataFrame, least: int = 5, masked: bool = True) -> DataFrame:
    """Lines (source, line_id) with their event id and whether its group is ``kept``: has at least ``least`` lines.

    Sizes come from the templates, and lines meet event ids only, never the texts of templates.
    """
    found = durable(discover(lines, masked).select(*ROUTE, "event_id", "count"))
    sizes = found.groupBy("source", "event_id").agg((F.sum("count") >= least).alias("kept"))
    named = found.drop("count").join(sizes, ["source", "event_id"])
    placed = routed(lines, masked).select(*ROUTE, "line_id")
    return lookup_join(placed, named, ROUTE, "inner").select("source", "line_id", "event_id", "kept")


def clusters(parsed: DataFrame) -> DataFrame:
    """Event id, template, first line and size of every cluster."""
    return parsed.groupBy("source", "event_id", "template").agg(
        F.min("line_id").alias("first_line"), F.count(F.lit(1)).alias("count")
    )


def template_clusters(found: DataFrame) -> DataFrame:
    """The same clusters from the templates alone: every line belongs to one of them."""
    return found.groupBy("source", "event_id", "template").agg(
        F.min("first_line").alias("first_line"), F.sum("count").alias("count")
    )


def cluster_preview(parsed: DataFrame, limit: int = 50) -> DataFrame:
    """First clusters in order of appearance, with a flag that more exist."""
    return first_clusters(clusters(parsed), limit)


def first_clusters(every: DataFrame, limit: int = 50) -> DataFrame:
    shown = every.orderBy("first_line", "source", "event_id").limit(limit + 1)
    numbered = shown.withColumn(
        "_rn", F.row_number().over(Window.orderBy("first_line", "source", "event_id"))
    )
    more = F.max("_rn").over(Window.partitionBy()) > limit
    return numbered.withColumn("truncated", more).filter(F.col("_rn") <= limit).drop("_rn")


def cluster_lines(parsed: DataFrame, chunk: int = LISTING_CHUNK) -> DataFrame:
    """All line numbers of every cluster, in arrays bounded by the chunk of line numbers."""
    return parsed.groupBy(
        "source", "event_id", F.floor(F.col("line_id") / chunk).cast("long").alias("chunk")
    ).agg(F.array_sort(F.collect_list("line_id")).alias("line_ids"))


def attach_lines(results: DataFrame, preprocessed: DataFrame, keys: tuple[str, ...] = ("source",)) -> DataFrame:
    """k-th result of a content takes the k-th input line of it; others get blanks.

    Both sides need a unique numeric ``line_id``; numbering is blocked, so a content that
    makes up most of the lines is spread over tasks, and the number is part of the join key.
    """
    on = [*keys, "content"]
    left = number_within(results.withColumnRenamed("line_id", "_order"), on, "_order", "_k")
    right = number_within(preprocessed.select(*on, "line_id", "timestamp", "original_content"), on, "line_id", "_k")
    joined = left.join(right, [*on, "_k"], "left")
    blank = F.col("line_id").isNull()
    return joined.withColumn("timestamp", F.coalesce("timestamp", F.lit(""))).withColumn(
        "original_content", F.when(blank, F.col("content")).otherwise(F.col("original_content"))
    ).drop("_k")


def accuracy(pairs: DataFrame, predicted: str, truth: str) -> DataFrame:
    """Share of equal templates, and share of lines in groups equal to one true group."""
    def bare(c: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(c, r"\s+", ""), r"<\*>|\(\.\*\?\)", "")

    cells = pairs.groupBy(bare(F.col(predicted)).alias("p"), bare(F.col(truth)).alias("t")).agg(
        F.count(F.lit(1)).alias("n")
    )
    predicted_groups = cells.groupBy("p").agg(
        F.count(F.lit(1)).alias("kinds"), F.min("t").alias("t"), F.sum("n").alias("size")
    )
    true_sizes = cells.groupBy("t").agg(F.sum("n").alias("true_size"))
    right = predicted_groups.join(true_sizes, "t").select(
        F.when((F.col("kinds") == 1) & (F.col("size") == F.col("true_size")), F.col("size")).otherwise(0).alias("g"),
        F.lit(0).alias("e"), F.lit(0).alias("n"), F.lit(1).alias("events"),
    )
    equal = cells.select(
        F.lit(0).alias("g"), F.when(F.col("p") == F.col("t"), F.col("n")).otherwise(0).alias("e"), "n",
        F.lit(0).alias("events"),
    )
    return right.unionByName(equal).agg(
        (F.sum("g") / F.sum("n")).alias("ga"),
        (F.sum("e") / F.sum("n")).alias("pa"),
        F.sum("events").alias("event_count"),
    )
