"""Raw log files as numbered lines, source selection and header formats."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions.text import WILDCARD, captured, is_blank, strip
from logloom.operators.skew import lookup_join, number_within

LOG_NAME = r"(?i)^.+\.log(?:\.[^./]*)*$"
LABEL_NAME = r"(?i)-label\.log"

# Header layouts of public benchmark logs, and their mask patterns.
LOG_FORMATS = {
    "HDFS": ("<Date> <Time> <Pid> <Level> <Component>: <Content>", [r"blk_-?\d+", r"(\d+\.){3}\d+(:\d+)?"]),
    "Hadoop": (r"<Date> <Time> <Level> \[<Process>\] <Component>: <Content>", [r"(\d+\.){3}\d+"]),
    "Spark": ("<Date> <Time> <Level> <Component>: <Content>", []),
    "Zookeeper": (r"<Date> <Time> - <Level>  \[<Node>:<Component>@<Id>\] - <Content>", [r"(/|)(\d+\.){3}\d+(:\d+)?"]),
    "BGL": ("<Label> <Timestamp> <Date> <Node> <Time> <NodeRepeat> <Type> <Component> <Level> <Content>", [r"core\.\d+"]),
    "HPC": ("<LogId> <Node> <Component> <State> <Time> <Flag> <Content>", [r"=\d+"]),
    "Thunderbird": (r"<Label> <Timestamp> <Date> <User> <Month> <Day> <Time> <Location> <Component>(\[<PID>\])?: <Content>", [r"(\d+\.){3}\d+"]),
    "Windows": ("<Date> <Time>, <Level>                  <Component>    <Content>", [r"0x.*?\s"]),
    "Linux": (r"<Month> <Date> <Time> <Level> <Component>(\[<PID>\])?: <Content>", [r"(\d+\.){3}\d+", r"\d{2}:\d{2}:\d{2}"]),
    "Android": ("<Date> <Time>  <Pid>  <Tid> <Level> <Component>: <Content>", [r"(/[\w-]+)+", r"([\w-]+\.){2,}[\w-]+", r"\b(\-?\+?\d+)\b|\b0[Xx][a-fA-F\d]+\b|\b[a-fA-F\d]{4,}\b"]),
    "HealthApp": (r"<Time>\|<Component>\|<Pid>\|<Content>", []),
    "Apache": (r"\[<Time>\] \[<Level>\] <Content>", [r"(\d+\.){3}\d+"]),
    "Proxifier": (r"\[<Time>\] <Program> - <Content>", [r"<\d+\ssec", r"([\w-]+\.)+[\w-]+(:\d+)?", r"\d{2}:\d{2}(:\d{2})*", r"[KGTM]B"]),
    "OpenSSH": (r"<Date> <Day> <Time> <Component> sshd\[<Pid>\]: <Content>", [r"(\d+\.){3}\d+", r"([\w-]+\.){2,}[\w-]+"]),
    "OpenStack": (r"<Logrecord> <Date> <Time> <Pid> <Level> <Component> \[<ADDR>\] <Content>", [r"((\d+\.){3}\d+,?)+", r"/.+?\s", r"\d+"]),
    "Mac": (r"<Month>  <Date> <Time> <User> <Component>\[<PID>\]( \(<Address>\))?: <Content>", [r"([\w-]+\.){2,}[\w-]+"]),
}


def _relative(path: Column, root: str) -> Column:
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    prefix = "^(?:[a-z0-9]+:)?/*" + re.escape(root.split(":", 1)[-1].strip("/")) + "/*"
    return F.regexp_replace(plain, prefix, "")


def _name(source: Column) -> Column:
    return F.substring_index(source, "/", -1)


def is_log_source(source: Column, names: str = LOG_NAME) -> Column:
    return _name(source).rlike(names) & ~_name(source).rlike(LABEL_NAME)


def without_suffix(source: Column) -> Column:
    return F.regexp_replace(source, r"(?<=[^/])\.[^./]*$", "")


def selected_by(source: Column, selectors: list[str]) -> Column:
    """Path, stem, name, substring or path part; no selector or ``all`` takes everything."""
    wanted = [s.strip().replace("\\", "/").lower() for s in selectors if s.strip()]
    if not wanted or wanted == ["all"]:
        return F.lit(True)
    path = F.lower(source)
    hit = F.lit(False)
    for selector in wanted:
        # The path contains its stem, name and parts, so one containment test covers them.
        hit = hit | path.contains(selector)
    return hit


def list_sources(spark: SparkSession, root: str, selectors: list[str] | None = None, names: str = LOG_NAME) -> DataFrame:
    """Log files below a folder with their sizes; no file content is read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .select(_relative(F.col("path"), root).alias("source"), F.col("length").alias("size_bytes"))
    )
    return files.filter(is_log_source(F.col("source"), names) & selected_by(F.col("source"), selectors or []))


def require_some(sources: DataFrame, what: str) -> DataFrame:
    if sources.isEmpty():
        raise FileNotFoundError(what)
    return sources


def read_selected(spark: SparkSession, root: str, selectors: list[str] | None = None, names: str = LOG_NAME) -> DataFrame:
    """Numbered lines of the log files that the selectors choose; that none is chosen is an error, not an empty result."""
    chosen = list_sources(spark, root, selectors, names)
    require_some(chosen, f"no log file below {root} for {', '.join(selectors or ['all'])}")
    return read_lines(spark, root, selectors, names)


def read_lines(
    spark: SparkSession, root: str, selectors: list[str] | None = None, names: str = LOG_NAME
) -> DataFrame:
    """Columns source, line_id, original_content: non-blank lines, numbered per source."""
    raw = (
        spark.read.option("recursiveFileLookup", True)
        .text(root)
        .select(
            _relative(F.col("_metadata.file_path"), root).alias("source"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.regexp_replace(F.make_valid_utf8("value"), "^\ufeff", "").alias("original_content"),
        )
    )
    kept = raw.filter(
        is_log_source(F.col("source"), names)
        & selected_by(F.col("source"), selectors or [])
        & ~is_blank(F.col("original_content"))
    )
    return number_lines(kept)


def number_lines(lines: DataFrame) -> DataFrame:
    """1-based numbers per source from columns source, _start (split offset).

    Rows of one split are consecutive in one task; the splits of a source are shifted by
    the row counts of its earlier splits. No source is sorted or gathered as a whole.
    """
    marked = lines.withColumn("_mark", F.monotonically_increasing_id())
    earlier = Window.partitionBy("source").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        marked.groupBy("source", "_start")
        .agg(F.min("_mark").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .select("source", "_start", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    )
    return lookup_join(marked, splits, ["source", "_start"], "inner").select(
        "source",
        (F.col("_shift") + F.col("_mark") - F.col("_first") + 1).alias("line_id"),
        "original_content",
    )


def header_pattern(layout: str, direct: bool = False) -> tuple[str, dict[str, int]]:
    """Anchored pattern of a header layout, and the group number of each header.

    The ``direct`` form reads leading headers that are followed by blanks as one word each,
    without backtracking.
    """
    pieces = re.split(r"(<[^<>]+>)", layout)
    pattern, positions, groups, leading = "^", {}, 0, not pieces[0]
    for number, piece in enumerate(pieces):
        if number % 2:
            groups += 1
            positions[piece[1:-1]] = groups
            leading = leading and re.fullmatch(" +", pieces[number + 1]) is not None
            pattern += r"(\S*+)" if direct and leading else "(.*?)"
        else:
            groups += len(re.findall(r"(?<!\\)\((?!\?)", piece))
            pattern += re.sub(" +", r"\\s++" if direct and leading else r"\\s+", piece)
    return pattern + "$", positions


def header_fields(lines: DataFrame, layout: str, column: str = "original_content") -> DataFrame:
    """One column per header of the layout; lines that do not fit are dropped.

    Lazy groups backtrack over every blank of a line that does not fit. The direct form
    finds the same groups; where it fails, another reading exists only in lines with runs
    of blanks or unusual line breaks, so only those are tried by the full pattern.
    """
    full, positions = header_pattern(layout)
    direct, _ = header_pattern(layout, direct=True)
    count = max(positions.values())
    text = strip(F.col(column))
    again = text.rlike(r"\s{2}|[\n\r\u0085\u2028\u2029]")
    found = lines.withColumn("_d", captured(text, direct, count))
    found = found.withColumn(
        "_g", F.when(F.col("_d").isNotNull(), F.col("_d")).when(again, captured(text, full, count))
    )
    fields = [F.element_at("_g", n).alias(name) for name, n in positions.items()]
    return found.filter("_g IS NOT NULL").select("source", "line_id", *fields)


def known_format(name: str) -> tuple[str, list[str]]:
    """Layout and masks of a public log format, by its name in any case."""
    by_name = {known.lower(): known for known in LOG_FORMATS}
    if name.lower() not in by_name:
        raise ValueError(f"unknown log format {name}; known are {', '.join(LOG_FORMATS)}")
    return LOG_FORMATS[by_name[name.lower()]]


def format_fields(lines: DataFrame, name: str, column: str = "original_content") -> DataFrame:
    """Header fields of a public log format, and ``masked``: its content with the format's variable parts as wildcards."""
    layout, masks = known_format(name)
    found = header_fields(lines, layout, column)
    masked = F.col("Content")
    for pattern in masks:
        masked = F.regexp_replace(masked, pattern, WILDCARD)
    return found.withColumn("masked", masked)


def percent_slice(lines: DataFrame, first_pct: float = 100, start_pct: float = 0) -> DataFrame:
    """Lines of each source from a start percentage on, up to a percentage of the rest."""
    totals = lines.groupBy("source").agg(F.max("line_id").alias("_total"))
    start = F.floor(F.col("_total") * F.lit(start_pct) / 100)
    size = F.floor((F.col("_total") - start) * F.lit(first_pct) / 100)
    joined = lookup_join(lines, totals, ["source"], "inner")
    return joined.filter((F.col("line_id") > start) & (F.col("line_id") <= start + size)).drop("_total")


def renumbered(lines: DataFrame) -> DataFrame:
    """Lines of each source numbered again without gaps."""
    return number_within(lines, ["source"], "line_id", "_new").withColumn("line_id", F.col("_new")).drop("_new")
