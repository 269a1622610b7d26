"""Writing results: per-source tables, event files, graphs, summaries."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from logloom.operators.graph import EDGE, NODE, Graph, upsert, with_endpoints
from logloom.operators.rollup import run_metrics
from logloom.session import durable

# Names of the event files.
EVENTS_NAME = "customer_events.json"
REJECTED_NAME = "customer_events_rejected.jsonl"
REPORT_NAME = "customer_event_validation.json"


def declared(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Only the declared columns, '' where a value or a column is missing."""
    known = set(rows.columns)
    return rows.select(
        *[(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if c in known else F.lit("")).alias(c) for c in columns]
    )


def write_csv(rows: DataFrame, path: str, columns: list[str], mode: str = "overwrite", by: tuple[str, ...] = ()) -> None:
    out = declared(rows, list(dict.fromkeys([*by, *columns])))
    writer = out.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "")
    if by:
        writer = writer.partitionBy(*by).option("partitionOverwriteMode", "dynamic")
    writer.csv(path)


def write_by_source(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per source; overwriting replaces only the sources that are written."""
    rows.write.mode(mode).partitionBy("source").option("partitionOverwriteMode", "dynamic").parquet(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def append_counts(rows: DataFrame, path: str) -> None:
    """Counts of equal rows, added to those written before."""
    append(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("count")), path)


def distinct_paths(paths: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(p.rstrip("/") for p in paths))


def _bracketed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The JSON objects of one part as the lines of one array, a batch at a time."""
    started = False
    for batch in batches:
        lines = [f",{text}" for text in batch["value"]]
        if lines and not started:
            lines[0], started = "[" + lines[0][1:], True
        yield pd.DataFrame({"value": lines})
    if started:
        yield pd.DataFrame({"value": ["]"]})


def write_json_arrays(rows: DataFrame, path: str) -> None:
    """One JSON array per part file, rows in the order that they have; no part is gathered."""
    texts = rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("value"))
    texts.mapInPandas(_bracketed, "value string").write.mode("overwrite").text(path)


def write_events(accepted: DataFrame, rejected: DataFrame, report: DataFrame, folders: Iterable[str], arrays: bool = False) -> list[str]:
    """Accepted events in time order, rejected rows as JSON lines, and the report.

    Rows stay distributed: each name is a folder of part files, sorted by range. Accepted events are JSON lines, or
    with ``arrays`` one JSON array per part file, as other readers of such files expect. Each input is evaluated once,
    however many folders there are; ``export(..., stored=True)`` also makes the three share one evaluation.
    """
    folders = distinct_paths(folders)
    ordered = accepted.orderBy("source", F.col("ts").asc_nulls_last(), "source_row")
    ordered = ordered.select("source", "source_row", "alarm_type", "data")
    if len(folders) > 1:
        ordered, rejected, report = durable(ordered), durable(rejected), durable(report)
    for folder in folders:
        if arrays:
            write_json_arrays(ordered, f"{folder}/{EVENTS_NAME}")
        else:
            ordered.write.mode("overwrite").json(f"{folder}/{EVENTS_NAME}")
        rejected.write.mode("overwrite").json(f"{folder}/{REJECTED_NAME}")
        report.write.mode("overwrite").json(f"{folder}/{REPORT_NAME}")
    return folders


def properties_json(column: str = "properties") -> Column:
    """JSON object with sorted names."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(column))))


def write_graph(graph: Graph, folder: str) -> None:
    nodes = graph.nodes.select(*NODE, properties_json().alias("properties_json"))
    edges = graph.edges.select(*EDGE, properties_json().alias("properties_json"))
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").parquet(f"{folder}/edges")


def read_graph(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    def one(name: str, keys: list[str]) -> DataFrame:
        rows = spark.read.parquet(f"{folder}/{name}")
        return rows.select(*keys, F.from_json("properties_json", "map<string,string>").alias("properties"))

    return one("nodes", NODE), one("edges", EDGE)


# Stored graphs: every upsert writes a whole new version aside, and a row of the table of versions makes it the current
# one. A write that fails leaves no such row, so readers keep the version before it.
VERSIONS = "version long, path string"


def current_graph(spark: SparkSession, folder: str) -> tuple[int, str] | None:
    """Number and path of the current version of a stored graph; None where there is none yet."""
    try:
        last = spark.read.schema(VERSIONS).parquet(f"{folder}/versions").agg(F.max(F.struct("version", "path")).alias("v")).first()["v"]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return None if last is None else (last["version"], last["path"])


def read_stored_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame] | None:
    """Nodes and edges of the current version."""
    current = current_graph(spark, folder)
    return None if current is None else read_graph(spark, current[1])


def upsert_graph(spark: SparkSession, folder: str, nodes: DataFrame, edges: DataFrame) -> int:
    """Set nodes and edges over those of a stored graph, and return the number of the new version.

    Incoming properties win, others stay. An edge is taken only if both of its nodes exist after the upsert. Keys of
    the incoming rows must be unique. One writer at a time; readers may read meanwhile.
    """
    current = current_graph(spark, folder)
    if current is None:
        old_nodes, old_edges = nodes.limit(0), edges.limit(0)
    else:
        old_nodes, old_edges = read_graph(spark, current[1])
    number = current[0] + 1 if current else 1
    path = f"{folder}/graph-{number}-{uuid.uuid4().hex}"
    merged = upsert(old_nodes, nodes, NODE)
    merged.select(*NODE, properties_json().alias("properties_json")).write.parquet(f"{path}/nodes")
    known = spark.read.parquet(f"{path}/nodes")
    joined = upsert(old_edges, with_endpoints(edges, known), EDGE)
    joined.select(*EDGE, properties_json().alias("properties_json")).write.parquet(f"{path}/edges")
    append(spark.createDataFrame([(number, path)], VERSIONS).coalesce(1), f"{folder}/versions")
    return number


def append_metrics(metrics: DataFrame, path: str, run: str, started: float, ended: float) -> None:
    """Rows of a run's metrics with its name, start and seconds, behind those of earlier runs."""
    timed = metrics.withColumns(
        {"run": F.lit(run), "started": F.timestamp_seconds(F.lit(started)), "seconds": F.lit(ended - started)}
    )
    append(timed, path)


def write_measured(parsed: DataFrame, path: str, metrics_path: str, run: str) -> int:
    """Write parsed lines by source, and append their metrics per source with the time that the writing took.

    The rows are counted while they are written; the metrics are read from what was written, not computed again.
    """
    seen = Observation(f"written-{run}")
    started = time.time()
    write_by_source(parsed.observe(seen, F.count(F.lit(1)).alias("lines")), path)
    ended = time.time()
    written = parsed.sparkSession.read.parquet(path)
    append_metrics(run_metrics(written), metrics_path, run, started, ended)
    return seen.get["lines"]
