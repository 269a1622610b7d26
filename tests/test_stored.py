"""Stored graphs, array files, run metrics, and picks from large groups."""

import glob
import json
import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import sampling
from logloom.sinks import tables as sinks
from logloom.sources.events import read_events

PROPERTIES = "map<string,string>"
NODES, EDGES = f"label string, id string, properties {PROPERTIES}", f"start_label string, start_id string, predicate string, end_label string, end_id string, properties {PROPERTIES}"


def nodes(spark, rows):
    return spark.createDataFrame([("N", i, p) for i, p in rows], NODES)


def edges(spark, rows):
    return spark.createDataFrame([("N", a, "TO", "N", b, p) for a, b, p in rows], EDGES)


def stored(spark, folder):
    found, links = sinks.read_stored_graph(spark, folder)
    return {r["id"]: r["properties"] for r in found.collect()}, {(r["start_id"], r["end_id"]): r["properties"] for r in links.collect()}


def test_upserts_into_a_stored_graph(spark, tmp_path):
    folder = str(tmp_path / "graph")
    assert sinks.read_stored_graph(spark, folder) is None
    assert sinks.upsert_graph(spark, folder, nodes(spark, [("a", {"x": "1", "y": "1"}), ("b", {})]), edges(spark, [("a", "b", {"w": "1"}), ("a", "gone", {})])) == 1
    assert stored(spark, folder) == ({"a": {"x": "1", "y": "1"}, "b": {}}, {("a", "b"): {"w": "1"}})
    # An edge may lead to a node that an earlier upsert brought.
    assert sinks.upsert_graph(spark, folder, nodes(spark, [("a", {"x": "2"}), ("c", None)]), edges(spark, [("a", "b", {"v": "2"}), ("c", "b", {})])) == 2
    assert stored(spark, folder) == ({"a": {"x": "2", "y": "1"}, "b": {}, "c": {}}, {("a", "b"): {"w": "1", "v": "2"}, ("c", "b"): {}})


def test_a_failed_upsert_leaves_the_graph(spark, tmp_path):
    folder = str(tmp_path / "graph")
    sinks.upsert_graph(spark, folder, nodes(spark, [("a", {"x": "1"})]), edges(spark, []))
    bad = edges(spark, [("a", "a", {})]).withColumn("properties", F.when(F.raise_error(F.lit("lost")).isNull(), F.col("properties")))
    with pytest.raises(Exception, match="lost"):
        sinks.upsert_graph(spark, folder, nodes(spark, [("a", {"x": "9"})]), bad)
    assert stored(spark, folder) == ({"a": {"x": "1"}}, {})
    assert sinks.upsert_graph(spark, folder, nodes(spark, [("a", {"x": "2"})]), edges(spark, [])) == 2
    assert stored(spark, folder)[0] == {"a": {"x": "2"}}


def test_array_files(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 7).selectExpr(
        "'s' AS source", "id AS source_row", "cast(1 + id % 4 AS int) AS alarm_type", "timestamp_seconds(id) AS ts",
        "map('src_ip', concat('10.0.0.', id, '\"\\n')) AS data",
    )
    rejected, report = spark.createDataFrame([("s", 5, "why")], "source string, source_row long, reason string"), spark.createDataFrame([("s", 1000)], "source string, n long")
    folders = [str(tmp_path / "a"), str(tmp_path / "a/"), str(tmp_path / "b")]
    assert sinks.write_events(rows, rejected, report, folders, arrays=True) == [folders[0], folders[2]]
    for folder in (folders[0], folders[2]):
        parts = [open(p).read() for p in sorted(glob.glob(f"{folder}/{sinks.EVENTS_NAME}/part-*"))]
        listed = [row for part in parts if part for row in json.loads(part)]
        assert [row["source_row"] for row in listed] == list(range(1000))
        back = read_events(spark, f"{folder}/{sinks.EVENTS_NAME}", name="part-*")
        assert back.count() == 1000 and back.filter("data.src_ip LIKE '10.0.0.%'").count() == 1000
        assert spark.read.json(f"{folder}/{sinks.REJECTED_NAME}").count() == 1
    empty = rows.limit(0)
    sinks.write_events(empty, rejected, report, [str(tmp_path / "c")], arrays=True)
    assert read_events(spark, f"{tmp_path}/c/{sinks.EVENTS_NAME}", name="part-*").count() == 0


def test_metrics_of_runs(spark, tmp_path):
    rows = spark.range(30).selectExpr("concat('s', id % 3) AS source", "id AS line_id", "concat('e', id % 5) AS event_id")
    for run in ("one", "two"):
        assert sinks.write_measured(rows.filter("id < 20") if run == "one" else rows, f"{tmp_path}/{run}", f"{tmp_path}/metrics", run) == (20 if run == "one" else 30)
    found = spark.read.parquet(f"{tmp_path}/metrics").collect()
    assert {(r["run"], r["source"], r["lines"]) for r in found if r["source"] == "s1"} == {("one", "s1", 7), ("two", "s1", 10)}
    assert all(r["seconds"] > 0 and r["event_count"] == 5 for r in found)


@pytest.mark.parametrize("metric, nearest", [("jaccard", False), ("jaccard", True), ("cosine", False)])
def test_picks_from_all_lines(spark, metric, nearest):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(12)]
    rows = [(rng.choice(["hot", "hot", "cold"]), n, " ".join(rng.choices(words, k=rng.randint(1, 9)))) for n in range(900)]
    frame = spark.createDataFrame(rows, "source string, line_id long, content string").repartition(5)
    found = {(r["source"], r["pick"]): r["content"] for r in sampling.representative(frame, ["source"], k=4, metric=metric, nearest=nearest).collect()}

    def gap(a, b):
        x, y = a.split(), b.split()
        if metric == "jaccard":
            return 1 - len(set(x) & set(y)) / len(set(x) | set(y))
        dot = lambda p, q: sum(p.count(t) * q.count(t) for t in set(p))
        return 1 - dot(x, y) / (dot(x, x) ** 0.5 * dot(y, y) ** 0.5)

    for source in ("hot", "cold"):
        left = [(n, c) for s, n, c in rows if s == source]
        taken = [min(left, key=lambda r: (-len(r[1].split()), r[0]))]
        for _ in range(3):
            left = [r for r in left if r not in taken]
            taken.append(min(left, key=lambda r: ((1 if nearest else -1) * min(gap(r[1], t[1]) for t in taken), r[0])))
        assert [found[(source, i + 1)] for i in range(4)] == [c for _, c in taken]
