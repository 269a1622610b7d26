"""Conditions, graph building, fusion, upsert, paths."""

import pytest
from pyspark.sql import functions as F

from logloom.functions.conditions import compile_condition, parse
from logloom.operators import graph
from logloom.sources.rules import make_rules, rules_from_lines

CASES = [
    ("a not null", {"a": "x"}, True), ("a not null", {"a": " Unknown "}, False), ("a is null", {"a": "N/A"}, True),
    ("zz is null", {"a": "x"}, True), ("a indicates 'YES'", {"a": "oh yes!"}, True), ("a not indicates yes", {"a": None}, False),
    ("a = X", {"a": "x"}, True), ("a == 'x'", {"a": "X"}, True), ("a != x", {"a": None}, False), ("a != null", {"a": "x"}, True),
    ("a > 9", {"a": "10"}, True), ("a > 9", {"a": "b"}, True), ("a <= 2.50", {"a": "2.5"}, True), ("a < beta", {"a": "Alpha"}, True),
    ("a in (x, 'Y' ,z)", {"a": "y"}, True), ("a in (x)", {"a": "?"}, False), ("TRUE", {"a": None}, True), ("", {"a": None}, True),
    ("a not null AND a = x and a in (x,y)", {"a": "x"}, True), ("a = unknown", {"a": "unknown"}, False), ("a >= 1e2", {"a": "99.5"}, False),
]


@pytest.mark.parametrize("text, row, expected", CASES)
def test_conditions(spark, text, row, expected):
    df = spark.createDataFrame([(row["a"],)], "a string")
    assert df.select(compile_condition(text, df.columns)).first()[0] is expected


def test_unknown_clause_fails():
    with pytest.raises(ValueError):
        parse("a ~ b")
    with pytest.raises(ValueError):
        make_rules([{"predicate": "X"}])


RULES = rules_from_lines(
    """
    Process; pid; RUNS_ON; Host; host; outcome; pid not null
    User; user; USES; Process; pid; time,outcome; user not null
    """
)


def rows(spark, data):
    return spark.createDataFrame(data, "n long, host string, pid string, user string, outcome string, time string")


def maps(df, keys):
    return {tuple(r[k] for k in keys): r["properties"] for r in df.collect()}


def test_first_value_wins(spark):
    data = [(1, "h", "7.0", "Bob", "unknown", "t1"), (2, "h", "7", "BOB", "ok", "t2"), (3, None, "8", "?", "bad", "t3")]
    built = graph.build_graph(rows(spark, data), RULES, "n")
    assert maps(built.nodes, graph.NODE) == {
        ("Process", "h|7"): {"process": "h|7", "pid": "7", "host": "h"}, ("Host", "h"): {"host": "h"}, ("User", "bob"): {"user": "bob"},
    }
    assert maps(built.edges, graph.EDGE) == {
        ("Process", "h|7", "RUNS_ON", "Host", "h"): {"outcome": "ok"},
        ("User", "bob", "USES", "Process", "h|7"): {"time": "t1", "outcome": "ok"},
    }
    assert {r["rule_id"]: r["hits"] for r in built.hits.collect()} == {"R1": 2, "R2": 2}


def test_fusion_prefers_first_source(spark):
    one = graph.build_graph(rows(spark, [(1, "h", "1", "u", "ok", None)]), RULES, "n")
    two = graph.build_graph(rows(spark, [(1, "h", "1", "u", "bad", "late")]), RULES, "n")
    fused = graph.fuse({"b": two, "a": one}, RULES)
    edge = fused.edges.filter("predicate = 'USES'").first()
    assert edge["properties"] == {"outcome": "ok", "time": "late"} and edge["sources"] == ["a", "b"]
    assert {r["rule_id"] for r in fused.hits.collect()} == {"a:R1", "a:R2", "b:R1", "b:R2"}


def test_upsert_and_endpoints(spark):
    stored = spark.createDataFrame([("A", "1", {"x": "old", "y": "keep"})], "label string, id string, properties map<string,string>")
    new = spark.createDataFrame([("A", "1", {"x": "new"}), ("A", "2", {})], "label string, id string, properties map<string,string>")
    merged = graph.upsert(stored, new, graph.NODE)
    assert maps(merged, graph.NODE) == {("A", "1"): {"x": "new", "y": "keep"}, ("A", "2"): {}}
    edges = spark.createDataFrame([("A", "1", "P", "A", "2", {}), ("A", "1", "P", "A", "9", {})], "start_label string, start_id string, predicate string, end_label string, end_id string, properties map<string,string>")
    assert graph.with_endpoints(edges, merged).count() == 1
    assert [r["id"] for r in graph.dangling(edges, merged).collect()] == ["9"]
    assert graph.isolated(merged, edges.limit(0)).count() == 2


def test_paths_reuse_and_inequality(spark):
    cells = [("U", "a", "P", "X", "1"), ("U", "b", "P", "X", "1"), ("U", "b", "P", "X", "2")]
    edges = spark.createDataFrame([(*c, {"t": c[1]}) for c in cells], "start_label string, start_id string, predicate string, end_label string, end_id string, properties map<string,string>")
    steps = [graph.Step("u", "U", "P", "x", "X"), graph.Step("v", "U", "P", "x", "X")]
    got = {(r["u"], r["x"], r["v"]) for r in graph.paths(edges, steps, different=[("u", "v")]).collect()}
    assert got == {("a", "1", "b"), ("b", "1", "a")}
    late = F.try_element_at("properties", F.lit("t")) == "b"
    assert graph.paths(edges, steps[:1], where={0: late}).count() == 2
    with pytest.raises(ValueError):
        graph.paths(edges, [steps[0], graph.Step("p", "U", "P", "q", "X")])


def test_summary_counts_its_tables_once(spark):
    """Totals are sums of the counts per label; an empty table has the total 0."""
    seen = spark.sparkContext.accumulator(0)

    def touch(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    nodes = spark.createDataFrame([("A", "1"), ("A", "2"), ("B", "3")], "label string, id string").coalesce(1).mapInPandas(touch, "label string, id string")
    edges = spark.createDataFrame([], "predicate string")
    found = {(r["part"], r["name"]): r["count"] for r in graph.summary(nodes, edges, 1).collect()}
    assert found == {("node", ""): 3, ("node_label", "A"): 2, ("edge", ""): 0} and seen.value == 3


def test_metrics_parse_their_lines_once(spark, monkeypatch):
    from logloom.queries import checks

    stored = []
    monkeypatch.setattr(checks, "durable", lambda rows: stored.append(rows.localCheckpoint()) or stored[0], raising=False)
    assert checks.run_metrics(spark, "/root/testdata/sf0.001").count() > 0 and len(stored) == 1


def test_edges_of_a_path_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(name):
        made.add(1)
        return name

    rows = [("A", "1", "TO", "B", "2"), ("B", "2", "ON", "C", "3"), ("C", "3", "IN", "D", "4"), ("A", "5", "TO", "B", "6")]
    edges = spark.createDataFrame([(*r, {"t": "9"}) for r in rows], "start_label string, start_id string, predicate string, end_label string, end_id string, properties map<string,string>")
    edges = edges.withColumn("predicate", F.udf(seen).asNondeterministic()("predicate"))
    steps = [graph.Step("a", "A", "TO", "b", "B"), graph.Step("b", "B", "ON", "c", "C"), graph.Step("c", "C", "IN", "d", "D")]
    got = graph.paths(edges, steps, keep=["t"]).collect()
    assert [(r["a"], r["b"], r["c"], r["d"], r["e2_t"]) for r in got] == [("1", "2", "3", "4", "9")]
    assert made.value == len(rows)


def test_rules_of_other_steps_change_no_edge(spark):
    rules = rules_from_lines(
        """
        User; user; TO; Host; host; k; user not null
        User; user; AT; Host; host; j; always
        User; peer; TO; Host; host; j,k; peer not null
        """
    )
    rows = [(1, "u", "p", "h", None, "j1"), (2, "p", "u", "h", "k2", "j2"), (3, "u", "u", "g", "k3", None)]
    params = spark.createDataFrame(rows, "n int, user string, peer string, host string, k string, j string")
    steps = [graph.Step("u", "User", "TO", "h", "Host")]
    few = graph.rules_for(rules, steps)
    assert [r.rule_id for r in few] == ["R1", "R3"]

    def edges(rules):
        made = graph.build_graph(params, rules, "n").edges.filter("predicate = 'TO'")
        return sorted((r["start_id"], r["end_id"], sorted(r["properties"].items())) for r in made.collect())

    assert edges(few) == edges(rules)
