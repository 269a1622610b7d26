"""CSV, JSON and specification inputs, extraction hooks, scalars."""

import ipaddress
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from logloom.functions import scalars
from logloom.functions.pairs import pairs
from logloom.operators import hooks, rollup
from logloom.operators.params_web import endpoint
from logloom.sources import events, specs, tables
from logloom.sources.rules import read_rules


def test_pairs(spark):
    cases = {
        'a=1 b="x y" c=\'q r\' a=2 word d=': {"a": "2", "b": "x y", "c": "q r", "d": ""},
        'msg="say \\"hi\\" = ok" z=9': {"msg": 'say "hi" = ok', "z": "9"},
        'k="open v=1 w=2': {"k": "open", "v": "1", "w": "2"},
    }
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert {r["t"]: r["m"] for r in df.select("t", pairs(F.col("t")).alias("m")).collect()} == cases


def test_addresses_like_the_standard_library(spark):
    values = [
        "10.0.0.1", "10.0.0.256", "01.2.3.4", "10.0.0.0/24", "10.0.0.5/33", "10.0.0.0/255.255.255.0", "10.0.0.0/0.0.0.255", "any", "ANY",
        "::", "::1", "fe80::1%eth0", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1::2::3", "::ffff:1.2.3.4", "2001:db8::/32", "2001:db8::/129",
        "12345::", "host", "1.2.3", "1.2.3.4/", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7::", "::g",
    ]

    def known(v):
        try:
            ipaddress.ip_network(v, strict=False) if "/" in v else ipaddress.ip_address(v)
            return True
        except ValueError:
            return v.lower() == "any"

    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r["v"]: r["ok"] for r in df.select("v", scalars.is_address(F.col("v")).alias("ok")).collect()}
    assert got == {v: known(v) for v in values}


def test_csv_dimension_and_rules(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text('﻿Key,Val\nA,"x, ""y""\nz"\n ,no\nb,1\nB,2\n', encoding="utf-8")
    table = tables.read_csv(spark, str(path))
    assert tables.select_columns(table, ["key"], ["none"]).first().asDict() == {"key": "A", "none": ""}
    with pytest.raises(ValueError):
        tables.select_columns(table, ["gone"])
    got = {r["_key"]: r["Val"] for r in tables.keyed(table, "Key", casefold=True).collect()}
    assert got == {"a": 'x, "y"\nz', "b": "2"}
    rules = tmp_path / "r.csv"
    rules.write_text(",".join(tables.RULE_COLUMNS) + '\nA,a,P,B,b,"x, y",a not null\n')
    (rule,) = read_rules(spark, str(rules))
    assert rule.rule_id == "R1" and rule.edge_fields == ("x", "y") and rule.referenced == ["a", "b", "x", "y"]


def test_catalog(spark, tmp_path):
    (tmp_path / "dns_POI.csv").write_text("Query Name,the name\nhost,where\n")
    (tmp_path / "dns_relation.csv").write_text(",".join(tables.RULE_COLUMNS) + "\nA,a,Q,B,b,,\nA,a,P,B,b,,\n")
    (tmp_path / "odd_POI.csv").write_text("field,description\nx,y\n")
    (row,) = tables.catalog(spark, str(tmp_path)).collect()
    assert row["family"] == "dns" and row["fields"] == ["host", "query_name"] and row["predicates"] == ["P", "Q"]


def test_event_and_audit_documents(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "e.json").write_text(json.dumps([{"alarm_type": 1, "data": {"src_ip": "a"}}, {"alarm_type": 4, "data": {"policy": "p"}}]))
    (tmp_path / "bad.json").write_text("{oops")
    found = events.read_events(spark, str(tmp_path))
    rows = sorted(map(tuple, events.flat_events(found, ["src_ip", "policy"]).collect()))
    assert rows == [(1, "a", ""), (4, "", "p")]
    doc = {"_source": {"@timestamp": "2026-07-13T08:34:40.835Z", "log_type": "t", "subject": '{"user":"u"}', "object": "nope"}}
    (tmp_path / "doc.txt").write_text(json.dumps([doc, doc]))
    first = events.read_audit_documents(spark, str(tmp_path / "doc.txt")).first()
    assert first["subject"] == {"user": "u"} and first["object"] == {} and first["timestamp"].startswith("2026")


def test_specs(spark):
    text = json.dumps([[["type", "d", "USER_CMD"], ["a -> b", "x"], ["a->b", "later"], ["plain"]], [["type", "d", "LOGIN"]]])
    rows = specs.field_specs(spark.createDataFrame([(text,)], "t string"), "t", expected=2)
    assert sorted((r["spec_index"], r["source"], r["output"], r["definition"]) for r in rows.collect()) == [
        (1, "a", "b", "x"), (1, "plain", "plain", ""), (1, "type", "type", "d"), (2, "type", "type", "d"),
    ]
    assert specs.dynamic_columns(rows, ["log"]) == ["log", "b", "type", "plain"]
    assert {r["audit_type"] for r in specs.by_audit_type(rows).collect()} == {"USER_CMD", "LOGIN"}
    with pytest.raises(ValueError):
        specs.field_specs(spark.createDataFrame([(text,)], "t string"), "t", expected=3)


def test_failing_extractor_falls_back_to_single_rows(spark):
    lines = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, "ok"), (4, "good")], "n int, content string")

    def extractor(batch: pd.DataFrame) -> pd.DataFrame:
        if (batch["content"] == "bad").any():
            raise ValueError("bad line")
        return pd.DataFrame({"v": batch["content"].str.upper()})

    got = {r["n"]: r["v"] for r in hooks.extract_with(lines, extractor, ["v"], keys=("content",)).collect()}
    assert got == {1: "OK", 2: "", 3: "OK", 4: "GOOD"}


def test_resume_needs_the_same_rows(spark):
    rows = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(ValueError):
        hooks.resume(rows, spark.createDataFrame([(1, "x")], "k int, v string"), "k", ["v"])
    with pytest.raises(ValueError):
        hooks.only_named(rows.withColumn("c", F.lit("a")), "c", ["zz"], rows.withColumn("c", F.lit("a")))


def test_families_and_endpoints(spark):
    names = {"firewallexample/a.log": "firewall", "安全/防火墙日志/x.log": "firewall", "x/access.log": "apache", "a/My App.log": "my_app"}
    df = spark.createDataFrame([(n,) for n in names], "s string")
    assert {r["s"]: r["f"] for r in df.select("s", rollup.parser_family(F.col("s")).alias("f")).collect()} == names
    tags = [r[0] for r in df.select(scalars.path_tag(F.col("s"))).collect()]
    assert len(set(tags)) == 4
    ends = spark.createDataFrame([("1.2.3.4:5",), ("::1:80",), ("[::1]:80",), ("h",)], "c string")
    got = [tuple(r[0]) for r in ends.select(endpoint(F.col("c"))).collect()]
    assert got == [("1.2.3.4", "5"), ("::1", "80"), ("[::1]", "80"), ("h", "")]


def test_long_quoted_values_and_words(spark):
    """Runs are read at once: neither long values nor long words without a pair are given back character by character."""
    long_value, escaped = "v " * 20_000, '\\"' * 50
    text = f'a="{long_value}" b="{escaped}" c=x"y z"w ' + "q" * 3_000 + " d='e f'"
    found = spark.createDataFrame([(text,)], "t string").select(pairs(F.col("t")).alias("m")).first()["m"]
    assert found["a"] == long_value.strip() and found["c"] == "xy zw" and found["d"] == "e f"
    assert found["b"].strip('"') == ""
