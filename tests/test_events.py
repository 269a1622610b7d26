"""Contract events: classification, defaults, state, validation, enrichment, reconciliation."""

import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import events, reconcile
from logloom.operators.rule_state import carry_forward, time_block
from logloom.sources.tables import keyed

DEVICE = {
    "device_name": "edge-fw7", "device_type": "防火墙", "management_ip": "172.20.4.2", "protocol": "UDP",
    "web_port": "8443", "cli_port": "2222", "terminal_port": "5900", "default_user": "keeper",
}
ASSET = {"src_ip": "172.20.9.31", "src_mac": "0a:1b:2c:3d:4e:5f", "default_user": "keeper"}


def frame(spark, rows):
    names = list(dict.fromkeys(n for r in rows for n in r))
    data = [tuple(r.get(n, "") for n in names) for r in rows]
    return spark.createDataFrame(data, ", ".join(f"`{n}` string" for n in names))


def params(spark, rows, source):
    indexed = [dict(r, source=source, source_row=str(i)) for i, r in enumerate(rows, start=2)]
    return frame(spark, indexed).withColumn("source_row", F.col("source_row").cast("long"))


def export(spark, rows, source, assets=(ASSET,), devices=(DEVICE,)):
    def dim(items, key, fold):
        return keyed(frame(spark, [dict(i, pos=str(n)) for n, i in enumerate(items)] or [{key: "", "pos": "0"}]), key, "pos", fold)

    return events.export(params(spark, rows, source), dim(assets, "src_ip", False), dim(devices, "device_name", True))


def accepted(made):
    return made.accepted.orderBy(F.col("ts").asc_nulls_last(), "source_row").collect()


MODULES = {1: "terminal", 2: "webui", 3: "cli"}


def session(kind, minute, who="nora", address="172.20.9.77", mac="0a:00:5e:10:20:30"):
    """A login through the module of an alarm type."""
    return {
        "alarm_type": str(kind), "time": f"2024/03/09 18:{minute:02d}:30", "device_name": "edge-fw7", "module": MODULES[kind],
        "event_type": "admin_session", "event_action": "login", "user": who, "src_ip": address, "src_mac": mac,
        "dst_ip": "172.20.4.9", "dst_port": "8443", "protocol": "UDP",
    }


def policy(minute, rule, **fields):
    row = {"alarm_type": "4", "time": f"2024/03/09 18:{minute:02d}:30", "device_name": "edge-fw7", "event_type": "policy_rule", "event_action": "add"}
    return row | {"user": "nora", "rule_id": rule, "policy_type": "permit", "src_addr": "172.21.0.0/16", "dst_addr": "172.22.8.1"} | fields


def test_each_type_reaches_its_payload(spark):
    rows = [policy(1, "r7"), session(2, 5, "omar"), session(1, 9), session(3, 3, mac="0a:00:5e:99:99:99")]
    made = export(spark, rows, "gate", assets=())
    by_type = {r["alarm_type"]: r["data"] for r in accepted(made)}
    assert [r["alarm_type"] for r in accepted(made)] == [4, 3, 2, 1] and made.rejected.isEmpty()
    assert by_type[4]["policy"] == "允许" and by_type[3]["src_mac"].endswith("99:99:99")
    assert by_type[2]["login_account"] == "omar" and by_type[2]["protocol"] == "IP协议UDP"


def test_unknown_kind_is_rejected(spark):
    odd = {"time": "2024/03/09 18:00:00", "event_type": "blacklist", "event_action": "modify", "module": "blacklist", "device_name": "edge-fw7"}
    made = export(spark, [odd, session(1, 2)], "gate")
    assert [r["alarm_type"] for r in accepted(made)] == [1]
    assert "客户协议未定义事件类型" in made.rejected.first()["reason"]


def test_duplicates_stay(spark):
    found = accepted(export(spark, [session(3, 4), session(2, 5), session(3, 4)], "gate"))
    payloads = [r["data"] for r in found]
    assert [r["alarm_type"] for r in found] == [3, 3, 2] and payloads[0] == payloads[1] != payloads[2]


def test_firewall_defaults(spark):
    """Blank fields of a firewall source come from its device and the device's asset."""
    blank = {"device_name": "edge-fw7", "event_type": "admin_session"}
    rows = [
        blank | {"module": "cli", "event_action": "login", "time": "2024/03/09 07:10:00", "management_ip": "172.20.9.31"},
        blank | {"module": "cli", "event_action": "leave", "time": "2024/03/09 07:20:00", "management_ip": "172.20.9.31", "user": "mira"},
        blank | {"module": "webui", "event_action": "logout", "time": "2024/03/09 07:30:00", "management_ip": "172.20.9.31", "user": "mira"},
    ]
    first, second, third = (r["data"] for r in accepted(export(spark, rows, "firewall_example")))
    assert (first["dst_ip"], first["dst_port"], first["login_account"]) == (DEVICE["management_ip"], DEVICE["cli_port"], "keeper")
    assert (second["action"], second["object"], second["subject"]) == ("离开", "172.20.9.31_mira", "172.20.9.31")
    assert (third["action"], third["dst_port"], third["object"]) == ("退出", DEVICE["web_port"], "172.20.9.31_mira")


def test_enrich_keeps_and_fills(spark):
    given = {"time": "2024/03/09 07:10:00", "device_name": "edge-fw7", "module": "webui", "user": "mira"}
    empty = dict.fromkeys(("event_type", "event_action", "management_ip", "src_addr", "dst_addr"), "")
    assets = keyed(frame(spark, [ASSET | {"pos": "0"}]), "src_ip", "pos")
    devices = keyed(frame(spark, [DEVICE | {"pos": "0"}]), "device_name", "pos", True)
    found = events.enrich(params(spark, [given | empty], "firewallexample/gate"), assets, devices).first()
    assert (found["user"], found["event_type"]) == ("mira", "admin_session")
    assert (found["dst_addr"], found["dst_port"]) == (DEVICE["management_ip"], DEVICE["web_port"])


def test_rule_state_equals_a_loop(spark):
    random.seed(5)
    rows = []
    for n in range(600):
        time = None if random.random() < 0.1 else random.randrange(20_000)
        rows.append((
            n, random.choice(["hot"] * 6 + ["a", "b"]), time, random.random() < 0.15,
            random.choice([None, None, f"p{n}"]), random.choice([None, f"s{n}"]), random.choice([None, f"d{n}"]),
        ))
    df = spark.createDataFrame(rows, "row long, key string, sec long, reset boolean, own_p string, own_s string, def_s string")
    df = df.withColumn("time", F.timestamp_seconds("sec")).withColumn("untimed", F.col("sec").isNull())
    df = df.withColumn("block", time_block(F.col("time"), F.col("row"), 900, 7))
    done = carry_forward(
        df, "key", "block", ["untimed", "time", "row"], F.col("reset"),
        {"p": (F.col("own_p"), None), "s": (F.col("own_s"), F.col("def_s"))},
    )
    got = {r["row"]: (r["p"], r["s"]) for r in done.collect()}
    state, want = {}, {}
    for n, key, time, reset, own_p, own_s, def_s in sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[0])):
        before = state.get(key, (None, None))
        now = (own_p or before[0], own_s or before[1] or def_s)
        want[n] = now
        state[key] = (None, None) if reset else now
    assert got == want


def test_reconcile_by_time(spark):
    names = ("event_type", "event_action", "user", "management_ip", "dst_addr")
    times = ["2024/03/09 07:30:00", "2024/03/09 07:10:00", "2024/03/09 07:20:00"]
    rows = frame(spark, [dict.fromkeys(names, "") | {"time": t, "pos": str(i)} for i, t in enumerate(times)])
    logins = [{"src_ip": f"172.20.9.{i}", "dst_ip": "172.20.4.2", "login_account": f"u{i}", "login_time": t, "pos": str(i)} for i, t in enumerate(sorted(times))]
    made = frame(spark, logins).withColumn("pos", F.col("pos").cast("long")).withColumn("alarm_type", F.lit(3))
    found = reconcile.reconcile(rows.withColumn("pos", F.col("pos").cast("long")), made).orderBy("pos").collect()
    assert [(r["user"], r["management_ip"]) for r in found] == [("u2", "172.20.9.2"), ("u0", "172.20.9.0"), ("u1", "172.20.9.1")]


def test_contract_violations(spark):
    made = export(spark, [session(1, 6) | {"user": "", "src_mac": "zz", "dst_ip": "gateway"}], "gate", assets=(), devices=())
    row = made.built.first()
    assert row["errors"] == ["缺少必填字段: login_account"]
    assert row["warnings"] == ["src_mac 不是合法 MAC 地址", "dst_ip 不是标准 IP/CIDR，当前按防火墙地址对象保留"]


def test_state_and_rows_without_rule(spark):
    """Rows without a rule keep their own values; a limit on types changes nothing of the rows that stay."""
    rows = [
        policy(1, "r7"), policy(2, "r7", policy_type="", src_addr="", dst_addr=""), policy(3, "", policy_type="", src_addr="", src_ip="172.20.9.9"),
        session(3, 4), policy(5, "r7", event_action="del", dst_addr="172.22.8.9"), policy(6, "r7", policy_type="", src_addr=""),
    ]
    given = params(spark, rows, "gate")
    assets, devices = (keyed(frame(spark, [dict(r, pos="0")]), key, "pos", fold) for r, key, fold in ((ASSET, "src_ip", False), (DEVICE, "device_name", True)))
    whole = events.build_events(given, assets, devices)
    cells = {r["source_row"]: r["data"] for r in whole.filter("_type = 4").collect()}
    assert cells[3]["src_ip"] == "172.21.0.0/16" and cells[3]["dst_ip"] == "172.22.8.1"
    assert (cells[4]["src_ip"], cells[4]["dst_ip"]) == ("172.20.9.9", "172.22.8.1")
    assert (cells[6]["dst_ip"], cells[7]["src_ip"]) == ("172.22.8.9", "")
    only = events.build_events(given, assets, devices, types=[4])
    assert {r["source_row"]: r["data"] for r in only.collect()} == cells


def test_filters_do_not_repeat_the_payload(spark):
    """Payload and errors are made once, below the generators; no filter builds them again for each mention."""
    given = [params(spark, [policy(1, "r7"), session(2, 5), session(3, 4) | {"user": ""}], "gate")] + [
        keyed(frame(spark, [dict(r, pos="0")]), key, "pos", fold) for r, key, fold in ((ASSET, "src_ip", False), (DEVICE, "device_name", True))
    ]
    made = events.export(*given)
    for rows in (made.accepted, made.rejected):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        filters = [line for line in plan.splitlines() if line.strip(" +-:").startswith("Filter")]
        assert filters and not any("map(" in line or "map_from" in line for line in filters)
        assert plan.count("map(src_ip, ") <= 6
    assert events.report(made).schema.simpleString() == spark.createDataFrame([], events.REPORT_SCHEMA).schema.simpleString()


def test_only_shown_columns_are_stored(spark):
    assets, devices = (keyed(frame(spark, [dict(r, pos="0")]), key, "pos", fold) for r, key, fold in ((ASSET, "src_ip", False), (DEVICE, "device_name", True)))
    given = params(spark, [policy(1, "r7") | {"wide": "w"}], "gate")
    assert "wide" in events.build_events(given, assets, devices).columns
    assert "wide" not in events.export(given, assets, devices).built.columns
