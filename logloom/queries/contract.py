"""Queries on contract events, rule state, alarms and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.operators import alarms, events, reconcile
from logloom.operators.columns import FIREWALL
from logloom.operators.rule_state import carry_forward, time_block
from logloom.queries.base import Rendered, query, sql_strip, table
from logloom.queries.fields import FW_SQL, fw_rows
from logloom.sources.events import json_map
from logloom.sources.tables import keyed

ASSET_ROWS = Rendered(
    "customer",
    pos="c_custkey",
    src_ip="CASE WHEN c_custkey % 37 = 0 THEN ' ' ELSE concat('192.168.100.', c_custkey % 90) END",
    src_mac="CASE WHEN c_custkey % 7 = 0 THEN concat('bad', c_custkey) ELSE concat('02:00:00:00:00:', lpad(cast(c_custkey % 90 as string), 2, '0')) END",
    default_user="CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat('owner', c_custkey) END",
)
DEVICE_ROWS = Rendered(
    "nation",
    pos="n_nationkey",
    device_name="CASE WHEN n_nationkey = 3 THEN 'THEMIS' ELSE n_name END",
    management_ip="CASE WHEN n_nationkey % 6 = 5 THEN '' ELSE concat('10.200.0.', n_nationkey) END",
    device_type="CASE WHEN n_nationkey % 4 = 1 THEN '' ELSE concat('type', n_regionkey) END",
    protocol="CASE WHEN n_regionkey = 1 THEN 'udp' ELSE '' END",
    web_port="CASE WHEN n_regionkey = 2 THEN '8443' ELSE '' END",
    cli_port="CASE WHEN n_regionkey = 3 THEN '2222' ELSE '' END",
    terminal_port="CASE WHEN n_regionkey = 4 THEN '23' ELSE '' END",
    default_user="CASE WHEN n_nationkey % 2 = 0 THEN concat('dev', n_nationkey) ELSE '' END",
)
STRICT_ROWS = Rendered(
    "orders",
    source="concat('audit/dev', o_custkey % 3)",
    source_row="o_orderkey",
    alarm_type="CASE o_orderkey % 13 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '3' WHEN 3 THEN '4' WHEN 4 THEN 'x' WHEN 5 THEN '09' ELSE '' END",
    time="CASE WHEN o_orderkey % 19 = 0 THEN 'soon' ELSE concat({day}, ' ', lpad(cast(o_orderkey % 24 as string), 2, '0'), ':00:00') END",
    device_name="concat('nation_', o_custkey % 30)",
    module="CASE o_orderkey % 5 WHEN 0 THEN 'CLI' WHEN 1 THEN 'terminal' WHEN 2 THEN 'webui' WHEN 3 THEN 'policy' ELSE '' END",
    event_type="CASE o_orderkey % 3 WHEN 0 THEN 'policy_rule' WHEN 1 THEN 'Admin_Session' ELSE 'blacklist' END",
    event_action="CASE o_custkey % 5 WHEN 0 THEN 'login' WHEN 1 THEN 'ADD' WHEN 2 THEN 'del' WHEN 3 THEN 'move' ELSE '' END",
    user="CASE WHEN o_orderkey % 8 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN 'root' ELSE concat('u', o_custkey) END",
    src_ip="CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN concat('192.168.100.', 10 + o_custkey % 2) ELSE concat('192.168.100.', o_custkey % 120) END",
    dst_ip="CASE WHEN o_custkey % 3 = 0 THEN '192.168.100.80' ELSE '' END",
    management_ip="CASE WHEN o_orderkey % 2 = 0 THEN '10.1.1.1' ELSE '' END",
    src_mac="CASE WHEN o_orderkey % 3 = 0 THEN '02-AA-00-00-00-01' ELSE '' END",
    rule_id="CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE cast(o_custkey % 21 as string) END",
    policy_type="CASE o_orderkey % 6 WHEN 0 THEN 'deny' WHEN 1 THEN 'permit_nat' WHEN 2 THEN 'odd' ELSE '' END",
    policy="CASE WHEN o_orderkey % 23 = 0 THEN '代理' WHEN o_orderkey % 23 = 1 THEN 'pass' ELSE '' END",
    src_addr="CASE WHEN o_orderkey % 5 = 1 THEN 'any' ELSE '' END",
    dst_addr="CASE o_orderkey % 7 WHEN 1 THEN 'any' WHEN 2 THEN 'fe80::1' WHEN 3 THEN 'web servers' ELSE '' END",
    protocol="CASE WHEN o_orderkey % 4 = 1 THEN 'IP协议ICMP' ELSE '' END",
)

# Equivalent SQL, from params rows p(source, source_row, <row fields>).
ACTION_SQL = "CASE {0} WHEN 'add' THEN '添加' WHEN 'set' THEN '修改' WHEN 'edit' THEN '修改' WHEN 'modify' THEN '修改' WHEN 'del' THEN '删除' WHEN 'delete' THEN '删除' WHEN 'show' THEN '显示' WHEN 'clear' THEN '清空' WHEN 'startup' THEN '恢复' WHEN 'bulk_load' THEN '批量加载' WHEN 'login' THEN '登录' WHEN 'logout' THEN '退出' WHEN 'leave' THEN '离开' END"
FIELDS = [
    "control_device_type", "control_name", "control_ip", "action", "policy", "src_ip", "dst_ip", "login_account",
    "login_time", "subject", "object", "time", "src_mac", "dst_port", "protocol",
]


def first(*values: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(trim({v}), '')" for v in values) + ", '')"


def keyed_sql(rows: str, key: str) -> str:
    return f"SELECT arg_max(t, pos) AS t, k FROM (SELECT t, pos, trim({key}) AS k FROM ({rows}) t) WHERE k <> '' GROUP BY k"


def built_sql(params: str, known: list[str], permissive: str) -> str:
    cells = ", ".join(f'trim("{c}") AS "{c}"' if c in known else f"'' AS \"{c}\"" for c in events.ROW_FIELDS)
    e, m, a, x = "lower(event_type)", "lower(module)", "lower(event_action)", "alarm_type"
    known_type = f"{x} IN ('1', '2', '3', '4')"
    actions = "('add', 'set', 'edit', 'modify', 'del', 'delete', 'show', 'clear', 'startup', 'bulk_load', 'login', 'logout', 'leave')"
    typ = f"""CASE WHEN pm AND ({e} = 'admin_session' OR {m} IN ('webui', 'cli')) THEN 3 WHEN pm AND {m} = 'terminal' THEN 1
        WHEN pm AND ({e} IN ('traffic', 'flow', 'flow_log', 'network_flow') OR {m} IN ('traffic', 'flow')) THEN 2
        WHEN {known_type} THEN cast({x} AS INT) WHEN pm THEN 4 WHEN {x} <> '' THEN NULL
        WHEN {e} = 'policy_rule' AND {a} IN {actions} THEN 4 WHEN {e} = 'policy_rule' THEN NULL
        WHEN {e} = 'admin_session' AND {a} = 'login' AND {m} IN ('webui', 'cli') THEN 3
        WHEN {e} = 'admin_session' AND {a} = 'login' AND {m} = 'terminal' THEN 1 END"""
    reason = f"""CASE WHEN {typ} IS NOT NULL THEN NULL WHEN {x} = 'x' THEN 'alarm_type 不是整数: x' WHEN {x} <> '' THEN '不支持的 alarm_type: ' || cast(cast({x} AS INT) AS VARCHAR)
        WHEN {e} = 'policy_rule' THEN '策略动作不属于添加/修改/删除: ' || {first(a, "'空'")}
        WHEN {e} = 'admin_session' AND {a} <> 'login' THEN '客户协议只接收登录事件，当前动作: ' || {first(a, "'空'")}
        WHEN {e} = 'admin_session' THEN '无法确定登录事件 alarm_type，module=' || {first(m, "'空'")} ELSE '客户协议未定义事件类型: ' || {first(e, "'空'")} END"""
    dip = "CASE WHEN lower(module) = 'terminal' THEN '192.168.100.10' ELSE '192.168.100.50' END"
    lenient = "CASE WHEN pm THEN {} ELSE '' END"

    def dev(f: str) -> str:
        return f"CASE WHEN de.k IS NOT NULL THEN coalesce(de.t.{f}, '') WHEN pm THEN coalesce(dd.t.{f}, '') ELSE '' END"

    src = first("src_ip", "management_ip", lenient.format(dip))
    name = first("control_name", "device_name", lenient.format("coalesce(dd.t.device_name, '')"))
    order = "t IS NULL, t, source_row"
    return f"""p AS (SELECT source, source_row, {cells}, {permissive} AS pm FROM ({params})),
    a AS ({keyed_sql(ASSET_ROWS.sql, 'src_ip')}), d AS ({keyed_sql(DEVICE_ROWS.sql, 'lower(device_name)')}),
    c AS (SELECT *, {typ} AS typ, {reason} AS reason, coalesce(try_strptime(time, '%Y/%m/%d %H:%M:%S'), try_strptime(time, '%Y-%m-%d %H:%M:%S')) AS t FROM p),
    j AS (SELECT c.*, {name} AS dev_name, {src} AS sip, {dev('management_ip')} AS mip, {dev('device_type')} AS dtype, {dev('protocol')} AS dproto,
        {dev('web_port')} AS wport, {dev('cli_port')} AS cport, {dev('terminal_port')} AS tport,
        {first('login_account', '"user"', "coalesce(a1.t.default_user, '')", lenient.format("coalesce(a2.t.default_user, '')"), dev('default_user'))} AS account,
        {first('src_mac', 'srp_mac', "coalesce(a1.t.src_mac, '')", lenient.format("coalesce(a2.t.src_mac, '')"))} AS mac,
        {first('login_time', 'time')} AS ltime, {first('rule_id', 'rule_key')} AS rk
        FROM c LEFT JOIN d dd ON dd.k = 'themis' LEFT JOIN d de ON de.k = lower({name})
        LEFT JOIN a a1 ON a1.k = {src} LEFT JOIN a a2 ON a2.k = {dip}),
    s AS (SELECT *, typ = 4 AND rk <> '' AS keyed, CASE WHEN typ = 4 AND rk <> '' THEN concat_ws('|', source, lower(dev_name), rk) ELSE concat_ws('#', source, source_row) END AS sk,
        nullif(policy_type, '') AS op, nullif({first('src_addr', 'src_ip')}, '') AS os, nullif({first('dst_addr', 'dst_ip')}, '') AS od,
        nullif({lenient.format(dip)}, '') AS ds, nullif({lenient.format('mip')}, '') AS ddst FROM j),
    g AS (SELECT *, coalesce(sum(CASE WHEN coalesce(keyed, false) AND lower(event_action) = 'del' THEN 1 ELSE 0 END) OVER (PARTITION BY sk ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM s),
    w AS (SELECT *, last_value(op IGNORE NULLS) OVER z AS ep, coalesce(last_value(os IGNORE NULLS) OVER z, first_value(ds IGNORE NULLS) OVER z) AS es,
        coalesce(last_value(od IGNORE NULLS) OVER z, first_value(ddst IGNORE NULLS) OVER z) AS ed FROM g
        WINDOW z AS (PARTITION BY sk, seg ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    x AS (SELECT source, source_row, typ, reason, coalesce(keyed, false) AS keyed, event_type AS et, event_action AS ea, module AS mo, t,
        CASE WHEN typ = 4 THEN {first('control_device_type', 'dtype')} END AS control_device_type,
        CASE WHEN typ = 4 THEN dev_name END AS control_name, CASE WHEN typ = 4 THEN {first('control_ip', 'mip')} END AS control_ip,
        CASE WHEN typ = 4 THEN coalesce({ACTION_SQL.format('lower(event_action)')}, nullif(lower(event_action), ''), '修改')
             WHEN typ = 3 THEN coalesce({ACTION_SQL.format('lower(' + first('event_action', '"action"') + ')')}, nullif({first('event_action', '"action"')}, ''), '登录') END AS "action",
        CASE WHEN typ = 4 THEN CASE WHEN {first('policy', 'pcpolicy')} IN ('允许', '禁止', '代理') THEN {first('policy', 'pcpolicy')} ELSE
            CASE ep WHEN 'permit' THEN '允许' WHEN 'permit_nat' THEN '允许' WHEN 'deny' THEN '禁止' WHEN 'proxy' THEN '代理' ELSE '允许' END END END AS policy,
        CASE WHEN typ = 4 THEN coalesce(es, '') WHEN typ < 4 THEN sip END AS src_ip,
        CASE WHEN typ = 4 THEN coalesce(ed, '') WHEN typ < 4 THEN {first('dst_ip', 'mip')} END AS dst_ip,
        CASE WHEN typ IS NOT NULL THEN account END AS login_account, CASE WHEN typ IS NOT NULL THEN ltime END AS login_time,
        CASE WHEN typ = 4 THEN concat_ws('_', nullif({first('control_ip', 'mip')}, ''), nullif(account, '')) WHEN typ = 3 THEN sip END AS subject,
        CASE WHEN typ = 4 THEN {first('control_ip', 'mip')} WHEN typ = 3 THEN concat_ws('_', nullif(sip, ''), nullif(account, '')) END AS object,
        CASE WHEN typ IN (3, 4) THEN ltime END AS time, CASE WHEN typ < 4 THEN mac END AS src_mac,
        CASE WHEN typ < 4 THEN {first('dst_port', "CASE WHEN typ = 2 OR lower(module) = 'webui' THEN " + first('wport', "'443'") + " ELSE " + first('cport', 'tport', "'22'") + " END")} END AS dst_port,
        CASE WHEN typ = 2 THEN CASE WHEN {first('protocol', 'dproto', "'TCP'")} LIKE 'IP协议%' THEN {first('protocol', 'dproto', "'TCP'")} ELSE 'IP协议' || upper({first('protocol', 'dproto', "'TCP'")}) END END AS protocol
        FROM w),
    v AS (SELECT *, {missing_sql()} AS missing, {warning_sql()} AS warnings FROM x)"""


def missing_sql() -> str:
    parts = []
    for number, names in events.CONTRACT.items():
        listed = ", ".join(f"CASE WHEN coalesce(trim(\"{n}\"), '') = '' THEN '{n}' END" for n in names)
        parts.append(f"WHEN typ = {number} THEN concat_ws(', ', {listed})")
    return f"CASE {' '.join(parts)} ELSE '' END"


def warning_sql() -> str:
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    good = f"^(any|({octet}\\.){{3}}{octet}(/([0-9]|[12][0-9]|3[0-2]))?|fe80::1)$"

    def odd(c: str) -> str:
        return f"CASE WHEN coalesce({c}, '') <> '' AND NOT regexp_matches(lower({c}), '{good}') THEN '{c} 不是标准 IP/CIDR，当前按防火墙地址对象保留' END"

    order = [
        "CASE WHEN typ = 4 AND NOT keyed THEN '策略日志没有 rule_id/rule_key，无法进行修改和删除状态关联' END",
        "CASE WHEN coalesce(src_mac, '') <> '' AND NOT regexp_matches(src_mac, '^([0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$') THEN 'src_mac 不是合法 MAC 地址' END",
        odd("control_ip"), odd("src_ip"), odd("dst_ip"),
        "CASE WHEN coalesce(login_time, '') <> '' AND NOT regexp_matches(login_time, '^[0-9]{4}/[0-9]+/[0-9]+ [0-9]+:[0-9]+:[0-9]+$') THEN 'login_time 无法按支持的时间格式解析' END",
    ]
    return f"concat_ws('; ', {', '.join(order)})"


FIREWALL_BUILT = built_sql(FW_SQL, FIREWALL, "true")
STRICT_BUILT = built_sql(STRICT_ROWS.sql, list(STRICT_ROWS.columns), "false")
FLAT = ", ".join(f"coalesce(\"{f}\", '') AS \"{f}\"" for f in FIELDS)


def assets(spark, sf):
    return keyed(ASSET_ROWS.frame(spark, sf), "src_ip", "pos")


def devices(spark, sf):
    return keyed(DEVICE_ROWS.frame(spark, sf), "device_name", "pos", casefold=True)


def firewall_events(spark, sf, types=None):
    return events.export(fw_rows(spark, sf), assets(spark, sf), devices(spark, sf), types=types)


def strict_events(spark, sf):
    return events.export(STRICT_ROWS.frame(spark, sf), assets(spark, sf), devices(spark, sf))


def flat(accepted):
    return accepted.select(
        "source", "source_row", "alarm_type",
        *[F.coalesce(F.try_element_at("data", F.lit(f)), F.lit("")).alias(f) for f in FIELDS],
        F.array_join("warnings", "; ").alias("warnings"),
    )


def accepted_sql(built: str) -> str:
    return f"WITH {built} SELECT source, source_row, typ AS alarm_type, {FLAT}, warnings FROM v WHERE typ IS NOT NULL AND missing = ''"


def rejected_sql(built: str) -> str:
    return f"""WITH {built} SELECT source, source_row, coalesce(reason, '缺少必填字段: ' || missing) AS reason, et AS event_type, ea AS event_action, mo AS module,
        typ AS candidate_type FROM v WHERE typ IS NULL OR missing <> ''"""


def rejected(built):
    return built.rejected.select(
        "source", "source_row", "reason", "event_type", "event_action", "module",
        F.col("candidate_event.alarm_type").alias("candidate_type"),
    )


def report_sql(built: str) -> str:
    return f"""WITH {built} SELECT source, count(*) AS input_rows, count(*) FILTER (WHERE good) AS event_count, count(*) FILTER (WHERE NOT good) AS rejected_count,
        cast(sum(CASE WHEN good AND warnings <> '' THEN len(string_split(warnings, '; ')) ELSE 0 END) AS BIGINT) AS warning_count,
        count(*) FILTER (WHERE good AND typ = 1) AS type_1, count(*) FILTER (WHERE good AND typ = 2) AS type_2, count(*) FILTER (WHERE good AND typ = 3) AS type_3,
        count(*) FILTER (WHERE good AND typ = 4) AS type_4, count(*) FILTER (WHERE NOT good) = 0 AS ok
        FROM (SELECT *, typ IS NOT NULL AND missing = '' AS good FROM v) GROUP BY source"""


@query("fw_events", accepted_sql(FIREWALL_BUILT))
def fw_events(spark, sf):
    return flat(firewall_events(spark, sf).accepted)


@query("fw_rejected", rejected_sql(FIREWALL_BUILT))
def fw_rejected(spark, sf):
    return rejected(firewall_events(spark, sf))


@query("fw_report", report_sql(FIREWALL_BUILT))
def fw_report(spark, sf):
    return events.report(firewall_events(spark, sf))


@query("strict_events", accepted_sql(STRICT_BUILT))
def strict_accepted(spark, sf):
    return flat(strict_events(spark, sf).accepted)


@query("strict_rejected", rejected_sql(STRICT_BUILT))
def strict_rejected(spark, sf):
    return rejected(strict_events(spark, sf))


@query("strict_report", report_sql(STRICT_BUILT))
def strict_report(spark, sf):
    return events.report(strict_events(spark, sf))


REVERSED = "CASE {0} WHEN '添加' THEN 'add' WHEN '修改' THEN 'set' WHEN '删除' THEN 'del' WHEN '显示' THEN 'show' WHEN '登录' THEN 'login' WHEN '退出' THEN 'logout' ELSE {0} END"


@query(
    "fw_enriched",
    f"""WITH {STRICT_BUILT}, r AS ({STRICT_ROWS.sql})
    SELECT source, source_row, CASE WHEN trim(r.time) <> '' THEN r.time ELSE coalesce(v.time, v.login_time, '') END AS time,
        {first("r.user", "coalesce(v.login_account, '')")} AS "user",
        CASE WHEN trim(r.event_action) <> '' THEN r.event_action WHEN typ < 4 THEN 'login' WHEN typ = 4 THEN {REVERSED.format('v.action')} ELSE '' END AS event_action,
        {first("r.management_ip", "CASE WHEN typ < 4 THEN coalesce(v.src_ip, '') ELSE '' END")} AS management_ip,
        {first("r.src_ip", "coalesce(v.src_ip, '')")} AS src_ip, {first("r.src_addr", "CASE WHEN typ = 4 THEN coalesce(v.src_ip, '') ELSE '' END")} AS src_addr,
        {first("r.dst_addr", "CASE WHEN typ IS NOT NULL THEN coalesce(v.dst_ip, '') ELSE '' END")} AS dst_addr, {first("r.dst_ip", "coalesce(v.dst_ip, '')")} AS dst_ip,
        {first("r.policy", "coalesce(v.policy, '')")} AS policy,
        {first("r.policy_type", "CASE WHEN typ = 4 THEN CASE v.policy WHEN '允许' THEN 'permit' WHEN '禁止' THEN 'deny' ELSE 'proxy' END ELSE '' END")} AS policy_type,
        CASE WHEN typ < 4 THEN coalesce(v.protocol, r.protocol) ELSE '' END AS service_from, coalesce(v.control_ip, '') AS control_ip
    FROM r JOIN v USING (source, source_row)""".replace(
        "CASE WHEN typ < 4 THEN coalesce(v.protocol, r.protocol) ELSE '' END AS service_from", "coalesce(v.protocol, '') AS service"
    ),
)
def fw_enriched(spark, sf):
    """Strict rows with blanks filled from their payload."""
    rows = events.enrich(STRICT_ROWS.frame(spark, sf), assets(spark, sf), devices(spark, sf))
    return rows.select(
        "source", "source_row", "time", "user", "event_action", "management_ip", "src_ip", "src_addr", "dst_addr", "dst_ip",
        "policy", "policy_type", "service", "control_ip",
    )


@query(
    "contract_from_examples",
    """SELECT cast(1 + event_id % 4 AS INT) AS alarm_type, field, min(event_id * 10 + p) AS first_seen FROM (
        SELECT event_id, unnest(['src_ip', CASE WHEN event_id % 9 = 0 THEN 'k' || (user_id % 3) ELSE 'dst_ip' END, 'login_time']) AS field, unnest([0, 1, 2]) AS p FROM events)
    GROUP BY ALL""",
)
def contract_from_examples(spark, sf):
    """Fields per alarm type in first-seen order, numbered by where they were seen."""
    rows = table(spark, sf, "events").selectExpr(
        "event_id", "cast(1 + event_id % 4 AS int) AS alarm_type",
        "map('src_ip', 'a', CASE WHEN event_id % 9 = 0 THEN concat('k', user_id % 3) ELSE 'dst_ip' END, 'b', 'login_time', 'c') AS data",
    )
    order = events.contract_of(rows, "event_id").select("alarm_type", F.posexplode("required").alias("place", "field"))
    seen = rows.select("alarm_type", "event_id", F.posexplode(F.map_keys("data")).alias("p", "field"))
    at = seen.groupBy("alarm_type", "field").agg(F.min(F.col("event_id") * 10 + F.col("p")).alias("first_seen"))
    return order.join(at, ["alarm_type", "field"]).select("alarm_type", "field", "first_seen")


STATE_ROWS = Rendered(
    "events",
    row_id="event_id",
    state_key="concat('r', user_id % 9)",
    ts="ts",
    reset="event_type = 'error'",
    own_policy_type="CASE WHEN event_type IN ('view', 'click') THEN concat(event_type, event_id % 10) END",
    own_src="CASE WHEN event_id % 4 = 0 THEN concat('s', event_id) END",
    own_dst="CASE WHEN event_id % 6 = 5 THEN concat('d', event_id) END",
    default_src="CASE WHEN event_id % 3 = 0 THEN 'x' WHEN event_id % 3 = 1 THEN 'y' END",
    default_dst="concat('m', user_id % 4)",
)
STATE_SQL = f"""WITH r AS ({STATE_ROWS.sql}), g AS (SELECT *, coalesce(sum(CASE WHEN reset THEN 1 ELSE 0 END) OVER (PARTITION BY state_key ORDER BY ts, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM r)
    SELECT state_key, row_id, last_value(own_policy_type IGNORE NULLS) OVER z AS policy_type, coalesce(last_value(own_src IGNORE NULLS) OVER z, first_value(default_src IGNORE NULLS) OVER z) AS src,
        coalesce(last_value(own_dst IGNORE NULLS) OVER z, first_value(default_dst IGNORE NULLS) OVER z) AS dst FROM g
    WINDOW z AS (PARTITION BY state_key, seg ORDER BY ts, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


@query("rule_state", STATE_SQL)
def rule_state(spark, sf):
    """State of nine busy keys, worked on in blocks of six hours."""
    rows = STATE_ROWS.frame(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withColumn("block", time_block(F.col("ts"), F.col("row_id"), 6 * 3600))
    none = {"policy_type": (F.col("own_policy_type"), None)}
    fields = none | {n: (F.col(f"own_{n}"), F.col(f"default_{n}")) for n in ("src", "dst")}
    done = carry_forward(rows, "state_key", "block", ["ts", "row_id"], F.col("reset"), fields)
    return done.select("state_key", "row_id", "policy_type", "src", "dst")


def owners(spark, sf):
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.expr("n_regionkey = r_regionkey"))
    return rows.selectExpr(
        "concat('10.200.0.', n_nationkey) AS ip", "n_name AS name", "concat('owner ', n_name) AS owner", "r_name AS department"
    )


OWNERS = "SELECT concat('10.200.0.', n_nationkey) AS ip, concat('owner ', n_name) AS owner, r_name AS department FROM nation JOIN region ON n_regionkey = r_regionkey"
OPEN_SQL = f"""SELECT source, source_row, control_ip, time, control_name, action, policy, login_account, coalesce(owner, '') AS control_owner, coalesce(department, '') AS control_owner_department
    FROM (SELECT source, source_row, control_ip, login_time AS time, control_name, action, policy, login_account FROM ({accepted_sql(FIREWALL_BUILT)}) WHERE alarm_type = 4 AND src_ip = 'any' AND dst_ip = 'any') e
    LEFT JOIN ({OWNERS}) o ON o.ip = e.control_ip"""
ALARM_CELLS = ["source", "source_row", "control_ip", "time", "control_name", "action", "policy", "login_account", "control_owner", "control_owner_department"]


def open_alarms(spark, sf):
    return alarms.open_policies(firewall_events(spark, sf, [4]).accepted, owners(spark, sf))


@query("alarm_open_policies", OPEN_SQL)
def alarm_open_policies(spark, sf):
    return open_alarms(spark, sf).select(*ALARM_CELLS)


LATEST_SQL = f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY control_ip ORDER BY time DESC, source_row) AS rn FROM ({OPEN_SQL})) WHERE rn = 1"


@query("alarm_latest", LATEST_SQL)
def alarm_latest(spark, sf):
    return alarms.latest_per_device(open_alarms(spark, sf)).select(*ALARM_CELLS)


@query(
    "terminal_logins",
    f"""SELECT source, source_row, CASE WHEN alarm_type = 1 THEN '{alarms.TERMINAL_ADMIN}' ELSE '{alarms.TERMINAL_OTHER}' END AS event_name, login_time AS time, src_ip AS involved_ip
    FROM ({accepted_sql(STRICT_BUILT)}) WHERE alarm_type < 4 AND (src_ip IN ('192.168.100.10', '192.168.100.11') OR src_mac IN ('00:e0:4c:fe:ad:10', '00:e0:4c:fe:ad:11'))
        AND dst_ip = '192.168.100.80' AND login_account = 'root'""",
)
def terminal_logins(spark, sf):
    """The optional rule over the strict events."""
    found = alarms.terminal_logins(strict_events(spark, sf).accepted, owners(spark, sf))
    return found.select("source", "source_row", "event_name", "time", "involved_ip")


DOC_CELLS = {
    "conv_id": "conv_id",
    "pos": "conv_id * 4294967296 + turn",
    "timestamp": "concat('2026-07-', lpad(cast(1 + conv_id % 28 as string), 2, '0'), 'T08:', lpad(cast(turn % 60 as string), 2, '0'), ':40.835', CASE WHEN conv_id % 2 = 0 THEN 'Z' ELSE '+08:00' END)",
    "log_type": "concat('type ', role)",
    "op_type": "concat('-op', turn % 3)",
    "subject": """CASE WHEN conv_id % 11 = 10 THEN 'broken {{' ELSE concat('{{"node_ip":"10.9.0.', conv_id % 200, '","user":"u', conv_id % 9, '","user_role":"', role, '","unit_name":"unit', conv_id % 3, '","department":"d"}}') END""",
    "app_info": """concat('{{"app_name":"OA', conv_id % 4, '","app_ip":"', CASE WHEN conv_id % 3 = 0 THEN '' ELSE '10.9.9.9' END, '"}}')""",
    "object": """CASE WHEN conv_id % 2 = 0 THEN '{{"object_security_level":"high"}}' ELSE '{{"objectSecurityLevel":"low"}}' END""",
    "details": "'[]'",
}
DOCS = Rendered("conversations", **DOC_CELLS)
DOC_SQL = f"""SELECT conv_id, pos, replace(substr("timestamp", 1, 19), 'T', ' ') AS time, json_extract_string(app_info, '$.app_name') AS involved_assets,
    CASE WHEN json_extract_string(app_info, '$.app_ip') <> '' THEN json_extract_string(app_info, '$.app_ip') ELSE coalesce(s ->> '$.node_ip', '') END AS involved_ip,
    coalesce(s ->> '$.user', '') AS "user", coalesce(s ->> '$.user_role', '') AS user_role, coalesce(s ->> '$.unit_name', '') AS unit_name,
    coalesce(json_extract_string(object, '$.object_security_level'), json_extract_string(object, '$.objectSecurityLevel'), '') AS secret_level, log_type, op_type
    FROM (SELECT *, CASE WHEN json_valid(subject) THEN subject::JSON END AS s FROM ({DOCS.sql}))"""


def app_events(spark, sf):
    docs = DOCS.frame(spark, sf)
    for column in ("subject", "app_info", "object", "details"):
        docs = docs.withColumn(column, json_map(F.col(column)))
    return alarms.application_events(docs, ["conv_id"])


@query("app_events", DOC_SQL)
def app_event_rows(spark, sf):
    rows = app_events(spark, sf)
    return rows.select("conv_id", "pos", "time", "involved_assets", "involved_ip", "user", "user_role", "unit_name", "secret_level", "log_type", "op_type")


def _app_sql(action: str, role: str = "user_role") -> str:
    return f"""WITH d AS ({DOC_SQL}), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS rn FROM d) WHERE rn = 1),
        m AS (SELECT conv_id, string_agg(user_role, '、' ORDER BY seen_at) AS roles FROM (SELECT conv_id, user_role, min(pos) AS seen_at FROM d WHERE user_role <> '' GROUP BY ALL) GROUP BY conv_id)
        SELECT conv_id, time, involved_assets, {role} AS user_role, {action} AS "action" FROM f LEFT JOIN m USING (conv_id)"""


@query("super_user", _app_sql("concat(involved_assets, '存在超级管理员', \"user\")"))
def super_user(spark, sf):
    return alarms.super_users(app_events(spark, sf), ["conv_id"]).select("conv_id", "time", "involved_assets", "user_role", "action")


@query("many_roles", _app_sql("concat(\"user\", '存在多个角色, 分别为: ', coalesce(roles, user_role))", "coalesce(roles, user_role)"))
def many_roles(spark, sf):
    return alarms.many_roles(app_events(spark, sf), ["conv_id"]).select("conv_id", "time", "involved_assets", "user_role", "action")


@query("abnormal_action", _app_sql("concat(user_role, '--', log_type, op_type)"))
def abnormal_action(spark, sf):
    return alarms.odd_actions(app_events(spark, sf), ["conv_id"]).select("conv_id", "time", "involved_assets", "user_role", "action")


def listed(spark, sf):
    found = app_events(spark, sf)
    app = alarms.super_users(found, ["conv_id"]).unionByName(alarms.odd_actions(found, ["conv_id"]))
    return alarms.alarm_list(alarms.latest_per_device(open_alarms(spark, sf)), app)


ALARM_LIST = f"""SELECT 0 AS branch, time, control_ip, "action", cast(NULL AS BIGINT) AS conv_id FROM ({LATEST_SQL})
    UNION ALL SELECT 1, a.time, d.involved_ip, a."action", a.conv_id FROM ({_app_sql("concat(involved_assets, '存在超级管理员', \"user\")")}) a JOIN (SELECT conv_id, arg_min(involved_ip, pos) AS involved_ip FROM ({DOC_SQL}) GROUP BY conv_id) d USING (conv_id)
    UNION ALL SELECT 1, a.time, d.involved_ip, a."action", a.conv_id FROM ({_app_sql("concat(user_role, '--', log_type, op_type)")}) a JOIN (SELECT conv_id, arg_min(involved_ip, pos) AS involved_ip FROM ({DOC_SQL}) GROUP BY conv_id) d USING (conv_id)"""


@query("alarm_page", f"SELECT branch, time, control_ip, \"action\" FROM ({ALARM_LIST}) ORDER BY branch, time DESC, control_ip, \"action\", conv_id LIMIT 10 OFFSET 10")
def alarm_page(spark, sf):
    """Second page of the alarm list: firewall alarms first, each part by time descending."""
    order = [F.col("branch"), F.desc("time"), F.col("control_ip"), F.col("action"), F.col("conv_id")]
    return alarms.page(listed(spark, sf), 2, 10, order)[0].select("branch", "time", "control_ip", "action")


@query("alarm_total", f"SELECT count(*) AS total FROM ({ALARM_LIST})")
def alarm_total(spark, sf):
    return alarms.page(listed(spark, sf), 1, 10, [F.col("time")])[1]


MATCH_ROWS = Rendered(
    "events",
    pos="event_id",
    time="CASE WHEN event_id % 31 = 0 THEN '' ELSE {hour} END",
    device_name="concat('Dev', user_id % 2)",
    user="CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('U', user_id % 4) END",
    management_ip="CASE WHEN event_id % 2 = 0 THEN '' ELSE concat('10.0.0.', user_id % 3) END",
    dst_addr="concat('10.1.0.', event_id % 3)",
    event_type="CASE WHEN event_id % 5 = 0 THEN event_type ELSE '' END",
    event_action="CASE WHEN event_id % 6 = 0 THEN 'leave' ELSE '' END",
    policy_type="''",
)
MATCH_EVENTS = Rendered(
    "events",
    pos="event_id",
    alarm_type="cast(3 + event_id % 2 AS int)",
    login_time="CASE WHEN event_id % 29 = 0 THEN '' ELSE {hour} END",
    control_name="concat('dev', event_id % 2)",
    login_account="CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('u', event_id % 5) END",
    src_ip="CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('10.0.0.', event_id % 4) END",
    control_ip="concat('10.3.0.', event_id % 4)",
    dst_ip="CASE WHEN event_id % 3 = 1 THEN '' ELSE concat('10.1.0.', event_id % 4) END",
    action="CASE WHEN event_id % 2 = 0 THEN '添加' ELSE 'odd' END",
    policy="CASE WHEN event_id % 2 = 0 THEN '禁止' ELSE '' END",
)


def _match_sql() -> str:
    def key(*parts: str) -> str:
        cells = [f"lower({sql_strip(p)})" for p in parts]
        return f"CASE WHEN {' || '.join(cells)} = '' THEN NULL ELSE concat_ws(chr(1), {', '.join(cells)}) END"

    left = [key("time", "device_name", '"user"'), key("time", '"user"'), key("time", "management_ip"), key("time", "dst_addr"), key("time")]
    right = [
        key("login_time", "control_name", "login_account"), key("login_time", "login_account"),
        key("login_time", first("src_ip", "control_ip")), key("login_time", first("dst_ip", "control_ip")), key("login_time"),
    ]
    cells = ", ".join(f"{k} AS k{n}" for n, k in enumerate(left, 1))
    others = ", ".join(f"{k} AS k{n}" for n, k in enumerate(right, 1))
    steps = [f"l AS (SELECT pos AS r, {cells} FROM ({MATCH_ROWS.sql}))", f"e AS (SELECT pos AS v, {others} FROM ({MATCH_EVENTS.sql}))", "m0 AS (SELECT 0 AS r, 0 AS v, 0 AS level WHERE false)"]
    for n in range(1, 6):
        rank = f"row_number() OVER (PARTITION BY k{n} ORDER BY {{}}) AS i"
        steps.append(
            f"m{n} AS (SELECT * FROM m{n - 1} UNION ALL SELECT r, v, {n} FROM (SELECT r, k{n}, {rank.format('r')} FROM l WHERE k{n} IS NOT NULL AND r NOT IN (SELECT r FROM m{n - 1})) "
            f"JOIN (SELECT v, k{n}, {rank.format('v')} FROM e WHERE k{n} IS NOT NULL AND v NOT IN (SELECT v FROM m{n - 1})) USING (k{n}, i))"
        )
    steps.append("m AS (SELECT * FROM m5 UNION ALL SELECT r, v, 0 FROM l JOIN e ON r = v WHERE r NOT IN (SELECT r FROM m5) AND v NOT IN (SELECT v FROM m5))")
    return "WITH " + ", ".join(steps)


@query("reconcile_pairs", _match_sql() + " SELECT r AS row_pos, v AS event_pos, cast(level AS INT) AS level FROM m")
def reconcile_pairs(spark, sf):
    return reconcile.match(MATCH_ROWS.frame(spark, sf), MATCH_EVENTS.frame(spark, sf))


@query(
    "reconcile",
    _match_sql()
    + f""", a AS ({MATCH_ROWS.sql}), b AS ({MATCH_EVENTS.sql})
    SELECT a.pos, {first('a.time', "coalesce(b.login_time, '')")} AS time, {first('a."user"', "coalesce(b.login_account, '')")} AS "user",
        {first('a.event_type', "CASE b.alarm_type WHEN 3 THEN 'admin_session' WHEN 4 THEN 'policy_rule' ELSE '' END")} AS event_type,
        {first('a.event_action', "CASE b.alarm_type WHEN 3 THEN 'login' WHEN 4 THEN CASE b.action WHEN '添加' THEN 'add' ELSE b.action END ELSE '' END")} AS event_action,
        {first('a.management_ip', "coalesce(b.src_ip, '')", "coalesce(b.control_ip, '')")} AS management_ip,
        CASE coalesce(b.policy, '') WHEN '禁止' THEN 'deny' ELSE coalesce(b.policy, '') END AS policy_type, {first("coalesce(b.src_ip, '')")} AS src_addr
    FROM a LEFT JOIN m ON m.r = a.pos LEFT JOIN b ON b.pos = m.v""",
)
def reconcile_rows(spark, sf):
    rows = reconcile.reconcile(MATCH_ROWS.frame(spark, sf), MATCH_EVENTS.frame(spark, sf))
    return rows.select("pos", "time", "user", "event_type", "event_action", "management_ip", "policy_type", "src_addr")
