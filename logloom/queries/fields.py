"""Queries on field extraction, field semantics and resuming."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from logloom.functions.pairs import pairs
from logloom.operators import hooks
from logloom.operators.columns import AUDIT, AUTH, DNS, FIREWALL, VPN, WEB
from logloom.operators.params_firewall import firewall_params
from logloom.operators.params_host import audit_params, auth_params, vpn_params
from logloom.operators.params_web import access_params, dns_params, error_params, with_access_values
from logloom.queries.base import (
    AUDIT_LINES,
    AUTH_LINES,
    DNS_LINES,
    FIREWALL_LINES,
    VPN_LINES,
    WEB_ERRORS,
    WEB_LINES,
    query,
    table,
)
from logloom.sources import specs
from logloom.sources.tables import union_by_name


def cells(columns: list[str], found: dict[str, str]) -> str:
    return ", ".join(f'coalesce({found.get(c, chr(39) * 2)}, \'\') AS "{c}"' for c in columns)


def kv(key: str) -> str:
    """Value of a pair in a firewall line, without its quotes."""
    return f"trim(regexp_extract(body, '(?:^|\\s){key}=(\"[^\"]*\"|\\S*)', 1), '\"')"


BODY = "regexp_extract(content, '^(\\S+)\\s+([^:\\s]+):\\s+(.*)$', 3)"
FW_BASE = f"""SELECT *, regexp_extract(content, '^(\\S+)\\s+([^:\\s]+):', 1) AS host, regexp_extract(content, '^(\\S+)\\s+([^:\\s]+):', 2) AS program,
    CASE {kv('mod')} WHEN '策略' THEN 'policy' WHEN '黑名单' THEN 'blacklist' ELSE {kv('mod')} END AS m,
    CASE {kv('act')} WHEN '修改' THEN 'set' WHEN '退出' THEN 'logout' ELSE {kv('act')} END AS a,
    {kv('msg')} AS msg FROM (SELECT *, {BODY} AS body FROM ({FIREWALL_LINES.sql}))"""
FW_KIND = """CASE WHEN m IN ('webui', 'cli', 'terminal') THEN 'admin_session' WHEN m = 'policy' OR program = 'rule' THEN 'policy_rule'
    WHEN m = 'blacklist' THEN 'blacklist' ELSE m END"""
FW_CELLS = {
    "time": kv("date"), "device_name": kv("dname"), "module": "m", "event_type": FW_KIND, "event_action": "a",
    "user": kv("user"), "management_ip": kv("from"),
    "outcome": f"CASE WHEN {kv('result')} = '0' THEN 'success' WHEN {kv('result')} = '1' THEN 'failure' WHEN msg LIKE '%错误%' THEN 'failure' ELSE 'unknown' END",
    "src_addr": kv("sa"), "dst_addr": kv("da"), "policy_id": kv("policy"), "rule_id": kv("id"),
    "rule_key": f"""CASE WHEN {kv('policy')} = '' AND {kv('id')} = '' THEN '' ELSE concat_ws('|', {kv('dname')}, CASE WHEN {kv('policy')} <> '' THEN 'policy:' || {kv('policy')} END,
        CASE WHEN {kv('id')} <> '' THEN 'rule:' || {kv('id')} END) END""",
    "policy_type": f"CASE {kv('policy')} WHEN '50' THEN 'deny' WHEN '55' THEN 'permit' WHEN '59' THEN 'proxy' WHEN '62' THEN 'permit_nat' ELSE CASE WHEN msg LIKE '%permit%' THEN 'permit' ELSE '' END END",
    "rule_state": f"CASE {kv('active')} WHEN 'on' THEN 'enabled' ELSE 'disabled' END", "log_enabled": "'disabled'",
    "zone_name": "regexp_extract(msg, '安全域名称\\s+(\\S+)', 1)",
    "blacklist_ip": f"CASE WHEN {FW_KIND} = 'blacklist' THEN regexp_extract(msg, '(?:\\d{{1,3}}\\.){{3}}\\d{{1,3}}', 0) ELSE '' END",
    "src_ip": kv("from"), "dst_ip": kv("da"), "login_account": kv("user"), "login_time": kv("date"), "control_name": kv("dname"),
}
FW_SQL = f"SELECT source, line_id AS source_row, {cells(FIREWALL, FW_CELLS)} FROM ({FW_BASE})"


def fw_rows(spark, sf):
    lines = FIREWALL_LINES.frame(spark, sf).withColumnRenamed("line_id", "source_row")
    return firewall_params(lines, keep=["source", "source_row"])


@query("fw_params", FW_SQL)
def fw_params(spark, sf):
    return fw_rows(spark, sf)


KEYS = ["devid", "date", "dname", "mod", "act", "user", "from", "id", "policy", "sa", "da", "active", "log", "result", "msg"]


@query(
    "kv_extract",
    f"""SELECT source, line_id, unnest([{', '.join(f"'{k}'" for k in KEYS)}]) AS key, unnest([{', '.join(kv(k) for k in KEYS)}]) AS value
    FROM (SELECT *, {BODY} AS body FROM ({FIREWALL_LINES.sql}))""",
)
def kv_extract(spark, sf):
    return FIREWALL_LINES.frame(spark, sf).select("source", "line_id", F.explode(pairs(F.col("content"))).alias("key", "value"))


ACCESS = r'^(\S+)\s+(\S+)\s+(\S+)\s+"([^"]*)"\s+(\S+)\s+(\S+)\s+"([^"]*)"\s+"([^"]*)"$'


def acc(n: int) -> str:
    return f"regexp_extract(content, '{ACCESS}', {n})"


def dash(x: str) -> str:
    return f"CASE WHEN {x} = '-' THEN '' ELSE {x} END"


REQ = r"^(\S+)\s+(\S+)\s+(\S+)$"
WEB_CELLS = {
    "log": "content", "time": '"timestamp"', "log_source": "'web'", "host": "'www'", "program": "'apache2'",
    "event_type": f"CASE WHEN {acc(4)} = '-' AND {acc(5)} = '408' THEN 'request_timeout' ELSE 'http_request' END",
    "event_action": f"regexp_extract({acc(4)}, '{REQ}', 1)", "user": dash(acc(3)), "src_ip": acc(1),
    "object_name": f"split_part(regexp_extract({acc(4)}, '{REQ}', 2), '?', 1)",
    "status_code": acc(5),
    "outcome": f"CASE WHEN {acc(5)} = '' THEN '' WHEN cast({acc(5)} AS INT) BETWEEN 200 AND 399 THEN 'success' WHEN cast({acc(5)} AS INT) BETWEEN 400 AND 599 THEN 'failure' ELSE 'unknown' END",
    "referer": dash(acc(7)), "user_agent": dash(acc(8)), "http_version": f"regexp_extract({acc(4)}, '{REQ}', 3)", "bytes_sent": acc(6),
}
WEB_SQL = f"SELECT line_id, {cells(WEB, WEB_CELLS)} FROM ({WEB_LINES.sql})"


@query("web_params", WEB_SQL)
def web_params(spark, sf):
    return access_params(WEB_LINES.frame(spark, sf), "web", "www", "apache2", keep=["line_id"])


ERR = r"^\[([^:\]]+):([^\]]+)\] \[pid (\d+)\] \[client ([^\]]+)\] (.*)$"


def err(n: int) -> str:
    return f"regexp_extract(content, '{ERR}', {n})"


def shape(*patterns: tuple[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN kind = {n} THEN {x}" for n, x in patterns) + " ELSE '' END"


ERR_BASE = f"""SELECT *, CASE WHEN NOT ok THEN -1 WHEN message LIKE 'AH01630:%' THEN 0 WHEN message LIKE 'script %' THEN 1 WHEN message LIKE 'AH00687:%' THEN 2
    WHEN message LIKE 'AH01276:%' THEN 3 WHEN message LIKE 'PHP Fatal error: require()%' THEN 4 WHEN message LIKE 'PHP Warning: scandir()%' THEN 5 ELSE 6 END AS kind
    FROM (SELECT *, regexp_matches(content, '{ERR}') AS ok, split_part({err(5)}, ', referer: ', 1) AS message,
        CASE WHEN contains({err(5)}, ', referer: ') THEN split_part({err(5)}, ', referer: ', 2) ELSE '' END AS ref FROM ({WEB_ERRORS.sql}))"""
ERR_CELLS = {
    "log": "content", "time": '"timestamp"', "log_source": "'weberr'", "host": "'www'", "program": err(1), "pid": err(3),
    "event_type": shape((0, "'access_denied'"), (1, "'script_not_found'"), (2, "'negotiation_error'"), (3, "'directory_index_forbidden'"), (4, "'php_error'"), (5, "'php_error'")),
    "event_action": shape((0, "'denied'"), (1, "'not_found'"), (2, "'failed'"), (3, "'denied'"), (4, "'failed'"), (5, "'failed'")),
    "src_ip": f"split_part({err(4)}, ':', 1)", "src_port": f"split_part({err(4)}, ':', 2)",
    "object_name": shape(
        (0, "regexp_extract(message, 'configuration: (.+)$', 1)"), (1, "regexp_extract(message, 'script .(.+). not found', 1)"),
        (2, "regexp_extract(message, 'request: (.+) \\(None', 1)"), (3, "regexp_extract(message, 'directory (.+): No', 1)"),
        (4, "regexp_extract(message, 'required .(.*). \\(include', 1)"), (5, "regexp_extract(message, 'directory in (.+) on line', 1)"),
    ),
    "status_code": shape((0, "'403'"), (1, "'404'"), (2, "'406'"), (3, "'403'"), (4, "'500'")),
    "outcome": "CASE WHEN ok THEN 'failure' ELSE '' END", "referer": "ref", "severity": err(2),
    "error_code": shape((0, "'AH01630'"), (2, "'AH00687'"), (3, "'AH01276'"), (5, "regexp_extract(message, 'errno (\\d+)', 1)")),
}


@query("web_errors", f"SELECT line_id, {cells(WEB, ERR_CELLS)}, NOT ok AS quarantined FROM ({ERR_BASE})")
def web_errors(spark, sf):
    return error_params(WEB_ERRORS.frame(spark, sf), "weberr", "www", keep=["line_id"])


ANSWER = "regexp_extract(content, ' is (.*)$', 1)"
DNS_STATUS = f"""CASE WHEN verb = 'nameserver' THEN 'REFUSED' WHEN upper({ANSWER}) IN ('NXDOMAIN', 'REFUSED', 'SERVFAIL', 'FORMERR', 'NOTIMP') THEN upper({ANSWER})
    WHEN upper({ANSWER}) LIKE 'NODATA%' THEN {ANSWER} ELSE '' END"""
DNS_CELLS = {
    "log": "content", "time": '"timestamp"', "log_source": "'dns'", "program": "'dnsmasq'",
    "pid": "regexp_extract(content, '^dnsmasq.([0-9]+).:', 1)",
    "event_type": "CASE verb WHEN 'nameserver' THEN 'nameserver_error' ELSE verb END",
    "qname": "CASE WHEN verb = 'nameserver' THEN '' ELSE regexp_extract(content, '(n[0-9]*\\.example\\.org)', 1) END",
    "qtype": f"CASE verb WHEN 'query' THEN regexp_extract(content, 'query.([A-Z]+). ', 1) WHEN 'cached' THEN {ANSWER} ELSE '' END",
    "src_ip": "CASE WHEN verb = 'query' THEN regexp_extract(content, ' from (.*)$', 1) ELSE '' END",
    "dst_ip": "CASE verb WHEN 'forwarded' THEN regexp_extract(content, ' to (.*)$', 1) WHEN 'nameserver' THEN regexp_extract(content, 'nameserver (\\S+) ', 1) ELSE '' END",
    "answer_kind": f"CASE verb WHEN 'reply' THEN {ANSWER} ELSE '' END",
    "status_code": DNS_STATUS,
    "response_source": "CASE verb WHEN 'forwarded' THEN 'upstream' WHEN 'nameserver' THEN 'upstream' WHEN 'cached' THEN 'cache' ELSE '' END",
    "outcome": f"CASE WHEN {DNS_STATUS} <> '' THEN 'failure' WHEN verb IN ('reply', 'cached') AND {ANSWER} <> '' THEN 'success' ELSE '' END",
}


@query("dns_params", f"SELECT line_id, {cells(DNS, DNS_CELLS)} FROM (SELECT *, regexp_extract(content, ': ([a-z]+)', 1) AS verb FROM ({DNS_LINES.sql}))")
def dns(spark, sf):
    return dns_params(DNS_LINES.frame(spark, sf), keep=["line_id"])


def word(key: str) -> str:
    return f"trim(regexp_extract(body, '(?:^|\\s){key}=(\"[^\"]*\"|\\S*)', 1), '\"')"


def pick(*keys: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({word(k)}, '')" for k in keys) + ", '')"


AUDIT_TIME = "strftime(to_timestamp(cast(regexp_extract(\"timestamp\", 'audit.([0-9]+)', 1) AS BIGINT)), '%Y-%m-%d %H:%M:%S')"
AUDIT_CELLS = {
    "log": "content", "time": AUDIT_TIME, "log_source": "'audit'", "host": "'share'", "event_type": pick("type"), "event_id": "event_id",
    "user": pick("acct", "id"), "auid": pick("auid"), "uid": pick("uid"), "session_id": pick("ses"), "tty": pick("tty"), "terminal": pick("terminal"),
    "src_ip": pick("addr"), "src_hostname": pick("hostname"), "pid": pick("pid"), "ppid": pick("ppid"), "process_exe": pick("exe"),
    "process_name": pick("comm"), "process_title": pick("proctitle"), "command": pick("cmd"), "cwd": pick("cwd"), "syscall": pick("syscall"),
    "outcome": pick("res", "success"),
}


@query(
    "audit_params",
    f"SELECT line_id, {cells(AUDIT, AUDIT_CELLS)} FROM (SELECT *, replace(replace(content, 'msg=' || chr(39), ''), chr(39), '') AS body FROM ({AUDIT_LINES.sql}))",
)
def audit(spark, sf):
    return audit_params(AUDIT_LINES.frame(spark, sf), host="share", keep=["line_id"])


def rx(p: str, n: int = 1) -> str:
    return f"regexp_extract(content, '{p}', {n})"


def by(**values: str) -> str:
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " ELSE '' END"


AUTH_CELLS = {
    "log": "content", "time": '"timestamp"', "log_source": "'auth'", "host": "split_part(content, ' ', 1)",
    "program": rx("^\\S+ ([^:\\[]+)"), "pid": rx("^\\S+ [^:\\[]+\\[([0-9]+)"),
    "event_type": by(ssh="'ssh_login'", pam="'session'", sudo="'sudo'", new="'login_session'", su="'su'"),
    "event_action": by(ssh="'accepted'", pam="'opened'", sudo="'executed'", new="'created'", su="'switched'"),
    "user": by(ssh=rx("for (\\S+) from"), pam="'root'", new=rx("of user (u[0-9]+)")),
    "actor_user": by(pam=rx("by (u[0-9]+)"), su=rx("by (u[0-9]+)")),
    "invoker_user": by(sudo=rx("sudo: (\\S+) :")), "target_user": by(sudo="'root'", su="'root'"),
    "session_id": by(new=rx("session ([0-9]+) of")), "tty": by(sudo=rx("TTY=(\\S+)")), "cwd": by(sudo=rx("PWD=(\\S+)")),
    "command": by(sudo=rx("COMMAND=(.*)$")), "src_ip": by(ssh=rx("from (\\S+) port")), "src_port": by(ssh=rx("port ([0-9]+)")),
    "pam_service": by(pam="'su'"), "pam_action": by(pam="'session'"), "outcome": "'success'",
}


@query(
    "auth_params",
    f"""SELECT line_id, {cells(AUTH, AUTH_CELLS)} FROM (SELECT *, CASE WHEN content LIKE '%Accepted%' THEN 'ssh' WHEN content LIKE '%pam_unix%' THEN 'pam'
    WHEN content LIKE '%COMMAND%' THEN 'sudo' WHEN content LIKE '%New session%' THEN 'new' ELSE 'su' END AS kind FROM ({AUTH_LINES.sql}))""",
)
def auth(spark, sf):
    return auth_params(AUTH_LINES.frame(spark, sf), keep=["line_id"])


VPN_CELLS = {
    "log": "content", "time": '"timestamp"', "log_source": "'vpn'", "program": "'openvpn'",
    "event_type": by(peer="'peer_info'", verify="'verify'", learn="'multi_learn'", reset="'tls'", error="'tls_error'"),
    "event_action": by(peer="'reported'", verify="'certificate'", learn="'learned'", reset="'soft_reset'", error="'failed'"),
    "user": rx("^(u[0-9]+)/"), "src_ip": rx("([0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+)"), "src_port": rx(":([0-9]+) "),
    "virtual_ip": by(learn=rx("Learn: (\\S+)")), "peer_info_key": by(peer="'IV_VER'"), "peer_info_value": by(peer=rx("IV_VER=(.*)$")),
    "control_message": by(verify=rx("depth=1, (.*)$"), error=rx("TLS Error: (.*)$")),
    "bytes_in": by(reset=rx("bytes=([0-9]+)")), "bytes_out": by(reset="'-1'"), "pkts_in": by(reset=rx("pkts=([0-9]+)")), "pkts_out": by(reset="'0'"),
    "outcome": by(verify="'success'", error="'failure'"),
}


@query(
    "vpn_params",
    f"""SELECT line_id, {cells(VPN, VPN_CELLS)} FROM (SELECT *, CASE WHEN content LIKE '%peer info%' THEN 'peer' WHEN content LIKE '%VERIFY%' THEN 'verify'
    WHEN content LIKE '%Learn%' THEN 'learn' WHEN content LIKE '%soft reset%' THEN 'reset' ELSE 'error' END AS kind FROM ({VPN_LINES.sql}))""",
)
def vpn(spark, sf):
    return vpn_params(VPN_LINES.frame(spark, sf), keep=["line_id"])


@query(
    "wide_params",
    f"""SELECT line_id, log_source, event_type, coalesce(src_ip, '') AS src_ip, coalesce(qname, '') AS qname, coalesce(virtual_ip, '') AS virtual_ip FROM (
    SELECT * FROM (SELECT line_id, {cells(DNS, DNS_CELLS)} FROM (SELECT *, regexp_extract(content, ': ([a-z]+)', 1) AS verb FROM ({DNS_LINES.sql})))
    UNION ALL BY NAME SELECT * FROM (SELECT line_id, {cells(AUTH, AUTH_CELLS)} FROM (SELECT *, CASE WHEN content LIKE '%Accepted%' THEN 'ssh' WHEN content LIKE '%pam_unix%' THEN 'pam'
        WHEN content LIKE '%COMMAND%' THEN 'sudo' WHEN content LIKE '%New session%' THEN 'new' ELSE 'su' END AS kind FROM ({AUTH_LINES.sql})))
    UNION ALL BY NAME SELECT * FROM (SELECT line_id, {cells(VPN, VPN_CELLS)} FROM (SELECT *, CASE WHEN content LIKE '%peer info%' THEN 'peer' WHEN content LIKE '%VERIFY%' THEN 'verify'
        WHEN content LIKE '%Learn%' THEN 'learn' WHEN content LIKE '%soft reset%' THEN 'reset' ELSE 'error' END AS kind FROM ({VPN_LINES.sql}))))""",
)
def wide_params(spark, sf):
    """Params of three families in one wide table, columns in first-seen order."""
    merged = union_by_name([dns(spark, sf), auth(spark, sf), vpn(spark, sf)])
    return merged.select("line_id", "log_source", "event_type", "src_ip", "qname", "virtual_ip")


# Field semantics as JSON, one document per part: two templates with mapped and plain fields.
SPEC_TEXT = """concat('[[["src_ip->src_ip", "Client of ', p_brand, '", "10.0.0.', p_size, '"], ["http_method->event_action", "Verb"], ["uri", "Path", "/', p_name, '"], ["uri", "again"]], [["size_', p_size % 7, '->bytes_sent", "Size"], ["', lower(p_type), '", "kind"], [" "]]]')"""

SPEC_SQL = f"""SELECT p_partkey, spec_index, pos, CASE WHEN contains(name, '->') THEN split_part(name, '->', 1) ELSE name END AS source,
    CASE WHEN contains(name, '->') THEN split_part(name, '->', 2) ELSE name END AS output, contains(name, '->') AS mapped, definition, example FROM (
    SELECT p_partkey, 1 AS spec_index, unnest([0, 1, 2]) AS pos, unnest(['src_ip->src_ip', 'http_method->event_action', 'uri']) AS name,
        unnest(['Client of ' || p_brand, 'Verb', 'Path']) AS definition, unnest(['10.0.0.' || p_size, '', '/' || p_name]) AS example FROM part
    UNION ALL SELECT p_partkey, 2, unnest([0, 1]), unnest(['size_' || (p_size % 7) || '->bytes_sent', lower(p_type)]), unnest(['Size', 'kind']), unnest(['', '']) FROM part)"""


def part_specs(spark, sf):
    texts = table(spark, sf, "part").selectExpr("p_partkey", f"{SPEC_TEXT} AS specs")
    return specs.field_specs(texts, "specs", expected=2, keys=("p_partkey",))


@query("field_specs", SPEC_SQL)
def field_specs(spark, sf):
    return part_specs(spark, sf)


@query(
    "spec_columns",
    f"""SELECT output, mapped, count(*) AS "count" FROM ({SPEC_SQL}) GROUP BY ALL""",
)
def spec_columns(spark, sf):
    """Output columns of all specs, in the order of the dynamic column list."""
    found = part_specs(spark, sf)
    order = specs.dynamic_columns(found, [])
    counted = found.groupBy("output", "mapped").agg(F.count(F.lit(1)).alias("count"))
    return counted.filter(F.col("output").isin(order))


@query(
    "pairs_mapped",
    f"""SELECT spec_index, pos, s.source, CASE WHEN m.canonical IS NOT NULL AND pos > 0 THEN m.canonical ELSE output END AS output,
        mapped OR (m.canonical IS NOT NULL AND pos > 0) AS mapped
    FROM (SELECT p_partkey + 1 AS spec_index, unnest([0, 1, 2]) AS pos, unnest(['brand', 'kind', 'name']) AS source, unnest(['brand', 'kind', 'name']) AS output, false AS mapped FROM part) s
    LEFT JOIN (SELECT p_partkey + 1 AS spec_index, unnest(['brand', 'kind']) AS source, unnest(['maker', lower(p_type)]) AS canonical FROM part) m USING (spec_index, source)""",
)
def pairs_mapped(spark, sf):
    """Three fields per part, two of them with a canonical name; the first field stays."""
    parts = table(spark, sf, "part")
    rows = parts.selectExpr("p_partkey + 1 AS spec_index", "posexplode(array('brand', 'kind', 'name')) AS (pos, source)").selectExpr(
        "spec_index", "pos", "source", "source AS output", "false AS mapped", "'' AS definition", "'' AS example"
    )
    mapping = parts.selectExpr("p_partkey + 1 AS spec_index", "explode(map('brand', 'maker', 'kind', lower(p_type))) AS (source, canonical)")
    return specs.with_canonical_names(rows, mapping).select("spec_index", "pos", "source", "output", "mapped")


ANSWERS = """concat('Mapping:', chr(10), '1. ', lower(p_brand), ' -> `HOST`', chr(10), '- kind -> ', CASE WHEN p_size % 2 = 0 THEN 'NONE' ELSE 'event_type' END,
    chr(10), 'name -> nonsense', chr(10), 'kind2 -> "Program".')"""


@query(
    "mapping_lines",
    """SELECT p_partkey, unnest([lower(p_brand), 'kind', 'kind2']) AS source, unnest(['host', CASE WHEN p_size % 2 = 0 THEN NULL ELSE 'event_type' END, 'program']) AS canonical FROM part""",
)
def mapping_lines(spark, sf):
    answers = table(spark, sf, "part").selectExpr("p_partkey", f"{ANSWERS} AS answer")
    return specs.mapping_lines(answers, "answer", ["host", "event_type", "program"], ["p_partkey"])


TEMPLATE = "concat(p_type, ' <*> ', p_size % 10)"


@query(
    "spec_join",
    f"""WITH i AS (SELECT template, cast(row_number() OVER (ORDER BY template) AS INTEGER) AS spec_index FROM (SELECT DISTINCT {TEMPLATE} AS template FROM part WHERE p_size % 10 < 6))
    SELECT p_partkey, template, spec_index FROM (SELECT p_partkey, {TEMPLATE} AS template FROM part) JOIN i USING (template)""",
)
def spec_join(spark, sf):
    lines, index = _template_index(spark, sf)
    return specs.template_specs(lines, index)[0].select("p_partkey", "template", "spec_index")


@query(
    "unknown_templates",
    f"""SELECT p_partkey, {TEMPLATE} AS template FROM part WHERE {TEMPLATE} NOT IN (SELECT {TEMPLATE} FROM part WHERE p_size % 10 < 6)""",
)
def unknown_templates(spark, sf):
    lines, index = _template_index(spark, sf)
    return specs.template_specs(lines, index)[1].select("p_partkey", "template")


def _template_index(spark, sf):
    """Template of every part, and numbers for the templates of some sizes."""
    parts = table(spark, sf, "part")
    lines = parts.selectExpr("p_partkey", f"{TEMPLATE} AS template")
    known = parts.filter("p_size % 10 < 6").selectExpr(f"{TEMPLATE} AS template").distinct()
    index = known.selectExpr("template", "cast(row_number() OVER (ORDER BY template) AS int) AS spec_index")
    return lines, index


ROUTES = [(1, 0, "client_ip", "src_ip"), (1, 1, "request_method", "event_action"), (1, 2, "http_query", "query"), (2, 0, "http_path", "object_name"), (2, 1, "nothing", "referer")]


@query(
    "spec_fill",
    f"""SELECT line_id, src_ip, CASE WHEN s = 1 THEN event_action ELSE '' END AS event_action,
        CASE WHEN s = 1 AND contains(target, '?') THEN regexp_replace(target, '^[^?]*\\?', '') ELSE '' END AS query, object_name, referer
    FROM (SELECT line_id, 1 + line_id % 2 AS s, coalesce({WEB_CELLS['src_ip']}, '') AS src_ip, {WEB_CELLS['event_action']} AS event_action,
        regexp_extract({acc(4)}, '{REQ}', 2) AS target, {WEB_CELLS['object_name']} AS object_name, {WEB_CELLS['referer']} AS referer FROM ({WEB_LINES.sql}))""",
)
def spec_fill(spark, sf):
    """Source values copied as each line's spec says; three columns have defaults."""
    lines = WEB_LINES.frame(spark, sf).withColumn("spec_index", (F.col("line_id") % 2 + 1).cast("int"))
    routes = spark.createDataFrame(ROUTES, "spec_index int, pos int, source string, output string")
    lines = with_access_values(lines, "_values")

    def v(name: str):
        return F.try_element_at("_values", F.lit(name))

    defaults = {"src_ip": v("src_ip"), "object_name": v("request_path"), "referer": v("referer")}
    return specs.routed(lines, "_values", routes, ["src_ip", "event_action", "query", "object_name", "referer"], defaults).select(
        "line_id", "src_ip", "event_action", "query", "object_name", "referer"
    )


def _count_words(batch: pd.DataFrame) -> pd.DataFrame:
    words = batch["content"].str.split()
    return pd.DataFrame({"first_word": words.str[0].fillna(""), "n_words": words.str.len().astype(str)})


@query(
    "distinct_fanout",
    f"""SELECT line_id, coalesce(string_split(content, ' ')[1], '') AS first_word, cast(len(string_split(content, ' ')) AS VARCHAR) AS n_words FROM ({DNS_LINES.sql})""",
)
def distinct_fanout(spark, sf):
    """A user's extractor runs once per distinct line; equal lines share the result."""
    lines = DNS_LINES.frame(spark, sf)
    found = hooks.extract_with(lines, _count_words, ["first_word", "n_words"], keys=("content",))
    return found.select("line_id", "first_word", "n_words")


@query(
    "fill_resume",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'old ' || event_type ELSE 'new ' || event_type END AS label, event_id % 3 = 0 AS kept FROM events""",
)
def fill_resume(spark, sf):
    """A third of the rows is filled by an earlier run; the rest is computed."""
    events = table(spark, sf, "events")
    earlier = events.selectExpr("event_id", "CASE WHEN event_id % 3 = 0 THEN concat('old ', event_type) ELSE ' ' END AS label")
    done, pending = hooks.resume(events.select("event_id", "event_type"), earlier, "event_id", ["label"])
    computed = pending.withColumn("label", F.concat(F.lit("new "), F.col("event_type")))
    return done.select("event_id", "label", F.lit(True).alias("kept")).unionByName(
        computed.select("event_id", "label", F.lit(False).alias("kept"))
    )


@query(
    "only_named",
    "SELECT event_id, event_type FROM events WHERE event_type IN ('view', 'error')",
)
def only_named(spark, sf):
    """Restriction to named groups; an unknown name would be an error."""
    events = table(spark, sf, "events").select("event_id", "event_type")
    return hooks.only_named(events, "event_type", ["view", "error", "view"], events)
