"""Firewall lines to params rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.pairs import first_value, pairs, value
from logloom.functions.scalars import label_of
from logloom.functions.text import captured, strip
from logloom.operators.columns import FIREWALL

# Spellings of modules and actions.
MODULES = {"策略": "policy", "黑名单": "blacklist"}
ACTIONS = {
    "添加": "add",
    "修改": "set",
    "编辑": "set",
    "设置": "set",
    "删除": "del",
    "清除": "clear",
    "批量加载": "bulk_load",
    "登录": "login",
    "退出": "logout",
    "离开": "leave",
    "显示": "show",
    "恢复": "startup",
}
# Policy kinds by policy number, then by words of the message, in order.
POLICY_NUMBERS = {
    "50": "deny",
    "55": "permit",
    "56": "nat",
    "57": "port_map",
    "58": "ip_map",
    "59": "proxy",
    "61": "masquerade",
    "62": "permit_nat",
    "101": "active_defense",
    "102": "uids",
    "103": "antiddos",
    "104": "psa",
}
POLICY_WORDS = [
    (["antiddos"], "antiddos"),
    (["psa"], "psa"),
    (["uids"], "uids"),
    (["端口映射", "portmap"], "port_map"),
    (["ip 映射", "ipmap"], "ip_map"),
    (["nat"], "nat"),
    (["代理", "proxy"], "proxy"),
    (["伪装", "masquerade"], "masquerade"),
    (["主动防御", "active"], "active_defense"),
    (["deny"], "deny"),
    (["允许", "permit"], "permit"),
]
# Words for switches and outcomes.
ON_WORDS = ["on", "enable", "enabled", "开启"]
OFF_WORDS = ["off", "disable", "disabled", "关闭"]
GOOD_WORDS = ["0", "成功", "success", "ok", "true"]
BAD_WORDS = ["1", "失败", "failure", "failed", "fail", "error", "false"]
BAD_MESSAGES = ["错误", "失败", "error"]
SESSION_MODULES = ["webui", "cli", "terminal"]
# Pair keys that feed a column under another name.
KEY_OF_COLUMN = {
    "device_name": "dname",
    "module": "mod",
    "event_action": "act",
    "management_ip": "from",
    "src_mac": "srp_mac",
    "policy_id": "policy",
    "rule_id": "id",
    "interface_in": "iif",
    "interface_out": "oif",
    "src_zone": "izone",
    "dst_zone": "ozone",
    "translated_src": "sat",
    "public_ip": "pa",
    "internal_addr": "ia",
    "public_service": "ps",
    "internal_service": "is",
}
PREFIX = r"(?s)^(\S+)\s+([^:\s]+):\s+(.*)$"
ZONE_NAMES = (r"(?i)(?:安全域名字|安全域名称)\s+(\S+)", r"(?i)seczone\s+name\s+(\S+)")
INTERFACE_SET = r"(?i)(?:接口集合|ifset)\s+(.+)$"
IPV4_WORD = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"


def with_prefix(lines: DataFrame) -> DataFrame:
    """Columns _host, _prefix_program, _body; the prefix counts only before a device line."""
    rows = lines.withColumn("_text", strip(F.coalesce(F.col("content"), F.lit(""))))
    rows = rows.withColumn("_parts", captured(F.col("_text"), PREFIX, 3))
    known = F.coalesce(F.element_at("_parts", 3).contains("devid="), F.lit(False))
    return rows.withColumns(
        {
            "_host": F.when(known, F.element_at("_parts", 1)).otherwise(""),
            "_prefix_program": F.when(known, F.element_at("_parts", 2)).otherwise(""),
            "_body": F.when(known, F.element_at("_parts", 3)).otherwise(F.col("_text")),
        }
    )


def module_name(text: Column) -> Column:
    return F.lower(label_of(strip(text), MODULES, strip(text)))


def action_name(text: Column) -> Column:
    return F.lower(label_of(strip(text), ACTIONS, strip(text)))


def switch_state(text: Column) -> Column:
    word = F.lower(strip(text))
    return F.when(word.isin(ON_WORDS), "enabled").when(word.isin(OFF_WORDS), "disabled").otherwise(text)


def _any_of(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def outcome_of(result: Column, message: Column) -> Column:
    """``message`` is the lower-case message."""
    raw = strip(result)
    word = F.lower(raw)
    return (
        F.when(word.isin(GOOD_WORDS), "success")
        .when(word.isin(BAD_WORDS), "failure")
        .when(_any_of(message, BAD_MESSAGES), "failure")
        .when(raw == "", "unknown")
        .otherwise(raw)
    )


def policy_kind(policy: Column, text: Column) -> Column:
    """``text`` is the lower-case message."""
    by_words = None
    for words, kind in POLICY_WORDS:
        hit = _any_of(text, words)
        by_words = F.when(hit, kind) if by_words is None else by_words.when(hit, kind)
    return F.coalesce(label_of(strip(policy), POLICY_NUMBERS), by_words, F.lit(""))


def event_kind(module: Column, program: Column, action: Column, message: Column) -> Column:
    combined = F.lower(F.concat_ws(" ", module, program, action, message))
    fallback = F.when(module != "", module).when(program != "", program).otherwise("firewall_event")
    return (
        F.when(module.isin(SESSION_MODULES), "admin_session")
        .when((module == "policy") | (program == "rule"), "policy_rule")
        .when((module == "zone") | (program == "zone"), "zone_config")
        .when((module == "blacklist") | _any_of(combined, ["黑名单", "blacklist"]), "blacklist")
        .when((module == "fc") | (program == "fc"), "flow_control")
        .otherwise(fallback)
    )


def zone_name(message: Column) -> Column:
    found = [F.regexp_extract(message, p, 1) for p in ZONE_NAMES]
    return F.coalesce(*[F.when(v != "", F.trim(v, F.lit(",，"))) for v in found], F.lit(""))


def interface_set(message: Column) -> Column:
    text = strip(F.regexp_extract(message, INTERFACE_SET, 1))
    return F.when(F.lower(text) == "ifset", "").otherwise(text)


def rule_key(device: Column, policy: Column, rule: Column) -> Column:
    parts = F.concat_ws(
        "|",
        F.when(policy != "", F.concat(F.lit("policy:"), policy)),
        F.when(rule != "", F.concat(F.lit("rule:"), rule)),
    )
    head = F.when(device == "", "firewall").otherwise(device)
    return F.when(parts == "", "").otherwise(F.concat_ws("|", head, parts))


def firewall_params(lines: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Columns timestamp and content to the 43 firewall columns; row-local."""
    rows = with_prefix(lines)
    rows = rows.withColumn("_kv", pairs(F.col("_body")))
    kv = F.col("_kv")

    def one(*keys: str) -> Column:
        return first_value(kv, *keys)

    def either(left: Column, right: Column) -> Column:
        return F.when(left != "", left).otherwise(F.coalesce(right, F.lit("")))

    program = F.col("_prefix_program")
    rows = rows.withColumns(
        {
            "_message": one("dsp_msg", "msg"),
            "_module": module_name(either(value(kv, "mod"), program)),
            "_action": action_name(value(kv, "act")),
            "_device": either(value(kv, "dname"), F.col("_host")),
            "_program": F.lower(program),
        }
    )
    message, module, action, device = (F.col(c) for c in ("_message", "_module", "_action", "_device"))
    policy, rule = value(kv, "policy"), value(kv, "id")
    rows = rows.withColumns(
        {"_kind": event_kind(module, F.col("_program"), action, message), "_low": F.lower(message)}
    )
    stamp = either(value(kv, "date"), F.col("timestamp"))
    found = {
        "time": stamp,
        "device_name": device,
        "module": module,
        "event_type": F.col("_kind"),
        "event_action": action,
        "user": one("user", "admin"),
        "management_ip": value(kv, "from"),
        "outcome": outcome_of(value(kv, "result"), F.col("_low")),
        "src_addr": value(kv, "sa"),
        "dst_addr": value(kv, "da"),
        "interface_in": value(kv, "iif"),
        "interface_out": value(kv, "oif"),
        "src_zone": value(kv, "izone"),
        "dst_zone": value(kv, "ozone"),
        "policy_id": policy,
        "rule_id": rule,
        "rule_key": rule_key(device, policy, rule),
        "policy_type": policy_kind(policy, F.col("_low")),
        "rule_state": switch_state(value(kv, "active")),
        "log_enabled": switch_state(value(kv, "log")),
        "translated_src": value(kv, "sat"),
        "public_ip": value(kv, "pa"),
        "internal_addr": value(kv, "ia"),
        "public_service": value(kv, "ps"),
        "internal_service": value(kv, "is"),
        "zone_name": zone_name(message),
        "blacklist_ip": F.when(F.col("_kind") == "blacklist", F.regexp_extract(message, IPV4_WORD, 0)).otherwise(""),
        "src_ip": one("src_ip", "from"),
        "src_mac": one("src_mac", "srp_mac"),
        "dst_ip": one("dst_ip", "da"),
        "dst_port": one("dst_port", "dport"),
        "login_account": one("login_account", "user", "admin"),
        "login_time": either(value(kv, "login_time"), stamp),
        "control_name": either(value(kv, "control_name"), device),
    }
    rows = rows.withColumns({f"_f_{name}": column for name, column in found.items()})
    columns = []
    for name in FIREWALL:
        spare = one(*[k for k in (KEY_OF_COLUMN.get(name), name) if k])
        columns.append((either(F.col(f"_f_{name}"), spare) if name in found else value(kv, name)).alias(name))
    return rows.select(*keep, *columns)
