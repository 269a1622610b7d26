"""Match params rows with contract events and fill the rows' blanks.

Rows look for events by five keys of falling precision, all led by the time, and finally
by position. Every event serves one row. Keys are matched level by level: on one level the
k-th unmatched row of a key takes its k-th unmatched event, which is an equi-join on key and
number, so neither a frequent time nor a frequent user gathers in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.scalars import fill, first_filled, label_of
from logloom.functions.text import strip
from logloom.operators.events import with_fields
from logloom.operators.skew import number_within
from logloom.session import durable

# Display labels back to params values.
ACTION_VALUES = {
    "添加": "add",
    "修改": "set",
    "编辑": "set",
    "删除": "del",
    "显示": "show",
    "清空": "clear",
    "恢复": "startup",
    "批量加载": "bulk_load",
    "登录": "login",
    "退出": "logout",
    "离开": "leave",
}
POLICY_VALUES = {"允许": "permit", "禁止": "deny", "代理": "proxy"}
# Event fields that fill each params column, in order.
FILLED_FROM = {
    "time": ["login_time"],
    "device_name": ["control_name"],
    "user": ["login_account"],
    "management_ip": ["src_ip", "control_ip"],
    "src_addr": ["src_ip"],
    "dst_addr": ["dst_ip", "control_ip"],
    "service": ["protocol", "dst_port"],
    "policy_type": ["policy", "pcpolicy"],
}
ROW_FIELDS = [
    "login_time", "time", "control_name", "device_name", "login_account", "user", "src_ip", "management_ip",
    "src_addr", "dst_ip", "dst_addr", "event_type", "event_action", "service", "policy_type",
]
EVENT_FIELDS = [
    "login_time", "control_name", "login_account", "src_ip", "control_ip", "dst_ip", "protocol", "dst_port",
    "policy", "pcpolicy", "action",
]


def _key(*parts: Column) -> Column:
    """Key text, or NULL when every part is blank."""
    cells = [F.lower(strip(p)) for p in parts]
    blank = F.concat(*cells) == ""
    return F.when(~blank, F.concat_ws("\u0001", *cells))


def row_keys() -> list[Column]:
    def c(*names: str) -> Column:
        return first_filled(*[F.col(n) for n in names])

    time, user = c("login_time", "time"), c("login_account", "user")
    return [
        _key(time, c("control_name", "device_name"), user),
        _key(time, user),
        _key(time, c("src_ip", "management_ip", "src_addr")),
        _key(time, c("dst_ip", "dst_addr")),
        _key(time),
    ]


def event_keys() -> list[Column]:
    def c(*names: str) -> Column:
        return first_filled(*[F.col(n) for n in names])

    time, user = c("login_time"), c("login_account")
    return [
        _key(time, c("control_name"), user),
        _key(time, user),
        _key(time, c("src_ip", "control_ip")),
        _key(time, c("dst_ip", "control_ip")),
        _key(time),
    ]


def match(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Pairs (row_pos, event_pos, level) of rows and events with a unique ``pos`` each.

    Level 0 pairs equal positions that no key has matched.
    """
    levels = range(1, 6)
    left = with_fields(rows, ROW_FIELDS).select(
        F.col("pos").alias("row_pos"), *[k.alias(f"k{n}") for n, k in zip(levels, row_keys())]
    )
    right = with_fields(events, EVENT_FIELDS).select(
        F.col("pos").alias("event_pos"), *[k.alias(f"k{n}") for n, k in zip(levels, event_keys())]
    )
    left, right = durable(left), durable(right)
    pairs = None
    for level in levels:
        key = f"k{level}"
        if pairs is not None:
            rest_left = left.join(pairs, "row_pos", "left_anti")
            rest_right = right.join(pairs, "event_pos", "left_anti")
        else:
            rest_left, rest_right = left, right
        a = number_within(rest_left.filter(f"{key} IS NOT NULL").select("row_pos", key), [key], "row_pos", "_k")
        b = number_within(rest_right.filter(f"{key} IS NOT NULL").select("event_pos", key), [key], "event_pos", "_k")
        found = a.join(b, [key, "_k"]).select("row_pos", "event_pos", F.lit(level).alias("level"))
        pairs = durable(found if pairs is None else pairs.unionByName(found))
    by_position = (
        left.join(pairs, "row_pos", "left_anti")
        .select("row_pos")
        .join(
            right.join(pairs, "event_pos", "left_anti").select("event_pos"),
            F.col("row_pos") == F.col("event_pos"),
        )
        .select("row_pos", "event_pos", F.lit(0).alias("level"))
    )
    return pairs.unionByName(by_position)


def reconcile(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Rows with their blanks filled from the matched event; filled values stay."""
    pairs = match(rows, events)
    side = with_fields(events, EVENT_FIELDS).select(
        F.col("pos").alias("event_pos"), F.col("alarm_type").alias("_e_alarm_type"),
        *[F.col(c).alias(f"_e_{c}") for c in EVENT_FIELDS],
    )
    joined = (
        with_fields(rows, [c for c in ROW_FIELDS if c in rows.columns])
        .join(pairs.withColumnRenamed("row_pos", "pos"), "pos", "left")
        .join(side, "event_pos", "left")
    )
    login, change = F.col("_e_alarm_type").isin(1, 2, 3), F.col("_e_alarm_type") == 4
    action = label_of(F.col("_e_action"), ACTION_VALUES, F.col("_e_action"))
    values = {
        "event_type": F.when(login, "admin_session").when(change, "policy_rule"),
        "event_action": F.when(login, "login").when(change, action),
    }
    for name, sources in FILLED_FROM.items():
        value = first_filled(*[F.col(f"_e_{s}") for s in sources])
        values[name] = label_of(value, POLICY_VALUES, value) if name == "policy_type" else value
    matched = F.col("event_pos").isNotNull()
    known = rows.columns
    filled = [
        (fill(F.col(c), F.when(matched, values[c])) if c in values else F.col(c)).alias(c) for c in known if c != "pos"
    ]
    added = [F.when(matched, values[c]).otherwise("").alias(c) for c in values if c not in known]
    return joined.select("pos", *filled, *added)
