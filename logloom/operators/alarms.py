"""Alarm lists from contract events and application audit documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.scalars import iso_wall_clock
from logloom.operators.skew import lookup_join

# Alarm names, assets named by the alarms and the protected service.
OPEN_POLICY = "管理员修改防火墙策略为全通"
SUPER_USER = "应用系统存在'超级用户'"
TERMINAL_ADMIN = "用户终端违规登录运维管理员账户"
TERMINAL_OTHER = "用户终端违规登录非运维管理员账户"
MANY_ROLES = "应用系统存在'一人多岗'"
ODD_ACTION = "应用系统用户异常操作"
ROLE_SEPARATOR = "、"
ASSETS = [
    ("192.168.100.10", "终端A", "00:e0:4c:fe:ad:10", "用户A", "终端部门1"),
    ("192.168.100.11", "终端B", "00:e0:4c:fe:ad:11", "用户B", "终端部门2"),
    ("192.168.100.50", "管理端", "00:e0:4c:fe:ad:50", "管理员", "IT部门"),
    ("192.168.100.80", "防火墙服务", "00:e0:4c:fe:ad:80", "管理员", "IT部门"),
]
TERMINAL_IPS = ["192.168.100.10", "192.168.100.11"]
TERMINAL_MACS = ["00:e0:4c:fe:ad:10", "00:e0:4c:fe:ad:11"]
SERVICE_IP = "192.168.100.80"
SERVICE_ACCOUNT = "root"


def default_assets(spark) -> DataFrame:
    return spark.createDataFrame(ASSETS, "ip string, name string, mac string, owner string, department string")


def _field(name: str) -> Column:
    return F.coalesce(F.try_element_at("data", F.lit(name)), F.lit(""))


def open_policies(events: DataFrame, assets: DataFrame) -> DataFrame:
    """Policy events from any to any, with the owner of the changed device."""
    hits = events.filter(
        (F.col("alarm_type") == 4) & (_field("src_ip") == "any") & (_field("dst_ip") == "any")
    )
    owned = assets.select(F.col("ip").alias("control_ip"), "owner", "department")
    rows = lookup_join(hits.withColumn("control_ip", _field("control_ip")), owned, ["control_ip"])
    return rows.select(
        "source",
        "source_row",
        F.lit(OPEN_POLICY).alias("event_name"),
        F.col("alarm_type").alias("event_type"),
        _field("login_time").alias("time"),
        _field("control_name").alias("involved_assets"),
        F.col("control_ip").alias("involved_ip"),
        *[_field(c).alias(c) for c in ("control_device_type", "control_name")],
        "control_ip",
        F.coalesce("owner", F.lit("")).alias("control_owner"),
        F.coalesce("department", F.lit("")).alias("control_owner_department"),
        *[_field(c).alias(c) for c in ("action", "policy", "src_ip", "dst_ip", "login_account", "login_time")],
    )


def latest_per_device(alarms: DataFrame) -> DataFrame:
    """Latest alarm of every control IP by time text; the earliest row among equal times."""
    rest = [c for c in alarms.columns if c != "control_ip"]
    latest = F.max_by(F.struct(*rest), F.struct("time", -F.col("source_row"))).alias("_a")
    return alarms.groupBy("control_ip").agg(latest).select("_a.*", "control_ip")


def terminal_logins(events: DataFrame, assets: DataFrame) -> DataFrame:
    """Terminals that log in to the protected service; an optional rule, not in the list."""
    from_terminal = _field("src_ip").isin(TERMINAL_IPS) | _field("src_mac").isin(TERMINAL_MACS)
    to_service = (_field("dst_ip") == SERVICE_IP) & (_field("login_account") == SERVICE_ACCOUNT)
    hits = events.filter(F.col("alarm_type").isin(1, 2, 3) & from_terminal & to_service)
    named = assets.select(F.col("ip").alias("_ip"), "name", "owner", "department")
    rows = lookup_join(hits.withColumn("_ip", _field("src_ip")), named, ["_ip"])
    return rows.select(
        "source",
        "source_row",
        F.when(F.col("alarm_type") == 1, TERMINAL_ADMIN).otherwise(TERMINAL_OTHER).alias("event_name"),
        F.col("alarm_type").alias("event_type"),
        _field("login_time").alias("time"),
        F.coalesce("name", F.lit("")).alias("involved_assets"),
        _field("src_ip").alias("involved_ip"),
        _field("src_mac").alias("src_mac"),
        F.coalesce("owner", F.lit("")).alias("src_owner"),
        F.coalesce("department", F.lit("")).alias("src_department"),
        _field("dst_ip").alias("dst_ip"),
        _field("dst_port").alias("dst_port"),
        _field("login_account").alias("login_account"),
    )


def application_events(docs: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Audit documents with parsed subject, app_info and object maps as flat rows."""
    def part(column: str, name: str) -> Column:
        return F.try_element_at(column, F.lit(name))

    app_ip = part("app_info", "app_ip")
    ip = F.when(app_ip != "", app_ip).otherwise(F.coalesce(part("subject", "node_ip"), F.lit("")))
    level = F.coalesce(part("object", "object_security_level"), part("object", "objectSecurityLevel"), F.lit(""))
    return docs.select(
        *keys,
        "pos",
        iso_wall_clock(F.col("timestamp")).alias("time"),
        F.coalesce(part("app_info", "app_name"), F.lit("")).alias("involved_assets"),
        F.coalesce(ip, F.lit("")).alias("involved_ip"),
        F.coalesce(ip, F.lit("")).alias("control_ip"),
        *[F.coalesce(part("subject", c), F.lit("")).alias(c) for c in ("user", "user_role", "unit_name", "department")],
        level.alias("secret_level"),
        F.coalesce("log_type", F.lit("")).alias("log_type"),
        F.coalesce("op_type", F.lit("")).alias("op_type"),
    )


def _first(events: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in events.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.col("pos")).alias("_d")
    if not keys:
        return events.agg(first).filter("_d IS NOT NULL").select("_d.*")
    return events.groupBy(*keys).agg(first).select(*keys, "_d.*")


def _named(rows: DataFrame, name: str, number: int, action: Column) -> DataFrame:
    return rows.withColumns(
        {"event_name": F.lit(name), "event_type": F.lit(number), "action": action}
    ).drop("pos", "log_type", "op_type")


def super_users(events: DataFrame, keys: list[str] = ()) -> DataFrame:
    """First document (per key) as a super-user alarm."""
    action = F.concat(F.col("involved_assets"), F.lit("存在超级管理员"), F.col("user"))
    return _named(_first(events, list(keys)), SUPER_USER, 5, action)


def many_roles(events: DataFrame, keys: list[str] = ()) -> DataFrame:
    """First document (per key) with all distinct roles in first-seen order."""
    rows, on = (events, list(keys)) if keys else (events.withColumn("_all", F.lit(1)), ["_all"])
    seen = rows.filter(F.col("user_role") != "").groupBy(*on, "user_role").agg(F.min("pos").alias("_at"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_at", "user_role"))), lambda x: x["user_role"])
    listed = seen.groupBy(*on).agg(F.array_join(ordered, ROLE_SEPARATOR).alias("_roles"))
    joined = _first(rows, on).join(listed, on, "left")
    roles = F.when(F.coalesce("_roles", F.lit("")) != "", F.col("_roles")).otherwise(F.col("user_role"))
    joined = joined.withColumn("user_role", roles).drop("_roles", "_all")
    action = F.concat(F.col("user"), F.lit("存在多个角色, 分别为: "), F.col("user_role"))
    return _named(joined, MANY_ROLES, 6, action)


def odd_actions(events: DataFrame, keys: list[str] = ()) -> DataFrame:
    """First document (per key) as an abnormal-operation alarm."""
    action = F.concat(F.col("user_role"), F.lit("--"), F.col("log_type"), F.col("op_type"))
    return _named(_first(events, list(keys)), ODD_ACTION, 7, action)


def alarm_list(firewall: DataFrame, application: DataFrame) -> DataFrame:
    """Firewall alarms, then application alarms, each by time descending: column branch orders them."""
    left = firewall.withColumn("branch", F.lit(0))
    right = application.withColumn("branch", F.lit(1))
    return left.unionByName(right, allowMissingColumns=True)


def page(alarms: DataFrame, number: int, size: int, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Rows of one page in a total order, and the total count."""
    rows = alarms.orderBy(*order).offset((number - 1) * size).limit(size)
    return rows, alarms.agg(F.count(F.lit(1)).alias("total"))
