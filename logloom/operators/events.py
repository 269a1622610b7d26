"""Firewall params to contract events: classify, enrich, carry rule state, validate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.scalars import (
    event_time,
    fill,
    first_filled,
    is_address,
    is_mac,
    join_filled,
    label_of,
    reversed_labels,
)
from logloom.functions.text import strip
from logloom.operators.rollup import is_firewall_name
from logloom.operators.rule_state import BLOCK_SECONDS, carry_forward, time_block
from logloom.operators.skew import BROADCAST_BYTES, Lookup, lookup_join, text_size
from logloom.session import durable

# Labels of actions and policies.
ACTION_LABELS = {
    "add": "添加",
    "set": "修改",
    "edit": "修改",
    "modify": "修改",
    "del": "删除",
    "delete": "删除",
    "show": "显示",
    "clear": "清空",
    "startup": "恢复",
    "bulk_load": "批量加载",
    "login": "登录",
    "logout": "退出",
    "leave": "离开",
}
POLICY_LABELS = {"permit": "允许", "permit_nat": "允许", "deny": "禁止", "proxy": "代理"}
POLICY_VALUES = ["允许", "禁止", "代理"]
# Defaults of firewall sources.
DEFAULT_DEVICE = "themis"
TERMINAL_IP = "192.168.100.10"
MANAGEMENT_IP = "192.168.100.50"
DEFAULT_WEB_PORT = "443"
DEFAULT_CLI_PORT = "22"
FLOW_KINDS = ["traffic", "flow", "flow_log", "network_flow"]
# Required fields per alarm type, in payload order.
CONTRACT = {
    1: ["src_ip", "src_mac", "dst_ip", "dst_port", "login_account", "login_time"],
    2: ["src_ip", "src_mac", "dst_ip", "dst_port", "protocol", "login_account", "login_time"],
    3: ["src_ip", "src_mac", "dst_ip", "dst_port", "login_account", "login_time", "subject", "action", "object", "time"],
    4: ["control_device_type", "control_name", "control_ip", "action", "policy", "src_ip", "dst_ip", "login_account", "login_time", "subject", "object", "time"],
}
# Columns of the asset and device tables that are read.
ASSET_FIELDS = ["src_mac", "default_user"]
DEVICE_FIELDS = ["device_name", "management_ip", "device_type", "protocol", "web_port", "cli_port", "terminal_port", "default_user"]
# Messages of rejections and warnings.
NOT_A_NUMBER = "alarm_type 不是整数: "
BAD_TYPE = "不支持的 alarm_type: "
BAD_ACTION = "策略动作不属于添加/修改/删除: "
NOT_A_LOGIN = "客户协议只接收登录事件，当前动作: "
NO_LOGIN_KIND = "无法确定登录事件 alarm_type，module="
BAD_EVENT_KIND = "客户协议未定义事件类型: "
EMPTY = "空"
MISSING = "缺少必填字段: "
EXTRA = "包含协议外字段: "
BAD_MAC = "src_mac 不是合法 MAC 地址"
BAD_ADDRESS = " 不是标准 IP/CIDR，当前按防火墙地址对象保留"
BAD_POLICY = "policy 不属于 允许、禁止或代理，当前按原始值保留"
BAD_TIME = "login_time 无法按支持的时间格式解析"
NO_RULE = "策略日志没有 rule_id/rule_key，无法进行修改和删除状态关联"

ROW_FIELDS = [
    "alarm_type", "time", "login_time", "control_name", "device_name", "module", "event_type", "event_action",
    "action", "user", "login_account", "src_ip", "management_ip", "dst_ip", "dst_port", "src_mac", "srp_mac",
    "protocol", "rule_id", "rule_key", "policy_type", "policy", "pcpolicy", "src_addr", "dst_addr",
    "control_device_type", "control_ip",
]

# Columns of the params that events and rejections show.
KEPT = ["source", "source_row", "event_type", "event_action", "module"]
# Columns of the report.
REPORT_SCHEMA = "source string, " + ", ".join(
    f"{n} long" for n in ["input_rows", "event_count", "rejected_count", "warning_count", *[f"type_{k}" for k in CONTRACT]]
) + ", ok boolean"


@dataclass
class Events:
    built: DataFrame
    accepted: DataFrame
    rejected: DataFrame


def with_fields(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Named columns as trimmed text, '' where the table has none."""
    known = set(rows.columns)
    return rows.withColumns(
        {f: strip(F.coalesce(F.col(f).cast("string"), F.lit(""))) if f in known else F.lit("") for f in fields}
    )


def _or_empty(text: Column) -> Column:
    return F.when(text == "", EMPTY).otherwise(text)


def classify(permissive: Column) -> Column:
    """Struct (type, reason) of a row; the reason is NULL when a type is found."""
    kind, module, action = (F.lower(F.col(c)) for c in ("event_type", "module", "event_action"))
    explicit = F.col("alarm_type")
    whole = explicit.rlike(r"^[+-]?\d+$")
    number = F.when(whole, explicit.try_cast("int"))
    known = F.coalesce(number.isin(1, 2, 3, 4), F.lit(False))

    def found(value: Column | int) -> Column:
        value = value if isinstance(value, Column) else F.lit(value)
        return F.struct(value.cast("int").alias("type"), F.lit(None).cast("string").alias("reason"))

    def refused(*parts: Column | str) -> Column:
        texts = [p if isinstance(p, Column) else F.lit(p) for p in parts]
        return F.struct(F.lit(None).cast("int").alias("type"), F.concat(*texts).alias("reason"))

    plain_number = F.regexp_replace(F.regexp_replace(explicit, r"^\+", ""), r"^(-?)0+(?=\d)", "$1")
    admin = kind == "admin_session"
    return (
        F.when(permissive & (admin | module.isin("webui", "cli")), found(3))
        .when(permissive & (module == "terminal"), found(1))
        .when(permissive & (kind.isin(FLOW_KINDS) | module.isin("traffic", "flow")), found(2))
        .when((explicit != "") & known, found(number))
        .when(permissive, found(4))
        .when((explicit != "") & ~whole, refused(NOT_A_NUMBER, explicit))
        .when(explicit != "", refused(BAD_TYPE, plain_number))
        .when((kind == "policy_rule") & action.isin(list(ACTION_LABELS)), found(4))
        .when(kind == "policy_rule", refused(BAD_ACTION, _or_empty(action)))
        .when(admin & (action != "login"), refused(NOT_A_LOGIN, _or_empty(action)))
        .when(admin & module.isin("webui", "cli"), found(3))
        .when(admin & (module == "terminal"), found(1))
        .when(admin, refused(NO_LOGIN_KIND, _or_empty(module)))
        .otherwise(refused(BAD_EVENT_KIND, _or_empty(kind)))
    )


@dataclass
class Dimensions:
    """Asset and device tables, ready to be joined, and the rows of the default keys."""

    assets: Lookup
    devices: Lookup
    terminal: dict[str, str]
    desk: dict[str, str]
    device: dict[str, str]


def _side(table: DataFrame, fields: list[str], prefix: str) -> DataFrame:
    known = set(table.columns)
    chosen = [(F.col(f) if f in known else F.lit("")).alias(f"{prefix}{f}") for f in fields]
    return table.select(F.col("_key").alias(f"{prefix}key"), *chosen, F.lit(True).alias(f"{prefix}found"))


def dimensions(assets: DataFrame, devices: DataFrame) -> Dimensions:
    """Both tables are stored as one, then measured and searched for the default keys in one aggregation."""
    assets, devices = _side(assets, ASSET_FIELDS, "_as_"), _side(devices, DEVICE_FIELDS, "_de_")
    both = durable(assets.unionByName(devices, allowMissingColumns=True))
    asset, device = F.struct(*assets.columns), F.struct(*devices.columns)

    def only(key: str, value: str, row: Column, name: str) -> Column:
        return F.max(F.when(F.col(key) == value, row)).alias(name)

    found = both.agg(
        F.sum(F.when(F.col("_as_found"), text_size(assets.columns))).alias("asset_bytes"),
        F.sum(F.when(F.col("_de_found"), text_size(devices.columns))).alias("device_bytes"),
        only("_as_key", TERMINAL_IP, asset, "terminal"),
        only("_as_key", MANAGEMENT_IP, asset, "desk"),
        only("_de_key", DEFAULT_DEVICE, device, "device"),
    ).first().asDict(recursive=True)

    def part(prefix: str, columns: list[str], size: str) -> Lookup:
        return Lookup(both.filter(f"{prefix}found").select(*columns), (found[size] or 0) <= BROADCAST_BYTES)

    return Dimensions(
        part("_as_", assets.columns, "asset_bytes"),
        part("_de_", devices.columns, "device_bytes"),
        *[found[name] or {} for name in ("terminal", "desk", "device")],
    )


def once(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with each of ``columns`` evaluated once per row.

    Filters on them, or on what is made of them, do not move below the generator; they would take the whole
    expressions with them and evaluate them again for every mention.
    """
    made = [f"_once_{n}" for n in range(len(columns))]
    kept = [c for c in rows.columns if c not in columns]
    cells = F.struct(*[F.col(f"`{c}`").alias(m) for c, m in zip(columns, made)])
    rows = rows.select(*[F.col(f"`{c}`") for c in kept], F.inline(F.array(cells)))
    return rows.withColumnsRenamed(dict(zip(made, columns)))


def build_events(
    params: DataFrame,
    assets: DataFrame,
    devices: DataFrame,
    block_seconds: int = BLOCK_SECONDS,
    types: list[int] | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Params (with source, source_row) with their alarm type or refusal and payload ``data``.

    ``assets`` and ``devices`` are keyed tables as made by ``sources.tables.keyed``. The
    rows are materialised before rule state is carried, because that reads them twice. Only rows
    with a rule pass through windows; the others have no state and stay as they are. With
    ``types`` rows of other alarm types, and refused ones, are left out of what follows the
    materialised rows (a filter before them would be pushed into the extraction of all fields and
    repeat its expressions); state belongs to rows of type 4, so the rows that stay do not change.
    ``keep`` names the columns of the params that stay in the result and in the materialised rows, by default all.
    """
    known = dimensions(assets, devices)
    rows = with_fields(params, ROW_FIELDS)
    lenient = is_firewall_name(F.col("source"))
    terminal = F.lower("module") == "terminal"

    def when_lenient(value: Column | str) -> Column:
        return F.when(lenient, value).otherwise("")

    def default_asset(field: str) -> Column:
        at_terminal, at_desk = (row.get(f"_as_{field}") or "" for row in (known.terminal, known.desk))
        return when_lenient(F.when(terminal, at_terminal).otherwise(at_desk))

    default_ip = when_lenient(F.when(terminal, TERMINAL_IP).otherwise(MANAGEMENT_IP))
    device_name = first_filled(
        F.col("control_name"), F.col("device_name"), when_lenient(known.device.get("_de_device_name") or "")
    )
    rows = rows.withColumns(
        {
            "_c": classify(lenient),
            "_time": event_time(F.col("time")),
            "_device": device_name,
            "_default_ip": default_ip,
            "_source_ip": first_filled(F.col("src_ip"), F.col("management_ip"), default_ip),
        }
    )
    rows = lookup_join(rows.withColumn("_de_key", F.lower("_device")), known.devices, ["_de_key"])
    rows = lookup_join(rows.withColumn("_as_key", F.col("_source_ip")), known.assets, ["_as_key"])

    def device(field: str) -> Column:
        return F.when(F.col("_de_found"), F.col(f"_de_{field}")).otherwise(when_lenient(known.device.get(f"_de_{field}") or ""))

    kind = F.col("_c.type")
    web = (kind == 2) | (F.lower("module") == "webui")
    raw_action = F.when(F.col("event_action") != "", F.col("event_action")).otherwise(F.col("action"))
    rule = first_filled(F.col("rule_id"), F.col("rule_key"))
    keyed = F.coalesce((kind == 4) & (rule != ""), F.lit(False))
    cells = {
        "_type": kind,
        "_reason": F.col("_c.reason"),
        "_keyed": keyed,
        "_key": F.when(keyed, F.concat_ws("\u0001", "source", F.lower("_device"), rule)),
        "_block": time_block(F.col("_time"), F.col("source_row"), block_seconds),
        "_untimed": F.col("_time").isNull(),
        "_action": F.lower("event_action"),
        "_account": first_filled(
            F.col("login_account"), F.col("user"), F.col("_as_default_user"),
            default_asset("default_user"), device("default_user"),
        ),
        "_login_time": first_filled(F.col("login_time"), F.col("time")),
        "_managed": device("management_ip"),
        "_port": first_filled(
            F.col("dst_port"),
            F.when(web, first_filled(device("web_port"), F.lit(DEFAULT_WEB_PORT))).otherwise(
                first_filled(device("cli_port"), device("terminal_port"), F.lit(DEFAULT_CLI_PORT))
            ),
        ),
        "_mac": first_filled(F.col("src_mac"), F.col("srp_mac"), F.col("_as_src_mac"), default_asset("src_mac")),
        "_login_action": first_filled(label_of(F.lower(raw_action), ACTION_LABELS), raw_action, F.lit("登录")),
        "_protocol": first_filled(F.col("protocol"), device("protocol"), F.lit("TCP")),
        "_raw_policy": first_filled(F.col("policy"), F.col("pcpolicy")),
        "_device_type": first_filled(F.col("control_device_type"), device("device_type")),
        "_lenient": lenient,
    }
    wanted = params.columns if keep is None else [c for c in params.columns if c in keep]
    kept = [*wanted, "_time", "_device", "_default_ip", "_source_ip"]
    state = ["policy_type", "src_addr", "src_ip", "dst_addr", "dst_ip", "control_ip"]
    extra = [c for c in state if c not in wanted]
    rows = durable(rows.select(*kept, *extra, *[c.alias(n) for n, c in cells.items()]))
    if types is not None:
        rows = rows.filter(F.col("_type").isin(types))

    def or_null(value: Column) -> Column:
        return F.when(value != "", value)

    fields = {
        "_policy_type": (or_null(F.col("policy_type")), None),
        "_src": (or_null(first_filled(F.col("src_addr"), F.col("src_ip"))), or_null(F.col("_default_ip"))),
        "_dst": (
            or_null(first_filled(F.col("dst_addr"), F.col("dst_ip"))),
            F.when(F.col("_lenient"), or_null(F.col("_managed"))),
        ),
    }
    order = ["_untimed", "_time", "source_row"]
    ruled = carry_forward(rows.filter("_keyed"), "_key", "_block", order, F.col("_action") == "del", fields)
    alone = rows.filter("NOT _keyed").withColumns(
        {name: own if default is None else F.coalesce(own, default) for name, (own, default) in fields.items()}
    )
    rows = ruled.unionByName(alone)
    rows = rows.select(*wanted, "_type", "_reason", "_keyed", "_untimed", "_time", _payload().alias("data"))
    return once(rows, ["data"])


def _payload() -> Column:
    """Map of the contract fields of the row's type."""
    kind, account, stamp, source = (F.col(c) for c in ("_type", "_account", "_login_time", "_source_ip"))
    protocol = F.col("_protocol")
    protocol = F.when(protocol.startswith("IP协议"), protocol).otherwise(F.concat(F.lit("IP协议"), F.upper(protocol)))
    login = {
        "src_ip": source, "src_mac": F.col("_mac"), "dst_ip": first_filled(F.col("dst_ip"), F.col("_managed")),
        "dst_port": F.col("_port"), "protocol": protocol, "login_account": account, "login_time": stamp,
        "subject": source, "action": F.col("_login_action"), "object": join_filled("_", [source, account]),
        "time": stamp,
    }
    raw_policy = F.col("_raw_policy")
    policy = F.when(raw_policy.isin(POLICY_VALUES), raw_policy).otherwise(
        F.coalesce(label_of(F.col("_policy_type"), POLICY_LABELS), F.lit(""))
    )
    control_ip = first_filled(F.col("control_ip"), F.col("_managed"))
    change = {
        "control_device_type": F.col("_device_type"),
        "control_name": F.col("_device"), "control_ip": control_ip,
        "action": first_filled(label_of(F.col("_action"), ACTION_LABELS), F.col("_action"), F.lit("修改")),
        "policy": first_filled(policy, F.lit("允许")),
        "src_ip": F.coalesce("_src", F.lit("")), "dst_ip": F.coalesce("_dst", F.lit("")),
        "login_account": account, "login_time": stamp, "subject": join_filled("_", [control_ip, account]),
        "object": control_ip, "time": stamp,
    }
    chain = None
    for number, names in CONTRACT.items():
        values = change if number == 4 else login
        part = F.create_map(*[x for n in names for x in (F.lit(n), values[n])])
        chain = F.when(kind == number, part) if chain is None else chain.when(kind == number, part)
    return chain


def _get(name: str) -> Column:
    return strip(F.coalesce(F.try_element_at("data", F.lit(name)), F.lit("")))


def validate(built: DataFrame, contract: dict[int, list[str]] = CONTRACT) -> DataFrame:
    """Arrays of errors and warnings per classified row."""
    required = None
    for number, names in contract.items():
        part = F.array(*[F.lit(n) for n in names])
        hit = F.col("_type") == number
        required = F.when(hit, part) if required is None else required.when(hit, part)
    every = list(dict.fromkeys(n for names in contract.values() for n in names))
    texts = list(dict.fromkeys([*every, "src_mac", "policy", "login_time"]))
    # Fields are read from the map once; errors and warnings are made of these texts.
    rows = built.withColumn("_required", required).withColumns({f"_v_{n}": _get(n) for n in texts})

    def of_type(parts: dict[int, Column], none: Column) -> Column:
        chain = None
        for number, part in parts.items():
            hit = F.col("_type") == number
            chain = F.when(hit, part) if chain is None else chain.when(hit, part)
        return F.coalesce(chain, none)

    def value(name: str) -> Column:
        return F.col(f"_v_{name}")

    blank = of_type(
        {k: F.concat_ws(", ", *[F.when(value(n) == "", F.lit(n)) for n in names]) for k, names in contract.items()}, F.lit("")
    )
    extra = F.array_sort(F.array_except(F.map_keys("data"), F.col("_required")))
    rows = rows.withColumns({"_blank": blank, "_extra": extra})
    errors = F.array(
        F.when(F.col("_required").isNull(), F.concat(F.lit(BAD_TYPE), F.col("_type").cast("string"))),
        F.when(F.col("_blank") != "", F.concat(F.lit(MISSING), F.col("_blank"))),
        F.when(F.size("_extra") > 0, F.concat(F.lit(EXTRA), F.array_join("_extra", ", "))),
    )
    addresses = [n for n in every if n.endswith("_ip")]
    odd = of_type(
        {
            k: F.array(*[F.when((value(n) != "") & ~is_address(value(n)), F.lit(n + BAD_ADDRESS)) for n in names if n in addresses])
            for k, names in contract.items()
        },
        F.array().cast("array<string>"),
    )
    mac, policy, stamp = value("src_mac"), value("policy"), value("login_time")
    policy_row = F.col("_type") == 4
    warnings = F.concat(
        F.array(
            F.when(policy_row & ~F.col("_keyed"), NO_RULE),
            F.when((mac != "") & ~is_mac(mac), BAD_MAC),
        ),
        odd,
        F.array(
            F.when(policy_row & (policy != "") & ~policy.isin(POLICY_VALUES), BAD_POLICY),
            F.when((stamp != "") & event_time(stamp).isNull(), BAD_TIME),
        ),
    )
    rows = rows.withColumns({"errors": F.array_compact(errors), "warnings": F.array_compact(warnings)})
    return once(rows.drop("_required", "_blank", "_extra", *[f"_v_{n}" for n in texts]), ["errors"])


def export(
    params: DataFrame,
    assets: DataFrame,
    devices: DataFrame,
    contract: dict[int, list[str]] = CONTRACT,
    block_seconds: int = BLOCK_SECONDS,
    stored: bool = False,
    types: list[int] | None = None,
) -> Events:
    """Accepted and rejected events of params rows; ``stored`` evaluates the rows behind both, and the report, once.

    ``types`` limits the work to rows of these alarm types.
    """
    built = validate(build_events(params, assets, devices, block_seconds, types, KEPT), contract)
    if stored:
        built = durable(built)
    typed = F.col("_type").isNotNull()
    good = typed & (F.size("errors") == 0)
    accepted = built.filter(good).select(
        "source", "source_row", F.col("_time").alias("ts"), F.col("_type").alias("alarm_type"), "data", "warnings"
    )
    known = set(params.columns)
    rejected = built.filter(~good).select(
        "source",
        "source_row",
        F.coalesce("_reason", F.array_join("errors", "; ")).alias("reason"),
        *[(F.col(c) if c in known else F.lit("")).alias(c) for c in ("event_type", "event_action", "module")],
        F.when(typed, F.struct(F.col("_type").alias("alarm_type"), "data")).alias("candidate_event"),
    )
    return Events(built, accepted, rejected)


def report(events: Events) -> DataFrame:
    """Per source: rows in, accepted, rejected, warnings, accepted per type, ok flag."""
    good = F.col("_type").isNotNull() & (F.size("errors") == 0)
    one = F.lit(1)
    return events.built.groupBy("source").agg(
        F.count(one).alias("input_rows"),
        F.count(F.when(good, one)).alias("event_count"),
        F.count(F.when(~good, one)).alias("rejected_count"),
        F.sum(F.when(good, F.size("warnings")).otherwise(0)).cast("long").alias("warning_count"),
        *[F.count(F.when(good & (F.col("_type") == n), one)).alias(f"type_{n}") for n in CONTRACT],
        (F.count(F.when(~good, one)) == 0).alias("ok"),
    )


def enrich(
    params: DataFrame, assets: DataFrame, devices: DataFrame, block_seconds: int = BLOCK_SECONDS
) -> DataFrame:
    """Params rows with blanks filled from their event payload; filled values stay."""
    built = build_events(params, assets, devices, block_seconds)
    names = list(dict.fromkeys(n for fields in CONTRACT.values() for n in fields))
    known = params.columns
    base = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in known if c not in ("source", "source_row")}
    for name in names:
        base[name] = fill(base.get(name, F.lit("")), _get(name))
    login = F.col("_type").isin(1, 2, 3)
    change = F.col("_type") == 4
    action = label_of(_get("action"), reversed_labels(ACTION_LABELS), _get("action"))
    policy = label_of(_get("policy"), reversed_labels(POLICY_LABELS), _get("policy"))
    either = {
        "time": _get("login_time"), "device_name": _get("control_name"), "user": _get("login_account"),
        "event_type": F.when(login, "admin_session").when(change, "policy_rule"),
        "event_action": F.when(login, "login").when(change, action),
        "management_ip": F.when(login, _get("src_ip")),
        "src_addr": F.when(change, _get("src_ip")),
        "dst_addr": F.when(login | change, _get("dst_ip")),
        "service": F.when(login, _get("protocol")),
        "policy_type": F.when(change, policy),
    }
    for name, value in either.items():
        base[name] = fill(base.get(name, F.lit("")), value)
    return built.select("source", "source_row", *[c.alias(n) for n, c in base.items()])


def contract_of(examples: DataFrame, order: str) -> DataFrame:
    """Per alarm type the data fields of example events, in first-seen order.

    ``data`` is a map whose keys keep their written order.
    """
    fields = examples.filter(F.col("alarm_type").isNotNull()).select(
        "alarm_type", F.col(order).alias("_o"), F.posexplode(F.map_keys("data")).alias("_p", "field")
    )
    first = fields.groupBy("alarm_type", "field").agg(F.min(F.struct("_o", "_p")).alias("_at"))
    return first.groupBy("alarm_type").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_at", "field"))), lambda x: x["field"]).alias("required")
    )
