"""Queries on scalars, quality checks, roll-ups, previews, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.functions import scalars
from logloom.operators import events, graph, quality, rollup, sampling
from logloom.operators.columns import FIREWALL
from logloom.operators.templates import preprocess
from logloom.queries.base import (
    APP_LINES,
    Rendered,
    TEXT_LINES,
    query,
    sql_null,
    sql_preprocessed,
    sql_strip,
    table,
    text_lines,
)
from logloom.queries.contract import (
    FIREWALL_BUILT,
    STATE_ROWS,
    STATE_SQL,
    accepted_sql,
    assets,
    devices,
    firewall_events,
    flat,
    rejected_sql,
    report_sql,
)
from logloom.queries.fields import FW_SQL, fw_rows
from logloom.queries.graphs import OE, ON, order_graph
from logloom.queries.parsing import ASSIGNED, PRE, app_parsed
from logloom.session import durable, scratch_path
from logloom.sinks import tables as sinks
from logloom.sources import logs
from logloom.sources.events import read_events
from logloom.sources.tables import keyed, read_csv, select_columns
from logloom.streaming import streams

WORDS = Rendered(
    "customer",
    c_custkey="c_custkey",
    raw="CASE c_custkey % 9 WHEN 0 THEN ' N/A ' WHEN 1 THEN 'Unknown' WHEN 2 THEN '?' WHEN 3 THEN '' WHEN 4 THEN concat('  ', c_name, '　') WHEN 5 THEN concat(c_custkey, '.000') WHEN 6 THEN '日志 服务器' WHEN 7 THEN 'nan' ELSE c_mktsegment END",
    other="CASE c_custkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN ' none' ELSE concat('x', c_nationkey) END",
    path="CASE c_custkey % 3 WHEN 0 THEN concat('a b/', c_mktsegment, '.log') WHEN 1 THEN concat('日志/', c_nationkey, '.x.log') ELSE concat('//', c_name) END",
)


@query(
    "norm_scalars",
    f"""SELECT c_custkey, {sql_null('raw')} AS cleaned, lower({sql_null('raw')}) AS lowered, regexp_replace({sql_null('raw')}, '^([+-]?\\d+)\\.0+$', '\\1') AS whole,
        coalesce(nullif({sql_strip('raw')}, ''), nullif({sql_strip('other')}, ''), '') AS filled, coalesce({sql_null('raw')}, {sql_null('other')}) AS known,
        CASE WHEN trim(lower(trim(regexp_replace({sql_strip('raw')}, '[^a-zA-Z0-9]+', '_', 'g'), '_'))) = '' THEN 'generated_log' ELSE lower(trim(regexp_replace({sql_strip('raw')}, '[^a-zA-Z0-9]+', '_', 'g'), '_')) END AS family,
        concat_ws('_', nullif({sql_strip('raw')}, ''), nullif({sql_strip('other')}, '')) AS joined,
        CASE WHEN {sql_strip('raw')} = '' AND {sql_strip('other')} <> '' THEN {sql_strip('other')} ELSE raw END AS kept
    FROM ({WORDS.sql})""",
)
def norm_scalars(spark, sf):
    raw, other = F.col("raw"), F.col("other")
    return WORDS.frame(spark, sf).select(
        "c_custkey", scalars.clean(raw).alias("cleaned"), scalars.clean_lower(raw).alias("lowered"),
        scalars.whole_number(scalars.clean(raw)).alias("whole"), scalars.first_filled(raw, other).alias("filled"),
        scalars.first_known(raw, other).alias("known"), scalars.family_name(raw).alias("family"),
        scalars.join_filled("_", [raw, other]).alias("joined"), scalars.fill(raw, other).alias("kept"),
    )


@query(
    "path_tags",
    """SELECT c_custkey, array_to_string([CASE WHEN trim(regexp_replace(p, '[^0-9A-Za-z]+', '_', 'g'), '_') = '' THEN 'u_' || substr(sha1(p), 1, 10)
        ELSE trim(regexp_replace(p, '[^0-9A-Za-z]+', '_', 'g'), '_') END for p in string_split(regexp_replace(path, '([^/])\\.[^./]+$', '\\1'), '/') if p <> ''], '_') AS tag FROM (%s)""" % WORDS.sql,
)
def path_tags(spark, sf):
    return WORDS.frame(spark, sf).select("c_custkey", scalars.path_tag(F.col("path")).alias("tag"))


@query(
    "known_names",
    """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'brand,' || lower(p_type) ELSE lower(p_type) || ',brand' END AS names FROM part""",
)
def known_names(spark, sf):
    rows = table(spark, sf, "part").selectExpr(
        "p_partkey", "lower(p_type) AS kind",
        "CASE WHEN p_size % 2 = 0 THEN concat(' Brand ,nothing,', p_type, ',brand') ELSE concat(p_type, ',,BRAND,', p_type) END AS listing",
    )
    known = F.array(F.lit("brand"), F.col("kind"))
    return rows.select("p_partkey", scalars.known_names(F.col("listing"), known).alias("names"))


STAMPS = Rendered(
    "events",
    event_id="event_id",
    ts="ts",
    stamp="CASE event_id % 6 WHEN 0 THEN {slash} WHEN 1 THEN {iso} WHEN 2 THEN replace({iso}, ' ', 'T') WHEN 3 THEN concat('audit(', {epoch}, '.5:', event_id, ')') WHEN 4 THEN concat(replace({iso}, ' ', 'T'), '.123Z') ELSE concat('later ', user_id) END",
)


@query(
    "time_scalars",
    f"""SELECT event_id, strftime(CASE WHEN event_id % 6 < 3 THEN date_trunc('second', ts) END, '%Y-%m-%d %H:%M:%S') AS typed,
        CASE WHEN event_id % 6 = 3 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE stamp END AS audit,
        CASE WHEN event_id % 6 IN (1, 2, 4) THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE stamp END AS wall FROM ({STAMPS.sql})""",
)
def time_scalars(spark, sf):
    stamp = F.col("stamp")
    return STAMPS.frame(spark, sf).select(
        "event_id", F.date_format(scalars.event_time(stamp), "yyyy-MM-dd HH:mm:ss").alias("typed"),
        scalars.audit_time(stamp).alias("audit"), scalars.iso_wall_clock(stamp).alias("wall"),
    )


ADDRESSES = Rendered(
    "customer",
    c_custkey="c_custkey",
    address="CASE c_custkey % 8 WHEN 0 THEN 'ANY' WHEN 1 THEN concat('10.0.', c_custkey % 300, '.1') WHEN 2 THEN concat('10.0.0.0/', c_custkey % 40) WHEN 3 THEN concat('fe80::', c_custkey % 9) WHEN 4 THEN '1:2:3:4:5:6:7' WHEN 5 THEN '2001:db8::/32' WHEN 6 THEN '10.1.1.1/255.255.0.0' ELSE c_name END",
)


@query(
    "address_check",
    f"""SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN true WHEN 1 THEN c_custkey % 300 < 256 WHEN 2 THEN c_custkey % 40 <= 32 WHEN 3 THEN true WHEN 5 THEN true WHEN 6 THEN true ELSE false END AS valid FROM ({ADDRESSES.sql})""",
)
def address_check(spark, sf):
    return ADDRESSES.frame(spark, sf).select("c_custkey", scalars.is_address(F.col("address")).alias("valid"))


@query(
    "keyed_dimension",
    """SELECT lower(trim(k)) AS key, arg_max(c_custkey, c_custkey) AS c_custkey FROM (SELECT *, CASE WHEN c_custkey % 10 = 0 THEN ' ' WHEN c_custkey % 2 = 0 THEN concat('Key', c_nationkey) ELSE concat(' kEY', c_nationkey) END AS k FROM customer) WHERE trim(k) <> '' GROUP BY ALL""",
)
def keyed_dimension(spark, sf):
    rows = table(spark, sf, "customer").selectExpr(
        "c_custkey", "c_custkey AS pos",
        "CASE WHEN c_custkey % 10 = 0 THEN ' ' WHEN c_custkey % 2 = 0 THEN concat('Key', c_nationkey) ELSE concat(' kEY', c_nationkey) END AS k",
    )
    return keyed(rows, "k", "pos", casefold=True).select(F.col("_key").alias("key"), F.col("c_custkey").cast("long").alias("c_custkey"))


SOURCES = Rendered(
    "pages",
    page_id="page_id",
    source="concat(CASE page_id % 9 WHEN 0 THEN 'apache2/' WHEN 1 THEN 'VPN/openvpn/' WHEN 2 THEN '防火墙/' WHEN 3 THEN 'x/auth/' WHEN 4 THEN 'dnsmasq/' WHEN 5 THEN '审计/' WHEN 6 THEN 'host/kern.log/' WHEN 7 THEN 'internal/audit/' ELSE 'misc/' END, regexp_extract(url, 'https?://([^#?]*)', 1), '.log')",
    ready="page_id % 3 = 0",
)


def _family_sql(families: dict[str, list[str]], otherwise: str) -> str:
    cells = [f"WHEN {' OR '.join(f'''contains(lower(source), '{m}')''' for m in marks)} THEN '{name}'" for name, marks in families.items()]
    return f"CASE {' '.join(cells)} ELSE {otherwise} END"


STEM = "regexp_replace(regexp_extract(source, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1')"
SNAKE = f"lower(trim(regexp_replace({STEM}, '[^a-zA-Z0-9]+', '_', 'g'), '_'))"


@query(
    "source_family",
    f"""SELECT page_id, {_family_sql(rollup.PARSER_FAMILIES, f"CASE WHEN {SNAKE} = '' THEN 'generated_log' ELSE {SNAKE} END")} AS parser_family,
        {_family_sql(rollup.DISPLAY_FAMILIES, 'NULL')} AS display_family, contains(source, '防火墙') OR contains(lower(source), 'firewall') AS firewall,
        CASE WHEN contains(lower(source), 'audit') THEN 'audit' WHEN contains(lower(source), '/auth/') THEN 'auth' ELSE 'generic' END AS mode FROM ({SOURCES.sql})""",
)
def source_family(spark, sf):
    source = F.col("source")
    return SOURCES.frame(spark, sf).select(
        "page_id", rollup.parser_family(source).alias("parser_family"), rollup.display_family(source).alias("display_family"),
        rollup.is_firewall_output(source, F.lit("")).alias("firewall"), rollup.template_mode(source).alias("mode"),
    )


@query(
    "source_match",
    f"""SELECT page_id FROM ({SOURCES.sql}) WHERE (contains(lower(source), '/en/') OR contains(lower(source), 'openvpn')) AND NOT source LIKE '%/.log'""",
)
def source_match(spark, sf):
    chosen = logs.is_log_source(F.col("source")) & logs.selected_by(F.col("source"), ["/EN/", " openvpn "])
    return SOURCES.frame(spark, sf).filter(chosen).select("page_id")


@query(
    "folder_rollup",
    f"""WITH s AS (SELECT *, string_split(source, '/') AS parts FROM ({SOURCES.sql})),
    a AS (SELECT array_to_string(parts[1:d], '/') AS folder, d = len(parts) - 1 AS direct, ready FROM (SELECT *, unnest(range(1, len(parts))) AS d FROM s))
    SELECT folder, count(*) FILTER (WHERE direct) AS direct_log_count, count(*) AS log_count, count(*) FILTER (WHERE ready) AS ready_count,
        CASE WHEN contains(folder, '/') THEN regexp_replace(folder, '/[^/]*$', '') ELSE '' END AS parent, {_family_sql(rollup.DISPLAY_FAMILIES, "''").replace('source', 'folder')} AS schema_type
    FROM a GROUP BY folder""",
)
def folder_rollup(spark, sf):
    found = rollup.folders(SOURCES.frame(spark, sf))
    return found.select("folder", "direct_log_count", "log_count", "ready_count", "parent", "schema_type")


@query(
    "export_status",
    f"""WITH s AS (SELECT page_id, ready, contains(source, '防火墙') OR page_id % 4 = 1 AS fw, page_id % 5 AS m FROM ({SOURCES.sql}))
    SELECT CASE WHEN NOT ready OR NOT fw OR m = 0 THEN 'skipped' WHEN m = 1 THEN 'failed' ELSE 'generated' END AS status, count(*) AS "count" FROM s GROUP BY ALL""",
)
def export_status(spark, sf):
    rows = SOURCES.frame(spark, sf).selectExpr(
        "source", "ready AS parsed", "CASE WHEN page_id % 4 = 1 THEN 'Firewall' ELSE 'dns' END AS schema_type",
        "CASE WHEN page_id % 5 <> 0 THEN page_id END AS rows", "CASE WHEN page_id % 5 = 1 THEN 'broken' END AS error",
    )
    return rollup.status_counts(rollup.export_status(rows))


@query("run_metrics", f"SELECT source, count(*) AS lines, count(DISTINCT event_id) AS event_count, true AS timed, 'second' AS run FROM ({ASSIGNED}) GROUP BY source")
def run_metrics(spark, sf):
    """Two runs append their metrics, the first over a part of the sources; the last row of every source is read."""
    base = scratch_path(spark, "measured")
    # Two runs and the order of the sources read the parsed lines: they are parsed once.
    parsed = durable(app_parsed(spark, sf)[0].select("source", "line_id", "template", "event_id"))
    first = sinks.write_measured(parsed.filter("source < 'app/p'"), f"{base}/one", f"{base}/metrics", "first")
    second = sinks.write_measured(parsed, f"{base}/two", f"{base}/metrics", "second")
    if not 0 < first < second:
        raise ValueError("the runs were not counted while they were written")
    rows = spark.read.parquet(f"{base}/metrics")
    order = parsed.select("source").distinct().withColumn("rank", F.col("source"))
    last = rollup.latest_in_order(rows, order, "source", "started")
    return last.select("source", "lines", "event_count", (F.col("seconds") > 0).alias("timed"), "run")


@query(
    "summary_order",
    """SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY user_id""",
)
def summary_order(spark, sf):
    """Last event per user, for the users of an ordering table, in its order."""
    rows = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    order = table(spark, sf, "customer").filter("c_custkey % 2 = 0").selectExpr("c_custkey AS user_id", "-c_custkey AS rank")
    return rollup.latest_in_order(rows, order, "user_id", "event_id")


DICTIONARY = Rendered(
    "part",
    dictionary="p_brand",
    row="p_partkey + 1",
    field="CASE p_partkey % 8 WHEN 0 THEN 'Test Field' WHEN 1 THEN 'xxx' WHEN 2 THEN '' WHEN 3 THEN concat('f_', p_size) WHEN 4 THEN 'x' WHEN 5 THEN 'host' ELSE replace(p_name, ' ', '_') END",
    description="CASE WHEN p_size % 5 = 0 THEN '' ELSE repeat('word ', cast(floor(p_size * p_size / 15) as int)) END",
)
FIELD_OK = "field <> ''"
DICT_SQL = f"""WITH d AS (SELECT dictionary, row, trim(field) AS field, trim(description) AS t FROM ({DICTIONARY.sql})),
    p AS (SELECT *, lag(row) OVER (PARTITION BY dictionary, field ORDER BY row) AS previous FROM d WHERE {FIELD_OK}),
    f AS (SELECT dictionary, row, 'error' AS severity, 'field is required' AS "check", field FROM d WHERE field = ''
    UNION ALL SELECT dictionary, row, 'error', 'not lower_snake_case', field FROM d WHERE {FIELD_OK} AND field <> lower(trim(regexp_replace(field, '[^a-zA-Z0-9]+', '_', 'g'), '_'))
    UNION ALL SELECT dictionary, row, 'error', 'not 2-64 characters from a letter on', field FROM d WHERE {FIELD_OK} AND NOT regexp_matches(field, '^[a-z][a-z0-9_]{{1,63}}$')
    UNION ALL SELECT dictionary, row, 'warning', 'no description', field FROM d WHERE {FIELD_OK} AND t = ''
    UNION ALL SELECT dictionary, row, 'warning', 'very short description', field FROM d WHERE {FIELD_OK} AND length(t) BETWEEN 1 AND 11
    UNION ALL SELECT dictionary, row, 'error', 'description too long', field FROM d WHERE {FIELD_OK} AND length(t) > 500
    UNION ALL SELECT dictionary, row, 'warning', 'placeholder name', field FROM d WHERE field IN ('xxx', 'test')
    UNION ALL SELECT dictionary, row, 'error', 'duplicate of row ' || previous, field FROM p WHERE previous IS NOT NULL
    UNION ALL SELECT dictionary, 0, 'warning', 'no graph anchor field', '' FROM d GROUP BY dictionary HAVING NOT bool_or(field = 'host') AND bool_or(field <> '')
    UNION ALL SELECT dictionary, 0, 'error', 'no field', '' FROM d GROUP BY dictionary HAVING NOT bool_or(field <> '')
    UNION ALL SELECT dictionary, 0, 'warning', 'too many fields', '' FROM d WHERE {FIELD_OK} GROUP BY dictionary HAVING count(DISTINCT field) > 80)
    SELECT * FROM f"""


@query("dict_check", DICT_SQL)
def dict_check(spark, sf):
    return quality.dictionary_findings(DICTIONARY.frame(spark, sf))


@query("dict_severity", f'SELECT severity, count(*) AS "count" FROM ({DICT_SQL}) GROUP BY severity')
def dict_severity(spark, sf):
    return quality.severity_counts(quality.dictionary_findings(DICTIONARY.frame(spark, sf)))


SNAKE_FIELD = "lower(trim(regexp_replace(trim(field), '[^a-zA-Z0-9]+', '_', 'g'), '_'))"
CLEAN = f"SELECT dictionary, {SNAKE_FIELD} AS field, min(row) AS row, arg_min(trim(description), row) AS description FROM ({DICTIONARY.sql}) WHERE {SNAKE_FIELD} <> '' GROUP BY ALL"


@query("schema_cleanup", CLEAN)
def schema_cleanup(spark, sf):
    return quality.clean_dictionary(DICTIONARY.frame(spark, sf)).select("dictionary", "field", "row", "description")


@query(
    "relation_cleanup",
    f"""WITH k AS ({CLEAN}), r AS (SELECT p_partkey, p_brand AS dictionary, lower(replace(p_name, ' ', '_')) AS s, CASE WHEN p_size % 2 = 0 THEN 'host' ELSE 'gone' END AS o FROM part WHERE p_partkey % 6 <> 0)
    SELECT p_partkey, dictionary, s AS subject_id_source, o AS object_id_source, 'host' || CASE WHEN s <> 'host' THEN ',' || s ELSE '' END AS edge_properties FROM r
    WHERE EXISTS (SELECT 1 FROM k WHERE k.dictionary = r.dictionary AND k.field = s) AND EXISTS (SELECT 1 FROM k WHERE k.dictionary = r.dictionary AND k.field = o)""",
)
def relation_cleanup(spark, sf):
    """Relations between part names and hosts, kept where their brand's dictionary has both."""
    fields = quality.clean_dictionary(DICTIONARY.frame(spark, sf))
    rows = table(spark, sf, "part").selectExpr(
        "p_partkey", "p_brand AS dictionary", "upper(p_name) AS subject_id_source",
        "CASE WHEN p_size % 2 = 0 THEN 'Host' ELSE 'gone' END AS object_id_source",
        "CASE WHEN p_partkey % 6 = 0 THEN '' ELSE 'USES' END AS predicate", "concat('HOST, missing,', p_name, ',host') AS edge_properties",
    )
    return quality.clean_relations(rows, fields).select("p_partkey", "dictionary", "subject_id_source", "object_id_source", "edge_properties")


@query(
    "dict_missing_refs",
    f"""SELECT DISTINCT p_brand AS dictionary, lower(replace(p_name, ' ', '_')) AS field FROM part WHERE (p_brand, lower(replace(p_name, ' ', '_'))) NOT IN (SELECT (dictionary, field) FROM ({DICTIONARY.sql}))""",
)
def dict_missing_refs(spark, sf):
    refs = table(spark, sf, "part").selectExpr("p_brand AS dictionary", "upper(p_name) AS field")
    return quality.missing_references(refs, DICTIONARY.frame(spark, sf))


@query(
    "preflight",
    """WITH c AS (SELECT event_type AS dataset, count(*) AS s, count(*) FILTER (WHERE value > 1) AS p, count(DISTINCT user_id) AS q FROM events GROUP BY ALL)
    SELECT dataset, 'warning' AS severity, 'source ' || s || ' differs from params ' || p AS finding FROM c WHERE s <> p
    UNION ALL SELECT dataset, 'issue', 'missing mapped' FROM c WHERE dataset = 'view'
    UNION ALL SELECT dataset, 'warning', 'pairs ' || q || ' differs from mapped ' || (q + 1) FROM c WHERE dataset <> 'view'""",
)
def preflight(spark, sf):
    events = table(spark, sf, "events")
    counted = events.groupBy(F.col("event_type").alias("dataset")).agg(
        F.count(F.lit(1)).alias("source"), F.count(F.when(F.col("value") > 1, 1)).alias("params"),
        F.count_distinct("user_id").alias("pairs"),
    ).withColumn("mapped", F.when(F.col("dataset") != "view", F.col("pairs") + 1))
    long = counted.select(
        "dataset", F.explode(F.create_map(*[x for c in ("source", "params", "pairs", "mapped") for x in (F.lit(c), F.col(c))])).alias("artifact", "items")
    )
    return quality.parity(long, [("source", "params"), ("pairs", "mapped")])


@query(
    "artifact_counts",
    """SELECT 'orders' AS artifact, count(*) AS rows, 6::BIGINT AS column_count FROM orders UNION ALL SELECT 'lineitem', count(*), 11 FROM lineitem UNION ALL SELECT 'pages', count(*), 3 FROM pages""",
)
def artifact_counts(spark, sf):
    parts = [quality.table_status(table(spark, sf, n), n) for n in ("orders", "lineitem", "pages")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "preview_lines",
    f"""SELECT source, line_id, original_content, (SELECT count(*) FROM ({TEXT_LINES})) > 40 AS truncated FROM ({TEXT_LINES}) ORDER BY source, line_id LIMIT 40""",
)
def preview_lines(spark, sf):
    """The preview's own limit: 40 lines and whether there are more."""
    rows, more = graph.capped(text_lines(spark, sf), ["source", "line_id"], 40)
    flag = more.first()["truncated"]
    return rows.withColumn("truncated", F.lit(flag))


AUDIT_KEYS_SQL = f"""SELECT line_id, CASE WHEN original_content LIKE 'type=%' THEN regexp_replace(content, '^(type=[^ ]+) msg=audit: ', '\\1: ') ELSE content END AS audit_key,
    CASE WHEN contains(content, ': ') THEN regexp_replace(string_split(content, ': ')[1], '\\[[^\\]]*\\]', '[<*>]', 'g') || ': ' || 'rest <*>' ELSE 'any: rest <*>' END AS prefixed FROM ({PRE})"""


@query("template_keys", AUDIT_KEYS_SQL)
def template_keys(spark, sf):
    """Template keys of audit lines and of prefixed lines."""
    rows = preprocess(APP_LINES.frame(spark, sf))
    return rows.select(
        "line_id", sampling.audit_key(F.col("content")).alias("audit_key"),
        sampling.prefixed_key(F.lit("any: rest <*>"), F.col("content")).alias("prefixed"),
    )


@query(
    "bank_keys",
    """SELECT event_id, concat('h', user_id % 3, ' app[<*>]: ', event_type) AS auth_key, concat('dnsmasq[<*>]: ', event_type) AS dns_key, concat(event_type, ': x <*>') AS audit_key FROM events""",
)
def bank_keys(spark, sf):
    rows = table(spark, sf, "events").selectExpr(
        "event_id", "concat('h', user_id % 3, ' ') AS component", "concat('app[', user_id, ']') AS proto", "event_type",
        "concat(' dnsmasq[', user_id, ']') AS server",
    )
    kind = F.col("event_type")
    return rows.select(
        "event_id", sampling.template_key("auth", kind, component=F.col("component"), proto=F.col("proto")).alias("auth_key"),
        sampling.template_key("dns", kind, component=F.col("server")).alias("dns_key"),
        sampling.template_key("audit", F.lit("x <*>"), type=kind).alias("audit_key"),
    )


# Lines of each family for a bank; ids and processes repeat, and some event ids are blank.
BANK_LINES = Rendered(
    "events",
    line_id="event_id",
    Component="concat('h', user_id % 3, ' ')",
    Proto="concat('app', user_id % 2, '[', user_id, ']')",
    Server="concat(' dnsmasq[', user_id % 50, ']')",
    Type="concat('type=', upper(event_type))",
    EventTemplate="concat(event_type, ' of <*> ', user_id % 2)",
    Content="CASE WHEN event_id % 23 = 0 THEN '  ' ELSE concat(event_type, ' of ', user_id % 40, ' ', user_id % 2) END",
    EventId="CASE WHEN user_id % 7 = 0 THEN ' ' ELSE concat('E', event_type, user_id % 4, ' ') END",
)
BANK_PARTS = {
    "auth": (["Component", "Proto"], "trim(Component) || ' ' || {proto}", "trim(Component) || ' ' || Proto"),
    "syslog": (["Component", "Proto"], "trim(Component) || ' ' || {proto}", "trim(Component) || ' ' || Proto"),
    "dns": (["Server"], "{server}", "trim(Server)"),
    "audit": (["Type"], "Type", "Type"),
}


def bank_sql(mode: str) -> str:
    _, key, context = BANK_PARTS[mode]
    key = key.format(proto=r"regexp_replace(Proto, '\[[^\]]*\]', '[<*>]', 'g')", server=r"trim(regexp_replace(Server, '\[[^\]]*\]', '[<*>]', 'g'))")
    auth = mode == "auth"
    event = "trim(EventId)" if auth else "EventId"
    grouped = "CASE WHEN event_id = '' THEN 't' || template ELSE 'e' || event_id END" if auth else "'t' || template"
    units = "SELECT g, sample, min(line_id) AS line_id FROM s GROUP BY ALL" if auth else "SELECT g, sample, line_id FROM s"
    digest = "md5('42::' || g || '::' || sample)" if auth else "md5('42::' || g || '::' || sample || '::' || line_id)"
    return f"""WITH l AS ({BANK_LINES.sql}),
    s AS (SELECT *, {grouped} AS g FROM (SELECT line_id, {key} || ': ' || EventTemplate AS template, {context} || ': ' || Content AS sample, {event} AS event_id
        FROM l WHERE trim(Content) <> '')),
    n AS (SELECT g, arg_min(template, line_id) AS template, arg_min(event_id, line_id) AS event_id, min(line_id) AS began FROM s GROUP BY g),
    m AS (SELECT template, arg_max(g, began) AS g, arg_max(event_id, began) AS event_id FROM n GROUP BY template),
    r AS (SELECT g, sample, row_number() OVER (PARTITION BY g ORDER BY {digest}, line_id) AS k FROM ({units}))
    SELECT m.template, string_agg(sample, '|' ORDER BY k) AS samples, any_value(m.event_id) AS event_id FROM m JOIN r USING (g) WHERE k <= 3 GROUP BY m.template"""


def bank(mode: str):
    def run(spark, sf):
        names = BANK_PARTS[mode][0]
        shown = [F.col(n).alias("Component" if n == "Server" else n) for n in names]
        lines = BANK_LINES.frame(spark, sf).select("line_id", *shown, "EventTemplate", "Content", "EventId")
        # Only syslog has to be named: its columns are those of auth.
        found = sampling.template_bank(lines, mode if mode == "syslog" else "auto")
        return found.select("template", F.array_join("samples", "|").alias("samples"), "event_id")

    run.__doc__ = f"Sample bank of {mode} lines."
    return run


for _mode in BANK_PARTS:
    query(f"bank_{_mode}", bank_sql(_mode))(bank(_mode))


# Sinks: written to the shared folder and read again.


@query("sink_params_csv", FW_SQL)
def sink_params_csv(spark, sf):
    """Params as CSV per source, read back by column name in any case."""
    path = scratch_path(spark, "params")
    sinks.write_csv(fw_rows(spark, sf), path, ["source_row", *FIREWALL], by=("source",))
    back = select_columns(read_csv(spark, path), ["source", "source_row", *[c.upper() for c in FIREWALL]])
    return back.select("source", F.col("source_row").cast("long").alias("source_row"), *[F.col(c.upper()).alias(c) for c in FIREWALL])


@query("sink_graph", f"SELECT * FROM ({ON}) UNION ALL SELECT concat_ws('|', start_label, predicate, end_label), concat_ws('|', start_id, end_id), key, value FROM ({OE})")
def sink_graph(spark, sf):
    """Nodes and edges written with JSON properties and read back."""
    path = scratch_path(spark, "graph")
    sinks.write_graph(order_graph(spark, sf), path)
    nodes, edges = sinks.read_graph(spark, path)
    flat_edges = edges.select(
        F.concat_ws("|", "start_label", "predicate", "end_label").alias("label"),
        F.concat_ws("|", "start_id", "end_id").alias("id"), F.explode_outer("properties").alias("key", "value"),
    )
    return graph.property_rows(nodes, graph.NODE).unionByName(flat_edges)


@query("sink_events", f"SELECT alarm_type, src_ip, dst_ip, login_account, time FROM ({accepted_sql(FIREWALL_BUILT)})")
def sink_events(spark, sf):
    """Accepted events, rejected rows and report as JSON; the accepted ones read back."""
    back = read_events(spark, f"{written_events(spark, sf)}/{sinks.EVENTS_NAME}", name="part-*")
    return back.select("alarm_type", *[F.coalesce(F.try_element_at("data", F.lit(f)), F.lit("")).alias(f) for f in ("src_ip", "dst_ip", "login_account", "time")])


def written_events(spark, sf):
    """Folder of the events, rejected rows and report of the firewall rows, made in one evaluation."""
    made = events.export(fw_rows(spark, sf), assets(spark, sf), devices(spark, sf), stored=True)
    folder = scratch_path(spark, "events")
    return sinks.write_events(made.accepted, made.rejected, events.report(made), [folder, folder + "/"], arrays=True)[0]


@query("sink_rejected", f"SELECT source, source_row, reason FROM ({rejected_sql(FIREWALL_BUILT)})")
def sink_rejected(spark, sf):
    """Rejected rows as they were written beside the events."""
    back = spark.read.schema("source string, source_row long, reason string").json(f"{written_events(spark, sf)}/{sinks.REJECTED_NAME}")
    return back


@query("sink_report", report_sql(FIREWALL_BUILT))
def sink_report(spark, sf):
    """The report as it was written beside the events."""
    return spark.read.schema(events.REPORT_SCHEMA).json(f"{written_events(spark, sf)}/{sinks.REPORT_NAME}")


@query("event_json_scan", "SELECT cast(1 + c_custkey % 4 AS INT) AS alarm_type, c_name AS src_ip, '' AS dst_ip FROM customer")
def event_json_scan(spark, sf):
    """JSON documents below a folder as flat events."""
    path = scratch_path(spark, "json")
    rows = table(spark, sf, "customer").selectExpr("cast(1 + c_custkey % 4 AS int) AS alarm_type", "map('src_ip', c_name) AS data")
    rows.write.json(path)
    from logloom.sources.events import flat_events

    back = read_events(spark, path, arrays=False)
    return flat_events(back, ["src_ip", "dst_ip"])


@query("sink_counts", f'SELECT content, 2 * count(*) AS total, 2 AS times FROM ({PRE}) GROUP BY content')
def sink_counts(spark, sf):
    """Counts appended twice, as two runs would do."""
    path = scratch_path(spark, "counts")
    rows = preprocess(APP_LINES.frame(spark, sf)).select("content")
    sinks.append_counts(rows, path)
    sinks.append_counts(rows, path)
    back = spark.read.parquet(path)
    return back.groupBy("content").agg(F.sum("count").alias("total"), F.count(F.lit(1)).cast("int").alias("times"))


@query(
    "sink_overwrite",
    "SELECT event_type AS source, event_id, CASE WHEN event_type = 'view' THEN 'new' ELSE 'old' END AS run FROM events",
)
def sink_overwrite(spark, sf):
    """A second run replaces only the source it writes."""
    path = scratch_path(spark, "runs")
    rows = table(spark, sf, "events").selectExpr("event_type AS source", "event_id")
    sinks.write_by_source(rows.withColumn("run", F.lit("old")), path)
    sinks.write_by_source(rows.filter("source = 'view'").withColumn("run", F.lit("new")), path)
    return spark.read.parquet(path).select("source", "event_id", "run")


@query(
    "numbered_files",
    f"""SELECT original_content, count(*) AS "count"
    FROM (SELECT unnest(string_split(original_content, chr(13))) AS original_content FROM ({TEXT_LINES}))
    WHERE {sql_strip('original_content')} <> '' GROUP BY ALL""",
)
def numbered_files(spark, sf):
    """Lines written as text files and read back, where CR ends a line too; each file's numbers run from 1 to its count."""
    path = scratch_path(spark, "text")
    text_lines(spark, sf).select("original_content").write.text(path)
    back = logs.read_lines(spark, path, names=r"part-.*")
    gaps = back.groupBy("source").agg(F.max("line_id").alias("last"), F.count_distinct("line_id").alias("n")).filter("last <> n")
    if not gaps.isEmpty():
        raise ValueError("line numbers of a file have gaps")
    return back.groupBy("original_content").agg(F.count(F.lit(1)).alias("count"))


# Streams: the same rows as files, read as one stream and drained.


@query("stream_extract", f'SELECT "timestamp", content, count(*) AS "count" FROM ({sql_preprocessed(APP_LINES.sql)}) GROUP BY ALL')
def stream_extract(spark, sf):
    base = scratch_path(spark, "stream")
    APP_LINES.frame(spark, sf).select("original_content").write.text(f"{base}/in")
    ready = streams.preprocessed_stream(streams.read_line_stream(spark, f"{base}/in"))
    running = (
        ready.writeStream.format("parquet").option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True).start(f"{base}/out")
    )
    running.awaitTermination()
    back = spark.read.parquet(f"{base}/out")
    return back.groupBy("timestamp", "content").agg(F.count(F.lit(1)).alias("count"))


@query("stream_state", STATE_SQL)
def stream_state(spark, sf):
    """Rule state kept by a stream over one drained input."""
    base = scratch_path(spark, "state")
    rows = STATE_ROWS.frame(spark, sf).withColumn("time", F.col("ts").cast("timestamp")).withColumn("default_policy_type", F.lit(None).cast("string"))
    rows.drop("ts").write.parquet(f"{base}/in")
    changes = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).parquet(f"{base}/in")
    running = (
        streams.rule_state_stream(changes).writeStream.format("parquet").option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True).start(f"{base}/out")
    )
    running.awaitTermination()
    return spark.read.parquet(f"{base}/out")
