"""Queries on rule evaluation and knowledge graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.functions.conditions import compile_condition
from logloom.operators import graph, quality
from logloom.queries.base import Rendered, query, sql_null, table
from logloom.session import scratch_path
from logloom.sinks import tables as sinks
from logloom.sources.rules import rule_table, rules_from_lines

ORDER_RULES = rules_from_lines(
    """
    Process; pid; RUNS_ON; Host; host; event_type,outcome; pid not null AND host not null
    User; user; PERFORMS; Action; event_action; outcome,time; user not null AND event_action in (add, 'del')
    IP; src_ip; CONNECTS; Host; host; ; src_ip not null and amount > 250000
    User; user; USES; Session; session_id; event_type; event_type == 'order' AND status != F
    User; user; FROM_IP; IP; src_ip; time,outcome; user indicates r1 AND outcome not indicates succ
    Session; session_id; ON_TTY; Terminal; tty; ; tty is null
    Host; host; PART_OF; Region; region; ; always
    Process; pid; PARENT_OF; Process; ppid; ; ppid not null AND severity is null
    """
)
EVENT_RULES = rules_from_lines(
    """
    User; user; PERFORMS; Action; event_action; k,time; user not null
    User; user; TOUCHES; Object; object_name; value; value >= 40 AND event_type in (purchase,click)
    Domain; qname; OWNED_BY; User; user; ; event_type not indicates view
    """
)

ORDER_CELLS = {
    "row_id": "o_orderkey",
    "user": "concat('User', o_custkey % 40)",
    "host": "concat('NATION_', o_custkey % 25)",
    "pid": "concat(o_custkey % 90, '.0')",
    "ppid": "CASE WHEN o_orderkey % 9 = 0 THEN '?' ELSE concat(o_custkey % 7, '') END",
    "event_type": "CASE WHEN o_orderkey % 5 = 0 THEN 'return' ELSE ' Order ' END",
    "event_action": "CASE o_orderkey % 4 WHEN 0 THEN 'add' WHEN 1 THEN 'DEL' WHEN 2 THEN 'set' ELSE 'n/a' END",
    "outcome": "CASE o_orderkey % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'Success' ELSE 'failure' END",
    "src_ip": "CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE concat('10.0.', o_custkey % 5, '.', o_custkey % 60) END",
    "amount": "cast(cast(floor(o_totalprice) as bigint) as string)",
    "session_id": "concat(o_orderkey % 70, '.00')",
    "tty": "CASE WHEN o_orderkey % 2 = 0 THEN 'pts/1' ELSE 'none' END",
    "status": "o_orderstatus",
    "region": "concat('REGION_', o_custkey % 5)",
    "time": "{day}",
}
EVENT_CELLS = {
    "row_id": "event_id",
    "user": "concat('USER', user_id % 60)",
    "event_action": "event_type",
    "event_type": "event_type",
    "object_name": "concat('obj', regexp_extract(props, '([0-9]+)', 1))",
    "qname": "concat('H', user_id % 11, '.Example.org')",
    "value": "cast(cast(floor(value) as bigint) as string)",
    "k": "regexp_extract(props, '([0-9]+)', 1)",
    "time": "{iso}",
}
ORDER_PARAMS = Rendered("orders", **ORDER_CELLS)
EVENT_PARAMS = Rendered("events", **EVENT_CELLS)


def N(c: str) -> str:  # noqa: N802
    return f"({sql_null(c)})"


def W(c: str) -> str:  # noqa: N802
    return f"regexp_replace({N(c)}, '^([+-]?\\d+)\\.0+$', '\\1')"


PID = f"coalesce({N('host')}, '') || '|' || {W('pid')}"
PPID = f"coalesce({N('host')}, '') || '|' || {W('ppid')}"
# rule, condition, start label, id, properties, predicate, end label, id, properties, edge properties
ORDER_FACTS = [
    (1, f"{N('pid')} IS NOT NULL AND {N('host')} IS NOT NULL", "Process", PID, {"process": PID, "pid": W("pid"), "host": N("host")}, "RUNS_ON", "Host", N("host"), {"host": N("host")}, ["event_type", "outcome"]),
    (2, f"{N('user')} IS NOT NULL AND lower({N('event_action')}) IN ('add', 'del')", "User", f"lower({N('user')})", {"user": f"lower({N('user')})"}, "PERFORMS", "Action", N("event_action"), {"event_action": N("event_action")}, ["outcome", "time"]),
    (3, f"{N('src_ip')} IS NOT NULL AND cast({N('amount')} AS DOUBLE) > 250000", "IP", N("src_ip"), {"ip": N("src_ip")}, "CONNECTS", "Host", N("host"), {"host": N("host")}, []),
    (4, f"lower({N('event_type')}) = 'order' AND lower({N('status')}) <> 'f'", "User", f"lower({N('user')})", {"user": f"lower({N('user')})"}, "USES", "Session", W("session_id"), {"session_id": W("session_id")}, ["event_type"]),
    (5, f"lower({N('user')}) LIKE '%r1%' AND lower({N('outcome')}) NOT LIKE '%succ%'", "User", f"lower({N('user')})", {"user": f"lower({N('user')})"}, "FROM_IP", "IP", N("src_ip"), {"ip": N("src_ip")}, ["time", "outcome"]),
    (6, f"{N('tty')} IS NULL", "Session", W("session_id"), {"session_id": W("session_id")}, "ON_TTY", "Terminal", N("tty"), {"terminal": N("tty")}, []),
    (7, "true", "Host", N("host"), {"host": N("host")}, "PART_OF", "Region", N("region"), {"region": N("region")}, []),
    (8, f"{N('ppid')} IS NOT NULL", "Process", PID, {"process": PID, "pid": W("pid"), "host": N("host")}, "PARENT_OF", "Process", PPID, {"process": PPID, "pid": W("ppid"), "host": N("host")}, []),
]
USER = f"lower({N('user')})"
EVENT_FACTS = [
    (1, f"{N('user')} IS NOT NULL", "User", USER, {"user": USER}, "PERFORMS", "Action", N("event_action"), {"event_action": N("event_action")}, ["k", "time"]),
    (2, f"cast({N('value')} AS DOUBLE) >= 40 AND {N('event_type')} IN ('purchase', 'click')", "User", USER, {"user": USER}, "TOUCHES", "Object", N("object_name"), {"object_name": N("object_name")}, ["value"]),
    (3, f"{N('event_type')} NOT LIKE '%view%'", "Domain", f"lower({N('qname')})", {"qname": f"lower({N('qname')})"}, "OWNED_BY", "User", USER, {"user": USER}, []),
]


def sql_hits(facts: list, params: str) -> str:
    rules = len(facts)
    parts = []
    for n, cond, sl, sid, _, pred, el, eid, _, _ in facts:
        parts.append(
            f"SELECT *, 'R{n}' AS rule_id, row_id * {rules} + {n - 1} AS ord, '{sl}' AS start_label, {sid} AS start_id, "
            f"'{pred}' AS predicate, '{el}' AS end_label, {eid} AS end_id FROM ({params}) "
            f"WHERE {cond} AND {sid} IS NOT NULL AND {eid} IS NOT NULL"
        )
    return " UNION ALL ".join(parts)


def sql_nodes(facts: list, params: str) -> str:
    """Rows (label, id, key, value): first value of every property."""
    hits = sql_hits(facts, params)
    parts = []
    for n, _, sl, _, sp, _, el, _, ep, _ in facts:
        for label, side, props, shift in ((sl, "start", sp, 0), (el, "end", ep, 1)):
            for key, value in props.items():
                parts.append(
                    f"SELECT '{label}' AS label, {side}_id AS id, '{key}' AS key, {value} AS value, ord * 2 + {shift} AS o "
                    f"FROM h WHERE rule_id = 'R{n}'"
                )
    return (
        f"WITH h AS ({hits}) SELECT label, id, key, arg_min(value, o) AS value FROM ({' UNION ALL '.join(parts)}) "
        "WHERE value IS NOT NULL GROUP BY label, id, key"
    )


def sql_edges(facts: list, params: str) -> str:
    """Rows (five key columns, key, value); NULL key for edges without properties."""
    hits = sql_hits(facts, params)
    e = "start_label, start_id, predicate, end_label, end_id"
    parts = [f"SELECT DISTINCT {e}, cast(NULL AS VARCHAR) AS key, cast(NULL AS VARCHAR) AS value, 0 AS o FROM h"]
    for n, *_, fields in facts:
        for field in fields:
            parts.append(f"SELECT {e}, '{field}' AS key, {N(field)} AS value, ord AS o FROM h WHERE rule_id = 'R{n}' AND {N(field)} IS NOT NULL")
    return (
        f"WITH h AS ({hits}), f AS (SELECT {e}, key, arg_min(value, o) AS value FROM ({' UNION ALL '.join(parts)}) GROUP BY {e}, key), "
        f"w AS (SELECT *, count(key) OVER (PARTITION BY {e}) AS n FROM f) SELECT {e}, key, value FROM w WHERE key IS NOT NULL OR n = 0"
    )


def order_graph(spark, sf, rules=ORDER_RULES):
    return graph.build_graph(ORDER_PARAMS.frame(spark, sf), rules, "row_id")


def order_edges(spark, sf, steps):
    """Edges that steps of a path may take: the other rules are not evaluated."""
    return order_graph(spark, sf, graph.rules_for(ORDER_RULES, steps)).edges


def event_graph(spark, sf):
    return graph.build_graph(EVENT_PARAMS.frame(spark, sf), EVENT_RULES, "row_id")


ON, OE = sql_nodes(ORDER_FACTS, ORDER_PARAMS.sql), sql_edges(ORDER_FACTS, ORDER_PARAMS.sql)
EN, EE = sql_nodes(EVENT_FACTS, EVENT_PARAMS.sql), sql_edges(EVENT_FACTS, EVENT_PARAMS.sql)
KEYS = "start_label, start_id, predicate, end_label, end_id"


@query(
    "kg_flagship",
    f"""SELECT predicate, end_label, end_id, count(*) AS edges FROM (SELECT DISTINCT {KEYS} FROM ({EE})) GROUP BY ALL""",
)
def kg_flagship(spark, sf):
    """Edges per predicate and target in the graph of the event table."""
    edges = event_graph(spark, sf).edges
    return edges.groupBy("predicate", "end_label", "end_id").agg(F.count(F.lit(1)).alias("edges"))


@query("kg_nodes", ON)
def kg_nodes(spark, sf):
    return graph.property_rows(order_graph(spark, sf).nodes, graph.NODE)


@query("kg_edges", OE)
def kg_edges(spark, sf):
    return graph.property_rows(order_graph(spark, sf).edges, graph.EDGE)


@query("kg_rule_hits", f"SELECT rule_id, count(*) AS hits FROM ({sql_hits(ORDER_FACTS, ORDER_PARAMS.sql)}) GROUP BY rule_id")
def kg_rule_hits(spark, sf):
    return graph.hit_counts(order_graph(spark, sf))


def fused(spark, sf):
    parts = {"orders": order_graph(spark, sf), "events": event_graph(spark, sf)}
    return graph.fuse(parts, [*EVENT_RULES, *ORDER_RULES])


def _fused_sql(keys: str, first: str, second: str) -> str:
    return f"""SELECT {keys}, key, arg_min(value, p) AS value, any_value(sources) AS sources FROM (
        SELECT {keys}, key, value, 0 AS p FROM ({first}) UNION ALL SELECT {keys}, key, value, 1 FROM ({second}))
        JOIN (SELECT {keys}, string_agg(name, ',' ORDER BY p) AS sources FROM (
            SELECT DISTINCT {keys}, 0 AS p, 'events' AS name FROM ({first}) UNION ALL SELECT DISTINCT {keys}, 1, 'orders' FROM ({second}))
            GROUP BY {keys}) USING ({keys}) GROUP BY {keys}, key"""


@query("kg_fuse_nodes", _fused_sql("label, id", EN, ON))
def kg_fuse_nodes(spark, sf):
    nodes = fused(spark, sf).nodes
    return nodes.select(*graph.NODE, F.explode_outer("properties").alias("key", "value"), F.array_join("sources", ",").alias("sources"))


FUSED_EDGES = _fused_sql(KEYS, EE, OE)


@query(
    "kg_fuse_edges",
    f"SELECT * EXCLUDE (n) FROM (SELECT *, count(key) OVER (PARTITION BY {KEYS}) AS n FROM ({FUSED_EDGES})) WHERE key IS NOT NULL OR n = 0",
)
def kg_fuse_edges(spark, sf):
    edges = fused(spark, sf).edges
    return edges.select(*graph.EDGE, F.explode_outer("properties").alias("key", "value"), F.array_join("sources", ",").alias("sources"))


@query(
    "kg_fuse_hits",
    f"""SELECT 'events:' || rule_id AS rule_id, count(*) AS hits FROM ({sql_hits(EVENT_FACTS, EVENT_PARAMS.sql)}) GROUP BY ALL
    UNION ALL SELECT 'orders:' || rule_id, count(*) FROM ({sql_hits(ORDER_FACTS, ORDER_PARAMS.sql)}) GROUP BY ALL""",
)
def kg_fuse_hits(spark, sf):
    return fused(spark, sf).hits


DN = f"SELECT DISTINCT label, id FROM ({ON})"
DE = f"SELECT DISTINCT {KEYS} FROM ({OE})"


@query(
    "kg_summary",
    f"""WITH n AS ({DN}), e AS ({DE})
    SELECT 'node' AS part, '' AS name, count(*) AS "count" FROM n UNION ALL SELECT 'edge', '', count(*) FROM e
    UNION ALL SELECT 'node_label', label, c FROM (SELECT label, count(*) AS c FROM n GROUP BY label ORDER BY c DESC, label LIMIT 12)
    UNION ALL SELECT 'edge_predicate', predicate, c FROM (SELECT predicate, count(*) AS c FROM e GROUP BY predicate ORDER BY c DESC, predicate LIMIT 12)""",
)
def kg_summary(spark, sf):
    built = order_graph(spark, sf)
    return graph.summary(built.nodes, built.edges)


@query(
    "kg_schema_nodes",
    f"""SELECT label, count(DISTINCT id) AS "count", string_agg(DISTINCT key, ',' ORDER BY key) AS properties FROM ({ON}) GROUP BY label""",
)
def kg_schema_nodes(spark, sf):
    found = graph.node_schema(order_graph(spark, sf).nodes)
    return found.select("label", "count", F.array_join("properties", ",").alias("properties"))


@query(
    "kg_schema_edges",
    f"""SELECT start_label, predicate, end_label, count(DISTINCT start_id || chr(1) || end_id) AS "count",
        coalesce(string_agg(DISTINCT key, ',' ORDER BY key), '') AS properties FROM ({OE}) GROUP BY ALL""",
)
def kg_schema_edges(spark, sf):
    found = graph.edge_schema(order_graph(spark, sf).edges)
    return found.select("start_label", "predicate", "end_label", "count", F.array_join("properties", ",").alias("properties"))


CUSTOMER_NODES = "SELECT 'User' AS label, concat('user', c_custkey) AS id FROM customer"


def customer_nodes(spark, sf):
    rows = table(spark, sf, "customer")
    return rows.selectExpr("'User' AS label", "concat('user', c_custkey) AS id", "map('name', c_name) AS properties")


@query(
    "kg_isolated",
    f"""SELECT label, id FROM ({CUSTOMER_NODES}) EXCEPT SELECT label, id FROM (
        SELECT start_label AS label, start_id AS id FROM ({DE}) UNION SELECT end_label, end_id FROM ({DE}))""",
)
def kg_isolated(spark, sf):
    """Customers no edge of the order graph touches."""
    return graph.isolated(customer_nodes(spark, sf), order_graph(spark, sf).edges).select("label", "id")


NATION_NODES = "SELECT 'Host' AS label, n_name AS id FROM nation UNION ALL SELECT 'User', concat('user', c_custkey) FROM customer"


def nation_nodes(spark, sf):
    hosts = table(spark, sf, "nation").selectExpr("'Host' AS label", "n_name AS id", "map('name', n_name) AS properties")
    return hosts.unionByName(customer_nodes(spark, sf))


@query(
    "kg_dangling",
    f"""WITH e AS ({DE}), n AS ({NATION_NODES})
    SELECT {KEYS}, 'start' AS side FROM e WHERE (start_label, start_id) NOT IN (SELECT (label, id) FROM n)
    UNION ALL SELECT {KEYS}, 'end' FROM e WHERE (end_label, end_id) NOT IN (SELECT (label, id) FROM n)""",
)
def kg_dangling(spark, sf):
    found = graph.dangling(order_graph(spark, sf).edges, nation_nodes(spark, sf))
    return found.select(*graph.EDGE, "side")


@query(
    "kg_endpoints",
    f"""WITH e AS ({DE}), n AS ({NATION_NODES})
    SELECT {KEYS} FROM e WHERE (start_label, start_id) IN (SELECT (label, id) FROM n) AND (end_label, end_id) IN (SELECT (label, id) FROM ({DN}))""",
)
def kg_endpoints(spark, sf):
    """Edges whose start is a known nation or customer and whose end is a node of the graph."""
    built = order_graph(spark, sf)
    nodes = built.nodes.select("label", "id")
    starts = nation_nodes(spark, sf).select(F.col("label").alias("start_label"), F.col("id").alias("start_id"))
    edges = built.edges.join(starts, ["start_label", "start_id"], "left_semi")
    return graph.with_endpoints(edges, nodes).select(*graph.EDGE)


FIND = "user1"


@query(
    "kg_find",
    f"""WITH e AS (SELECT {KEYS}, coalesce(max(CASE WHEN key = 'outcome' THEN value END), '') AS outcome, coalesce(max(CASE WHEN key = 'time' THEN value END), '') AS t FROM ({OE}) WHERE predicate = 'PERFORMS' GROUP BY ALL)
    SELECT {KEYS} FROM e WHERE contains(lower(concat_ws(' ', start_label, start_id, predicate, end_label, end_id, outcome, t)), '{FIND}')
    ORDER BY start_label, start_id, predicate, end_label, end_id LIMIT 20""",
)
def kg_find(spark, sf):
    """The lookup's own limit: the first 20 matching edges."""
    built = order_graph(spark, sf)
    return graph.find(built.nodes, built.edges, predicate="performs", contains="USER1").select(*graph.EDGE)


@query(
    "kg_pattern",
    f"""WITH e AS ({DE}) SELECT a.start_id AS child, a.end_id AS parent, b.end_id AS host, c.end_id AS region
    FROM e a JOIN e b ON a.start_id = b.start_id JOIN e c ON b.end_id = c.start_id
    WHERE a.predicate = 'PARENT_OF' AND b.predicate = 'RUNS_ON' AND c.predicate = 'PART_OF' AND a.start_id <> a.end_id""",
)
def kg_pattern(spark, sf):
    """Parent, child, host and region of every process: a three-step path with a reused node."""
    steps = [
        graph.Step("child", "Process", "PARENT_OF", "parent", "Process"),
        graph.Step("child", "Process", "RUNS_ON", "host", "Host"),
        graph.Step("host", "Host", "PART_OF", "region", "Region"),
    ]
    return graph.paths(order_edges(spark, sf, steps), steps, different=[("child", "parent")])


@query(
    "kg_pattern_filtered",
    f"""WITH e AS (SELECT {KEYS}, max(CASE WHEN key = 'time' THEN value END) AS t FROM ({OE}) GROUP BY {KEYS})
    SELECT a.start_id AS "user", a.end_id AS ip, b.end_id AS action, b.t AS e1_time, a.t AS e0_time
    FROM e a JOIN e b ON a.start_id = b.start_id WHERE a.predicate = 'FROM_IP' AND b.predicate = 'PERFORMS' AND a.t >= '1996/01/01'""",
)
def kg_pattern_filtered(spark, sf):
    """Steps with a time filter on an edge property; both edges of a user are few."""
    steps = [
        graph.Step("user", "User", "FROM_IP", "ip", "IP"),
        graph.Step("user", "User", "PERFORMS", "action", "Action"),
    ]
    late = F.try_element_at("properties", F.lit("time")) >= "1996/01/01"
    return graph.paths(order_edges(spark, sf, steps), steps, where={0: late}, keep=["time"])


CLAIMS = """SELECT 'label' AS kind, n_name AS name FROM nation UNION ALL SELECT 'label', 'User' UNION ALL SELECT 'property', p_brand FROM part
    UNION ALL SELECT 'property', 'outcome' UNION ALL SELECT 'relationship_type', upper(event_type) FROM events UNION ALL SELECT 'relationship_type', 'USES'"""


@query(
    "kg_vocabulary",
    f"""SELECT DISTINCT kind, name FROM ({CLAIMS}) EXCEPT (SELECT 'label', label FROM ({ON}) UNION SELECT 'relationship_type', predicate FROM ({OE})
    UNION SELECT 'property', key FROM ({ON}) UNION SELECT 'property', key FROM ({OE}))""",
)
def kg_vocabulary(spark, sf):
    """Claimed names the order graph does not know."""
    claims = (
        table(spark, sf, "nation").selectExpr("'label' AS kind", "n_name AS name")
        .unionByName(table(spark, sf, "part").selectExpr("'property' AS kind", "p_brand AS name"))
        .unionByName(table(spark, sf, "events").selectExpr("'relationship_type' AS kind", "upper(event_type) AS name"))
        .unionByName(
            spark.createDataFrame(
                [("label", "User"), ("property", "outcome"), ("relationship_type", "USES")], "kind string, name string"
            )
        )
    ).distinct()
    built = order_graph(spark, sf)
    return graph.unknown_names(claims, built.nodes, built.edges)


@query(
    "kg_identifiers",
    """SELECT DISTINCT 'label' AS kind, p_type || ' ' || p_size AS name FROM part WHERE NOT regexp_matches(p_type || ' ' || p_size, '^[A-Za-z_][A-Za-z0-9_]*$')
    UNION SELECT DISTINCT 'predicate', o_orderpriority FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[A-Za-z_][A-Za-z0-9_]*$')""",
)
def kg_identifiers(spark, sf):
    """Part types and order priorities that could not be labels or predicates."""
    nodes = table(spark, sf, "part").selectExpr("concat_ws(' ', p_type, p_size) AS label")
    edges = table(spark, sf, "orders").selectExpr("o_orderpriority AS predicate")
    return graph.bad_identifiers(nodes, edges)


STORED_NODES = f"""WITH o AS ({ON}), n AS (SELECT 'User' AS label, concat('user', c_custkey) AS id, 'name' AS key, c_name AS value FROM customer
        UNION ALL SELECT 'User', concat('user', c_custkey), 'user', c_mktsegment FROM customer)
    SELECT label, id, key, coalesce(n.value, o.value) AS value FROM o FULL JOIN n USING (label, id, key)"""


def stored_graph(spark, sf):
    """The order graph, and customers set over its users with edges to their nations, of which every fourth is missing."""
    folder = scratch_path(spark, "stored")
    made = order_graph(spark, sf)
    sinks.upsert_graph(spark, folder, made.nodes, made.edges)
    customers = table(spark, sf, "customer")
    nodes = customers.selectExpr(
        "'User' AS label", "concat('user', c_custkey) AS id", "map('name', c_name, 'user', c_mktsegment) AS properties"
    )
    nations = table(spark, sf, "nation").filter("n_nationkey % 4 <> 0").selectExpr("'Nation' AS label", "n_name AS id", "map('name', n_name) AS properties")
    edges = customers.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).selectExpr(
        "'User' AS start_label", "concat('user', c_custkey) AS start_id", "'livesIn' AS predicate", "'Nation' AS end_label", "n_name AS end_id",
        "map('since', c_mktsegment) AS properties",
    )
    sinks.upsert_graph(spark, folder, nodes.unionByName(nations), edges)
    return sinks.read_stored_graph(spark, folder)


@query("kg_upsert", f"{STORED_NODES} UNION ALL SELECT 'Nation', n_name, 'name', n_name FROM nation WHERE n_nationkey % 4 <> 0")
def kg_upsert(spark, sf):
    """Nodes of a stored graph after two upserts: incoming values win."""
    return graph.property_rows(stored_graph(spark, sf)[0], graph.NODE)


@query(
    "kg_upsert_edges",
    f"""SELECT {KEYS}, key, value FROM ({OE}) UNION ALL SELECT 'User', concat('user', c_custkey), 'livesIn', 'Nation', n_name, 'since', c_mktsegment
    FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 4 <> 0""",
)
def kg_upsert_edges(spark, sf):
    """Edges of a stored graph after two upserts; those without both of their nodes are left out."""
    return graph.property_rows(stored_graph(spark, sf)[1], graph.EDGE)


@query(
    "kg_quality",
    f"""WITH n AS (SELECT DISTINCT label, id FROM ({NATION_NODES})), e AS ({DE}), c AS (SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges,
        (SELECT count(*) FROM (SELECT * FROM n EXCEPT (SELECT start_label, start_id FROM e UNION SELECT end_label, end_id FROM e))) AS isolated)
    SELECT nodes, edges, isolated, round(isolated / nodes, 4) AS isolated_ratio, CASE WHEN isolated / nodes > 0.3 THEN 'many isolated nodes' ELSE '' END AS warnings FROM c""",
)
def kg_quality(spark, sf):
    found = quality.graph_quality(nation_nodes(spark, sf), order_graph(spark, sf).edges)
    return found.withColumn("warnings", F.array_join("warnings", ","))


CONDITIONS = {
    "c_contains": ("l_returnflag indicates r", "lower(f) LIKE '%r%'"),
    "c_not_contains": ("l_linestatus not indicates 'o'", "lower(s) NOT LIKE '%o%'"),
    "c_equal": ("l_returnflag == 'a'", "lower(f) = 'a'"),
    "c_not_equal": ("l_returnflag != n", "lower(f) <> 'n'"),
    "c_greater": ("qty > 25", "q > 25"),
    "c_least": ("qty >= 25.0", "q >= 25"),
    "c_less": ("qty < 1e1", "q < 10"),
    "c_most": ("day <= 1996/06/30", "d <= '1996/06/30'"),
    "c_in": ("l_returnflag in (A, 'n', x)", "lower(f) IN ('a', 'n', 'x')"),
    "c_filled": ("note not null", "note IS NOT NULL"),
    "c_blank": ("note is null AND missing is null", "note IS NULL"),
    "c_both": ("l_returnflag = R and qty > 10 AND note not null", "lower(f) = 'r' AND q > 10 AND note IS NOT NULL"),
    "c_unknown": ("note != unknown", "note IS NOT NULL"),
    "c_always": ("always", "true"),
}


@query(
    "cond_ops",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, q AS qty_number, "
    + ", ".join(f"coalesce({sql}, false) AS {name}" for name, (_, sql) in CONDITIONS.items())
    + """ FROM (SELECT *, l_returnflag AS f, l_linestatus AS s, cast(l_quantity AS BIGINT) AS q, strftime(l_shipdate, '%Y/%m/%d') AS d,
        CASE l_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN cast(l_suppkey AS VARCHAR) END AS note FROM lineitem)""",
)
def cond_ops(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(
        "*", "cast(cast(l_quantity as bigint) as string) AS qty", "date_format(l_shipdate, 'yyyy/MM/dd') AS day",
        "CASE l_partkey % 3 WHEN 0 THEN ' N/A ' WHEN 1 THEN cast(l_suppkey as string) ELSE '?' END AS note",
    )
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("qty").cast("long").alias("qty_number"),
        *[compile_condition(text, rows.columns).alias(name) for name, (text, _) in CONDITIONS.items()],
    )


FIELD_ROWS = "SELECT 'orders' AS params, unnest([{}]) AS field"


@query(
    "field_coverage",
    """WITH r AS (SELECT DISTINCT concat('rule ', p_brand) AS rule_id, lower(replace(p_name, ' ', '_')) AS field FROM part),
    f AS (SELECT DISTINCT lower(replace(p_name, ' ', '_')) AS field FROM part WHERE p_size < 4)
    SELECT rule_id, count(*) AS referenced_field_count, count(f.field) AS present_field_count, count(*) - count(f.field) AS missing_field_count,
        coalesce(string_agg(CASE WHEN f.field IS NULL THEN r.field END, ',' ORDER BY r.field), '') AS missing_fields, round(count(f.field) / count(*), 4) AS coverage
    FROM r LEFT JOIN f USING (field) GROUP BY rule_id""",
)
def field_coverage(spark, sf):
    """Fields named by part brands, against the fields of small parts."""
    parts = table(spark, sf, "part")
    refs = parts.selectExpr("concat('rule ', p_brand) AS rule_id", "lower(replace(p_name, ' ', '_')) AS field")
    fields = parts.filter("p_size < 4").selectExpr("lower(replace(p_name, ' ', '_')) AS field")
    found = quality.coverage(refs, fields, "rule_id")
    return found.withColumn("missing_fields", F.array_join("missing_fields", ","))


@query(
    "rule_coverage",
    f"""WITH p AS ({ORDER_PARAMS.sql}), c AS (SELECT unnest(['R1','R1','R1','R1','R2','R2','R2','R2','R3','R3','R3','R4','R4','R4','R4','R5','R5','R5','R5','R6','R6','R7','R7','R8','R8','R8']) AS rule_id,
        unnest(['pid','host','event_type','outcome','user','event_action','outcome','time','src_ip','host','amount','user','session_id','event_type','status','user','src_ip','time','outcome','session_id','tty','host','region','pid','ppid','severity']) AS field),
    u AS (SELECT field, count(value) AS filled FROM (UNPIVOT (SELECT {", ".join(f'{sql_null(c)} AS "{c}"' for c in ORDER_CELLS if c != "row_id")} FROM p) ON COLUMNS(*) INTO NAME field VALUE value) GROUP BY field)
    SELECT rule_id, field, coalesce(filled, 0) AS filled_rows FROM c LEFT JOIN u USING (field)""",
)
def rule_coverage(spark, sf):
    """How many rows fill each field the rules refer to; absent fields count 0."""
    params = ORDER_PARAMS.frame(spark, sf)
    names = [c for c in params.columns if c != "row_id"]
    from logloom.functions.scalars import clean

    counts = params.agg(*[F.count(clean(F.col(c))).alias(c) for c in names])
    long = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in names])).alias("x")).select("x.*")
    refs = rule_table(spark, ORDER_RULES)
    return refs.join(long, "field", "left").select("rule_id", "field", F.coalesce("filled", F.lit(0)).alias("filled_rows"))
