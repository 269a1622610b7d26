"""Knowledge graph: rule evaluation, nodes, edges, fusion, upsert, summaries, search."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.conditions import compile_condition
from logloom.functions.scalars import clean, whole_number
from logloom.operators.skew import lookup_join
from logloom.session import durable
from logloom.sources.rules import Rule

NODE = ["label", "id"]
EDGE = ["start_label", "start_id", "predicate", "end_label", "end_id"]
PROPERTIES = "map<string,string>"

# Property that holds a node's id, for labels that do not use the source field.
ID_PROPERTY = {
    "Host": "host",
    "Program": "program",
    "User": "user",
    "IP": "ip",
    "Command": "command",
    "Object": "object_name",
    "Domain": "qname",
    "Session": "session_id",
    "Terminal": "terminal",
    "Syscall": "syscall",
}
# Labels whose id is qualified by the host, with their id and raw properties.
HOST_BOUND = {"Process": ("process", "pid"), "Interface": ("interface", "iface")}


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    hits: DataFrame


def _field(name: str, columns: list[str]) -> Column:
    """A cleaned column, NULL when the table has none."""
    return F.col(f"`{name}`") if name in columns else F.lit(None).cast("string")


def node_id(label: str, source: str, columns: list[str]) -> Column:
    value = _field(source, columns)
    if label in HOST_BOUND:
        host = F.coalesce(_field("host", columns), F.lit(""))
        return F.concat(host, F.lit("|"), whole_number(value))
    if label in ("User", "Domain"):
        return F.lower(value)
    return whole_number(value) if label == "Session" else value


def node_properties(label: str, source: str, columns: list[str]) -> dict[str, Column]:
    identity, raw = node_id(label, source, columns), _field(source, columns)
    if label in HOST_BOUND:
        id_name, raw_name = HOST_BOUND[label]
        raw = whole_number(raw) if label == "Process" else raw
        return {id_name: identity, raw_name: raw, "host": _field("host", columns)}
    return {ID_PROPERTY[label]: identity} if label in ID_PROPERTY else {source: raw}


def _map(values: dict[str, Column]) -> Column:
    if not values:
        return F.create_map().cast(PROPERTIES)
    pairs = [x for name, value in values.items() for x in (F.lit(name), value)]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()).cast(PROPERTIES)


def facts(params: DataFrame, rules: list[Rule], order: str) -> DataFrame:
    """One row per rule hit, from a single pass over the rows.

    ``order`` is a unique numeric column: it decides which value of a property comes first.
    A rule whose condition holds but whose ids are missing is no hit.
    """
    read = dict.fromkeys(["host", *[f for rule in rules for f in rule.referenced]])
    columns = [c for c in read if c in params.columns]
    params = params.select(F.col(order).cast("long").alias("_order"), *[clean(F.col(f"`{c}`")).alias(c) for c in columns])
    hits = []
    for position, rule in enumerate(rules):
        start = node_id(rule.subject_type, rule.subject_id_source, columns)
        end = node_id(rule.object_type, rule.object_id_source, columns)
        holds = compile_condition(rule.condition, columns, cleaned=True) & start.isNotNull() & end.isNotNull()
        hits.append(
            F.when(
                holds,
                F.struct(
                    F.lit(rule.rule_id).alias("rule_id"),
                    (F.col("_order") * len(rules) + position).alias("ord"),
                    F.lit(rule.subject_type).alias("start_label"),
                    start.alias("start_id"),
                    _map(node_properties(rule.subject_type, rule.subject_id_source, columns)).alias("start_properties"),
                    F.lit(rule.predicate).alias("predicate"),
                    F.lit(rule.object_type).alias("end_label"),
                    end.alias("end_id"),
                    _map(node_properties(rule.object_type, rule.object_id_source, columns)).alias("end_properties"),
                    _map({f: _field(f, columns) for f in rule.edge_fields}).alias("properties"),
                ),
            )
        )
    every = F.filter(F.array(*hits), lambda h: h.isNotNull())
    return params.select(F.explode(every).alias("_f")).select("_f.*")


def _property_names(rules: list[Rule]) -> tuple[list[str], list[str]]:
    nodes, edges = {}, {}
    for rule in rules:
        for label, source in ((rule.subject_type, rule.subject_id_source), (rule.object_type, rule.object_id_source)):
            nodes.update(dict.fromkeys(node_properties(label, source, [])))
        edges.update(dict.fromkeys(rule.edge_fields))
    return list(nodes), list(edges)


def first_properties(rows: DataFrame, keys: list[str], names: list[str], extra: list[Column] = ()) -> DataFrame:
    """Per key the first value of every named property, by the column ord.

    The names are known beforehand, so one aggregation with map-side combining does it:
    a hub node sends one row per task, whatever the number of its rows.
    """
    firsts = []
    for position, name in enumerate(names):
        value = F.try_element_at("properties", F.lit(name))
        firsts.append(F.min_by(value, F.when(value.isNotNull(), F.col("ord"))).alias(f"_v{position}"))
    merged = rows.groupBy(*keys).agg(*firsts, F.min("ord").alias("ord"), *extra)
    values = _map({name: F.col(f"_v{position}") for position, name in enumerate(names)})
    rest = [c for c in merged.columns if not c.startswith("_v") and c != "ord" and c not in keys]
    return merged.select(*keys, values.alias("properties"), "ord", *rest)


def build(hits: DataFrame, rules: list[Rule]) -> Graph:
    """Nodes, edges and rule hits of the facts."""
    node_names, edge_names = _property_names(rules)
    ends = F.explode(
        F.array(
            F.struct(
                F.col("start_label").alias("label"), F.col("start_id").alias("id"),
                F.col("start_properties").alias("properties"), (F.col("ord") * 2).alias("ord"),
            ),
            F.struct(
                F.col("end_label").alias("label"), F.col("end_id").alias("id"),
                F.col("end_properties").alias("properties"), (F.col("ord") * 2 + 1).alias("ord"),
            ),
        )
    )
    nodes = first_properties(hits.select(ends.alias("_n")).select("_n.*"), NODE, node_names)
    edges = first_properties(hits.select(*EDGE, "properties", "ord"), EDGE, edge_names)
    counts = hits.groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits"))
    return Graph(nodes, edges, counts)


def build_graph(params: DataFrame, rules: list[Rule], order: str) -> Graph:
    return build(facts(params, rules, order), rules)


def _fuse(parts: list[DataFrame], names: list[str], keys: list[str], properties: list[str]) -> DataFrame:
    merged = None
    for position, (name, part) in enumerate(zip(names, parts)):
        tagged = part.select(
            *keys, "properties", F.struct(F.lit(position).alias("p"), F.col("ord")).alias("ord"),
            F.struct(F.lit(position).alias("p"), F.lit(name).alias("name")).alias("_source"),
        )
        merged = tagged if merged is None else merged.unionByName(tagged)
    sources = F.array_sort(F.collect_set("_source")).alias("_sources")
    fused = first_properties(merged, keys, properties, [sources])
    return fused.select(*keys, "properties", F.transform("_sources", lambda s: s["name"]).alias("sources"))


def fuse(graphs: dict[str, Graph], rules: list[Rule]) -> Graph:
    """Union of named graphs: the first source's value of a property wins.

    Sources are taken in name order; ``sources`` lists them per node and edge. ``rules``
    are all rules the graphs were built from.
    """
    names = sorted(graphs)
    node_names, edge_names = _property_names(rules)
    nodes = _fuse([graphs[n].nodes for n in names], names, NODE, node_names)
    edges = _fuse([graphs[n].edges for n in names], names, EDGE, edge_names)
    hits = None
    for name in names:
        part = graphs[name].hits.select(F.concat(F.lit(f"{name}:"), F.col("rule_id")).alias("rule_id"), "hits")
        hits = part if hits is None else hits.unionByName(part)
    return Graph(nodes, edges, hits)


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows with the incoming properties set over theirs, and the new rows."""
    new = incoming.select(*keys, F.col("properties").alias("_new"))
    joined = stored.select(*keys, "properties").join(new, keys, "full_outer")
    none = F.create_map().cast(PROPERTIES)
    old, fresh = F.coalesce("properties", none), F.coalesce("_new", none)
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(fresh, k))
    return joined.select(*keys, F.map_concat(kept, fresh).alias("properties"))


def with_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two nodes exist."""
    for side in ("start", "end"):
        keys = nodes.select(F.col("label").alias(f"{side}_label"), F.col("id").alias(f"{side}_id"))
        edges = edges.join(keys, [f"{side}_label", f"{side}_id"], "left_semi")
    return edges


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that lack a node, with the missing side."""
    ends = F.explode(
        F.array(
            F.struct(F.lit("start").alias("side"), F.col("start_label").alias("label"), F.col("start_id").alias("id")),
            F.struct(F.lit("end").alias("side"), F.col("end_label").alias("label"), F.col("end_id").alias("id")),
        )
    )
    return edges.select(*EDGE, ends.alias("_e")).select(*EDGE, "_e.*").join(nodes.select(*NODE), NODE, "left_anti")


def endpoints(edges: DataFrame) -> DataFrame:
    both = F.explode(
        F.array(
            F.struct(F.col("start_label").alias("label"), F.col("start_id").alias("id")),
            F.struct(F.col("end_label").alias("label"), F.col("end_id").alias("id")),
        )
    )
    return edges.select(both.alias("_e")).select("_e.*").distinct()


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(endpoints(edges), NODE, "left_anti")


def summary(nodes: DataFrame, edges: DataFrame, k: int = 12) -> DataFrame:
    """Totals and the most frequent labels and predicates as (part, name, count).

    Nodes and edges are counted once, per label and predicate; totals are sums of these counts.
    """
    columns = {"node": (nodes, "label"), "edge": (edges, "predicate")}
    tallies = [
        rows.groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("count")).withColumn("part", F.lit(part))
        for part, (rows, column) in columns.items()
    ]
    every = durable(tallies[0].unionByName(tallies[1]))
    parts = []
    for part, (_, column) in columns.items():
        counts = every.filter(F.col("part") == part)
        total = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("count"))
        parts.append(total.select(F.lit(part).alias("part"), F.lit("").alias("name"), "count"))
        top = counts.filter(F.col("name") != "").orderBy(F.desc("count"), "name").limit(k)
        parts.append(top.select(F.lit(f"{part}_{column}").alias("part"), "name", "count"))
    result = parts[0]
    for more in parts[1:]:
        result = result.unionByName(more)
    return result


def node_schema(nodes: DataFrame) -> DataFrame:
    return _schema(nodes, ["label"])


def edge_schema(edges: DataFrame) -> DataFrame:
    return _schema(edges, ["start_label", "predicate", "end_label"])


def _schema(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Count and sorted property names per key; names are few, values are not touched."""
    names = rows.select(*keys, F.explode_outer(F.map_keys("properties")).alias("_p"))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    props = names.groupBy(*keys).agg(F.array_sort(F.collect_set("_p")).alias("properties"))
    return counts.join(props, keys)


def _holds_text(rows: DataFrame, needle: str) -> Column:
    return F.lower(F.to_json(F.struct(*[F.col(c) for c in rows.columns]))).contains(needle)


def find(
    nodes: DataFrame, edges: DataFrame, label: str = "", predicate: str = "", contains: str = "", limit: int = 20
) -> DataFrame:
    """Rows by label, predicate and contained text; nodes, then edges, at most ``limit``."""
    needle = contains.strip().lower()
    chosen = []
    if label or not predicate:
        part = nodes.select(*NODE, F.to_json(F.map_from_entries(F.array_sort(F.map_entries("properties")))).alias("properties_json"))
        part = part.filter(F.lower("label") == label.lower()) if label else part
        part = part.filter(_holds_text(part, needle)) if needle else part
        chosen.append(part.orderBy(*NODE).limit(limit).withColumn("_part", F.lit(0)))
    if predicate or not label:
        part = edges.select(*EDGE, F.to_json(F.map_from_entries(F.array_sort(F.map_entries("properties")))).alias("properties_json"))
        part = part.filter(F.lower("predicate") == predicate.lower()) if predicate else part
        part = part.filter(_holds_text(part, needle)) if needle else part
        chosen.append(part.orderBy(*EDGE).limit(limit).withColumn("_part", F.lit(1)))
    rows = chosen[0] if len(chosen) == 1 else chosen[0].unionByName(chosen[1], allowMissingColumns=True)
    order = ["_part", *[c for c in [*NODE, *EDGE] if c in rows.columns]]
    return rows.orderBy(*order).limit(limit).drop("_part")


@dataclass(frozen=True)
class Step:
    """One hop of a path: node names bind, and a name used twice must be the same node."""

    start: str
    start_label: str
    predicate: str
    end: str
    end_label: str


def paths(
    edges: DataFrame,
    steps: list[Step],
    different: list[tuple[str, str]] = (),
    where: dict[int, Column] | None = None,
    keep: list[str] = (),
) -> DataFrame:
    """All bindings of a chain of typed steps; ``where`` filters a step's edges by number.

    The edges are made and read once: those that fit a step are stored, and every step
    takes its own from there. Every step is an equi-join on the nodes bound so far, and its
    edges are filtered by labels and predicate before the join. Properties named in ``keep``
    are returned as ``e<step>_<name>``.
    """
    def fits(step: Step) -> Column:
        return (
            (F.col("start_label") == step.start_label)
            & (F.col("predicate") == step.predicate)
            & (F.col("end_label") == step.end_label)
        )

    edges = edges.filter(reduce(or_, [fits(step) for step in steps]))
    edges = durable(edges if where else edges.select(*EDGE, *(["properties"] if keep else [])))
    result, bound = None, set()
    for number, step in enumerate(steps):
        part = edges.filter(fits(step))
        if where and number in where:
            part = part.filter(where[number])
        if step.start == step.end:
            part = part.filter(F.col("start_id") == F.col("end_id"))
        names = [F.col("start_id").alias(step.start)]
        if step.end != step.start:
            names.append(F.col("end_id").alias(step.end))
        extra = [F.try_element_at("properties", F.lit(k)).alias(f"e{number}_{k}") for k in keep]
        part = part.select(*names, *extra)
        if result is None:
            result = part
        else:
            shared = sorted(bound & {step.start, step.end})
            if not shared:
                raise ValueError(f"step {number} is not connected to the steps before it")
            result = result.join(part, shared)
        bound |= {step.start, step.end}
    for left, right in different:
        result = result.filter(F.col(left) != F.col(right))
    return result


def rules_for(rules: list[Rule], steps: list[Step]) -> list[Rule]:
    """Rules that can make an edge of a step; an edge of other rules never fits, and shares no property with one."""
    kinds = {(s.start_label, s.predicate, s.end_label) for s in steps}
    return [r for r in rules if (r.subject_type, r.predicate, r.object_type) in kinds]


def capped(rows: DataFrame, order: list[str], limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """First rows of a result, and whether more exist."""
    probe = rows.orderBy(*order).limit(limit + 1)
    return rows.orderBy(*order).limit(limit), probe.agg((F.count(F.lit(1)) > limit).alias("truncated"))


def unknown_names(claims: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Claimed (kind, name) rows outside the graph: labels, relationship types, properties."""
    def named(kind: str, rows: DataFrame, column: Column) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), column.alias("name")).distinct()

    known = (
        named("label", nodes, F.col("label"))
        .unionByName(named("relationship_type", edges, F.col("predicate")))
        .unionByName(named("property", nodes, F.explode(F.map_keys("properties"))))
        .unionByName(named("property", edges, F.explode(F.map_keys("properties"))))
        .distinct()
    )
    return claims.join(known, ["kind", "name"], "left_anti")


def bad_identifiers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels and predicates that are no plain identifiers."""
    names = nodes.select(F.lit("label").alias("kind"), F.col("label").alias("name")).distinct()
    names = names.unionByName(edges.select(F.lit("predicate").alias("kind"), F.col("predicate").alias("name")).distinct())
    return names.filter(~F.col("name").rlike("^[A-Za-z_][A-Za-z0-9_]*$"))


def property_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key and property; a row without properties stays with NULLs."""
    return rows.select(*keys, F.explode_outer("properties").alias("key", "value"))


def hit_counts(graph: Graph) -> DataFrame:
    """Hits of every rule."""
    return graph.hits


def top_hits(graph: Graph, k: int = 10) -> DataFrame:
    """The rules with the most hits, for a printed summary."""
    return graph.hits.orderBy(F.desc("hits"), "rule_id").limit(k)


def attach_labels(rows: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Label of a bound node id, where ids are unique over labels."""
    return lookup_join(rows, nodes.select(F.col("id").alias(key), F.col("label").alias(f"{key}_label")), [key])
