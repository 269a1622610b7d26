"""End-to-end flows: parse sources, build and fuse graphs, events to alarms."""

from __future__ import annotations

from pyspark.sql import DataFrame

from logloom.operators import alarms, drain, events, graph, stage, templates
from logloom.sources.rules import Rule


def parse_sources(
    lines: DataFrame,
    remembered: DataFrame | None = None,
    generator: stage.Generator | None = None,
    in_order: bool = False,
    refine: bool = True,
) -> stage.Stage:
    """Lines (source, line_id, original_content) of all sources to patterns, and the memory after them.

    Lines are cleaned and grouped (by position, or with ``in_order`` by online clustering), and every group goes
    through the template stage: lines that a ``remembered`` pattern matches take it, the others get their group's.
    """
    ready = templates.preprocess(lines)
    grouped = drain.drain(ready) if in_order else templates.parse(ready)[0]
    grouped = grouped.withColumnRenamed("event_id", "group_id").drop("template", "n_tokens")
    return stage.fit_stage(grouped, ["source", "group_id"], remembered, generator, refine=refine)


def build_and_fuse(params: dict[str, DataFrame], rules: dict[str, list[Rule]], order: str = "row_id") -> graph.Graph:
    """One graph per source by its own rules, fused in source order."""
    parts = {name: graph.build_graph(table, rules[name], order) for name, table in params.items()}
    every = [rule for name in sorted(params) for rule in rules[name]]
    return graph.fuse(parts, every)


def firewall_alarms(
    params: DataFrame, assets: DataFrame, devices: DataFrame, owners: DataFrame, application: DataFrame
) -> DataFrame:
    """Firewall params and application alarms to one ordered alarm list."""
    built = events.export(params, assets, devices, types=[4])
    opened = alarms.latest_per_device(alarms.open_policies(built.accepted, owners))
    return alarms.alarm_list(opened, application)
