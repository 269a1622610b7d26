"""Relation rules."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import conditions
from logloom.sources.tables import RULE_COLUMNS, read_csv


@dataclass(frozen=True)
class Rule:
    rule_id: str
    subject_type: str
    subject_id_source: str
    predicate: str
    object_type: str
    object_id_source: str
    edge_fields: tuple[str, ...]
    condition: str

    @property
    def referenced(self) -> list[str]:
        """Every field the rule reads, in order of mention."""
        names = [self.subject_id_source, self.object_id_source, *self.edge_fields]
        return list(dict.fromkeys([*names, *conditions.fields(self.condition)]))


def make_rules(rows: Iterable[Mapping[str, str]]) -> list[Rule]:
    """Rules numbered R1, R2, … in the order given; a bad condition fails here."""
    rules = []
    for number, row in enumerate(rows, start=1):
        missing = [c for c in RULE_COLUMNS if c not in row]
        if missing:
            raise ValueError(f"relation rules lack columns: {', '.join(missing)}")
        value = {c: (row[c] or "").strip() for c in RULE_COLUMNS}
        conditions.parse(value["condition"])
        rules.append(
            Rule(
                f"R{number}",
                value["subject_type"],
                value["subject_id_source"],
                value["predicate"],
                value["object_type"],
                value["object_id_source"],
                tuple(p.strip() for p in value["edge_properties"].split(",") if p.strip()),
                value["condition"],
            )
        )
    return rules


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    """A rule file is a short configuration table, so its rows come to the driver."""
    table = read_csv(spark, path).withColumn("_pos", F.monotonically_increasing_id())
    return make_rules(row.asDict() for row in table.orderBy("_pos").collect())


def rules_from_lines(text: str) -> list[Rule]:
    """Rules written one per line, columns separated by ``;``."""
    rows = []
    for line in filter(str.strip, text.splitlines()):
        rows.append(dict(zip(RULE_COLUMNS, (c.strip() for c in line.split(";")), strict=True)))
    return make_rules(rows)


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """Rules as rows (rule_id, field): one per referenced field."""
    pairs = [(r.rule_id, f) for r in rules for f in r.referenced]
    return spark.createDataFrame(pairs, "rule_id string, field string")
