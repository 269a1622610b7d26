"""Checks of dictionaries, field coverage, artifacts and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.scalars import known_names, snake_name
from logloom.functions.text import strip
from logloom.operators.graph import isolated
from logloom.operators.skew import lookup_join, number_within

# Names that look like placeholders, and fields that anchor a graph.
PLACEHOLDERS = ["a", "aa", "aaa", "asdf", "bar", "field", "foo", "null", "none", "test", "tmp", "todo", "unknown", "xxx"]
ANCHORS = ["host", "program", "event_type", "event_action", "user", "src_ip", "dst_ip", "outcome", "object", "target"]
# Limits of a dictionary.
SHORT_DESCRIPTION = 12
LONG_DESCRIPTION = 500
MANY_FIELDS = 80
ISOLATED_SHARE = 0.3
# Fields of a dictionary that would be empty otherwise.
DEFAULT_FIELDS = [
    ("host", "Hostname/device that emitted the log."),
    ("program", "Emitting application or service."),
    ("event_type", "Canonical event category inferred from the template."),
    ("outcome", "Normalized event outcome."),
]
FIELD_SHAPE = "^[a-z][a-z0-9_]{1,63}$"


def dictionary_findings(rows: DataFrame) -> DataFrame:
    """Findings (dictionary, row, severity, check, field) of rows (dictionary, row, field, description).

    ``row`` is unique within a dictionary; findings on a whole dictionary have row 0.
    """
    base = rows.select(
        "dictionary", "row", strip(F.coalesce("field", F.lit(""))).alias("field"),
        strip(F.coalesce("description", F.lit(""))).alias("description"),
    )
    numbered = number_within(base.filter("field <> ''").select("dictionary", "row", "field"), ["dictionary", "field"], "row", "_k")
    earlier = numbered.select("dictionary", "field", (F.col("_k") + 1).alias("_k"), F.col("row").alias("previous"))
    repeated = numbered.join(earlier, ["dictionary", "field", "_k"]).select(
        "dictionary", "row", F.lit("error").alias("severity"),
        F.concat(F.lit("duplicate of row "), F.col("previous").cast("string")).alias("check"), "field",
    )
    field, text = F.col("field"), F.col("description")
    length = F.length(text)
    checks = [
        ("error", "field is required", field == ""),
        ("error", "not lower_snake_case", (field != "") & (field != snake_name(field))),
        ("error", "not 2-64 characters from a letter on", (field != "") & ~field.rlike(FIELD_SHAPE)),
        ("warning", "no description", (field != "") & (text == "")),
        ("warning", "very short description", (field != "") & (length > 0) & (length < SHORT_DESCRIPTION)),
        ("error", "description too long", (field != "") & (length > LONG_DESCRIPTION)),
        ("warning", "placeholder name", field.isin(PLACEHOLDERS) | field.rlike(r"^(.)\1{2,}$")),
    ]
    found = F.array_compact(
        F.array(*[F.when(hit, F.struct(F.lit(s).alias("severity"), F.lit(c).alias("check"))) for s, c, hit in checks])
    )
    single = base.select("dictionary", "row", "field", F.explode(found).alias("_f")).select(
        "dictionary", "row", "_f.severity", "_f.check", "field"
    )
    whole = base.groupBy("dictionary").agg(
        F.count_distinct(F.when(field != "", field)).alias("fields"),
        F.max(F.coalesce(field.isin(ANCHORS), F.lit(False))).alias("anchored"),
    )
    general = F.array_compact(
        F.array(
            F.when(F.col("fields") == 0, F.struct(F.lit("error").alias("severity"), F.lit("no field").alias("check"))),
            F.when(
                (F.col("fields") > 0) & ~F.col("anchored"),
                F.struct(F.lit("warning").alias("severity"), F.lit("no graph anchor field").alias("check")),
            ),
            F.when(
                F.col("fields") > MANY_FIELDS,
                F.struct(F.lit("warning").alias("severity"), F.lit("too many fields").alias("check")),
            ),
        )
    )
    overall = whole.select("dictionary", F.explode(general).alias("_f")).select(
        "dictionary", F.lit(0).cast("long").alias("row"), "_f.severity", "_f.check", F.lit("").alias("field")
    )
    return single.unionByName(repeated).unionByName(overall)


def missing_references(references: DataFrame, fields: DataFrame) -> DataFrame:
    """Referenced (dictionary, field) pairs that the dictionary does not define."""
    asked = references.select("dictionary", snake_name(F.col("field")).alias("field")).filter("field <> ''").distinct()
    return asked.join(fields.select("dictionary", "field").distinct(), ["dictionary", "field"], "left_anti")


def coverage(references: DataFrame, fields: DataFrame, group: str) -> DataFrame:
    """Per group: referenced, present and missing fields, and the covered share."""
    asked = references.select(group, "field").distinct()
    has = fields.select("field", F.lit(1).alias("_has")).distinct()
    joined = lookup_join(asked, has, ["field"])
    present = F.count("_has")
    every = F.count(F.lit(1))
    return joined.groupBy(group).agg(
        every.alias("referenced_field_count"),
        present.alias("present_field_count"),
        (every - present).alias("missing_field_count"),
        F.array_sort(F.collect_set(F.when(F.col("_has").isNull(), F.col("field")))).alias("missing_fields"),
        F.round(present / every, 4).alias("coverage"),
    )


def table_status(table: DataFrame, name: str) -> DataFrame:
    """Row and column counts of an artifact."""
    return table.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(name).alias("artifact"), "rows", F.lit(len(table.columns)).cast("long").alias("column_count")
    )


def parity(counts: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Artifacts of a dataset whose counts differ, or that are missing.

    ``counts`` has one row (dataset, artifact, items); ``pairs`` name artifacts to compare.
    """
    names = list(dict.fromkeys(n for p in pairs for n in p))
    wide = counts.groupBy("dataset").agg(
        *[F.max(F.when(F.col("artifact") == n, F.col("items"))).alias(n) for n in names]
    )
    cells = [
        F.when(F.col(n).isNull(), F.struct(F.lit("issue").alias("severity"), F.lit(f"missing {n}").alias("finding")))
        for n in names
    ]
    for left, right in pairs:
        text = F.concat(
            F.lit(f"{left} "), F.col(left).cast("string"), F.lit(f" differs from {right} "), F.col(right).cast("string")
        )
        cells.append(
            F.when(F.col(left) != F.col(right), F.struct(F.lit("warning").alias("severity"), text.alias("finding")))
        )
    return wide.select("dataset", F.explode(F.array_compact(F.array(*cells))).alias("_f")).select("dataset", "_f.*")


def graph_quality(nodes: DataFrame, edges: DataFrame, most: float = ISOLATED_SHARE) -> DataFrame:
    """One row: counts, isolated nodes and their share, warnings."""
    one = F.lit(1)
    counted = (
        nodes.agg(F.count(one).alias("n")).select(F.lit("nodes").alias("k"), "n")
        .unionByName(edges.agg(F.count(one).alias("n")).select(F.lit("edges").alias("k"), "n"))
        .unionByName(isolated(nodes, edges).agg(F.count(one).alias("n")).select(F.lit("isolated").alias("k"), "n"))
    )
    row = counted.agg(*[F.max(F.when(F.col("k") == k, F.col("n"))).alias(k) for k in ("nodes", "edges", "isolated")])
    share = F.when(F.col("nodes") > 0, F.round(F.col("isolated") / F.col("nodes"), 4))
    row = row.withColumn("isolated_ratio", share)
    return row.withColumn(
        "warnings",
        F.array_compact(
            F.array(
                F.when(F.col("nodes") == 0, "no nodes"),
                F.when(F.col("edges") == 0, "no edges"),
                F.when(F.col("isolated") / F.when(F.col("nodes") > 0, F.col("nodes")) > most, "many isolated nodes"),
            )
        ),
    )


def clean_dictionary(rows: DataFrame) -> DataFrame:
    """Normalised distinct fields of every dictionary, first occurrence; defaults when empty."""
    named = rows.select(
        "dictionary", "row", snake_name(F.coalesce("field", F.lit(""))).alias("field"),
        strip(F.coalesce("description", F.lit(""))).alias("description"),
    )
    first = named.filter("field <> ''").groupBy("dictionary", "field").agg(
        F.min("row").alias("row"), F.min_by("description", "row").alias("description")
    )
    empty = named.groupBy("dictionary").agg(F.max(F.col("field") != "").alias("_any")).filter("NOT _any")
    defaults = F.explode(
        F.array(
            *[
                F.struct(F.lit(f).alias("field"), F.lit(n).cast("long").alias("row"), F.lit(d).alias("description"))
                for n, (f, d) in enumerate(DEFAULT_FIELDS, start=1)
            ]
        )
    )
    return first.unionByName(empty.select("dictionary", defaults.alias("_d")).select("dictionary", "_d.*"))


def clean_relations(relations: DataFrame, fields: DataFrame) -> DataFrame:
    """Relations whose ids the dictionary defines; edge properties limited to its fields."""
    known = fields.groupBy("dictionary").agg(F.collect_set("field").alias("_known"))
    rows = lookup_join(relations, known, ["dictionary"], "inner")
    for column in ("subject_id_source", "object_id_source"):
        rows = rows.withColumn(column, snake_name(F.col(column)))
    rows = rows.withColumn("edge_properties", known_names(F.col("edge_properties"), F.col("_known")))
    kept = (F.col("predicate") != "") & F.array_contains("_known", F.col("subject_id_source")) & F.array_contains(
        "_known", F.col("object_id_source")
    )
    return rows.filter(kept).drop("_known")


def severity_counts(findings: DataFrame, column: str = "severity") -> DataFrame:
    return findings.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
