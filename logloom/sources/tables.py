"""CSV tables: case-insensitive columns, keyed dimensions, dictionaries and their catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.scalars import snake_name
from logloom.functions.text import strip

# Columns of a relation-rule table.
RULE_COLUMNS = [
    "subject_type",
    "subject_id_source",
    "predicate",
    "object_type",
    "object_id_source",
    "edge_properties",
    "condition",
]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV with doubled quotes and multi-line fields, all columns text, NULL as ''."""
    table = (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", True)
        .option("encoding", "UTF-8")
        .csv(path)
    )
    names = [c.lstrip("\ufeff") for c in table.columns]
    return table.toDF(*names).na.fill("")


def file_order(table: DataFrame, out: str = "pos") -> DataFrame:
    """Adds an order that follows file names, then the place inside the file; for tables just read from files."""
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return table.withColumn(out, place)


def select_columns(table: DataFrame, required: list[str], optional: list[str] = ()) -> DataFrame:
    """Columns by name in any case; a missing optional one is '', a missing required one fails."""
    known = {c.lower(): c for c in table.columns}
    missing = [c for c in required if c.lower() not in known]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    chosen = [F.col(f"`{known[c.lower()]}`").alias(c) for c in required]
    chosen += [
        (F.col(f"`{known[c.lower()]}`") if c.lower() in known else F.lit("")).alias(c) for c in optional
    ]
    return table.select(*chosen)


def read_column(spark: SparkSession, path: str, column: str = "Content") -> DataFrame:
    return select_columns(read_csv(spark, path), [column])


def keyed(table: DataFrame, key: str, order: str | None = None, casefold: bool = False) -> DataFrame:
    """One row per non-blank key, the last one; columns trimmed, keys optionally lower-cased.

    Without ``order`` the last row is the one that the input holds last, which is only defined for a table
    of one file; several files need an order column, such as ``file_order`` gives.
    """
    names = [c for c in table.columns if c != order]
    trimmed = table.select(
        *[strip(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias(c) for c in names],
        (F.col(order) if order else F.monotonically_increasing_id()).alias("_pos"),
    ).filter(F.col(key) != "")
    index = F.lower(F.col(key)) if casefold else F.col(key)
    last = F.max_by(F.struct(*names), F.col("_pos")).alias("_row")
    return trimmed.groupBy(index.alias("_key")).agg(last).select("_key", "_row.*")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Headerless field and description table; a header row and blank fields are skipped."""
    table = (
        spark.read.option("escape", '"')
        .schema("field string, description string")
        .csv(path)
        .select(
            F.col("_metadata.file_name").alias("file_name"),
            snake_name(F.regexp_replace(F.coalesce("field", F.lit("")), "^\ufeff", "")).alias("field"),
            strip(F.coalesce("description", F.lit(""))).alias("description"),
        )
    )
    return table.filter((F.col("field") != "") & ~((F.col("field") == "field") & (F.col("description") == "description")))


def read_rule_table(spark: SparkSession, path: str) -> DataFrame:
    table = spark.read.option("header", True).option("escape", '"').csv(path)
    return table.select(
        F.col("_metadata.file_name").alias("file_name"),
        *[strip(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in RULE_COLUMNS],
    )


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Families that have a dictionary and a rule table: their fields and sorted predicates."""
    fields = (
        read_dictionary(spark, f"{folder}/*_POI.csv")
        .groupBy(F.regexp_extract("file_name", r"^(.*)_POI\.csv$", 1).alias("family"))
        .agg(F.array_sort(F.collect_set("field")).alias("fields"))
    )
    predicates = (
        read_rule_table(spark, f"{folder}/*_relation.csv")
        .groupBy(F.regexp_extract("file_name", r"^(.*)_relation\.csv$", 1).alias("family"))
        .agg(F.array_sort(F.collect_set(F.when(F.col("predicate") != "", F.col("predicate")))).alias("predicates"))
    )
    return fields.join(predicates, "family")


def union_by_name(tables: list[DataFrame]) -> DataFrame:
    """Wide union: columns in first-seen order, '' where a table lacks one."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    texts = [c for c, kind in merged.dtypes if kind == "string"]
    return merged.na.fill("", subset=texts)
