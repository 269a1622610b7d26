"""JSON inputs: contract events and application audit documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EMBEDDED = ("subject", "app_info", "object", "details")
AUDIT_DOCUMENT = (
    "_source struct<`@timestamp`:string,log_type:string,op_type:string,valid:boolean,"
    "entry_stamp:bigint,tags:array<string>,app_info:string,subject:string,object:string,details:string>"
)


def read_events(spark: SparkSession, folder: str, name: str = "*.json", arrays: bool = True) -> DataFrame:
    """Contract events of the files below a folder: alarm_type and data as a text map.

    ``arrays`` reads files that hold one array each, over any number of lines; without it a file holds an
    event, or an array of events, per line, as this package writes them, and can be split.
    """
    return (
        spark.read.option("multiLine", arrays)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", name)
        .option("mode", "DROPMALFORMED")
        .schema("alarm_type int, data map<string,string>")
        .json(folder)
        .filter(F.col("alarm_type").isNotNull() | F.col("data").isNotNull())
    )


def flat_events(events: DataFrame, fields: list[str]) -> DataFrame:
    """alarm_type beside the named data fields, '' where an event lacks one."""
    return events.select(
        "alarm_type",
        *[F.coalesce(F.try_element_at("data", F.lit(f)), F.lit("")).alias(f) for f in fields],
    )


def json_map(text: Column) -> Column:
    """Embedded JSON object as a text map; anything else is an empty map."""
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.from_json(text, "map<string,string>"), empty)


def read_audit_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents (one object or an array per file) with their embedded objects parsed."""
    docs = spark.read.option("multiLine", True).schema(AUDIT_DOCUMENT).json(path)
    return docs.select(
        F.monotonically_increasing_id().alias("pos"),
        F.col("_source.`@timestamp`").alias("timestamp"),
        F.col("_source.log_type").alias("log_type"),
        F.col("_source.op_type").alias("op_type"),
        *[json_map(F.col(f"_source.{c}")).alias(c) for c in EMBEDDED],
    )
