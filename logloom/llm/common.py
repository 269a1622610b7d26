"""Helpers shared by the text operators."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
)

from logloom.session import prepare

# Rows of one Arrow batch: texts may be very long, so a batch holds few of them.
BATCH_ROWS = 256
# The separators between words, as a character class without its brackets.
SEPARATORS = r"\x20\x09-\x0D"
WORD = rf"[^{SEPARATORS}]+"

ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
    "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()),
}


DDL = {
    "long": LongType(), "int": IntegerType(), "double": DoubleType(), "boolean": BooleanType(), "string": StringType(),
    "binary": BinaryType(), "array<int>": ArrayType(IntegerType()), "array<string>": ArrayType(StringType()),
}


def ready(spark: SparkSession) -> SparkSession:
    """Session settings of these operators: those of the library, and small Arrow batches."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


class Shared:
    """A value sent to every executor once, by value: workers need no installed package to open it.

    A Python worker opens it once and keeps it, and what ``made`` makes of it, for all its tasks.
    """

    def __init__(self, spark: SparkSession, value: object) -> None:
        self.box = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def _kept(self) -> dict:
        if not hasattr(self.box, "_kept"):
            self.box._kept = {}
        return self.box._kept

    @property
    def value(self):
        kept = self._kept()
        if "value" not in kept:
            kept["value"] = pickle.loads(self.box.value)
        return kept["value"]

    def made(self, name: str, make: Callable):
        kept = self._kept()
        if name not in kept:
            kept[name] = make(self.value)
        return kept[name]


def fresh(taken: Iterable[str], name: str) -> str:
    """The name, or one that starts with it, that no given column has in any case of letters."""
    known = {column.lower() for column in taken}
    while name.lower() in known:
        name += "_"
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model learns from; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def columns_of(kinds: dict[str, str]) -> pa.Schema:
    return pa.schema([(name, ARROW[kind]) for name, kind in kinds.items()])


def map_texts(
    docs: DataFrame,
    kinds: dict[str, str],
    make: Callable[[], Callable[[list], dict[str, list]]],
    id_col: str = "doc_id",
    text_col: str = "text",
    as_bytes: bool = False,
) -> DataFrame:
    """One row per document: its id and the columns that a function gives for a list of texts.

    ``make`` runs once per task and returns the function, which gets the texts of one batch (a null
    text as empty) and returns a list per column of ``kinds``. Other columns of the input do not
    reach the function or the result.
    """
    rows = docs.select(F.col(id_col).alias(id_col), whole_text(text_col).alias("text"))
    if as_bytes:
        rows = rows.withColumn("text", F.col("text").cast("binary"))
    schema = StructType([StructField(id_col, rows.schema[0].dataType)])
    for name, kind in kinds.items():
        schema = schema.add(name, DDL[kind])
    wanted = columns_of(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            found = work(batch.column(1).to_pylist())
            arrays = [pa.array(found[field.name], field.type) for field in wanted]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[id_col, *wanted.names])

    return rows.mapInArrow(run, schema)


def map_rows(docs: DataFrame, run: Callable, extra: Iterable[StructField] = ()) -> DataFrame:
    """``mapInArrow`` over whole rows, whatever their columns are called; ``run`` may add the fields of ``extra``.

    Meanwhile the columns have the names c0, c1 and so on, since a name with a dot cannot be passed on.
    """
    plain = [StructField(f"c{i}", field.dataType) for i, field in enumerate(docs.schema.fields)]
    extra = list(extra)
    done = docs.toDF(*[field.name for field in plain]).mapInArrow(run, StructType([*plain, *extra]))
    return done.toDF(*docs.columns, *[field.name for field in extra])


def keep_rows(docs: DataFrame, make: Callable[[], Callable[[list], list[bool]]], text_col: str = "text") -> DataFrame:
    """The rows, in all their columns, whose text the function keeps; ``make`` as in ``map_texts``."""
    position = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            kept = work([text or "" for text in batch.column(position).to_pylist()])
            yield batch.filter(pa.array(kept, pa.bool_()))

    return map_rows(docs, run)


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """All rows of a table that has to be small; more than ``limit`` is an error, never a cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows")
    return rows
