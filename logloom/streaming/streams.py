"""The same row-local work on streams, and rule state kept per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logloom.operators.templates import preprocess

STATE = "policy_type string, src string, dst string"
STATE_FIELDS = ["policy_type", "src", "dst"]
# Rows of a key that are Python objects at a time; the others wait in Arrow's columns.
CHUNK_ROWS = 10_000
STATE_OUTPUT = f"state_key string, row_id long, {STATE}"


def read_line_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """New lines of text files as they arrive, with their file as source."""
    return (
        spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
        .text(folder)
        .select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("original_content"))
    )


def preprocessed_stream(lines: DataFrame) -> DataFrame:
    return preprocess(lines)


def _packed(batch: pd.DataFrame) -> pa.Table:
    """The columns that state depends on, without a Python object per value."""
    texts = [f"{side}_{name}" for name in STATE_FIELDS for side in ("own", "default")]
    cells = {c: pa.array(batch[c], from_pandas=True) for c in ("time", "row_id", "reset")}
    return pa.table(cells | {c: pa.array(batch[c], pa.string(), from_pandas=True) for c in texts})


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    current = list(state.get) if state.exists else [None] * len(STATE_FIELDS)
    rows = pa.concat_tables([_packed(b) for b in batches], promote_options="permissive")
    order = pc.sort_indices(rows, sort_keys=[("time", "ascending"), ("row_id", "ascending")])
    for start in range(0, len(order), CHUNK_ROWS):
        part = rows.take(order.slice(start, CHUNK_ROWS)).to_pydict()
        sides = [list(zip(part[f"own_{name}"], part[f"default_{name}"])) for name in STATE_FIELDS]
        out = []
        for at, (row_id, reset) in enumerate(zip(part["row_id"], part["reset"])):
            for n, side in enumerate(sides):
                own, default = side[at]
                current[n] = own or current[n] or default or None
            out.append((key[0], row_id, *current))
            if reset:
                current = [None] * len(STATE_FIELDS)
        yield pd.DataFrame(out, columns=["state_key", "row_id", *STATE_FIELDS])
    state.update(tuple(current))


def rule_state_stream(changes: DataFrame) -> DataFrame:
    """Effective policy, source and target of every change of a rule.

    Columns state_key, time, row_id, reset, own_* and default_* for policy_type, src, dst. A
    key's rows are ordered by time inside a micro-batch, whose size the source's trigger
    limits; rows of later batches count as later. A task holds its key's rows of the micro-batch as
    Arrow columns.
    """
    return changes.groupBy("state_key").applyInPandasWithState(
        _advance, STATE_OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout
    )
