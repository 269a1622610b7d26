"""User-supplied extractors over distinct lines, and resuming an earlier output."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.text import strip
from logloom.operators.skew import lookup_join


def extract_with(
    lines: DataFrame,
    extractor: Callable[[pd.DataFrame], pd.DataFrame],
    columns: list[str],
    keys: tuple[str, ...] = ("template", "content"),
) -> DataFrame:
    """Run a batch extractor once per distinct line and hand the result to all equal lines.

    The extractor sees the key columns of a batch and returns ``columns``, row by row. A
    batch that fails is tried row by row, and a row that fails gets blanks.
    """
    key_list = list(keys)

    def blank() -> pd.DataFrame:
        return pd.DataFrame([[""] * len(columns)], columns=columns)

    def attempt(batch: pd.DataFrame) -> pd.DataFrame:
        found = extractor(batch).reset_index(drop=True)
        if len(found) != len(batch):
            raise ValueError("extractor must return one row per line")
        return found.reindex(columns=columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.reset_index(drop=True)
            try:
                found = attempt(batch)
            except Exception:  # noqa: BLE001 - one bad line must not lose its batch
                parts = []
                for i in range(len(batch)):
                    try:
                        parts.append(attempt(batch.iloc[[i]]))
                    except Exception:  # noqa: BLE001
                        parts.append(blank())
                found = pd.concat(parts, ignore_index=True) if parts else blank().iloc[:0]
            texts = found.fillna("").astype(str)
            yield pd.concat([batch[key_list], texts], axis=1)

    schema = ", ".join(f"`{c}` string" for c in [*key_list, *columns])
    distinct = lines.select(*key_list).distinct()
    # There may be nearly as many results as lines, so none is copied: beyond a broadcast
    # this is one shuffle join whose skewed partitions adaptive execution splits.
    return lookup_join(lines, distinct.mapInPandas(run, schema), key_list, salts=1)


def resume(rows: DataFrame, earlier: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows filled from an earlier output, and the rows that have to be computed.

    An earlier row counts when any of the columns is filled. The earlier output must have
    the same rows and columns.
    """
    if [c for c in columns if c not in earlier.columns]:
        raise ValueError("earlier output has other columns")
    old = earlier.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_old"))
    joined = rows.select(key, *[c for c in rows.columns if c not in columns and c != key]).join(old, key, "left")
    if not joined.filter("_old IS NULL").isEmpty():
        raise ValueError("earlier output lacks rows of the input")
    filled = F.lit(False)
    for c in columns:
        filled = filled | (strip(F.coalesce(F.col(f"_{c}"), F.lit(""))) != "")
    named = joined.withColumn("_filled", filled)
    base = [c for c in joined.columns if not c.startswith("_")]
    done = named.filter("_filled").select(*base, *[F.coalesce(F.col(f"_{c}"), F.lit("")).alias(c) for c in columns])
    return done, named.filter("NOT _filled").select(*base)


def only_named(rows: DataFrame, column: str, wanted: list[str], known: DataFrame) -> DataFrame:
    """Rows of the named groups; a name that does not exist is an error."""
    asked = rows.sparkSession.createDataFrame([(w,) for w in dict.fromkeys(wanted)], f"`{column}` string")
    missing = asked.join(known.select(column).distinct(), column, "left_anti")
    unknown = [r[0] for r in missing.collect()]
    if unknown:
        raise ValueError(f"unknown {column}: {', '.join(sorted(unknown))}")
    return rows.filter(F.col(column).isin(list(dict.fromkeys(wanted))))
