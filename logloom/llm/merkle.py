"""Merkle manifest of a table: a digest tree per group, a root over the groups, and a checked proof for every row.

The trees are reduced in tiers of superblocks (``SUPERBLOCK`` consecutive nodes, whole runs on each level), so that a
group of any size is many small groups of tasks. On the way down, the nodes of each superblock are cogrouped with what
they need from outside it (the path from the superblock to the root): one function finishes the local levels, joins
the two parts of every proof and folds it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.numbering import numbered
from logloom.session import scratch_path

FANOUT = 8
# Levels that one superblock spans, and the nodes that it therefore holds.
LEVELS = 3
SUPERBLOCK = FANOUT**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_of(values: Iterable[Column]) -> Column:
    """SHA-256 (hex) of the values: ``-`` for a null, else the UTF-8 byte count, a colon and the value as text."""
    texts = [value.cast("string") for value in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def digest_of(nodes: Iterable[bytes]) -> bytes:
    return hashlib.sha256(b"".join(nodes).hex().encode()).digest()


def local_levels(nodes: list[bytes], width: int) -> list[list[bytes]]:
    """Levels of one superblock, the given nodes first; ``width`` is the number of such nodes in the whole tree."""
    levels = [nodes]
    while width > 1 and len(levels) <= LEVELS:
        below = levels[-1]
        levels.append([digest_of(below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)])
        width = -(-width // FANOUT)
    return levels


def local_path(levels: list[list[bytes]], at: int) -> list[bytes]:
    """One step per level: the place in the run as a byte, then the other nodes of the run."""
    steps = []
    for nodes in levels[:-1]:
        start = at - at % FANOUT
        run = nodes[start : start + FANOUT]
        steps.append(bytes([at - start]) + b"".join(run[: at - start] + run[at - start + 1 :]))
        at //= FANOUT
    return steps


def fold(leaf: bytes, path: Iterable[bytes]) -> bytes:
    """The root that a leaf and its path lead to."""
    for step in path:
        cut = 1 + 32 * step[0]
        leaf = digest_of((step[1:cut], leaf, step[cut:]))
    return leaf


def path_digest(path: Iterable[bytes]) -> bytes:
    return digest_of(step[1:] for step in path)


def _reduce(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("pos")
    width = int(rows["n"].iloc[0])
    top = local_levels([bytes(d) for d in rows["digest"]], width)[-1][0]
    return pd.DataFrame({"g": [key[0]], "pos": [key[1]], "digest": [top], "n": [-(-width // SUPERBLOCK)]})


def _extend(key: tuple, rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Path of every node of a superblock: the local steps, then those of the superblock."""
    rows = rows.sort_values("pos")
    levels = local_levels([bytes(d) for d in rows["digest"]], int(rows["n"].iloc[0]))
    above, subroot = list(outer["path"].iloc[0]), outer["subroot"].iloc[0]
    paths = [local_path(levels, at) + above for at in range(len(rows))]
    return pd.DataFrame({"g": key[0], "pos": rows["pos"].to_numpy(), "path": paths, "subroot": [subroot] * len(rows)})


def _prove(key: tuple, rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """As ``_extend`` for leaves, with the digest of each path and what the leaf as found folds to."""
    rows = rows.sort_values("pos")
    leaves = [bytes(d) for d in rows["digest"]]
    levels = local_levels(leaves, int(rows["n"].iloc[0]))
    above, subroot = [bytes(step) for step in outer["path"].iloc[0]], bytes(outer["subroot"].iloc[0]).hex()
    proofs, folded, paths = [], [], []
    for at, (leaf, found) in enumerate(zip(leaves, rows["found"])):
        path = local_path(levels, at) + above
        paths.append(path)
        proofs.append(path_digest(path).hex())
        folded.append(fold(leaf if found is None else bytes(found), path).hex())
    return pd.DataFrame(
        {
            "id": rows["id"].to_numpy(), "leaf": [leaf.hex() for leaf in leaves], "subroot": subroot,
            "proof_sha256": proofs, "folded_root": folded, "path": paths,
        }
    )


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


NODE = "g string, pos long, digest binary, n long"
PATH = "g string, pos long, path array<binary>, subroot binary"


def _blocks(rows: DataFrame) -> DataFrame:
    return rows.withColumn("block", F.floor(F.col("pos") / F.lit(SUPERBLOCK)).cast("long"))


def _tiers(nodes: DataFrame) -> list[DataFrame]:
    """The nodes and the tiers above them; in the last one each group has one node."""
    tiers = [nodes]
    width = nodes.agg(F.max("n").alias("n")).first()["n"] or 1
    while width > 1:
        below = _blocks(tiers[-1].select("g", "pos", "digest", "n"))
        tiers.append(_stored(below.groupBy("g", "block").applyInPandas(_reduce, NODE), "merkle-tier"))
        width = -(-width // SUPERBLOCK)
    return tiers


def _paths(tier: DataFrame, above: DataFrame) -> DataFrame:
    """Paths of a tier's nodes from those of the tier above."""
    nodes = _blocks(tier.select("g", "pos", "digest", "n")).groupBy("g", "block")
    outer = above.withColumnRenamed("pos", "block").groupBy("g", "block")
    return _stored(nodes.cogroup(outer).applyInPandas(_extend, PATH), "merkle-paths")


def manifest(
    docs: DataFrame,
    fields: Iterable[str] = FIELDS,
    group: str = "lang",
    order: str = "doc_id",
    changed: dict[str, Column] | None = None,
    with_path: bool = False,
) -> DataFrame:
    """One row per row of the table: its id, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    ``fields`` make the leaf. Rows of a ``group`` value (null is a group of its own, the first one) form a tree in
    ascending ``order``; groups ascend bytewise. ``changed`` gives the fields as they are found later, as columns of
    ``docs``: what the found row's leaf and the stored siblings fold to is ``folded_root``, and ``verified`` says
    whether that is the root. ``with_path`` adds ``path``, a step per level (place in the run, then the siblings).

    Null ids come first; repeated ids are ordered by their leaf, and equal rows have equal leaves, each at a place of
    its own. Null and empty texts differ. A text of any length is hashed in one pass inside the JVM and never leaves
    it. An empty table gives no rows. Other columns, whatever their names, neither count nor reach the result.
    """
    spark = docs.sparkSession
    id_type = docs.schema[order].dataType
    # Every name is taken before new ones are made, so that no column of the table can clash.
    changed = changed or {}
    leaf = leaf_of(F.col(f"`{name}`") for name in fields)
    found = leaf_of(changed.get(name, F.col(f"`{name}`")) for name in fields) if changed else leaf
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    leaves = docs.select(
        F.col(f"`{order}`").alias("id"), key.alias("g"), F.unhex(leaf).alias("digest"),
        F.when(found != leaf, F.unhex(found)).alias("found"),
    )
    leaves = _stored(leaves, "merkle-leaves")
    # Ids pass through pandas as text: a nullable integer would become a float there.
    leaves = numbered(leaves, "g", ["id", "digest"]).withColumn("id", F.col("id").cast("string"))
    tiers = _tiers(leaves)
    subroots = tiers[-1].select("g", "digest")
    over = _stored(numbered(subroots.select(F.lit("").alias("all"), F.col("g").alias("name"), "digest"), "all", ["name"]), "merkle-subroots")
    upper = _tiers(over.select(F.col("all").alias("g"), "pos", "digest", "n"))
    top = upper[-1].first()
    root = bytes(top["digest"]).hex() if top else ""
    paths = upper[-1].select("g", "pos", F.array().cast("array<binary>").alias("path"), F.lit(None).cast("binary").alias("subroot"))
    for tier in upper[-2::-1]:
        paths = _paths(tier, paths)
    named = over.select("pos", "name", "digest").join(paths.select("pos", "path"), "pos")
    paths = named.select(F.col("name").alias("g"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"))
    for tier in tiers[-1:0:-1]:
        if tier is not tiers[-1]:
            paths = _paths(tier, paths)
    nodes = _blocks(leaves).groupBy("g", "block")
    outer = paths.withColumnRenamed("pos", "block").groupBy("g", "block")
    schema = "id string, leaf string, subroot string, proof_sha256 string, folded_root string, path array<binary>"
    if not with_path:
        schema = schema.removesuffix(", path array<binary>")

    def prove(key: tuple, rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        proved = _prove(key, rows, outer)
        return proved if with_path else proved.drop(columns="path")

    proved = nodes.cogroup(outer).applyInPandas(prove, schema)
    return proved.select(
        F.col("id").cast(id_type).alias(order), "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == F.lit(root)).alias("verified"), *(["path"] if with_path else []),
    )


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other letter as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tampered(doc_id: str = "doc_id", text: str = "text", every: int = 3) -> dict[str, Column]:
    """The text as a tamperer leaves it: lower-cased in the rows whose crc32 of the id ``every`` divides."""
    hit = F.crc32(F.col(doc_id).cast("string").cast("binary")) % every == 0
    return {text: F.when(hit, lower_ascii(F.col(text))).otherwise(F.col(text))}
