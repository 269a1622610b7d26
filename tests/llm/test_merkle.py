"""The manifest against a tree built plainly, with more tiers than the given tables need."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from logloom.llm import merkle, numbering

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, pos long, digest string, path string, id string, _row long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = (row[0], row[3], row[2], row[4], text)
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """(top, list of siblings and place per node) of a list of digests."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, path in enumerate(paths):
            start = at[i] - at[i] % 8
            run = nodes[start : start + 8]
            path.append((at[i] - start, run[: at[i] - start] + run[at[i] - start + 1 :]))
            at[i] //= 8
        nodes = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def by_force(rows):
    groups = defaultdict(list)
    for row in rows:
        found = row[1]
        if found is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
            found = "".join(c.lower() if "A" <= c <= "Z" else c for c in found)
        groups[row[2]].append((row[0] is not None, row[0] or 0, leaf(row, row[1]), leaf(row, found)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = {}
    for name in names:
        groups[name].sort(key=lambda r: r[:3])
        tops[name] = climb([r[2] for r in groups[name]])
    root, upper = climb([tops[name][0] for name in names])
    out = Counter()
    for name, above in zip(names, upper):
        for row, path in zip(groups[name], tops[name][1]):
            path, digest = path + above, row[3]
            for place, others in path:
                digest = h(*others[:place], digest, *others[place:])
            proof = h(*(x for _, others in path for x in others))
            out[(row[1] if row[0] else None, row[2], tops[name][0], root, proof, digest, digest == root)] += 1
    return out


def table(n, langs, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = rng.choice([None, "", "Abc", "abc", f"Text {i} Ä漢", "x" * 100_000 if i % 97 == 0 else "YES"])
        rows.append((rng.choice([None, i, i, 7 * i]), text, rng.choice(langs), rng.choice([None, "s:1"]), rng.choice([None, 3]), "g", 5, "d", "p", "i", 1))
    return rows + rows[:3]


def found(frame):
    return Counter(
        tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in frame.collect()
    )


@pytest.mark.parametrize("n, langs, levels", [(700, [None, "", "en", "En", "ü"], 1), (90, [None, *map(str, range(70))], 1), (600, ["a"], 3), (1, [None], 3)])
def test_manifest_equals_plain_trees(spark, monkeypatch, n, langs, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "SUPERBLOCK", 8**levels)
    rows = table(n, langs, n)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(merkle.manifest(docs, changed=merkle.tampered())) == by_force(rows)


def test_paths_fold_to_the_root(spark):
    docs = spark.createDataFrame(table(60, ["a", "b"], 3), SCHEMA)
    for row in merkle.manifest(docs, with_path=True).collect():
        path = [bytes(step) for step in row["path"]]
        assert merkle.fold(bytes.fromhex(row["leaf"]), path).hex() == row["root"] and row["verified"]
        assert merkle.path_digest(path).hex() == row["proof_sha256"]
        assert merkle.fold(bytes(32), path).hex() != row["root"]


def test_empty_table(spark):
    empty = merkle.manifest(spark.createDataFrame([], SCHEMA), changed=merkle.tampered())
    assert empty.count() == 0 and empty.columns[0] == "doc_id"


@pytest.mark.parametrize("limit", [0, 100])
def test_positions_of_a_hot_key(spark, monkeypatch, limit):
    monkeypatch.setattr(numbering, "BROADCAST_ROWS", limit)
    rows = spark.range(1000).select(F.when(F.col("id") % 10 < 7, "hot").otherwise(F.col("id").cast("string")).alias("k"), (-F.col("id")).alias("o"))
    got = numbering.numbered(rows, "k", ["o"]).filter("k = 'hot'").orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(700)) and {r["n"] for r in got} == {700}
    assert [r["o"] for r in got] == sorted(r["o"] for r in got)
