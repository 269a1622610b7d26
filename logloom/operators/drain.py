"""Online template clustering in line order.

The published algorithm visits lines one after another. Lines of one source and token count form an
independent stream. A stream is sorted by line and read through an iterator that holds its clusters, not
its lines: the result does not depend on batch size or partitioning, and every size gives the result of
the plain sequential pass.

Most lines repeat an earlier one, and a repeat is read only where it may matter. A line's cluster depends on the
templates filed under its first token and under the wildcard. As long as none of them changes, equal lines get the same
cluster and change nothing. So a stream comes as its distinct token lists, in the order of their first lines and each with
the numbers of all its lines. A change of a branch calls for the next line of every list that looks there; those lines
wait in a heap for their place in the order. All other lines take the cluster of their list's last one that was read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.text import WILDCARD, event_id
from logloom.operators.skew import BROADCAST_BYTES, Lookup, lookup_join, text_bytes
from logloom.operators.templates import WORD_MARK, routed
from logloom.session import release, stored

# Least similarity of a line and its cluster, most branches of one level.
SIMILARITY = 0.5
BRANCHES = 100
STREAM = ["source", "n_tokens"]
# Branches of more clusters are compared as numbers; number of a template's wildcard.
FEW = 2
WILD_NUMBER = -1


class _Branches:
    """Clusters of one stream, filed under their first token."""

    def __init__(self) -> None:
        self.members: dict[str, list[int]] = {}

    def branch(self, token: str) -> str:
        """Where clusters for a line with this first token are looked for."""
        return token if token in self.members else WILDCARD

    def file(self, token: str, cluster: int) -> str:
        if token not in self.members and not self._may_open(token):
            token = WILDCARD
        self.members.setdefault(token, []).append(cluster)
        return token

    def _may_open(self, token: str) -> bool:
        if any(ch.isdigit() for ch in token):
            return False
        reserved = 0 if WILDCARD in self.members else 1
        return len(self.members) + reserved < BRANCHES


class _Matrix:
    """Templates of one branch as columns of token numbers, so that a line is compared with all of them at once."""

    def __init__(self, width: int) -> None:
        self.rows, self.wild = np.empty((width, 4 * FEW), np.int32), np.empty(4 * FEW, np.int32)
        self.clusters: list[int] = []
        self.place: dict[int, int] = {}
        # The smallest numbers that can count the tokens of a line add up fastest.
        self.count = np.min_scalar_type(width)

    def put(self, cluster: int, numbers: np.ndarray) -> None:
        at = self.place.setdefault(cluster, len(self.clusters))
        if at == len(self.clusters):
            self.clusters.append(cluster)
            if at == self.rows.shape[1]:
                self.rows, self.wild = np.concatenate([self.rows, self.rows], axis=1), np.concatenate([self.wild, self.wild])
        self.rows[:, at] = numbers
        self.wild[at] = np.count_nonzero(numbers == WILD_NUMBER)

    def best(self, numbers: np.ndarray) -> tuple[int, int]:
        """The first cluster with the most equal tokens, and of those the most wildcards; and how many are equal."""
        n = len(self.clusters)
        same = (self.rows[:, :n] == numbers[:, None]).view(np.uint8).sum(axis=0, dtype=self.count)
        most = same.max()
        among = np.flatnonzero(same == most)
        return self.clusters[among[self.wild[among].argmax()]], int(most)


class Clusters:
    """Templates of one stream so far, in the order of their first lines."""

    def __init__(self, similarity: float = SIMILARITY) -> None:
        self.similarity, self.branches = similarity, _Branches()
        self.templates: list[list[str]] = []
        self.matrices: dict[str, _Matrix] = {}
        self.numbers: dict[str, int] = defaultdict(count().__next__)
        self.numbers[WILDCARD] = WILD_NUMBER

    def _numbered(self, words: list[str], wild: int) -> np.ndarray:
        """Token numbers; a wildcard of a template and one of a line differ, because they never count as equal."""
        numbers = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
        if wild != WILD_NUMBER:
            numbers[numbers == WILD_NUMBER] = wild
        return numbers

    def _nearest(self, branch: str, words: list[str]) -> tuple[int, float]:
        members = self.branches.members.get(branch, ())
        if len(members) > FEW:
            if branch not in self.matrices:
                matrix = self.matrices[branch] = _Matrix(len(words))
                for number in members:
                    matrix.put(number, self._numbered(self.templates[number], WILD_NUMBER))
            best, same = self.matrices[branch].best(self._numbered(words, WILD_NUMBER - 1))
            return best, same / len(words)
        best, best_rank = -1, (-1.0, -1)
        for number in members:
            template = self.templates[number]
            same = sum(a == b and a != WILDCARD for a, b in zip(template, words))
            rank = (same / len(words), template.count(WILDCARD))
            if rank > best_rank:
                best, best_rank = number, rank
        return best, best_rank[0]

    def add(self, words: list[str]) -> tuple[int, str | None]:
        """Number of the cluster that takes the line, widened to cover it, and the branch that this changed, if any."""
        best, likeness, branch = -1, -1.0, WILDCARD
        if len(words) > 1:
            branch = self.branches.branch(words[0])
            best, likeness = self._nearest(branch, words)
        if likeness < self.similarity:
            self.templates.append(list(words))
            best = len(self.templates) - 1
            if len(words) <= 1:
                return best, None
            branch = self.branches.file(words[0], best)
        else:
            wider = [a if a == b else WILDCARD for a, b in zip(self.templates[best], words)]
            if wider == self.templates[best]:
                return best, None
            self.templates[best] = wider
        if branch in self.matrices:
            self.matrices[branch].put(best, self._numbered(self.templates[best], WILD_NUMBER))
        return best, branch


def cluster_in_order(token_lists: list[list[str]], similarity: float = SIMILARITY) -> list[str]:
    """Final template of every line, for lines of one token count in their order."""
    clusters = Clusters(similarity)
    owner = [clusters.add(list(words))[0] for words in token_lists]
    return [" ".join(clusters.templates[number]) for number in owner]


FOUND = "source string, n_tokens int, ord long, cluster int, template string, turn int"
ARROW = pa.schema(
    [("source", pa.string()), ("n_tokens", pa.int32()), ("ord", pa.int64()), ("cluster", pa.int32()), ("template", pa.string()), ("turn", pa.int32())]
)
# Rows and characters that a task gathers before it sends them on.
ROWS, CHARACTERS = 10_000, 8 * 1024 * 1024


class _Repeated:
    """A token list with several lines: their numbers, and the cluster of those from ``at`` on."""

    def __init__(self, words: list[str], ords: np.ndarray) -> None:
        self.words, self.ords = words, ords
        self.at, self.cluster, self.waiting = 0, -1, False


class _Stream:
    """One stream, read in order; what was found out is handed to ``tell``."""

    def __init__(self, source: str, size: int, tell) -> None:
        self.source, self.size, self.tell = source, size, tell
        self.clusters = Clusters()
        # Lists of which no later line has to be read, by the branches that they look at.
        self.settled: dict[str, list[_Repeated]] = {}
        self.waiting: list[tuple[int, int, _Repeated]] = []
        self.pushed = 0

    def _changed(self, branch: str, at: int) -> None:
        """The next line, behind ``at``, of every list that looks at the branch has to be read."""
        for known in self.settled.pop(branch, ()):
            if known.waiting:
                continue
            following = int(known.ords.searchsorted(at, "right"))
            if following < len(known.ords):
                known.waiting = True
                self.pushed += 1
                heappush(self.waiting, (int(known.ords[following]), self.pushed, known))

    def _read(self, known: _Repeated, at: int, turn: int) -> None:
        cluster, branch = self.clusters.add(known.words)
        here = int(known.ords.searchsorted(at))
        self._told(known, here)
        self.tell(self.source, self.size, at, cluster, None, turn)
        known.at, known.cluster, known.waiting = here + 1, cluster, False
        if here + 1 < len(known.ords):
            for look in {known.words[0], WILDCARD}:
                self.settled.setdefault(look, []).append(known)
        if branch is not None:
            self._changed(branch, at)

    def _told(self, known: _Repeated, end: int) -> None:
        """The lines that were not read, up to ``end``, have the cluster of the last one that was."""
        for number in known.ords[known.at : end].tolist():
            self.tell(self.source, self.size, number, known.cluster, None, None)

    def until(self, end: int | None) -> None:
        while self.waiting and (end is None or self.waiting[0][0] < end):
            at, _, known = heappop(self.waiting)
            self._read(known, at, 1)

    def add(self, at: int, words: list[str], ords: list[int] | None) -> _Repeated | None:
        self.until(at)
        if ords is not None:
            known = _Repeated(words, np.unique(np.array(ords, np.int64)))
            self._read(known, at, 0)
            return known
        cluster, branch = self.clusters.add(words)
        self.tell(self.source, self.size, at, cluster, None, 0)
        if branch is not None:
            self._changed(branch, at)
        return None

    def end(self, repeated: list[_Repeated]) -> None:
        self.until(None)
        for known in repeated:
            self._told(known, len(known.ords))
        for number, template in enumerate(self.clusters.templates):
            self.tell(self.source, self.size, None, number, " ".join(template), None)


def _read_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct token lists of whole streams in order: each line's cluster, then a row per cluster with its last
    template. A line of one token, or none, is a template of its own."""
    ready, rows, held = [], [], 0

    def packed() -> pa.RecordBatch:
        cells = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, ARROW)], schema=ARROW)

    def tell(*row) -> None:
        nonlocal rows, held
        rows.append(row)
        held += len(row[4] or "")
        if len(rows) >= ROWS or held > CHARACTERS:
            ready.append(packed())
            rows, held = [], 0

    stream, repeated = None, []
    for batch in batches:
        for source, size, at, text, ords in zip(*(batch.column(c).to_pylist() for c in ("source", "n_tokens", "ord", "text", "ords"))):
            if size <= 1:
                for n, number in enumerate([at] if ords is None else sorted(set(ords))):
                    tell(source, size, number, None, text, None if n else 0)
                continue
            if stream is None or (source, size) != (stream.source, stream.size):
                if stream is not None:
                    stream.end(repeated)
                stream, repeated = _Stream(source, size, tell), []
            known = stream.add(at, text.split(WORD_MARK), ords)
            if known is not None:
                repeated.append(known)
            if ready:
                yield from ready
                ready.clear()
    if stream is not None:
        stream.end(repeated)
    yield from ready
    if rows:
        yield packed()


@dataclass
class Streams:
    """Clusters of all lines: (source, n_tokens, ord, cluster), the last template of every cluster, the templates of
    lines of at most one token, and how many lines were read: of every list the first one, and later ones."""

    owners: DataFrame
    templates: DataFrame
    short: DataFrame
    read: list[int]


def cluster_streams(lines: DataFrame) -> Streams:
    """Online clustering of lines (source, n_tokens, ord, tokens), as one pass over all would do it.

    A line without a source or a number belongs to no stream. The text of a line crosses the network once, to the task
    of its stream (short ones, which need no order, to any), and is stored once, as a part of a template.
    """
    text = F.array_join("tokens", WORD_MARK).alias("text")
    sent = lines.filter("source IS NOT NULL AND ord IS NOT NULL").select(*STREAM, "ord", text)
    sent = sent.withColumn("_deal", F.when(F.col("n_tokens") <= 1, F.xxhash64("text")).otherwise(0))
    keys = [*STREAM, "_deal"]
    every = F.collect_list("ord")
    lists = sent.repartition(*keys).groupBy(*keys, "text").agg(F.min("ord").alias("ord"), every.alias("ords"))
    lists = lists.withColumn("ords", F.when(F.size("ords") > 1, F.col("ords"))).sortWithinPartitions(*STREAM, "ord")
    found = stored(lists.select(*STREAM, "ord", "text", "ords").mapInArrow(_read_streams, FOUND), "streams")
    # The shuffled texts are not needed any more.
    del sent, lists
    release(lines.sparkSession)
    turns = found.agg(*[F.count_if(F.col("turn") == n) for n in (0, 1)]).first()
    return Streams(
        found.filter("ord IS NOT NULL AND cluster IS NOT NULL").select(*STREAM, "ord", "cluster"),
        found.filter("ord IS NULL").select(*STREAM, "cluster", "template"),
        found.filter("cluster IS NULL").select(*STREAM, "ord", "template"),
        list(turns),
    )


def tokenised(lines: DataFrame, masked: bool = True) -> DataFrame:
    return routed(lines, masked).select("source", "n_tokens", F.col("line_id").alias("ord"), "tokens")


def drain(lines: DataFrame, masked: bool = True) -> DataFrame:
    """Lines (source, line_id, content) with the template and event id of their cluster."""
    found = cluster_streams(tokenised(lines, masked))
    # Lines meet numbers of clusters, and those their texts.
    short = found.short.withColumn("cluster", F.lit(None).cast("int")).withColumnRenamed("template", "_short")
    places = found.owners.withColumn("_short", F.lit(None).cast("string")).unionByName(short)
    placed = lines.join(places.withColumnRenamed("ord", "line_id"), ["source", "line_id"])
    small = text_bytes(found.templates) <= BROADCAST_BYTES
    named = lookup_join(placed, Lookup(found.templates, small), [*STREAM, "cluster"])
    rest = [c for c in lines.columns if c not in ("source", "line_id")]
    template = F.coalesce("template", "_short").alias("template")
    return named.select("source", "line_id", *rest, "n_tokens", template).withColumn("event_id", event_id(F.col("template")))
