"""Main text of web pages: boosted trees over the nodes of a page, decoded so that no kept node has a dropped ancestor."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from logloom.llm import boosting, dom, layouts

# Pages that the trees are fitted on. They are made by rules and the same everywhere, so a page's text depends on
# nothing but the page.
TRAINING_PAGES = 1000
# Cost of leaving a node out of a kept parent, in log odds: without it every block would be decided alone.
CUT_COST = 0.7

# Element names by the part that they play.
KINDS = (
    {dom.TEXT}, {"article"}, {"main"}, {"section"}, {"div", "center"}, {"p"}, dom.HEADINGS, {"ul", "ol", "dl", "dir"}, {"li", "dd", "dt"},
    {"nav", "menu"}, {"header", "hgroup"}, {"footer"}, {"aside"}, {"form", "fieldset", "legend", "search", "dialog"},
    {"table", "tbody", "thead", "tfoot", "tr", "caption"}, {"td", "th"}, {"blockquote", "pre"}, {"figure", "figcaption"},
)
KIND_OF = {name: i for i, names in enumerate(KINDS) for name in names}
OTHER = len(KINDS)
BIT_OF = {word: 1 << layouts.GROUPS.index(group) for word, group in layouts.GROUP_OF.items()}
N_GROUPS = len(layouts.GROUPS)
# Element kinds that say something about all that they hold.
AROUND = [KIND_OF[name] for name in ("article", "main", "nav", "header", "footer", "aside", "form", "li", "table")]


def word_bits(words: tuple) -> int:
    bits = 0
    for word in words:
        bits |= BIT_OF.get(word, 0) or (BIT_OF.get(word[:-1], 0) if word.endswith("s") else 0)
    return bits


def features(pages: list[dom.Page]) -> np.ndarray:
    """One row per node of all pages, in order: kinds and attribute words of the node and around it, density of its
    subtree, depth and place, and the same for its neighbours and its parent."""
    sizes = [len(page.tags) for page in pages]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    n = int(starts[-1])
    first = np.repeat(starts[:-1], sizes)
    whole = lambda name: np.fromiter((x for page in pages for x in getattr(page, name)), np.int64, n)
    parent, end, depth = whole("parents") + first, whole("ends") + first, whole("depths")
    root = np.zeros(n, bool)
    root[starts[:-1]] = True
    parent[root] = starts[:-1]
    kind, own = np.empty(n, np.int64), np.zeros(n, np.int64)
    texts, at = [], 0
    for page in pages:
        for tag, words in zip(page.tags, page.words):
            kind[at] = KIND_OF.get(tag, OTHER)
            if words:
                own[at] = word_bits(words)
            at += 1
        texts += page.texts
    count = lambda f: np.fromiter(map(f, texts), np.float64, n)
    leaf = (kind == 0).astype(np.float64)
    counts = np.stack([
        count(len), whole("linked"), count(lambda t: t.count(".") + t.count("?") + t.count("!") + t.count("。")),
        count(lambda t: t.count(",")), count(lambda t: t.count(" ")), leaf, 1 - leaf, whole("inline"),
    ])
    before = np.concatenate([np.zeros((len(counts), 1)), counts.cumsum(axis=1)], axis=1)
    chars, linked, stops, commas, blanks, leaves, elements, inline = before[:, end] - before[:, :n]
    page_end = np.repeat(starts[1:], sizes)
    page_chars = before[0, page_end] - before[0, first]
    longest = np.zeros(n)
    np.maximum.at(longest, np.arange(n), counts[0])
    # What holds around a node: from the top of the page down, level by level.
    around = np.zeros(n, np.int64)
    mark = own << len(AROUND)
    for bit, wanted in enumerate(AROUND):
        mark |= (kind == wanted).astype(np.int64) << bit
    index = np.arange(n)
    n_children = np.bincount(parent[~root], minlength=n)
    previous, following, place = index.copy(), index.copy(), np.zeros(n)
    for level in range(1, int(depth.max(initial=0)) + 1):
        here = np.flatnonzero(depth == level)
        around[here] = around[parent[here]] | mark[parent[here]]
    # A node that ends where another with the same parent begins stands before it.
    follows = np.flatnonzero(~root & (end < page_end))
    follows = follows[parent[end[follows]] == parent[follows]]
    following[follows], previous[end[follows]] = end[follows], follows
    order = np.lexsort((index, parent))
    order = order[~root[order]]
    if len(order):
        new = np.concatenate([[True], parent[order][1:] != parent[order][:-1]])
        run = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        place[order] = np.arange(len(order)) - run
    length, link_share = np.log1p(chars), linked / np.maximum(chars, 1)
    mean_leaf, stop_rate = chars / np.maximum(leaves, 1), stops / np.maximum(chars, 1)
    alone_before, alone_after = previous == index, following == index
    columns = [
        depth, length, link_share, stop_rate, commas / np.maximum(chars, 1), chars / np.maximum(blanks + leaves, 1), mean_leaf,
        leaves, elements, chars / np.maximum(elements + inline, 1), chars / np.maximum(page_chars, 1),
        (before[0, :n] - before[0, first]) / np.maximum(page_chars, 1), page_chars,
        place, n_children[parent], place / np.maximum(n_children[parent], 1), n_children,
        np.where(alone_before, -1, length[previous]), np.where(alone_after, -1, length[following]),
        np.where(alone_before, -1, link_share[previous]), np.where(alone_after, -1, link_share[following]),
        np.where(alone_before, -1, kind[previous] == KIND_OF["h1"]), np.where(alone_before, -1, kind[previous] == kind),
        np.where(alone_after, -1, kind[following] == kind), length[parent], link_share[parent], mean_leaf[parent], stop_rate[parent],
        chars / np.maximum(chars[parent], 1), own != 0,
        *[kind == k for k in range(OTHER + 1)], *[kind[parent] == k for k in range(OTHER + 1)],
        *[own >> b & 1 for b in range(N_GROUPS)], *[around >> b & 1 for b in range(len(AROUND) + N_GROUPS)],
        *[own[parent[parent]] >> b & 1 for b in (2, 8)],
    ]
    return np.stack([np.asarray(c, np.float32) for c in columns], axis=1)


@lru_cache(maxsize=2)
def model(pages: int = TRAINING_PAGES) -> boosting.Trees:
    """Trees for "this node holds text of the article", fitted on ``pages`` made pages."""
    parsed, wanted, weights = [], [], []
    for seed in range(pages):
        maker = layouts.Maker(seed)
        page = dom.parse(maker.page())
        gold = set(maker.gold)
        holds = np.array([text in gold and tag == dom.TEXT for tag, text in zip(page.tags, page.texts)], np.int64)
        sums = np.concatenate([[0], holds.cumsum()])
        parsed.append(page)
        wanted.append(sums[page.ends] > sums[: len(holds)])
        # Every page weighs about the same, however many nodes it has.
        weights.append(np.full(len(holds), (40 / len(holds)) ** 0.5))
    return boosting.fit(features(parsed), np.concatenate(wanted).astype(np.float64), np.concatenate(weights))


def decode(page: dom.Page, odds: list[float]) -> list[bool]:
    """Which nodes are kept: the most likely choice in which a dropped node has no kept descendant.

    From the leaves up, each node's best gain of being kept (its own log odds plus what its children gain, each kept
    or dropped as a whole) is compared with dropping it, which costs ``CUT_COST``; from the root down the choice is read.
    """
    gain = list(odds)
    gain[0] = 0.0
    parents = page.parents
    for node in range(len(odds) - 1, 0, -1):
        gain[parents[node]] += max(gain[node], -CUT_COST)
    kept = [True] * len(odds)
    for node in range(1, len(odds)):
        kept[node] = kept[parents[node]] and gain[node] > -CUT_COST
    return kept


def main_texts(sources: list[str], trees: boosting.Trees) -> list[list[str]]:
    """Blocks of the main text of each page, in page order."""
    pages = [dom.parse(source) for source in sources]
    odds = trees.score(features(pages)).tolist()
    out, at = [], 0
    for page in pages:
        kept = decode(page, odds[at : at + len(page.tags)])
        at += len(page.tags)
        out.append([text for text, keep in zip(page.texts, kept) if keep and text])
    return out


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: Iterable[str] = ()) -> DataFrame:
    """(id, columns of ``keep``, text, n_chars) of every page; blocks are joined by an empty line, nothing found is an empty text.

    A null page reads as an empty one. A page of any length is parsed whole and in one pass; nodes are scored a batch
    of pages at a time. Repeated rows give repeated results, an empty table gives none, and columns that are not named
    are not read, whatever they are called.
    """
    trees = model()
    passed = [F.col(f"`{name}`") for name in (id_col, *keep)]
    rows = pages.select(*passed, F.coalesce(F.col(f"`{html_col}`"), F.lit("")))
    # Plain names meanwhile: those of the table may hold dots.
    kept = [StructField(f"c{i}", field.dataType) for i, field in enumerate(rows.schema.fields[:-1])]
    schema = StructType([*kept, StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, sources = batch.columns
            texts = ["\n\n".join(blocks) for blocks in main_texts(sources.to_pylist(), trees)] if len(batch) else []
            columns += [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    plain = rows.toDF(*schema.names[: len(rows.columns) - 1], "html")
    return plain.mapInArrow(run, schema).toDF(id_col, *keep, "text", "n_chars")
