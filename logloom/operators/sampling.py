"""Representative lines: deterministic caps, farthest-first picks, sample banks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.regexes import without_commas
from logloom.functions.similarity import METRICS, distance, square
from logloom.functions.text import strip, tokens
from logloom.operators.skew import BROADCAST_BYTES, SALTS, first_rows, lookup, lookup_join, text_bytes
from logloom.session import durable

# Most lines of a capped group, and lines picked of each.
CANDIDATES = 200
PICKS = 3
SEED = 42
# Rarest tokens of a set by which its first partner is chosen.
SEEDS = 8
# Part of the needed common tokens that a pair must show before it is compared.
SHARE = 0.75
# Cells (texts times selected texts, or index entries) that a task holds as numbers at a time.
CELLS = 1 << 21


def hashed_order(columns: list[str], seed: int = SEED) -> list[Column]:
    """A reproducible shuffle: order by the digest of seed and columns."""
    return [F.md5(F.concat_ws("::", F.lit(str(seed)), *[F.col(c) for c in columns]).cast("binary"))]


def random_cap(lines: DataFrame, keys: list[str], most: int = CANDIDATES, seed: int = SEED) -> DataFrame:
    """At most ``most`` lines of every group, chosen by hash order."""
    return first_rows(lines, keys, [*hashed_order(["content"], seed), F.col("line_id")], most).drop("_rank")


def representative(
    lines: DataFrame,
    keys: list[str],
    k: int = PICKS,
    metric: str = "jaccard",
    most: int | None = None,
    nearest: bool = False,
    seed: int = SEED,
) -> DataFrame:
    """k lines per group: the longest, then always the farthest from (or nearest to) those taken; ties by line.

    Every line of a group takes part; ``most`` caps a group by hash order where that is wanted. Each pick is one
    aggregation with map-side combining over all groups, and the picks, a row per group and turn, are joined back to
    the lines: no group is gathered.
    """
    taken = lines if most is None else random_cap(lines, keys, most, seed)
    if metric == "random":
        picked = first_rows(taken, keys, [*hashed_order(["content"], seed), F.col("line_id")], k)
        return picked.select(*keys, F.col("_rank").alias("pick"), without_commas(F.col("content")).alias("content"))
    rows = taken.select(*keys, "line_id", "content", tokens(F.col("content")).alias("_words"))
    # What a line brings to every distance alike is made once, not once per turn.
    own = ["_words"] if metric == "jaccard" else ["_words", "_square"]
    rows = durable(rows if metric == "jaccard" else rows.withColumn("_square", square(F.col("_words"))))
    place = ["line_id", "content"]
    rank, picks = -F.size("_words"), []
    for turn in range(k):
        first = F.min_by(F.struct(*place, *own), F.struct(rank.alias("r"), *place)).alias("_pick")
        pick = durable(rows.groupBy(*keys).agg(first))
        picks.append(pick.select(*keys, F.lit(turn + 1).alias("pick"), F.col("_pick.content").alias("content")))
        if turn == k - 1:
            break
        joined = lookup_join(rows, pick, keys, "inner")
        squares = None if metric == "jaccard" else (F.col("_square"), F.col("_pick._square"))
        gap = distance(F.col("_words"), F.col("_pick._words"), metric, squares)
        gap = F.least("_gap", gap) if turn else gap
        left = joined.filter((F.col("line_id") != F.col("_pick.line_id")) | (F.col("content") != F.col("_pick.content")))
        rows = left.withColumn("_gap", gap).drop("_pick")
        # The last pick reads its lines once: nothing to keep.
        rows = rows if turn == k - 2 else durable(rows)
        rank = F.col("_gap") if nearest else -F.col("_gap")
    result = picks[0]
    for part in picks[1:]:
        result = result.unionByName(part)
    return result.select(*keys, "pick", without_commas(F.col("content")).alias("content"))


def _set_key(text: str) -> tuple[Column, Column]:
    """Sorted tokens of a text, and their digest."""
    words = F.array_sort(tokens(F.coalesce(F.col(text), F.lit(""))))
    return words, F.sha2(F.array_join(words, " "), 256)


def _token_sets(rows: DataFrame, text: str) -> DataFrame:
    """Each different list of tokens once."""
    words, key = _set_key(text)
    return rows.select(key.alias("_set"), words.alias("_words")).dropDuplicates(["_set"])


def _places(sets: DataFrame, order: DataFrame, metric: str, out: str) -> DataFrame:
    """One row per set and token of ``order``: its weight, and how much of the set comes from there on.

    Tokens stand in ``order`` (rare ones first). ``rest`` counts the tokens from this one on (jaccard) or is the norm
    of their counts (cosine); ``size`` is the same for the whole set, unknown tokens included.
    """
    count = F.count(F.lit(1))
    words = sets.select(F.col("_set").alias(out), F.explode("_words").alias("token")).groupBy(out, "token").agg(count.alias("_n"))
    weight = F.lit(1).cast("long") if metric == "jaccard" else F.col("_n") * F.col("_n")
    whole = Window.partitionBy(out)
    sized = words.withColumn("_w", weight).withColumn("_size", F.sum("_w").over(whole))
    known = lookup_join(sized, order, ["token"], "inner")
    after = whole.orderBy(F.col("_place").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return known.select(
        "token", out, "_place", F.col("_n").alias(f"_n_{out}"), F.col("_size").alias(f"_size_{out}"),
        F.sum("_w").over(after).alias(f"_rest_{out}"),
    )


def _verified(pairs: DataFrame, left: DataFrame, right: DataFrame, metric: str) -> DataFrame:
    """Exact closeness of pairs (a, b) of sets."""
    both = pairs.join(left.select(F.col("_set").alias("a"), F.col("_words").alias("_x")), "a")
    both = lookup_join(both, right.select(F.col("_set").alias("b"), F.col("_words").alias("_y")), ["b"], "inner")
    return both.select("a", "b", (1 - distance(F.col("_x"), F.col("_y"), metric)).alias("_close"))


def nearest_sets(left: DataFrame, right: DataFrame, metric: str, seeds: int = SEEDS) -> tuple[DataFrame, DataFrame]:
    """Closeness of every set of ``left`` to its nearest of ``right`` (columns a, _close), and all pairs compared.

    First every set is compared with the one that looks nearest by its ``seeds`` rarest known tokens, which gives a
    closeness it has at least. To beat it, two sets must have more than ``need`` in common. Their common tokens are looked at, rare ones
    first, as long as what follows may still be more than ``need`` without a share of it (the smaller rest of the two
    bounds it); a pair that has not found more than this share by then cannot reach ``need`` and is not compared.
    Frequent tokens come last and leave little; lengths enter through ``need``. No pair that beats the seeds is lost.
    """
    df = right.select(F.explode(F.array_distinct("_words")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("_f"))
    # The place of a token: how many sets hold it, and a hash among equals; any fixed order is right.
    order = lookup(df.select("token", F.struct("_f", F.xxhash64("token").alias("_h"), "token").alias("_place")))
    ours, theirs = durable(_places(left, order, metric, "a")), _places(right, order, metric, "b").drop("_place")
    # A token has a row per set that holds it: hot ones on either side are spread by salts beyond the limit.
    index = durable(theirs)
    small = text_bytes(index) <= BROADCAST_BYTES

    def meet(rows: DataFrame) -> DataFrame:
        if small:
            return rows.join(F.broadcast(index), "token")
        salt = F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int")
        copies = index.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return rows.withColumn("_salt", salt).join(copies, ["token", "_salt"])

    rare = F.row_number().over(Window.partitionBy("a").orderBy("_place"))
    first = ours.withColumn("_rare", rare).filter(F.col("_rare") <= seeds)
    size_a, size_b = F.col("_size_a"), F.col("_size_b")
    if metric == "jaccard":
        found, rest = F.lit(1), F.least("_rest_a", "_rest_b")
        need = F.col("_least") / (1 + F.col("_least")) * (size_a + size_b)
        seen = F.sum(found) / (F.first(size_a) + F.first(size_b) - F.sum(found))
    else:
        norms = F.sqrt(size_a.cast("double")) * F.sqrt(size_b.cast("double"))
        found, rest = F.col("_n_a") * F.col("_n_b"), F.sqrt(F.col("_rest_a").cast("double")) * F.sqrt(F.col("_rest_b").cast("double"))
        need = F.col("_least") * norms
        seen = F.sum(found) / F.first(norms)
    met = meet(first).groupBy("a", "b").agg(seen.alias("_seen"))
    partner = met.groupBy("a").agg(F.max_by("b", F.struct("_seen", "b")).alias("b"))
    tried = durable(_verified(partner, left, right, metric))
    reached = tried.select("a", F.col("_close").alias("_least"))
    # Rounding may only let more pairs through.
    rows = meet(ours.join(reached, "a")).withColumn("_need", need * (1 - 1e-9))
    rows = rows.filter(rest > F.col("_need") * (1 - SHARE))
    shared = rows.groupBy("a", "b").agg(F.sum(found).alias("_found"), F.first("_need").alias("_need"))
    open_pairs = shared.filter(F.col("_found") > F.col("_need") * SHARE).select("a", "b")
    more = durable(_verified(open_pairs.join(tried, ["a", "b"], "left_anti"), left, right, metric))
    compared = tried.unionByName(more)
    return compared.groupBy("a").agg(F.max("_close").alias("_close")), compared


def _counted(words: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Different tokens of all lists, and a row per list and token: list, place of the token, how often it is there."""
    flat = words.flatten().dictionary_encode()
    kinds = max(len(flat.dictionary), 1)
    lists = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    cells, counts = np.unique(lists * kinds + flat.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return flat.dictionary, cells // kinds, cells % kinds, counts


def _gaps_to(selected: pa.ListArray, metric: str) -> Callable[[pa.Array], pa.Array]:
    """Function from lists of tokens to the distance of each to the nearest selected list."""
    vocabulary, holders, places, times = _counted(selected)
    order = np.argsort(places, kind="stable")
    # Entries of a token stand side by side: the selected lists that hold it, and how often they do.
    starts = np.searchsorted(places[order], np.arange(len(vocabulary) + 1))
    holders, times, many = holders[order], times[order], len(selected)
    sizes = np.bincount(holders, None if metric == "jaccard" else times * times, many).astype(float)
    blank = bool((sizes == 0).any())

    def gaps(words: pa.Array) -> pa.Array:
        tokens_here, rows, places, counts = _counted(words)
        size = np.bincount(rows, None if metric == "jaccard" else counts * counts, len(words)).astype(float)
        token = pc.index_in(tokens_here, value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)[places]
        rows, counts, token = rows[token >= 0], counts[token >= 0], token[token >= 0]
        width = starts[token + 1] - starts[token]
        best = np.zeros(len(words))
        step = max(1, CELLS // max(many, 1))
        for low in range(0, len(words) if many else 0, step):
            high = min(low + step, len(words))
            common = np.zeros((high - low) * many)
            at, end = np.searchsorted(rows, [low, high])
            ends = np.cumsum(width[at:end])
            cuts = np.searchsorted(ends, np.arange(CELLS, ends[-1], CELLS)) if len(ends) else []
            for part in np.split(np.arange(at, end), cuts):
                wide = width[part]
                entry = np.repeat(starts[token[part]] - np.cumsum(wide) + wide, wide) + np.arange(wide.sum())
                pair = np.repeat((rows[part] - low) * many, wide) + holders[entry]
                found = None if metric == "jaccard" else np.repeat(counts[part], wide) * times[entry]
                common += np.bincount(pair, found, len(common))
            common = common.reshape(-1, many)
            mine = size[low:high, None]
            whole = mine + sizes - common if metric == "jaccard" else np.sqrt(mine) * np.sqrt(sizes)
            best[low:high] = np.divide(common, whole, out=np.zeros_like(common), where=whole > 0).max(axis=1)
        return pa.array(np.where((size == 0) & blank, 0.0, 1 - best))

    return gaps


def minimum_distances(
    candidates: DataFrame,
    selected: DataFrame,
    metric: str = "jaccard",
    text: str = "text",
) -> DataFrame:
    """Distance of every candidate to the nearest selected text.

    Texts without a common token are at distance 1, and so is everything from an empty selection; an empty (or NULL)
    text is at distance 0 from another one. A small selection is sent to the candidates as an index of its tokens, in
    which each batch of them is counted: nothing of the candidates is shuffled or stored. For a larger one equal token
    lists are compared once, see ``nearest_sets``.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    right = durable(_token_sets(selected, text))
    if text_bytes(right) <= BROADCAST_BYTES // 8:
        gaps = F.arrow_udf(_gaps_to(right.select("_words").toArrow()["_words"].combine_chunks(), metric), "double")
        return candidates.withColumn("min_distance", gaps(tokens(F.coalesce(F.col(text), F.lit("")))))
    left = durable(_token_sets(candidates, text))
    best, _ = nearest_sets(left, right, metric)
    blank = not right.filter(F.size("_words") == 0).isEmpty()
    gaps = left.join(best, F.col("_set") == F.col("a"), "left").select(
        F.col("_set"),
        F.when((F.size("_words") == 0) & F.lit(blank), 0.0).otherwise(1 - F.coalesce("_close", F.lit(0.0))).alias("min_distance"),
    )
    keyed = candidates.withColumn("_set", _set_key(text)[1])
    return lookup_join(keyed, gaps, ["_set"]).drop("_set")


def sample_bank(lines: DataFrame, k: int = PICKS, seed: int = SEED, group: str = "template") -> DataFrame:
    """Per template up to k distinct sample lines and the first event id that is filled."""
    rows = lines.select(
        group,
        strip(F.col("content")).alias("content"),
        strip(F.coalesce(F.col("event_id"), F.lit(""))).alias("event_id"),
        "line_id",
    ).filter((F.col(group) != "") & (F.col("content") != ""))
    distinct = rows.groupBy(group, "content").agg(F.min("line_id").alias("line_id"))
    samples = (
        first_rows(distinct, [group], [*hashed_order([group, "content"], seed), F.col("line_id")], k)
        .groupBy(group)
        .agg(F.array_sort(F.collect_list(F.struct("_rank", "content"))).alias("_s"))
        .select(group, F.transform("_s", lambda s: s["content"]).alias("samples"))
    )
    filled = (F.col("event_id") != "") & (F.lower("event_id") != "nan")
    ids = rows.groupBy(group).agg(
        F.coalesce(F.min_by("event_id", F.when(filled, F.col("line_id"))), F.lit("")).alias("event_id")
    )
    return samples.join(ids, group)


def bracketed(text: Column) -> Column:
    return F.regexp_replace(text, r"\[[^\]]*\]", "[<*>]")


def template_key(mode: str, template: Column, **parts: Column) -> Column:
    """Template key of a sample bank: audit type, or host and program with ids masked."""
    if mode == "audit":
        return F.concat(strip(parts["type"]), F.lit(": "), template)
    if mode in ("auth", "syslog"):
        prefix = F.concat_ws(" ", strip(parts["component"]), strip(bracketed(parts["proto"])))
    elif mode == "dns":
        prefix = strip(bracketed(parts["component"]))
    else:
        raise ValueError(f"unknown mode: {mode}")
    return F.concat(prefix, F.lit(": "), strip(template))


def audit_key(line: Column) -> Column:
    """``type=X msg=audit: rest`` as ``type=X: rest``."""
    text = strip(line)
    shape = r"(?s)^(type=[^ ]+)\s+(.*)$"
    kind = F.regexp_extract(text, shape, 1)
    rest = F.regexp_replace(strip(F.regexp_extract(text, shape, 2)), r"^msg=audit:\s*", "")
    return F.when(kind == "", text).when(rest == "", kind).otherwise(F.concat(kind, F.lit(": "), rest))


def prefixed_key(template: Column, sample: Column) -> Column:
    """The prefix before ``: `` taken from a sample line, with its bracketed parts masked."""
    both = sample.contains(": ") & template.contains(": ")
    rest = F.regexp_replace(template, "(?s)^.*?: ", "")
    prefix = bracketed(F.substring_index(sample, ": ", 1))
    return F.when(both, F.concat(prefix, F.lit(": "), rest)).otherwise(template)


# Columns that a bank of each mode needs beside content, template and event id, in order of detection.
BANK_COLUMNS = {"auth": ["component", "proto"], "syslog": ["component", "proto"], "dns": ["component"], "audit": ["type"]}


def bank_mode(columns: list[str], mode: str = "auto") -> str:
    """The mode of a bank; ``auto`` takes the first whose columns are there, in any case (syslog has auth's)."""
    known = {c.lower() for c in columns}
    fitting = [m for m, needed in BANK_COLUMNS.items() if known >= {"content", "eventtemplate", "eventid", *needed}]
    if mode == "auto" and fitting:
        return fitting[0]
    if mode not in fitting:
        raise ValueError(f"columns {columns} do not make a bank of mode {mode}")
    return mode


def template_bank(
    lines: DataFrame, mode: str = "auto", k: int = PICKS, seed: int = SEED, order: str = "line_id", distinct: bool = False
) -> DataFrame:
    """Template keys with up to k sample lines in their context and an event id, for the lines of one log family.

    Lines have Content, EventTemplate, EventId (names in any case), the mode's columns and a unique ``order``.
    Blank contents are left out. Lines of auth are grouped by event id, or by template key where it is blank, and
    their samples are distinct; other modes group by template key, and samples repeat unless ``distinct``. A group is
    named by the key of its first line; of groups with one name the last to begin stays. Samples are the first k by
    digest of seed, group, content and order.
    """
    mode = bank_mode([c for c in lines.columns if c != order], mode)
    named = {c.lower(): c for c in lines.columns}

    def cell(name: str) -> Column:
        return F.coalesce(F.col(f"`{named[name]}`").cast("string"), F.lit(""))

    parts = {name: cell(name) for name in BANK_COLUMNS[mode]}
    # Context of a sample: as the key's, with what is in brackets.
    context = F.concat_ws(" ", *[strip(p) for p in parts.values()])
    rows = lines.select(
        template_key(mode, cell("eventtemplate"), **parts).alias("template"),
        F.concat(context, F.lit(": "), cell("content")).alias("sample"),
        cell("content").alias("content"),
        (strip(cell("eventid")) if mode == "auth" else cell("eventid")).alias("event_id"),
        F.col(order).alias("_line"),
    ).filter(strip(F.col("content")) != "")
    group = F.concat(F.lit("t"), F.col("template"))
    if mode == "auth":
        group = F.when(F.col("event_id") == "", group).otherwise(F.concat(F.lit("e"), F.col("event_id")))
    rows = rows.withColumn("_group", group)
    names = rows.groupBy("_group").agg(F.min_by(F.struct("template", "event_id"), "_line").alias("_first"), F.min("_line").alias("_at"))
    names = names.groupBy("_first.template").agg(F.max_by(F.struct("_group", "_first.event_id"), "_at").alias("_last"))
    names = names.select("template", F.col("_last._group").alias("_group"), F.col("_last.event_id").alias("event_id"))
    unit = "sample" if mode == "auth" else "content" if distinct else "_line"
    # Lines to choose from combine before the shuffle where they have to differ.
    if unit != "_line":
        rows = rows.groupBy("_group", unit).agg(F.min_by("sample", "_line").alias("_s"), F.min("_line").alias("_line"))
        rows = rows.select("_group", F.col("_s").alias("sample"), "_line")
    digest = F.md5(F.concat_ws("::", F.lit(str(seed)), "_group", "sample", *([F.col("_line").cast("string")] if unit == "_line" else [])).cast("binary"))
    chosen = first_rows(rows.withColumn("_digest", digest), ["_group"], [F.col("_digest"), F.col("_line")], k)
    samples = chosen.groupBy("_group").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "sample"))), lambda x: x["sample"]).alias("samples"))
    return names.join(samples, "_group").select("template", "samples", "event_id")


def first_samples(lines: DataFrame, keys: list[str]) -> DataFrame:
    """First content and first filled event id of every key."""
    filled = strip(F.coalesce(F.col("event_id"), F.lit(""))) != ""
    return lines.groupBy(*keys).agg(
        F.min_by("content", "line_id").alias("content"),
        F.min_by("event_id", F.when(filled, F.col("line_id"))).alias("event_id"),
    )
