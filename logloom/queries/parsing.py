"""Queries on line parsing: timestamps, masks, templates, memory, accuracy, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.functions import regexes, text
from logloom.functions.similarity import cosine_distance, jaccard_distance
from logloom.operators import drain as drains
from logloom.operators import memory, sampling, stage, templates
from logloom.queries.base import (
    APP_LINES,
    TEXT_LINES,
    query,
    sql_mask,
    sql_preprocessed,
    sql_routed,
    sql_strip,
    sql_templates,
    sql_tokens,
    table,
    text_lines,
)
from logloom.session import durable, scratch_path
from logloom.sources import logs

PRE = sql_preprocessed(APP_LINES.sql)
ROUTED = sql_routed(PRE)
TEMPLATES = sql_templates(ROUTED)
ASSIGNED = f"""SELECT r.source, r.line_id, r."timestamp", r.content, r.original_content, r.n_tokens, t.template, t.event_id
    FROM ({ROUTED}) r JOIN ({TEMPLATES}) t USING (source, n_tokens, route)"""
TEXT_PRE = sql_preprocessed(TEXT_LINES)


def app_lines(spark, sf):
    return templates.preprocess(APP_LINES.frame(spark, sf))


def app_parsed(spark, sf):
    return templates.parse(app_lines(spark, sf))


@query("split_timestamp", PRE)
def split_timestamp(spark, sf):
    return app_lines(spark, sf)


@query("split_timestamp_text", f'SELECT source, line_id, "timestamp", content, original_content FROM ({TEXT_PRE})')
def split_timestamp_text(spark, sf):
    return templates.preprocess(text_lines(spark, sf))


@query("mask_lines", f"SELECT source, line_id, {sql_mask('content')} AS masked FROM ({PRE})")
def mask_lines(spark, sf):
    return app_lines(spark, sf).select("source", "line_id", text.mask(F.col("content")).alias("masked"))


ERROR_LAYOUT = r"\[<Time>\] \[<Level>\] <Content>"
ERROR_SHAPE = r"^\[(.*?)\]\s+\[(.*?)\]\s+(.*?)$"
SYSLOG_LAYOUT = r"<Month> <Date> <Time> <Level> <Component>(\[<PID>\])?: <Content>"
SYSLOG_SHAPE = r"^(.*?)\s+(.*?)\s+(.*?)\s+(.*?)\s+(.*?)(\[(.*?)\])?:\s+(.*?)$"


def _layout_sql(shape: str, fields: dict[str, int]) -> str:
    t = sql_strip("original_content")
    cells = ", ".join(f"regexp_extract({t}, '{shape}', {n}) AS \"{name}\"" for name, n in fields.items())
    return f"SELECT source, line_id, {cells} FROM ({APP_LINES.sql}) WHERE regexp_matches({t}, '{shape}')"


@query("logformat_fields", _layout_sql(SYSLOG_SHAPE, {"Month": 1, "Date": 2, "Time": 3, "Level": 4, "Component": 5, "PID": 7, "Content": 8}))
def logformat_fields(spark, sf):
    return logs.header_fields(APP_LINES.frame(spark, sf), SYSLOG_LAYOUT)


@query("logformat_errors", _layout_sql(ERROR_SHAPE, {"Time": 1, "Level": 2, "Content": 3}))
def logformat_errors(spark, sf):
    return logs.header_fields(APP_LINES.frame(spark, sf), ERROR_LAYOUT)


def _masked_sql(layout: str, name: str) -> str:
    masked = '"Content"'
    for pattern in logs.LOG_FORMATS[name][1]:
        masked = f"regexp_replace({masked}, '{pattern}', '<*>', 'g')"
    return f"SELECT '{name}' AS format, source, line_id, \"Content\" AS content, {masked} AS masked FROM ({layout})"


@query(
    "named_formats",
    _masked_sql(_layout_sql(SYSLOG_SHAPE, {"Content": 8}), "Linux") + " UNION ALL " + _masked_sql(_layout_sql(ERROR_SHAPE, {"Content": 3}), "Apache"),
)
def named_formats(spark, sf):
    """Contents of lines that fit a public format, found by its name, with the format's own masks."""
    rows = APP_LINES.frame(spark, sf)
    parts = [
        logs.format_fields(rows, name).select(F.lit(name).alias("format"), "source", "line_id", F.col("Content").alias("content"), "masked")
        for name in ("Linux", "Apache")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "selected_lines",
    f"""SELECT original_content, count(*) AS "count" FROM (SELECT unnest(string_split(original_content, chr(13))) AS original_content
    FROM ({TEXT_LINES}) WHERE contains(lower(source), 'src1')) WHERE {sql_strip('original_content')} <> '' GROUP BY ALL""",
)
def selected_lines(spark, sf):
    """Lines written in a folder per source, of which those of the sources that a selector names are read back."""
    path = scratch_path(spark, "sources")
    text_lines(spark, sf).select("source", "original_content").write.partitionBy("source").text(path)
    back = logs.read_selected(spark, path, ["SRC1"], names=r"part-.*")
    return back.groupBy("original_content").agg(F.count(F.lit(1)).alias("count"))


NUMBERED = f"SELECT source, row_number() OVER (PARTITION BY source ORDER BY line_id) AS line_id, original_content FROM ({TEXT_LINES}) WHERE {sql_strip('original_content')} <> ''"


@query(
    "percent_slice",
    f"""SELECT source, line_id, original_content FROM ({NUMBERED}) JOIN (SELECT source, max(line_id) AS n FROM ({NUMBERED}) GROUP BY source) USING (source)
    WHERE line_id > floor(n * 20 / 100) AND line_id <= floor(n * 20 / 100) + floor((n - floor(n * 20 / 100)) * 50 / 100)""",
)
def percent_slice(spark, sf):
    """Lines numbered per source, then half of the lines behind the first fifth."""
    kept = text_lines(spark, sf).filter(~text.is_blank(F.col("original_content")))
    return logs.percent_slice(logs.renumbered(kept).select("source", "line_id", "original_content"), 50, 20)


@query("templates", TEMPLATES)
def template_table(spark, sf):
    return templates.discover(app_lines(spark, sf)).select(
        "source", "n_tokens", "route", "template", "event_id", "count", "first_line"
    )


@query("templates_text", sql_templates(sql_routed(TEXT_PRE)))
def templates_text(spark, sf):
    found = templates.discover(templates.preprocess(text_lines(spark, sf)))
    return found.select("source", "n_tokens", "route", "template", "event_id", "count", "first_line")


@query("parsed_lines", f"SELECT source, line_id, n_tokens, template, event_id FROM ({ASSIGNED})")
def parsed_lines(spark, sf):
    return app_parsed(spark, sf)[0].select("source", "line_id", "n_tokens", "template", "event_id")


@query("group_counts", f'SELECT content, event_id, template, count(*) AS "count" FROM ({ASSIGNED}) GROUP BY ALL')
def group_counts(spark, sf):
    return templates.group_counts(app_parsed(spark, sf)[0])


@query("event_count", f"SELECT count(DISTINCT template) AS event_count FROM ({ASSIGNED})")
def event_count(spark, sf):
    return templates.template_count(app_parsed(spark, sf)[0])


@query(
    "ordered_groups",
    f"""SELECT source, event_id, cast(arg_min(len({sql_tokens('content')}), line_id) AS INTEGER) AS words, count(*) AS "count"
    FROM ({ASSIGNED}) GROUP BY source, event_id""",
)
def ordered_groups(spark, sf):
    return templates.ordered_groups(app_parsed(spark, sf)[0]).select("source", "event_id", "words", "count")


TEXT_ROUTED = sql_routed(TEXT_PRE)


@query(
    "small_groups",
    f"""SELECT a.source, line_id, event_id, n >= 5 AS kept FROM (SELECT r.source, r.line_id, t.event_id FROM ({TEXT_ROUTED}) r
        JOIN ({sql_templates(TEXT_ROUTED)}) t USING (source, n_tokens, route)) a
    JOIN (SELECT t.source, event_id, sum("count") AS n FROM ({sql_templates(TEXT_ROUTED)}) t GROUP BY ALL) USING (source, event_id)""",
)
def small_groups(spark, sf):
    return templates.sized_lines(templates.preprocess(text_lines(spark, sf)))


@query("cluster_lines", f"SELECT source, event_id, line_id FROM ({ASSIGNED})")
def cluster_lines(spark, sf):
    listed = templates.cluster_lines(app_parsed(spark, sf)[0])
    return listed.select("source", "event_id", F.explode("line_ids").alias("line_id"))


@query(
    "cluster_list",
    f"""SELECT source, event_id, template, first_line, "count", total > 50 AS truncated FROM (
        SELECT *, row_number() OVER (ORDER BY first_line, source, event_id) AS rn, count(*) OVER () AS total FROM (
        SELECT source, event_id, template, min(line_id) AS first_line, count(*) AS "count"
        FROM (SELECT r.source, r.line_id, t.template, t.event_id FROM ({TEXT_ROUTED}) r
              JOIN ({sql_templates(TEXT_ROUTED)}) t USING (source, n_tokens, route)) GROUP BY ALL)) WHERE rn <= 50""",
)
def cluster_list(spark, sf):
    found = templates.discover(templates.preprocess(text_lines(spark, sf)))
    return templates.first_clusters(templates.template_clusters(found))


@query("drain_exact")
def drain_exact(spark, sf):
    """Online clustering in line order; its order dependence has no SQL form."""
    found = drains.drain(app_lines(spark, sf))
    return found.select("source", "line_id", "template", "event_id")


@query("drain_text")
def drain_text(spark, sf):
    found = drains.drain(templates.preprocess(text_lines(spark, sf)))
    return found.groupBy("source", "event_id", "template").agg(F.count(F.lit(1)).alias("count"))


def _regex_sql(template: str) -> str:
    """Regex of a template without misspelt wildcards or more than ten in a row."""
    escaped = rf"regexp_replace(replace({template}, ',', ''), '([()\[\]{{}}?*+\-|^$\\.&~#])', '\\\1', 'g')"
    return rf"regexp_replace({escaped}, '(<\\\*>)+', '(.*?)', 'g')"


WORDS = "(length({0}) - length(replace({0}, ' ', '')) + 1)"
MEMORY = f"""SELECT regex, min(first_line) AS seq, cast({WORDS.format('regex')} AS INTEGER) AS word_count
    FROM (SELECT {_regex_sql('template')} AS regex, first_line FROM ({TEMPLATES})) GROUP BY regex"""


def app_memory(spark, sf):
    lines, found = app_parsed(spark, sf)
    # Read by the learning and twice by the search.
    lines = durable(lines.select("source", "line_id", "content"))
    logged = found.join(lines.select("source", F.col("line_id").alias("first_line"), F.col("content").alias("log")), ["source", "first_line"])
    return lines, memory.learn(
        logged.select(F.col("first_line").alias("seq"), regexes.template_to_regex(F.col("template")).alias("regex"), "log")
    )


MASKED_MEMORY = f"""SELECT regex, min(first_line) AS seq, cast({WORDS.format('regex')} AS INTEGER) AS word_count
    FROM (SELECT {_regex_sql('template')} AS regex, first_line, source FROM ({TEMPLATES})) m
    JOIN (SELECT source, line_id AS first_line, content FROM ({PRE})) USING (source, first_line)
    WHERE regexp_matches(replace(content, ',', ''), '^' || regex || '$') GROUP BY regex"""


@query("template_regex", f"SELECT source, event_id, template, {_regex_sql('template')} AS regex FROM ({TEMPLATES})")
def template_regex(spark, sf):
    _, found = app_parsed(spark, sf)
    return found.select("source", "event_id", "template", regexes.template_to_regex(F.col("template")).alias("regex"))


@query("regex_to_template", rf"""SELECT source, event_id, template, regex, {sql_strip(rf"replace(regexp_replace(regex, '\\(.)', '\1', 'g'), '(.*?)', '<*>')")} AS rebuilt
    FROM (SELECT source, event_id, template, {_regex_sql('template')} AS regex FROM ({TEMPLATES}))""")
def regex_to_template(spark, sf):
    _, found = app_parsed(spark, sf)
    rows = found.select("source", "event_id", "template", regexes.template_to_regex(F.col("template")).alias("regex"))
    return rows.withColumn("rebuilt", regexes.regex_to_template(F.col("regex")))


@query("memory_build", MASKED_MEMORY)
def memory_build(spark, sf):
    return app_memory(spark, sf)[1].select("regex", "seq", "word_count")


@query(
    "regex_memory",
    f"""SELECT source, line_id, regex FROM ({PRE}) l LEFT JOIN (
        SELECT source, line_id, arg_min(regex, rank) AS regex FROM (
            SELECT p.source, p.line_id, m.regex, row_number() OVER (ORDER BY m.word_count DESC, m.seq) AS rank
            FROM ({PRE}) p JOIN ({MASKED_MEMORY}) m ON m.word_count IN ({WORDS.format('p.content')}, {WORDS.format('p.content')} + 1)
            WHERE regexp_matches(replace(p.content, ',', ''), '^' || m.regex || '$')) GROUP BY source, line_id) USING (source, line_id)""",
)
def regex_memory(spark, sf):
    lines, known = app_memory(spark, sf)
    return memory.recall(lines.select("source", "line_id", "content"), known).select("source", "line_id", "regex")


@query(
    "retry_rounds",
    f"""SELECT source, line_id, true AS matched FROM ({PRE})""",
)
def retry_rounds(spark, sf):
    """All lines of a source share one group at first; every line ends with a pattern it matches."""
    lines = app_lines(spark, sf).select("source", "line_id", "content")
    done = stage.fit_stage(lines, ["source"]).lines
    return done.select("source", "line_id", regexes.matches_somewhere(F.col("content"), F.col("regex")).alias("matched"))


@query("retry_templates")
def retry_templates(spark, sf):
    """Patterns of sampled lines per round; the samples' hash order has no SQL twin here."""
    lines = app_lines(spark, sf).select("source", "line_id", "content")
    return stage.fit_stage(lines, ["source"]).lines.groupBy("source", "round", "template", "regex").agg(
        F.count(F.lit(1)).alias("count")
    )


CLICK_TEMPLATE = "host-<*> ui: click on button <*> by user <*>"
CLICK_SHAPE = r"^host\-(.*?)\s+ui\:\s+click\s+on\s+button\s+(.*?)\s+by\s+user\s+(.*?)$"


@query(
    "param_list",
    f"""SELECT source, line_id, CASE WHEN regexp_matches(content, '{CLICK_SHAPE}') THEN
        regexp_extract(content, '{CLICK_SHAPE}', 1) || '|' || regexp_extract(content, '{CLICK_SHAPE}', 2) || '|' || regexp_extract(content, '{CLICK_SHAPE}', 3)
        ELSE '' END AS params FROM ({PRE})""",
)
def param_list(spark, sf):
    found = regexes.parameters(F.lit(CLICK_TEMPLATE), F.col("content"))
    return app_lines(spark, sf).select("source", "line_id", F.array_join(found, "|").alias("params"))


@query(
    "fifo_join",
    f"""WITH p AS (SELECT source, line_id, content, "timestamp", original_content FROM ({TEXT_PRE})),
    r AS (SELECT source, line_id AS result_id, content, row_number() OVER (PARTITION BY source, content ORDER BY line_id) AS k FROM p),
    q AS (SELECT *, row_number() OVER (PARTITION BY source, content ORDER BY line_id DESC) AS k FROM p)
    SELECT r.source, r.result_id, q.line_id, q."timestamp", q.original_content FROM r JOIN q USING (source, content, k)""",
)
def fifo_join(spark, sf):
    """Results in line order take the input lines of equal content, given here in reverse."""
    pre = durable(templates.preprocess(text_lines(spark, sf)))
    results = pre.select("source", "content", F.col("line_id").alias("result_id"), "line_id")
    flipped = pre.withColumn("line_id", -F.col("line_id"))
    joined = templates.attach_lines(results.withColumn("line_id", F.col("result_id")), flipped)
    return joined.select("source", F.col("_order").alias("result_id"), (-F.col("line_id")).alias("line_id"), "timestamp", "original_content")


@query(
    "accuracy_ga_pa",
    f"""WITH c AS (SELECT p, t, count(*) AS n FROM (SELECT regexp_replace(regexp_replace(template, '\\s+', '', 'g'), '<\\*>|\\(\\.\\*\\?\\)', '', 'g') AS p,
        regexp_extract(source, 'app/(.*)\\.log', 1) AS t FROM ({ASSIGNED})) GROUP BY ALL),
    g AS (SELECT p, count(*) AS kinds, min(t) AS t, sum(n) AS size FROM c GROUP BY p),
    s AS (SELECT t, sum(n) AS true_size FROM c GROUP BY t)
    SELECT (SELECT cast(coalesce(sum(size), 0) AS DOUBLE) FROM g JOIN s USING (t) WHERE kinds = 1 AND size = true_size) / (SELECT cast(sum(n) AS DOUBLE) FROM c) AS ga,
           (SELECT cast(coalesce(sum(n), 0) AS DOUBLE) FROM c WHERE p = t) / (SELECT cast(sum(n) AS DOUBLE) FROM c) AS pa,
           (SELECT count(*) FROM g) AS event_count""",
)
def accuracy_ga_pa(spark, sf):
    parsed, _ = app_parsed(spark, sf)
    truth = parsed.withColumn("truth", F.regexp_extract("source", r"app/(.*)\.log", 1))
    return templates.accuracy(truth, "template", "truth")


@query(
    "template_samples",
    f"""WITH d AS (SELECT template, content, min(line_id) AS line_id FROM ({ASSIGNED}) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY template ORDER BY md5('42::' || template || '::' || content), line_id) AS k FROM d)
    SELECT template, string_agg(content, '|' ORDER BY k) AS samples, any_value(event_id) AS event_id
    FROM r JOIN (SELECT template, arg_min(event_id, line_id) AS event_id FROM ({ASSIGNED}) GROUP BY template) USING (template)
    WHERE k <= 3 GROUP BY template""",
)
def template_samples(spark, sf):
    bank = sampling.sample_bank(app_parsed(spark, sf)[0])
    return bank.select("template", F.array_join("samples", "|").alias("samples"), "event_id")


@query(
    "first_sample",
    f"SELECT source, template, arg_min(content, line_id) AS content, arg_min(event_id, line_id) AS event_id FROM ({ASSIGNED}) GROUP BY source, template",
)
def first_sample(spark, sf):
    return sampling.first_samples(app_parsed(spark, sf)[0], ["source", "template"])


def _jaccard(a: str, b: str) -> str:
    common = f"len(list_intersect({a}, {b}))"
    union = f"len(list_distinct(list_concat({a}, {b})))"
    return f"(1 - {common} / {union})"


def _cosine(a: str, b: str) -> str:
    dot = lambda x, y: f"list_sum(list_transform(list_distinct({x}), lambda t: len(list_filter({x}, lambda u: u = t)) * len(list_filter({y}, lambda u: u = t))))"
    return f"(1 - {dot(a, b)} / (sqrt(cast({dot(a, a)} AS DOUBLE)) * sqrt(cast({dot(b, b)} AS DOUBLE))))"


def _picks(gap, sign: str = "-") -> str:
    """Three picks per source: the longest line, then twice the one whose least distance to the picks is most (or least)."""
    near = lambda n: f"""d{n} AS (SELECT c.source, c.line_id, c.content, c.w, {'least(c.d, ' if n > 1 else ''}{gap('c.w', 'f.w')}{')' if n > 1 else ''} AS d
        FROM {f'd{n - 1}' if n > 1 else 'c'} AS c JOIN p{n} USING (source) JOIN c AS f ON f.source = c.source AND f.line_id = p{n}.i WHERE c.line_id <> p{n}.i),
    p{n + 1} AS (SELECT source, arg_min(line_id, ({sign}d, line_id)) AS i FROM d{n} GROUP BY source)"""  # noqa: E731
    shown = " UNION ALL ".join(f"SELECT c.source, {n} AS pick, replace(content, ',', '') AS content FROM c JOIN p{n} ON c.source = p{n}.source AND line_id = i" for n in (1, 2, 3))
    return f"""WITH c AS (SELECT source, line_id, content, {sql_tokens('content')} AS w FROM ({PRE})),
    p1 AS (SELECT source, arg_min(line_id, (-len(w), line_id)) AS i FROM c GROUP BY source), {near(1)}, {near(2)} {shown}"""


@query("farthest_sample", _picks(_jaccard))
def farthest_sample(spark, sf):
    """Of all lines of each source the longest, then twice the farthest from those taken."""
    return sampling.representative(app_lines(spark, sf), ["source"])


@query("farthest_cosine", _picks(_cosine))
def farthest_cosine(spark, sf):
    return sampling.representative(app_lines(spark, sf), ["source"], metric="cosine")


@query("nearest_sample", _picks(_jaccard, sign=""))
def nearest_sample(spark, sf):
    """The longest line of each source, then twice the nearest to those taken."""
    return sampling.representative(app_lines(spark, sf), ["source"], nearest=True)


@query(
    "random_cap",
    f"""SELECT source, line_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42::' || content), line_id) AS h FROM ({PRE})) WHERE h <= 200""",
)
def random_cap(spark, sf):
    """The sampling operator's own limit: 200 lines of every source."""
    return sampling.random_cap(app_lines(spark, sf), ["source"]).select("source", "line_id")


@query(
    "token_similarity",
    f"""WITH t AS (SELECT conv_id, turn, {sql_tokens('text')} AS w, lead({sql_tokens('text')}) OVER (PARTITION BY conv_id ORDER BY turn) AS x FROM conversations)
    SELECT conv_id, turn, round({_jaccard('w', 'x')}, 9) AS jaccard FROM t WHERE x IS NOT NULL""",
)
def token_similarity(spark, sf):
    """Distance of every turn to the next turn of its conversation."""
    turns = table(spark, sf, "conversations").withColumn("w", text.tokens(F.col("text")))
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("x"))
    return turns.join(following, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(jaccard_distance(F.col("w"), F.col("x")), 9).alias("jaccard")
    )


_COS = """WITH t AS (SELECT conv_id, turn, unnest(%s) AS w FROM conversations), c AS (SELECT conv_id, turn, w, count(*) AS n FROM t GROUP BY ALL),
    s AS (SELECT conv_id, turn, sqrt(cast(sum(n * n) AS DOUBLE)) AS norm FROM c GROUP BY ALL),
    d AS (SELECT a.conv_id, a.turn, sum(a.n * b.n) AS dot FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.w = b.w GROUP BY ALL)
    SELECT a.conv_id, a.turn, round(1 - coalesce(dot, 0) / (a.norm * b.norm), 9) AS cosine
    FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 LEFT JOIN d ON d.conv_id = a.conv_id AND d.turn = a.turn""" % sql_tokens("text")


@query("token_cosine", _COS)
def token_cosine(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("w", text.tokens(F.col("text")))
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("x"))
    return turns.join(following, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(cosine_distance(F.col("w"), F.col("x")), 9).alias("cosine")
    )


@query(
    "min_distance",
    f"""WITH c AS (SELECT doc_id, list_distinct({sql_tokens('text')}) AS w FROM documents),
    s AS (SELECT item_id, list_distinct({sql_tokens('text')}) AS x FROM benchmark),
    a AS (SELECT doc_id, unnest(w) AS t FROM c), b AS (SELECT item_id, unnest(x) AS t FROM s),
    o AS (SELECT doc_id, item_id, count(*) AS common FROM a JOIN b USING (t) GROUP BY ALL)
    SELECT doc_id, round(coalesce(min(1 - common / (len(w) + len(x) - common)), 1.0), 9) AS min_distance
    FROM c LEFT JOIN (SELECT * FROM o JOIN s USING (item_id)) USING (doc_id) GROUP BY doc_id""",
)
def min_distance(spark, sf):
    """Distance of every document to the nearest benchmark text."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    chosen = table(spark, sf, "benchmark")
    near = sampling.minimum_distances(docs, chosen)
    return near.select("doc_id", F.round("min_distance", 9).alias("min_distance"))
