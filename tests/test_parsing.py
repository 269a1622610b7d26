"""Lines, templates, clustering, memory and numbering."""

import random
from collections import Counter

import pytest

from pyspark.sql import functions as F

from logloom.functions import regexes, text
from logloom.operators import drain, memory, sampling, templates
from logloom.operators.skew import lookup_join, number_within
from logloom.sources import logs


def lines(spark, contents, source="a"):
    return spark.createDataFrame([(source, n, c) for n, c in enumerate(contents, 1)], "source string, line_id long, content string")


def test_timestamp_layouts(spark):
    cases = {
        "[Mon Jan 01 00:09:58.778549 2024] [x] y": ("[Mon Jan 01 00:09:58.778549 2024]", "[x] y"),
        "2024-01-01T10:00:00Z foo  bar": ("2024-01-01T10:00:00Z", "foo bar"),
        "Jan  5 10:11:12 host a: b": ("Jan  5 10:11:12", "host a: b"),
        '1.2.3.4 - - [05/Jan/2024:10:11:12 +0000] "GET /"': ("[05/Jan/2024:10:11:12 +0000]", '1.2.3.4 - - "GET /"'),
        "type=A msg=audit(123.4:5): pid=1": ("audit(123.4:5)", "type=A msg=audit: pid=1"),
        "2024-01-01 10:00:00": ("2024-01-01 10:00:00", "2024-01-01 10:00:00"),
        "　plain text\xa0": ("", "plain text"),
    }
    df = spark.createDataFrame([(c,) for c in cases], "original_content string")
    got = {r["original_content"]: (r["timestamp"], r["content"]) for r in templates.preprocess(df).collect()}
    assert got == cases


def test_mask_is_unicode_aware(spark):
    df = spark.createDataFrame([("at 10.1.2.3:44 12:13:14 deadbeef99 /a/b,c x.y-z 日志.文件 end",)], "c string")
    assert df.select(text.mask(F.col("c"))).first()[0] == "at <*> <*> <*> <*>,c <*> <*> end"


def test_generalise_pads(spark):
    rows = lines(spark, ["a b c", "a x c", "a b"]).withColumn("tokens", text.tokens(F.col("content")))
    assert templates.generalise(rows, ["source"]).first()["template"] == "a <*> <*>"


def sequential(contents):
    """Plain one-pass clustering by definition, for comparison."""
    clusters, result = [], []
    for words in (c.split() for c in contents):
        best, rank = None, (-1, -1)
        for cluster in clusters:
            template = cluster["t"]
            if len(template) != len(words) or len(words) == 1 or cluster["route"] != cluster["find"](words[0]):
                continue
            score = (sum(a == b for a, b in zip(template, words)) / len(words), template.count("<*>"))
            if score > rank:
                best, rank = cluster, score
        if rank[0] < 0.5:
            known = {c["route"] for c in clusters if len(c["t"]) == len(words) and len(words) > 1}
            route = "<*>" if any(ch.isdigit() for ch in words[0]) else words[0]

            def find(token, n=len(words)):
                routes = {c["route"] for c in clusters if len(c["t"]) == n}
                return token if token in routes else "<*>"

            assert len(known) < 100
            best = {"t": list(words), "route": route, "find": find}
            clusters.append(best)
        else:
            best["t"] = [a if a == b else "<*>" for a, b in zip(best["t"], words)]
        result.append(best)
    return [" ".join(c["t"]) for c in result]


def test_drain_equals_one_pass(spark):
    random.seed(3)
    verbs = ["open", "close", "read", "x1", "y2"]
    contents = [
        f"{random.choice(verbs)} file {random.choice('abc')} by {random.choice(['u', 'v'])} {random.choice(['ok', 'bad', 'late'])}"
        if random.random() < 0.7 else random.choice(["boot", "halt now", "open it"]) for _ in range(300)
    ]
    found = drain.drain(lines(spark, contents), masked=False).orderBy("line_id").collect()
    assert [r["template"] for r in found] == sequential(contents)


def test_drain_does_not_depend_on_batches(spark):
    rng = random.Random(8)
    contents = [" ".join(rng.choice(["up", "down", "x", f"v{rng.randrange(30)}"]) for _ in range(rng.randint(1, 5))) for _ in range(400)]
    found = []
    for size in (3, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        rows = drain.drain(lines(spark, contents).repartition(size % 7 + 1), masked=False).collect()
        found.append({r["line_id"]: r["template"] for r in rows})
    assert len(found[0]) == 400 and found[0] == found[1]
    by_size = {}
    for number in sorted(found[0]):
        by_size.setdefault(len(contents[number - 1].split()), []).append(number)
    for numbers in by_size.values():
        assert [found[0][n] for n in numbers] == drain.cluster_in_order([contents[n - 1].split() for n in numbers])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_drain_reads_repeats_only_where_they_matter(spark, seed):
    rng = random.Random(seed)
    shapes = [["open", "close", "v1"], ["file", "door", "7"], ["a", "b", "c"], ["by", "of"], ["u", "v", "w"]]
    known = [" ".join(rng.choice(words) for words in shapes) for _ in range(40)]
    contents = [rng.choice(known) for _ in range(1500)]
    found = {r["line_id"]: r["template"] for r in drain.drain(lines(spark, contents), masked=False).collect()}
    want = drain.cluster_in_order([c.split() for c in contents])
    assert [found[n + 1] for n in range(len(contents))] == want
    streams = drain.cluster_streams(drain.tokenised(lines(spark, contents), masked=False))
    # All passes together read a small part of the lines, and the first one the distinct ones.
    assert streams.read[0] == len(set(contents)) and sum(streams.read) < len(contents) / 2


def test_drain_where_a_repeat_moves(spark):
    """A list that was taken by one cluster later fits another one better, and widens it."""
    rng = random.Random(11)
    contents = []
    for _ in range(600):
        n = rng.randint(2, 4)
        contents.append(" ".join([rng.choice(["go", "<*>", "x9", "stop"]), *rng.choices(["p", "q", "r", "s"], k=n - 1)]))
    found = {r["line_id"]: r["template"] for r in drain.drain(lines(spark, contents), masked=False).collect()}
    for size in (2, 3, 4):
        numbers = [n for n, c in enumerate(contents, 1) if len(c.split()) == size]
        assert [found[n] for n in numbers] == drain.cluster_in_order([contents[n - 1].split() for n in numbers])


def test_memory_searches_wider_patterns_first(spark):
    rows = [
        (1, r"abc (.*?) cde", "abc b cde"), (2, r"abc (.*?)", "abc b"), (3, r"abc (.*?)", "abc z"), (4, r"a (.*?)", "a x"),
        (5, r"qrs tu(", "qrs tu("), (6, r"abc b c d", "nope"),
    ]
    known = memory.learn(spark.createDataFrame(rows, "seq long, regex string, log string"))
    assert [tuple(r) for r in memory.snapshot(known).collect()] == [(3, "abc (.*?) cde"), (2, "abc (.*?)")]
    got = memory.recall(lines(spark, ["abc b cde", "abc, b", "zzz"]), known).orderBy("line_id").collect()
    assert [r["regex"] for r in got] == ["abc (.*?) cde", "abc (.*?)", None]


def test_regex_to_template(spark):
    cases = {r"^a\ b\(x\) ((?:a|(b))c) d.*?\\ (q$": r"a b(x) <*> d<*>\ <*>", r"x (.*?)\.y$": "x <*>.y", "": "", "a" + "(" * 12 + "x" + ")" * 12 + " tail word": "a<*> tail word"}
    df = spark.createDataFrame([(c,) for c in cases], "r string")
    assert {r["r"]: r["t"] for r in df.select("r", regexes.regex_to_template(F.col("r")).alias("t")).collect()} == cases


def test_template_to_regex_repairs_and_limits(spark):
    many = " ".join(["<*> w"] * 40)
    df = spark.createDataFrame([("a <*1*> b*, c.",), ("<*> " * 14 + "end",), (many,)], "t string")
    got = [r[0] for r in df.select(regexes.template_to_regex(F.col("t"))).collect()]
    assert got[0] == "a (.*?) b(.*?) c"
    # A run of wildcards takes its trailing blank with it.
    assert got[1] == " ".join(["(.*?)"] * 10) + "end"
    assert got[2].count("(.*?)") == 30 and got[2].endswith("(.*?)")


def test_fit_regex(spark):
    df = spark.createDataFrame([("(?:GET|POST) (.*?)", "POST /x"), ("a(.*?)", "a"), ("v (.*?) w", "v  z w")], "r string, s string")
    got = [r[0] for r in df.select(regexes.fit_regex("r", "s")).collect()]
    assert got == ["POST (.*?)$", "a(.*?)$", "v  (.*?) w"]


def test_numbering_in_ranges(spark):
    """Order values far apart and one hot key: ranges hold about as many rows each, and few keys are moved."""
    random.seed(1)
    rows = [(n, random.choice(["hot"] * 5 + [f"k{n % 90}"])) for n in random.sample(range(1 << 50), 4000)]
    frame = spark.createDataFrame(rows, "o long, k string").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = number_within(frame, ["k"], "o", "n")
        got = found.collect()
        dealt = frame.repartitionByRange("k", "o").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(dealt) == 16 and max(r["count"] for r in dealt) < 2 * 4000 / 16
    for key in {k for _, k in rows}:
        part = sorted((r["o"], r["n"]) for r in got if r["k"] == key)
        assert [n for _, n in part] == list(range(1, len(part) + 1))
    assert number_within(frame.limit(0), ["k"], "o", "n").count() == 0


def test_lookup_join_salted_equals_broadcast(spark):
    facts = spark.createDataFrame([(n, "hot" if n % 3 else f"k{n % 5}") for n in range(200)], "n long, k string")
    table = spark.createDataFrame([("hot", 1), ("k0", 2)], "k string, v int")
    small = sorted(map(tuple, lookup_join(facts, table, ["k"]).select("n", "v").collect()), key=str)
    salted = sorted(map(tuple, lookup_join(facts, table, ["k"], max_bytes=0, salts=4).select("n", "v").collect()), key=str)
    assert small == salted


def test_lines_are_numbered_over_splits(spark, tmp_path):
    folder = tmp_path / "full data" / "防火墙"
    folder.mkdir(parents=True)
    body = "﻿" + "".join(f"line {n}\n" + ("\n" if n % 3 == 0 else "") for n in range(500))
    (folder / "a+b.log").write_text(body, encoding="utf-8")
    (folder / "a-label.log").write_text("no\n")
    (folder / "notes.txt").write_text("no\n")
    (folder / "old.log.1").write_bytes(b"caf\xe9\r\n\r\nend")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        got = logs.read_lines(spark, str(tmp_path / "full data")).collect()
        names = {r["source"] for r in logs.list_sources(spark, str(tmp_path / "full data"), ["防火墙"]).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    big = sorted((r["line_id"], r["original_content"]) for r in got if r["source"] == "防火墙/a+b.log")
    assert big == [(n + 1, f"line {n}") for n in range(500)]
    assert sorted((r["line_id"], r["original_content"]) for r in got if r["source"] == "防火墙/old.log.1") == [(1, "caf�"), (2, "end")]
    assert names == {"防火墙/a+b.log", "防火墙/old.log.1"}


def test_no_chosen_source_is_an_error(spark, tmp_path):
    (tmp_path / "web").mkdir()
    (tmp_path / "web" / "a.log").write_text("one\ntwo\n")
    (tmp_path / "b.log").write_text("three\n")
    assert logs.read_selected(spark, str(tmp_path)).count() == 3
    assert {r["original_content"] for r in logs.read_selected(spark, str(tmp_path), ["WEB"]).collect()} == {"one", "two"}
    with pytest.raises(FileNotFoundError, match="nothing"):
        logs.read_selected(spark, str(tmp_path), ["nothing"])


def test_formats_by_name(spark):
    rows = [("s", 1, "081109 203615 148 INFO dfs.DataNode: Received blk_-16 from 10.0.0.1:80"), ("s", 2, "other")]
    frame = spark.createDataFrame(rows, "source string, line_id long, original_content string")
    found = logs.format_fields(frame, "hdfs").collect()
    assert [(r["Component"], r["masked"]) for r in found] == [("dfs.DataNode", "Received <*> from <*>")]
    with pytest.raises(ValueError, match="unknown log format"):
        logs.known_format("none")
    for name in logs.LOG_FORMATS:
        assert logs.format_fields(frame, name).columns[-1] == "masked"


def test_representative_picks(spark):
    rows = lines(spark, ["a b c d", "a b c d", "x y", "a b, z"])
    got = sampling.representative(rows, ["source"], k=3).orderBy("pick").collect()
    assert [r["content"] for r in got] == ["a b c d", "x y", "a b z"]
    near = sampling.representative(rows, ["source"], k=2, nearest=True).orderBy("pick").collect()
    assert [r["content"] for r in near] == ["a b c d", "a b c d"]


def test_minimum_distances_small_and_odd_tables(spark, monkeypatch):
    left = spark.createDataFrame([(1, "a b"), (2, "q"), (3, "c b  a"), (4, ""), (5, None)], "i int, text string")
    right = spark.createDataFrame([(7, "a b c"), (8, "z")], "j int, text string")
    for limit in (10**6, 0):
        monkeypatch.setattr(sampling, "BROADCAST_BYTES", limit)
        got = {r["i"]: round(r["min_distance"], 6) for r in sampling.minimum_distances(left, right).collect()}
        assert got == {1: round(1 - 2 / 3, 6), 2: 1.0, 3: 0.0, 4: 1.0, 5: 1.0}
    blank = right.unionByName(spark.createDataFrame([(9, " ")], right.schema))
    got = {r["i"]: round(r["min_distance"], 6) for r in sampling.minimum_distances(left, blank, "cosine").collect()}
    assert got == {1: round(1 - 2 / 6**0.5, 6), 2: 1.0, 3: 0.0, 4: 0.0, 5: 0.0}
    assert {r["min_distance"] for r in sampling.minimum_distances(left, right.limit(0)).collect()} == {1.0}


def test_nearest_sets_equal_force_with_few_pairs(spark):
    rng = random.Random(4)
    words = [f"w{n}" for n in range(400)]
    frequent = [1 / (n + 1) for n in range(400)]
    theirs = [rng.choices(words, frequent, k=rng.randint(4, 30)) for _ in range(150)]
    # Variants of the selected lines, as log lines are of one another, and a few that are like none.
    ours = [[w if rng.random() < 0.8 else rng.choice(words) for w in rng.choice(theirs)] for _ in range(280)]
    ours += [rng.choices(words, frequent, k=rng.randint(1, 30)) for _ in range(20)]

    def close(x, y, metric):
        if metric == "jaccard":
            return len({*x} & {*y}) / len({*x} | {*y})
        p, q = Counter(x), Counter(y)
        norm = (sum(v * v for v in p.values()) * sum(v * v for v in q.values())) ** 0.5
        return sum(p[w] * q[w] for w in p) / norm

    left = spark.createDataFrame([(n, " ".join(x)) for n, x in enumerate(ours)], "i int, text string")
    right = spark.createDataFrame([(" ".join(x),) for x in theirs], "text string")
    for metric in ("jaccard", "cosine"):
        got = {r["i"]: r["min_distance"] for r in sampling.minimum_distances(left, right, metric).collect()}
        for n, x in enumerate(ours):
            assert abs(got[n] - (1 - max(close(x, y, metric) for y in theirs))) < 1e-9
        sets = sampling._token_sets(left, "text"), sampling._token_sets(right, "text")
        compared = sampling.nearest_sets(*sets, metric)[1].count()
        assert compared < sets[0].count() * sets[1].count() / 10, (metric, compared)


def bank_frame(spark, rows):
    return spark.createDataFrame(rows, "line_id int, Component string, Proto string, EventTemplate string, Content string, EventId string")


def test_bank_of_auth_groups_by_event_id(spark):
    rows = [
        (1, "h1 ", "cron[7]", "open <*>", "open 1", "E1"), (2, "h1", "cron[8]", "open <*> now", "open 2", " E1 "),
        (3, "h1", "cron[7]", "open <*>", "open 1", "E1"), (4, "h1", "cron[9]", "close", "close", None),
        (5, "h1", "cron[9]", "close", "  ", "E9"), (6, "h2", "sshd[1]", "in", "in", ""),
    ]
    frame = bank_frame(spark, rows)
    assert sampling.bank_mode(frame.columns) == "auth" and sampling.bank_mode(frame.columns, "syslog") == "syslog"
    got = {r["template"]: (sorted(r["samples"]), r["event_id"]) for r in sampling.template_bank(frame).collect()}
    assert got == {
        "h1 cron[<*>]: open <*>": (["h1 cron[7]: open 1", "h1 cron[8]: open 2"], "E1"),
        "h1 cron[<*>]: close": (["h1 cron[9]: close"], ""),
        "h2 sshd[<*>]: in": (["h2 sshd[1]: in"], ""),
    }
    plain = {r["template"]: sorted(r["samples"]) for r in sampling.template_bank(frame, "syslog").collect()}
    assert plain["h1 cron[<*>]: open <*>"] == ["h1 cron[7]: open 1"] * 2 and "h1 cron[<*>]: open <*> now" in plain
    once = {r["template"]: r["samples"] for r in sampling.template_bank(frame, "syslog", distinct=True).collect()}
    assert once["h1 cron[<*>]: open <*>"] == ["h1 cron[7]: open 1"]


def test_bank_modes_by_columns(spark):
    frame = bank_frame(spark, [(1, "dnsmasq[4]", "x", "query <*>", "query a", "D1")])
    dns = sampling.template_bank(frame.drop("Proto")).first()
    assert (dns["template"], dns["samples"], dns["event_id"]) == ("dnsmasq[<*>]: query <*>", ["dnsmasq[4]: query a"], "D1")
    audit = frame.withColumnRenamed("Component", "TYPE").drop("Proto")
    assert sampling.template_bank(audit).first()["template"] == "dnsmasq[4]: query <*>"
    with pytest.raises(ValueError):
        sampling.bank_mode(["content", "eventtemplate", "eventid"])
    assert sampling.template_bank(frame.limit(0)).isEmpty()


def test_header_layouts_like_plain_patterns(spark):
    import re

    texts = [
        "Jan 5 10:00:00 web app[12]: up and: running", "Jan 5 10:00:00 web app: x", "a  b c d e: f", "a b c d", "a b  c d: e", "x", "",
        "1 2 3 4 5 6 7 8: 9", "[t] [e] body: x", "[t]  [e] body",
    ]
    for layout in (r"<Month> <Date> <Time> <Level> <Component>(\[<PID>\])?: <Content>", r"\[<Time>\] \[<Level>\] <Content>", "<Date> <Time> <Level> <Component>: <Content>"):
        pattern, positions = logs.header_pattern(layout)
        want = {}
        for n, t in enumerate(texts):
            hit = re.search(pattern, t.strip())
            if hit:
                want[n] = tuple(hit.group(g) or "" for g in positions.values())
        df = spark.createDataFrame([("s", n, t) for n, t in enumerate(texts)], "source string, line_id long, original_content string")
        got = {r["line_id"]: tuple(r)[2:] for r in logs.header_fields(df, layout).collect()}
        assert got == want
