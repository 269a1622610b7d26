"""Patterns across engines, the index of patterns against plain search, and the rounds of the template stage."""

import random
import re

import pytest
from pyspark.sql import functions as F

from logloom.functions import patterns
from logloom.operators import memory, stage
from logloom.plans import flows


def lines(spark, contents, source="s"):
    return spark.createDataFrame([(source, n + 1, c) for n, c in enumerate(contents)], "source string, line_id long, content string")


TEXTS = [
    "abcdef", "abc def", "xx aa bb", "a{b", "a{3}", "host-1 x_y=2", "é ü 漢 ٣", "line\x85two", "tab\there", "a\x0bb", "[x]", "a&&b", "", " ",
    "ABC", "a^b", "a]b", "a\\b", "a-b", "12 12", "12 13", "user u1 logged in", "end\n", "k=v k2=v2", "#note", "a b  c", "x\x07y", "~|~",
]
PATTERNS = [
    r"(?P<x>abc)def", r"(?P<a_b>\d+) (?P=a_b)", "(", "[", r"abc\Z", r"a{,2}b", r"a{b", r"a{3}", r"[[]x]", r"[]x[]+", r"[^]]+", r"a[&&]+b", r"\w+ \w+", r"[\w]+\s[\W]",
    r"(?i)abc", r"(?a)\w+ ", r"(?s:a.b)", r"a.b", r"line.two", r"\d", r"\x61", r"a\x0bb", "a\\vb", r"[\b]", r"\babc\b", r"(a)(b)\2?", r"(\d+) \1", r"(?#say)abc", r"a|x", r"(?:a|x)+ ",
    r"\N{LATIN SMALL LETTER E WITH ACUTE}", r"漢", r"\U00006f22", r"\p{L}", r"\z", r"\Qa\E", r"a++b", r"(?>a+)b", r"(?<=a)b", r"(?<!a)b", r"(?(1)a|b)", r"$", r"^", r"end$", r"#note", r"[#~|]+",
    r"\07y", r"x\ay", r"a\-b", r"}", r"{", r"a\\b", r".*", r"(?x) a b c", r"k\d?=v", r"*a", r"a**", r"(?P<n>", r"\8", r"(?P<é>a)b",
]


def test_patterns_mean_the_same_in_both_engines(spark):
    frame = spark.createDataFrame([(n, p) for n, p in enumerate(PATTERNS)], "n int, regex string")
    made = frame.withColumn("_made", patterns.prepared(F.col("regex"))).select("n", patterns.runnable(F.col("_made.java")).alias("java"))
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    pairs = texts.crossJoin(made).select("n", "i", F.coalesce(F.rlike("t", F.col("java")), F.lit(False)).alias("hit"))
    got = {(r["n"], r["i"]) for r in pairs.filter("hit").collect()}
    want = set()
    for n, p in enumerate(PATTERNS):
        try:
            want |= {(n, i) for i, t in enumerate(TEXTS) if re.search(p, t)}
        except re.error:
            pass
    # A choice by group is Python's alone; it matches nothing here.
    alone = {n for n, p in enumerate(PATTERNS) if p.startswith("(?(")}
    assert got == {w for w in want if w[0] not in alone}


def test_patterns_that_end_no_job(spark):
    rows = [(1, "(?P<x>abc)def", "abcdef"), (2, "(", "("), (3, r"abc\Z", "abc"), (4, r"ab\p{L}d", "abcd"), (5, "abc[", "abc["), (6, None, "x"), (7, "abc", None)]
    known = memory.learn(spark.createDataFrame(rows, "seq long, regex string, log string"))
    assert {r["regex"] for r in known.collect()} == {"(?P<x>abc)def", r"abc\Z"}
    got = memory.recall(lines(spark, ["abcdef", "abc", "abcd", None]), known).orderBy("line_id").collect()
    assert [r["regex"] for r in got] == ["(?P<x>abc)def", r"abc\Z", None, None]


@pytest.mark.parametrize(
    "pattern, keys",
    [
        (r"^user (.*?) logged in$", ["wuser", "wlogged", "win"]), (r"^a|b c$", []), (r"^(?:a|b) cc d?$", ["wcc"]), (r"^name=(.*?) x\.y$", ["pname", "wx.y"]),
        (r"^ab{2} cd{0,1} ef$", ["wef"]), (r"^(?i)abc def$", []), (r"^a\ b$", ["wa", "wb"]), (r"^a\sb cc$", ["wcc"]), (r"^a{b cc$", ["wa{b", "wcc"]),
        (r"^longword(.*?)$", ["plong"]), (r"^x+ yy*? zz$", ["wzz"]), (r"^[a b] cc$", ["wcc"]),
    ],
)
def test_words_that_lines_must_hold(pattern, keys):
    assert patterns.required_keys(patterns.plain_text(pattern)) == keys


def test_recall_equals_plain_search(spark):
    rng = random.Random(4)
    words = ["alpha", "be", "gamma", "d=1", "eps", "zz", "user", "id=7", "(x)", "a,b"]
    contents = [" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(150)]
    rows = []
    for seq in range(400):
        parts = [re.escape(w).replace(r"\ ", " ") if rng.random() < 0.6 else rng.choice(["(.*?)", r"\S+", "id=(.*?)", "[a-z]+", "(?:be|eps)", "user?"]) for w in rng.choice(contents).split(" ")]
        rows.append((seq, " ".join(parts), rng.choice(contents)))
    known = memory.learn(spark.createDataFrame(rows, "seq long, regex string, log string"))
    want_known = {}
    whole = lambda r, t: re.search("^" + r.replace(",", "") + "$", t.replace(",", ""))
    for seq, regex, log in rows:
        if len(re.sub(r"[!-/:-@\[-`{-~ ]", "", regex)) >= 3 and whole(regex, log):
            want_known.setdefault(regex, seq)
    assert {r["regex"]: r["seq"] for r in known.collect()} == want_known
    order = sorted(((r.count(" ") + 1, s, r) for r, s in want_known.items()), key=lambda x: (-x[0], x[1]))
    got = memory.recall(lines(spark, contents), known).collect()
    for row in got:
        n = row["content"].count(" ") + 1
        assert row["regex"] == next((r for c, _, r in order if c in (n, n + 1) and whole(r, row["content"])), None)
    # An index entry is looked up by a word, so most patterns are not tried on most lines.
    assert memory.index(known).filter("key = ''").select(F.explode("entries")).count() < len(want_known) / 3


SHAPES = [f"login of user u{n} from 10.0.0.{n}" for n in range(30)] + [f"disk d{n} is {n} percent full now" for n in range(30)]
SHAPES += ["service started"] * 5 + [f"job {n} done" for n in range(12)] + ["reboot"]


def test_stage_covers_every_line_and_remembers(spark):
    done = stage.fit_stage(lines(spark, SHAPES), ["source"])
    rows = done.lines.collect()
    assert len(rows) == len(SHAPES)
    assert all(re.search(r["regex"].replace(",", ""), r["content"].replace(",", "")) for r in rows)
    report = [r.asDict() for r in done.rounds.orderBy("round").collect()]
    for row, after in zip(report, report[1:]):
        assert after["tried"] == row["missed"] <= row["tried"]
        # A round that fits a pattern remembers it.
        assert after["fitted"] + after["static"] == 0 or after["remembered"] > row["remembered"]
    assert report[-1]["missed"] < 10 and report[-1]["remembered"] > 3
    for row in report:
        assert row["recalled"] + row["static"] + row["fitted"] + row["missed"] == row["tried"]
    again = stage.fit_stage(lines(spark, SHAPES), ["source"], memory=done.memory)
    assert again.lines.filter("way = 'memory'").count() > 0.9 * len(SHAPES)
    assert again.rounds.collect()[0]["recalled"] >= len(set(SHAPES)) * 0.9


def test_static_groups(spark):
    contents = ["service started", "a is b", "k=v", "go to x", "a_b", "a-b", "a:b", "a.b", "item 7", "ends"]
    frame = lines(spark, contents).withColumn("static", stage.is_static(F.col("content"), F.lit(1)))
    assert [r["content"] for r in frame.filter("static").collect()] == ["service started", "ends"]
    done = stage.fit_stage(lines(spark, ["service (up)"] * 3), ["source"]).lines.collect()
    assert {(r["way"], r["regex"]) for r in done} == {("static", r"service \(up\)")}
    long = lines(spark, ["x " * 120 + "error of kind 3", "short error of kind 3"])
    assert [r["line_id"] for r in long.filter(stage.is_long(F.col("content"), "error of (.*?)$")).collect()] == [1]


def test_generator_fails_in_every_way(spark):
    asked = lines(spark, [f"login of user u{n}" for n in range(9)], "a").unionByName(lines(spark, [f"disk d{n} full" for n in range(9)], "b"))
    asked = asked.unionByName(lines(spark, [f"fan {n} slow" for n in range(9)], "c")).unionByName(lines(spark, [f"net {n} down" for n in range(9)], "d"))

    def generator(samples):
        if samples[0].startswith("login"):
            if len(samples) > 1:
                raise RuntimeError("too many samples")
            return 'The template is `login of user <*>`, "surely".'
        if samples[0].startswith("disk"):
            raise ValueError("never works")
        if samples[0].startswith("fan"):
            return "(?P<broken"
        return None

    done = stage.fit_stage(asked, ["source"], generator=generator)
    found = {(r["source"], r["template"], r["way"]) for r in done.lines.filter("round = 0").collect()}
    assert ("a", "login of user <*>", "fitted") in found
    assert ("b", "disk <*> full", "fitted") in found and ("d", "net <*> down", "fitted") in found
    assert done.lines.count() == 36


def test_clean_generated(spark):
    from logloom.functions.regexes import clean_generated

    cases = {"`a <*>`": "a <*>", "x ``` long, one ``` `b`": "long one", '"^abc def.$': "abc def", "  plain. ": "plain", r"a\ b": "a b", "it finished": "it "}
    frame = spark.createDataFrame([(c,) for c in cases], "t string")
    assert {r["t"]: r["c"] for r in frame.select("t", clean_generated(F.col("t")).alias("c")).collect()} == cases


def test_empty_and_null_lines(spark):
    empty = stage.fit_stage(lines(spark, ["x"]).limit(0), ["source"])
    assert empty.lines.count() == 0 and empty.memory.count() == 0
    odd = stage.fit_stage(lines(spark, [None, "", "a", "long " * 400 + "9", "(((", "a\\"]), ["source"]).lines
    assert odd.count() == 6


def test_flow_from_raw_lines(spark):
    raw = [f"2024-01-01 10:00:{n:02d} login of user u{n}" for n in range(20)] + [f"2024-01-02 10:00:{n:02d} disk d{n} full" for n in range(20)]
    frame = spark.createDataFrame([("s", n, t) for n, t in enumerate(raw)], "source string, line_id long, original_content string")
    for in_order in (False, True):
        done = flows.parse_sources(frame, in_order=in_order)
        rows = done.lines.collect()
        assert len(rows) == 40 and {r["timestamp"][:10] for r in rows} == {"2024-01-01", "2024-01-02"}
        again = flows.parse_sources(frame, remembered=done.memory, in_order=in_order).lines
        assert again.filter("way = 'memory'").count() == 40


def test_patterns_of_wildcards_are_tried_in_one_pass(spark):
    """A line that lacks the last word made the engine try all ways to share the line among the wildcards."""
    import time

    shape, line = "(.*?) x " * 12 + "end", "ab x " * 60
    quick = patterns.straight(f"^{shape}$")
    started = time.time()
    assert not re.search(quick, line) and not re.search(patterns.straight(shape), line)
    assert re.search(quick, line + "end") and time.time() - started < 1
    rng = random.Random(6)
    for _ in range(5000):
        pattern = "(.*?)".join("".join(rng.choices(["a", "b", " ", r"\.", r"\$"], k=rng.randint(0, 2))) for _ in range(rng.randint(2, 5)))
        pattern = rng.choice(["", "^"]) + pattern + rng.choice(["", "$"])
        text = "".join(rng.choices("ab .$\n", weights=[5, 5, 3, 1, 1, 1], k=rng.randint(0, 9)))
        assert bool(re.search(pattern, text)) == bool(re.search(patterns.straight(pattern), text)), (pattern, text)
    for pattern in (None, "a", "a(b|c)(.*?)", "[a](.*?)", "a\n(.*?)b", "(.*?)(?i)b"):
        assert patterns.straight(pattern) == pattern
    rows = [(shape, f"{line}end", True), (shape, line, False), (r"a\$(.*?)", "xa$", True), ("b(.*?)c", "b\nc", False), ("(.*?)b(.*?)c", "b\nbc", True)]
    made = spark.createDataFrame(rows, "regex string, t string, want boolean").withColumn("_made", patterns.prepared(F.col("regex")))
    assert all(r["got"] == r["want"] for r in made.select("want", patterns.found_in(F.col("t"), F.col("_made")).alias("got")).collect())


def test_stage_stores_its_lines_in_few_bytes(spark):
    """Lines were stored uncompressed several times a round, with their patterns beside them."""
    import os

    from logloom.session import shared_dir

    contents = [f"login of user u{n % 700} from 10.0.{n % 250}.{n % 99} over channel {n % 13} was {'kept' if n % 3 else 'lost'}" for n in range(20_000)]
    folder = shared_dir(spark).removeprefix("file:")

    def size():
        return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(folder) for f in names if os.path.exists(f"{d}/{f}"))

    before = size()
    done = stage.fit_stage(lines(spark, contents), ["source"], refine=False)
    assert size() - before < 1.2 * sum(map(len, contents))
    assert done.lines.count() == len(contents)
    report = {r["round"]: r for r in done.rounds.collect()}
    assert report[0]["tried"] == len(set(contents))


def test_recall_by_a_memory_in_the_query(spark, monkeypatch):
    """A small memory is written into the query; the order of its tries stays."""
    contents = ["a x end", "a y end", "b, x end", "a x", "a x end more", "", None]
    rows = [(5, "a (.*?) end", "a x end"), (3, "(.*?) x end", "a x end"), (4, "a x end", "a x end"), (1, "a (.*?) end (.*?)", "a x end more")]
    known = memory.learn(spark.createDataFrame(rows, "seq long, regex string, log string"))
    here = {r["line_id"]: r["regex"] for r in memory.recall(lines(spark, contents), known).collect()}
    monkeypatch.setattr(memory, "WRITTEN", -1)
    there = {r["line_id"]: r["regex"] for r in memory.recall(lines(spark, contents), known).collect()}
    assert here == there and sum(r is not None for r in here.values()) == 4
