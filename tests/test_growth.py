"""Steps whose shuffles and tables must not outgrow their input."""

import random
from collections import Counter

from pyspark.sql import functions as F

from logloom.functions import similarity
from logloom.functions.text import mask, with_mask
from logloom.operators import drain, memory, sampling, skew, templates
from logloom.operators.skew import lookup_join
from logloom.sources import specs


def spreading(df):
    """Plan of a table, in which a row per token or per copy would show as a Generate."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_templates_fold_lines_without_a_row_per_token(spark, monkeypatch):
    draw = random.Random(7)
    rows = [(draw.choice(["s", "t", None]), n, " ".join(draw.choice(["a", "b", "1"]) for _ in range(draw.randint(1, 4)))) for n in range(400)]
    lines = spark.createDataFrame(rows, "source string, line_id long, content string").repartition(3)
    want = {}
    for source, n, content in rows:
        if source is not None:
            words = content.split()
            want.setdefault((source, len(words), "<*>" if words[0] == "1" else words[0]), []).append((n, words))
    merged = {
        key: (" ".join(w[0] if len(set(w)) == 1 else "<*>" for w in zip(*(words for _, words in group))), len(group), min(n for n, _ in group))
        for key, group in want.items()
    }
    for limit in (templates.GROUP_BYTES, 0):
        monkeypatch.setattr(templates, "GROUP_BYTES", limit)
        found = templates.discover(lines)
        assert "Generate" not in spreading(found)
        assert {(r["source"], r["n_tokens"], r["route"]): (r["template"], r["count"], r["first_line"]) for r in found.collect()} == merged


def test_clusters_and_sizes_come_from_templates(spark):
    contents = ["x 1", "x 2", "y z", "x 3", "x 4", "y z", "x 5", "q"]
    lines = spark.createDataFrame([("s", n, c) for n, c in enumerate(contents)], "source string, line_id long, content string")
    parsed, found = templates.parse(lines)
    order = ["first_line", "source", "event_id"]
    cells = ["source", "event_id", "template", "first_line", "count"]
    assert templates.template_clusters(found).orderBy(*order).select(*cells).collect() == templates.clusters(parsed).orderBy(*order).select(*cells).collect()
    kept = {r["line_id"]: r["kept"] for r in templates.sized_lines(lines).collect()}
    assert kept == {n: c.startswith("x") for n, c in enumerate(contents)}


def test_a_large_lookup_table_is_not_copied(spark):
    facts = spark.range(50).select((F.col("id") % 7).alias("k"), F.col("id").alias("n"))
    table = spark.range(5).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"))
    joined = lookup_join(facts, table, ["k"], max_bytes=0)
    assert "Generate" not in spreading(joined)
    want = sorted((n, f"v{n % 7}" if n % 7 < 5 else "") for n in range(50))
    assert sorted((r["n"], r["v"] or "") for r in joined.collect()) == want


def test_a_large_lookup_table_is_not_broadcast(spark):
    facts = spark.range(50).select((F.col("id") % 7).alias("k"), F.col("id").alias("n"))
    table = spark.range(5).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"))
    for how in ("left", "inner"):
        for salts in (1, 3):
            joined = lookup_join(facts, table, ["k"], how, max_bytes=0, salts=salts)
            # Spark itself takes this table for small: only the hint keeps it from being sent to every executor.
            assert "Broadcast" not in spreading(joined) and "SortMergeJoin" in spreading(joined)
            want = sorted((n, f"v{n % 7}" if n % 7 < 5 else "") for n in range(50) if how == "left" or n % 7 < 5)
            assert sorted((r["n"], r["v"] or "") for r in joined.collect()) == want


def test_recall_is_the_same_in_all_ways(spark, monkeypatch):
    contents = ["go to x", "go, to y", "stop all. now", "a.b c", "go to x\n", "one two three four", "wide one", "go to", None]
    shapes = [r"go to (.*?)", "go to x", r"go to y", r"stop all\. now", r"a\.b c", r"one (.*?) four", r"wide (.*?) ?", r"(.*?) one", "go t(o|x) y", "stop a{2}ll"]
    made = [(n, shape, log) for shape in shapes for n, log in enumerate(contents) if log]
    known = memory.learn(spark.createDataFrame(made, "seq long, regex string, log string"))
    assert known.filter("literal IS NULL").select("regex").distinct().count() == 5
    lines = spark.createDataFrame([("s", n, c) for n, c in enumerate(contents)], "source string, line_id long, content string")
    near = {r["line_id"]: r["regex"] for r in memory.recall(lines, known).collect()}
    monkeypatch.setattr(memory, "SMALL", -1)
    monkeypatch.setattr(skew.lookup, "__defaults__", (0,))
    monkeypatch.setattr(skew.lookup_join, "__defaults__", ("left", 0, 1))
    far = memory.recall(lines, known)
    assert {r["line_id"]: r["regex"] for r in far.collect()} == near
    assert near[8] is None and near[2] == r"stop all\. now" and near[3] == r"a\.b c"


def test_many_clusters_are_compared_as_numbers(monkeypatch):
    draw = random.Random(11)
    words = [f"w{n}x" for n in range(9)] + ["<*>", "aa", "bb", "cc"]
    lists = [[draw.choice(words) for _ in range(6)] for _ in range(1500)]
    used = []
    best = drain._Matrix.best
    monkeypatch.setattr(drain._Matrix, "best", lambda self, numbers: used.append(1) or best(self, numbers))
    for similarity in (0.5, 0.7, 0.9):
        fast = drain.cluster_in_order(lists, similarity)
        monkeypatch.setattr(drain, "FEW", 10**9)
        plain = drain.cluster_in_order(lists, similarity)
        monkeypatch.setattr(drain, "FEW", 8)
        assert fast == plain
    assert len(used) > 1000


def test_names_of_a_large_mapping_are_joined_once(spark, monkeypatch):
    monkeypatch.setattr(skew.lookup, "__defaults__", (0,))
    monkeypatch.setattr(skew.lookup_join, "__defaults__", ("left", 0, *skew.lookup_join.__defaults__[2:]))
    rows = spark.createDataFrame([(n, p, f"s{p}", f"s{p}", False, "", "") for n in (1, 2) for p in (0, 1)], "spec_index int, pos int, source string, output string, mapped boolean, definition string, example string")
    mapping = spark.createDataFrame([(2, "s0", "first"), (2, "s1", "second")], "spec_index int, source string, canonical string")
    named = specs.with_canonical_names(rows, mapping)
    assert "Generate" not in spreading(named)
    assert {(r["spec_index"], r["pos"]): r["output"] for r in named.collect()} == {(1, 0): "s0", (1, 1): "s1", (2, 0): "s0", (2, 1): "second"}


def test_field_specs_are_made_row_by_row(spark):
    texts = [
        (1, '[[["a->b", "d1", "e"], ["a", "d2"], ["a -> b", "d3"], [""], ["a->b"]], [["b"], null, ["b", "again"]]]'),
        (2, '[[["a:a"], ["a", "x"], ["a", "y"]], null]'),
    ]
    found = specs.field_specs(spark.createDataFrame(texts, "k int, t string"), "t", expected=2, keys=("k",))
    plan = spreading(found)
    assert "Exchange" not in plan and "Window" not in plan
    cells = ["k", "spec_index", "pos", "source", "output", "mapped", "definition", "example"]
    assert sorted(tuple(r) for r in found.select(*cells).collect()) == [
        (1, 1, 0, "a", "b", True, "d1", "e"), (1, 1, 1, "a", "a", False, "d2", ""), (1, 2, 0, "b", "b", False, "", ""),
        (2, 1, 0, "a:a", "a:a", False, "", ""), (2, 1, 1, "a", "a", False, "x", ""),
    ]
    assert specs.dynamic_columns(found, ["z"]) == ["z", "b", "a:a", "a"]
    seen = found.groupBy("output", "mapped").agg(F.min(F.struct("spec_index", "pos")).alias("at"))
    assert specs.dynamic_columns(found, []) == list(dict.fromkeys(r["output"] for r in seen.orderBy(F.desc("mapped"), "at").collect()))


def test_distances_to_a_small_selection_without_a_shuffle(spark, monkeypatch):
    draw = random.Random(5)
    words = [f"w{n}" for n in range(60)]
    frequent = [1 / (n + 1) for n in range(60)]
    theirs = [" ".join(draw.choices(words[:40], frequent[:40], k=draw.randint(1, 12))) for _ in range(30)]
    ours = [" ".join(draw.choices(words, frequent, k=draw.randint(0, 25))) for _ in range(120)] + ["", None, theirs[3], "zz zz"]
    left = spark.createDataFrame(list(enumerate(ours)), "i int, text string").repartition(3)
    for blank in ([], [""]):
        right = spark.createDataFrame([(x,) for x in theirs + blank], "text string")
        for metric in ("jaccard", "cosine"):
            monkeypatch.setattr(sampling, "BROADCAST_BYTES", 0)
            want = {r["i"]: round(r["min_distance"], 9) for r in sampling.minimum_distances(left, right, metric).collect()}
            monkeypatch.setattr(sampling, "BROADCAST_BYTES", 10**6)
            for cells in (1 << 21, 64, 1):
                monkeypatch.setattr(sampling, "CELLS", cells)
                near = sampling.minimum_distances(left, right, metric)
                assert spreading(near).count("Exchange") == spreading(left).count("Exchange")
                assert {r["i"]: round(r["min_distance"], 9) for r in near.collect()} == want
    assert want[122] == 0.0 and want[123] == 1.0 and want[120] == want[121] == 0.0


def test_cosine_picks_make_squares_once(spark, monkeypatch):
    draw = random.Random(9)
    words = [f"w{n}" for n in range(12)]
    texts = [" ".join(draw.choices(words, k=draw.randint(0, 9))) for _ in range(80)]
    rows = [(f"s{n % 3}", n, x) for n, x in enumerate(texts)]

    def gap(x, y):
        p, q = Counter(x.split()), Counter(y.split())
        norm = sum(v * v for v in p.values()) ** 0.5 * sum(v * v for v in q.values()) ** 0.5
        return 1 - sum(p[w] * q[w] for w in p) / norm if norm else float(bool(p or q))

    want = set()
    for source in ("s0", "s1", "s2"):
        left = [(n, x) for s, n, x in rows if s == source]
        pick = min(left, key=lambda r: (-len(r[1].split()), r[0]))
        taken = []
        for turn in (1, 2, 3):
            taken.append(pick[1])
            want.add((source, turn, pick[1]))
            left.remove(pick)
            pick = min(left, key=lambda r: (-min(gap(r[1], t) for t in taken), r[0]))
    made, dot = [], similarity._dot
    monkeypatch.setattr(similarity, "_dot", lambda a, b: made.append(1) or dot(a, b))
    lines = spark.createDataFrame(rows, "source string, line_id long, content string")
    got = sampling.representative(lines, ["source"], metric="cosine").collect()
    assert {(r["source"], r["pick"], r["content"]) for r in got} == want
    # One for each turn with picks to compare with; with the squares of both lines it was three.
    assert len(made) == 2


def test_clustering_stores_less_than_the_text(spark):
    """Token arrays of all lines were stored, and again for every pass, several times the bytes of the text."""
    import os

    from logloom.session import shared_dir

    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefghijklmnop", k=6)) for _ in range(3000)]
    known = [" ".join(draw.choices(words, k=draw.choice([40, 41, 60]))) for _ in range(1500)]
    contents = known + draw.choices(known, k=1500)
    folder = shared_dir(spark).removeprefix("file:")

    def size():
        return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(folder) for f in names if os.path.exists(f"{d}/{f}"))

    before = size()
    rows = spark.createDataFrame([("s", n, c) for n, c in enumerate(contents)], "source string, line_id long, content string")
    found = drain.drain(rows, masked=False)
    assert size() - before < sum(map(len, contents))
    assert found.count() == len(contents)


def test_lines_of_a_stream_that_repeat_are_counted_once(spark):
    """Every line has one template, that of the plain pass, however often its list is read again."""
    draw = random.Random(2)
    parts = ["<*>", "go", "stop", "x1", "p", "q", "r"]
    contents = [" ".join(draw.choices(parts, k=draw.choice([1, 2, 3, 5]))) for _ in range(1200)] + ["", "one"]
    rows = spark.createDataFrame([("s", n, c) for n, c in enumerate(contents)], "source string, line_id long, content string")
    found = drain.drain(rows, masked=False).select("line_id", "template").collect()
    assert len(found) == len(contents)
    found = {r["line_id"]: r["template"] for r in found}
    for k in range(6):
        numbers = [n for n, c in enumerate(contents) if len(c.split()) == k]
        want = drain.cluster_in_order([contents[n].split() for n in numbers]) if k > 1 else [contents[n] for n in numbers]
        assert [found[n] for n in numbers] == want


def test_masks_by_their_signs(spark):
    """Masking step by step gives what the expression gives, with and without each sign."""
    texts = ["a 1.2.3.4:80 b", "at 10:11:12.5 x", "id deadbeef01 y", "see /a/b,c", "www.é-x.org.", "end. Next", "1.2", "a:b", "abcdefgh", "1.2.3", "...", "a..b", "é.è", "x .y", "١٢:٣٤:٥٦ z", "", None, "1.2.3.4/x 00:00:00 a.b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for got, want in with_mask(rows, "t", "m").select("m", mask(F.col("t"))).collect():
        assert got == want
