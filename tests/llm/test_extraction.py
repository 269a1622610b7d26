"""Pages as browsers read them, trees and decoding against force, and held-out accuracy of the extraction."""

import itertools
import os
import random
import re
from collections import Counter

import numpy as np
import pytest

from logloom.llm import boosting, dom, extraction, layouts

P = "The council voted on Tuesday to extend the tram line to the northern suburbs, after two years of debate. Work will begin next spring, officials said."
Q = "Residents had asked for the extension since 2009. Several shops along the route fear losing customers, but the mayor promised compensation."
R = "Planning takes until March. Then the old rails have to be taken out, which needs about six weeks if the weather allows it."


def blocks(source):
    return [t for t in dom.parse(source).texts if t]


@pytest.mark.parametrize(
    "source, want",
    [
        ("", []),
        ("  \n ", []),
        ("a  b\n\tc d", ["a b c d"]),
        ("<p>one<p>two</p>three", ["one", "two", "three"]),
        ("<p>a<b>b</b>c<br>d <i>e</i></p>", ["abc d e"]),
        ("<p>1 &lt; 2 &amp;amp; &copy &#233;&#x4e2d; &nosuch; &am", ["1 < 2 &amp; © é中 &nosuch; &am"]),
        ("1 < 2 <3 <- </ 4", ["1 < 2 <3 <-"]),
        ("<script>var a='</p>';</script>x<style>p{}</style>y<!-- <p>no</p> -->z<textarea>no</textarea>", ["xyz"]),
        ("a<script>never closed <p>no", ["a"]),
        ("a<!-- never closed <p>no", ["a"]),
        ("a<p class='cut", ["a"]),
        ("<p title=\"a > b\" x='>' y=a>in</p>", ["in"]),
        ("<p title=\"5\" tall\">in</p>out", ["in", "out"]),
        ("<head><title>no</title><meta x><p>in", ["in"]),
        ("<head><noscript><p>no</p></noscript></head><body>in", ["in"]),
        ("<select><option>no<option>no</select>in<button>no<b>no</b></button> too", ["in too"]),
        ("<div><form>a<button>no</form>b</div>c", ["a", "b", "c"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", ["a", "b", "c", "d", "e"]),
        ("<table><tr><td>a<td>b<p>c<tr><td>d</table>e", ["a", "b", "c", "d", "e"]),
        ("</div></p><div>a</section>b</div>c", ["ab", "c"]),
        ("<DIV>a</Div><my-box>b</my-box>", ["a", "b"]),
        ("<article><p><b>T<br><p>a</article><footer>f", ["T", "a", "f"]),
        ("a<hr>b</body></html>c", ["a", "bc"]),
    ],
)
def test_blocks_as_browsers_read_them(source, want):
    assert blocks(source) == want


def test_tree_is_whole_for_any_input():
    rng = random.Random(1)
    parts = ["<p>", "</p>", "<div class='a b'>", "</div>", "<a href=x>", "</a>", "<td>", "<table>", "</table>", "<li>", "<svg>", "</svg>", "x y", "&amp;", "<", ">", '"', "<!--", "-->", "<script>", "</script>", "<br>", "<head>", "<body>"]
    for _ in range(400):
        page = dom.parse("".join(rng.choices(parts, k=rng.randint(0, 60))))
        for node in range(1, len(page.tags)):
            parent = page.parents[node]
            assert parent < node < page.ends[node] <= page.ends[parent]
            assert page.depths[node] == page.depths[parent] + 1 and page.linked[node] <= len(page.texts[node])
        table = extraction.features([page, dom.parse("<p>a")])
        assert len(table) == len(page.tags) + 3 and np.isfinite(table).all()


def test_features_do_not_depend_on_the_batch():
    pages = [dom.parse(layouts.Maker(seed).page()) for seed in range(20)]
    together = extraction.features(pages)
    assert np.array_equal(together, np.concatenate([extraction.features([page]) for page in pages]))


def test_trees_learn_and_are_the_same_each_time():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(4000, 6)).astype(np.float32)
    wanted = ((rows[:, 0] > 0) ^ (rows[:, 3] > 0.5)).astype(float)
    trees, again = (boosting.fit(rows[:3000], wanted[:3000], np.ones(3000)) for _ in range(2))
    assert np.array_equal(trees.leaf, again.leaf)
    assert ((trees.score(rows[3000:]) > 0) == wanted[3000:]).mean() > 0.95


def test_decoding_is_the_best_choice_without_contradictions():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 8)
        page = dom.Page()
        for _ in range(n):
            page.add("div", rng.randrange(len(page.tags)), ())
        # Children in any order of their parents are enough here: parents come first.
        odds = [0.0] + [rng.uniform(-3, 3) for _ in range(n)]
        best = None
        for choice in itertools.product([True, False], repeat=n):
            kept = [True, *choice]
            if any(kept[i] and not kept[page.parents[i]] for i in range(1, n + 1)):
                continue
            cuts = sum(not kept[i] and kept[page.parents[i]] for i in range(1, n + 1))
            value = sum(odds[i] for i in range(1, n + 1) if kept[i]) - extraction.CUT_COST * cuts
            if best is None or value > best[0] + 1e-12:
                best = (value, kept)
        assert extraction.decode(page, odds) == best[1]


def test_held_out_layouts():
    trees = extraction.model()
    makers = [layouts.Maker(seed) for seed in range(50_000, 50_300)]
    found = extraction.main_texts([maker.page() for maker in makers], trees)
    wanted = [Counter(maker.gold) for maker in makers]
    both = sum(((w & Counter(f)).total()) for w, f in zip(wanted, found))
    assert both / sum(w.total() for w in wanted) > 0.97
    assert both / sum(map(len, found)) > 0.95
    told = [m.gold == f for m, f in zip(makers, found) if m.semantic and m.telling]
    assert np.mean(told) > 0.9


BLOG = f"""<!doctype html><html><head><title>Tram</title><script>var a="<p>no</p>"</script></head><body class="post-template single">
<div id="page"><header id="masthead" class="site-header"><p class="site-title"><a href="/">City News</a></p><p class="site-description">All the news</p>
<nav class="main-navigation"><ul><li><a>Home</a></li><li><a>Politics</a></li></ul></nav></header><div id="content"><main id="main">
<article id="post-12" class="post type-post"><header class="entry-header"><h1 class="entry-title">Tram line to be extended</h1></header>
<div class="entry-content"><p>{P}</p><div class="ad-container">Buy two, get one free. Only this week.</div><p>{Q}</p><h2>What comes next</h2>
<ul><li>Planning until March</li><li>Construction from April</li></ul></div></article><div id="comments" class="comments-area"><h2>3 thoughts</h2>
<ol class="comment-list"><li class="comment"><p>Great news for all of us who live up there, I have been waiting for years.</p></li></ol>
<form><p>Leave a reply</p><textarea></textarea></form></div></main></div><aside id="secondary" class="widget-area"><h3>Recent posts</h3><ul>
<li><a>Fire in the old mill</a></li></ul></aside></div><footer class="site-footer"><p>&copy; 2024 City News. All rights reserved.</p></footer>
<div class="cookie-banner" role="dialog"><p>We use cookies to improve your visit. By going on you agree.</p><button>OK</button></div></body></html>"""
SOUP = f"""<html><body><table><tr><td><a href=1>Home</a><br><a href=2>News</a></td><td><h1>Tram line</h1><p>{P}<p>{Q}<p>{R}</td></tr></table>
<div>Copyright 2001 City News | <a>Contact</a> | <a>Legal</a></div></body></html>"""
FORM = f"<body><form id=aspnetForm><div class=header><a>Site</a></div><div id=content><h1>Tram line</h1><p>{P}</p><p>{Q}</p></div></form></body>"


@pytest.mark.parametrize(
    "source, want",
    [
        (BLOG, ["Tram line to be extended", P, Q, "What comes next", "Planning until March", "Construction from April"]),
        (SOUP, ["Tram line", P, Q, R]),
        (FORM, ["Tram line", P, Q]),
        (f"<p>{P}</p><p>{Q}</p>", [P, Q]),
        ("<body><nav><ul><li><a>x</a></li></ul></nav><footer>&copy; 2020</footer></body>", []),
    ],
)
def test_pages_written_by_hand(source, want):
    assert extraction.main_texts([source], extraction.model()) == [want]


def test_extract_on_awkward_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars string, node int, `a.b` int"
    long = "<article>" + "".join(f"<p>{P} {i}</p>" for i in range(20_000)) + "</article>"
    deep = "<div>" * 3000 + f"<p>{P}</p>"
    rows = [(1, "u", None), (1, None, ""), (None, "v", BLOG), (3, "w", long), (3, "w", BLOG), (3, "w", BLOG), (4, "x", deep), (5, "y", "<" * 50_000), (6, "z", '<p a="' * 20_000)]
    frame = spark.createDataFrame([(*r, "t", "n", 1, 2) for r in rows], schema).repartition(2)
    found = extraction.extract(frame, keep=["url"])
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    got = Counter((r["page_id"], r["url"], r["text"]) for r in found.collect() if r["page_id"] not in (4, 5, 6))
    blog = "\n\n".join(extraction.main_texts([BLOG], extraction.model())[0])
    assert got[(3, "w", blog)] == 2 and got[(None, "v", blog)] == 1 and got[(1, "u", "")] == 1 and got[(1, None, "")] == 1
    assert got[(3, "w", "\n\n".join(f"{P} {i}" for i in range(20_000)))] == 1
    assert extraction.extract(frame.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_given_pages_give_their_article(spark):
    def article(source):
        # A plain reading of these pages: all between the marks of the article, or up to the end where it is cut off.
        inside = re.search(r"<article>(.*?)(?:</article>|$)", source, re.S)
        return blocks(inside[1]) if inside else []

    for row in extraction.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), keep=["html"]).collect():
        assert row["text"] == "\n\n".join(article(row["html"])) and row["n_chars"] == len(row["text"])
