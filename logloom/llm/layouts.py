"""Labelled pages made from layout rules, for fitting the extractor: markup of many styles around invented prose."""

from __future__ import annotations

import html
import random

# Words of class and id attributes by what they usually mark.
ATTRIBUTE_WORDS = {
    "menu": "nav navigation navbar navi menu submenu topnav subnav breadcrumb breadcrumbs crumbs pagination pager toc tabs skip toolbar",
    "advert": "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted adsense adsbygoogle dfp outbrain taboola",
    "comments": "comment comments commentlist reply replies respond disqus discussion feedback",
    "social": "share sharing social follow like tweet facebook twitter linkedin whatsapp print email",
    "notice": "notice notices cookie cookies consent gdpr alert dialog modal popup overlay privacy warning message toast announcement disclaimer paywall",
    "side": "sidebar side aside widget widgets related recommended recommendations more trending popular latest teaser teasers complementary archive tags tagcloud",
    "frame": "header head masthead topbar footer foot bottom copyright legal logo branding contentinfo colophon imprint credits",
    "form": "form login signin signup register newsletter subscribe subscription search searchbox contact",
    "main": "article content entry post story main body text prose page maincontent articlebody blogpost news",
    "hidden": "!hidden hidden invisible",
}
GROUPS = tuple(ATTRIBUTE_WORDS)
GROUP_OF = {word: group for group, words in ATTRIBUTE_WORDS.items() for word in words.split()}
SYLLABLES = "al be ca do en fi go ha in jo ku la mi no op pa qu ro si tu ver ung tion ment ciòn heit est sch eau".split()
ROLES = {"menu": "navigation", "frame": "contentinfo", "side": "complementary", "notice": "alertdialog", "form": "search"}


class Maker:
    """One invented page; ``gold`` holds the text blocks of its article in page order."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.gold: list[str] = []
        # How much the markup says: semantic elements, telling attributes, both or neither.
        self.semantic, self.telling = self.rng.random() < 0.5, self.rng.random() < 0.7
        self.closes = self.rng.random() < 0.8
        self.wordy = self.rng.random() < 0.5

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def words(self, low: int, high: int) -> str:
        n = self.rng.randint(low, high)
        return " ".join("".join(self.rng.choices(SYLLABLES, k=self.rng.randint(1, 3))) for _ in range(n))

    def sentences(self, low: int, high: int) -> str:
        out = []
        for _ in range(self.rng.randint(low, high)):
            words = self.words(3, 18).split()
            if len(words) > 6 and self.chance(0.4):
                words[len(words) // 2] += ","
            out.append(" ".join(words).capitalize() + self.rng.choice("....?!"))
        return " ".join(out)

    def mark(self, group: str, tag: str | None = None) -> tuple[str, str]:
        """Start and end tag of an element of this group."""
        if tag is None or not self.semantic:
            tag = self.rng.choice(["div", "div", "section"] if self.semantic else ["div"])
        attrs = ""
        if self.telling and self.chance(0.85):
            name = self.rng.choice([w for w in ATTRIBUTE_WORDS[group].split() if w[0] != "!"])
            if self.chance(0.4):
                other = self.rng.choice(["box", "block", "wrapper", "inner", "list", "area", "container", "item", "content", "text", "post", "article", "page"])
                name = self.rng.choice([f"{name}-{other}", f"{other}-{name}", f"{name}{other.capitalize()}", f"{name} {other}", f"{name}_{other}"])
            attrs = f' {self.rng.choice(["class", "class", "id"])}="{name}"'
        if self.semantic and group in ROLES and self.chance(0.2):
            attrs += f' role="{ROLES[group]}"'
        return f"<{tag}{attrs}>", f"</{tag}>"

    def wrap(self, group: str, inner: str, tag: str | None = None) -> str:
        start, end = self.mark(group, tag)
        return start + inner + end

    def block(self, tag: str, text: str, gold: bool, rich: bool = False) -> str:
        if gold:
            self.gold.append(text)
        shown = html.escape(text, quote=False)
        if rich and self.chance(0.4):
            words = shown.split(" ")
            i = self.rng.randrange(len(words))
            words[i] = self.rng.choice(["<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<span>{}</span>"]).format(words[i])
            shown = " ".join(words)
        end = "" if tag in ("p", "li") and not self.closes and self.chance(0.5) else f"</{tag}>"
        return f"<{tag}>{shown}{end}"

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(self.rng.randint(low, high))]
        style = self.rng.randrange(3)
        if style == 0:
            return "<ul>" + "".join(f"<li>{item}</li>" for item in items) + "</ul>"
        if style == 1:
            return self.rng.choice([" | ", " &middot; ", " "]).join(items)
        return "".join(f"<div>{item}</div>" for item in items)

    # Parts that are not the article

    def menu(self) -> str:
        return self.wrap("menu", self.links(2, 12), "nav")

    def advert(self) -> str:
        inner = self.rng.choice([self.sentences(1, 3), f'<p>{self.sentences(1, 2)}</p>', f'<a href="/buy">{self.words(2, 8)}</a>', f"<h3>{self.words(2, 4)}</h3><p>{self.sentences(1, 2)}</p>"])
        return self.wrap("advert", inner, self.rng.choice(["div", "aside"]))

    def notice(self) -> str:
        inner = self.rng.choice([self.sentences(1, 2), f"<p>{self.sentences(1, 3)}</p>", f"{self.sentences(1, 1)} <button>{self.words(1, 2)}</button>"])
        return self.wrap("notice", inner, self.rng.choice(["div", "aside", "section"]))

    def social(self) -> str:
        return self.wrap("social", self.links(2, 5))

    def side(self) -> str:
        def teaser() -> str:
            text = f"<p>{self.sentences(1, 2)}</p>" if self.chance(0.5) else ""
            return f'<h4><a href="/t">{self.words(2, 6)}</a></h4>{text}'

        parts = [f"<h3>{self.words(1, 3)}</h3>"] if self.chance(0.7) else []
        parts += [self.rng.choice([lambda: self.links(3, 8), teaser, lambda: f"<p>{self.sentences(1, 2)}</p>"])() for _ in range(self.rng.randint(1, 3))]
        return self.wrap("side", "".join(parts), "aside")

    def form(self) -> str:
        inner = f"<label>{self.words(1, 3)}</label><input><button>{self.words(1, 1)}</button>"
        if self.chance(0.5):
            inner = f"<h3>{self.words(1, 4)}</h3><p>{self.sentences(1, 1)}</p>" + inner
        return self.wrap("form", f"<form>{inner}</form>" if self.chance(0.8) else inner, "section")

    def comments(self) -> str:
        def one() -> str:
            who = f"<span>{self.words(1, 2)}</span> " if self.chance(0.5) else f"<div>{self.words(1, 2)}</div>"
            text = "".join(f"<p>{self.sentences(1, 4)}</p>" for _ in range(self.rng.randint(1, 2)))
            return self.wrap("comments", who + text, self.rng.choice(["article", "div"])) if self.chance(0.7) else f"<li>{who}{text}</li>"

        body = "".join(one() for _ in range(self.rng.randint(1, 6)))
        start, end = self.mark("comments", "section")
        if "class" not in start and "id" not in start:
            # Nothing but a telling attribute sets a reader's comment apart from the article.
            start = f'<{start[1:-1].split()[0]} {self.rng.choice(["id", "class"])}="{self.rng.choice(ATTRIBUTE_WORDS["comments"].split())}">'
        return f"{start}<h3>{self.words(1, 3)}</h3>{body}{end}"

    def top(self) -> str:
        title = self.rng.choice(["<h1>{}</h1>", '<a href="/">{}</a>', "<div>{}</div>", "<p>{}</p>"]).format(self.words(1, 4))
        parts = [title]
        if self.chance(0.4):
            parts.append(f"<p>{self.words(2, 8)}</p>" if self.chance(0.6) else self.form())
        if self.chance(0.4):
            parts.append(self.menu())
        return self.wrap("frame", "".join(parts), "header")

    def bottom(self) -> str:
        parts = [self.rng.choice([f"&copy; {self.words(1, 3)} &middot; {self.sentences(1, 2)}", f"<p>&copy; {self.words(1, 4)}</p>", self.links(2, 6)])]
        if self.chance(0.4):
            parts.append(f"<p>{self.sentences(1, 3)}</p>")
        return self.wrap("frame", "".join(parts), "footer")

    def unseen(self) -> str:
        text = self.sentences(1, 2)
        return self.rng.choice([f"<script>var a = '{self.words(1, 4)}</p>';</script>", "<style>p{margin:0}</style>", f"<!-- {text} -->", f"<noscript><p>{text}</p></noscript>", f'<div style="display:none"><p>{text}</p></div>'])

    # The article

    def article(self) -> str:
        parts = []
        heading = self.chance(0.85)
        if heading:
            title = self.block(self.rng.choice(["h1", "h1", "h2"]), self.words(2, 10).capitalize() + self.rng.choice(["", ".", ""]), True)
            if self.chance(0.3):
                tag = "header" if self.semantic else "div"
                name = f'{self.rng.choice(["entry", "post", "article", "page", "story"])}-{self.rng.choice(["header", "head", "title"])}'
                title = f'<{tag} class="{name}">{title}</{tag}>' if self.telling and self.chance(0.7) else f"<{tag}>{title}</{tag}>"
            parts.append(title)
        low, high = self.rng.choice([(1, 1), (1, 3), (2, 6), (4, 14), (10, 30)])
        for i in range(self.rng.randint(low, high)):
            kind = self.rng.random()
            if kind < 0.72 or i == 0:
                parts.append(self.block("p", self.sentences(1, self.rng.choice([1, 2, 5, 8])), True, rich=True))
            elif kind < 0.8:
                parts.append(self.block(self.rng.choice(["h2", "h3"]), self.words(1, 7).capitalize(), True))
                parts.append(self.block("p", self.sentences(1, 4), True, rich=True))
            elif kind < 0.86:
                tag = self.rng.choice(["ul", "ol"])
                long = self.chance(0.5)
                items = "".join(self.block("li", self.sentences(1, 2) if long else self.words(1, 8), True, rich=True) for _ in range(self.rng.randint(2, 6)))
                parts.append(f"<{tag}>{items}</{tag}>")
            elif kind < 0.9:
                quote = self.block("p", self.sentences(1, 3), True)
                parts.append(f"<blockquote>{quote}</blockquote>")
            elif kind < 0.93:
                parts.append(self.block("pre", self.words(4, 30), True))
            elif kind < 0.95:
                caption = self.block("figcaption", self.sentences(1, 1), True)
                parts.append(f"<figure><img>{caption}</figure>")
            elif kind < 0.97:
                rows = "".join("<tr>" + "".join(self.block("td", self.words(1, 4), True) for _ in range(3)) + "</tr>" for _ in range(self.rng.randint(1, 4)))
                parts.append(f"<table>{rows}</table>")
            else:
                parts.append(self.rng.choice([self.advert, self.side, self.social, self.unseen])())
        if self.chance(0.15):
            parts.append(self.rng.choice([self.social, self.form, self.side, self.comments, self.menu])())
        return self.wrap("main", "".join(parts), self.rng.choice(["article", "main", "article"]))

    def page(self) -> str:
        parts = [self.rng.choice([self.top, self.menu, self.notice, self.advert, self.unseen])() for _ in range(self.rng.randint(0, 3))]
        side = self.side() if self.chance(0.4) else ""
        first = self.chance(0.4)
        if first:
            parts.append(side)
        if self.chance(0.94):
            parts.append(self.article())
        if not first:
            parts.append(side)
        parts += [self.rng.choice([self.social, self.comments, self.comments, self.form, self.advert, self.menu, self.side, self.notice, self.unseen])() for _ in range(self.rng.randint(0, 3))]
        if self.chance(0.85):
            parts.append(self.bottom())
        body = "".join(parts)
        for _ in range(self.rng.choice([0, 0, 1, 2])):
            body = f'<div class="{self.rng.choice(["wrapper", "container", "page", "row", "site"])}">{body}</div>' if self.telling else f"<div>{body}</div>"
        if self.chance(0.08):
            # Some servers put all of a page into one form.
            body = self.rng.choice(['<form id="mainForm">{}</form>', "<form>{}</form>"]).format(body)
        if self.chance(0.05):
            return f"<html><body>{body}"
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 5)}</title></head><body>{body}</body></html>"
