"""Secret scans: base patterns, and a lexer of assignments whose target names score the literals."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame

from logloom.llm.common import map_rows, map_texts, ready

# The base patterns of the contract.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_WORDS = ("passw", "secret", "token", "api_key", "apikey")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "pair")

# Weight of a word in a target's name; two-word names count as one word.
SENSITIVE = {
    "password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "token": 3, "apikey": 3, "api_key": 3,
    "private_key": 3, "access_key": 3, "credential": 3, "credentials": 3, "auth": 2, "bearer": 3, "signature": 2, "key": 1,
}
# A literal of several words with one of these is prose, such as a prompt; other such literals may be passphrases.
PROSE = re.compile(r"(?i)\b(?:the|an?|is|are|be|to|of|in|for|your|please|enter|must|not|password|passphrase|secret|token|key)\b|[.!?:,]$")
HARMLESS = re.compile(
    r"(?i)^(true|false|null|none|yes|no|string|str|example.*|changeme|placeholder|your[_-].*|x+|\*+|\d{1,7}|<.*>|\$\{.*\}|%\(.*\))$"
)
THRESHOLD = 5
TERM = r"""(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|[A-Za-z0-9_$][A-Za-z0-9+/_.@!$%^&*~-]*(?:={1,2}(?![^\s"',;)}\]]))?)"""
# A type between a name and its value, as in ``name: Optional[str] = value``.
TYPE = r"""[A-Za-z_][A-Za-z0-9_.]*(?:\[[^\n=]{0,100}\])?(?:[ \t]*\|[ \t]*[A-Za-z_][A-Za-z0-9_.]*)*"""
PAIR = re.compile(
    rf"""(?<![A-Za-z0-9_.])(?<![A-Za-z0-9_.]-)["']?([A-Za-z_][A-Za-z0-9_.-]*)["']?[ \t]*(?::=|=>|:[ \t]*({TYPE})[ \t]*=(?!=)|[:=](?!=))[ \t]*({TERM}(?:[ \t]*\+[ \t]*{TERM})*)"""
)
EACH_TERM = re.compile(TERM)
NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_score(name: str) -> int:
    """The highest weight among the words of a name and its neighbouring words joined."""
    parts = [p.lower() for p in NAME_PART.findall(name)]
    joined = [f"{a}_{b}" for a, b in zip(parts, parts[1:])]
    return max((SENSITIVE.get(p, 0) for p in [*parts, *joined]), default=0)


def points_of(counts: Counter) -> int:
    """A point each for being there, length, mixed letters and digits, and entropy."""
    size = sum(counts.values())
    entropy = -sum(n / size * math.log2(n / size) for n in counts.values())
    mixed = any(c.isdigit() for c in counts) and any(c.isalpha() for c in counts)
    return 1 + (size >= 12) + mixed + (entropy >= 3.0)


def literal_score(value: str) -> int:
    """0 for a harmless literal, else its points."""
    if len(value) < 6 or HARMLESS.match(value) or (" " in value.strip() and PROSE.search(value)):
        return 0
    return points_of(Counter(value))


# A literal joined beyond this length is known by its letters' counts alone; counts stop at the second number.
JOINED_LENGTH, MOST = 4096, 1 << 50


class Literal:
    """What an assignment binds: spans of its own, earlier literals that it joins, and its text or letters' counts.

    Parts are referred to, not copied: a name that is added to itself again and again costs a step each time.
    """

    __slots__ = ("text", "counts", "spans", "parts")

    def __init__(self, text: str, spans: list[tuple[int, int]]) -> None:
        self.text, self.counts, self.spans, self.parts = text, None, spans, []

    @classmethod
    def joined(cls, parts: list["Literal"]) -> "Literal":
        if len(parts) == 1:
            return parts[0]
        made = cls("", [])
        made.parts = parts
        if all(p.text is not None for p in parts) and sum(len(p.text) for p in parts) <= JOINED_LENGTH:
            made.text = "".join(p.text for p in parts)
            return made
        made.text, made.counts = None, Counter()
        for part in parts:
            for letter, n in (Counter(part.text) if part.text is not None else part.counts).items():
                made.counts[letter] = min(made.counts[letter] + n, MOST)
        return made

    def score(self) -> int:
        return points_of(self.counts) if self.text is None else literal_score(self.text)

    def collect(self, into: set[tuple[int, int]], seen: set[int]) -> None:
        """Add the spans of all parts; a part that was seen before adds nothing."""
        left = [self]
        while left:
            part = left.pop()
            if id(part) not in seen:
                seen.add(id(part))
                into.update(part.spans)
                left += part.parts


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    lower = text.lower()
    if any(word in lower for word in ASSIGN_WORDS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return found + [(*m.span(), "hex") for m in HEX.finditer(text)]


def pairs(text: str) -> list[tuple[str, Literal]]:
    """(target name, literal) of each assignment.

    A name on the right that an earlier assignment bound stands for that literal; parts joined by + are one.
    Every target directly before an operator has its own pair, also inside the right-hand side of another one,
    and the targets of a chain (a = b = literal) all get its literal.
    """
    bound: dict[str, Literal] = {}
    found, chain, right = [], [], None

    def close() -> None:
        for name in chain:
            bound[name] = bound[right[2]]
            found.append((name, bound[name]))
        chain.clear()

    match = PAIR.search(text)
    while match:
        if right and right[:2] == match.span(1):
            chain.append(right[2])
        elif chain:
            close()
        parts = []
        for term in EACH_TERM.finditer(text, match.start(3), match.end(3)):
            if term[0][0] in "\"'":
                parts.append(Literal(term[0][1:-1], [(term.start() + 1, term.end() - 1)]))
            else:
                parts.append(bound.get(term[0]) or Literal(term[0], [term.span()]))
        # What stands where a type may stand can be a value.
        if match[2] and any(c.isdigit() for c in match[2]):
            found.append((match[1], Literal(match[2], [match.span(2)])))
        bound[match[1]] = Literal.joined(parts)
        found.append((match[1], bound[match[1]]))
        right = (*match.span(3), match[1])
        match = PAIR.search(text, match.end(1))
    if chain:
        close()
    return found


def scan(text: str) -> list[tuple[int, int, str]]:
    """All spans of a text by start, then kind: the base ones, and literals whose pair scores enough."""
    found = base_spans(text)
    if "=" in text or ":" in text:
        extra, seen = set(), set()
        for name, literal in pairs(text):
            weight = name_score(name)
            if weight > 1 and (points := literal.score()) and weight + points >= THRESHOLD:
                literal.collect(extra, seen)
        found += [(*s, "pair") for s in extra if s[0] < s[1]]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts per base kind and all spans (kind:start:end in code points, end exclusive) of each whole text.

    A null or empty text has no spans. One row per input row; texts of any length are read whole, and other columns
    are not.
    """
    ready(docs.sparkSession)

    def work(texts):
        scanned = [scan(t) for t in texts]
        base = [[s for s in spans if s[2] != "pair"] for spans in scanned]
        counts = {f"n_{k}": [sum(s[2] == k for s in spans) for spans in base] for k in KINDS}
        counts["n_pair"] = [sum(s[2] == "pair" for s in spans) for spans in scanned]
        return counts | {
            "base_sha256": [hashlib.sha256(written(spans).encode()).hexdigest() for spans in base],
            "spans": [written(spans) for spans in scanned],
        }

    kinds = {f"n_{k}": "long" for k in KINDS} | {"base_sha256": "string", "spans": "string"}
    return map_texts(docs, kinds, lambda: work, id_col, text_col)


def masked(text: str, mask: str = "[SECRET]") -> str:
    """The text with each stretch covered by spans replaced by the mask."""
    parts, done = [], 0
    for start, end, _ in scan(text):
        if start >= done:
            parts += [text[done:start], mask]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def mask_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns, with the secrets of each text replaced by a mask; null stays null."""
    position = docs.columns.index(text_col)
    ready(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [t if t is None else masked(t) for t in batch.column(position).to_pylist()]
            columns = list(batch.columns)
            columns[position] = pa.array(texts, batch.schema[position].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_rows(docs, run)
