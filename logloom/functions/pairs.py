"""key=value text as a map."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.text import strip

# Possessive: what one part takes no other part could, so nothing is given back and runs are read at once.
QUOTED = r""""(?:[^"\\]++|\\.)*+"|'[^']*+'"""
TOKEN = rf"""[^\s="']++=(?:{QUOTED}|[^\s"'\\]++|\\.)*+"""
LOOSE_TOKEN = r"""[A-Za-z_][A-Za-z0-9_]*=(?:"[^"]*"|\S*)"""


def pairs(text: Column) -> Column:
    """Shell-quoted ``key=value`` tokens; the last value of a key counts.

    Text with an open quote is read by a looser rule: a quoted value or one word.
    """
    text = F.coalesce(text, F.lit(""))
    leftover = F.regexp_replace(text, rf"{QUOTED}|\\.", "")
    broken = leftover.rlike(r"""["'\\]""")

    def key_of(token: Column) -> Column:
        return strip(F.substring_index(token, "=", 1))

    def raw_of(token: Column) -> Column:
        return F.substr(token, F.instr(token, "=") + 1)

    def quoted(token: Column) -> Column:
        raw = raw_of(token)
        plain = F.regexp_replace(raw, r""""((?:[^"\\]++|\\.)*+)"|'([^']*+)'""", "$1$2")
        plain = F.regexp_replace(plain, r"\\(.)", "$1")
        plain = F.when(raw.rlike(r"""["'\\]"""), plain).otherwise(raw)
        return F.struct(key_of(token).alias("key"), F.trim(strip(plain), F.lit('"')).alias("value"))

    def loose(token: Column) -> Column:
        return F.struct(key_of(token).alias("key"), F.trim(strip(raw_of(token)), F.lit('"')).alias("value"))

    return F.map_from_entries(
        F.when(broken, F.transform(F.regexp_extract_all(text, F.lit(LOOSE_TOKEN), F.lit(0)), loose)).otherwise(
            F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), quoted)
        )
    )


def value(mapping: Column | str, key: str) -> Column:
    return F.coalesce(F.try_element_at(mapping, F.lit(key)), F.lit(""))


def first_value(mapping: Column | str, *keys: str) -> Column:
    """First key with a non-empty value; '' when there is none."""
    found = [F.try_element_at(mapping, F.lit(k)) for k in keys]
    return F.coalesce(*[F.when(v != "", v) for v in found], F.lit(""))
