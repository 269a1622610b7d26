"""Scalar clean-up: null words, identities, first non-blank, names, times, addresses."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.text import strip

# Words that stand for a missing value.
NULL_WORDS = ["", "nan", "none", "null", "na", "n/a", "?", "unknown"]

# Event-time layouts, in the order they are tried.
EVENT_TIME_LAYOUTS = ["yyyy/M/d H:m:s", "yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s"]

HEX_GROUP = "[0-9A-Fa-f]{1,4}"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"(?:{OCTET}\.){{3}}{OCTET}"
MAC = r"^(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$"


def clean(value: Column) -> Column:
    """Trimmed text, or NULL for blanks and null words."""
    text = strip(value.cast("string"))
    return F.when(~F.lower(text).isin(NULL_WORDS), text)


def clean_lower(value: Column) -> Column:
    return F.lower(clean(value))


def whole_number(value: Column) -> Column:
    """``123.0`` as ``123``; other text unchanged."""
    return F.regexp_replace(value, r"^([+-]?\d+)\.0+$", "$1")


def first_filled(*values: Column) -> Column:
    """First value that is not blank, trimmed; '' when there is none."""
    trimmed = [strip(v.cast("string")) for v in values]
    return F.coalesce(*[F.when(t != "", t) for t in trimmed], F.lit(""))


def first_known(*values: Column) -> Column:
    """First value that is neither blank nor a null word; NULL when there is none."""
    return F.coalesce(*[clean(v) for v in values])


def fill(current: Column, value: Column) -> Column:
    """Keep a filled value as it is, otherwise take the trimmed replacement."""
    replacement = strip(F.coalesce(value.cast("string"), F.lit("")))
    kept = F.coalesce(current.cast("string"), F.lit(""))
    return F.when((strip(kept) == "") & (replacement != ""), replacement).otherwise(kept)


def snake_name(value: Column) -> Column:
    text = F.regexp_replace(strip(value), "[^a-zA-Z0-9]+", "_")
    return F.lower(F.trim(text, F.lit("_")))


def family_name(value: Column) -> Column:
    name = snake_name(value)
    return F.when(name == "", "generated_log").otherwise(name)


def known_names(listing: Column, known: Column) -> Column:
    """Comma list to its distinct known names in first-seen order, again as a comma list."""
    names = F.transform(F.split(listing, ","), snake_name)
    return F.array_join(
        F.array_distinct(F.filter(names, lambda n: (n != "") & F.array_contains(known, n))), ","
    )


def path_tag(relative: Column) -> Column:
    """Output tag of a source path; parts without ASCII letters or digits become a hash."""
    stem = F.regexp_replace(relative, r"(?<=[^/])\.[^./]+$", "")
    parts = F.filter(F.split(stem, "/"), lambda p: p != "")

    def one(part: Column) -> Column:
        name = F.trim(F.regexp_replace(part, "[^0-9A-Za-z]+", "_"), F.lit("_"))
        digest = F.concat(F.lit("u_"), F.substring(F.sha1(part.cast("binary")), 1, 10))
        return F.when(name == "", digest).otherwise(name)

    tag = F.array_join(F.transform(parts, one), "_")
    return F.when(tag == "", "ait").otherwise(tag)


def audit_time(stamp: Column) -> Column:
    """``audit(sec.frac:seq)`` as a UTC wall clock; other text unchanged."""
    text = strip(F.coalesce(stamp, F.lit("")))
    seconds = F.regexp_extract(text, r"^audit\(\s*([+-]?\d+(?:\.\d*)?)\s*:.*\)", 1)
    clock = F.date_format(
        F.timestamp_seconds(F.floor(seconds.try_cast("decimal(20,6)")).cast("long")),
        "yyyy-MM-dd HH:mm:ss",
    )
    return F.when(seconds != "", clock).otherwise(text)


def event_time(value: Column) -> Column:
    """Typed time of three text layouts; NULL (sorted last by the callers) otherwise."""
    text = strip(F.coalesce(value, F.lit("")))
    shape = text.rlike(r"^\d{4}([/-])\d{1,2}\1\d{1,2}[ T]\d{1,2}:\d{1,2}:\d{1,2}$")
    slashed, dashed, iso = (F.try_to_timestamp(text, F.lit(p)) for p in EVENT_TIME_LAYOUTS)
    parsed = F.when(text.contains("/"), slashed).when(text.contains("T"), iso).otherwise(dashed)
    return F.when(shape, parsed)


def iso_wall_clock(value: Column) -> Column:
    """ISO date-time as its own wall clock, no zone shift; other text unchanged."""
    text = F.coalesce(value, F.lit(""))
    shape = (
        r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2})?)(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2}(?::?\d{2})?)?)?$"
    )
    day = F.regexp_extract(text, shape, 1)
    clock = F.regexp_extract(text, shape, 2)
    clock = (
        F.when(clock == "", "00:00:00")
        .when(F.length(clock) == 5, F.concat(clock, F.lit(":00")))
        .otherwise(clock)
    )
    valid = F.concat_ws(" ", day, clock)
    real = F.try_to_timestamp(valid, F.lit("yyyy-MM-dd HH:mm:ss")).isNotNull()
    return F.when((day != "") & real, valid).otherwise(text)


def _netmasks() -> list[str]:
    masks = set()
    for bits in range(33):
        net = (0xFFFFFFFF << (32 - bits)) & 0xFFFFFFFF
        for value in (net, net ^ 0xFFFFFFFF):
            masks.add(".".join(str((value >> shift) & 255) for shift in (24, 16, 8, 0)))
    return sorted(masks)


def is_address(value: Column) -> Column:
    """``any``, an IPv4 or IPv6 address, or a network of either kind."""
    text = strip(value)
    slashed = text.contains("/")
    host = F.substring_index(text, "/", 1)
    prefix = F.regexp_extract(text, "/(.*)$", 1)
    v4 = host.rlike(f"^{IPV4}$")
    bits = F.when(prefix.rlike(r"^\d{1,4}$"), prefix.try_cast("int"))
    v4_prefix = F.coalesce(bits <= 32, F.lit(False)) | prefix.isin(_netmasks())
    plain = F.regexp_replace(host, "%[^%]+$", "")
    six = F.regexp_replace(plain, rf"(^|:){IPV4}$", "$1" + "0:0")
    groups = F.size(F.filter(F.split(six, ":"), lambda g: g != ""))
    full = six.rlike(rf"^(?:{HEX_GROUP}:){{7}}{HEX_GROUP}$")
    short = six.rlike(rf"^(?:{HEX_GROUP}(?::{HEX_GROUP})*)?::(?:{HEX_GROUP}(?::{HEX_GROUP})*)?$") & (groups <= 7)
    v6 = host.contains(":") & (full | short)
    v6_prefix = F.coalesce(bits <= 128, F.lit(False))
    other = (~slashed & (v4 | v6)) | (slashed & ((v4 & v4_prefix) | (v6 & v6_prefix)))
    # The common forms are settled first; the branches behind them are rarely evaluated.
    usual = text.rlike(rf"^(?i:any|{IPV4}(?:/(?:[0-9]|[12][0-9]|3[0-2]))?)$")
    return F.when(usual, True).when(~text.rlike("[:/]"), False).otherwise(other)


def is_mac(value: Column) -> Column:
    return value.rlike(MAC)


def label_of(value: Column, labels: Mapping[str, str], default: Column | None = None) -> Column:
    """Literal dictionary lookup; NULL or the default for other keys."""
    literal = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    found = F.try_element_at(literal, value)
    return found if default is None else F.coalesce(found, default)


def reversed_labels(labels: Mapping[str, str]) -> dict[str, str]:
    """Label to its first key."""
    back: dict[str, str] = {}
    for key, label in labels.items():
        back.setdefault(label, key)
    return back


def join_filled(separator: str, values: Iterable[Column]) -> Column:
    parts = [strip(F.coalesce(v.cast("string"), F.lit(""))) for v in values]
    return F.concat_ws(separator, *[F.when(p != "", p) for p in parts])
