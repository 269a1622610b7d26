"""Line text: whitespace, leading and inline timestamps, masking, tokens, templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WILDCARD = "<*>"

# Whitespace characters of Unicode text.
WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The whitespace besides the blank.
OTHER_SPACE = r"[\t-\r\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SPACE = r"[\s\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# Timestamp layouts, in the order they are tried.
MONTHS = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
WEEKDAYS = "(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)"
LEADING_TIMES = (
    rf"^(\[{WEEKDAYS}\s+{MONTHS}\s+\d{{1,2}}\s+\d{{2}}:\d{{2}}:\d{{2}}(?:\.\d+)?\s+\d{{4}}\])\s*",
    r"^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z| ?[+-]\d{2}:?\d{2})?)\s*",
    rf"^({MONTHS}\s+\d{{1,2}}\s+\d{{2}}:\d{{2}}:\d{{2}})\s+",
)
INLINE_WEB_TIME = rf"\s*(\[\d{{1,2}}/{MONTHS}/\d{{4}}:\d{{2}}:\d{{2}}:\d{{2}}\s+[+-]\d{{4}}\])\s*"
INLINE_AUDIT_TIME = r"\bmsg=audit\((\d+(?:\.\d+)?:\d+)\):"

# Variable parts that are masked before clustering, in order.
MASKS = (
    r"(\d+\.){3}\d+(:\d+)?",
    r"(?U)\b\d{2}:\d{2}:\d{2}(?:\.\d+)?\b",
    r"(?U)\b[0-9a-fA-F]{8,}\b",
    r"(?U)/[^\s,]+",
    r"(?U)([\w-]++\.)+[\w-]+",
)
# What every text holds in which the mask of the same place is found; it is looked for in a fraction of the time.
MASK_SIGNS = (r"\d\.\d", ":", "[0-9a-fA-F]{8}", "/", r"\.[^\s.]")


def strip(col: Column) -> Column:
    return F.trim(col, F.lit(WHITESPACE))


def is_blank(col: Column) -> Column:
    return F.coalesce(strip(col) == "", F.lit(True))


def squeeze(col: Column) -> Column:
    return strip(F.regexp_replace(col, SPACE + "{2,}", " "))


def timestamp_parts(text: Column) -> Column:
    """Struct (timestamp, rest) of stripped text; NULL when no layout occurs.

    The first layout that occurs counts, and one occurrence of it is taken out.
    """
    branches = []
    for pattern in LEADING_TIMES:
        branches.append(
            (
                text.rlike(pattern),
                F.regexp_extract(text, pattern, 1),
                F.regexp_replace(text, pattern, ""),
            )
        )
    first_web = rf"(?s)^(.*?){INLINE_WEB_TIME}(.*)$"
    branches.append(
        (
            text.rlike(INLINE_WEB_TIME),
            F.regexp_extract(text, INLINE_WEB_TIME, 1),
            F.regexp_replace(text, first_web, "$1 $3"),
        )
    )
    first_audit = r"(?s)^(.*?)\bmsg=audit\(\d+(?:\.\d+)?:\d+\):(.*)$"
    branches.append(
        (
            text.rlike(INLINE_AUDIT_TIME),
            F.concat(F.lit("audit("), F.regexp_extract(text, INLINE_AUDIT_TIME, 1), F.lit(")")),
            F.regexp_replace(text, first_audit, "$1msg=audit:$2"),
        )
    )
    chain = None
    for hit, stamp, rest in branches:
        value = F.struct(stamp.alias("timestamp"), squeeze(rest).alias("rest"))
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain


def with_timestamp(lines: DataFrame, column: str) -> DataFrame:
    """Add timestamp ('' without one) and content; a line that is only a timestamp is kept whole."""
    rows = lines.withColumn("_t", strip(F.col(column))).withColumn("_s", timestamp_parts(F.col("_t")))
    rest = F.col("_s.rest")
    return rows.withColumns(
        {
            "timestamp": F.coalesce("_s.timestamp", F.lit("")),
            "content": F.when(F.coalesce(rest, F.lit("")) != "", rest).otherwise(F.col("_t")),
        }
    ).drop("_t", "_s")


def mask(content: Column) -> Column:
    for pattern in MASKS:
        content = F.regexp_replace(content, pattern, WILDCARD)
    return content


def with_mask(lines: DataFrame, column: str, out: str) -> DataFrame:
    """``mask`` of a column, step by step: a pattern runs only over texts that hold its sign."""
    lines = lines.withColumn(out, F.col(column))
    for pattern, sign in zip(MASKS, MASK_SIGNS):
        held = F.contains(out, F.lit(sign)) if len(sign) == 1 else F.rlike(out, F.lit(sign))
        lines = lines.withColumn(out, F.when(held, F.regexp_replace(out, pattern, WILDCARD)).otherwise(F.col(out)))
    return lines


def tokens(content: Column) -> Column:
    # Blanks alone are split at several times faster than a class of characters.
    blanks = F.when(F.rlike(content, F.lit(OTHER_SPACE)), F.regexp_replace(content, OTHER_SPACE, " ")).otherwise(content)
    return F.filter(F.split(blanks, " "), lambda t: t != "")


def has_digit(text: Column) -> Column:
    return text.rlike(r"\p{Nd}")


def event_id(template: Column) -> Column:
    return F.substring(F.md5(template.cast("binary")), 1, 8)


def word_count(text: Column) -> Column:
    """Blanks plus one, as the regex memory counts words."""
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1


# Stands between captured groups; three control characters that no log line has in a row.
GROUP_MARK = "\x01\x02\x03"


def captured(text: Column, pattern: str, count: int) -> Column:
    """Array of the first ``count`` groups of an anchored pattern; NULL without a match.

    The pattern is tested once and applied once, not once per group.
    """
    marked = F.regexp_replace(text, pattern, GROUP_MARK.join(f"${n}" for n in range(1, count + 1)))
    return F.when(text.rlike(pattern), F.split(marked, GROUP_MARK))
