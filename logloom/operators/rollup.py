"""Source families, folder roll-ups and run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.scalars import family_name

# Family markers searched in a source path, in order.
PARSER_FAMILIES = {
    "apache": ["apache", "httpd", "access.log", "error.log"],
    "audit": ["audit"],
    "auth": ["auth.log", "/auth", "\\auth", "sshd", "sudo"],
    "dns": ["dnsmasq", "dns"],
    "firewall": ["firewallexample", "firewallexamplae", "firewall", "防火墙"],
    "syslog": ["syslog", "messages", "kern.log"],
}
DISPLAY_FAMILIES = {
    "apache": ["apache", "httpd", "tomcat"],
    "openvpn": ["openvpn", "vpn"],
    "dns": ["dnsmasq", "dns"],
    "firewall": ["firewall", "firewallexamplae", "firewallexample", "防火墙"],
    "auth": ["auth.log", "/auth", "\\auth", "sshd", "sudo"],
    "audit": ["audit", "审计", "主审"],
    "syslog": ["syslog", "messages", "kern.log", "检测器", "防病毒", "入侵检测", "应用系统", "终端", "套件", "邮件", "oa"],
}


def _marked(text: Column, families: dict[str, list[str]]) -> Column:
    chain = None
    for family, markers in families.items():
        hit = F.lit(False)
        for marker in markers:
            hit = hit | text.contains(marker)
        chain = F.when(hit, family) if chain is None else chain.when(hit, family)
    return chain


def parser_family(source: Column) -> Column:
    """Family of a source; without a marker its normalised file stem."""
    stem = F.regexp_replace(F.substring_index(source, "/", -1), r"(?<=.)\.[^.]*$", "")
    return _marked(F.lower(source), PARSER_FAMILIES).otherwise(family_name(stem))


def display_family(source: Column) -> Column:
    """Family by the display markers; NULL without one."""
    return _marked(F.lower(F.replace(source, F.lit("\\"), F.lit("/"))), DISPLAY_FAMILIES)


def log_kind(path: Column, all_audit: Column) -> Column:
    """Sampling kind of a parsed table: by path, then whether every line is an audit line."""
    text = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return (
        F.when(text.contains("dnsmasq"), "dns")
        .when(text.contains("/auth/"), "auth")
        .when(text.contains("audit"), "audit")
        .when(all_audit, "audit")
        .otherwise("generic")
    )


def template_mode(path: Column) -> Column:
    text = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return F.when(text.contains("audit"), "audit").when(text.contains("/auth/"), "auth").otherwise("generic")


def is_firewall_name(source: Column) -> Column:
    text = F.lower(F.coalesce(source, F.lit("")))
    return text.contains("firewall") | text.contains("防火墙")


def is_firewall_output(source: Column, schema_type: Column) -> Column:
    """A stored family decides, unless the path names a firewall."""
    return (F.lower(F.trim(F.coalesce(schema_type, F.lit("")))) == "firewall") | is_firewall_name(source)


def folders(sources: DataFrame, ready: str = "ready") -> DataFrame:
    """Per folder: direct, total and ready sources, and its family.

    Every source contributes one row per ancestor folder, summed before the shuffle.
    """
    parts = F.slice(F.split("source", "/"), F.lit(1), F.greatest(F.size(F.split("source", "/")) - 1, F.lit(0)))
    depth = F.col("_d")
    rows = sources.select(F.col(ready).alias("_ready"), parts.alias("_parts")).select(
        "_ready", "_parts", F.explode(F.sequence(F.lit(1), F.greatest(F.size("_parts"), F.lit(1)))).alias("_d")
    ).filter(F.size("_parts") > 0)
    rows = rows.select(
        F.array_join(F.slice("_parts", F.lit(1), depth), "/").alias("folder"),
        (F.size("_parts") == depth).alias("_direct"),
        "_ready",
    )
    counted = rows.groupBy("folder").agg(
        F.sum(F.col("_direct").cast("long")).alias("direct_log_count"),
        F.count(F.lit(1)).alias("log_count"),
        F.sum(F.col("_ready").cast("long")).alias("ready_count"),
    )
    return counted.select(
        "folder",
        F.substring_index("folder", "/", -1).alias("label"),
        F.when(F.col("folder").contains("/"), F.regexp_replace("folder", "/[^/]*$", "")).otherwise("").alias("parent"),
        "direct_log_count", "log_count", "ready_count",
        F.coalesce(display_family(F.col("folder")), F.lit("")).alias("schema_type"),
    )


def export_status(sources: DataFrame) -> DataFrame:
    """Per source generated, skipped or failed with its reason.

    Columns parsed (BOOLEAN), schema_type, rows (params rows or NULL) and error.
    """
    status = (
        F.when(~F.col("parsed"), "skipped")
        .when(~is_firewall_output(F.col("source"), F.col("schema_type")), "skipped")
        .when(F.col("rows").isNull(), "skipped")
        .when(F.coalesce(F.col("error"), F.lit("")) != "", "failed")
        .otherwise("generated")
    )
    reason = (
        F.when(~F.col("parsed"), "no parsed output")
        .when(~is_firewall_output(F.col("source"), F.col("schema_type")), "not a firewall source")
        .when(F.col("rows").isNull(), "no result table")
        .otherwise(F.coalesce(F.col("error"), F.lit("")))
    )
    return sources.select("source", status.alias("status"), reason.alias("message"))


def status_counts(items: DataFrame, column: str = "status") -> DataFrame:
    return items.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def run_metrics(parsed: DataFrame) -> DataFrame:
    """Lines and templates per source, the countable part of a run summary."""
    return parsed.groupBy("source").agg(
        F.count(F.lit(1)).alias("lines"), F.count_distinct("event_id").alias("event_count")
    )


def latest_in_order(summary: DataFrame, order: DataFrame, key: str, position: str) -> DataFrame:
    """Last row per key, keys of the ordering table only, in its order."""
    rest = [c for c in summary.columns if c not in (key, position)]
    last = summary.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(position)).alias("_r")).select(key, "_r.*")
    return last.join(order.select(key, F.col("rank")), key).orderBy("rank").drop("rank")
