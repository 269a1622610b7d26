"""Web access and error lines, and name-server lines, to params rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.scalars import audit_time
from logloom.functions.text import captured, strip
from logloom.operators.columns import DNS, WEB

# Line shapes.
ACCESS = r'^(\S+)\s+(\S+)\s+(\S+)\s+"([^"]*)"\s+(\S+)\s+(\S+)\s+"([^"]*)"\s+"([^"]*)"$'
REQUEST = r"^(\S+)\s+(\S+)\s+(\S+)$"
ERROR_LINE = r"(?s)^\[([^:\]]+):([^\]]+)\] \[pid (\d+)\] \[client ([^\]]+)\] (.*)$"
# Error messages in the order they are tried: pattern, group of the object,
# whether its quotes go, type, action, status, named groups, error function.
ERROR_SHAPES = [
    (r"^AH01630: client denied by server configuration: (.+)$", 1, False, "access_denied", "denied", "403", {"requested_resource": 1, "denied_path": 1}, ""),
    (r"^script (.+?) not found or unable to stat$", 1, True, "script_not_found", "not_found", "404", {"script": 1}, ""),
    (r"^AH00687: Negotiation: discovered file\(s\) matching request: (.+?) \(None could be negotiated\)\.?$", 1, False, "negotiation_error", "failed", "406", {"requested_file": 1}, ""),
    (r"^AH01276: Cannot serve directory (.+?): No matching DirectoryIndex \((.+?)\) found, and server-generated directory index forbidden by Options directive$", 1, False, "directory_index_forbidden", "denied", "403", {"directory": 1, "directory_index": 2, "directory_index_list": 2}, ""),
    (r"^PHP Fatal error: require\(\): Failed opening required (.+?) \(include_path='(.+?)'\) in (.+?) on line (\d+)$", 1, True, "php_error", "failed", "500", {"required_file": 1, "include_path": 2, "source_file": 3, "line_number": 4}, "require()"),
    (r"^PHP Fatal error: Uncaught Error: Call to undefined function ([^()]+)\(\) in (.+?):(\d+)\\nStack trace:\\n(#\d+ \{main\})\\n thrown in (.+?) on line (\d+)$", 2, False, "php_error", "failed", "500", {"undefined_function": 1, "error_file": 2, "error_line": 3, "stack_trace": 4, "thrown_file": 5, "thrown_line": 6}, ""),
    (r"^PHP Warning: Use of undefined constant (.+?) - assumed (.+?) \(this will throw an Error in a future version of PHP\) in (.+?) on line (\d+)$", 3, False, "php_error", "failed", "", {"undefined_constant": 1, "assumed_constant": 2, "error_file": 3, "error_line": 4}, ""),
    (r"^PHP Warning: scandir\(\): \(errno (\d+)\): No such file or directory in (.+?) on line (\d+)$", 2, False, "php_error", "failed", "", {"errno": 1, "file_path": 2, "line_number": 3}, ""),
    (r"^PHP Warning: (.+?) in (.+?) on line (\d+)$", 2, False, "php_error", "failed", "", {"warning_message": 1, "file_path": 2, "line_number": 3}, ""),
]
# Name-server answers that mean failure.
DNS_FAILURES = ["NXDOMAIN", "REFUSED", "SERVFAIL", "FORMERR", "NOTIMP"]
DNS_PREFIX = r"^dnsmasq\[([^\]]*)\]: "
DNS_QUERY = DNS_PREFIX + r"query\[([^\]]*)\] (.*?) from (.*)$"
DNS_FORWARD = DNS_PREFIX + r"forwarded (.*?) to (.*)$"
DNS_REPLY = DNS_PREFIX + r"reply (.*?) is (.*)$"
DNS_CACHED = DNS_PREFIX + r"cached (.*?) is (.*)$"
DNS_REFUSED = DNS_PREFIX + r"nameserver (\S+) refused to do a recursive query$"
DNS_NO_FILE = DNS_PREFIX + r"failed to access (.*?): (No such file or directory)$"


def blank_dash(text: Column) -> Column:
    return F.when(text == "-", "").otherwise(text)


def outcome_of_status(status: Column) -> Column:
    text = strip(status)
    code = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int"))
    return (
        F.when(code.isNull(), "")
        .when((code >= 200) & (code < 400), "success")
        .when((code >= 400) & (code < 600), "failure")
        .otherwise("unknown")
    )


def http_version(text: Column) -> Column:
    word = strip(text)
    return F.when((word == "") | word.startswith("HTTP/"), word).otherwise(F.concat(F.lit("HTTP/"), word))


def with_access_values(lines: DataFrame, out: str) -> DataFrame:
    """Add a map of every source field of access lines; '' where a line does not fit."""
    rows = lines.withColumn("_g", captured(strip(F.col("content")), ACCESS, 8))

    def part(column: str, n: int) -> Column:
        return F.coalesce(F.element_at(column, n), F.lit(""))

    client, user, request, status, size, referer, agent = (part("_g", n) for n in (1, 3, 4, 5, 6, 7, 8))
    rows = rows.withColumn("_r", captured(request, REQUEST, 3))
    method, target = part("_r", 1), blank_dash(part("_r", 2))
    path = F.substring_index(target, "?", 1)
    query = F.when(target.contains("?"), F.substr(target, F.instr(target, "?") + 1)).otherwise("")
    version = http_version(part("_r", 3))
    values = {
        "src_ip": client, "client_ip": client, "user": blank_dash(user), "request": request,
        "http_method": method, "request_method": method, "request_uri": target,
        "request_path": path, "http_path": path, "query_string": query, "request_query": query, "http_query": query,
        "http_version": version, "status_code": status, "response_size": size, "bytes_sent": size,
        "referer": blank_dash(referer), "user_agent": blank_dash(agent),
    }
    cells = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])
    return rows.withColumn(out, cells).drop("_g", "_r")


def access_params(
    lines: DataFrame, log_source: str = "", host: str = "", program: str = "", keep: list[str] = ()
) -> DataFrame:
    """Columns timestamp and content to web params; a per-template spec may fill more."""
    rows = with_access_values(lines, "_v")

    def v(name: str) -> Column:
        return F.try_element_at("_v", F.lit(name))

    timeout = (v("request") == "-") & (v("status_code") == "408")
    found = {
        "log": F.col("content"), "time": audit_time(F.col("timestamp")), "log_source": F.lit(log_source),
        "host": F.lit(host), "program": F.lit(program),
        "event_type": F.when(timeout, "request_timeout").otherwise("http_request"),
        "event_action": v("http_method"), "user": v("user"), "src_ip": v("src_ip"),
        "object_name": F.when(v("request_path") != "", v("request_path")).otherwise(v("request_uri")),
        "status_code": v("status_code"), "outcome": outcome_of_status(v("status_code")),
        "referer": v("referer"), "user_agent": v("user_agent"), "http_version": v("http_version"),
        "bytes_sent": v("bytes_sent"),
    }
    return rows.select(*keep, *[found.get(c, F.lit("")).alias(c) for c in WEB])


def endpoint(text: Column) -> Column:
    """Struct (ip, port) of ``ip:port``; the last colon separates, brackets included."""
    word = strip(text)
    has_port = word.contains(":")
    ip = F.when(has_port, F.regexp_replace(word, ":[^:]*$", "")).otherwise(word)
    port = F.when(has_port, F.substring_index(word, ":", -1)).otherwise("")
    return F.struct(ip.alias("ip"), port.alias("port"))


def unquoted(text: Column) -> Column:
    word = strip(text)
    return F.regexp_replace(word, r"""(?s)^(['"])(.*)\1$""", "$2")


def with_error_values(lines: DataFrame, out: str) -> DataFrame:
    """Add a map of the parsed fields of error lines; it is empty where the line does not fit.

    Built in steps, so that no pattern is evaluated twice and the generated code stays small.
    """
    text = strip(F.col("content"))
    rows = lines.withColumn("_e", captured(text, ERROR_LINE, 5))
    rest = F.coalesce(F.element_at("_e", 5), F.lit(""))
    rows = rows.withColumn("_cut", F.when(rest.contains(", referer: "), F.length(F.substring_index(rest, ", referer: ", -1))))
    rows = rows.withColumn(
        "_message",
        F.when(F.col("_cut").isNotNull(), F.substr(rest, F.lit(1), F.length(rest) - F.col("_cut") - 11)).otherwise(rest),
    ).withColumn("_referer", F.when(F.col("_cut").isNotNull(), strip(F.substring_index(rest, ", referer: ", -1))).otherwise(""))
    message = F.col("_message")
    kind = None
    for number, (pattern, *_) in enumerate(ERROR_SHAPES):
        hit = message.rlike(pattern)
        kind = F.when(hit, number) if kind is None else kind.when(hit, number)
    rows = rows.withColumn("_kind", kind)
    groups = None
    for number, (pattern, *_) in enumerate(ERROR_SHAPES):
        hit = F.col("_kind") == number
        count = re.compile(pattern).groups
        part = F.array(*[strip(F.regexp_extract(message, pattern, n)) for n in range(1, count + 1)])
        groups = F.when(hit, part) if groups is None else groups.when(hit, part)
    rows = rows.withColumn("_groups", groups).withColumn("_code", F.regexp_extract(message, r"^(AH\d+):", 1))
    shapes = None
    for number, (_, about, quoted, kind_name, action, status, fields, function) in enumerate(ERROR_SHAPES):
        def group(n: int) -> Column:
            return F.element_at("_groups", n)

        subject = unquoted(group(about)) if quoted else group(about)
        values = {name: (subject if n == about else group(n)) for name, n in fields.items()}
        values |= {
            "object_name": subject, "event_type": F.lit(kind_name), "event_action": F.lit(action),
            "status_code": F.lit(status), "error_code": values.get("errno", F.col("_code")),
        }
        if function:
            values["error_function"] = F.lit(function)
        elif "warning_message" in fields:
            values["error_function"] = F.when(values["warning_message"].startswith("require("), "require()").otherwise("")
        if status == "500":
            values["error_message"] = message
        part = F.create_map(*[x for k, c in values.items() for x in (F.lit(k), c)])
        hit = F.col("_kind") == number
        shapes = F.when(hit, part) if shapes is None else shapes.when(hit, part)
    rows = rows.withColumn("_shape", shapes.otherwise(F.create_map(F.lit("error_code"), F.col("_code"))))
    module, severity = F.element_at("_e", 1), F.element_at("_e", 2)
    php = module == "php7"
    both = F.concat(module, F.lit(":"), severity)
    fatal = php & (severity == "error") & message.startswith("PHP Fatal error:")
    end = endpoint(F.element_at("_e", 4))
    base = {
        "module": module, "severity": severity, "pid": F.element_at("_e", 3), "client": F.element_at("_e", 4), "program": module,
        "component": module, "log_level": severity, "referer": F.col("_referer"), "message": message,
        "src_ip": end["ip"], "src_port": end["port"], "log_component": both,
        "php7_error": F.when(php, both).otherwise(""),
        "negotiation_error": F.when(module == "negotiation", severity).otherwise(""),
        "autoindex_error": F.when(module == "autoindex", severity).otherwise(""),
        "error_type": F.when(fatal, "Fatal error").when(php & (severity == "warn"), "Warning").otherwise(""),
        "outcome": F.lit("failure"),
    }
    common = F.create_map(*[x for k, c in base.items() for x in (F.lit(k), c)])
    empty = F.create_map().cast("map<string,string>")
    found = F.when(F.col("_e").isNotNull(), F.map_concat(common, F.col("_shape"))).otherwise(empty)
    return rows.withColumn(out, found).drop("_e", "_cut", "_message", "_referer", "_kind", "_groups", "_code", "_shape")


def error_params(lines: DataFrame, log_source: str = "", host: str = "", keep: list[str] = ()) -> DataFrame:
    """Columns timestamp and content to web params, with a flag for lines that do not fit."""
    rows = with_error_values(lines, "_v")

    def v(name: str) -> Column:
        return F.coalesce(F.try_element_at("_v", F.lit(name)), F.lit(""))

    found = {
        "log": F.col("content"), "time": audit_time(F.col("timestamp")), "log_source": F.lit(log_source),
        "host": F.lit(host),
    }
    for name in (
        "program", "pid", "event_type", "event_action", "src_ip", "src_port", "object_name", "status_code",
        "outcome", "referer", "severity", "error_code",
    ):
        found[name] = v(name)
    return rows.select(
        *keep, *[found.get(c, F.lit("")).alias(c) for c in WEB], (F.size("_v") == 0).alias("quarantined")
    )


def dns_failure(answer: Column) -> Column:
    text = strip(answer)
    upper = F.upper(text)
    return F.when(upper.isin(DNS_FAILURES), upper).when(upper.startswith("NODATA"), text).otherwise("")


def dns_params(lines: DataFrame, log_source: str = "dns", keep: list[str] = ()) -> DataFrame:
    """Columns timestamp and content to name-server params; a cached answer is kept in qtype."""
    text = F.col("content")

    def group(pattern: str, n: int) -> Column:
        return F.regexp_extract(text, pattern, n)

    kind = (
        F.when(text.rlike(DNS_QUERY), "query")
        .when(text.rlike(DNS_FORWARD), "forwarded")
        .when(text.rlike(DNS_REPLY), "reply")
        .when(text.rlike(DNS_CACHED), "cached")
        .when(text.rlike(DNS_REFUSED), "nameserver_error")
        .when(text.rlike(DNS_NO_FILE), "file_access_error")
        .otherwise("")
    )
    rows = lines.withColumn("event_type", kind)
    event = F.col("event_type")
    answer = F.when(event == "reply", group(DNS_REPLY, 3)).when(event == "cached", group(DNS_CACHED, 3)).otherwise("")
    status = (
        F.when(event == "nameserver_error", "REFUSED")
        .when(event == "file_access_error", "FILE_ACCESS_ERROR")
        .otherwise(dns_failure(answer))
    )
    found = {
        "log": text,
        "time": audit_time(F.col("timestamp")),
        "log_source": F.lit(log_source),
        "program": F.lit("dnsmasq"),
        "pid": F.when(event != "", group(DNS_PREFIX, 1)).otherwise(""),
        "event_type": event,
        "qname": F.when(event == "query", group(DNS_QUERY, 3))
        .when(event == "forwarded", group(DNS_FORWARD, 2))
        .when(event == "reply", group(DNS_REPLY, 2))
        .when(event == "cached", group(DNS_CACHED, 2))
        .otherwise(""),
        "qtype": F.when(event == "query", group(DNS_QUERY, 2)).when(event == "cached", answer).otherwise(""),
        "src_ip": F.when(event == "query", group(DNS_QUERY, 4)).otherwise(""),
        "dst_ip": F.when(event == "forwarded", group(DNS_FORWARD, 3))
        .when(event == "nameserver_error", group(DNS_REFUSED, 2))
        .otherwise(""),
        "answer_kind": F.when(event == "reply", answer).otherwise(""),
        "status_code": status,
        "response_source": F.when(event.isin("forwarded", "nameserver_error"), "upstream")
        .when(event == "cached", "cache")
        .otherwise(""),
        "outcome": F.when(status != "", "failure").when(answer != "", "success").otherwise(""),
    }
    return rows.select(*keep, *[found.get(c, F.lit("")).alias(c) for c in DNS])
