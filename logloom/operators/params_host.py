"""Authentication, audit and VPN lines to params rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.pairs import first_value, pairs, value
from logloom.functions.scalars import audit_time
from logloom.functions.text import captured, strip
from logloom.operators.columns import AUDIT, AUTH, VPN

AUTH_PREFIX = r"^(\S+) ([^\[:]+)(?:\[(\d+)\])?: "
EMBEDDED_PID = r"^([^\[]+)\[(\d+)\]$"
# Authentication messages in the order they are tried, with the columns their
# groups fill and the constant columns.
AUTH_SHAPES = [
    (r"pam_unix\(([^:)]*):?([^)]*)\): session opened for user (\S+) by (\S*?)\(uid=(\d+)\)", {"pam_service": 1, "pam_action": 2, "user": 3, "actor_user": 4}, {"event_type": "session", "event_action": "opened", "outcome": "success"}),
    (r"pam_unix\(([^:)]*):?([^)]*)\): session closed for user (\S+)", {"pam_service": 1, "pam_action": 2, "user": 3}, {"event_type": "session", "event_action": "closed", "outcome": "success"}),
    (r"Accepted (?:\S+) for (\S+) from (\S+) port (\d+)", {"user": 1, "src_ip": 2, "src_port": 3}, {"event_type": "ssh_login", "event_action": "accepted", "outcome": "success"}),
    (r"Did not receive identification string from (\S+) port (\d+)", {"src_ip": 1, "src_port": 2}, {"event_type": "ssh_probe", "event_action": "no_identification", "outcome": "failure"}),
    (r"\+ (/dev/\S+) ([^:\s]+):(\S+)", {"tty": 1, "actor_user": 2, "target_user": 3}, {"event_type": "su", "event_action": "switched", "outcome": "success"}),
    (r"Successful su for (\S+) by (\S+)", {"target_user": 1, "actor_user": 2}, {"event_type": "su", "event_action": "switched", "outcome": "success"}),
    (r"sudo(?:\[\d+\])?:\s+(\S+) : TTY=(\S+) ; PWD=(\S+) ; USER=(\S+) ; COMMAND=(.*)$", {"invoker_user": 1, "tty": 2, "cwd": 3, "target_user": 4, "command": 5}, {"event_type": "sudo", "event_action": "executed", "outcome": "success"}),
    (r"New session (\S+) of user ([^\s.]+)", {"session_id": 1, "user": 2}, {"event_type": "login_session", "event_action": "created", "outcome": "success"}),
    (r"Removed session ([^\s.]+)", {"session_id": 1}, {"event_type": "login_session", "event_action": "removed", "outcome": "success"}),
]
# Audit keys of each column, in order of preference.
AUDIT_KEYS = {
    "user": ["acct", "id"], "auid": ["auid"], "uid": ["uid"], "session_id": ["ses"], "tty": ["tty"],
    "terminal": ["terminal"], "src_ip": ["addr"], "src_hostname": ["hostname"], "pid": ["pid"], "ppid": ["ppid"],
    "process_exe": ["exe"], "process_name": ["comm"], "process_title": ["proctitle"], "command": ["cmd"],
    "cwd": ["cwd"], "syscall": ["syscall"], "outcome": ["res", "success"],
}
# VPN prefix and messages, in the order they are tried.
VPN_PREFIX = r"^(?:([^/\s:]+)/)?(\d+(?:\.\d+){3})(?::(\d+))? (.*)$"
VPN_SHAPES = [
    (r"^VERIFY OK: depth=(\d+),? (.*)$", {"control_message": 2}, {"event_type": "verify", "event_action": "certificate", "outcome": "success"}),
    (r"^VERIFY (\S+) OK$", {"control_message": 1}, {"event_type": "verify", "event_action": "extended_key_usage", "outcome": "success"}),
    (r"^Validating certificate extended key usage$", {}, {"event_type": "verify", "event_action": "validating"}),
    (r"^\+\+ Certificate has EKU \(str\) (.*?),? expects (.*)$", {"control_message": 1}, {"event_type": "verify", "event_action": "key_usage_matched"}),
    (r"^peer info: ([^=]+)=(.*)$", {"peer_info_key": 1, "peer_info_value": 2}, {"event_type": "peer_info", "event_action": "reported"}),
    (r"^SIGUSR1\[([^\],]*)[^\]]*\] received,? client-instance restarting$", {"control_message": 1}, {"event_type": "signal", "event_action": "restart"}),
    (r"^PUSH: Received control message: '(.*)'$", {"control_message": 1}, {"event_type": "push", "event_action": "received"}),
    (r"^SENT CONTROL \[([^\]]*)\]: '(.*)' \(status=(\d+)\)$", {"control_message": 2, "status_code": 3}, {"event_type": "push", "event_action": "sent"}),
    (r"^MULTI: Learn: (\S+) -> (\S+)$", {"virtual_ip": 1}, {"event_type": "multi_learn", "event_action": "learned"}),
    (r"^MULTI: primary virtual IP for \S+: (\S+)$", {"virtual_ip": 1}, {"event_type": "multi_virtual_ip", "event_action": "assigned"}),
    (r"^MULTI_sva: pool returned IPv4=([^,\s]+),? IPv6=(.*)$", {"virtual_ip": 1}, {"event_type": "multi_pool", "event_action": "returned"}),
    (r"^\[([^\]]*)\] Inactivity timeout \(--ping-restart\),? restarting$", {}, {"event_type": "timeout", "event_action": "restart"}),
    (r"^\[([^\]]*)\] Peer Connection Initiated with \[AF_INET\](\S+?)(?::(\d+))?$", {"user": 1}, {"event_type": "connection", "event_action": "initiated", "outcome": "success"}),
    (r"^TLS Error: (.*)$", {"control_message": 1}, {"event_type": "tls_error", "event_action": "failed", "outcome": "failure"}),
    (r"^TLS: soft reset sec=(\S+) bytes=([^/\s]+)(?:/(\S+))? pkts=([^/\s]+)(?:/(\S+))?$", {"bytes_in": 2, "bytes_out": 3, "pkts_in": 4, "pkts_out": 5}, {"event_type": "tls", "event_action": "soft_reset"}),
    (r"^TLS: move_session: (.*)$", {"control_message": 1}, {"event_type": "tls", "event_action": "move_session"}),
    (r"^TLS: Initial packet from \[AF_INET\](\S+?):?(\d*),? sid=(.*)$", {"session_id": 3}, {"event_type": "tls", "event_action": "initial_packet"}),
    (r"^(\S+) Data Channel: Cipher '([^']*)' initialized with (\d+) bit key$", {"cipher_suite": 2, "control_message": 1}, {"event_type": "data_channel", "event_action": "cipher"}),
    (r"^(\S+) Data Channel: Using (\d+) bit message hash '([^']*)' for HMAC authentication$", {"hmac_alg": 3, "control_message": 1}, {"event_type": "data_channel", "event_action": "hmac"}),
    (r"^Control Channel: (TLSv[\d.]+),? cipher (?:TLSv[\d.]+) (\S+?),? peer certificate: (\d+) bit RSA,? signature: (\S+)$", {"tls_version": 1, "cipher_suite": 2}, {"event_type": "control_channel", "event_action": "negotiated", "outcome": "success"}),
]


def _shaped(text: Column, shapes: list[tuple]) -> Column:
    """Map of the columns filled by the first shape that occurs in the text."""
    chain = None
    for pattern, groups, constants in shapes:
        cells = [x for name, n in groups.items() for x in (F.lit(name), F.regexp_extract(text, pattern, n))]
        cells += [x for name, fixed in constants.items() for x in (F.lit(name), F.lit(fixed))]
        hit = text.rlike(pattern)
        part = F.create_map(*cells)
        chain = F.when(hit, part) if chain is None else chain.when(hit, part)
    return chain.otherwise(F.create_map().cast("map<string,string>"))


def host_prefix(log: Column) -> Column:
    """Struct (host, program, pid) of ``host program[pid]: ``; blanks when it is absent."""
    text = strip(F.coalesce(log, F.lit("")))
    return F.struct(
        *[F.regexp_extract(text, AUTH_PREFIX, n).alias(c) for n, c in enumerate(("host", "program", "pid"), start=1)]
    )


def program_and_pid(program: Column, pid: Column) -> Column:
    """A pid written inside the program name is split off; a separate pid wins."""
    embedded = program.rlike(EMBEDDED_PID)
    return F.struct(
        F.when(embedded, F.regexp_extract(program, EMBEDDED_PID, 1)).otherwise(program).alias("program"),
        F.when(embedded & (pid == ""), F.regexp_extract(program, EMBEDDED_PID, 2)).otherwise(pid).alias("pid"),
    )


def auth_params(lines: DataFrame, log_source: str = "auth", keep: list[str] = ()) -> DataFrame:
    rows = lines.withColumn("_v", _shaped(F.col("content"), AUTH_SHAPES)).withColumn("_h", host_prefix(F.col("content")))
    rows = rows.withColumn("_pp", program_and_pid(strip(F.col("_h.program")), F.col("_h.pid")))
    found = {
        "log": F.col("content"), "time": audit_time(F.col("timestamp")), "log_source": F.lit(log_source),
        "host": F.col("_h.host"), "program": F.col("_pp.program"), "pid": F.col("_pp.pid"),
    }
    return rows.select(*keep, *[found.get(c, value("_v", c)).alias(c) for c in AUTH])


def audit_type(log: Column) -> Column:
    return F.regexp_extract(F.coalesce(log, F.lit("")), r"\btype=([A-Za-z0-9_]+)\b", 1)


def audit_params(lines: DataFrame, log_source: str = "audit", host: str = "", keep: list[str] = ()) -> DataFrame:
    """Columns timestamp, content, event_id; inner quoted pairs count like outer ones."""
    body = F.regexp_replace(F.col("content"), r"(?s)\bmsg='(.*)'\s*$", "$1")
    rows = lines.withColumn("_kv", pairs(body))
    found = {
        "log": F.col("content"), "time": audit_time(F.col("timestamp")), "log_source": F.lit(log_source),
        "host": F.lit(host), "event_type": audit_type(F.col("content")), "event_id": F.col("event_id"),
    }
    return rows.select(
        *keep,
        *[found.get(c, first_value("_kv", *AUDIT_KEYS.get(c, [c]))).alias(c) for c in AUDIT],
    )


def vpn_params(
    lines: DataFrame, log_source: str = "vpn", host: str = "", program: str = "openvpn", keep: list[str] = ()
) -> DataFrame:
    text = F.col("content")
    rows = lines.withColumn("_p", captured(text, VPN_PREFIX, 4))

    def part(n: int) -> Column:
        return F.coalesce(F.element_at("_p", n), F.lit(""))

    rows = rows.withColumn("_m", F.coalesce(F.element_at("_p", 4), text)).withColumn("_v", _shaped(F.col("_m"), VPN_SHAPES))
    named = part(1)
    found = {
        "log": text, "time": audit_time(F.col("timestamp")), "log_source": F.lit(log_source),
        "host": F.lit(host), "program": F.lit(program),
        "user": F.when(named != "", named).otherwise(value("_v", "user")),
        "src_ip": part(2), "src_port": part(3),
    }
    return rows.select(*keep, *[found.get(c, value("_v", c)).alias(c) for c in VPN])
