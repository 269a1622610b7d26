"""Columns of the params tables, per family, in output order."""

FIREWALL = [
    "time", "device_name", "module", "event_type", "event_action", "user", "management_ip", "outcome",
    "src_addr", "dst_addr", "interface_in", "interface_out", "src_zone", "dst_zone", "service", "policy_id",
    "rule_id", "rule_key", "policy_type", "rule_state", "log_enabled", "translated_src", "public_ip",
    "internal_addr", "public_service", "internal_service", "zone_name", "blacklist_ip", "alarm_type", "src_ip",
    "src_mac", "src_owner", "src_department", "dst_ip", "dst_port", "protocol", "login_account", "login_time",
    "control_device_type", "control_name", "control_owner", "control_owner_department", "pcpolicy",
]
DNS = [
    "log", "time", "log_source", "host", "program", "pid", "event_type", "qname", "qtype", "src_ip", "dst_ip",
    "answer_kind", "status_code", "response_source", "outcome",
]
WEB = [
    "log", "time", "log_source", "host", "program", "pid", "event_type", "event_action", "user", "src_ip",
    "src_port", "object_name", "status_code", "outcome", "referer", "user_agent", "http_version", "bytes_sent",
    "severity", "error_code",
]
AUDIT = [
    "log", "time", "log_source", "host", "event_type", "event_id", "user", "auid", "uid", "session_id", "tty",
    "terminal", "src_ip", "src_hostname", "pid", "ppid", "process_exe", "process_name", "process_title",
    "command", "cwd", "syscall", "outcome",
]
AUTH = [
    "log", "time", "log_source", "host", "program", "pid", "event_type", "event_action", "user", "actor_user",
    "invoker_user", "target_user", "session_id", "tty", "cwd", "command", "src_ip", "src_port", "pam_service",
    "pam_action", "outcome",
]
VPN = [
    "log", "time", "log_source", "host", "program", "pid", "event_type", "event_action", "user", "session_id",
    "src_ip", "src_port", "virtual_ip", "peer_info_key", "peer_info_value", "tls_version", "cipher_suite",
    "hmac_alg", "control_message", "status_code", "bytes_in", "bytes_out", "pkts_in", "pkts_out", "outcome",
]
