"""Query registry and log lines rendered from the given tables, in both SQL dialects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logloom.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where one exists, the SQL that gives the same rows."""

    def register(function: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(prepare(spark), sf_dir)

        run.__name__ = name
        run.__doc__ = function.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Rendered:
    """A projection of one table, written once and run by Spark and by the oracle."""

    def __init__(self, table_name: str, **columns: str) -> None:
        self.table_name, self.columns = table_name, columns

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        cells = [f"{text.format(**SPARK_FORMATS)} AS `{name}`" for name, text in self.columns.items()]
        return table(spark, sf_dir, self.table_name).selectExpr(*cells)

    @property
    def sql(self) -> str:
        cells = ", ".join(f'{text.format(**DUCK_FORMATS)} AS "{name}"' for name, text in self.columns.items())
        return f"SELECT {cells} FROM {self.table_name}"


# Time texts of the column ts in both dialects.
SPARK_FORMATS = {
    "iso": "date_format(ts, 'yyyy-MM-dd HH:mm:ss')",
    "slash": "date_format(ts, 'yyyy/MM/dd HH:mm:ss')",
    "sys": "date_format(ts, 'MMM dd HH:mm:ss')",
    "web": "date_format(ts, 'dd/MMM/yyyy:HH:mm:ss')",
    "long": "date_format(ts, 'EEE MMM dd HH:mm:ss.SSSSSS yyyy')",
    "epoch": "unix_timestamp(ts)",
    "day": "date_format(o_orderdate, 'yyyy/MM/dd')",
    "hour": "date_format(ts, 'yyyy/MM/dd HH')",
}
DUCK_FORMATS = {
    "iso": "strftime(ts, '%Y-%m-%d %H:%M:%S')",
    "slash": "strftime(ts, '%Y/%m/%d %H:%M:%S')",
    "sys": "strftime(ts, '%b %d %H:%M:%S')",
    "web": "strftime(ts, '%d/%b/%Y:%H:%M:%S')",
    "long": "strftime(ts, '%a %b %d %H:%M:%S.%f %Y')",
    "epoch": "cast(floor(epoch(ts)) as bigint)",
    "day": "strftime(o_orderdate, '%Y/%m/%d')",
    "hour": "strftime(ts, '%Y/%m/%d %H')",
}

K = "regexp_extract(props, '([0-9]+)', 1)"
V = "cast(floor(value) as bigint)"
Q = "chr(39)"

APP_LINES = Rendered(
    "events",
    source="concat('app/', event_type, '.log')",
    line_id="event_id",
    original_content=f"""CASE event_type
        WHEN 'view' THEN concat({{iso}}, ' web-01 app[', user_id, ']: GET /item/', {K}, ' took  ', {V}, ' ms')
        WHEN 'click' THEN concat({{sys}}, ' host-', user_id % 5, ' ui: click on button ', {K}, ' by user u', user_id)
        WHEN 'purchase' THEN concat('10.0.', user_id % 256, '.', {K}, ' - - [', {{web}}, ' +0000] "POST /buy/', {K}, ' HTTP/1.1" 200 ', {V})
        WHEN 'signup' THEN concat('type=USER_START msg=audit(', {{epoch}}, '.', 100 + event_id % 900, ':', event_id, '): pid=', user_id, ' uid=', {K}, ' res=success')
        ELSE concat('[', {{long}}, '] [php7:error] [pid ', user_id, '] [client 10.0.0.', {K}, ':', 1024 + {V}, '] script ', {Q}, '/x/', {K}, '.php', {Q}, ' not found or unable to stat')
        END""",
)

FIREWALL_LINES = Rendered(
    "orders",
    source="concat('firewall/fw', o_custkey % 3, '.log')",
    line_id="o_orderkey",
    timestamp="concat({day}, ' 00:00:00')",
    content=f"""concat('fw', o_custkey % 3, ' ', CASE WHEN o_orderkey % 6 < 3 THEN 'rule' ELSE 'auth' END, ': devid=0 date="',
        {{day}}, ' ', lpad(cast(o_orderkey % 24 as string), 2, '0'), ':', lpad(cast(o_orderkey % 60 as string), 2, '0'), ':', lpad(cast(o_custkey % 60 as string), 2, '0'),
        '" dname=', CASE WHEN o_custkey % 4 = 0 THEN 'Themis' ELSE concat('NATION_', o_custkey % 30) END,
        ' mod=', CASE o_orderkey % 6 WHEN 3 THEN 'webui' WHEN 4 THEN 'cli' WHEN 5 THEN '黑名单' ELSE '策略' END,
        ' act=', CASE o_orderkey % 7 WHEN 0 THEN 'add' WHEN 1 THEN '修改' WHEN 2 THEN 'set' WHEN 3 THEN 'del' WHEN 4 THEN 'login' WHEN 5 THEN '退出' ELSE 'show' END,
        ' user=u', o_custkey % 50, ' from=192.168.100.', o_custkey % 100,
        ' id=', CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE cast(o_custkey % 17 as string) END,
        ' policy=', CASE o_orderkey % 5 WHEN 0 THEN '50' WHEN 1 THEN '55' WHEN 2 THEN '59' WHEN 3 THEN '62' ELSE '' END,
        ' sa=', CASE o_orderkey % 4 WHEN 0 THEN 'any' WHEN 1 THEN concat('10.', o_custkey % 256, '.0.0/16') WHEN 2 THEN 'hosts' ELSE '""' END,
        ' da=', CASE o_orderkey % 3 WHEN 0 THEN 'any' WHEN 1 THEN '10.2.0.10' ELSE '""' END,
        ' active=', CASE o_orderkey % 2 WHEN 0 THEN 'on' ELSE 'disable' END, ' log=off',
        ' result=', CASE o_orderkey % 3 WHEN 0 THEN '0' WHEN 1 THEN '1' ELSE '' END,
        ' msg="', CASE o_orderkey % 6 WHEN 5 THEN concat('blacklist add 10.9.8.', o_custkey % 256) WHEN 1 THEN 'permit any 错误' ELSE concat('编辑 安全域名称 zone', o_custkey % 9, ' 接口集合 eth0,eth1') END, '"')""",
)

AUDIT_LINES = Rendered(
    "events",
    source="'host/audit.log'",
    line_id="event_id",
    event_id="concat('E', user_id % 4)",
    timestamp="concat('audit(', {epoch}, '.', 100 + event_id % 900, ':', event_id, ')')",
    content=f"""CASE event_type
        WHEN 'view' THEN concat('type=SYSCALL msg=audit: arch=c000003e syscall=', user_id % 300, ' success=yes exit=0 ppid=', user_id + 1, ' pid=', user_id, ' auid=', {K}, ' uid=0 tty=pts0 ses=', {K}, ' comm="app" exe="/sbin/app"')
        WHEN 'click' THEN concat('type=USER_CMD msg=audit: pid=', user_id, ' uid=', {K}, ' auid=', {K}, ' ses=3 msg=', {Q}, 'cwd="/home/u', user_id, '" cmd=6C73 terminal=pts/0 res=success', {Q})
        WHEN 'purchase' THEN concat('type=PROCTITLE msg=audit: proctitle=', {V})
        WHEN 'signup' THEN concat('type=LOGIN msg=audit: pid=', user_id, ' uid=0 old-auid=1 auid=', {K}, ' tty=(none) old-ses=2 ses=', {K}, ' res=1')
        ELSE concat('type=USER_LOGIN msg=audit: pid=', user_id, ' uid=0 auid=1 ses=', {K}, ' msg=', {Q}, 'op=login id=', {K}, ' exe="/usr/sbin/sshd" hostname=10.0.0.', {K}, ' addr=10.0.0.', {K}, ' terminal=ssh res=failed', {Q})
        END""",
)

AUTH_LINES = Rendered(
    "events",
    source="'host/auth/auth.log'",
    line_id="event_id",
    timestamp="{sys}",
    content=f"""CASE event_type
        WHEN 'view' THEN concat('srv', user_id % 3, ' sshd[', user_id, ']: Accepted publickey for u', user_id, ' from 10.1.0.', {K}, ' port ', 40000 + {V}, ' ssh2: RSA SHA256:x')
        WHEN 'click' THEN concat('srv', user_id % 3, ' su[', user_id, ']: pam_unix(su:session): session opened for user root by u', user_id, '(uid=', {K}, ')')
        WHEN 'purchase' THEN concat('srv', user_id % 3, ' sudo: u', user_id, ' : TTY=pts/', {K}, ' ; PWD=/home/u', user_id, ' ; USER=root ; COMMAND=/bin/cat /etc/', {V})
        WHEN 'signup' THEN concat('srv', user_id % 3, ' systemd-logind[1011]: New session ', event_id, ' of user u', user_id, '.')
        ELSE concat('srv', user_id % 3, ' su[', user_id, ']: Successful su for root by u', user_id)
        END""",
)

VPN_LINES = Rendered(
    "events",
    source="'vpn/openvpn.log'",
    line_id="event_id",
    timestamp="{iso}",
    content=f"""CASE event_type
        WHEN 'view' THEN concat('u', user_id, '/192.168.', user_id % 256, '.', {K}, ':', 1024 + user_id % 60000, ' peer info: IV_VER=2.', {K})
        WHEN 'click' THEN concat('192.168.', user_id % 256, '.', {K}, ':', 1024 + user_id % 60000, ' VERIFY OK: depth=1, CN=u', user_id)
        WHEN 'purchase' THEN concat('u', user_id, '/192.168.', user_id % 256, '.', {K}, ':', 1024 + user_id % 60000, ' MULTI: Learn: 10.9.0.', {K}, ' -> u', user_id, '/192.168.1.1:5')
        WHEN 'signup' THEN concat('u', user_id, '/192.168.', user_id % 256, '.', {K}, ':', 1024 + user_id % 60000, ' TLS: soft reset sec=0 bytes=', {V}, '/-1 pkts=', {K}, '/0')
        ELSE concat('192.168.', user_id % 256, '.', {K}, ':', 1024 + user_id % 60000, ' TLS Error: TLS handshake failed')
        END""",
)

DNS_LINES = Rendered(
    "events",
    source="'net/dnsmasq.log'",
    line_id="event_id",
    timestamp="{sys}",
    content=f"""CASE event_type
        WHEN 'view' THEN concat('dnsmasq[', user_id, ']: query[', CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'AAAA' END, '] n', {K}, '.example.org from 10.35.35.', user_id % 256)
        WHEN 'click' THEN concat('dnsmasq[', user_id, ']: forwarded n', {K}, '.example.org to 192.168.255.', user_id % 256)
        WHEN 'purchase' THEN concat('dnsmasq[', user_id, ']: reply n', {K}, '.example.org is ', CASE user_id % 3 WHEN 0 THEN 'NXDOMAIN' WHEN 1 THEN 'NODATA-IPv6' ELSE concat('10.3.0.', {K}) END)
        WHEN 'signup' THEN concat('dnsmasq[', user_id, ']: cached n', {K}, '.example.org is ', CASE user_id % 3 WHEN 0 THEN 'servfail' ELSE concat('10.4.0.', {K}) END)
        ELSE concat('dnsmasq[', user_id, ']: nameserver 127.0.0.', {K}, ' refused to do a recursive query')
        END""",
)

PATH = "regexp_extract(url, 'https?://[^/]+([^#]*)', 1)"
SITE = "regexp_extract(url, 'https?://([^/]+)', 1)"
WEB_LINES = Rendered(
    "pages",
    source=f"concat('apache2/', {SITE}, '/access.log')",
    line_id="page_id",
    timestamp="concat('[01/Jan/2024:00:00:', lpad(cast(page_id % 60 as string), 2, '0'), ' +0000]')",
    content=f"""CASE WHEN page_id % 17 = 0 THEN concat('10.7.0.', page_id % 256, ' - - "-" 408 0 "-" "-"')
        ELSE concat('10.7.0.', page_id % 256, ' - ', CASE WHEN page_id % 5 = 0 THEN concat('u', page_id % 40) ELSE '-' END, ' "', CASE WHEN page_id % 4 = 0 THEN 'POST' ELSE 'GET' END,
        ' ', {PATH}, ' HTTP/1.1" ', 200 + 100 * (page_id % 4), ' ', length(html), ' "', CASE WHEN page_id % 3 = 0 THEN '-' ELSE url END, '" "Mozilla/5.0 (', {SITE}, ')"') END""",
)

WEB_ERRORS = Rendered(
    "pages",
    source=f"concat('apache2/', {SITE}, '/error.log')",
    line_id="page_id",
    timestamp="''",
    content=f"""concat(CASE page_id % 7 WHEN 0 THEN '[authz_core:error]' WHEN 1 THEN '[php7:error]' WHEN 2 THEN '[negotiation:error]' WHEN 3 THEN '[autoindex:error]' WHEN 4 THEN '[php7:error]' WHEN 5 THEN '[php7:warn]' ELSE 'broken' END,
        ' [pid ', page_id, '] [client 10.8.0.', page_id % 256, ':', 1000 + page_id % 50000, '] ',
        CASE page_id % 7
        WHEN 0 THEN concat('AH01630: client denied by server configuration: /var/www', {PATH})
        WHEN 1 THEN concat('script ', {Q}, '/var/www', {PATH}, {Q}, ' not found or unable to stat')
        WHEN 2 THEN concat('AH00687: Negotiation: discovered file(s) matching request: /var/www', {PATH}, ' (None could be negotiated).')
        WHEN 3 THEN concat('AH01276: Cannot serve directory /var/www', {PATH}, ': No matching DirectoryIndex (index.html,index.php) found, and server-generated directory index forbidden by Options directive')
        WHEN 4 THEN concat('PHP Fatal error: require(): Failed opening required ', {Q}, {PATH}, {Q}, ' (include_path=', {Q}, '.:/usr/share/php', {Q}, ') in /srv/a.php on line ', page_id)
        WHEN 5 THEN concat('PHP Warning: scandir(): (errno ', page_id % 99, '): No such file or directory in /srv', {PATH}, ' on line ', page_id)
        ELSE 'nothing' END,
        CASE WHEN page_id % 2 = 0 THEN concat(', referer: ', url) ELSE '' END)""",
)


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document: source, line_id, original_content."""
    docs = table(spark, sf_dir, "documents")
    cells = "doc_id", "source", "posexplode(split(text, chr(10))) AS (pos, original_content)"
    return docs.selectExpr(*cells).selectExpr("source", "doc_id * 4294967296 + pos AS line_id", "original_content")


TEXT_LINES = """SELECT source, doc_id * 4294967296 + pos - 1 AS line_id, original_content
    FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS original_content,
                 generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)"""

# Oracle fragments.
BLANKS = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288) || chr(28) || chr(29) || chr(30) || chr(31)"
SQL_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_strip(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def sql_null(x: str) -> str:
    """Trimmed value, NULL for null words."""
    return (
        f"CASE WHEN lower({sql_strip(x)}) IN ('','nan','none','null','na','n/a','?','unknown') "
        f"THEN NULL ELSE {sql_strip(x)} END"
    )


def sql_squeeze(x: str) -> str:
    return sql_strip(f"regexp_replace({x}, '{SQL_SPACE}{{2,}}', ' ', 'g')")


MON = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
DAY = "(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)"
SQL_LEADING = [
    rf"^(\[{DAY}\s+{MON}\s+\d{{1,2}}\s+\d{{2}}:\d{{2}}:\d{{2}}(?:\.\d+)?\s+\d{{4}}\])\s*",
    r"^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z| ?[+-]\d{2}:?\d{2})?)\s*",
    rf"^({MON}\s+\d{{1,2}}\s+\d{{2}}:\d{{2}}:\d{{2}})\s+",
]
SQL_WEB = rf"\s*(\[\d{{1,2}}/{MON}/\d{{4}}:\d{{2}}:\d{{2}}:\d{{2}}\s+[+-]\d{{4}}\])\s*"
SQL_AUDIT = r"\bmsg=audit\((\d+(?:\.\d+)?:\d+)\):"


def sql_preprocessed(lines: str, extra: str = "") -> str:
    """Lines with timestamp and content split, blank lines dropped."""
    stamp = "CASE " + " ".join(
        f"WHEN regexp_matches(t, '{p}') THEN regexp_extract(t, '{p}', 1)" for p in [*SQL_LEADING, SQL_WEB]
    ) + f" WHEN regexp_matches(t, '{SQL_AUDIT}') THEN 'audit(' || regexp_extract(t, '{SQL_AUDIT}', 1) || ')' ELSE '' END"
    rest = "CASE " + " ".join(
        f"WHEN regexp_matches(t, '{p}') THEN {sql_squeeze(f'''regexp_replace(t, '{p}', '')''')}" for p in SQL_LEADING
    ) + (
        f" WHEN regexp_matches(t, '{SQL_WEB}') THEN {sql_squeeze(f'''regexp_replace(t, '{SQL_WEB}', ' ')''')}"
        f" WHEN regexp_matches(t, '{SQL_AUDIT}') THEN {sql_squeeze(f'''regexp_replace(t, '{SQL_AUDIT}', 'msg=audit:')''')} ELSE t END"
    )
    return f"""SELECT source, line_id{extra}, "timestamp", CASE WHEN c = '' THEN t ELSE c END AS content, original_content
        FROM (SELECT *, {stamp} AS "timestamp", {rest} AS c FROM (SELECT *, {sql_strip('original_content')} AS t FROM ({lines})) WHERE t <> '')"""


def sql_mask(x: str) -> str:
    for p in (
        r"(\d+\.){3}\d+(:\d+)?",
        r"\b\d{2}:\d{2}:\d{2}(?:\.\d+)?\b",
        r"\b[0-9a-fA-F]{8,}\b",
        rf"/[^\s\x{{85}}\x{{a0}},]+",
        r"([\p{L}\p{N}\p{M}_-]+\.)+[\p{L}\p{N}\p{M}_-]+",
    ):
        x = f"regexp_replace({x}, '{p}', '<*>', 'g')"
    return x


def sql_tokens(x: str) -> str:
    return f"[w for w in regexp_split_to_array({x}, '{SQL_SPACE}+') if w <> '']"


def sql_routed(preprocessed: str) -> str:
    """tokens, n_tokens and the routing token of preprocessed lines."""
    return f"""SELECT *, cast(len(tokens) AS INTEGER) AS n_tokens,
        CASE WHEN regexp_matches(tokens[1], '\\p{{Nd}}') THEN '<*>' ELSE coalesce(tokens[1], '') END AS route
        FROM (SELECT *, {sql_tokens(sql_mask('content'))} AS tokens FROM ({preprocessed}))"""


def sql_templates(routed: str, keys: str = "source, n_tokens, route") -> str:
    """Template per key: a token stays where every line has it."""
    using = keys
    return f"""SELECT {keys}, template, substr(md5(template), 1, 8) AS event_id, n AS "count", first_line
        FROM (SELECT {keys}, string_agg(CASE WHEN lo = hi AND c = n THEN lo ELSE '<*>' END, ' ' ORDER BY pos) AS template,
                     any_value(n) AS n, any_value(first_line) AS first_line
              FROM (SELECT {keys}, pos, min(tok) AS lo, max(tok) AS hi, count(*) AS c
                    FROM (SELECT {keys}, unnest(tokens) AS tok, generate_subscripts(tokens, 1) AS pos FROM ({routed}))
                    GROUP BY {keys}, pos)
              JOIN (SELECT {keys}, count(*) AS n, min(line_id) AS first_line FROM ({routed}) GROUP BY {keys}) USING ({using})
              GROUP BY {keys})"""
