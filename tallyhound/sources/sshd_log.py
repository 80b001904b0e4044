"""Events from the log of an SSH server: syslog lines or journal objects, one text column `value`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The event row: ts, kind, source, user, src_ip, src_port, pid, ses, fields.
EVENT = "ts timestamp, kind string, source string, user string, src_ip string, src_port int, pid int, ses int, fields map<string,string>"

#: The names under which the server logs, and those of a hook that declares an agent.
SERVERS, DECLARERS = ["sshd", "sshd-session", "sshd-auth"], ["ai-agent-declare"]
#: Each message with the first words that are tested before its pattern; kind; the groups of user, address
#: and port (0: none); constant fields; fields by group. A field whose group is empty is left out.
MESSAGES: list[tuple[str, str, str, tuple[int, int, int], dict[str, str], dict[str, int]]] = [
    ("Accepted ", r"^Accepted ([^\s/]+)(?:/(\S+))? for (\S+) from (\S+) port (\d+) ssh2(?:: (\S+) (\S+)(?: ID (.+) \(serial (\d+)\) CA (\S+) (\S+)|.*))?$", "ssh.auth_ok", (3, 4, 5), {}, {"method": 1, "submethod": 2, "keytype": 6, "fp": 7, "cert_id": 8, "cert_serial": 9, "ca_keytype": 10, "ca_fp": 11}),
    ("Failed ", r"^Failed ([^\s/]+)(?:/(\S+))? for (invalid user )?(\S+) from (\S+) port (\d+) ssh2(?:: (\S+) (\S+))?$", "ssh.auth_fail", (4, 5, 6), {"reason": "failed"}, {"method": 1, "submethod": 2, "invalid_user": 3, "keytype": 7, "fp": 8}),
    ("Invalid user ", r"^Invalid user (\S*) from (\S+) port (\d+)$", "ssh.auth_fail", (1, 2, 3), {"reason": "invalid_user", "invalid_user": "true"}, {}),
    ("Connection closed by ", r"^Connection closed by authenticating user (\S+) (\S+) port (\d+)$", "ssh.auth_fail", (1, 2, 3), {"reason": "closed_authenticating"}, {}),
    ("Connection closed by ", r"^Connection closed by invalid user (\S+) (\S+) port (\d+)$", "ssh.auth_fail", (1, 2, 3), {"reason": "closed_invalid", "invalid_user": "true"}, {}),
    ("Connection closed by ", r"^Connection closed by (\S+) port (\d+)$", "ssh.disconnect", (0, 1, 2), {"scope": "connection", "reason": "closed"}, {}),
    ("Connection reset by ", r"^Connection reset by (\S+) port (\d+)$", "ssh.disconnect", (0, 1, 2), {"scope": "connection", "reason": "reset"}, {}),
    ("Timeout before ", r"^Timeout before authentication for (\S+?)(?: port (\d+))?(?:, pid = (\d+))?$", "ssh.auth_fail", (0, 1, 2), {"reason": "timeout"}, {"child_pid": 3}),
    ("maximum auth", r"^maximum authentication attempts exceeded for (invalid user )?(\S+) from (\S+) port (\d+) ssh2$", "ssh.auth_fail", (2, 3, 4), {"reason": "max_attempts"}, {"invalid_user": 1}),
    ("PAM: ", r"^PAM: Authentication failure for (illegal user )?(\S+) from (\S+)$", "ssh.auth_fail", (2, 3, 0), {"reason": "pam"}, {"invalid_user": 1}),
    ("Starting session: ", r"^Starting session: (shell|command)(?: on (pts/\d+))? for (\S+) from (\S+) port (\d+) id (\d+)$", "ssh.session_start", (3, 4, 5), {}, {"stype": 1, "tty": 2, "chan": 6}),
    ("Starting session: ", r"^Starting session: subsystem '([^']*)'(?: on (pts/\d+))? for (\S+) from (\S+) port (\d+) id (\d+)$", "ssh.session_start", (3, 4, 5), {"stype": "subsystem"}, {"subsystem": 1, "tty": 2, "chan": 6}),
    ("Starting session: ", r"^Starting session: forced-command \((config|key-option)\) '(.*)'(?: on (pts/\d+))? for (\S+) from (\S+) port (\d+) id (\d+)$", "ssh.session_start", (4, 5, 6), {"stype": "forced-command"}, {"forced_by": 1, "cmd": 2, "tty": 3, "chan": 7}),
    ("Close session: ", r"^Close session: user (\S+) from (\S+) port (\d+) id (\d+)$", "ssh.disconnect", (1, 2, 3), {"scope": "channel"}, {"chan": 4}),
    ("Disconnected from ", r"^Disconnected from user (\S+) (\S+) port (\d+)$", "ssh.disconnect", (1, 2, 3), {"scope": "connection", "reason": "disconnected"}, {}),
    ("Disconnected from ", r"^Disconnected from authenticating user (\S+) (\S+) port (\d+)$", "ssh.auth_fail", (1, 2, 3), {"reason": "disconnected_authenticating"}, {}),
    ("Disconnected from ", r"^Disconnected from invalid user (\S+) (\S+) port (\d+)$", "ssh.auth_fail", (1, 2, 3), {"reason": "disconnected_invalid", "invalid_user": "true"}, {}),
    ("Disconnected from ", r"^Disconnected from (\S+) port (\d+)$", "ssh.disconnect", (0, 1, 2), {"scope": "connection", "reason": "disconnected"}, {}),
    ("Received disconnect ", r"^Received disconnect from (\S+) port (\d+):(\d+):(?: (.*))?$", "ssh.disconnect", (0, 1, 2), {"scope": "connection", "reason": "received_disconnect"}, {"code": 3, "text": 4}),
    ("User child ", r"^User child is on pid (\d+)$", "ssh.pam_open", (0, 0, 0), {"note": "user_child"}, {"child_pid": 1}),
    ("pam_unix(sshd:session): ", r"^pam_unix\(sshd:session\): session opened for user (\S+?)(?:\(uid=(\d+)\))? by (\S*)\(uid=(\d+)\)$", "ssh.pam_open", (1, 0, 0), {}, {"uid": 2, "by": 3, "by_uid": 4}),
    ("pam_unix(sshd:session): ", r"^pam_unix\(sshd:session\): session closed for user (\S+)$", "ssh.disconnect", (1, 0, 0), {"scope": "pam"}, {}),
    ("Remote protocol ", r"^Remote protocol version ([\d.]+), remote software version (.+?)\s*$", "ssh.banner", (0, 0, 0), {}, {"protocol": 1, "banner": 2}),
    ("Client protocol ", r"^Client protocol version ([\d.]+); client software version (.+?)\s*$", "ssh.banner", (0, 0, 0), {}, {"protocol": 1, "banner": 2}),
    ("Setting env ", r"^Setting env (\d+): ([A-Za-z_][A-Za-z0-9_]*)=(.*)$", "ssh.env", (0, 0, 0), {}, {"index": 1, "name": 2, "value": 3}),
    ("Ignoring env ", r"^Ignoring env request (\S+): (disallowed name|too many env vars)$", "ssh.env", (0, 0, 0), {"ignored": "true"}, {"name": 1, "reason": 2}),
]
#: What a hook says of an agent: its name and value, and the connection, of which the port must exist.
DECLARE = r"^AI_AGENT=([A-Za-z0-9._@:+-]{1,64}) user=([A-Za-z0-9_][A-Za-z0-9_.-]{0,31}\$?) from=([0-9A-Fa-f.:]{2,45}) port=(\d{1,5})$"


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is worked out once a row. A filter on a plain column is pushed below it, with the column's
    expression wherever the filter names it, so that patterns would run again for every test of what they gave."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def lines(logs: DataFrame, now: Column | None = None) -> DataFrame:
    """(ts, ident, pid, host, uid, msg) of each line that the server or a hook wrote. A year that a time lacks is this
    year, or the last one where that would be over a day ahead of now. Undated lines, other programs' and blank ones go."""
    now = F.current_timestamp() if now is None else now
    v = F.col("value")
    obj = F.from_json(v, "map<string,string>")
    at = lambda k: F.try_element_at(obj, F.lit(k))
    journal = logs.filter(v.startswith("{") & v.rlike(r'"MESSAGE"\s*:\s*"')).select(
        F.timestamp_micros(at("__REALTIME_TIMESTAMP").cast("long")).alias("ts"), at("SYSLOG_IDENTIFIER").alias("ident"), F.coalesce(at("SYSLOG_PID"), at("_PID")).cast("int").alias("pid"), at("_HOSTNAME").alias("host"), at("_UID").alias("uid"), at("MESSAGE").alias("msg")
    )
    iso = r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)) "
    short = r"^([A-Z][a-z]{2}) +(\d{1,2}) (\d\d:\d\d:\d\d) "
    named = F.concat_ws(" ", F.year(now).cast("string"), F.regexp_extract(v, short, 1), F.regexp_extract(v, short, 2), F.regexp_extract(v, short, 3))
    dated = F.try_to_timestamp(named, F.lit("yyyy MMM d HH:mm:ss"))
    dated = F.when(dated > now + F.expr("INTERVAL 24 HOURS"), F.add_months(dated.cast("date"), -12).cast("timestamp") + (dated - F.date_trunc("day", dated))).otherwise(dated)
    stamped = F.when(v.rlike(iso), F.try_to_timestamp(F.regexp_extract(v, iso, 1))).when(v.rlike(short), dated)
    rest = F.regexp_replace(v, f"(?:{iso})|(?:{short})", "")
    tag = r"^(\S+) ([A-Za-z0-9_.-]+)(?:\[(\d+)\])?: ?"
    dated_lines = once(logs.filter(~v.startswith("{")), "_line", F.struct(stamped.alias("ts"), rest.alias("rest"))).filter("_line.ts IS NOT NULL")
    tagged = F.regexp_replace("_line.rest", r"(?s)" + tag + "(.*)", "$1\n$2\n$3\n$4")  # the first three hold no blank
    part = lambda k: F.get(F.split("_tagged", "\n", 4), F.lit(k))
    syslog = once(dated_lines.filter(F.col("_line.rest").rlike(tag)), "_tagged", tagged).select(F.col("_line.ts").alias("ts"), part(1).alias("ident"), part(2).try_cast("int").alias("pid"), part(0).alias("host"), F.lit(None).cast("string").alias("uid"), part(3).alias("msg"))
    return journal.unionByName(syslog).filter(F.col("ident").isin(*SERVERS, *DECLARERS) & F.col("ts").isNotNull())


def classified(parsed: DataFrame) -> DataFrame:
    """Events of the lines whose message is known. The first words are tested before a pattern is tried."""
    msg = F.regexp_replace(F.regexp_replace(F.col("msg"), r"^(?:debug[123]|error|fatal): ", ""), r" \[(?:pre|post)auth\]$", "")
    df = once(parsed.filter(~F.col("msg").rlike(r"[\n\r]")), "_m", msg)
    m = F.col("_m")
    told = None
    for first, pattern, kind, place, fixed, groups in MESSAGES:
        # all that a pattern gives in one go; a message holds no line ends, so that these can part what it gives
        fields = [f"{k}\r{x}" for k, x in fixed.items()] + [f"{k}\r${g}" for k, g in groups.items()]
        layout = "\n".join([kind, *(f"${g}" if g else "" for g in place), *fields, ""])
        test = ~F.col("ident").isin(*DECLARERS) & m.startswith(first) & m.rlike(pattern)
        row = F.regexp_replace(m, pattern, layout)
        told = F.when(test, row) if told is None else told.when(test, row)
    df = once(df, "_told", told)
    parts = F.split("_told", "\n")
    read = F.str_to_map(F.array_join(F.slice(parts, 5, F.size(parts) - 5), "\n"), F.lit("\n"), F.lit("\r"))
    read = F.map_filter(read, lambda k, x: F.coalesce(x, F.lit("")) != "")
    read = F.transform_values(read, lambda k, x: F.when(k == "invalid_user", "true").otherwise(x))
    at = lambda k: F.get(parts, F.lit(k))
    event = F.when(F.col("_told").isNotNull(), F.struct(at(0).alias("kind"), at(1).alias("user"), at(2).alias("src_ip"), F.coalesce(F.nullif(at(3), F.lit("")).cast("int"), F.lit(0)).alias("src_port"), read.alias("fields")))
    said = lambda g: F.regexp_extract(m, DECLARE, g)
    fields = F.create_map(F.lit("name"), F.lit("AI_AGENT"), F.lit("value"), said(1), F.lit("via"), F.lit("sshrc"), F.lit("uid"), F.coalesce(F.col("uid"), F.lit("")))
    fields = F.map_filter(fields, lambda k, v: v != "")
    declared = F.col("ident").isin(*DECLARERS) & m.rlike(DECLARE) & F.nullif(said(4), F.lit("")).cast("int").between(1, 65535)
    event = event.when(declared, F.struct(F.lit("ssh.env").alias("kind"), said(2).alias("user"), said(3).alias("src_ip"), F.nullif(said(4), F.lit("")).cast("int").alias("src_port"), fields.alias("fields")))
    df = once(df, "_e", event).filter("_e IS NOT NULL")
    about = F.map_filter(F.create_map(F.lit("ident"), F.col("ident"), F.lit("host"), F.coalesce("host", F.lit(""))), lambda k, x: x != "")
    return df.select("ts", "_e.kind", F.lit("sshlog").alias("source"), "_e.user", "_e.src_ip", "_e.src_port", F.when(F.col("ident").isin(*DECLARERS), 0).otherwise(F.coalesce("pid", F.lit(0))).alias("pid"), F.lit(0).alias("ses"), F.map_concat(F.col("_e.fields"), about).alias("fields"))


def events(logs: DataFrame, now: Column | None = None) -> DataFrame:
    return classified(lines(logs, now))
