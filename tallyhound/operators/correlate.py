"""From events to sessions: connections, who runs a command, and what each session did.

The events are joined by equality and by as-of windows, not applied one by one, and always within one host: (1) an event
that knows only its process gets the address and port of its connection; process numbers and ports may be used again once
a connection has closed. (2) A connection's user and key are those of its log-in; what a hook declares for it counts only
while it is open, for its own user, and from a sender that is that user where this is known. (3) Commands, processes and
network connections go to a session by their audit session, by a parent process that is the connection's or a known one,
or, failing these, to the user's latest session. A late identity holds for the whole connection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhound.functions.text import declared, sanitised, shell_command
from tallyhound.operators.joins import as_of, closure
from tallyhound.operators.sessions import sessionised
from tallyhound.sources.tables import stored

#: Commands that start a session's own plumbing; they and their children are no one's commands.
PLUMBING = [
    r"^(?:/bin/)?sh -c /bin/sh (?:/etc/ssh/sshrc|\.ssh/rc)$", r"^/bin/sh (?:/etc/ssh/sshrc|\.ssh/rc)$", r"run-parts --lsbsysinit /etc/update-motd\.d", r"^(?:/usr)?/lib/systemd/systemd --user", r"^(?:/usr)?/lib/systemd/user-environment-generators/",
    r"^(?:/usr)?/bin/systemctl --user (?:set-environment|import-environment|unset-environment)", r"^(?:/usr/lib/update-notifier/update-motd-|/usr/bin/landscape-sysinfo)", r"^logger -p authpriv\.info -t ai-agent-declare ", r"^tr -cd A-Za-z0-9\._@:\+-$", r"^xauth -q -$",
]
WINDOW = 15 * 60 * 1_000_000
#: Fixed value: bytes of a client's banner that are kept.
BANNER_CAP = 256
KEY = ["host", "user", "fp", "src_ip"]


def value(key: str) -> Column:
    return F.coalesce(F.try_element_at("fields", F.lit(key)), F.lit(""))


def number(key: str) -> Column:
    return F.coalesce(value(key).try_cast("int"), F.lit(0))


def prepared(events: DataFrame) -> DataFrame:
    """events with us and seq, empty texts for nulls; those of several machines are told apart by a column host."""
    e = events.withColumn("us", F.unix_micros("ts"))
    if "seq" not in e.columns:
        e = e.withColumn("seq", F.monotonically_increasing_id())
    if "host" not in e.columns:
        e = e.withColumn("host", F.lit(""))
    texts = {c: F.coalesce(F.col(c), F.lit("")) for c in ("host", "user", "src_ip", "source")}
    numbers = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("src_port", "pid", "ses")}
    return e.withColumns(texts | numbers).withColumn("fields", F.coalesce("fields", F.create_map().cast("map<string,string>")))


def looked_up(rows: DataFrame, known: DataFrame, *, key: list[str], take: str, where: Column) -> DataFrame:
    """rows with the latest `take` of known at or before each, by key; null for rows outside `where`, which are not shuffled."""
    rows = rows.withColumn("_asked", F.coalesce(where, F.lit(False)))
    found = as_of(rows.filter("_asked"), known, key=key, take=take)
    rest = rows.filter("NOT _asked").withColumn(take, F.lit(None).cast(known.schema[take].dataType))
    return found.select(*rest.columns).unionByName(rest).drop("_asked")


def owners_of_uids(e: DataFrame) -> DataFrame:
    """(host, uid, us, seq, uid_user): what log-ins and processes tell of whose number is whose."""
    said = F.col("kind").isin("ssh.pam_open", "proc.seen") & (value("uid") != "") & (F.col("user") != "")
    return e.filter(said).select("host", value("uid").alias("uid"), "us", "seq", F.col("user").alias("uid_user"))


def latest(what: Column, when: Column) -> Column:
    return F.max_by(F.when(when, what), F.when(when, F.struct("us", "seq")))


def closes() -> Column:
    return (F.col("kind") == "ssh.disconnect") & (value("scope") != "channel")


def command_channel() -> Column:
    return (F.col("kind") == "ssh.session_start") & value("stype").isin("command", "forced-command")


def shell_channel() -> Column:
    return (F.col("kind") == "ssh.session_start") & (value("stype") == "shell")


def banner_text() -> Column:
    return sanitised(value("banner"), BANNER_CAP)


def said_here() -> Column:
    """What an event declares for its connection, null where it declares nothing that counts."""
    name = declared(value("value"))
    return F.when((F.col("kind") == "ssh.env") & (value("name") == "AI_AGENT") & ~name.isin("", "invalid-declaration"), name)


def connection_state() -> list[Column]:
    """What a connection's own events tell of it, as aggregates."""
    return [
        F.min("opened").alias("opened"), F.min(F.when(closes(), F.col("us"))).alias("closed"), F.count_if(command_channel()).alias("exec_count"), F.count_if(shell_channel()).alias("shell_count"),
        F.count_if(command_channel() & (value("tty") != "")).alias("pty_exec_count"), F.min(F.when(shell_channel(), F.col("us"))).alias("pty_opened"), latest(banner_text(), F.col("kind") == "ssh.banner").alias("banner"),
        latest(said_here(), said_here().isNotNull()).alias("declared"),
    ]


def connections(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ssh events with the connection they belong to, connections)."""
    hooked = (F.col("kind") == "ssh.env") & (value("via") == "sshrc")  # anyone on the host can write such a line
    ssh = e.filter(F.col("kind").startswith("ssh.") & (F.col("kind") != "ssh.auth_fail") & ~hooked)
    pair = F.when((F.col("src_ip") != "") & (F.col("src_port") > 0), F.concat_ws("|", "host", "src_ip", F.col("src_port").cast("string")))
    ssh = ssh.withColumn("_pair", pair).withColumn("_closes", closes().cast("int"))
    notes = ssh.filter((value("note") == "user_child") & (number("child_pid") > 0)).select("host", number("child_pid").alias("pid"), "us", "seq", F.col("pid").alias("_parent"))
    ssh = looked_up(ssh, notes, key=["host", "pid"], take="_parent", where=F.col("pid") > 0).withColumn("_pid", F.coalesce("_parent", "pid")).drop("_parent")

    # a process number stands for one connection until that closes
    alone, own = ssh.filter("_pid = 0"), ssh.filter("_pid > 0")
    order = Window.partitionBy("host", "_pid").orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("_life", F.coalesce(F.sum("_closes").over(order), F.lit(0)))
    near = Window.partitionBy("host", "_pid", "_life").orderBy("us", "seq")
    back = F.last("_pair", True).over(near.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("_pair", True).over(near.rowsBetween(0, Window.unboundedFollowing))
    ssh = own.withColumn("_pair", F.coalesce("_pair", back, ahead)).drop("_life").unionByName(alone).filter("_pair IS NOT NULL")
    before = Window.partitionBy("_pair").orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, -1)
    ssh = ssh.withColumn("_use", F.coalesce(F.sum("_closes").over(before), F.lit(0))).withColumn("conn", F.concat_ws("#", "_pair", F.col("_use").cast("string")))

    logged_in, said = F.col("kind") == "ssh.auth_ok", declared(value("value"))
    per = ssh.groupBy("conn", "_pair", "host").agg(
        F.coalesce(latest(F.col("user"), logged_in & (F.col("user") != "")), latest(F.col("user"), F.col("user") != ""), F.lit("")).alias("user"), F.coalesce(latest(value("fp"), logged_in & (value("fp") != "")), F.lit("-")).alias("fp"),
        F.coalesce(latest(F.col("src_ip"), F.col("src_ip") != ""), F.lit("")).alias("src_ip"), F.coalesce(F.max(F.when(logged_in, F.col("_pid"))), F.max("_pid")).alias("pid"), F.max(F.when(value("note") == "user_child", number("child_pid"))).alias("child"),
        F.min("us").alias("opened"), F.min(F.when(F.col("_closes") == 1, F.col("us"))).alias("closed"), F.count_if(F.col("_closes") == 0).alias("_open"),
    ).filter("user <> '' AND _open > 0").drop("_open")

    told = e.filter(hooked & (value("name") == "AI_AGENT")).withColumn("_pair", pair).withColumn("uid", value("uid"))
    told = looked_up(told, owners_of_uids(e), key=["host", "uid"], take="uid_user", where=F.col("uid") != "")
    told = told.filter("_pair IS NOT NULL AND (uid_user IS NULL OR uid_user = user)").withColumn("value", said).filter(~F.col("value").isin("", "invalid-declaration"))
    told = told.join(per.select("conn", "_pair", "user", "opened", "closed"), ["_pair", "user"]).filter("us >= opened AND (closed IS NULL OR us < closed)")
    per = per.drop("_pair")
    keep = ["seq", "us", "kind", "host", "user", "src_ip", "pid", "ses", "fields", "conn"]
    return ssh.select(*keep).unionByName(told.select(*keep)), per


def placed(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events with host, user, fp, src_ip of their session and their connection, connections, failed log-ins). Events of no known user go."""
    e = prepared(events)
    ssh, conns = connections(e)
    conns = stored(conns, "connections")
    track = F.struct(*KEY)
    mine = ssh.join(conns.select("conn", "opened", track.alias("key")), "conn").select("seq", "us", "kind", "fields", "pid", "ses", "key", F.lit(True).alias("attributed"), "conn", "opened")
    opened = conns.select("host", "user", "src_ip", F.explode(F.array_distinct(F.array("pid", F.coalesce("child", "pid")))).alias("pid"), F.col("opened").alias("us"), F.lit(-1).cast("long").alias("seq"), F.struct(track.alias("key"), "closed").alias("of"))
    still = F.col("of").isNotNull() & (F.col("of.closed").isNull() | (F.col("of.closed") >= F.col("us")))

    named = F.when(F.col("user") != "", F.col("user")).otherwise(value("acct"))
    logins = e.filter((F.col("kind") == "audit.login") & value("res").isin("", "success")).withColumn("user", named).withColumn("src_ip", F.when(F.col("src_ip") != "", F.col("src_ip")).otherwise(value("addr")))
    logins = logins.filter(~F.col("user").isin("", "(unknown user)", "?"))
    logins = looked_up(logins, opened.filter("pid > 0").select("host", "pid", "us", "seq", "of"), key=["host", "pid"], take="of", where=F.col("pid") > 0).withColumn("by_pid", F.when(still, F.col("of.key"))).drop("of")
    logins = looked_up(logins, opened.select("host", "user", "src_ip", "us", "seq", "of"), key=["host", "user", "src_ip"], take="of", where=F.lit(True)).withColumn("by_user", F.when(still, F.col("of.key"))).drop("of")
    own = F.struct("host", "user", F.lit("-").alias("fp"), F.when(F.col("src_ip") == "", "local").otherwise(F.col("src_ip")).alias("src_ip"))
    login = stored(logins.select("seq", "us", "kind", "fields", "pid", "ses", "host", F.coalesce("by_pid", "by_user", own).alias("key"), F.lit(True).alias("attributed")), "audit-logins")

    local = e.filter(F.col("kind").isin("audit.execve", "proc.seen", "proc.gone", "net.conn", "audit.logout")).withColumn("uid", value("uid")).withColumn("ppid", number("ppid"))
    local = looked_up(local, owners_of_uids(e), key=["host", "uid"], take="uid_user", where=(F.col("user") == "") & (F.col("uid") != ""))
    local = local.withColumn("user", F.coalesce(F.nullif("user", F.lit("")), "uid_user", F.lit(""))).drop("uid_user", "uid")
    local = looked_up(local, login.filter("ses > 0").select("host", "ses", "us", "seq", F.col("key").alias("by_ses")), key=["host", "ses"], take="by_ses", where=F.col("ses") > 0)
    parent = opened.filter("pid > 0").select("host", F.col("pid").alias("ppid"), "us", "seq", "of")
    local = looked_up(local, parent, key=["host", "ppid"], take="of", where=F.col("by_ses").isNull() & (F.col("ppid") > 1) & (F.col("kind") != "audit.execve"))
    local = stored(local.withColumn("key", F.coalesce("by_ses", F.when(still, F.col("of.key")))).drop("of", "by_ses").withColumn("attributed", F.col("key").isNotNull()), "local-events")

    # processes whose parent is a known process, a generation a round; network connections go with their own process
    done, waiting = local.filter("key IS NOT NULL"), local.filter("key IS NULL AND kind <> 'audit.execve'")
    rest, fresh = local.filter("key IS NULL AND kind = 'audit.execve'"), done
    while not (seen := fresh.filter("kind = 'proc.seen' AND pid > 0")).isEmpty():
        seen = seen.select("host", F.col("pid").alias("via"), "us", "seq", F.col("key").alias("by_process"))
        asked = waiting.withColumn("via", F.when(F.col("kind").isin("net.conn", "proc.gone"), F.col("pid")).otherwise(F.col("ppid")))
        met = stored(looked_up(asked, seen, key=["host", "via"], take="by_process", where=F.col("via") > 1), "children")
        fresh = met.filter("by_process IS NOT NULL").withColumn("key", F.col("by_process")).withColumn("attributed", F.lit(True)).select(*local.columns)
        waiting, done = met.filter("by_process IS NULL").select(*local.columns), done.unionByName(fresh)
    placed_first = ["seq", "us", "kind", "fields", "pid", "ses", "key", "attributed"]
    known = mine.unionByName(login.select(*placed_first), allowMissingColumns=True).unionByName(done.select(*placed_first), allowMissingColumns=True)

    latest = known.select("key.host", "key.user", "us", "seq", F.col("key").alias("last_key"))
    rest = rest.unionByName(waiting).filter("user <> ''").drop("key", "attributed")
    rest = looked_up(rest, latest, key=["host", "user"], take="last_key", where=F.lit(True))
    # a process of a user without a session has one of its own; a command alone does not, it may be a scheduled one
    alone = F.struct("host", "user", F.lit("-").alias("fp"), F.lit("local").alias("src_ip"))
    rest = rest.filter("last_key IS NOT NULL OR kind IN ('proc.seen', 'net.conn')").withColumn("key", F.coalesce("last_key", alone)).withColumn("attributed", F.col("last_key").isNull())
    fails = e.filter((F.col("kind") == "ssh.auth_fail") & (F.col("user") != "") & (value("invalid_user") != "true")).select("host", "user", "src_ip", "us", "seq")
    return known.unionByName(rest.select(*placed_first), allowMissingColumns=True).select(*[c for c in placed_first if c != "key"], "conn", "opened", "key.*"), conns, fails


def plumbing(execs: DataFrame) -> DataFrame:
    """(seq) of commands that are plumbing themselves or have such an ancestor.

    A command's parent is the latest one of that process number on its host, at or before it.
    """
    rows = stored(execs.select("host", "seq", "us", "pid", number("ppid").alias("ppid"), value("cmd").alias("cmd")), "commands")
    runs = rows.filter("pid > 0").select("host", F.col("pid").alias("ppid"), "us", F.lit(-1).cast("long").alias("_o"), "seq").withColumnRenamed("seq", "parent").withColumnRenamed("_o", "seq")
    edges = looked_up(rows, runs, key=["host", "ppid"], take="parent", where=F.col("ppid") > 1).filter("parent <> seq").select("seq", "parent")
    match = F.lit(False)
    for p in PLUMBING:
        match = match | F.col("cmd").rlike(p)
    return closure(edges, rows.filter(match).select("seq"), node="seq", parent="parent")


def mode(processes: Column, has_connections: Column, has_commands: Column) -> Column:
    """How an agent would work here: on the host itself, from outside, or unknown."""
    field = lambda p, k: F.coalesce(F.try_element_at(p["fields"], F.lit(k)), F.lit(""))
    marked = lambda p: F.exists(F.map_keys(p["fields"]), lambda k: k.startswith("env.") & (k != "env.AI_AGENT")) | (p["attributed"] & (field(p, "env.AI_AGENT") != ""))
    agent = F.coalesce(F.exists(processes, lambda p: (field(p, "agent") != "") | (field(p, "flags") != "") | marked(p)), F.lit(False))
    local = agent | ((F.col("src_ip") == "local") & ~has_connections)
    return F.when(local, "local_agent").when(has_connections | has_commands, "remote_agent").otherwise("unknown")


SESSION = [*KEY, "session_start"]


def contents(events: DataFrame, *, gap: int | None = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(what each session consists of, failed log-ins).

    The first has a row for each placed event: host, user, fp, src_ip, session_start, us, seq, kind, pid, fields,
    attributed, conn and opened (of the connection, for its own events), and cmd, origin and argv0 where it is a command.
    Plumbing is there with the kind `plumbing`: it prolongs a session and is otherwise no one's. gap None: sessions never
    end, as when a recording is scored whole.
    """
    every, _, fails = placed(events)
    every = stored(every, "placed-events")
    every = stored(sessionised(every, key=KEY, gap=gap) if gap else every.withColumn("session_start", F.min("us").over(Window.partitionBy(*KEY))), "session-events")
    commands = every.filter("kind = 'audit.execve'").withColumn("ppid", number("ppid"))
    hidden = stored(plumbing(commands), "plumbing").withColumn("hidden", F.lit(True))
    # what the server forked to run a client's command: "sh -c" there is transport, elsewhere a tool's wrapper
    hooks = commands.filter(value("cmd").rlike(PLUMBING[0]) | value("cmd").rlike(PLUMBING[1])).filter("ppid > 1").select("host", "ppid", "us")
    command = command_channel()
    forks = hooks.unionByName(every.filter(command & (F.col("pid") > 1)).select("host", F.col("pid").alias("ppid"), "us")).select("*", F.lit(-1).cast("long").alias("seq"), F.lit(True).alias("forked"))
    execs = looked_up(commands.join(hidden, "seq", "left"), forks, key=["host", "ppid"], take="forked", where=F.col("ppid") > 1)
    execs = execs.withColumn("kind", F.when(F.col("hidden"), "plumbing").otherwise(F.col("kind"))).withColumn("ran", F.col("kind") != "plumbing")
    execs = execs.withColumn("said", F.when(F.coalesce("forked", F.lit(False)), shell_command(value("cmd"))).otherwise(value("cmd"))).withColumn("origin", F.lit("auditd"))
    rest = every.filter("kind <> 'audit.execve'").withColumn("ran", command).withColumn("said", value("cmd")).withColumn("origin", F.lit("sshlog"))
    keep = [*SESSION, "us", "seq", "kind", "pid", "fields", "attributed", "conn", "opened"]
    shown = [F.when(F.col("ran"), F.col("said")).alias("cmd"), F.when(F.col("ran"), F.col("origin")).alias("origin"), F.when(F.col("ran"), F.when(F.col("origin") == "auditd", value("argv0")).otherwise("")).alias("argv0")]
    return execs.select(*keep, *shown).unionByName(rest.select(*keep, *shown)), fails


def grouped(rows: DataFrame, *, key: list[str] = SESSION) -> DataFrame:
    """One row per key of contents(): first_us, last_us, events, connections, commands, processes, net, mode, banners."""
    ran = rows.filter("origin IS NOT NULL").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("us", "cmd", "origin", "argv0"))).alias("commands"))
    seen = rows.filter(F.col("kind").isin("proc.seen", "proc.gone")).groupBy(*key, "pid").agg(F.max_by(F.struct("kind", "fields", "attributed"), F.struct("us", "seq")).alias("p"), F.min("us").alias("us")).filter("p.kind = 'proc.seen'")
    procs = seen.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("us", "pid", F.map_entries("p.fields").alias("f"), F.col("p.attributed").alias("attributed")))).alias("processes"))
    procs = procs.withColumn("processes", F.transform("processes", lambda p: F.struct(p["us"].alias("us"), p["pid"].alias("pid"), F.map_from_entries(p["f"]).alias("fields"), p["attributed"].alias("attributed"))))
    net = rows.filter("kind = 'net.conn'").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("us", "seq", "pid", F.map_entries("fields").alias("f"), "attributed"))).alias("net"))
    net = net.withColumn("net", F.transform("net", lambda n: F.struct(n["us"].alias("us"), n["pid"].alias("pid"), F.map_from_entries(n["f"]).alias("fields"), n["attributed"].alias("attributed"))))
    base = rows.groupBy(*key).agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("events"))
    # a connection is a session's if it was opened within it
    own = rows.filter("conn IS NOT NULL AND opened >= session_start").groupBy(*key, "conn").agg(*connection_state())
    own = own.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("opened", "closed", "exec_count", "shell_count", "pty_exec_count", "pty_opened", "banner", "declared"))).alias("connections"))
    out = base
    for part in (own, ran, procs, net):
        out = out.join(part, key, "left")
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    out = out.withColumn("mode", mode(F.col("processes"), some("connections"), some("commands")))
    return out.withColumn("banners", F.array_distinct(F.filter(F.transform("connections", lambda c: c["banner"]), lambda b: b.isNotNull())))


def tracks(events: DataFrame, *, gap: int | None = WINDOW) -> DataFrame:
    """One row per session: host, user, fp, src_ip, session_start, first_us, last_us, connections, banners, commands,
    processes, net, mode, auth_fails.

    gap None: sessions never end, as when a recording is scored whole.
    """
    rows, fails = contents(events, gap=gap)
    out = grouped(stored(rows, "session-contents"))
    # a failed log-in counts for the latest session of its user and address, and neither opens nor prolongs one
    latest = out.select("host", "user", "src_ip", F.col("first_us").alias("us"), F.lit(-1).cast("long").alias("seq"), F.struct("fp", "session_start").alias("of"))
    failed = as_of(fails, latest, key=["host", "user", "src_ip"], take="of").filter("of IS NOT NULL").groupBy("host", "user", F.col("of.fp").alias("fp"), "src_ip", F.col("of.session_start").alias("session_start")).agg(F.count("*").alias("auth_fails"))
    return out.join(failed, SESSION, "left").withColumn("auth_fails", F.coalesce("auth_fails", F.lit(0)))


def tracks_at(rows: DataFrame, moments: DataFrame) -> DataFrame:
    """tracks() as they were right after each of some moments (host, user, fp, src_ip, session_start, at, at_seq) of rows, contents()."""
    before = rows.join(moments.select(*SESSION, "at", "at_seq"), SESSION).filter("us < at OR (us = at AND seq <= at_seq)")
    return grouped(before, key=[*SESSION, "at", "at_seq"]).withColumn("auth_fails", F.lit(0).cast("long"))
