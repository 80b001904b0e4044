"""Scans of a host's processes and sockets, as events: what is new, what goes on and what is gone since the scan before.

A process lives through scans that follow each other with the same number and start; it is told at the first of them and
again each time `refresh` has passed since it was last told, and it is gone at the next scan of its host, or when its
number is another's. Lives are found by windows over a host's scan numbers, so that a host's scans need not meet in one
task. streaming.scans does the same with state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhound.functions import text
from tallyhound.operators import detect, policy
from tallyhound.sources import records
from tallyhound.sources.rules import Pack

#: Time after which a live process is told again, in microseconds; lowest number of a person's account; caps in bytes.
REFRESH, MIN_UID = 60 * 1_000_000, 1000
COMM, NAME, CMD, DECLARED = 64, 256, 2048, 64
#: The columns of a process within a scan, and of an event.
PROCESS = ["host", "at", "pid", "start_ticks", "ses", "user", "fields"]
EVENT = ["ts", "kind", "source", "user", "src_ip", "src_port", "pid", "ses", "fields", "host"]


def found_variables(env: Column, pack: Pack) -> Column:
    """The variables of a process that a rule names (with the value it asks for, if any), and AI_AGENT: the latter checked, others cleaned."""
    wanted: dict[str, list[str]] = {"AI_AGENT": [""]}
    for a in pack.agents:
        for rule in a.env_vars:
            name, _, value = rule.partition("=")
            wanted.setdefault(name, []).append(value)
    tests = [F.create_map(F.lit(n), F.lit("" in v)) for n, v in wanted.items()]
    anything = F.map_concat(*tests)
    exact = F.array(*[F.lit(f"{n}={x}") for n, v in wanted.items() for x in v if x])
    kept = F.map_filter(env, lambda k, v: F.coalesce(F.try_element_at(anything, k), F.lit(False)) | F.array_contains(exact, F.concat(k, F.lit("="), v)))
    shown = F.transform_values(kept, lambda k, v: F.when(k == "AI_AGENT", text.declared(v)).otherwise(text.sanitised(v, DECLARED)))
    return F.transform_keys(shown, lambda k, v: F.concat(F.lit("env."), k))


def processes(scan: DataFrame, pack: Pack, *, min_uid: int = MIN_UID, environ: bool = True) -> DataFrame:
    """The processes worth an event (PROCESS) of a scan (host, at, pid, stat, cmdline, exe, environ, uid, loginuid, ses, user).

    Worth one is what an agent's rule knows, what declares itself, and what a person runs with a flag that skips questions.
    The variables of system accounts are looked at only within a log-in (loginuid), and of nobody if environ is false.
    Nulls count as empty texts, and as no log-in.
    """
    text_of = lambda c: F.coalesce(F.col(c), F.lit(""))
    p = scan.withColumns({"stat": records.stat(text_of("stat")), "loginuid": F.coalesce("loginuid", F.lit(-1)), "uid": F.coalesce("uid", F.lit(0))})
    person = (F.col("uid") >= min_uid) | (F.col("loginuid") >= 0)
    argv = F.filter(F.split(text_of("cmdline"), "\\x00"), lambda x: x != "")
    env = F.when(person & F.lit(environ), records.environ(text_of("environ"))).otherwise(F.create_map().cast("map<string,string>"))
    base = F.create_map(
        F.lit("comm"), text.sanitised(F.col("stat.comm"), COMM), F.lit("exe"), text.sanitised(text_of("exe"), NAME), F.lit("argv0"), text.sanitised(F.coalesce(F.get(argv, F.lit(0)), F.lit("")), NAME), F.lit("cmd"), text.sanitised(F.array_join(argv, " "), CMD),
        F.lit("uid"), F.col("uid").cast("string"), F.lit("loginuid"), F.col("loginuid").cast("string"), F.lit("ppid"), F.coalesce(F.col("stat.ppid"), F.lit(0)).cast("string"), F.lit("tty"), F.col("stat.tty"),
    )
    p = p.withColumn("fields", F.map_concat(base, found_variables(env, pack))).withColumn("start_ticks", F.coalesce(F.col("stat.start_ticks"), F.lit(0)))
    one = F.struct(F.col("at").alias("us"), "pid", "fields", F.lit(True).alias("attributed"))
    named = detect.agent_of_process(detect.shown(one), pack)
    p = p.withColumns({"_agent": F.when(named != "", named).otherwise(detect.agent_of_env(one, pack)), "_flags": detect.skip_flags(one, pack)})
    worth = (F.col("_agent") != "") | F.map_contains_key("fields", F.lit("env.AI_AGENT")) | ((F.size("_flags") > 0) & person)
    told = F.map_filter(F.map_concat("fields", F.create_map(F.lit("agent"), F.col("_agent"), F.lit("flags"), F.array_join("_flags", ","))), lambda k, v: (v != "") | k.isin("comm", "cmd"))
    return p.filter(worth).select("host", "at", "pid", "start_ticks", F.coalesce("ses", F.lit(0)).alias("ses"), F.coalesce("user", F.lit("")).alias("user"), told.alias("fields"))


def numbered(scans: DataFrame) -> DataFrame:
    """(host, at, n, next): each scan's number within its host, and the time of the next one, null for the last."""
    order = Window.partitionBy("host").orderBy("at")
    return scans.select("host", "at").distinct().select("host", "at", F.row_number().over(order).alias("n"), F.lead("at").over(order).alias("next"))


def lives(rows: DataFrame, scans: DataFrame, key: list[str]) -> DataFrame:
    """rows (host, at, key) with n, next and life: the same for what is there in scans that follow each other."""
    there = rows.join(numbered(scans), ["host", "at"])
    return there.withColumn("life", F.col("n") - F.row_number().over(Window.partitionBy("host", *key).orderBy("n")))


def _event(kind: str, at: Column, fields: Column) -> list[Column]:
    return [F.timestamp_micros(at).alias("ts"), F.lit(kind).alias("kind"), F.lit("procfs").alias("source"), "user", F.lit("").alias("src_ip"), F.lit(0).alias("src_port"), F.col("pid").cast("int").alias("pid"), F.col("ses").cast("int").alias("ses"), fields.alias("fields"), "host"]


def gone_fields(fields: Column) -> Column:
    return F.map_filter(fields, lambda k, v: k.isin("comm", "agent", "uid"))


def process_events(rows: DataFrame, scans: DataFrame, *, refresh: int = REFRESH) -> DataFrame:
    """proc.seen and proc.gone events (EVENT) of processes() over scans (host, at), which also name scans that found nothing.

    A row of no scan is left out; of rows that are repeated within a scan the one that starts first counts. Null hosts
    have no scans. Empty tables give no events.
    """
    rows = rows.select(*PROCESS).withColumn("_k", F.row_number().over(Window.partitionBy("host", "at", "pid").orderBy("start_ticks", F.to_json("fields")))).filter("_k = 1").drop("_k")
    there = lives(rows, scans, ["pid", "start_ticks"])
    life = ["host", "pid", "start_ticks", "life"]
    times = there.groupBy(*life).agg(F.sort_array(F.collect_list("at")).alias("_t"))
    told = times.select(*life, F.explode(policy.reminded(F.col("_t"), refresh)).alias("at"))
    seen = there.join(told, [*life, "at"]).select(*_event("proc.seen", F.col("at"), F.col("fields")))
    last = there.withColumn("_last", F.row_number().over(Window.partitionBy(*life).orderBy(F.desc("n")))).filter("_last = 1 AND next IS NOT NULL")
    return seen.unionByName(last.select(*_event("proc.gone", F.col("next"), gone_fields(F.col("fields")))))


def service_calls(sockets: DataFrame, pack: Pack) -> DataFrame:
    """Sockets (host, at, inode, dst, dst_port, state, uid, name) that speak to a service of the rules, with service and agent. name is the address's, where known."""
    n = F.struct(F.create_map(F.lit("host"), F.coalesce("name", F.lit("")), F.lit("dst_port"), F.col("dst_port").cast("string")).alias("fields"))
    found = detect.host_agent(n, pack)
    return sockets.withColumn("agent", found).filter("agent <> ''")


def socket_events(calls: DataFrame, scans: DataFrame, owners: DataFrame, people: DataFrame) -> DataFrame:
    """net.conn events (EVENT) of service_calls(), once for each socket as long as it lives.

    owners: (host, at, inode, pid), the lowest process of each counts; people: (host, at, pid, ses, comm, uid, loginuid,
    user) of all processes. A socket without an owner keeps its own uid and no session.
    """
    once = calls.dropDuplicates(["host", "at", "inode"])
    first = lives(once, scans, ["inode"])
    first = first.withColumn("_first", F.row_number().over(Window.partitionBy("host", "inode", "life").orderBy("n"))).filter("_first = 1")
    mine = owners.groupBy("host", "at", "inode").agg(F.min("pid").alias("pid"))
    about = people.select("host", "at", "pid", "ses", "comm", F.col("uid").alias("_uid"), "loginuid", "user").dropDuplicates(["host", "at", "pid"])
    e = first.join(mine, ["host", "at", "inode"], "left").join(about, ["host", "at", "pid"], "left")
    fields = F.create_map(
        F.lit("dst"), F.col("dst"), F.lit("dst_port"), F.col("dst_port").cast("string"), F.lit("host"), F.coalesce("name", F.lit("")), F.lit("agent"), F.when(F.col("agent") == "?service", "").otherwise(F.col("agent")), F.lit("state"), F.col("state"),
        F.lit("comm"), F.coalesce("comm", F.lit("")), F.lit("loginuid"), F.coalesce(F.col("loginuid").cast("string"), F.lit("")), F.lit("uid"), F.coalesce("_uid", "uid").cast("string"),
    )
    e = e.withColumns({"pid": F.coalesce("pid", F.lit(0)), "ses": F.coalesce("ses", F.lit(0)), "user": F.coalesce("user", F.lit(""))})
    return e.select(*_event("net.conn", F.col("at"), F.map_filter(fields, lambda k, v: F.coalesce(v, F.lit("")) != "")))
