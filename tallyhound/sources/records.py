"""Readers of recorded events and of alerts, and snapshots of processes and sockets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhound.functions.text import base_name
from tallyhound.sources.sshd_log import EVENT

#: An alert as it is written, one JSON object a line.
ALERT = (
    "schema string, ts timestamp, host string, event string, class string, mode string, user string, src_ip string, key_fingerprint string, agent string, score int, level string,"
    " reasons array<struct<clue:string,category:string,weight:int,evidence:string,ts:timestamp>>, suppressed array<struct<profile:string,clue:string,weight:int,reason:string>>, session_id string, connections int,"
    " window struct<start:timestamp,end:timestamp,execs:int>, freeze_window struct<name:string,until:timestamp,level:string>, actions_hint string"
)
RANKS = {"none": 0, "info": 1, "alert": 2, "high": 3}


def recorded_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, skipped) of recorded lines. Blank lines and comments do not count; a line that is no event raises when it
    is read; one without a time is skipped."""
    lines = spark.read.text(path)
    said = F.when((F.trim("value") != "") & ~F.ltrim("value").startswith("#"), F.col("value"))  # filters may be reordered, a condition may not
    parsed = lines.select("value", F.from_json(said, EVENT, {"mode": "FAILFAST"}).alias("e"), said.isNotNull().alias("_said"))
    ok = F.when(~F.col("_said"), False).when(F.coalesce(F.col("e.kind"), F.lit("")) == "", F.raise_error(F.concat(F.lit("no kind: "), F.col("value"))).cast("boolean")).otherwise(True)
    checked = parsed.withColumn("_ok", ok).filter("_ok")
    return checked.filter("e.ts IS NOT NULL").select("e.*"), checked.filter("e.ts IS NULL").select("value")


def alerts(spark: SparkSession, path: str, since: Column | None = None) -> DataFrame:
    """Alerts of path and its rotated siblings path.N, in order of time; lines that are no alert are left out."""
    rows = spark.read.text([path, path + ".*"] if _siblings(spark, path) else path).select(F.from_json("value", ALERT).alias("a")).select("a.*").filter("schema IS NOT NULL AND schema <> '' AND ts IS NOT NULL")
    rows = rows if since is None else rows.filter(F.col("ts") >= since)
    return rows.orderBy("ts", "session_id")


def _siblings(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + ".*")
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    return bool(found) and len(found) > 0


def report_rows(found: DataFrame) -> DataFrame:
    """Alerts with what folding needs: us, seq, rank, in_freeze and empty texts for nulls."""
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv]), F.coalesce("level", F.lit("none"))), F.lit(0))
    out = found.withColumn("us", F.unix_micros("ts")).withColumn("seq", F.monotonically_increasing_id()).withColumn("rank", rank).withColumn("in_freeze", F.col("freeze_window").isNotNull())
    return out.fillna("", ["agent", "class", "event"])


def passwd(lines: DataFrame) -> DataFrame:
    """(uid, name) of a passwd file's lines (value); the first entry of a uid counts, comments and short lines go."""
    parts = F.split("value", ":")
    rows = lines.withColumn("_n", F.monotonically_increasing_id()).filter((F.size(parts) >= 3) & ~F.col("value").startswith("#")).select(parts[2].try_cast("int").alias("uid"), parts[0].alias("name"), "_n").filter("uid IS NOT NULL")
    return rows.groupBy("uid").agg(F.min_by("name", "_n").alias("name"))


def stat(text: Column) -> Column:
    """comm, ppid, tty and start_ticks of a /proc/PID/stat line; the command may hold brackets and spaces."""
    rest = F.split(F.regexp_extract(text, r"^.*\) (\S.*)$", 1), " ")
    tty = F.get(rest, F.lit(4)).try_cast("int")
    major, minor = F.shiftright(tty, 8).bitwiseAND(0xFFF), tty.bitwiseAND(0xFF).bitwiseOR(F.shiftright(tty, 12).bitwiseAND(0xFFF00))
    name = F.when(major.between(136, 143), F.concat(F.lit("pts/"), ((major - 136) * 256 + minor).cast("string"))).when(major == 4, F.concat(F.lit("tty"), minor.cast("string"))).otherwise("")
    return F.struct(F.regexp_extract(text, r"\((.*)\) ", 1).alias("comm"), F.get(rest, F.lit(1)).try_cast("int").alias("ppid"), name.alias("tty"), F.get(rest, F.lit(19)).try_cast("long").alias("start_ticks"))


def environ(text: Column) -> Column:
    """Variables of a NUL-separated environment; the first of a name counts."""
    pairs = F.filter(F.split(text, "\\x00"), lambda x: x.contains("="))
    items = F.transform(pairs, lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.regexp_replace(x, "^[^=]*=", "").alias("value")))
    first = F.filter(items, lambda x, i: ~F.exists(F.slice(items, F.lit(1), i), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(first)


def socket_address(text: Column) -> Column:
    """ADDRESS:PORT in hex, as in /proc/net/tcp, as ip and port. Words are little-endian; v4 within v6 is v4."""
    a, port = F.split(text, ":")[0], F.conv(F.split(text, ":")[1], 16, 10).cast("int")
    v4 = F.right(a, F.lit(8))
    byte = lambda k: F.conv(F.substring(v4, 2 * k + 1, 2), 16, 10)
    words = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda w: F.concat(*[F.substr(a, w * 8 + 7 - 2 * k, F.lit(2)) for k in range(4)]))
    full = F.lower(F.array_join(words, ""))
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda g: F.regexp_replace(F.substr(full, g * 4 + 1, F.lit(4)), "^0{1,3}", ""))
    mapped = F.length(a).isin(8) | full.startswith("0" * 20 + "ffff")
    return F.struct(F.when(mapped, F.concat_ws(".", byte(3), byte(2), byte(1), byte(0))).otherwise(F.array_join(groups, ":")).alias("ip"), port.alias("port"))


def sockets(lines: DataFrame) -> DataFrame:
    """Established and opening connections of /proc/net/tcp lines (value): local, remote, uid, inode."""
    parts = F.split(F.trim("value"), " +")
    return lines.filter(F.trim("value").rlike(r"^\d+:") & parts[3].isin("01", "02")).select(socket_address(parts[1]).alias("local"), socket_address(parts[2]).alias("remote"), parts[7].cast("int").alias("uid"), parts[9].cast("long").alias("inode"))


def owners(fds: DataFrame) -> DataFrame:
    """(inode, pid) of links (pid, target) like socket:[123]; the lowest process counts."""
    inode = F.regexp_extract("target", r"^socket:\[(\d+)\]$", 1)
    return fds.filter(inode != "").groupBy(inode.cast("long").alias("inode")).agg(F.min("pid").alias("pid"))


def interesting(name: str, agents: list[str]) -> Column:
    """Whether a process's name is an agent's: whole, or cut to 15 bytes as the kernel does."""
    cut = [a for a in agents if len(a) > 15]
    own = base_name(F.col(name))
    out = own.isin(*agents)
    for a in cut:
        out = out | (own == a[:15])
    return out


