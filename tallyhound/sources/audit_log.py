"""Events from kernel audit records, one text column `value`.

Records of one event share a time and serial number; they meet in one grouping, so that interleaving, order and late
records do not matter in a batch. streaming.audit does the same for streams, with groups that close.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhound.functions.text import first_bytes

#: Keys whose value may be hex, record types that are events on their own, exec calls by architecture, caps.
HEX_KEYS = ["proctitle", "cmd", "cwd", "name", "acct", "comm", "exe", "key", "hostname", "terminal", "grantors", "data"]
LOGIN, LOGOUT = ["USER_START", "USER_LOGIN"], ["USER_END", "USER_LOGOUT"]
EXEC_CALLS = {"c000003e": ["59", "322"], "40000003": ["11", "358"], "c00000b7": ["221", "281"]}
CMD, NAME, COMM = 2048, 256, 64
HEADER = r"^(?:node=\S+ )?type=(\S+) msg=audit\((\d+)(?:\.(\d+))?:(\d+)\):"
_PAIR = re.compile(r"""([^\s=]+)=(?:"([^"]*)"?|'([^']*)'?|(\S*))|\S+""")
_ARG = re.compile(r"a\d+(?:\[\d+\])?")
_HEX = re.compile(r"(?:[0-9A-F]{2})+")


def pairs(text: str, kind: str, decode: bool) -> dict[str, str]:
    """key=value, key="value" and key='value'; msg='...' holds pairs of its own; stray words are skipped, the last value stays."""
    out: dict[str, str] = {}
    for m in _PAIR.finditer(text):
        key, quoted, single, bare = m.groups()
        if key is None:
            continue
        if single is not None:
            out |= pairs(single, kind, decode) if key == "msg" else {key: single}
        elif quoted is not None:
            out[key] = quoted
        else:
            hexed = decode and (key in HEX_KEYS or kind == "EXECVE" and _ARG.fullmatch(key)) and _HEX.fullmatch(bare)
            out[key] = bytes.fromhex(bare).decode("utf-8", "replace") if hexed else bare
    return out


def tokens(body: Column, kind: Column) -> Column:
    """fields and enriched, the pairs before and after the mark that enriched logs add."""

    @F.pandas_udf("struct<fields:map<string,string>,enriched:map<string,string>>")
    def both(body: pd.Series, kind: pd.Series) -> pd.DataFrame:
        rows = []
        for text, k in zip(body, kind):
            raw, _, tail = text.partition("\x1d")
            fields = pairs(raw, k, True)
            for key in ("auid", "ses"):
                if fields.get(key) in ("unset", "4294967295", "-1"):
                    fields[key] = "-1"
            rows.append((fields, pairs(tail, k, False)))
        return pd.DataFrame(rows, columns=["fields", "enriched"])

    return both(body, kind)


def records(logs: DataFrame, *more: str) -> DataFrame:
    """(type, us, serial, fields, enriched) of each audit record, and `more` columns; other lines go."""
    v = F.regexp_replace("value", r"[\r\n]+$", "")
    g = lambda n: F.regexp_extract(v, HEADER, n)
    us = g(2).cast("long") * 1_000_000 + F.when(g(3) != "", g(3)).otherwise("0").cast("long") * 1000
    out = logs.filter(v.rlike(HEADER)).select(g(1).alias("type"), us.alias("us"), g(4).cast("decimal(20,0)").alias("serial"), tokens(F.trim(F.regexp_replace(v, HEADER, "")), g(1)).alias("_t"), *more)
    return out.select("type", "us", "serial", "_t.fields", "_t.enriched", *more)


def argv(execves: Column) -> Column:
    """The arguments of all EXECVE records, in order; chunks aN[k] are joined and missing ones are empty."""
    chunk = r"^a(\d+)(?:\[(\d+)\])?$"
    entries = F.flatten(F.transform(execves, lambda f: F.map_entries(F.map_filter(f, lambda k, v: k.rlike(chunk)))))
    placed = F.array_sort(F.transform(entries, lambda e: F.struct(F.regexp_extract(e["key"], chunk, 1).cast("int").alias("n"), F.coalesce(F.nullif(F.regexp_extract(e["key"], chunk, 2), F.lit("")).cast("int"), F.lit(0)).alias("c"), e["value"].alias("v"))))
    top = F.array_max(F.transform(placed, lambda p: p["n"]))
    every = F.when(F.size(placed) > 0, F.sequence(F.lit(0), top)).otherwise(F.array().cast("array<int>"))
    return F.transform(every, lambda n: F.array_join(F.transform(F.filter(placed, lambda p: p["n"] == n), lambda p: p["v"]), ""))


#: The records that together make one exec call.
PARTS = ["SYSCALL", "EXECVE", "CWD", "PROCTITLE"]


def _f(k: str, m: str = "fields") -> Column:
    return F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(""))


def _number(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")).try_cast("int"), F.lit(0))


def logins(r: DataFrame, *more: str) -> DataFrame:
    """Events of records() that are events on their own: log-ins and log-outs of the SSH server; `more` columns are kept."""
    server = (_f("terminal") == "ssh") | F.regexp_extract(_f("exe"), "([^/]*)$", 1).isin("sshd", "sshd-session", "sshd-auth")
    kept = F.map_filter("fields", lambda k, v: k.isin("acct", "addr", "hostname", "terminal", "res", "op", "exe", "auid"))
    extra = F.map_filter(F.create_map(F.lit("type"), F.col("type"), F.lit("serial"), F.col("serial").cast("string"), F.lit("uid"), _f("id")), lambda k, v: v != "")
    return r.filter(F.col("type").isin(*LOGIN, *LOGOUT) & server).select(
        F.timestamp_micros("us").alias("ts"), F.when(F.col("type").isin(*LOGIN), "audit.login").otherwise("audit.logout").alias("kind"), F.lit("auditd").alias("source"),
        F.when(_f("acct") != "", _f("acct")).otherwise(_f("ID", "enriched")).alias("user"), F.when(_f("addr") == "?", "").otherwise(_f("addr")).alias("src_ip"), F.lit(0).alias("src_port"), _number(_f("pid")).alias("pid"), _number(_f("ses")).alias("ses"), F.map_concat(kept, extra).alias("fields"), *more,
    )


def execs(groups: DataFrame, *more: str) -> DataFrame:
    """Exec calls of whole groups (us, serial, records: array of type, fields, enriched); `more` columns are kept."""
    of = lambda t: F.filter("records", lambda r: r["type"] == t)
    grouped = groups.select("us", "serial", F.get(of("SYSCALL"), F.lit(0)).alias("_s"), F.transform(of("EXECVE"), lambda r: r["fields"]).alias("exec"), F.get(of("CWD"), F.lit(0))["fields"].alias("cwd"), F.get(of("PROCTITLE"), F.lit(0))["fields"].alias("title"), *more)
    grouped = grouped.withColumns({"sys": F.col("_s.fields"), "enr": F.col("_s.enriched")}).drop("_s")
    call = F.lit(False)
    for arch, numbers in EXEC_CALLS.items():
        call = call | ((_f("arch", "sys") == arch) & _f("syscall", "sys").isin(*numbers))
    call = F.coalesce(call | _f("SYSCALL", "enr").isin("execve", "execveat"), F.lit(False))
    grouped = grouped.filter((F.size("exec") > 0) | call).withColumn("argv", argv(F.col("exec")))
    title = F.regexp_replace(_f("proctitle", "title"), "\\x00+$", "")
    from_title = (F.size("argv") == 0) & (title != "")
    grouped = grouped.withColumn("_title", from_title).withColumn("argv", F.when(from_title, F.split(title, "\\x00")).otherwise(F.col("argv")))
    keep = F.map_filter(F.coalesce("sys", F.create_map().cast("map<string,string>")), lambda k, v: k.isin("exe", "comm", "tty", "uid", "auid", "ppid", "key", "success", "arch", "syscall", "exit"))
    keep = F.transform_values(keep, lambda k, v: F.when(k == "exe", first_bytes(v, NAME)).when(k == "comm", first_bytes(v, COMM)).otherwise(v))
    user = F.when(_f("AUID", "enr") == "unset", "").otherwise(_f("AUID", "enr"))
    argc = F.coalesce(F.nullif(F.coalesce(F.try_element_at(F.get("exec", F.lit(0)), F.lit("argc")), F.lit("")), F.lit("")), F.size("argv").cast("string"))
    told = F.create_map(
        F.lit("serial"), F.col("serial").cast("string"), F.lit("auid_name"), user, F.lit("uid_name"), _f("UID", "enr"), F.lit("cwd"), first_bytes(_f("cwd", "cwd"), NAME), F.lit("argv_from"), F.when(F.col("_title"), "proctitle").otherwise(""),
        F.lit("argv0"), F.coalesce(first_bytes(F.get("argv", F.lit(0)), NAME), F.lit("")), F.lit("cmd"), first_bytes(F.array_join("argv", " "), CMD), F.lit("argc"), argc,
    )
    return grouped.select(F.timestamp_micros("us").alias("ts"), F.lit("audit.execve").alias("kind"), F.lit("auditd").alias("source"), user.alias("user"), F.lit("").alias("src_ip"), F.lit(0).alias("src_port"), _number(_f("pid", "sys")).alias("pid"), _number(_f("ses", "sys")).alias("ses"), F.map_concat(keep, F.map_filter(told, lambda k, v: v != "")).alias("fields"), *more)


def events(logs: DataFrame) -> DataFrame:
    """Events of all records: exec calls, log-ins and log-outs of the SSH server."""
    r = records(logs)
    groups = r.filter(F.col("type").isin(*PARTS)).groupBy("us", "serial").agg(F.collect_list(F.struct("type", "fields", "enriched")).alias("records"))
    return logins(r).unionByName(execs(groups))
