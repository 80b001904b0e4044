"""Clues of a session's row, as expressions compiled from a rule pack, and the verdict they add up to."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhound.functions import text
from tallyhound.operators import rhythm, score
from tallyhound.operators.joins import first_match
from tallyhound.sources.rules import Clause, Pack, Profile, Style
from tallyhound.sources.tables import stored

#: Weights by kind of banner, and the time limits of timing clues in microseconds.
BANNER = {"library": 35, "automation": 15, "human": -10}
SECOND = 1_000_000
LIMITS = {"burst": 6, "regular": 0.35, "quick": 1_500_000, "sustained": 25}
TRACK = ["host", "user", "fp", "src_ip", "session_start"]


def _exists(array: str, f) -> Column:  # noqa: ANN001
    return F.coalesce(F.exists(F.col(array), f), F.lit(False))


def style_id(s: Style) -> str:
    name = s.id.removeprefix("style.")
    return f"style.{s.group}.{name.removeprefix(s.group).lstrip('._') if name.startswith(s.group) else name}" if s.group else f"style.{name}"


def _field(row: Column, key: str) -> Column:
    return F.coalesce(F.try_element_at(row["fields"], F.lit(key)), F.lit(""))


def shown(p: Column) -> Column:
    """What a process shows, read once: its name, its file, the parts of an interpreter's first path, its command."""
    base = F.regexp_extract(F.lower(_field(p, "exe")), r"([^/]*?)(?: \(deleted\))?$", 1)
    script = F.regexp_extract(F.lower(_field(p, "cmd")), r"^(?:\S*/)?(?:node|nodejs|bun|deno|python[0-9.]*|ruby|perl) (?:-\S+ )*(\S+)", 1)
    return F.struct(
        p["us"].alias("us"), p["pid"].alias("pid"), p["fields"].alias("fields"), p["attributed"].alias("attributed"), F.lower(_field(p, "comm")).alias("comm"), base.alias("base"), F.split(script, "/").alias("parts"),
        F.lower(_field(p, "cmd")).alias("cmd"),
    )


def agent_of_process(p: Column, pack: Pack) -> Column:
    """The first agent that a process (shown()) is, by its name, its file or a part of its command.

    The kernel cuts a process's name to 15 bytes.
    """
    rules = []
    for a in pack.agents:
        names, test = [n.lower() for n in a.process_names], F.lit(False)
        if names:
            test = p["comm"].isin(*names, *[n[:15] for n in names]) | p["base"].isin(*names) | F.arrays_overlap(p["parts"], F.array(*map(F.lit, names)))
        for s in a.argv_contains:
            test = test | p["cmd"].contains(s.lower())
        if names or a.argv_contains:
            rules.append((a.id, test))
    return first_match(rules)


def agent_of_env(p: Column, pack: Pack) -> Column:
    """The first agent whose variables a process has."""
    rules = []
    for a in pack.agents:
        test = F.lit(False)
        for rule in a.env_vars:
            name, _, want = rule.partition("=")
            got = F.try_element_at(p["fields"], F.lit(f"env.{name}"))
            test = test | (F.coalesce(got == want, F.lit(False)) if want else got.isNotNull())
        if a.env_vars:
            rules.append((a.id, test))
    return first_match(rules)


def skip_flags(p: Column, pack: Pack) -> Column:
    """The flags of a process that let an agent act without being asked: those the reader found, a list, or those of the pack."""
    found = F.filter(F.transform(F.split(_field(p, "flags"), ","), F.trim), lambda f: f != "")
    known = [f for a in pack.agents for f in a.skip_flags]
    return F.array_distinct(F.concat(found, F.filter(F.array(*map(F.lit, dict.fromkeys(known))), lambda f: F.contains(_field(p, "cmd"), f)) if known else F.array().cast("array<string>")))


def host_agent(n: Column, pack: Pack) -> Column:
    """The agent that a network connection speaks for: the reader's, or that of the first host rule, ?service where that names none."""
    host, port = _field(n, "host"), F.coalesce(_field(n, "dst_port").try_cast("int"), F.lit(0))
    rules = lambda h: first_match([(r.agent or "?service", (h != "") & text.host_matches(h, r.id) & port.isin(0, r.port or 443)) for r in pack.hosts])
    return F.when(_field(n, "agent") != "", _field(n, "agent")).otherwise(text.bound(host, rules))


def identified_rows(t: DataFrame, pack: Pack) -> DataFrame:
    """Tracks whose processes say which agent they are (named, env, flags), and whose connections whose service they call."""
    t = t.withColumn("processes", F.transform("processes", shown))
    judge = lambda p: F.struct(
        p["pid"].alias("pid"), p["fields"].alias("fields"), p["attributed"].alias("attributed"), _field(p, "agent").alias("guess"), agent_of_process(p, pack).alias("named"), agent_of_env(p, pack).alias("env"), skip_flags(p, pack).alias("flags"),
    )
    call = lambda n: F.struct(n["pid"].alias("pid"), n["fields"].alias("fields"), n["attributed"].alias("attributed"), host_agent(n, pack).alias("service"))
    return t.withColumns({"processes": F.transform("processes", judge), "net": F.transform("net", call)})


def agent_of_name(said: Column, pack: Pack) -> Column:
    """The agent that a declaration speaks of: the rule of that name or other name, else the name itself."""
    name = text.declared_name(said)
    found = first_match([(a.id, name.isin(*{x.lower() for x in [a.id, *a.env_ai_agent]})) for a in pack.agents])
    return F.when(found != "", found).otherwise(name)


def identified(declared: Column, pack: Pack) -> Column:
    """The agent most directly shown: by declaration, by the reader, by a process's name, its variables, or a service it calls."""
    first = lambda array, f, *skip: F.get(F.filter(F.transform(array, lambda x: x[f]), lambda a: ~a.isin("", *skip)), F.lit(0))
    return F.coalesce(F.when(declared != "", agent_of_name(declared, pack)), first("processes", "guess"), first("processes", "named"), first("processes", "env"), first("net", "service", "?service"), F.lit(""))


#: Fixed value: an absolute path within a command.
PATH = r"""(?:^|[\s='"(])(/(?:[\w.@+-]+/)*[\w.@+-]+)"""


def clause_met(c: Column, clause: Clause) -> Column:
    """Whether a command (cmd, argv0) meets a clause of a profile."""
    argv0 = F.when(c["argv0"] != "", c["argv0"]).otherwise(F.substring_index(c["cmd"], " ", 1))
    out = F.lit(False)
    if clause.cmd_regex:
        out = out | F.rlike(c["cmd"], F.lit(clause.cmd_regex))
    if clause.argv0_regex:
        out = out | F.rlike(argv0, F.lit(clause.argv0_regex))
    if clause.path_regex:
        paths = F.concat(F.regexp_extract_all(c["cmd"], F.lit(PATH), F.lit(1)), F.when(argv0.startswith("/"), F.array(argv0)).otherwise(F.array().cast("array<string>")))
        out = out | F.exists(paths, lambda x: F.rlike(x, F.lit(clause.path_regex)))
    return out


def profile_of(pack: Pack) -> Column:
    """The first profile that a session meets: users, addresses, keys, enough of its commands and all that it requires.

    Commands without a text cannot meet a clause, but their channels count for the share. Only where no command has a
    text does the client's banner decide.
    """
    texts = F.filter(F.col("commands"), lambda c: (c["cmd"] != "") | (c["argv0"] != ""))
    channels = F.aggregate(F.coalesce("connections", F.array()), F.lit(0).cast("long"), lambda a, c: a + c["exec_count"])

    def test(p: Profile) -> Column:
        out = F.lit(True)
        if p.users:
            out = out & _any(F.col("user"), [text.glob_pattern(u) for u in p.users])
        if p.src_cidrs:
            inside = F.lit(False)
            for c in p.src_cidrs:
                inside = inside | text.ip_in_cidr(F.col("src_ip"), c)
            out = out & inside
        if p.fingerprints:
            out = out & F.col("fp").isin(*p.fingerprints)
        if p.any_of:
            hits = F.size(F.filter(texts, lambda c: _either([clause_met(c, x) for x in p.any_of])))
            banner = F.exists("banners", lambda b: _any(b, [x.banner_regex for x in p.any_of if x.banner_regex]))
            out = out & (F.when(F.size(texts) > 0, score.match_ratio(hits, F.size(texts), channels)).otherwise(banner.cast("double")) >= p.min_match_ratio)
        for x in [x for x in p.any_of if x.required]:
            met = F.exists(texts, lambda c: clause_met(c, x))  # noqa: B023
            out = out & (met | F.exists("banners", lambda b: F.rlike(b, F.lit(x.banner_regex))) if x.banner_regex else met)  # noqa: B023
        return F.coalesce(out, F.lit(False)) if p.users or p.src_cidrs or p.fingerprints or p.any_of else F.lit(False)

    return first_match([(p.id, test(p)) for p in pack.profiles])


def _either(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def _any(c: Column, patterns: list[str]) -> Column:
    return _either([F.rlike(c, F.lit(p)) for p in patterns])


#: A detector of one's own: (clue, category, weight, evidence) of each clue it knows, as expressions over a prepared track.
Detector = Callable[[], Iterable[tuple[str, str, Column, Column]]]


def clues(tracks: DataFrame, pack: Pack, key: list[str] = TRACK, command_text: str = "argv0", detectors: Sequence[Detector] = ()) -> DataFrame:
    """(track key, clue, category, weight, evidence, suppressed, declared, agent, profile), one row for each clue of each track.

    command_text says what evidence may show of a command: the part that matched, at most a fragment (argv0), all of it
    (full), or nothing (none). What detectors add counts like the others: by category, under its cap, weights of 0 for what
    does not hold.
    """
    t = tracks.withColumns({c: F.coalesce(c, F.array().cast(tracks.schema[c].dataType)) for c in ("connections", "commands", "processes", "net", "banners")})
    t = identified_rows(t, pack).withColumn("profile", profile_of(pack))
    env = F.filter(F.transform(F.filter("processes", lambda p: p["attributed"]), lambda p: F.try_element_at(p["fields"], F.lit("env.AI_AGENT"))), lambda v: v.isNotNull() & (v != ""))
    said = F.filter(F.transform("connections", lambda c: c["declared"]), lambda v: v.isNotNull() & (v != ""))
    said = F.filter(F.transform(F.concat(said, env), text.declared), lambda v: ~v.isin("", "invalid-declaration"))
    t = t.withColumn("declared", F.coalesce(F.get(said, F.lit(0)), F.lit("")))
    t = t.withColumn("_times", rhythm.deduped(F.array_sort(F.transform("commands", lambda c: c["us"])), 200_000)).withColumn("_gaps", rhythm.gaps(F.col("_times")))
    t = t.withColumn("_chan", F.array_sort(F.transform(F.filter("commands", lambda c: c["origin"] == "sshlog"), lambda c: c["us"]))).withColumn("_cgaps", rhythm.gaps(F.col("_chan")))
    t = stored(t, "prepared-tracks")
    n, cv, peak = F.size("_times"), rhythm.variation(F.col("_gaps")), rhythm.peak(F.col("_times"), 300 * SECOND)
    middle = lambda gaps: rhythm.median(F.filter(gaps, lambda g: g <= 60 * SECOND))
    timing = rhythm.rhythm_clues(n, peak, middle("_gaps"), cv, **LIMITS)
    pause = rhythm.think_time(F.size("_chan"), middle("_cgaps"), rhythm.variation(F.col("_cgaps")), low=1_500_000, high=30 * SECOND)
    timing["rhythm.think_time"] = F.when(n >= 4, pause).otherwise(0)
    span = text.duration_said(F.element_at("_times", -1) - F.element_at("_times", 1))
    shown = {
        "rhythm.burst": F.format_string("%d of %d commands within 5m0s, median gap %s", peak, n, text.duration_said(middle("_gaps"))), "rhythm.regular": F.format_string("gaps cv %.2f over %d commands", cv, n),
        "rhythm.subsecond": F.format_string("median gap %s over %d commands", text.duration_said(middle("_gaps")), n), "rhythm.sustained": F.format_string("%d commands in %s", n, span),
        "rhythm.think_time": F.format_string("%d exec channels paced like a model's answers: median gap %s, cv %.2f", F.size("_chan"), text.duration_said(middle("_cgaps")), rhythm.variation(F.col("_cgaps"))),
    }
    rows = [(k, "rhythm", w, shown[k]) for k, w in timing.items()]
    kind_of = lambda b: first_match([(r.kind, F.rlike(b, F.lit("(?i)" + r.regex))) for r in pack.banners])
    for k, w in BANNER.items():
        of = F.filter("banners", lambda b: kind_of(b) == k)  # noqa: B023
        rows.append((f"banner.{k}", "banner", F.when(F.size(of) > 0, w).otherwise(0), F.array_join(F.transform(of, lambda b: text.fragment(F.lit(""), text.cleaned(b))), ", ")))
    total = lambda f: F.aggregate("connections", F.lit(0).cast("long"), lambda a, c: a + c[f])
    rows.append(("pty.none", "pty", F.when((total("exec_count") >= 3) & (total("shell_count") == 0), 15).otherwise(0), F.format_string("%d exec channels, no shell", total("exec_count"))))
    open_for = F.array_max(F.transform("connections", lambda c: F.coalesce(F.least(c["closed"], F.col("last_us")), F.col("last_us")) - c["pty_opened"]))
    rows.append(("pty.interactive", "pty", F.when(F.coalesce(open_for, F.lit(0)) > 300 * SECOND, -15).otherwise(0), F.concat(F.lit("PTY shell open "), text.duration_said(F.floor(open_for / (60 * SECOND)) * 60 * SECOND))))
    for s in pack.styles:
        regex = "(?i)" + s.regex
        hit = F.filter("commands", lambda c: F.rlike(c["cmd"], F.lit(regex)))  # noqa: B023
        part = lambda c: text.fragment(text.cleaned(c["cmd"]), text.cleaned(F.regexp_extract(c["cmd"], regex, 0)))  # noqa: B023, E731
        first = F.get(F.transform(hit, part if command_text == "argv0" else lambda c: text.redacted(c["cmd"], command_text)), F.lit(0))
        rows.append((style_id(s), "style", F.when(F.size(hit) >= s.min_commands, s.weight).otherwise(0), F.trim(F.format_string("%s (%dx)", first, F.size(hit)))))
    listed = lambda array, keep, f: text.joined_evidence(F.array_distinct(F.transform(F.filter(array, keep), f)))
    on = lambda array, keep, w: F.when(_exists(array, keep), w).otherwise(0)
    is_named = lambda p: (p["guess"] != "") | (p["named"] != "")
    of_pid = lambda p, said: F.concat(text.fragment(F.lit(""), text.cleaned(said)), F.lit(" pid "), p["pid"].cast("string"))
    calls = lambda mine: lambda x: (x["attributed"] == mine) & (x["service"] != "")
    target = lambda x: F.concat(
        text.fragment(F.lit(""), F.when(_field(x, "host") != "", _field(x, "host")).otherwise(_field(x, "dst"))), F.lit(":"), F.coalesce(F.nullif(_field(x, "dst_port"), F.lit("")), F.lit("0")),
        F.when(x["pid"] > 0, F.concat(F.lit(" from pid "), x["pid"].cast("string"))).when(~x["attributed"], " (uid only)").otherwise(""),
    )
    rows += [
        ("proc.agent_name", "process", on("processes", is_named, 45), listed("processes", is_named, lambda p: of_pid(p, _field(p, "comm")))),
        ("proc.agent_env", "process", on("processes", lambda p: p["env"] != "", 40), listed("processes", lambda p: p["env"] != "", lambda p: of_pid(p, p["env"]))),
        ("proc.skip_flags", "flags", on("processes", lambda p: F.size(p["flags"]) > 0, 25), listed("processes", lambda p: F.size(p["flags"]) > 0, lambda p: of_pid(p, F.array_join(p["flags"], " ")))),
        ("net.ai_api", "network", on("net", calls(True), 30), listed("net", calls(True), target)), ("net.ai_api_unattributed", "network", on("net", calls(False), 15), listed("net", calls(False), target)),
        ("env.ai_agent", "identity", F.lit(0), F.concat(F.lit("AI_AGENT="), text.fragment(F.lit(""), F.col("declared")))),
    ]
    for clue, category, weight, said in (row for d in detectors for row in d()):
        if category not in score.CAPS or clue in {r[0] for r in rows}:
            raise ValueError(f"{clue}: no category {category!r}, or a clue that there is")
        rows.append((clue, category, F.coalesce(weight, F.lit(0)), said))
    t = t.withColumn("agent", identified(F.col("declared"), pack))
    t = t.withColumn("_c", F.array(*[F.struct(F.lit(i).alias("clue"), F.lit(c).alias("category"), w.cast("int").alias("weight"), F.when((F.col("declared") != "") if c == "identity" else (w != 0), said).alias("evidence")) for i, c, w, said in rows]))
    keep = [*key, "declared", "agent", "profile"]
    out = t.select(*keep, F.explode("_c").alias("c")).select(*keep, "c.*")
    out = out.filter((F.col("weight") != 0) | (F.col("clue") == "env.ai_agent"))  # the last keeps every track
    suppressed = F.lit(False)
    for p in pack.profiles:
        rules = F.array(*map(F.lit, p.suppress)) if p.suppress else F.array().cast("array<string>")
        suppressed = suppressed | ((F.col("profile") == p.id) & F.exists(rules, lambda r: score.suppresses(r, F.col("clue"), F.col("category"))))
    return out.withColumn("suppressed", suppressed & ~F.col("category").isin(score.PROTECTED))


def verdicts(tracks: DataFrame, pack: Pack, thresholds: tuple[int, int, int] = (score.INFO, score.ALERT, score.HIGH), key: list[str] = TRACK, command_text: str = "argv0", detectors: Sequence[Detector] = ()) -> DataFrame:
    """One row per track (per key): score, level, class, agent, profile, reasons, evidence (by clue), details, mode, auth_fails and connections.

    A profile caps the score unless a process or flag speaks.
    """
    tracks = stored(tracks, "tracks")
    c = stored(clues(tracks, pack, key, command_text, detectors), "clues")
    v = score.verdicts(c, key=key, thresholds=thresholds)
    about = c.groupBy(*key).agg(
        F.max("agent").alias("agent"), F.max("profile").alias("profile"), F.bool_or(F.col("category").isin("process", "flags")).alias("hard"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("evidence").isNotNull() & ~F.col("suppressed"), F.struct("clue", "evidence"))))).alias("evidence"),
        F.array_sort(F.collect_list(F.when(F.col("suppressed"), F.struct("profile", "clue", "weight")))).alias("suppressed"),
        F.sort_array(F.collect_list(F.when(~F.col("suppressed"), F.struct("clue", "category", "weight", "evidence")))).alias("details"),
    )
    caps = first_match([(str(p.max_score), F.col("profile") == p.id) for p in pack.profiles if p.max_score is not None]).try_cast("int")
    out = v.join(about, key).withColumn("score", F.when(caps.isNotNull() & ~F.col("hard"), F.least("score", caps)).otherwise(F.col("score")))
    first = score.downgraded(score.rank(F.col("score"), *thresholds), F.col("categories"))
    out = out.withColumn("rank", F.when(F.col("class") == "declared_agent", F.greatest(first, F.lit(1))).otherwise(first))
    out = out.withColumn("class", F.when(F.col("class") == "declared_agent", F.col("class")).when(F.col("rank") >= 2, "suspected_agent").otherwise("human"))
    shown = F.filter("reasons", lambda r: (r != "env.ai_agent") | (F.col("class") == "declared_agent"))
    told = tracks.select(*key, "mode", "auth_fails", F.coalesce(F.size("connections"), F.lit(0)).alias("connections"), F.coalesce(F.size("commands"), F.lit(0)).alias("execs"), "first_us", "last_us")
    return out.withColumn("level", score.level(F.col("rank"))).withColumn("reasons", shown).drop("hard").join(told, key)
