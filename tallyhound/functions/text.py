"""Text functions over untrusted log strings, as column expressions."""

from __future__ import annotations

import fnmatch
import ipaddress
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The longest evidence fragment in bytes and the characters that separate shell commands.
FRAGMENT, SEPARATORS = 48, " ;&|"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def sanitised(text: Column, cap: int) -> Column:
    """Terminal escape sequences dropped, every other control character a question mark, at most `cap` bytes."""
    plain = F.regexp_replace(text, r"\x1b\[[0-?]*[ -/]*[@-~]|\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)|\x1b.?", "")
    return first_bytes(F.regexp_replace(plain, r"\p{Cc}", "?"), cap)


def cleaned(text: Column) -> Column:
    """Line breaks and tabs to spaces, control characters dropped, runs of spaces to one, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[\n\r\t]", " "), r"[\x00-\x1f\x7f]", ""), " +", " "))


def fragment(text: Column, match: Column, cap: int = FRAGMENT) -> Column:
    """The match without leading separators, else the first word; cut with an ellipsis beyond `cap` bytes."""
    some = F.regexp_replace(match, rf"^[{SEPARATORS}]+", "")
    best = bound(some, lambda m: F.when(m != "", m).otherwise(F.regexp_extract(F.trim(text), r"^(\S+)", 1)))
    return bound(best, lambda x: F.when(F.octet_length(x) > cap, F.concat(first_bytes(x, cap), F.lit("…"))).otherwise(x))


def redacted(command: Column, mode: str) -> Column:
    """A command as it may be stored: whole (full), not at all (none), or its first word and its length in bytes."""
    clean = cleaned(command)
    if mode == "full":
        return clean
    if mode == "none":
        return F.lit("")

    def word(x: Column) -> Column:
        return F.when(F.octet_length(x) > FRAGMENT, F.concat(first_bytes(x, FRAGMENT), F.lit("…"))).otherwise(x)

    said = lambda x: F.concat(bound(F.regexp_extract(x, r"^([^ ]*)", 1), word), F.lit(" … (len "), F.octet_length(x).cast("string"), F.lit(")"))
    return bound(clean, lambda x: F.when(x == "", F.lit("")).otherwise(said(x)))


def pseudonym(user: Column, salt: str) -> Column:
    return F.concat(F.lit("u_"), F.substring(F.sha2(F.concat(F.lit(salt), user), 256), 1, 12))


def declared(value: Column) -> Column:
    """What an agent says it is: nothing if empty, the word invalid-declaration unless short and of plain characters."""
    return F.when(value == "", F.lit("")).when(value.rlike(r"\A[A-Za-z0-9._@:+-]{1,64}\z"), value).otherwise(F.lit("invalid-declaration"))


def declared_name(value: Column) -> Column:
    """The name within a declaration: without its @version, trimmed, in lower case."""
    return F.lower(F.trim(F.substring_index(value, "@", 1)))


def absolute_paths(command: Column) -> Column:
    return F.regexp_extract_all(command, F.lit(r"(?:^|[\s=:'\"])(/[A-Za-z0-9_.-]+/\S*)"), F.lit(1))


#: Fixed value: how a server runs a client's command through the user's shell.
SHELL_COMMAND = r"^(?:\S*/)?-?(?:ba|z|da|k|fi)?sh -c (.+)$"


def shell_command(command: Column) -> Column:
    """What a session's shell was given to run: X of `sh -c X`. Other flags, as in `bash -lc X`, are a tool's own wrapper."""
    inner = F.regexp_extract(command, SHELL_COMMAND, 1)
    return F.when(inner != "", inner).otherwise(command)


def first_bytes(text: Column, cap: int) -> Column:
    """The longest start of a text that has at most `cap` bytes and ends with a whole character."""
    def cut(head: Column) -> Column:  # a character cut in two becomes U+FFFD
        some = F.make_valid_utf8(F.substring(F.encode(head, "UTF-8"), 1, cap).cast("string"))
        return F.when(F.octet_length(head) <= cap, head).otherwise(F.regexp_replace(some, "\uFFFD+$", ""))

    return bound(F.substring(text, 1, cap), cut)  # no more characters than bytes


def base_name(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(F.regexp_replace(path, r" \(deleted\)$", ""), r"([^/]*)$", 1), r"\s+$", "")


def glob_pattern(glob: str) -> str:
    """A regular expression, for whole strings, that both Spark and other engines read alike."""
    return "^" + re.sub(r"\\Z$|\\z$|^\(\?s:|\)(?:\\Z|\\z)?$", "", fnmatch.translate(glob)).replace("(?>", "(?:") + "$"


def host_matches(host: Column, rule: str) -> Column:
    """Equal to the rule or below it, whatever the case and a final dot; a star makes it a glob."""
    name = F.regexp_replace(F.lower(host), r"\.$", "")
    if "*" in rule:
        return name.rlike("^" + re.escape(rule.lower()).replace(r"\*", ".*") + "$")
    return (name == rule.lower()) | name.endswith("." + rule.lower())


def ip_number(ip: Column) -> Column:
    """An IPv4 address, also one mapped into IPv6, as a number; null for anything else."""
    plain = F.regexp_replace(F.lower(ip), "^::ffff:", "")
    parts = F.split(plain, r"\.")
    number = sum((F.element_at(parts, k + 1).cast("long") * (1 << (8 * (3 - k))) for k in range(4)), F.lit(0).cast("long"))
    return F.when(plain.rlike(r"\A(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.|\z)){4}"), number)


def ip6_hex(ip: Column) -> Column:
    """An IPv6 address as 32 hexadecimal digits, so that order and prefixes of the text are those of the address; null for anything else."""
    low = F.lower(ip)
    left, right = F.split(F.substring_index(low, "::", 1), ":"), F.split(F.when(low.contains("::"), F.substring_index(low, "::", -1)).otherwise(""), ":")
    some = lambda parts: F.filter(parts, lambda x: x != "")
    missing = 8 - F.size(some(left)) - F.size(some(right))
    groups = F.concat(some(left), F.when(low.contains("::") & (missing > 0), F.array_repeat(F.lit("0"), missing)).otherwise(F.array().cast("array<string>")), some(right))
    whole = low.rlike(r"\A(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){7}|(?=[0-9a-f:]*::)(?![0-9a-f:]*::[0-9a-f:]*::)(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?)\z")
    return F.when(whole & (F.size(groups) == 8), F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), ""))


def cidr_bounds(cidr: str) -> tuple[int, int]:
    """First and last number of a range; a bare address is a range of one."""
    net = ipaddress.ip_network(cidr, strict=False)
    return int(net.network_address), int(net.broadcast_address)


def in_cidr(number: Column, cidr: str) -> Column:
    low, high = cidr_bounds(cidr)
    return number.between(low, high)


def ip_in_cidr(ip: Column, cidr: str) -> Column:
    """Whether an address, of either version, lies in a range of its own version."""
    low, high = cidr_bounds(cidr)
    if ipaddress.ip_network(cidr, strict=False).version == 4:
        return F.coalesce(ip_number(ip).between(low, high), F.lit(False))
    return F.coalesce(ip6_hex(ip).between(f"{low:032x}", f"{high:032x}"), F.lit(False))


def joined_evidence(items: Column, most: int = 3) -> Column:
    more = F.size(items) - most
    return F.concat(F.array_join(F.slice(items, 1, most), "; "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(F.lit("")))


def slack_escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def markdown_escaped(text: Column) -> Column:
    """For a cell of a Markdown table."""
    return F.regexp_replace(F.regexp_replace(text, r"\|", r"\\|"), r"[\n\r]", " ")


def chat_escaped(text: Column) -> Column:
    """Marks that a chat client would read as layout or as a mention, with a backslash before them."""
    return F.regexp_replace(text, r"([\\*_~`|>@#\[\]])", r"\\$1")


def duration_said(us: Column) -> Column:
    """A length of time in microseconds for people: 250ms, 1.5s, 2m5s, 1h0m10s."""
    part = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))

    def said(x: Column) -> Column:
        s = F.round(x / 1_000_000).cast("long")
        minutes = F.concat(part(F.floor(s / 60) % 60, "m"), part(s % 60, "s"))
        short = F.concat(F.regexp_replace(F.round(x / 1_000_000, 1).cast("string"), r"\.0$", ""), F.lit("s"))
        return F.when(x < 999_500, part(F.round(x / 1_000).cast("long"), "ms")).when(s < 60, short).when(s < 3600, minutes).otherwise(F.concat(part(F.floor(s / 3600), "h"), minutes))

    return bound(us, said)
