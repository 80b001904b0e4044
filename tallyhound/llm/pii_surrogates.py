"""Surrogates for personal data.

Entities are e-mail addresses, telephone numbers, IPv4 and IPv6 addresses, card, account (IBAN) and social security
numbers, and names: those after a form of address, and every further mention of such a name in the same document. Each
distinct entity gets a keyed replacement of its own type: digits for digits in the mention's layout, letters in its
script, a name of its gender. Replacements are checked over the whole corpus: no two entities may share one and none may
be an entity that occurs; whoever loses draws again. One entity has one replacement everywhere, however a mention writes
it, so texts that speak of the same person still do.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
from itertools import count

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhound.llm.common import documents, join_by_group, named, stored

#: Forms of address by gender, particles of names, syllables and name endings by script.
ADDRESS = {
    "m": ["Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"],
    "n": ["Dr", "Prof", "Professor"],
}
#: Forms that are read in lower case too; the others might be words of some language.
SMALL = ["mr", "mrs", "ms", "dr", "prof"]
PARTICLES = ["van", "von", "de", "der", "den", "da", "di", "du", "la", "le", "zu", "bin"]
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ke la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi wa we za".split(),
    "cyrillic": "ба бо ва ве га го да де жа за зи ка ко ла ле ма ми на не но па по ра ре ро са се та то фа ха ша".split(),
    "greek": "βα βε γα δα δε ζα θα κα κε λα λε μα με να νε νι πα πε ρα ρε σα σε τα τε φα χα".split(),
}
ENDINGS = {
    "latin": {"m": "rt", "f": "lia", "n": "rin", "s": "son"}, "cyrillic": {"m": "мир", "f": "на", "n": "ня", "s": "ов"}, "greek": {"m": "ος", "f": "ια", "n": "ι", "s": "ίδης"},
}
#: Endings of women's surnames, what stands in their place in the man's, and the surrogate's own pair.
FEMININE = {"cyrillic": [("ова", "ов"), ("ева", "ев"), ("ёва", "ёв"), ("ина", "ин"), ("ына", "ын"), ("ская", "ский"), ("цкая", "цкий")], "greek": [("ίδου", "ίδης"), ("άκη", "άκης"), ("οπούλου", "όπουλος")]}
WOMAN = {"cyrillic": ("ов", "ова"), "greek": ("ίδης", "ίδου")}

#: The country codes of two digits; 1 and 7 have one, all others three.
TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()

_FORMS = [x for g in ADDRESS.values() for x in g]
_FORM = "|".join(sorted({*_FORMS, *(x.upper() for x in _FORMS), *SMALL}, key=lambda x: (-len(x), x)))
_WORD = r"\p{Lu}(?:[\p{L}\p{M}]|['’-](?=\p{L}))*[\p{L}\p{M}]"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
PATTERNS = [
    ("email", r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ip6", r"(?<![A-Za-z0-9:.])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![A-Za-z0-9:]|\.[0-9])"),
    ("card", r"(?<![0-9])(?:[3-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("phone", r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
     r"|\(0[0-9]{1,4}\) ?[0-9]{3,4}(?:[ -]?[0-9]{3,4})?|0[1-9](?:[ .-][0-9]{2}){4}|0[0-9]{2,4}[ /-][0-9]{3,4}[ -]?[0-9]{3,4}|[2-9][0-9]{9})(?![0-9])"),
    ("ip", rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"),
    ("name", rf"(?<!\w)(?:{_FORM})\.?[ ](?:\p{{Lu}}\.[ ]?)*(?:(?:{'|'.join(PARTICLES)})[ ])*{_WORD}(?:(?:[ ]\p{{Lu}}\.)?(?:[ ](?:{'|'.join(PARTICLES)}))*[ ]{_WORD}){{0,2}}"),
]
_ALL = regex.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS))
_NAME, _HEAD = regex.compile(rf"(?<![\p{{L}}\p{{M}}]){_WORD}"), regex.compile(rf"({_FORM})\.?[ ]")
#: What every text with an entity has: Spark drops the other rows before any work in Python. Few letters start a name's form.
HINT = (
    "(?=[:@0-9A-Z" + "".join(sorted({x[0] for x in _FORM.split("|")} - set("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))) + "])(?:@|[0-9][0-9().\\-/ ]{5,}[0-9]|:[0-9A-Fa-f]{0,4}:"
    + r"|[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4} ?[A-Z0-9]" + f"|(?:{_FORM})" + r"\.? )"
)
_GENDER = {x.casefold(): g for g, xs in ADDRESS.items() for x in xs}


def script_of(word: str) -> str:
    c = word[0].lower()
    return "cyrillic" if "а" <= c <= "ё" else "greek" if "ά" <= c <= "ώ" else "latin"


def surname_of(word: str) -> tuple[str, bool]:
    """The man's form of a surname, folded, and whether the word is the woman's form."""
    folded = word.casefold()
    for hers, his in FEMININE.get(script_of(word), []):
        if folded.endswith(hers) and len(folded) > len(hers) + 1:
            return folded.removesuffix(hers) + his, True
    return folded, False


def iban_rest(said: str) -> int:
    return int("".join(str(int(c, 36)) for c in said[4:] + said[:4])) % 97


def _valid(kind: str, said: str) -> bool:
    if kind == "iban":
        plain = said.replace(" ", "")
        return 15 <= len(plain) <= 34 and iban_rest(plain) == 1
    if kind == "ip6":  # two words around a double colon are more often code than an address
        groups = [g for g in said.split(":") if g]
        try:
            address = ipaddress.IPv6Address(said)
        except ValueError:
            return False
        return len(groups) >= 3 or address.is_link_local or address.is_private and len(groups) == 2
    return True


def _owner(word: str) -> str:
    """A word without the s of possession."""
    return word[:-2] if word[-2:].lower() in ("'s", "’s") and len(word) > 3 else word


def mentions(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, entity, gender) of each mention, in order. The kind of a name says whether it is a surname, or
    the gender of a given name, and its script.

    The forms of address of a text give a given name its gender there; with forms of both, or none that says one, it is
    open (n). So one name of people of different gender in different texts is two entities.
    """
    out, known = [], {}
    for m in _ALL.finditer(text):
        kind, said = m.lastgroup, m[0]
        if kind == "name":
            head = _HEAD.match(said)
            gender = _GENDER[head[1].casefold()]
            words = [(w.start(), w.start() + len(own), own) for w in _NAME.finditer(said, head.end()) for own in [_owner(w[0])]]
            for a, b, word in words:
                if (a, b, word) == words[-1]:
                    what = (f"name.s.{script_of(word)}", surname_of(word)[0], "n")
                else:
                    what = (f"name.g.{script_of(word)}", word.casefold(), gender)
                known.setdefault(what[1], what)
                out.append((m.start() + a, m.start() + b, *what))
        elif _valid(kind, said):
            if kind in ("email", "ip"):
                entity = said.lower()
            elif kind == "ip6":
                entity = ipaddress.IPv6Address(said).compressed
            elif kind == "iban":
                entity = said.replace(" ", "")
            else:
                entity = ("+" if said[0] == "+" else "") + regex.sub(r"[^0-9]", "", said)
            out.append((m.start(), m.end(), kind, entity, "n"))
    if known:  # the same people again, without a form of address
        taken = [(a, b) for a, b, *_ in out]
        at = 0
        for w in _NAME.finditer(text):
            word = _owner(w[0])
            end = w.start() + len(word)
            what = known.get(word.casefold()) or known.get(surname_of(word)[0])
            while at < len(taken) and taken[at][1] <= w.start():
                at += 1
            if what and not (at < len(taken) and taken[at][0] < end):
                out.append((w.start(), end, *what))
        out.sort()
    return gendered(out)


def gendered(found: list[tuple[int, int, str, str, str]]) -> list[tuple[int, int, str, str, str]]:
    """mentions with the gender that a given name has in the text in its kind (name.m.latin)."""
    seen: dict[str, set[str]] = {}
    for _, _, kind, entity, gender in found:
        if kind.startswith("name.g.") and gender != "n":
            seen.setdefault(entity, set()).add(gender)
    out = []
    for a, b, kind, entity, gender in found:
        if kind.startswith("name.g."):
            own = seen.get(entity, set())
            gender = next(iter(own)) if len(own) == 1 else "n"
            kind = kind.replace(".g.", f".{gender}.", 1)
        out.append((a, b, kind, entity, gender))
    return out


def domain(kind: Column) -> Column:
    """Kinds whose surrogates must differ from each other: given names of all genders are one."""
    return F.regexp_replace(kind, r"^name\.[mfn]\.", "name.g.")


class Draw:
    """A stream of keyed choices for one entity and attempt."""

    def __init__(self, key: bytes, *what: object):
        self.key, self.what, self.bits, self.n = key, "\0".join(map(str, what)), 0, 0
        self.block = count()

    def __call__(self, n: int) -> int:
        if self.n < 1 << 64:
            self.bits, self.n = int.from_bytes(hmac.new(self.key, f"{self.what}\0{next(self.block)}".encode(), hashlib.sha256).digest(), "big"), 1 << 256
        self.bits, out = divmod(self.bits, n)
        self.n //= n
        return out


def luhn(digits: str) -> int:
    return sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10


def country_digits(digits: str) -> int:
    """How many digits the country's code has at the start of an international number."""
    return 1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGITS else 3


def surrogate(key: bytes, kind: str, entity: str, attempt: int) -> str:
    """A replacement of the same type: same length and layout of digits and letters, same script and gender.

    Later attempts draw from more: names have one more syllable at each second attempt, e-mail addresses one more letter,
    numbers one more digit at each fourth. Addresses of a private block move to 10.* at the second attempt; from the
    fourth on, where IPv4 has no room, an address is a unique local one of IPv6. The kind of a given name has its gender
    (name.m.latin) in place of the g.
    """
    draw = Draw(key, kind, entity, attempt)
    if kind == "email":
        local, _, domain = entity.partition("@")
        *hosts, top = domain.split(".")
        swap = lambda s: "".join(chr(97 + draw(26)) if c.isalpha() else str(draw(10)) if c.isdigit() else c for c in s)
        more = "".join(chr(97 + draw(26)) for _ in range(attempt // 2))
        return f"{swap(local)}{more}@{'.'.join(map(swap, hosts))}.{top}"
    if kind == "ip":
        if attempt >= 4:
            return ":".join([f"fd{draw(1 << 8):02x}", *(f"{draw(1 << 16):x}" for _ in range(7))])
        a, b, *rest = map(int, entity.split("."))
        if attempt >= 2 and ((a, b) == (192, 168) or (a == 172 and 16 <= b < 32)):
            a = 10
        if a in (10, 127) or (a, b) == (192, 168) or (a == 172 and 16 <= b < 32):
            fixed = 1 if a in (10, 127) else 2
            return ".".join(map(str, [a, b][:fixed] + [draw(254) + 1 for _ in range(4 - fixed)]))
        first = next(x for x in iter(lambda: draw(222) + 1, None) if x not in (10, 127, 172, 192))
        return ".".join(map(str, [first, *(draw(254) + 1 for _ in range(3))]))
    if kind == "ip6":  # a local address stays one; others go to the prefix that is kept for documentation
        local = entity.startswith(("fc", "fd", "fe8"))
        head = f"fd{draw(1 << 8):02x}:{draw(1 << 16):x}" if local else "2001:db8"
        return ipaddress.IPv6Address(":".join([head, *(f"{1 + draw((1 << 16) - 1):x}" for _ in range(6))])).compressed
    if kind == "iban":  # the country stays, and the check digits are right
        body = "".join(c if k < 2 else chr(65 + draw(26)) if c.isalpha() else str(draw(10)) for k, c in enumerate(entity[:2] + entity[4:] + "0" * (attempt // 4)))
        return f"{body[:2]}{98 - iban_rest(body[:2] + '00' + body[2:]):02d}{body[2:]}"
    if kind.startswith("name"):
        _, role, script = kind.split(".")
        parts = SYLLABLES[script]
        return "".join(parts[draw(len(parts))] for _ in range(3 + attempt // 2)) + ENDINGS[script][role]
    sign, digits = ("+", entity[1:]) if entity[0] == "+" else ("", entity)
    if kind == "card":  # the issuer's digit stays, and so does whether the check digit is right
        body = digits[0] + "".join(str(draw(10)) for _ in range(len(digits) - 2 + attempt // 4))
        last = next(d for d in "0123456789" if luhn(body + d) == 0)
        return body + (last if luhn(digits) == 0 else str((int(last) + 1 + draw(9)) % 10))
    keep = country_digits(digits) if sign else int(kind == "phone" and digits[0] == "0")  # the country's code and the trunk's 0 stay
    return sign + digits[:keep] + "".join(str(2 + draw(8)) if k == 0 else str(draw(10)) for k in range(len(digits) - keep + attempt // 4))


def worn(kind: str, mention: str, new: str) -> str:
    """The replacement in the layout, case and, for a surname, the gender of a mention."""
    if kind == "email":
        return new.upper() if mention.isupper() else new
    if kind in ("ip", "ip6"):
        return new
    if kind == "iban":
        rest = iter(new)
        return "".join(c if c == " " else next(rest) for c in mention) + "".join(rest)
    if kind.startswith("name"):
        if ".s." in kind and surname_of(mention)[1]:
            his, hers = WOMAN[script_of(mention)]
            new = new.removesuffix(his) + hers
        return new.upper() if mention.isupper() else new[0].upper() + new[1:]
    digits = iter(new.lstrip("+"))
    return "".join(next(digits) if c.isdigit() else c for c in mention) + "".join(digits)  # a longer number ends with what is more


def assigned(entities: DataFrame, key: bytes) -> DataFrame:
    """entities, distinct (kind, entity), with a surrogate: all surrogates of a kind differ and none is an entity of it.

    Given names of all genders count as one kind in this. One without a gender (name.g) gets a name of neither.
    """

    @F.pandas_udf("string")
    def drawn(kind: pd.Series, entity: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, k.replace(".g.", ".n."), e, a) for k, e, a in zip(kind, entity, attempt)], dtype=object)

    waiting, done, attempt = entities, None, 0
    taken = entities.select(domain(F.col("kind")).alias("domain"), F.col("entity").alias("surrogate")).distinct()
    while True:
        drawn_now = stored(waiting.withColumn("surrogate", drawn("kind", "entity", F.lit(attempt))).withColumn("domain", domain(F.col("kind"))), "surrogates-drawn")
        free = drawn_now.join(taken, ["domain", "surrogate"], "left_anti")
        first = free.groupBy("domain", "surrogate").agg(F.min(F.struct("entity", "kind")).alias("f")).select("domain", "surrogate", "f.entity", "f.kind")
        won = stored(free.join(first, ["domain", "surrogate", "entity", "kind"], "left_semi"), "surrogates")
        done = won.drop("domain") if done is None else done.unionByName(won.drop("domain"))
        taken = taken.unionByName(won.select("domain", "surrogate"))
        waiting = stored(drawn_now.join(won.select("kind", "entity"), ["kind", "entity"], "left_anti").drop("surrogate", "domain"), "surrogates-waiting")
        if waiting.isEmpty():
            return done
        attempt += 1


def with_surrogates(df: DataFrame, *, key: bytes, text_col: str = "text") -> DataFrame:
    """df with personal data replaced in text_col, and n_entities, the number of replaced mentions. All rows stay.

    Null texts stay null; texts are read whole; repeated rows are replaced alike, with or without an id; df must have no
    column n_entities, any other name will do. An empty df gives an empty result. A given name is told apart by its gender in its text, see
    mentions(); one without gets a name of neither. Only rows that may hold an entity are shuffled.
    """
    if "n_entities" in df.columns:
        raise ValueError("df has a column n_entities")
    cols = df.columns
    hinted = F.coalesce(named(text_col).rlike(HINT), F.lit(False))

    @F.pandas_udf("array<struct<first:int,end:int,kind:string,entity:string,gender:string>>")
    def marked(text: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("first", "end", "kind", "entity", "gender"), m)) for m in mentions(t)] for t in text], dtype=object)

    # texts, not rows, are what mentions belong to: copies of a text share its replacements
    some = df.filter(hinted).select(F.struct(*[named(c) for c in cols]).alias("doc"), named(text_col).alias("text"), F.md5(named(text_col)).alias("hash"))
    some = stored(some.withColumn("marks", marked("text")), "rows-with-hints")
    each = some.select("hash", F.explode("marks").alias("m")).select("hash", "m.kind", "m.entity")
    pairs = each.groupBy("hash", "kind", "entity").agg(F.lit(1).alias("one"))
    sizes = pairs.groupBy("kind", "entity").agg(F.count("*").alias("n"))
    entities = stored(sizes, "entities")
    known = assigned(entities, key).withColumn("ke", F.struct("kind", "entity"))
    total = max(1, entities.agg(F.sum("n")).first()[0] or 0)
    placed = join_by_group(pairs.select("hash", F.struct("kind", "entity").alias("ke")), known.select("ke", "n", "surrogate"), "ke", "n", total)
    maps = placed.groupBy("hash").agg(F.collect_list(F.struct("ke.kind", "ke.entity", "surrogate")).alias("swaps"))

    @F.pandas_udf("text string, n int")
    def replaced(text: pd.Series, marks: pd.Series, swaps: pd.Series) -> pd.DataFrame:
        out = []
        for t, said, s in zip(text, marks, swaps):
            new = {(x["kind"], x["entity"]): x["surrogate"] for x in s} if s is not None else {}
            at, parts = 0, []
            for m in said:
                parts += [t[at : m["first"]], worn(m["kind"], t[m["first"] : m["end"]], new[m["kind"], m["entity"]])]
                at = m["end"]
            out.append(("".join([*parts, t[at:]]), len(said)))
        return pd.DataFrame(out, columns=["text", "n"])

    counts = some.groupBy("hash").agg(F.count("*").alias("copies"))
    lookup = stored(maps.join(counts, "hash"), "swaps-of-texts")
    done = join_by_group(some, lookup, "hash", "copies", max(1, some.count())).withColumn("new", replaced("text", "marks", "swaps"))
    out = [F.col("new.text").alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in cols]
    return df.filter(~hinted).withColumn("n_entities", F.lit(0)).unionByName(done.select(*out, F.col("new.n").alias("n_entities")))


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_surrogates(documents(spark, sf_dir).select("doc_id", "text"), key=b"tallyhound-demonstration-key")
