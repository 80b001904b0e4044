"""Phrases against brute force: counts, parts, scores and ranks."""

import collections
import random
import re

import numpy as np
import pytest

from tallyhound.llm import phrases as ph

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(data):
    """{lang: Counter of word tuples up to four words}."""
    out = collections.defaultdict(collections.Counter)
    for lang, text in data:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, 5):
                out[lang or "und"].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    return out


def brute(data, least, inside, top):
    out = []
    for lang, f in counts(data).items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        n = sum(a for p, a in f.items() if len(p) == 1)
        gone = {p[i : i + m] for p, b in cand.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * b >= inside * cand[p[i : i + m]]}
        rows = []
        for p, a in cand.items():
            if p not in gone:
                s, _, l, r = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                rows.append((-s, -a, " ".join(p).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, n, -s) for k, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def texts():
    rnd = random.Random(5)
    out = []
    for k in range(150):
        words = [rnd.choice("a b c d e f g the The of x\x00y ärger Ärger 日本".split() + [f"rare{rnd.randrange(400)}"]) + rnd.choice(["", "", "", ",", ".", "\t", "\n", "!\r\n", "\x0b"]) for _ in range(rnd.randrange(90))]
        out.append((rnd.choice(["en", "de", None]), " ".join(words)))
    out += [("en", None), (None, None), ("en", ""), ("fr", " \t ... "), ("en", "same same same same same " * 40)]
    out += [("en", "one copied passage of words, " * 9)] * 4 + [("de", "lang ! " + "a b c d " * 3000)]
    return out


@pytest.mark.parametrize(("table", "places", "tokens", "cut"), [(400_000, 1_000_000, 1_500_000, 8_000_000), (12, 100, 700, 500), (1, 50, 100, 64)])
def test_against_brute_force(spark, monkeypatch, table, places, tokens, cut):
    for name, value in (("TABLE", table), ("PLACES", places), ("TOKENS", tokens), ("SLICE", cut)):
        monkeypatch.setattr(ph, name, value)
    data = texts()
    df = spark.createDataFrame([(i, lang, t, 1, "w") for i, (lang, t) in enumerate(data)], "ids long, lang string, text string, n long, word string").repartition(3)
    for least, inside, top in ((3, 80, 2000), (8, 100, 5)):
        assert sorted(map(tuple, ph.collocations(df, least=least, inside=inside, top=top).collect())) == brute(data, least, inside, top)


def test_every_place_of_a_phrase_has_one_owner():
    rnd = np.random.default_rng(2)
    for high in (3, 9):
        x = rnd.integers(-1, high, 3000)
        pivot, cols, n = ph.places(x)
        got = collections.Counter()
        for phrases, count in ph.mined(pivot, cols, n, np.ones(len(pivot), dtype=bool), 1):
            for p, c in zip(phrases.tolist(), count.tolist()):
                assert tuple(p) not in got
                got[tuple(p)] = c
        want = collections.Counter(tuple(x[i : i + m].tolist()) for m in (2, 3, 4) for i in range(len(x) - m + 1) if (x[i : i + m] >= 0).all())
        assert got == want
        big = ph.mined(np.where(pivot < 0, -1, pivot + 2**61), np.where(cols < 0, -1, cols + 2**61), n, np.ones(len(pivot), dtype=bool), 1)
        assert {tuple(p - 2**61): c for phrases, count in big for p, c in zip(phrases, count)} == want


def test_empty_tables_and_other_names(spark):
    assert ph.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert ph.collocations(spark.createDataFrame([("en", None)], "lang string, text string")).collect() == []
    df = spark.createDataFrame([("en", "a b")] * 2, "`l.l` string, `t t` string")
    assert [tuple(r) for r in ph.collocations(df, lang_col="l.l", text_col="t t", least=2).collect()] == [("en", 1, "a b", 2, 2, 2, 4, 1_000_000)]
