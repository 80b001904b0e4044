"""Bit-sliced search against brute force, and its arithmetic."""

import collections
import math
import random
import re

import numpy as np
import pytest

from tests.llm.common import frame, rows
from tallyhound.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    found = [(i, collections.Counter(terms(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in found), sum(sum(c.values()) for _, c in found)
    df = collections.Counter(t for _, c in found for t in c)
    asked, out = collections.defaultdict(set), []
    for item, text in items:
        asked[item] |= set(terms(text))
    for item, want in asked.items():
        scores = []
        for i, c in found:
            m = 10 + (90 * sum(c.values()) * n) // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in want if c[t])
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


ITEMS = [(1, "the cat And the DOG"), (2, None), (3, "!!"), (4, "hund fluss naïve w10 w11 absentword"), (5, " ".join(f"w{k}" for k in range(120)) + " cat12 dog7"), (None, "red ball"), (6, "near river"), (6, "house")]


@pytest.mark.parametrize(("block", "together", "deep", "sent"), [(8192, 8, 64, 500_000), (64, 3, 5, 20)])
def test_against_brute_force(spark, monkeypatch, block, together, deep, sent):
    for name, value in (("BLOCK", block), ("TOGETHER", together), ("DEEP", deep), ("SENT_TERMS", sent)):
        monkeypatch.setattr(ls, name, value)
    data = [(i, t) for i, t, *_ in rows()] + [(None, "the red cat"), (None, "the red cat"), (-5, "red ball red")]
    docs = frame(spark).select("doc_id", "text", "n", "value").unionByName(spark.createDataFrame([(i, t, 5, "v") for i, t in data[len(rows()) :]], "doc_id long, text string, n long, value string"))
    index, n = ls.build_index(docs.repartition(2))
    items = spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, item string")
    for k in (1, 7, 500):
        got = ls.search(index, n, items, k=k).collect()
        assert sorted(map(tuple, got), key=str) == brute(data, ITEMS, k)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    index, n = ls.build_index(none)
    assert n == 0 and ls.search(index, n, items).collect() == []
    index, n = ls.build_index(spark.createDataFrame([(1, "cat"), (2, None), (3, "?")], "doc_id long, text string"))
    assert n == 1 and ls.search(index, n, items.limit(0)).collect() == []
    assert [tuple(r) for r in ls.search(index, n, items).select("item", "rank", "id").collect()] == [(1, 1, 1)]


def sliced(values, bits):
    raw = np.array([[(v >> b) & 1 for v in values] for b in range(bits)], dtype=np.uint8)
    return np.packbits(raw, axis=1, bitorder="little").view(np.uint64)


def test_bit_sliced_arithmetic():
    rnd = random.Random(3)
    for _ in range(20):
        rows_, size = rnd.randint(1, 9), 128
        values = [[rnd.choice([0, rnd.randrange(1 << 20), (1 << 20) - 1]) for _ in range(size)] for _ in range(rows_)]
        weights = np.array([rnd.choice([0, 1, rnd.randrange(1 << 15), (1 << 15) - 1]) for _ in range(rows_)])
        slices = ls.summed(ls.times(np.stack([sliced(v, 20) for v in values]), weights)[None])[0]
        want = [sum(int(w) * v[d] for w, v in zip(weights, values)) for d in range(size)]
        assert ls.values_at(slices, np.arange(size)).tolist() == want
        want = [x % 5 for x in want] if rnd.random() < 0.5 else want  # ties
        for k in (1, 3, 200):
            got = ls.top_slots(sliced(want, 45), k).tolist()
            assert sorted(got) == sorted(sorted((d for d in range(size) if want[d]), key=lambda d: (-want[d], d))[:k])
