"""Collocations: phrases of 2 to 4 words, mined by pivot partitioning.

Words get numbers by falling frequency, so that a larger number is a rarer word. Words that are not frequent part the
text, as no frequent phrase holds one. Every place of the text is routed to the word that stands there, its pivot,
together with up to three words on each side that are not rarer: what the pivot's own phrases can be made of. A phrase
belongs to its rarest word, to the leftmost place of it, so it is counted by one pivot and once. A pivot's places are
mined level by level: a longer phrase is counted only where its parts are frequent. Pivots with very many places are
mined in several tasks, whose counts are added before the threshold applies.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhound.llm.common import documents, named, stored, text_or_empty

#: Words of a phrase, at most.
LONGEST = 4
#: Words with a number by frequency, at most: they are sent to every task. Rarer ones are numbered by a hash.
TABLE = 400_000
#: Places that one task mines at once, and tokens that one task turns into places at once.
PLACES, TOKENS = 1_000_000, 1_500_000
#: Bytes of a text that are cut into words at once.
SLICE = 8_000_000
_BREAK = b"\xff"  # no byte of UTF-8
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 255 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
_HASHED = 1 << 62


def tokens_of(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text with a break between pieces, in portions that end at a break."""
    folded = raw.translate(_FOLD)
    start = 0
    while start < len(folded):
        end = len(folded) if len(folded) - start <= SLICE else folded.rfind(_BREAK, start, start + SLICE) + 1 or folded.find(_BREAK, start) + 1 or len(folded)
        yield folded[start:end].replace(_BREAK, b" \xff ").split()
        start = end


def hashed_id(lang: str, word: bytes) -> int:
    """A number for a word outside the table, above all numbers in it. (62 bits: 10 ** 8 such words share one with a chance of 0.1 %.)"""
    return _HASHED | int.from_bytes(hashlib.blake2b(lang.encode() + b"\0" + word, digest_size=8).digest(), "little") >> 2


def _raw(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
        yield lang, text.as_py()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = defaultdict(Counter)

    def out() -> Iterator[pa.RecordBatch]:
        for lang, words in counts.items():
            words.pop(_BREAK, None)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.binary()).cast(pa.string()), pa.array(list(words.values()), pa.int64())], ["lang", "word", "n"])
        counts.clear()

    for batch in batches:
        for lang, raw in _raw(batch):
            for tokens in tokens_of(raw):
                counts[lang].update(tokens)
        if sum(map(len, counts.values())) > 500_000:
            yield from out()
    yield from out()


class _Numbers(dict):
    """Numbers of one language's words: -1 for words that are not frequent, or a hash where they may be."""

    def __init__(self, lang: str, known: dict[bytes, int], hashed: bool):
        super().__init__(known)
        self[_BREAK] = -1
        self.lang, self.hashed = lang, hashed

    def __missing__(self, word: bytes) -> int:
        return hashed_id(self.lang, word) if self.hashed else -1


def places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pivot, words [n, 6], count) of the numbers x of a text, -1 between pieces: three words on the left and three on the right, -1 beyond the end.

    On the left only words that are less rare than the pivot, on the right also the pivot itself. Places with a
    neighbour only; equal ones together, by pivot.
    """
    n, half = len(x), LONGEST - 1
    y = np.concatenate((np.full(half, -1), x, np.full(half, -1)))
    cols = np.full((n, 2 * half), -1, dtype=np.int64)
    for side, step in ((0, -1), (1, 1)):
        ok = x >= 0
        for d in range(1, half + 1):
            v = y[half + step * d : half + step * d + n]
            ok = ok & (v >= 0) & ((v < x) if side == 0 else (v <= x))
            cols[:, half - d if side == 0 else half + d - 1] = np.where(ok, v, -1)
    keep = np.flatnonzero((x >= 0) & ((cols[:, half - 1] >= 0) | (cols[:, half] >= 0)))
    pivot, cols = x[keep], cols[keep]
    mixed = np.zeros(len(keep), dtype=np.uint64)
    for c in range(2 * half):
        mixed = (mixed ^ cols[:, c].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.lexsort((mixed, pivot))
    pivot, cols = pivot[order], cols[order]
    new = np.ones(len(pivot), dtype=bool)
    new[1:] = (pivot[1:] != pivot[:-1]) | (cols[1:] != cols[:-1]).any(axis=1)
    first = np.flatnonzero(new)
    return pivot[first], cols[first], np.diff(np.append(first, len(pivot)))


def _router(known, floor: int, least: int):
    """Rows (lang, pivot, salt, whole, width, places): what one portion of the text holds for a pivot."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, freq = known.value
        numbers: dict[str, _Numbers] = {}
        held: dict[str, list[np.ndarray]] = defaultdict(list)
        portion = TaskContext.get().partitionId() * 7919
        sizes: Counter = Counter()

        def out(lang: str) -> pa.RecordBatch:
            nonlocal portion
            portion += 1
            pivot, cols, n = places(np.concatenate(held.pop(lang)))
            del sizes[lang]
            width = 4 if max(pivot.max(initial=0), n.max(initial=0)) < 1 << 31 else 8
            flat = np.concatenate((cols, n[:, None]), axis=1).astype(f"<i{width}")
            first = np.flatnonzero(np.diff(pivot, prepend=-1))
            own = pivot[first]
            most = np.where(own < len(freq), freq[np.minimum(own, max(0, len(freq) - 1))] if len(freq) else 0, floor)
            salts = -(-most // PLACES)
            offsets = np.append(first, len(pivot)) * flat.shape[1] * width
            blob = pa.Array.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(flat.tobytes())]).cast(pa.binary())
            mixed = np.uint64(portion * 0x9E3779B97F4A7C15 % (1 << 64) >> 33)
            arrays = [pa.array([lang] * len(own), pa.string()), pa.array(own, pa.int64()), pa.array((mixed % np.maximum(1, salts).astype(np.uint64)).astype(np.int32), pa.int32())]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(salts <= 1), pa.array(np.full(len(own), width, dtype=np.int32)), blob], ["lang", "pivot", "salt", "whole", "width", "places"])

        for batch in batches:
            for lang, raw in _raw(batch):
                if lang not in numbers:
                    numbers[lang] = _Numbers(lang, ids.get(lang, {}), floor > least)
                number = numbers[lang].__getitem__
                for tokens in tokens_of(raw):
                    if tokens:
                        tokens.append(_BREAK)
                        held[lang].append(np.fromiter(map(number, tokens), np.int64, len(tokens)))
                        sizes[lang] += len(tokens)
                    if sizes[lang] >= TOKENS:
                        yield out(lang)
                if sizes.total() >= 2 * TOKENS:  # many languages
                    for each in list(held):
                        yield out(each)
        for each in list(held):
            yield out(each)

    return route


def mined(pivot: np.ndarray, cols: np.ndarray, n: np.ndarray, whole: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """[(phrases [m, words], counts)] of the pivots' own phrases. Where all places of a pivot are here (whole), only frequent ones."""
    names = None
    if max(pivot.max(initial=0), cols.max(initial=0)) >= 1 << 31:
        names, small = np.unique(np.concatenate((pivot, cols.ravel())), return_inverse=True)
        small = np.where(names < 0, -1, np.arange(len(names)) - (names[0] < 0))[small]
        names = names[names >= 0]
        pivot, cols = small[: len(pivot)], small[len(pivot) :].reshape(cols.shape)
    l3, l2, l1, r1, r2, r3 = cols.T
    found = []

    def grown(prefix: np.ndarray, phrases: np.ndarray | None, word: np.ndarray, ok: np.ndarray, left: bool) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the phrases that are one word longer, -1 where there is none or it is not frequent; and those phrases."""
        at = np.flatnonzero(ok & (prefix >= 0) & (word >= 0))
        key, first, inverse = np.unique((prefix[at] << 32) | word[at], return_index=True, return_inverse=True)
        count = np.bincount(inverse, weights=n[at], minlength=len(key)).astype(np.int64)
        keep = (count >= least) | ~whole[at][first]
        code = np.full(len(prefix), -1, dtype=np.int64)
        code[at] = np.where(keep, np.cumsum(keep) - 1, -1)[inverse]
        key = key[keep]
        old = (key >> 32)[:, None] if phrases is None else phrases[key >> 32]
        new = (key & 0xFFFFFFFF)[:, None]
        longer = np.concatenate((new, old) if left else (old, new), axis=1)
        if len(longer):
            found.append((longer if names is None else names[longer], count[keep]))
        return code, longer

    yes = np.ones(len(pivot), dtype=bool)
    a1, pa1 = grown(pivot, None, l1, yes, True)
    b1, pb1 = grown(pivot, None, r1, yes, False)
    a2, pa2 = grown(a1, pa1, l2, yes, True)
    b2, pb2 = grown(b1, pb1, r2, yes, False)
    c11, pc11 = grown(a1, pa1, r1, b1 >= 0, False)
    grown(a2, pa2, l3, yes, True)
    grown(b2, pb2, r3, yes, False)
    grown(a2, pa2, r1, c11 >= 0, False)
    grown(c11, pc11, r2, b2 >= 0, False)
    return found


def _miner(least: int):
    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last, lang = [], 0, None, None

        def out() -> Iterator[pa.RecordBatch]:
            flat = [np.frombuffer(raw, dtype=f"<i{width}").reshape(-1, 2 * LONGEST - 1) for _, _, width, raw in rows]
            each = [len(f) for f in flat]
            pivot, whole = np.repeat([r[0] for r in rows], each), np.repeat([r[1] for r in rows], each)
            every = np.concatenate(flat).astype(np.int64)
            for phrases, n in mined(pivot, every[:, :-1], every[:, -1], whole, least):
                ends = np.arange(len(n) + 1, dtype=np.int32) * phrases.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.ListArray.from_arrays(pa.array(ends), pa.array(phrases.ravel(), pa.int64())), pa.array(n, pa.int64())], ["lang", "ids", "n"])

        for batch in batches:
            for own, pivot, whole, width, raw in zip(*(batch.column(c).to_pylist() for c in ("lang", "pivot", "whole", "width", "places"))):
                if rows and (own != lang or pivot != last and size >= PLACES // 2 or not rows[-1][1] and size >= PLACES):
                    yield from out()
                    rows, size = [], 0
                rows.append((pivot, whole, width, raw))
                last, lang, size = pivot, own, size + len(raw) // (width * (2 * LONGEST - 1))
        if rows:
            yield from out()

    return mine


def word_counts(df: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(lang, word, n) of all words of df, stored; a null language is und."""
    docs = df.select(F.coalesce(named(lang_col).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text_col).alias("text"))
    return stored(docs.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "word-counts")


def phrase_counts(df: DataFrame, words: DataFrame, least: int, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, ids, n) of the phrases of 2 to 4 words that stand `least` times or more, and (id, lang, word, n) of the words that do; both stored."""
    spark = df.sparkSession
    frequent = words.filter(F.col("n") >= least)
    total, many = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], frequent.count()
    floor = least if many <= TABLE else max(least, total // TABLE + 1)  # fewer than TABLE words stand so often
    table = sorted(frequent.filter(F.col("n") >= floor).collect(), key=lambda r: (-r.n, r.lang, r.word))
    ids: dict[str, dict[bytes, int]] = defaultdict(dict)
    for k, r in enumerate(table):
        ids[r.lang][r.word.encode()] = k
    known = spark.sparkContext.broadcast((dict(ids), np.array([r.n for r in table], dtype=np.int64)))
    numbered = spark.createDataFrame([(k, r.lang, r.word, r.n) for k, r in enumerate(table)], "id long, lang string, word string, n long")
    if floor > least:
        number = F.pandas_udf(lambda lang, word: pd.Series([hashed_id(a, b.encode()) for a, b in zip(lang, word)], dtype="int64"), "long")
        numbered = numbered.unionByName(frequent.filter(F.col("n") < floor).select(number("lang", "word").alias("id"), "lang", "word", "n"))
    numbered = stored(numbered, "numbered-words")

    docs = df.select(F.coalesce(named(lang_col).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text_col).alias("text"))
    routed = docs.mapInArrow(_router(known, floor, least), "lang string, pivot long, salt int, whole boolean, width int, places binary")
    tasks = max(spark.sparkContext.defaultParallelism, ceil(total / PLACES))  # so that a task's share does not grow with the corpus
    routed = routed.repartition(tasks, "pivot", "salt").sortWithinPartitions("lang", "pivot", "salt")
    counts = routed.mapInArrow(_miner(least), "lang string, ids array<long>, n long").groupBy("lang", "ids").agg(F.sum("n").alias("n"))
    return stored(counts.filter(F.col("n") >= least), "phrase-counts"), numbered


def wide(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(25,0)")


def collocations(df: DataFrame, *, lang_col: str = "lang", text_col: str = "text", least: int = 30, inside: int = 80, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of 2 to 4 words.

    Texts, A-Z in lower case, are cut at .,;:!? and line ends into pieces, these at spaces and tabs into words. n counts
    the language's words, a the phrase's places within pieces, overlapping ones included; phrases of `least` or more
    places are candidates. The cut of a candidate whose floor(2000000 * a / (l + r)) is least counts (the earliest of
    such), l and r being the counts of its parts. Candidates that stand within a longer one of `inside` % of their count
    or more go. Order: score, a, then the phrase by its UTF-8 bytes. Each row of df counts by itself, repeated or not;
    null texts are empty; null languages are und; long texts are read whole; other columns of df play no part, whatever
    their names; an empty df gives an empty result.
    """
    words = word_counts(df, lang_col, text_col)
    counts, numbered = phrase_counts(df, words, least, lang_col, text_col)
    known = counts.select("ids", "n").unionByName(numbered.select(F.array("id").alias("ids"), "n"))
    cuts = counts.select("lang", "ids", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.select("*", F.slice("ids", F.lit(1), F.col("k")).alias("left"), F.expr("slice(ids, k + 1, size(ids) - k)").alias("right"))
    cuts = cuts.join(known.select(F.col("ids").alias("left"), F.col("n").alias("l")), "left").join(known.select(F.col("ids").alias("right"), F.col("n").alias("r")), "right")
    cuts = cuts.withColumn("score", F.expr("cast(2000000 as decimal(10,0)) * cast(a as decimal(25,0)) div (cast(l as decimal(25,0)) + cast(r as decimal(25,0)))"))
    best = cuts.groupBy("lang", "ids").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("b")).select("lang", "ids", "b.*")

    parts = ", ".join(f"IF(size(ids) > {m}, transform(sequence(1, size(ids) - {m} + 1), i -> slice(ids, i, {m})), array())" for m in range(2, LONGEST))
    within = counts.filter(F.size("ids") > 2).select(F.explode(F.expr(f"concat({parts})")).alias("ids"), "n").groupBy("ids").agg(F.max("n").alias("longer"))
    gone = F.col("longer").isNotNull() & (wide("longer") * 100 >= wide("a") * inside)
    kept = best.join(within, "ids", "left").filter(~gone)

    first = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc())
    kept = stored(kept.withColumn("place", F.rank().over(first)).filter(F.col("place") <= top).drop("place", "k", "longer"), "top-phrases")
    named_ = kept.select("ids", F.posexplode("ids").alias("at", "id")).join(numbered.select("id", "word"), "id")
    named_ = named_.groupBy("ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    out = kept.join(named_, "ids").withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top).join(total, "lang")
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_pivot_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


OP12_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
f AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS m)) GROUP BY ALL),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 30),
k AS (SELECT c.*, k, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f::HUGEINT + y.f))::BIGINT AS score FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
s AS (SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest(range(1, m - j + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS j) WHERE j < m) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b LEFT JOIN s USING (lang, phrase) JOIN n USING (lang) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
