"""Language-model scoring with a probabilistic suffix tree.

The tree's symbols are the bytes of a text's words, joined by one space, and an end. Contexts of up to DEPTH symbols
are counted over all training texts. A context is a node when it is frequent (at least `least` of all positions, so
that there are no more than 1 / least nodes of each length, whatever the corpus) and its next-symbol distribution
diverges from that of its longest proper suffix. Distributions are smoothed towards that suffix's. A position is scored
by the longest suffix of what stands before it that is a node. As words and the joined bytes determine each other, the
score is the log10 probability of the text's token sequence, as the unigram base score is.

Above these short contexts, whose number is bounded so that each task can hold them, stand long ones, whose number grows
with the corpus: a text is a sequence of phrases, and the phrase before one is its context where training positions,
each predicted from all others, diverge enough from the bytes' prediction. They are found and looked up by joins.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhound.llm.common import crc32_mod, documents, join_by_group, stored, text_or_empty
from tallyhound.sources.tables import passing

#: Longest context; bits of a symbol code (0: end, 1: any rare byte, others: the frequent bytes).
DEPTH, BITS = 6, 6
CODES = 1 << BITS
#: Positions scored one after the other in one row of the arrays, and bytes of text taken at a time.
SPAN, CHUNK = 256, 1_000_000
#: Last byte of a word that ends a phrase.
STOPS = np.isin(np.arange(256), list(b".!?"))
#: Hash of a phrase: a polynomial in MULTIPLIER over a random number for each byte, modulo 2^64.
MULTIPLIER = 0x9E3779B97F4A7C15
VALUES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


@dataclass(frozen=True)
class Settings:
    """least: share of all positions that a context must have. gain: nats by which its own distribution must describe its
    positions better than its suffix's. weight: of the suffix's distribution, in positions. common: words with over
    1 / common of all training tokens are looked up in each task, the others by a join. phrase: words after which a
    phrase ends at the latest. phrase_weight: of the bytes' prediction of a phrase after a phrase, in positions."""

    least: float = 4e-6
    gain: float = 10.0
    weight: float = 16.0
    common: int = 200_000
    phrase: int = 16
    phrase_weight: float = 1.0


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def chunked(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size < CHUNK):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def word_counts(train: DataFrame) -> DataFrame:
    """(word, byte, n): how often each word and each byte of the joined words occurs in the training texts (text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[bytes] = Counter()
        letters = np.zeros(256, dtype=np.int64)

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({"word": list(seen.keys()), "byte": -1, "n": list(seen.values())})
            seen.clear()
            return out

        for batch in batches:
            for text in batch["text"]:
                words = words_of(text)
                seen.update(words)
                letters += np.bincount(np.frombuffer(b" ".join(words), dtype=np.uint8), minlength=256)
                if len(seen) > 150_000:
                    yield flush()
        yield flush()
        yield pd.DataFrame({"word": [b""] * 256, "byte": range(256), "n": letters}).query("n > 0")

    return train.select("text").mapInPandas(run, "word binary, byte int, n long").groupBy("word", "byte").agg(F.sum("n").alias("n"))


def alphabet(letters: dict[int, int]) -> np.ndarray:
    """The code of each byte: the most frequent bytes have their own, by count and then by value."""
    best = sorted((b for b in range(256) if b != 10), key=lambda b: (-letters.get(b, 0), b))[: CODES - 2]
    code = np.ones(256, dtype=np.uint8)
    code[np.array(sorted(best))] = np.arange(2, CODES)
    code[10] = 0  # a line end is never within joined words: it marks the text's end and, repeated, what is before it
    return code


def streamed(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, each after DEPTH ends and before one; the place of each text's first byte, and of its last end."""
    parts = [b"\n" * DEPTH + b" ".join(w) + b"\n" for w in texts]
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(sizes)
    return np.frombuffer(b"".join(parts), dtype=np.uint8), ends - sizes + DEPTH, ends - 1


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def phrases(raw: np.ndarray, first: np.ndarray, last: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The first and last byte, the text and the hash of each phrase of the streamed texts, in order.

    A phrase ends with a word that ends in a stop, with its `most`th word and with the text.
    """
    word_end = raw == 32
    word_end[last] = True
    ends = np.flatnonzero(word_end)
    stop = STOPS[raw[ends - 1]] | (raw[ends] == 10)
    at = np.arange(len(ends))
    before = np.r_[-1, np.maximum.accumulate(np.where(stop, at, -1))[:-1]] if len(ends) else at
    close = ends[stop | ((at - before) % most == 0)]
    owner = np.searchsorted(last, close)
    head = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else owner.astype(bool)
    opening = np.where(head, first[owner], np.r_[0, close[:-1] + 1] if len(close) else close)
    power = np.full(len(raw) + 1, MULTIPLIER, dtype=np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    back = np.full(len(raw) + 1, pow(MULTIPLIER, -1, 1 << 64), dtype=np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    sums = sums_of(VALUES[raw] * power[:-1], opening, close)
    return opening, close, owner, mixed(sums * back[opening])


def sums_of(values: np.ndarray, opening: np.ndarray, close: np.ndarray) -> np.ndarray:
    """The sum of values[opening..close] for each of these ranges, which are in order and do not overlap."""
    bounds = np.stack([opening, close + 1], axis=1).ravel()
    return np.add.reduceat(np.append(values, values.dtype.type(0)), bounds)[::2] if len(bounds) else values[:0]


#: Grams that a task adds up before it passes counts on: 16 bytes each, and as much again two times while they are merged.
GRAMS_HELD = 4_000_000


def gram_counts(train: DataFrame, code: np.ndarray) -> DataFrame:
    """(gram, n) of the DEPTH codes before each training position and the one that stands there, six bits each."""

    def merged(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        all_grams, all_counts = np.concatenate(grams), np.concatenate(counts)
        order = np.argsort(all_grams, kind="stable")
        all_grams, all_counts = all_grams[order], all_counts[order]
        first = np.flatnonzero(np.r_[True, all_grams[1:] != all_grams[:-1]])
        return all_grams[first], np.add.reduceat(all_counts, first)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, counts = [], []
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in chunked(texts):
                raw, first, last = streamed([words_of(t) for t in texts[a:b]])
                codes = code[raw].astype(np.int64)
                n = len(codes) - DEPTH
                gram = np.zeros(n, dtype=np.int64)
                for k in range(DEPTH + 1):
                    gram = (gram << BITS) | codes[k : k + n]
                scored = np.zeros(n + 1, dtype=np.int64)
                np.add.at(scored, first - DEPTH, 1)
                np.add.at(scored, last + 1 - DEPTH, -1)
                g, c = np.unique(gram[np.cumsum(scored[:-1]) > 0], return_counts=True)
                grams.append(g)
                counts.append(c)
                if sum(map(len, grams)) > GRAMS_HELD:
                    g, c = merged(grams, counts)
                    grams, counts = [g], [c]
                    if len(g) > GRAMS_HELD // 2:
                        yield pd.DataFrame({"gram": g, "n": c})
                        grams, counts = [], []
        if grams:
            g, c = merged(grams, counts)
            yield pd.DataFrame({"gram": g, "n": c})

    return train.select("text").mapInPandas(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def tree_nodes(grams: DataFrame, s: Settings) -> DataFrame:
    """(depth, context, symbol, n) of the nodes, the root (depth 0) and all suffixes of nodes among them."""
    level = grams
    levels = []
    for depth in range(DEPTH, -1, -1):  # the counts of each length come from those of the next
        if depth < DEPTH:
            level = level.groupBy(F.col("gram").bitwiseAND((1 << (BITS * (depth + 1))) - 1).alias("gram")).agg(F.sum("n").alias("n"))
        level = stored(level, f"grams-{depth}")
        levels.append(level.withColumn("depth", F.lit(depth)))
    counts = reduce(DataFrame.unionByName, levels).select("depth", F.shiftright("gram", BITS).alias("context"), F.col("gram").bitwiseAND(CODES - 1).cast("int").alias("symbol"), "n")
    totals = counts.groupBy("depth", "context").agg(F.sum("n").alias("total"))
    positions = totals.filter("depth = 0").agg(F.sum("total")).first()[0] or 0
    frequent = totals.filter((F.col("depth") == 0) | (F.col("total") >= max(1.0, s.least * positions)))  # at most DEPTH / least + 1 rows
    entries = stored(counts.join(F.broadcast(frequent), ["depth", "context"]), "suffix-tree-entries")
    suffix = entries.select((F.col("depth") + 1).alias("depth"), F.col("context").alias("suffix"), "symbol", F.col("n").alias("sn"), F.col("total").alias("st"))
    child = entries.filter("depth > 0").withColumn("suffix", F.col("context").bitwiseAND(F.expr(f"shiftleft(1L, {BITS} * (depth - 1)) - 1")))
    gain = child.join(suffix, ["depth", "suffix", "symbol"]).groupBy("depth", "context").agg(F.sum(F.expr("n * ln((n / total) / (sn / st))")).alias("gain"))
    kept = gain.filter(F.col("gain") >= s.gain).select(F.explode(F.sequence(F.lit(1), F.col("depth"))).alias("depth"), "context")
    kept = kept.select("depth", F.col("context").bitwiseAND(F.expr(f"shiftleft(1L, {BITS} * depth) - 1")).alias("context")).distinct()
    kept = kept.unionByName(entries.filter("depth = 0").select("depth", "context").distinct())
    return entries.join(kept, ["depth", "context"], "left_semi").select("depth", "context", "symbol", "n")


class Tree:
    """The suffix tree as an automaton: the state after a symbol, and log10 of each symbol's probability in a state.

    States are the nodes and all parts of their contexts, which are needed to follow a text; a state that is no node has
    the distribution of its longest suffix that is one.
    """

    def __init__(self, nodes: pd.DataFrame, code: np.ndarray, letters: dict[int, int], s: Settings):
        self.code = code
        nodes = nodes.sort_values(["depth", "context", "symbol"])
        rare = [b for b in range(256) if code[b] == 1]
        seen = sum(letters.get(b, 0) for b in rare)
        self.rare = np.zeros(256)
        for b in rare:
            self.rare[b] = np.log10((letters.get(b, 0) + 0.5) / (seen + 0.5 * len(rare)))
        depth, context = nodes["depth"].to_numpy(np.int64), nodes["context"].to_numpy(np.int64)
        own = [np.unique(context[depth == d]) for d in range(DEPTH + 1)]
        states = [np.zeros(1, dtype=np.int64)]
        for d in range(1, DEPTH + 1):
            parts = [(own[e] >> (BITS * up)) & ((1 << (BITS * d)) - 1) for e in range(d, DEPTH + 1) for up in range(e - d + 1)]
            states.append(np.unique(np.concatenate(parts)))
        first = np.cumsum([0, *map(len, states)])
        # the state after a symbol and its log10 side by side, so that a step reads one place of a table that no cache holds
        table = np.zeros((first[-1], CODES), dtype=[("next", np.int32), ("log", np.float32)])
        following, probability = table["next"], table["log"]

        def place(d: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if not len(states[d]):
                return np.zeros(keys.shape, dtype=np.int64), np.zeros(keys.shape, dtype=bool)
            at = np.minimum(np.searchsorted(states[d], keys), len(states[d]) - 1)
            return first[d] + at, states[d][at] == keys

        symbols = np.arange(CODES, dtype=np.int64)
        symbol, count = nodes["symbol"].to_numpy(np.int64), nodes["n"].to_numpy(np.float64)
        for d in range(DEPTH + 1):
            mine = np.flatnonzero(depth == d)
            row = np.searchsorted(states[d], context[mine])
            for lo in range(0, len(states[d]), 4096):  # a few states at a time, to bound what each worker needs
                keys = states[d][lo : lo + 4096]
                at = slice(first[d] + lo, first[d] + lo + len(keys))
                if d:
                    up = place(d - 1, keys & ((1 << (BITS * (d - 1))) - 1))[0]
                    p, fall = probability[up].astype(np.float64), following[up]
                else:
                    p, fall = np.full((1, CODES), 1.0 / CODES), np.zeros((1, CODES), dtype=np.int32)
                n = np.zeros((len(keys), CODES))
                some = slice(*np.searchsorted(row, [lo, lo + len(keys)]))
                n[row[some] - lo, symbol[mine[some]]] = count[mine[some]]
                weight = s.weight if d else CODES / 2
                probability[at] = (n + weight * p) / (n.sum(axis=1, keepdims=True) + weight)
                if d < DEPTH and len(states[d + 1]):
                    to, there = place(d + 1, (keys[:, None] << BITS) | symbols)
                    following[at] = np.where(there, to, fall)
                else:
                    following[at] = fall
        np.log10(probability, out=probability)
        self.step = table.ravel().view(np.int64)

    def positions(self, raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """log10 of the probability of each byte of the streamed texts, 0 before them. All texts are followed at once, in
        spans that start DEPTH symbols early."""
        codes = self.code[raw]
        sizes = last + 1 - first
        spans = -(-sizes // SPAN)
        owner = np.repeat(np.arange(len(first)), spans)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(spans) - spans, spans)
        begin = first[owner] + step * SPAN
        length = np.minimum(SPAN, last[owner] + 1 - begin)
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order] - DEPTH, length[order]
        state, out = np.zeros(len(begin), dtype=np.int64), np.zeros(len(raw))
        for t in range(DEPTH + int(length[0]) if len(length) else 0):
            m = len(begin) if t <= DEPTH else int(np.searchsorted(-length, DEPTH - t, side="left"))
            place = begin[:m] + t
            found = self.step[state[:m] * CODES + codes[place]].view(np.int32).reshape(-1, 2)
            if t >= DEPTH:
                out[place] = found[:, 1].view(np.float32)
            state[:m] = found[:, 0]
        return out + self.rare[raw]

    def score(self, texts: list[list[bytes]]) -> np.ndarray:
        """log10 of the probability of each text by the bytes' contexts."""
        raw, first, last = streamed(texts)
        return np.add.reduceat(self.positions(raw, first, last), first - DEPTH)

    def score_phrases(self, texts: list[list[bytes]], most: int) -> tuple[np.ndarray, list[list[np.ndarray]]]:
        """score(texts), and for each text hashes of the phrase before each phrase but the first, hashes of both, and
        log10 of the later one's probability by the bytes' contexts."""
        raw, first, last = streamed(texts)
        logs = self.positions(raw, first, last)
        opening, close, owner, own = phrases(raw, first, last, most)
        later = np.flatnonzero(owner[1:] == owner[:-1]) + 1
        before = own[later - 1]
        both = mixed(before * np.uint64(MULTIPLIER) + own[later])
        columns = [before.view(np.int64), both.view(np.int64), sums_of(logs, opening, close)[later].astype(np.float32)]
        cuts = np.searchsorted(owner[later], np.arange(len(texts) + 1))
        return np.add.reduceat(logs, first - DEPTH), [[c[a:b] for a, b in zip(cuts[:-1], cuts[1:])] for c in columns]


def phrase_contexts(after: DataFrame, s: Settings) -> DataFrame:
    """(context, total) of the phrases that are contexts, from all training positions (context, pair, own).

    Each position is predicted from its context's other positions, so that one that occurs once never passes, and from
    the bytes; the sum of the gains over the bytes' own prediction must reach s.gain nats. There is no other floor, so
    that the contexts grow with the corpus.
    """
    pairs = after.groupBy("pair").agg(F.min("context").alias("context"), F.count("*").alias("n"), F.avg("own").alias("own"))
    w = F.lit(s.phrase_weight)
    others = F.when(F.col("n") == 1, F.log(w)).otherwise(F.log(F.col("n") - 1 + w * F.pow(F.lit(10.0), "own")) - F.col("own") * F.log(F.lit(10.0)))
    sums = pairs.groupBy("context").agg(F.sum("n").alias("total"), F.sum(F.col("n") * others).alias("gain"))
    return sums.filter((F.col("total") > 1) & (F.col("gain") - F.col("total") * F.log(F.col("total") - 1 + w) >= s.gain)).select("context", "total")


def phrase_gains(after: DataFrame, s: Settings) -> DataFrame:
    """(row, more): what the phrases' contexts add to the score of each row of (row, held_out, context, pair, own) that has one."""
    contexts = stored(phrase_contexts(after.filter("NOT held_out").drop("row", "held_out"), s), "phrase-contexts")
    total = contexts.agg(F.sum("total")).first()[0] or 0
    found = stored(join_by_group(after, contexts, "context", "total", total).filter("total IS NOT NULL"), "phrases-in-context")
    seen = found.filter("NOT held_out").groupBy("pair").agg(F.count("*").alias("n"))
    found = join_by_group(found, seen, "pair", "n", total)
    w = F.lit(s.phrase_weight)
    p = F.when(F.col("n").isNull(), F.log10(w)).otherwise(F.log10(F.col("n") + w * F.pow(F.lit(10.0), "own")) - F.col("own"))
    return found.groupBy("row").agg(F.sum(p - F.log10(F.col("total") + w)).alias("more"))


#: The tree that this worker built last, by the name of its model: a worker scores many tasks of one model.
_BUILT: dict[str, Tree] = {}


def built(name: str, *model) -> Tree:  # noqa: ANN002
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Tree(*model)
    return _BUILT[name]


def lm_score(df: DataFrame, *, held_out: str = "held_out", id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per row of df: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose column `held_out` is false. Null text counts as empty: one token, the end. Texts are read
    whole; repeated rows count as often as they occur; extra columns of df are ignored; an empty df gives an empty result.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), F.col(held_out).alias("held_out"))
    train = docs.filter("NOT held_out")
    counts = stored(word_counts(train), "word-counts")
    words = counts.filter("byte < 0").select("word", "n")
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = train.count()
    tokens, kinds = total + ends, kinds + (ends > 0)
    letters = {r[0]: r[1] for r in counts.filter("byte >= 0").select("byte", "n").collect()}  # at most 256 rows
    code = alphabet(letters)
    with passing(spark):
        nodes = tree_nodes(gram_counts(train, code), settings).toArrow().to_pandas()  # bounded by settings.least
    whole = tokens + 0.5 * (kinds + 1)
    common = {bytes(r[0]): float(np.log10((r[1] + 0.5) / whole)) for r in words.filter(F.col("n") > tokens / settings.common).collect()}  # fewer than settings.common rows
    end = float(np.log10((ends + 0.5) / whole))
    shared, model = spark.sparkContext.broadcast((nodes, code, letters, settings, common)), uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes, code, letters, s, common = shared.value
        tree = built(model, nodes, code, letters, s)
        del nodes
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in chunked(texts):
                rows = []
                split = [words_of(t) for t in texts[a:b]]
                scores, after = tree.score_phrases(split, s.phrase)
                for words, score in zip(split, scores):
                    found = list(map(common.get, words))
                    known = [x for x in found if x is not None]
                    rare = Counter([w for w, x in zip(words, found) if x is None]) if len(known) < len(words) else {}
                    rows.append((len(words) + 1, len(known) + (ends > 0), sum(known) + end, float(score), list(rare.keys()), list(rare.values())))
                out = pd.DataFrame(rows, columns=["n_tokens", "n_known", "base", "score", "rare", "times"])
                for k, c in enumerate(("row", "doc_id", "held_out")):
                    out.insert(k, c, batch[c].to_numpy()[a:b])
                for c, values in zip(("context", "pair", "own"), after):
                    out[c] = values
                yield out

    kind = df.schema[id_col].dataType.simpleString()
    scored = docs.withColumn("row", F.monotonically_increasing_id()).mapInPandas(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<binary>, times array<long>, context array<long>, pair array<long>, own array<float>")
    scored = stored(scored, "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    found = rare.join(words, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sums = found.groupBy("row").agg(
        F.sum(F.col("times") * F.log10((F.col("n") + 0.5) / F.lit(float(whole)))).alias("rest"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rest_known")
    )
    after = scored.select("row", "held_out", F.explode(F.arrays_zip("context", "pair", "own")).alias("p")).select("row", "held_out", "p.*")
    more = phrase_gains(after, settings)
    out = scored.drop("rare", "times", "context", "pair", "own").join(sums, "row", "left").join(more, "row", "left").fillna(0, ["rest_known"]).fillna(0.0, ["rest", "more"])
    return out.select(
        F.col("doc_id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.col("rest_known")).alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("rest")).alias("base_score"), (F.col("score") + F.col("more")).alias("score"),
    )


def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return lm_score(docs.withColumn("held_out", crc32_mod(F.col("doc_id"), 5) == 1))
