"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from all training documents. Weights are learnt by follow-the-regularised-leader with
elastic-net penalties, on a bounded sample of labelled rows, in a fixed number of shares whose weights are then
averaged; a temperature fitted on another part of the sample calibrates the probabilities. Only text and label are used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhound.llm.common import crc32_mod, documents, stored

#: Hashed features (a power of two), n-gram lengths, characters taken at a time, and places of these worked on at once.
BITS, LENGTHS, CHUNK, PIECE = 16, (1, 2, 3), 500_000, 1 << 17
#: The prediction where there is no letter.
NONE = "und"


@dataclass(frozen=True)
class Settings:
    """sample: most labelled rows for the weights (four fifths) and the temperature (one fifth), the languages alike."""

    sample: int = 8000
    shares: int = 6
    epochs: int = 3
    batch: int = 32
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-3
    l2: float = 1e-3
    scale: float = 100.0


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all the texts, each between two line ends, and each text's first place in them.

    A text's n-grams stand together: for each place in it, those of every length that start there and end in it.
    """
    parts = ["\n" + t.lower() + "\n" for t in texts]
    code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum(np.fromiter((len(p) for p in parts), dtype=np.int64, count=len(parts)))
    n = len(code)
    out = np.full((n, len(LENGTHS)), 1 << BITS, dtype=np.int32)  # the last number: no n-gram
    for at in range(0, n, PIECE):  # a very long text needs no more than its codes and places at once
        own = code[at : at + PIECE + max(LENGTHS) - 1].astype(np.uint64)
        h = np.zeros(len(own), dtype=np.uint64)
        for k in range(1, max(LENGTHS) + 1):
            h = h[: len(own) - k + 1] * np.uint64(0x9E3779B97F4A7C15) + own[k - 1 :] + np.uint64(k)
            if k in LENGTHS:
                x = h[:PIECE] ^ (h[:PIECE] >> np.uint64(29))
                out[at : at + len(x), LENGTHS.index(k)] = ((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int32)
    for k in LENGTHS:
        for back in range(1, k):  # those that would run into the next text
            out[ends - back, LENGTHS.index(k)] = 1 << BITS
    return out, np.r_[0, ends[:-1]]


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size < CHUNK):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def document_frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """For each feature the number of training documents (text) that have it, and the number of them all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, docs = np.zeros((1 << BITS) + 1, dtype=np.int64), 0
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in chunks(texts):
                grams, starts = ngrams(texts[a:b])
                for own in np.split(grams, starts[1:]):
                    df[np.unique(own.astype(np.int32).ravel())] += 1
                docs += b - a
        df[-1] = docs
        yield pd.DataFrame({"feature": np.arange(len(df)), "n": df}).query("n > 0")

    rows = train.select("text").mapInPandas(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()  # at most 2 ** BITS + 1 rows
    out = np.zeros((1 << BITS) + 1, dtype=np.int64)
    for feature, n in rows:
        out[feature] = n
    return out[:-1], int(out[-1])


def learnt(sample: DataFrame, idf: np.ndarray, langs: list[str], s: Settings) -> np.ndarray:
    """Weights [feature, language], the last row the biases, learnt in s.shares shares and averaged."""
    index = {x: k for k, x in enumerate(langs)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs, labels = [], []
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in chunks(texts):
                grams, starts = ngrams(texts[a:b])
                for own in np.split(grams, starts[1:]):
                    f, n = np.unique(own[own < 1 << BITS], return_counts=True)
                    docs.append((f, n * idf[f] * (s.scale / n.sum())))
            labels += [index[x] for x in batch["lang"]]
        if not docs:
            return
        k, bias = len(langs), 1 << BITS
        z, g2 = np.zeros((bias + 1, k)), np.zeros((bias + 1, k))

        def weights(f: np.ndarray) -> np.ndarray:
            zf = z[f]
            return np.where(np.abs(zf) <= s.l1, 0.0, (np.sign(zf) * s.l1 - zf) / ((s.beta + np.sqrt(g2[f])) / s.alpha + s.l2))

        for epoch in range(s.epochs):
            order = np.random.default_rng(epoch).permutation(len(docs))
            for at in range(0, len(order), s.batch):
                own = order[at : at + s.batch]
                rows = np.repeat(np.arange(len(own)), [len(docs[i][0]) + 1 for i in own])
                f = np.concatenate([np.r_[docs[i][0], bias] for i in own])
                x = np.concatenate([np.r_[docs[i][1], 1.0] for i in own])
                used, place = np.unique(f, return_inverse=True)
                w = weights(used)
                logits = np.stack([np.bincount(rows, x * w[place, c], len(own)) for c in range(k)], axis=1)
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(own)), [labels[i] for i in own]] -= 1
                g = np.stack([np.bincount(place, x * p[rows, c], len(used)) for c in range(k)], axis=1) / len(own)
                sigma = (np.sqrt(g2[used] + g * g) - np.sqrt(g2[used])) / s.alpha
                z[used] += g - sigma * w
                g2[used] += g * g
        w = weights(np.arange(bias + 1))
        f, c = np.nonzero(w)
        yield pd.DataFrame({"feature": f, "c": c, "w": w[f, c]})
        yield pd.DataFrame({"feature": [-1], "c": [0], "w": [1.0]})

    shares = sample.withColumn("share", F.pmod(F.xxhash64("text", F.lit(3)), F.lit(s.shares))).repartition(s.shares, "share").sortWithinPartitions("share", "text").select("text", "lang")
    rows = shares.mapInPandas(run, "feature int, c int, w double").groupBy("feature", "c").agg(F.sum("w").alias("w")).orderBy("feature", "c").collect()  # bounded by features and languages
    weights, parts = np.zeros(((1 << BITS) + 1, len(langs))), 1.0
    for feature, c, w in rows:
        if feature < 0:
            parts = w
        else:
            weights[feature, c] = w
    return weights / parts


@dataclass(frozen=True)
class Model:
    """table: weight times idf of each feature and, last, of no n-gram; one column for each language."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    scale: float
    temperature: float

    def logits(self, texts: list[str]) -> np.ndarray:
        out = []
        for a, b in chunks(texts):
            grams, starts = ngrams(texts[a:b])
            total, number = np.zeros((b - a, len(self.langs))), np.zeros(b - a, dtype=np.int64)
            for at in range(0, len(grams), PIECE):
                own = grams[at : at + PIECE]
                first = int(np.searchsorted(starts, at, side="right")) - 1  # the text that goes on here
                cut = np.r_[0, starts[first + 1 : int(np.searchsorted(starts, at + len(own)))] - at].astype(np.int64)
                here = slice(first, first + len(cut))
                total[here] += np.add.reduceat(sum(self.table[own[:, k]] for k in range(own.shape[1])), cut, axis=0)
                number[here] += np.add.reduceat((own < 1 << BITS).sum(axis=1), cut)
            out.append(total * (self.scale / number)[:, None] + self.bias)
        return np.concatenate(out) if out else np.zeros((0, len(self.langs)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [NONE] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t is not None and has_letter(t)] if self.langs else []
        logits = self.logits([texts[i] for i in known]) / self.temperature if known else np.zeros((0, 1))
        p = np.exp(logits - logits.max(axis=1, keepdims=True)) if known else logits
        for i, row in zip(known, p):
            best = int(row.argmax())
            langs[i], scores[i] = self.langs[best], float(row[best] / row.sum())
        return langs, scores


def fit(train: DataFrame, settings: Settings = Settings()) -> Model:
    """train: doc_id, text and lang, the last two not null. Without any row the model knows no language and predicts `und`.

    The id only helps to draw the sample: by the text alone, a text with many copies would come with all of them.
    """
    spark = train.sparkSession
    train = train.filter("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    counts = {r[0]: r[1] for r in train.groupBy("lang").count().collect()}  # as many rows as there are languages
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros(((1 << BITS) + 1, 0)), np.zeros(0), settings.scale, 1.0)
    df, n = document_frequencies(train)
    idf = np.log((1 + n) / (1 + df)) + 1
    each = settings.sample // len(langs)
    share = spark.createDataFrame([(x, min(1.0, each / counts[x]) * 1_000_000) for x in langs], "lang string, most double")
    drawn = train.join(F.broadcast(share), "lang").filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < F.col("most"))
    drawn = stored(drawn.withColumn("fold", F.pmod(F.xxhash64("text", F.lit(1)), F.lit(5))).select("text", "lang", "fold"), "language-sample")
    weights = learnt(drawn.filter("fold > 0"), idf, langs, settings)
    table = np.vstack([weights[:-1] * idf[:, None], np.zeros((1, len(langs)))])
    model = Model(langs, table, weights[-1], settings.scale, 1.0)
    return Model(langs, table, weights[-1], settings.scale, temperature(drawn.filter("fold = 0"), model))


def temperature(held: DataFrame, model: Model) -> float:
    """The temperature under which the labels of the held-out part of the sample are most probable."""
    shared = held.sparkSession.sparkContext.broadcast(model)
    kinds = {x: k for k, x in enumerate(model.langs)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"logits": list(shared.value.logits(batch["text"].tolist())), "lang": batch["lang"]})

    rows = held.mapInPandas(run, "logits array<double>, lang string").collect()  # a fifth of the bounded sample
    if not rows:
        return 1.0
    logits, label = np.array([r[0] for r in rows]), np.array([kinds[r[1]] for r in rows])

    def loss(t: float) -> float:
        x = logits / t
        x = x - x.max(axis=1, keepdims=True)
        return float((np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(x)), label]).mean())

    return float(min(np.geomspace(0.05, 20, 241), key=loss))


def identify(df: DataFrame, model: Model, *, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "lang_score") -> DataFrame:
    """df with the predicted language and its calibrated probability; null texts and those without a letter: und, 0.

    Texts are read whole; every other column stays as it is, but lang_col and score_col, which must be new names.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by features and languages

    @F.pandas_udf("lang string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        langs, scores = shared.value.predict(texts.tolist())
        return pd.DataFrame({"lang": langs, "score": scores})

    return df.withColumn("_said", predicted(F.col(text_col))).select(*df.columns, F.col("_said.lang").alias(lang_col), F.col("_said.score").alias(score_col))


def training(docs: DataFrame) -> DataFrame:
    return docs.filter((crc32_mod(F.col("doc_id"), 3) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")


def accepted(df: DataFrame, *, least: float = 0.3) -> DataFrame:
    """The rows of df in a known language. Rejected are null texts, texts without a letter and predictions under `least`."""
    model = fit(training(df))
    if not model.langs:  # nothing is known of any language: only texts without a letter can be rejected
        return df.filter(F.col("text").rlike(r"\p{L}"))
    return identify(df, model, lang_col="_lang_pred", score_col="_lang_score").filter((F.col("_lang_pred") != NONE) & (F.col("_lang_score") >= least)).select(*df.columns)


def op10_ftrl_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), fit(training(docs)), score_col="score")
    return out.select("doc_id", (crc32_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
