"""BPE encoding and decoding by speculation and verification.

For words not seen before, greedy longest match proposes tokens; every adjacent pair of proposed tokens, of all those
words at once, is tested for compatibility in numpy arrays; a word whose pairs all pass is proved to be what merging
gives, and only the others are merged exactly. A pair is compatible when no merge across its border comes before the
merges that built its two sides; a sequence of tokens is the BPE encoding iff all its adjacent pairs are.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tallyhound.llm.common import documents

#: Words kept with their tokens in one Python worker, and characters of text taken at a time.
KNOWN_WORDS, CHUNK = 200_000, 4_000_000


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Codec:
    """A word-level BPE vocabulary with an end-of-word suffix, lower case, white space dropped."""

    def __init__(self, spec: dict):
        import regex

        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.said = {i: s.encode() for i, s in self.names.items()}
        letters = byte_letters()
        raw = {c: bytes([k]) for k, c in enumerate(letters)}
        self.letter = np.array([[self.vocab[c], self.vocab[c + self.suffix]] for c in letters])  # by byte: inside and at the end of a word
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        size = max(self.names) + 1
        # by token id: when it was made (single letters: before any merge) and of which two tokens
        self.made = np.full(size, -1, dtype=np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        pairs = np.array([(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in merges], dtype=np.int64)
        self.made[pairs[:, 2]] = np.arange(len(pairs))
        self.left[pairs[:, 2]], self.right[pairs[:, 2]] = pairs[:, 0], pairs[:, 1]
        self.size, self.result = size, pairs[:, 2].copy()
        keys = pairs[:, 0] * size + pairs[:, 1]
        order = np.argsort(keys)
        self.keys, self.order = keys[order], order
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split).findall
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # tokens that merging their own letters gives back, by their bytes; no others are ever proposed
        inner, final = {}, {}
        for t, i in self.vocab.items():
            if i not in self.special.values():
                body, at_end = (t[: -len(self.suffix)], True) if t.endswith(self.suffix) else (t, False)
                (final if at_end else inner)[b"".join([raw[c] for c in body])] = i
        self.inner, self.final = ({k: i for (k, i), ids in zip(d.items(), self.merged([*d], end)) if ids == [i]} for d, end in ((inner, 0), (final, 1)))
        self.reach: dict[bytes, int] = {}
        for k in self.inner:
            self.reach[k[:2]] = max(self.reach.get(k[:2], 1), len(k))

    def merged(self, words: list[bytes], end: int = 1) -> list[list[int]]:
        """Exact merging, of all words at once: in each round, each word's earliest merge, the leftmost where equal."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        out: list[list[int]] = [[] for _ in words]
        flat = self.letter[np.frombuffer(b"".join(words), dtype=np.uint8), 0].copy()
        owner = np.repeat(np.arange(len(words)), sizes)
        if end and len(flat):
            last = np.cumsum(sizes)[sizes > 0] - 1
            flat[last] = self.letter[np.frombuffer(b"".join(words), dtype=np.uint8)[last], 1]
        while len(flat):
            n = len(flat)
            rank = np.full(n, 1 << 40)
            inside = np.flatnonzero(owner[1:] == owner[:-1])
            rank[inside] = self.merge_rank(flat[inside], flat[inside + 1])
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            at = np.minimum.reduceat(rank * n + np.arange(n), starts)
            best, at = at // n, at % n
            go = best < (1 << 40)
            lengths = np.diff(np.r_[starts, n])
            for k, a, m in zip(owner[starts[~go]].tolist(), starts[~go].tolist(), lengths[~go].tolist()):
                out[k] = flat[a : a + m].tolist()
            flat[at[go]] = self.result[best[go]]
            stay = np.repeat(go, lengths)
            stay[at[go] + 1] = False
            flat, owner = flat[stay], owner[stay]
        return out

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], 1 << 40)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging would leave the border between tokens a and b alone, for arrays of both.

        Walks back through the merges that built the two tokens, the later one first: at each point of that history the
        two tokens beside the border must not have a merge that comes before the one just undone.
        """
        good = np.ones(len(a), dtype=bool)
        live, left, right = np.arange(len(a)), a.copy(), b.copy()
        before, tie = np.full(len(a), 1 << 41), np.ones(len(a), dtype=bool)
        while len(live):
            across = self.merge_rank(left, right)
            # the undone merge stood right of the border: an equal rank at the border, further left, would have come first
            bad = (across < before) | ((across == before) & tie)
            bad &= across < (1 << 40)
            good[live[bad]] = False
            on_left = self.made[left] >= self.made[right]
            before = np.where(on_left, self.made[left], self.made[right])
            tie = ~on_left
            left, right = np.where(on_left, self.right[left], left), np.where(on_left, right, self.left[right])
            go = ~bad & (before >= 0)
            live, left, right, before, tie = live[go], left[go], right[go], before[go], tie[go]
        return good

    def proposed(self, word: bytes) -> list[int]:
        """Greedy longest match; nothing where it comes to a letter that no proposable token starts with."""
        out, i, n, inner, final, reach = [], 0, len(word), self.inner, self.final, self.reach
        while True:
            if (t := final.get(word[i:])) is not None:
                out.append(t)
                return out
            for j in range(min(n - 1, i + reach.get(word[i : i + 2], 1)), i, -1):
                if (t := inner.get(word[i:j])) is not None:
                    out.append(t)
                    i = j
                    break
            else:
                return []

    def learn(self, words: list[str]) -> tuple[list[bytes], int]:
        """The ids of each word, and how many words had to be merged exactly."""
        spelt = [w.encode() for w in words]
        guesses = list(map(self.proposed, spelt))
        lengths = np.fromiter(map(len, guesses), dtype=np.int64, count=len(guesses))
        flat = np.fromiter(chain.from_iterable(guesses), dtype=np.int64, count=int(lengths.sum()))
        owner = np.repeat(np.arange(len(words)), lengths)
        border = np.flatnonzero(owner[1:] == owner[:-1])
        unique, back = np.unique(flat[border] * self.size + flat[border + 1], return_inverse=True)
        fits = self.compatible(unique // self.size, unique % self.size)
        fails = lengths == 0
        fails[owner[border[~fits[back]]]] = True
        again = np.flatnonzero(fails).tolist()
        for k, ids in zip(again, self.merged([spelt[k] for k in again])):
            guesses[k] = ids
        lengths = np.fromiter(map(len, guesses), dtype=np.int64, count=len(guesses))
        whole = np.fromiter(chain.from_iterable(guesses), dtype="<u4", count=int(lengths.sum())).tobytes()
        ends = (np.cumsum(lengths) * 4).tolist()
        return [whole[a:b] for a, b in zip([0, *ends], ends)], len(again)

    def split(self, text: str) -> list[str]:
        """Words of a text; special tokens, which are matched in the raw text, stand for themselves."""
        if "<|" not in text:
            return self.plain(text)
        out = []
        for k, part in enumerate(self.marks.split(text)):
            out += [part] if k % 2 else self.plain(part)
        return out

    def plain(self, text: str) -> list[str]:
        # lower case is taken letter by letter, so a final capital sigma has no form of its own
        return self.words(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def ids_of(self, words: set[str]) -> dict[str, bytes]:
        """The ids of some words. Words not asked for lately are forgotten, so that what is kept stays bounded."""
        young, old = self.young, self.old
        found = {w: young[w] for w in words & young.keys()}
        again = (words & old.keys()) - found.keys()
        found |= {w: old[w] for w in again}
        new = list(words - found.keys())
        fresh = dict(zip(new, self.learn(new)[0])) if new else {}
        if len(young) + len(again) + len(new) > KNOWN_WORDS:
            self.old, self.young = young, {}
        self.young |= {w: found[w] for w in again} | fresh
        return found | fresh | {s: np.array([i], dtype="<u4").tobytes() for s, i in self.special.items()}

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < CHUNK):
                size += len(texts[end])
                end += 1
            split = [self.split(t) for t in texts[at:end]]
            ids = self.ids_of(set().union(*split) - self.special.keys())
            for words in split:
                yield b"".join([ids[w] for w in words])
            at = end

    def decode(self, ids: bytes) -> bytes:
        """The tokens' strings with a space between them: this vocabulary has no decoder of its own."""
        return b" ".join([self.said[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    with open(path, encoding="utf-8") as f:
        return Codec(json.load(f))


def encode(df: DataFrame, *, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """One row per row of df: id_col, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids themselves.

    Null text counts as empty and has no token; texts are encoded whole; extra columns of df are ignored; an empty df
    gives an empty result. path is a vocabulary file that lies on every executor, as installed with its package.
    """
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for batch in batches:
            texts = ["" if t is None else t for t in batch["_text"]]
            rows = []
            for a in own.encode_all(texts):
                rows.append((len(a) // 4, hashlib.sha256(a).hexdigest(), hashlib.sha256(own.decode(a)).hexdigest(), np.frombuffer(a, dtype="<u4").astype(np.int32) if ids else None))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "ids"])
            out.insert(0, id_col, batch[id_col].to_numpy())
            yield out if ids else out.drop(columns="ids")

    return df.selectExpr(f"`{id_col}`", f"`{text_col}` AS _text").mapInPandas(run, schema)


def op3_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(documents(spark, sf_dir), path=public_tokenizers.path("word_bpe_49k.json"))
