"""The registered queries on the smallest tables: their columns and types, and their values by brute force."""

import collections
import hashlib
import itertools
import math
import os
import zlib

import pytest
from pyspark.sql import functions as F

from tallyhound.llm import suffix_tree_lm
from tallyhound.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")

COLUMNS = {
    "op2_flow_reshard": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op3_speculative_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op4_suffix_tree": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op6_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op7_secret_ownership": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op8_signature_sniffing": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op9_lsh_forest": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op10_ftrl_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
}


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def result(spark):
    cache = {}

    def get(name):
        if name not in cache:
            cache[name] = QUERIES[name](spark, DIR).collect()
        return cache[name]

    return get


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_types_and_one_row_for_each_document(spark, texts, result, name):
    types = dict(QUERIES[name](spark, DIR).dtypes)
    want = dict(c.split() for c in COLUMNS[name].split(", "))
    assert {c: types.get(c) for c in want} == want
    assert sorted(r.doc_id for r in result(name)) == sorted(texts)


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_shards(texts, result):
    rows = result("op2_flow_reshard")
    slots = collections.defaultdict(list)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[k]) for k in range(16)]
    assert max(sizes) - min(sizes) <= 1


def test_stored_payloads(texts, result):
    for r in result("op8_signature_sniffing"):
        raw = texts[r.doc_id].encode()
        size = max(1, -(-len(raw) // 576)) * 576
        whole = raw + b"\xff" * (size - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), size, hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]))


def test_components(texts, result):
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and min(len(x), len(y)) * 100 >= 85 * max(len(x), len(y)):
            both = len(x & y)
            if 100 * both >= 85 * (len(x) + len(y) - both):
                p, q = top(a), top(b)
                label[max(p, q)] = min(p, q)
    for r in result("op9_lsh_forest"):
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), top(r.doc_id), top(r.doc_id) == r.doc_id)


def test_languages_of_held_out_documents(spark, texts, result):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang").collect()}
    learnt = {v for i, v in lang.items() if v is not None and remainder(i, 3) != 1}
    right = []
    for r in result("op10_ftrl_language"):
        assert r.held_out == (remainder(r.doc_id, 3) == 1) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id])) and (r.lang_pred == "und" or r.lang_pred in learnt)
        if r.held_out and lang[r.doc_id] is not None and r.lang_pred != "und":
            right.append(r.lang_pred == lang[r.doc_id])
    assert sum(right) >= 0.95 * len(right) > 20


def test_contexts_pay_on_held_out_texts(spark, result):
    """Against the same symbols without contexts. (Against the unigrams of words, the base, the tree needs more text than there is here.)"""
    rows = result("op4_suffix_tree")
    assert all(r.held_out == (remainder(r.doc_id, 5) == 1) for r in rows)
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", F.col("doc_id").isin([r.doc_id for r in rows if r.held_out]).alias("held_out"))
    root = suffix_tree_lm.lm_score(docs, settings=suffix_tree_lm.Settings(gain=math.inf)).filter("held_out").agg(F.sum("score")).first()[0]
    assert sum(r.score for r in rows if r.held_out) > 0.75 * root


def test_tree_against_brute_force(spark, texts):
    some = [texts[i] for i in sorted(texts)[:40]]
    s = suffix_tree_lm.Settings(least=5e-4, gain=3.0)
    letters = collections.Counter(b for t in some for b in b" ".join(t.encode().lower().split()))
    code = suffix_tree_lm.alphabet(letters)
    df = spark.createDataFrame([(t,) for t in some], "text string")
    got = {(r.depth, r.context, r.symbol): r.n for r in suffix_tree_lm.tree_nodes(suffix_tree_lm.gram_counts(df, code), s).collect()}

    depth, counts = suffix_tree_lm.DEPTH, collections.defaultdict(collections.Counter)
    for t in some:
        line = [0] * depth + [int(code[b]) for b in b" ".join(t.encode().lower().split())] + [0]
        for k in range(depth, len(line)):
            for d in range(depth + 1):
                counts[tuple(line[k - d : k])][line[k]] += 1
    total = {c: sum(n.values()) for c, n in counts.items()}
    frequent = {c for c in counts if not c or total[c] >= max(1.0, s.least * total[()])}
    kept = {()}
    for c in frequent - {()}:
        gain = sum(n * math.log((n / total[c]) / (counts[c[1:]][x] / total[c[1:]])) for x, n in counts[c].items())
        if gain >= s.gain:
            kept |= {c[k:] for k in range(len(c))}
    packed = lambda c: sum(x << (suffix_tree_lm.BITS * k) for k, x in enumerate(reversed(c)))
    assert got == {(len(c), packed(c), x): n for c in kept for x, n in counts[c].items()}
    assert len({k[:2] for k in got}) > 100


def test_bytes_round_trip(texts, result):
    from tokenizers import Tokenizer

    public_tokenizers = pytest.importorskip("public_tokenizers")
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    for r in result("op3_speculative_bpe"):
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(raw).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_every_document_is_packed_and_rewritten(spark, texts):
    for name in ("op1_surrogates", "op5_conflict_best_fit"):
        assert {r.doc_id for r in QUERIES[name](spark, DIR).select(F.col("doc_id")).collect()} == set(texts)
