"""Ranked lexical search over a bit-sliced impact index.

The documents are cut into blocks. For each block and each of its terms the index holds the places of the term's
documents and, over those, one bitmap for each bit of their impacts. A search adds the bitmaps: an impact is multiplied
by its term's weight by adding shifted slices, and the weighted slices of an item's terms are summed in a tree, both by
full adders over 64 documents a word. The top k of a block are found from the most significant slice down: whoever has
the bit set goes before all who have not. A block's best k are merged with the others'.

The blocks are made where their documents lie, so that indexing shuffles nothing; a search moves only the terms asked for.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhound.llm.common import documents, named, stored, text_or_empty

#: An impact is below 10 ** 6.
BITS = 20
#: Most documents of a block, and most terms with repeats; a document that alone has more is a block.
BLOCK, BLOCK_TERMS = 8192, 3_000_000
#: Items that are summed at once, terms of each of them at once, and terms of items that one search sends to the tasks.
TOGETHER, DEEP, SENT_TERMS = 8, 64, 500_000
#: Bytes of a term: letters and digits of ASCII, A-Z as a-z, and all beyond ASCII; others part terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    some = every = 0
    for batch in batches:
        for text in batch.column(0):
            n = len(terms_of(text.as_py()))
            some, every = some + (n > 0), every + n
    yield pa.RecordBatch.from_pydict({"docs": [some], "terms": [every]})


def _block(ids: list, counts: list[np.ndarray], lengths: list[int], names: list[bytes], number: int, docs: int, total: int) -> pa.RecordBatch:
    """The rows of one block: term, df, slots (little-endian 16-bit), slices; and one without a term that holds the ids in the order of slots."""
    known = np.array([i is not None for i in ids])
    value = np.array([0 if i is None else i for i in ids], dtype=np.int64)
    order = np.lexsort((value, ~known))  # slots go by id, nulls last
    slot = np.empty(len(ids), dtype=np.int64)
    slot[order] = np.arange(len(ids))
    n = np.array(lengths, dtype=np.int64)
    m = 100 - 90 + (90 * n * docs) // max(1, total)
    flat = np.concatenate(counts).astype(np.int64) if counts else np.empty(0, dtype=np.int64)
    key, tf = np.unique(flat * BLOCK + np.repeat(slot, n), return_counts=True)
    term, at = key // BLOCK, key % BLOCK
    impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[order][at])
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    df = np.diff(np.append(starts, len(term)))
    size = (BITS * df + 7) // 8  # bytes of a term's slices
    offset = np.concatenate(([0], np.cumsum(size)))
    bits = np.zeros(8 * offset[-1], dtype=np.uint8)
    base = np.repeat(8 * offset[:-1], df) + np.arange(len(term)) - np.repeat(starts, df)
    step = np.repeat(df, df)
    for b in range(BITS):
        bits[base + b * step] = (impact >> b) & 1
    blob = lambda raw, ends: pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(raw)])
    slots = blob(at.astype("<u2").tobytes(), np.append(2 * starts, 2 * len(term)))
    rows = pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(df), number), pa.int64()), pa.array([names[t] for t in term[starts]], pa.binary()), pa.array(df, pa.int64()), slots, blob(np.packbits(bits).tobytes(), offset)], ["block", "term", "df", "slots", "slices"]
    )
    head = {"block": [number], "term": [None], "df": [len(ids)], "slots": [value[order].tobytes()], "slices": [known[order].tobytes()]}
    return pa.Table.from_batches([rows, pa.RecordBatch.from_pydict(head, schema=rows.schema)]).combine_chunks()


def _indexer(docs: int, total: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        number = itertools.count(task)

        def fresh():
            return [], [], [], defaultdict(itertools.count().__next__)

        ids, counts, lengths, names = fresh()
        held = 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                terms = terms_of(text.as_py())
                if ids and (len(ids) == BLOCK or held + len(terms) > BLOCK_TERMS):
                    yield from _block(ids, counts, lengths, list(names), next(number), docs, total).to_batches()
                    ids, counts, lengths, names = fresh()
                    held = 0
                ids.append(i)
                lengths.append(len(terms))
                held += len(terms)
                if terms:
                    counts.append(np.fromiter(map(names.__getitem__, terms), np.int32, len(terms)))
        if ids:
            yield from _block(ids, counts, lengths, list(names), next(number), docs, total).to_batches()

    return index


def build_index(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """(index, N): rows (block, term, df, slots, slices) of all terms of all rows of df, written; and the number of documents with a term.

    Two passes over the texts: the first for N and the mean length, which the impacts need. ids are whole numbers or null.
    """
    docs = df.select(named(id_col).cast("long").alias("id"), named(text_col).alias("text"))
    docs_n, total = docs.select("text").mapInArrow(_totals, "docs long, terms long").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    index = docs.mapInArrow(_indexer(docs_n, total), "block long, term binary, df long, slots binary, slices binary")
    return stored(index, "impact-index"), docs_n


# ---- bit-sliced arithmetic: arrays [..., bits, words], least significant slice first


def add_slices(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a + b for every document, by full adders; one more slice than the wider of them."""
    wide = max(a.shape[-2], b.shape[-2])
    out = np.zeros((*np.broadcast_shapes(a.shape[:-2], b.shape[:-2]), wide + 1, a.shape[-1]), dtype=np.uint64)
    carry = np.zeros_like(out[..., 0, :])
    for k in range(wide):
        if k < a.shape[-2] and k < b.shape[-2]:
            x, y = a[..., k, :], b[..., k, :]
            either = x ^ y
            out[..., k, :] = either ^ carry
            carry = (x & y) | (carry & either)
        else:
            x = a[..., k, :] if k < a.shape[-2] else b[..., k, :]
            out[..., k, :] = x ^ carry
            carry = x & carry
    out[..., wide, :] = carry
    return out


def times(a: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """a[t] * weights[t] for every document, by adding a shifted to the place of each bit that is set in the weight."""
    top = int(weights.max(initial=0)).bit_length()
    out = np.zeros((a.shape[0], a.shape[1] + top, a.shape[2]), dtype=np.uint64)
    for j in range(top):
        some = np.flatnonzero((weights >> j) & 1)
        if len(some):
            high = min(out.shape[1], j + a.shape[1] + 1)
            out[some, j:high] = add_slices(out[some, j : high - 1], a[some])[:, : high - j]
    return out


def summed(a: np.ndarray) -> np.ndarray:
    """The sum over the first axis but one, in a tree: [items, terms, bits, words] to [items, bits, words]."""
    while a.shape[1] > 1:
        if a.shape[1] % 2:
            a = np.concatenate((a, np.zeros_like(a[:, :1])), axis=1)
        a = add_slices(a[:, ::2], a[:, 1::2])
    return a[:, 0]


def top_slots(slices: np.ndarray, k: int) -> np.ndarray:
    """The slots of the k largest values above 0 (all, if fewer), equal values by slot, from the most significant slice down."""
    live = np.bitwise_or.reduce(slices, axis=0)
    sure = np.zeros_like(live)  # larger than all that are still open
    count = lambda x: int(np.bitwise_count(x).sum())
    if count(live) > k:
        for s in slices[::-1]:
            with_bit = live & s
            if not (n := count(with_bit)):
                continue
            if count(sure) + n >= k:
                live = with_bit
                if count(sure) + n == k:
                    break
            else:
                sure |= with_bit
                live &= ~s
    at = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))
    best = at(sure)
    return np.concatenate((best, at(live)[: k - len(best)]))


def values_at(slices: np.ndarray, slots: np.ndarray) -> np.ndarray:
    bits = (slices[:, slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1)
    return (bits.astype(np.int64) << np.arange(len(slices))[:, None]).sum(axis=0)


def dense(rows: list[tuple[int, bytes, bytes]], words: int) -> np.ndarray:
    """[terms, BITS, words] of index rows (df, slots, slices)."""
    if len(rows) > DEEP:  # a byte a bit on the way
        return np.concatenate([dense(rows[k : k + DEEP], words) for k in range(0, len(rows), DEEP)])
    df = np.array([r[0] for r in rows])
    slots = np.frombuffer(b"".join(r[1] for r in rows), dtype="<u2").astype(np.int64)
    bits = np.unpackbits(np.frombuffer(b"".join(r[2] for r in rows), dtype=np.uint8))
    offset = np.concatenate(([0], np.cumsum((BITS * df + 7) // 8 * 8)))[:-1]
    first = np.concatenate(([0], np.cumsum(df)))[:-1]
    base = np.repeat(offset, df) + np.arange(len(slots)) - np.repeat(first, df)
    row, step = np.repeat(np.arange(len(df)), df), np.repeat(df, df)
    out = np.zeros((len(df), BITS, 64 * words), dtype=np.uint8)
    for b in range(BITS):
        out[row, b, slots] = bits[base + b * step]
    return np.packbits(out, axis=2, bitorder="little").view(np.uint64)


def _searcher(items: list[tuple[object, list[bytes]]], weights: dict[bytes, int], k: int):
    """Rows (item, id, score) of a block's best k for each item, from the block's index rows."""

    def search(rows: dict[bytes | None, tuple[int, bytes, bytes]], out: list) -> None:
        size, ids, known = rows.pop(None)
        ids, known, words = np.frombuffer(ids, dtype=np.int64), np.frombuffer(known, dtype=bool), -(-size // 64)
        for start in range(0, len(items), TOGETHER):
            some = [(i, found) for i, terms in items[start : start + TOGETHER] if (found := [t for t in terms if t in rows])]
            sums = None
            for low in range(0, max((len(f) for _, f in some), default=0), DEEP):
                parts = [f[low : low + DEEP] for _, f in some]
                place = {t: p for p, t in enumerate(sorted({t for f in parts for t in f}))}
                weighted = times(dense([rows[t] for t in place], words), np.array([weights[t] for t in place], dtype=np.int64))
                stack = np.zeros((len(some), max(map(len, parts)), *weighted.shape[1:]), dtype=np.uint64)
                for p, f in enumerate(parts):
                    stack[p, : len(f)] = weighted[[place[t] for t in f]]
                sums = summed(stack) if sums is None else add_slices(sums, summed(stack))
            for p, (i, _) in enumerate(some):
                slots = top_slots(sums[p], k)
                for s, v in zip(slots, values_at(sums[p], slots)):
                    out.append((i, int(ids[s]) if known[s] else None, int(v)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows, now = [], {}, None
        names = ["item", "id", "score"]
        table = lambda: pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int64())], names)
        for batch in batches:
            for block, term, df, slots, slices in zip(*(batch.column(c).to_pylist() for c in ("block", "term", "df", "slots", "slices"))):
                if block != now:
                    if rows:
                        search(rows, out)
                        yield table()
                        out.clear()
                    rows, now = {}, block
                rows[term] = (df, slots, slices)
        if rows:
            search(rows, out)
        yield table()

    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(dict.fromkeys(terms_of(t.as_py()))) for t in batch.column(1)], pa.list_(pa.binary()))], ["item", "terms"])


def search(index: DataFrame, docs: int, items: DataFrame, *, id_col: str = "item_id", text_col: str = "text", k: int = 10) -> DataFrame:
    """(item, rank, id, score): each item's k best documents with a score above 0, equal scores by id, null ids last.

    Items are rows (whole-number id_col, text_col). Items without a term, and null texts, give no rows; repeated items
    and items without an id are one item each by id, of all their terms. An empty index gives an empty result. Items are
    taken in portions of SENT_TERMS terms, which is what goes to the tasks at once; an item of more terms is a portion.
    """
    spark = index.sparkSession
    asked = items.select(named(id_col).cast("long").alias("item"), text_or_empty(text_col).alias("text")).mapInArrow(_item_terms, "item long, terms array<binary>")
    asked = stored(asked.select("item", F.explode("terms").alias("term")).distinct(), "item-terms")
    portions = max(1, -(-asked.count() // SENT_TERMS))
    asked = asked.withColumn("portion", F.pmod(F.xxhash64("item"), F.lit(portions)))
    used = index.select("term", "df").join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    asked = stored(asked.join(used, "term"), "asked-terms")
    found = None
    for portion in range(portions):
        own = asked.filter(F.col("portion") == portion)
        rows = own.select("item", "term", "df").collect()  # about SENT_TERMS
        by_item, weights = defaultdict(list), {}
        for r in rows:
            term = bytes(r.term)
            by_item[r.item].append(term)
            weights[term] = math.floor(1000 * math.log((2 * docs + 2) / (2 * r.df + 1)))
        terms = own.select("term").distinct()
        needed = index.join(terms, "term", "left_semi").unionByName(index.filter("term IS NULL"))
        by_block = needed.repartition("block").sortWithinPartitions("block")
        best = by_block.mapInArrow(_searcher(sorted(by_item.items(), key=lambda x: (x[0] is None, x[0])), weights, k), "item long, id long, score long")
        found = best if found is None else found.unionByName(best)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item", "rank", "id", "score")


def op13_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, n = build_index(documents(spark, sf_dir))
    found = search(index, n, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


OP13_SQL = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
s AS (SELECT count(*) FILTER (len(terms) > 0) AS n, sum(len(terms))::BIGINT AS l FROM t),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT rid, doc_id, term, count(*) AS tf, any_value(100 - 90 + (90 * size * s.n) // s.l) AS m FROM (SELECT rid, doc_id, len(terms) AS size, unnest(terms) AS term FROM t), s GROUP BY rid, doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(s.n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term),
r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term) GROUP BY item_id, rid, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
