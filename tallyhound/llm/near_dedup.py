"""Near-duplicate components by an LSH forest over MinHash signatures.

Each document's signature is read in several orders (trees). In each order documents that share a prefix form a region,
and those of a region are candidates. The depth adapts to the region: where too many share a prefix, each is compared
with the region's first document, its hub, and unless all agree with it the region's documents go on to longer prefixes,
in more orders, until every region is small. Small regions compare all with all. Candidates that the whole signature
supports join into families; each family is then checked exactly by the full sets: first against a hub, which ties most
of a group of copies together in one pass, and then only what no hub settled, against all others of its family.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from tallyhound.llm.common import documents, join_by_group, stored, text_or_empty

#: Values of a signature, and the forest's levels: length of the shared prefix, and orders in which it is read. A pair of
#: similarity 0.8 shares no prefix of the first level with a chance of 3e-6, one of 0.85 with 2e-8.
VALUES, TREES, DEPTH = 96, 24, 4
LEVELS = [(8, 48), (14, 96), (24, 96), (VALUES, 1)]
#: By how much the share of equal signature values may fall below the similarity asked for (over five deviations).
SLACK = 0.2
#: Most members of a region that are compared all with all; of these, most that are compared place by place at once.
REGION, SMALL = 512, 16
#: Most documents of a family that are checked in one go.
BLOCK = 1000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values spread evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.cumprod(np.full(1 << 16, np.uint64(0x2545F4914F6CDD1D)))
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word [^\\x20\\x09-\\x0D]+ of a lower-cased text, computed over all its bytes at once."""
    raw = np.frombuffer(text, dtype=np.uint8)
    blank = _BLANK[raw]
    edge = np.flatnonzero(np.diff(np.r_[True, blank, True].view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    raw, blank, start, size = raw[start[0] :], blank[start[0] :], start - start[0], end - start
    at = np.arange(len(raw)) - np.repeat(start, np.diff(np.r_[start, len(raw)]))  # place within the word
    terms = np.where(blank, np.uint64(0), (raw.astype(np.uint64) + np.uint64(1)) * _POWERS[at & 0xFFFF])
    return mixed(np.add.reduceat(terms, start) + size.astype(np.uint64) * _ODD)


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted set of 64-bit shingle hashes; the whole sequence as one where there are fewer words; A-Z lower-cased."""
    h = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(h):
        return h
    k = min(words, len(h))
    out = np.zeros(len(h) - k + 1, dtype=np.uint64)
    for i in range(k):
        out = mixed(out * _ODD + h[i : len(h) - k + 1 + i] + np.uint64(i))
    return np.unique(out)


def signed_long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _multipliers() -> np.ndarray:
    return mixed(np.arange(1, VALUES + 1, dtype=np.uint64) * _ODD) | np.uint64(1)


def signed(df: DataFrame, words: int) -> DataFrame:
    """n, two hashes of the set, the signature's low 16 bits each, and each order's region, for (doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        many = _multipliers()[:, None]
        for batch in batches:
            rows = []
            for text in batch["text"]:
                s = shingles(text, words)
                if not len(s):
                    rows.append((0, 0, 0, None, None))
                    continue
                least = np.full(len(many), np.uint64(2**64 - 1))
                for i in range(0, len(s), 1024):
                    np.minimum(least, (s[None, i : i + 1024] * many).min(axis=1), out=least)
                sign = mixed(least)
                region = np.arange(TREES, dtype=np.uint64)
                for values in sign.reshape(TREES, DEPTH).T:
                    region = mixed(region * _ODD + values)
                one, two = int(s.sum()), int(mixed(s ^ _ODD).sum())
                rows.append((len(s), signed_long(one), signed_long(two), sign.astype("<u2").tobytes(), region.view(np.int64)))
            out = pd.DataFrame(rows, columns=["n", "h1", "h2", "sign", "regions"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.mapInPandas(run, f"doc_id {kind}, n long, h1 long, h2 long, sign binary, regions array<long>")


def spanning(pairs: list[list[int]]) -> list[tuple[int, int]]:
    """Those of some pairs that tie together what all of them do."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    out = []
    for a, b in pairs:
        if (p := find(a)) != (q := find(b)):
            root[max(p, q)] = min(p, q)
            out.append((min(a, b), max(a, b)))
    return out


def tied(alike: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric matrix of links."""
    seen, out = np.zeros(len(alike), dtype=bool), []
    for first in range(len(alike)):
        if seen[first]:
            continue
        seen[first], todo = True, [first]
        while todo:
            k = todo.pop()
            new = np.flatnonzero(alike[k] & ~seen)
            seen[new] = True
            out += [(k, int(j)) for j in new]
            todo += new.tolist()
    return out


def agreement(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The share of equal values of each signature (row) of one with each of other."""
    out = np.zeros((len(one), len(other)), dtype=np.float32)
    for at in range(0, len(one), 64):
        out[at : at + 64] = (one[at : at + 64, None] == other[None]).mean(axis=2)
    return out


def within_regions(members: DataFrame, least: float) -> DataFrame:
    """(a, b) pairs that tie together the members of each region whose signatures agree in a share of `least` or more.

    members: region, size, node, sign. All of a region are compared with all.
    """
    dealt = members.select("region", "size", "node", "sign").repartition("region").sortWithinPartitions("region", "node")

    def pairs_of(rows: pd.DataFrame) -> pd.DataFrame:
        region, node, size = (rows[c].to_numpy() for c in ("region", "node", "size"))
        signs = np.frombuffer(b"".join(rows["sign"]), dtype="<u2").reshape(len(rows), -1)
        found = []
        small = np.flatnonzero(size <= SMALL)  # all these regions at once: each row with the next, the one after, and so on
        for gap in range(1, min(SMALL, len(small))):
            i, j = small[:-gap], small[gap:]
            same = region[i] == region[j]
            if not same.any():
                break
            i, j = i[same], j[same]
            like = (signs[i] == signs[j]).mean(axis=1) >= least
            found += np.stack([node[i[like]], node[j[like]]], axis=1).tolist()
        found = spanning(found)
        large = np.flatnonzero(size > SMALL)
        edge = np.flatnonzero(np.diff(region[large])) + 1
        for own in np.split(large, edge) if len(large) else []:
            found += [(int(node[own[i]]), int(node[own[j]])) for i, j in tied(agreement(signs[own], signs[own]) >= least)]
        return pd.DataFrame([(min(p), max(p)) for p in found], columns=["a", "b"], dtype="int64")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if not len(batch):
                continue
            open_ = batch["region"] == batch["region"].iloc[-1]  # may go on in the next batch
            if not open_.all():
                yield pairs_of(batch[~open_].reset_index(drop=True))
            rest = batch[open_]
        if rest is not None:
            yield pairs_of(rest.reset_index(drop=True))

    return dealt.mapInPandas(run, "a long, b long").filter("a <> b").distinct()


@F.pandas_udf(FloatType())
def share_alike(one: pd.Series, other: pd.Series) -> pd.Series:
    if not len(one):
        return pd.Series([], dtype="float32")
    a, b = (np.frombuffer(b"".join(x), dtype="<u2").reshape(len(x), -1) for x in (one, other))
    return pd.Series((a == b).mean(axis=1).astype("float32"))


def candidates(firsts: DataFrame, least: float, total: int) -> DataFrame:
    """(a, b) pairs of nodes that tie each family together; firsts: node, sign, regions, one row a node."""
    found = []
    places = firsts.select("node", F.explode("regions").alias("region"))
    signed_nodes = firsts.select("node", "sign")
    for depth, orders in [*LEVELS, (0, 0)]:
        sizes = stored(places.groupBy("region").agg(F.count("*").alias("size"), F.min("node").alias("hub")).filter("size > 1"), "regions")
        members = join_by_group(places, sizes, "region", "size", total * TREES).filter("size IS NOT NULL")
        found.append(within_regions(members.filter(F.col("size") <= REGION).join(signed_nodes, "node"), least))
        large = sizes.filter(F.col("size") > REGION)
        if large.isEmpty():
            break
        hubs = large.join(firsts.select(F.col("node").alias("hub"), F.col("sign").alias("hub_sign")), "hub")
        both = join_by_group(places, hubs, "region", "size", total * TREES).filter("size IS NOT NULL").join(signed_nodes, "node")
        both = stored(both.withColumn("alike", F.lit(1.0) if depth == 0 else share_alike("sign", "hub_sign")).select("node", "region", "hub", "alike"), "region-hubs")
        found.append(both.filter(F.col("alike") >= least).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).filter("a <> b").distinct())
        if depth == 0:  # equal signatures throughout
            break
        open_ = both.groupBy("region").agg(F.min("alike").alias("alike")).filter(F.col("alike") < least)
        nodes = both.join(open_.select("region"), "region", "left_semi").select("node").distinct()
        rows = stored(nodes.join(signed_nodes, "node"), "region-members")
        if rows.isEmpty():
            break
        order = F.explode(F.sequence(F.lit(0), F.lit(orders - 1))).alias("tree")
        turned = F.expr(f"concat(substring(sign, {2 * (VALUES // orders)} * tree + 1), substring(sign, 1, {2 * (VALUES // orders)} * tree))")
        places = rows.select("node", "sign", order).select("node", F.xxhash64("tree", turned.substr(1, 2 * depth)).alias("region"))
    return reduce(DataFrame.unionByName, found).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of the edges (a, b) reaches.

    Each round gives a node the least of itself and its neighbours, follows that one step further, and goes on with the
    edges between different labels only, so that a round costs less than the one before. Nodes are hashes: their order is
    at random, which keeps the rounds few. The smallest node of a component keeps itself as its label throughout.
    """
    edges, overall = stored(edges.select("a", "b"), "edges"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label"))
        onward = near.filter("node <> label").select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = stored(near.join(onward, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "labels")
        step = moved.select(F.col("node").alias("label"), F.col("label").alias("next"))
        overall = moved if overall is None else stored(overall.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "labels")
        ends = edges.join(moved.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(moved.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
        edges = stored(ends.filter("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return overall


def linked_to(hub: np.ndarray, joined: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
    """Which of some sets, given end to end, are linked with one: 100 * intersection >= least * union."""
    inter = np.add.reduceat(hub[np.minimum(np.searchsorted(hub, joined), len(hub) - 1)] == joined, starts, dtype=np.int64)
    return 100 * inter >= least * (sizes + len(hub) - inter)


def joined_sets(sets: list[np.ndarray], signs: np.ndarray, least: int, hubs: int = 4) -> tuple[list[tuple[int, int]], int]:
    """A spanning forest of the links among some non-empty sets, and the number of sets that the first one reaches.

    A few hubs are checked against all; only where that leaves sets apart are the pairs between these checked, those
    whose signatures allow a link, one by one where they are few and as matrix products otherwise.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets])
    starts, joined = np.cumsum(sizes) - sizes, np.concatenate(sets)
    label, out = np.arange(n), []

    def join(i: int, j: int) -> None:
        if label[i] != label[j]:
            out.append((i, j))
            label[label == max(label[i], label[j])] = min(label[i], label[j])

    tried = np.zeros(n, dtype=bool)
    for _ in range(min(hubs, n)):
        rest = np.flatnonzero(~tried & (label != np.bincount(label).argmax())) if tried.any() else np.arange(n)
        if not len(rest):
            break
        tried[rest[0]] = True
        for j in np.flatnonzero(linked_to(sets[rest[0]], joined, starts, sizes, least)):
            join(int(rest[0]), int(j))
    if (label != 0).any():
        apart = (label[:, None] != label[None]) & (100 * np.minimum.outer(sizes, sizes) >= least * np.maximum.outer(sizes, sizes))
        pairs = np.argwhere(np.triu(apart & (agreement(signs, signs) >= least / 100 - SLACK) & ~tried[:, None] & ~tried[None], 1))
        if len(pairs) <= 20 * n:
            for i, j in pairs.tolist():
                if label[i] != label[j]:
                    inter = int(np.isin(sets[i], sets[j], assume_unique=True).sum())
                    if 100 * inter >= least * (sizes[i] + sizes[j] - inter):
                        join(i, j)
        else:
            for i, j in tied(linked_matrix(sets, least)):
                join(i, j)
    return out, int((label == 0).sum())


def linked_matrix(sets: list[np.ndarray], least: int) -> np.ndarray:
    """Which of some sets are linked, every pair, by matrix products over the shingles that two of them share."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, code, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = df[code] > 1  # a shingle of one set only is in no intersection
    owner, code = owner[keep], code[keep]
    ids, code = np.unique(code, return_inverse=True)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    inter = np.zeros((n, n), dtype=np.float32)
    width = max(1, 4_000_000 // n)
    for at in range(0, len(ids), width):
        a, b = np.searchsorted(code, [at, at + width])
        x = np.zeros((n, width), dtype=np.float32)
        x[owner[a:b], code[a:b] - at] = 1
        inter += x @ x.T
    inter = np.rint(inter).astype(np.int64)
    return 100 * inter >= least * (sizes[:, None] + sizes[None, :] - inter)


def checked(members: DataFrame, words: int, least: int) -> DataFrame:
    """(a, b) links, confirmed on full sets, of dealt members (group, split, side, node, h1, sign, text).

    A group of side 0 is checked in itself. Where it is one part of a split family, its first member is the family's hub,
    and every member that the hub does not reach is told as (node, null). In a group with sides 1 and 2 each of side 1 is
    checked against all of side 2.
    """
    dealt = members.select("group", "split", "side", "node", "h1", "sign", "text").repartition("group").sortWithinPartitions("group", "side", "node")

    def links(split: bool, sides: list[int], nodes: list[int], signs: list[bytes], sets: list[np.ndarray]) -> Iterator[tuple[int, int | None]]:
        sign = np.frombuffer(b"".join(signs), dtype="<u2").reshape(len(nodes), -1)
        if sides[-1] == 0:
            found, reached = joined_sets(sets, sign, least) if len(nodes) > 1 else ([], 1)
            yield from ((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])) for i, j in found)
            if split and reached < len(nodes):
                root = {0}
                for i, j in sorted(found, key=lambda p: p[0]):  # what the hub reaches, by going over the forest until nothing is new
                    if i in root or j in root:
                        root |= {i, j}
                while (more := {k for p in found if (p[0] in root) != (p[1] in root) for k in p} - root):
                    root |= more
                yield from ((nodes[k], None) for k in range(len(nodes)) if k not in root)
            return
        cut = sides.count(1)
        if cut == len(nodes) or not cut:
            return
        likely = agreement(sign[:cut], sign[cut:]) >= least / 100 - SLACK
        for i, j in np.argwhere(likely).tolist():
            a, b = sets[i], sets[cut + j]
            if nodes[i] != nodes[cut + j] and 100 * min(len(a), len(b)) >= least * max(len(a), len(b)):
                inter = int(np.isin(a, b, assume_unique=True).sum())
                if 100 * inter >= least * (len(a) + len(b) - inter):
                    yield min(nodes[i], nodes[cut + j]), max(nodes[i], nodes[cut + j])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, split, sides, nodes, signs, sets = None, False, [], [], [], []
        table = lambda rows: pd.DataFrame({"a": pd.array([a for a, _ in rows], dtype="Int64"), "b": pd.array([b for _, b in rows], dtype="Int64")})
        for batch in batches:
            found: list = []
            for group, part, side, node, h1, sign, text in zip(*[batch[c] for c in ("group", "split", "side", "node", "h1", "sign", "text")]):
                if group != now:
                    if nodes:
                        found += links(split, sides, nodes, signs, sets)
                    now, split, sides, nodes, signs, sets = group, part, [], [], [], []
                own = shingles(text, words)
                if signed_long(int(own.sum())) == h1 and not (nodes[-1:] == [node] and sides[-1] == side):  # else an id with several texts, or a repeated row
                    sides.append(side)
                    nodes.append(node)
                    signs.append(sign)
                    sets.append(own)
            yield table(found)
        yield table(list(links(split, sides, nodes, signs, sets)) if nodes else [])

    return dealt.mapInPandas(run, "a long, b long").filter("NOT a <=> b").distinct()


def across_parts(placed: DataFrame, alone: DataFrame, words: int, least: int, total: int) -> DataFrame:
    """(a, b) links of the nodes in `alone`, which their family's hub does not reach, with all others of their family.

    placed: node, family, members, h1, sign, text. Blocks of half of BLOCK of one meet as many of the other.
    """
    half = max(1, BLOCK // 2)
    lone = alone.withColumn("lone", F.lit(True))
    open_ = lone.join(placed.select("node", "family", "members"), "node").groupBy("family", "members").agg(F.count("*").alias("ones"))
    open_ = stored(open_.select("family", "members", (F.col("ones") / half + 1).cast("long").alias("ones"), (F.col("members") / half + 1).cast("long").alias("others")), "unsettled-families")
    both = join_by_group(placed.drop("members"), open_, "family", "members", total).filter("ones IS NOT NULL").join(lone, "node", "left").withColumn("lone", F.coalesce("lone", F.lit(False)))
    one = both.filter("lone").select("node", "h1", "sign", "text", F.lit(1).alias("side"), F.explode(F.expr("transform(sequence(0L, others - 1), p -> xxhash64(family, pmod(xxhash64(node), ones), p))")).alias("group"))
    two = both.select("node", "h1", "sign", "text", F.lit(2).alias("side"), F.explode(F.expr("transform(sequence(0L, ones - 1), p -> xxhash64(family, p, pmod(xxhash64(node, 1), others)))")).alias("group"))
    return checked(one.unionByName(two).withColumn("split", F.lit(False)), words, least).filter("b IS NOT NULL")


def near_dedup(df: DataFrame, *, words: int = 5, least: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id_col, n_shingles, component_id (smallest id reachable), kept, class_size.

    Documents are linked where 100 * intersection >= least * union of their sets of `words`-word shingles. Null, empty
    and blank texts have an empty set and are linked with nothing: their component is their own id. Repeated rows and
    equal sets are one class, linked throughout. Extra columns of df are ignored; an empty df gives an empty result.
    Rows with a null id are linked by equal sets only, and all of
    them are kept; give rows a number of their own as id where ids may be null.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    signs = stored(signed(docs, words), "signatures")
    full = signs.filter("n > 0").withColumn("key", F.struct("h1", "h2", "n"))
    classes = full.groupBy("key").agg(F.count("*").alias("class_size"), F.min("doc_id").alias("first"), F.xxhash64("key").alias("node"))
    classes = stored(classes, "classes")
    total = max(1, signs.count())

    # one row of each class carries its signature: that of its smallest id
    labelled = join_by_group(full.select("doc_id", "key"), classes, "key", "class_size", total)
    firsts = full.withColumn("node", F.xxhash64("key")).join(classes.select("node", F.col("first").alias("doc_id")), ["node", "doc_id"]).dropDuplicates(["node"])
    firsts = stored(firsts.select("node", "n", "sign", "regions"), "class-signatures")
    pairs = candidates(firsts, least / 100 - SLACK, total)
    families = stored(components(pairs).withColumnRenamed("label", "family"), "families")

    # their texts, once for each class: ids are spread evenly however large a class is. By a shuffle of the texts whatever
    # the size, so that the job is the same on small and large data
    wanted = classes.join(families.select("node"), "node", "left_semi").select("node", F.col("key.h1").alias("h1"), F.col("first").alias("doc_id"))
    texts = docs.join(stored(wanted, "wanted-texts").hint("shuffle_hash"), "doc_id").select("node", "h1", "text").join(firsts.select("node", "sign"), "node")
    counts = stored(families.groupBy("family").agg(F.count("*").alias("members")), "family-sizes")
    placed = stored(join_by_group(families, counts, "family", "members", total).join(texts, "node"), "family-texts")

    # a family of up to BLOCK members meets in one group; a larger one in parts, each with the family's hub
    parts = F.ceil(F.col("members") / F.lit(max(1, BLOCK - 1))).cast("long")
    part = F.pmod(F.xxhash64("node"), F.when(F.col("members") > BLOCK, parts).otherwise(F.lit(1)))
    hub = F.col("node") == F.col("family")  # a family's label is its smallest node
    every = F.sequence(F.lit(0).cast("long"), F.when(F.col("members") > BLOCK, parts).otherwise(F.lit(1)) - 1)
    dealt = placed.withColumn("part", F.explode(F.when(hub, every).otherwise(F.array(part))))
    dealt = dealt.withColumn("group", F.xxhash64("family", "part")).withColumn("split", F.col("members") > BLOCK).withColumn("side", F.lit(0))
    first = stored(checked(dealt, words, least), "first-links")
    links = first.filter("b IS NOT NULL")
    alone = stored(first.filter("b IS NULL").select(F.col("a").alias("node")).distinct(), "unsettled")
    if not alone.isEmpty():
        links = stored(links.unionByName(across_parts(placed, alone, words, least, total)), "links")
    reached = components(links)
    lowest = classes.join(reached, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = stored(lowest.select("key", "node", "first", "label", "class_size"), "labelled-classes")
    least_id = lowest.filter("label IS NOT NULL").groupBy("label").agg(F.min("first").alias("component_id"), F.count("*").alias("classes"))
    ends = join_by_group(lowest, least_id, "label", "classes", total).select("key", "class_size", "component_id")
    out = join_by_group(full.select("doc_id", "n", "key"), ends, "key", "class_size", total).select("doc_id", "n", "component_id", "class_size")
    out = out.unionByName(signs.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("class_size")))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "class_size")


def op9_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir), words=3, least=85).drop("class_size")
