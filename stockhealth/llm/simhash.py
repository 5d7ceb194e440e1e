"""SimHash near-duplicates: fingerprints of word shingles, linked by search in BK-trees.

Fingerprints are dealt to shards by keys that close ones have in common. A BK-tree holds each shard: a child hangs
from its parent on the edge of their Hamming distance, and a search with radius r from distance d follows only
the edges d - r to d + r. The trees of all fingerprints grow with the corpus, so a tree is not sent to every executor:
it is built, searched and dropped in the task that has the shard, many small trees at once as one forest.

Keys, for radius 2 in 64 bits: the bits form 8 groups, and two fingerprints that differ in at most 2 bits agree in
some 6 of them. Each of the 28 choices is a key, so no link is lost, and as 48 bits are fixed a shard has at most
65,536 different fingerprints. For wide radii (``sampled_keys``) a key is a number of random bits, and there are as many
tables as a stated recall needs.
"""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockhealth.llm.common import cells, components, pin, small_batches

SEED = 42
BLOCK = 4096  # a cell has about twice as many fingerprints at most
_ROWS = 60_000  # rows of small shards that are searched together
_PAIRS = 100_000  # pairs of query and node that are compared at once


def shingles(text: str | None, words: int = 3) -> np.ndarray:
    """XXH64 of each run of ``words`` words, repeats included; a shorter text is one shingle, a wordless one has none."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - words + 1)
    pairs = zip(starts[:n].tolist(), ends[min(words, len(parts)) - 1:].tolist())
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[s:e], SEED) for s, e in pairs], np.uint64, n)


def fingerprint(text: str | None, words: int = 3, lanes: int = 1) -> list[int]:
    """``lanes`` signed 64-bit numbers. Lane 0 takes the bits of each shingle's XXH64, the others bits mixed from it.

    A bit is 1 if over half of the shingles (repeats included) have it. Null or no words: all zero.
    """
    return _print(shingles(text, words), lanes)


def _print(h: np.ndarray, lanes: int) -> list[int]:
    n, out = len(h), []
    if not n:
        return [0] * lanes
    for lane in range(lanes):
        ones = np.zeros(64, np.int64)
        for at in range(0, n, 255 * 256):
            bits = np.unpackbits(_lane(h[at:at + 255 * 256], lane).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            if len(bits) > 255:  # sums of 255 rows fit a byte
                full = len(bits) // 255 * 255
                ones += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
                bits = bits[full:]
            ones += bits.sum(axis=0, dtype=np.uint8)
        out.append(int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0]))
    return out


def _lane(h: np.ndarray, lane: int) -> np.ndarray:
    if not lane:
        return h
    with np.errstate(over="ignore"):
        x = h + np.uint64(0x9E3779B97F4A7C15 * lane % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, lanes: int = 1) -> DataFrame:
    """``_id`` and lanes ``f0``, ``f1``, … of every row."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = [f"f{i}" for i in range(lanes)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            prints = [fingerprint(t, words, lanes) for t in frame["_text"]]
            out = pd.DataFrame(np.array(prints, np.int64).reshape(-1, lanes), columns=names)
            out.insert(0, "_id", frame["_id"].to_numpy())
            yield out

    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    return rows.mapInPandas(run, ", ".join([f"_id {kind}", *(f"{c} long" for c in names)]))


def exact_keys(radius: int, spare: int = 6) -> list[list[int]]:
    """Masks of 64 bits: every pair within ``radius`` agrees under one of them."""
    groups = radius + spare
    cuts = [64 * i // groups for i in range(groups + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [[sum(kept)] for kept in combinations(parts, spare)]


def sampled_keys(n: int, lanes: int, radius: int, recall: float, width: int | None = None) -> list[list[int]]:
    """Masks with ``width`` (about log2(n)) random bits, as many as find a pair at ``radius`` with probability ``recall``."""
    bits, width = 64 * lanes, width or max(12, math.ceil(math.log2(max(n, 2))))
    tables = math.ceil(math.log(1 - recall) / math.log(1 - (1 - radius / bits) ** width))
    rng = np.random.default_rng(SEED)
    masks = []
    for _ in range(tables):
        chosen = rng.choice(bits, width, replace=False).tolist()
        masks.append([sum(1 << b % 64 for b in chosen if b // 64 == lane) for lane in range(lanes)])
    return masks


class Forest:
    """BK-trees over fingerprints (n x lanes, uint64), one for each value of ``group`` (rows sorted by it)."""

    def __init__(self, prints: np.ndarray, group: np.ndarray):
        self.lanes = [np.ascontiguousarray(lane) for lane in prints.T]
        self.width = prints.shape[1] * 64 + 1
        first = np.concatenate(([True], group[1:] != group[:-1]))
        self.root = np.flatnonzero(first)[np.cumsum(first) - 1]
        keys, kids = [], []
        waiting = np.flatnonzero(~first)
        at = self.root[waiting]
        while len(waiting):
            key = at * self.width + self.distance(waiting, at)
            order = np.argsort(key, kind="stable")
            key, waiting = key[order], waiting[order]
            new = np.concatenate(([True], key[1:] != key[:-1]))
            keys.append(key[new])
            kids.append(waiting[new])
            at = waiting[new][np.cumsum(new) - 1][~new]
            waiting = waiting[~new]
        key = np.concatenate([*keys, np.empty(0, np.int64)])
        order = np.argsort(key)
        self.key, self.kid = key[order], np.concatenate([*kids, np.empty(0, np.int64)])[order]
        self.inner = np.zeros(len(group), bool)  # nodes with children
        self.inner[self.key // self.width] = True

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        far = np.zeros(len(a), np.uint16)
        for lane in self.lanes:
            far += np.bitwise_count(lane[a] ^ lane[b])
        return far.astype(np.int64)

    def close(self, queries: np.ndarray, radius: int, earlier: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node of its tree) within the radius, in pieces. With ``earlier`` only nodes of smaller rows, and roots.

        A child's row is larger than its parent's, so a later child's subtree is left out as a whole.
        """
        todo = [(queries, self.root[queries])]
        while todo:
            q, node = todo.pop()
            if len(q) > _PAIRS and len(q) > 1:
                half = len(q) // 2
                todo += [(q[:half], node[:half]), (q[half:], node[half:])]
                continue
            d = self.distance(q, node)
            near = np.flatnonzero(d <= radius)
            yield q[near], node[near]
            inner = np.flatnonzero(self.inner[node])
            q, node, d = q[inner], node[inner], d[inner]
            low = np.searchsorted(self.key, node * self.width + np.maximum(d - radius, 0))
            high = np.searchsorted(self.key, node * self.width + np.minimum(d + radius, self.width - 1), side="right")
            n = high - low
            if total := int(n.sum()):
                kid, q = self.kid[np.arange(total) + np.repeat(low - np.cumsum(n) + n, n)], np.repeat(q, n)
                if earlier:
                    kept = np.flatnonzero(kid < q)
                    kid, q = kid[kept], q[kept]
                todo.append((q, kid))


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union-find over arrays: ``label`` points to smaller members; afterwards a and b share one."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, up := label[label]):
            label = up


def chunks(batches: Iterator[pd.DataFrame], keys: Sequence[str], rows: int) -> Iterator[pd.DataFrame]:
    """Whole groups of a partition sorted by ``keys``, about ``rows`` rows at a time."""
    rest: list[pd.DataFrame] = []
    for frame in batches:
        rest.append(frame)
        if sum(map(len, rest)) < rows:
            continue
        all_rows = pd.concat(rest, ignore_index=True)
        values = all_rows[list(keys)].to_numpy()
        changes = np.flatnonzero((values[1:] != values[:-1]).any(axis=1))
        if len(changes):
            cut = changes[-1] + 1
            yield all_rows.iloc[:cut]
            rest = [all_rows.iloc[cut:]]
        else:
            rest = [all_rows]
    if rest and sum(map(len, rest)):
        yield pd.concat(rest, ignore_index=True)


def _search(lanes: Sequence[str], radius: int, keys: Sequence[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in chunks(batches, keys, _ROWS):
            values = frame[list(keys)].to_numpy()
            group = np.concatenate(([0], np.cumsum((values[1:] != values[:-1]).any(axis=1))))
            prints = np.ascontiguousarray(frame[list(lanes)].to_numpy(np.int64)).view(np.uint64)
            forest = Forest(prints, group)
            label = np.arange(len(frame))
            for q in np.array_split(label, max(1, len(frame) // 2048)):
                for a, b in forest.close(q, radius):
                    label = join_labels(label, a, b)
            node = frame["_node"].to_numpy()
            linked = label != np.arange(len(frame))
            yield pd.DataFrame({"a": node[linked], "b": node[label[linked]]})

    return run


def links(classes: DataFrame, lanes: Sequence[str], masks: list[list[int]], radius: int) -> DataFrame:
    """Edges (a, b) that connect all classes within the radius that share a key: at most one for each row of a shard."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keys = [
        F.struct(F.lit(i).alias("_table"), (F.xxhash64(*[F.col(c).bitwiseAND(F.lit(signed(m))) for c, m in zip(lanes, mask)])
                 if len(lanes) > 1 else F.col(lanes[0]).bitwiseAND(F.lit(signed(mask[0])))).alias("_key"))
        for i, mask in enumerate(masks)
    ]
    rows = classes.select("_node", *lanes, F.inline(F.array(*keys)))
    cell = ["_table", "_key", "_x", "_y"]
    sharded = cells(rows, ["_table", "_key"], BLOCK, F.xxhash64("_node")).drop("_b")
    sharded = sharded.repartition(*cell).sortWithinPartitions(*cell)
    return sharded.mapInPandas(_search(lanes, radius, cell), "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, lanes: int = 1, radius: int = 2,
    recall: float | None = None,
) -> DataFrame:
    """One row per input row: id, lanes ``f0``…, ``component_id`` (smallest id reachable through links, own included).

    Rows with equal fingerprints form a class; only classes are compared. With ``recall`` the keys are sampled bits, without it
    every link within ``radius`` (one lane) is found. Null and wordless texts have fingerprint zero and link like any other. A null id names no
    component: its row gets the smallest id of its component that is not null, or null. Rows that share an id count as one document. An
    empty table gives an empty result.
    """
    names = [f"f{i}" for i in range(lanes)]
    prints = pin(fingerprints(docs, id_col, text_col, words, lanes), "fingerprints")
    classes = pin(prints.groupBy(*names).agg(F.min("_id").cast("long").alias("_node")), "classes")
    named = classes.where("_node IS NOT NULL")
    masks = exact_keys(radius) if recall is None else sampled_keys(named.count(), lanes, radius, recall)
    roots = components(links(named, names, masks, radius))
    classes = classes.join(roots, classes["_node"] == roots["node"], "left")
    classes = classes.select(*[F.col(c).alias(f"_{c}") for c in names], F.coalesce("root", "_node").alias("component_id"))
    same: Column = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"_{c}") for c in names])
    return prints.join(classes, same).select(F.col("_id").alias(id_col), *names, "component_id")


# Near-duplicates by the Jaccard similarity of shingle sets. A pair at 0.8 differs in about 39 of 256 bits (48 if one text has four
# shingles and the other five), unrelated texts in 128. The keys find a pair at ``PLAN`` bits with probability ``FOUND``.
RADIUS, PLAN, FOUND, WIDTH = 64, 60, 0.99, 10
MEMBERS, SHINGLES = 1024, 500_000  # texts and shingles of a block of candidates


def _sets(words: int, lanes: Sequence[str], keys: Sequence[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            sets = [np.unique(shingles(t, words)) for t in frame["_text"]]
            out = frame[list(keys)].copy()
            for name, values in zip(lanes, np.array([_print(h, len(lanes)) for h in sets], np.int64).reshape(-1, len(lanes)).T):
                out[name] = values
            out["_set"] = np.array([xxhash.xxh3_64_intdigest(h.tobytes()) for h in sets], np.uint64).view(np.int64)
            out["_size"] = [len(h) for h in sets]
            yield out

    return run


def _candidates(lanes: Sequence[str], radius: int, keys: Sequence[str]):
    """Edges that connect the rows of a shard within the radius, found by search in a BK-tree for each shard.

    Rows are sorted by shard and node. Equal prints of a shard are linked as they are and stand in its tree once. What the shards
    of a chunk link is joined first, so a chunk sends at most one edge for each node, to the smallest node that it is linked with.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in chunks(batches, keys, _ROWS):
            values = frame[list(keys)].to_numpy()
            shard = np.concatenate(([0], np.cumsum((values[1:] != values[:-1]).any(axis=1))))
            prints = np.ascontiguousarray(frame[list(lanes)].to_numpy(np.int64)).view(np.uint64)
            nodes, place = np.unique(frame["_node"].to_numpy(), return_inverse=True)
            order = np.lexsort((*prints.T, shard))
            same = (shard[order][1:] == shard[order][:-1]) & (prints[order][1:] == prints[order][:-1]).all(axis=1)
            label = join_labels(np.arange(len(nodes)), place[order[1:][same]], place[order[:-1][same]])
            rows = np.sort(order[np.concatenate(([True], ~same))])
            forest, place = Forest(prints[rows], shard[rows]), place[rows]
            for q in np.array_split(np.arange(len(rows)), max(1, len(rows) // 2048)):
                for a, b in forest.close(q, radius, earlier=True):
                    a, b = place[a], place[b]
                    apart = label[a] != label[b]
                    label = join_labels(label, a[apart], b[apart]) if apart.any() else label
            linked = label != np.arange(len(nodes))
            yield pd.DataFrame({"a": nodes[linked], "b": nodes[label[linked]]})

    return run


def _alike(words: int, percent: int, keys: Sequence[str]):
    """Edges that connect the texts of a cell whose shingle sets have a Jaccard similarity of at least ``percent``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in chunks(batches, keys, 2 * MEMBERS):
            values = frame[list(keys)].to_numpy()
            group = np.concatenate(([0], np.cumsum((values[1:] != values[:-1]).any(axis=1)))).astype(np.uint64)
            sets = [np.unique(shingles(t, words)) for t in frame.pop("_text")]
            size = np.array([len(h) for h in sets])
            owner = np.repeat(np.arange(len(sets)), size)
            every = np.concatenate([*sets, np.empty(0, np.uint64)])
            order = np.lexsort((every, group[owner]))
            every, holder = every[order], owner[order]
            new = np.concatenate(([True], (every[1:] != every[:-1]) | (group[holder][1:] != group[holder][:-1])))[:len(every)]
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(every)))
            which = np.empty(len(every), np.int64)
            which[order] = np.cumsum(new) - 1
            begin = np.concatenate(([0], np.cumsum(size)))
            label = np.arange(len(sets))
            for x in range(len(sets)):
                mine = which[begin[x]:begin[x + 1]]
                mine = mine[count[mine] > 1]
                n = count[mine]
                inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                shared = np.bincount(holder[np.repeat(first[mine], n) + inside], minlength=1)
                other = np.flatnonzero(shared[:x])
                # shared / (all of both - shared) >= percent / 100, in whole numbers
                other = other[(100 + percent) * shared[other] >= percent * (size[x] + size[other])]
                other = other[label[other] != label[x]]
                if len(other):
                    label = join_labels(label, np.full(len(other), x), other)
            node = frame["_node"].to_numpy()
            linked = label != np.arange(len(sets))
            yield pd.DataFrame({"a": node[linked], "b": node[label[linked]]})

    return run


def first_of_alike(docs: DataFrame, keys: Sequence[str], text_col: str = "text", words: int = 5, lanes: int = 4, percent: int = 80) -> DataFrame:
    """The smallest ``keys`` (no nulls, numbers) of every group of texts linked by a Jaccard similarity of at least ``percent`` hundredths.

    Texts with one set of shingles form a class. SimHash links classes within ``RADIUS`` bits that share a key of ``WIDTH`` sampled
    bits; these links only propose groups. Any two members of a proposed group meet in a cell, where their sets are
    compared, and only edges that reach the similarity count. Wordless texts are one class.
    """
    small_batches(docs.sparkSession)
    names, keys = [f"f{i}" for i in range(lanes)], list(keys)
    kinds = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys)
    rows = docs.select(*keys, docs[text_col].alias("_text"))
    prints = rows.mapInPandas(_sets(words, names, keys), f"{kinds}, {', '.join(f'{c} long' for c in names)}, _set long, _size long")
    classes = prints.groupBy(*names, "_set").agg(F.min(F.struct(*keys)).alias("_key"), F.max("_size").alias("_size"))
    classes = pin(classes.withColumn("_node", F.monotonically_increasing_id()), "classes")

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    masks = sampled_keys(0, lanes, PLAN, FOUND, WIDTH)
    buckets = F.array(*[F.xxhash64(F.lit(i), *[F.col(c).bitwiseAND(F.lit(signed(m))) for c, m in zip(names, mask)]) for i, mask in enumerate(masks)])
    spread = classes.select("_node", *names, F.explode(buckets).alias("_bucket"))
    hot = pin(spread.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 2 * BLOCK), "hot")
    if (n := hot.count()) and n <= 100_000:
        hot = F.broadcast(hot)
    blocks = F.coalesce(F.ceil(F.col("_n") / BLOCK), F.lit(1)).cast("int")
    spread = spread.join(hot, "_bucket", "left").withColumn("_m", blocks) if n else spread.withColumn("_m", F.lit(1))
    spread = _paired(spread).select("_node", *names, "_bucket", "_cell")
    cell = ["_bucket", "_cell"]
    sharded = spread.repartition(*cell).sortWithinPartitions(*cell, "_node")
    roots = components(sharded.mapInPandas(_candidates(names, RADIUS, cell), "a long, b long"))

    members = classes.join(roots, classes["_node"] == roots["node"], "left").select("_node", "_key.*", "_size", F.coalesce("root", "_node").alias("_group"))
    sizes = members.groupBy("_group").agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_all")).where("_n > 1")
    blocks = F.greatest(F.when(F.col("_n") > 2 * MEMBERS, F.ceil(F.col("_n") / MEMBERS)).otherwise(1),
                        F.when(F.col("_all") > 2 * SHINGLES, F.least("_n", F.ceil(F.col("_all") / SHINGLES))).otherwise(1)).cast("int")
    members = members.join(sizes.select("_group", blocks.alias("_m")), "_group")
    texts = members.join(rows, keys).select("_group", "_m", "_node", "_text")
    cell = ["_group", "_cell"]
    texts = _paired(texts).select(*cell, "_node", "_text").repartition(*cell).sortWithinPartitions(*cell, "_node")
    found = components(texts.mapInPandas(_alike(words, percent, cell), "a long, b long"))
    whole = classes.join(found, classes["_node"] == found["node"], "left").select("_key", F.coalesce("root", "_node").alias("_group"))
    return whole.groupBy("_group").agg(F.min("_key").alias("_key")).select("_key.*")


def _paired(rows: DataFrame) -> DataFrame:
    """Rows of a group cut into ``_m`` blocks, once for each ``_cell`` of two blocks, so that any two rows meet."""
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("_node"), F.col("_m").cast("long")))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m").cast("long") - 1)))
    return rows.withColumn("_cell", F.least("_b", "_o") * F.lit(1 << 31) + F.greatest("_b", "_o"))
