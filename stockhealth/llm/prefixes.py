"""Prefix trie of conversations: a node for every distinct beginning, with what sharing it would save.

A conversation is a path of turns, each by its digest; chained digests name the nodes. Equal conversations are one path with a
weight. Paths are dealt to shards by the shortest prefix that at most ``PATHS`` of them share; in a shard the shared
parts go into a double-array trie: turns are numbered densely, the child of a node for turn t is at BASE[node] + t if CHECK there
is the node. Walking the arrays gives the nodes and, from the deepest up, their sums. What only one path has is its tail
and needs no trie. The upper nodes, shared by several shards, get their sums from all shards in one global aggregation.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockhealth.llm.common import WORD, pin
from stockhealth.llm.simhash import chunks

PATHS = 2000  # different paths in a shard at most
_ROWS = 60_000  # rows of small shards that go into one trie
_TRIES = 32  # free places tried for a node's children before they go to the end
_ROOT = bytes(16)
_NODE = ("_key binary, conv_id long, depth long, parent_conv_id long, _up binary, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, ends_sha256 string")
_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_NONE = hashlib.sha256(b"").hexdigest()


class DoubleArray:
    """BASE and CHECK of a trie over symbols from 0; the root is at 0. A free place has CHECK -1."""

    def __init__(self, size: int = 1024):
        self.base, self.check = np.zeros(size, np.int64), np.full(size, -1)
        self.check[0], self.end, self.free = 0, 1, 1  # all places from ``end`` are free, all before ``free`` taken

    def _room(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1)])

    def _take(self, parents, places: np.ndarray) -> None:
        self.check[places] = parents
        self.end = max(self.end, int(places.max()) + 1)

    def _gaps(self, n: int) -> np.ndarray:
        """The first ``n`` free places."""
        self._room(self.end + n)
        found = self.free + np.flatnonzero(self.check[self.free:self.end + n] < 0)
        self.free = int(found[0])
        return found[:n]

    def insert(self, parents: np.ndarray, symbols: np.ndarray) -> None:
        """Children of leaves: unique pairs in the order of parent and symbol, all children of a parent at once."""
        begin = np.flatnonzero(np.concatenate(([True], parents[1:] != parents[:-1])))
        count = np.diff(np.append(begin, len(parents)))
        for i in begin[count > 1][np.argsort(-count[count > 1], kind="stable")].tolist():  # wide nodes first
            node = parents[i]
            mine = symbols[i:i + count[np.searchsorted(begin, i)]]
            reach = int(mine[-1] - mine[0]) + 1
            for gap in [*self._gaps(_TRIES).tolist(), self.end]:
                self._room(gap + reach)
                places = gap + mine - mine[0]
                if (self.check[places] < 0).all():
                    break
            self.base[node] = gap - mine[0]
            self._take(node, places)
        only = begin[count == 1]
        if len(only):
            places = self._gaps(len(only))
            self.base[parents[only]] = places - symbols[only]
            self._take(parents[only], places)

    def step(self, nodes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The child of each node for its symbol, -1 if it has none."""
        at = self.base[nodes] + symbols
        inside = (at > 0) & (at < len(self.check))
        at = np.where(inside, at, 0)
        return np.where(inside & (self.check[at] == nodes), at, -1)


def _ordered(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns of every conversation with their places from 0, digests and numbers of words; no text goes on."""
    said = F.concat(F.length("_role").cast("string"), F.lit(":"), F.col("_role"), F.col("_text"))
    rows = conversations.select(F.col(conv).cast("long").alias("_conv"), F.col(turn).alias("_turn"),
                                F.coalesce(role, F.lit("")).alias("_role"), F.coalesce(text, F.lit("")).alias("_text")).where("_conv IS NOT NULL")
    rows = rows.select("_conv", "_turn", "_role", F.unhex(F.substring(F.sha2(said, 256), 1, 32)).alias("_said"),
                       F.regexp_count("_text", F.lit(WORD)).cast("long").alias("_words"))
    order = Window.partitionBy("_conv").orderBy(F.asc_nulls_first("_turn"), "_role", "_said")
    return rows.select("_conv", (F.row_number().over(order) - 1).cast("long").alias("_at"), "_said", "_words")


def _rebuilt(turns: DataFrame, group: int, heads: int) -> DataFrame:
    """``_conv``, ``_part`` (-1: the root, 0: lent turns, 1: own turns), ``_at``, ``_said``, ``_words`` of every rebuilt conversation."""
    lent = F.pmod(F.crc32(F.col("_conv").cast("string").cast("binary")), F.lit(heads))
    first = F.array_sort(F.collect_list(F.when(F.col("_at") < heads - 1, F.struct("_at", "_said", "_words"))))
    convs = pin(turns.groupBy("_conv").agg(first.alias("_own")).withColumn("_base", F.col("_conv") - F.col("_conv") % group), "convs")
    bases = convs.select(F.col("_conv").alias("_base"), F.col("_own").alias("_head")).where(F.col("_base") % group == 0)
    head = convs.select("_conv", "_base").join(bases, "_base").select("_conv", F.inline("_head"))
    part = lambda df, p: df.select("_conv", F.lit(p).alias("_part"), "_at", "_said", "_words")
    root = convs.select("_conv", F.lit(0).cast("long").alias("_at"), F.lit(None).cast("binary").alias("_said"), F.lit(0).cast("long").alias("_words"))
    return part(root, -1).unionByName(part(head.where(F.col("_at") < lent), 0)).unionByName(part(turns.where(F.col("_at") >= lent), 1))


def _chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each node of a path, named by the chained digest of its turns; one row is held back to know the last of a path."""
    conv = held = None
    key, depth = _ROOT, 0
    names = ["_conv", "_depth", "_key", "_up", "_said", "_words", "_last"]
    for frame in batches:
        out = []
        for c, said, words in zip(frame["_conv"].tolist(), frame["_said"], frame["_words"].tolist()):
            if held:
                out.append((*held, c != conv))
            if c != conv:
                conv, key, depth, up = c, _ROOT, 0, None
            else:
                up, depth = key, depth + 1
                key = xxhash.xxh3_128_digest(key + said)
            held = (c, depth, key, up, said, words)
        if out:
            yield pd.DataFrame(out, columns=names)
    if held:
        yield pd.DataFrame([(*held, True)], columns=names)


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digest of the ids of equal conversations, from sorted pieces of their list; only the running digest is kept."""
    key = rep = digest = None
    weight = 0
    names = ["_end", "_rep", "_weight", "_sha"]
    for frame in batches:
        out = []
        for k, low, n, ids in zip(frame["_key"], frame["_low"].tolist(), frame["_n"].tolist(), frame["_ids"]):
            if k == key:
                digest.update(b",")
            else:
                if digest:
                    out.append((key, rep, weight, digest.hexdigest()))
                key, rep, weight, digest = k, low, 0, hashlib.sha256()
            digest.update(ids.encode())
            weight += n
        if out:
            yield pd.DataFrame(out, columns=names)
    if digest:
        yield pd.DataFrame([(key, rep, weight, digest.hexdigest())], columns=names)


def _tries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The nodes of whole shards. Rows are sorted by shard, path and depth."""
    for frame in chunks(batches, ["_shard"], _ROWS):
        if not len(frame):
            continue
        conv, depth = frame["_conv"].to_numpy(np.int64), frame["_depth"].to_numpy(np.int64)
        shard = pd.factorize(frame["_shard"])[0]
        new = np.concatenate(([True], (conv[1:] != conv[:-1]) | (shard[1:] != shard[:-1])))
        path = np.cumsum(new) - 1
        level = np.arange(len(frame)) - np.flatnonzero(new)[path]
        symbol = np.where(level == 0, shard, pd.factorize(frame["_said"])[0])

        # Pack level by level, then walk: every row of a path is at a node.
        by_level = np.argsort(level, kind="stable")
        cuts = np.concatenate((np.flatnonzero(np.diff(level[by_level])) + 1, [len(frame)]))
        trie, state, place, begin = DoubleArray(), np.zeros(path[-1] + 1, np.int64), np.empty(len(frame), np.int64), 0
        width = int(symbol.max()) + 1
        for cut in cuts.tolist():
            rows = by_level[begin:cut]
            pairs = np.unique(state[path[rows]] * width + symbol[rows])
            trie.insert(pairs // width, pairs % width)
            state[path[rows]] = place[rows] = trie.step(state[path[rows]], symbol[rows])
            begin = cut

        size = trie.end
        weight, tail = frame["_weight"].to_numpy(np.int64), frame["_tail"].to_numpy(bool)
        some = np.empty(size, np.int64)
        some[place] = np.arange(len(frame))  # any row of each node
        members, low = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max)
        np.add.at(members, place, weight)
        np.minimum.at(low, place, conv)
        nodes = np.flatnonzero(trie.check[:size] >= 0)[1:]
        rows, up = some[nodes], trie.check[nodes]
        children, leaves, saved = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        np.add.at(children, up, 1)
        saved[nodes] = (members[nodes] - 1) * frame["_words"].to_numpy(np.int64)[rows]
        np.add.at(children, place[tail], 1)
        np.add.at(leaves, place[tail], 1)
        np.add.at(saved, place[tail], frame["_tail_saved"].to_numpy(np.int64)[tail])
        deep = np.argsort(-level[rows], kind="stable")
        for some_nodes in np.split(nodes[deep], np.flatnonzero(np.diff(-level[rows][deep])) + 1):
            np.add.at(leaves, trie.check[some_nodes], leaves[some_nodes])
            np.add.at(saved, trie.check[some_nodes], saved[some_nodes])
        ends = np.full(size, None, object)
        sha = frame["_sha"].to_numpy(object)
        ended = frame["_last"].to_numpy(bool)
        ends[place[ended]] = sha[ended]
        top = up == 0
        parent = pd.array(low[up], "Int64")
        parent[top] = pd.NA
        yield pd.DataFrame({
            "_key": frame["_key"].to_numpy(object)[rows], "conv_id": low[nodes], "depth": depth[rows],
            "parent_conv_id": parent, "_up": np.where(top, frame["_up"].to_numpy(object)[rows], None),
            "n_convs": members[nodes], "n_children": children[nodes], "n_leaves": leaves[nodes], "saved_tokens": saved[nodes], "ends_sha256": ends[nodes]})


def trie(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", group: int = 20, heads: int = 4,
    paths: int = PATHS,
) -> DataFrame:
    """One row per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    Turns are ordered by ``turn``, null first, rows that share a turn by role and digest of the text; null roles and texts are empty.
    Conversation c starts with the first crc32(c) mod ``heads`` turns of conversation c - c % ``group`` in place of its own. Rows without a
    conversation id belong to none. A table without conversations has no node. Repeated rows are turns of their own.

    The turns of one conversation are read in order by one task, which holds one of them at a time; a task that packs a trie holds
    the shared turns of a shard, that is of ``paths`` different paths at most.
    """
    turns = pin(_ordered(conversations, conv, turn, role, text), "turns")
    rows = _rebuilt(turns, group, heads).repartition("_conv").sortWithinPartitions("_conv", "_part", "_at")
    schema = "_conv long, _depth long, _key binary, _up binary, _said binary, _words long, _last boolean"
    rows = pin(rows.select("_conv", "_said", "_words").mapInPandas(_chained, schema), "chained")

    # Equal conversations: pieces of their sorted ids by range of ids, so that a piece has a bounded length.
    ids = F.array_sort(F.collect_list("_conv"))
    pieces = rows.where("_last").groupBy("_key", F.shiftright("_conv", 16).alias("_piece")).agg(
        F.min("_conv").alias("_low"), F.count(F.lit(1)).alias("_n"), F.array_join(F.transform(ids, lambda c: c.cast("string")), ",").alias("_ids"))
    pieces = pieces.repartition("_key").sortWithinPartitions("_key", "_piece")
    ends = pieces.select("_key", "_low", "_n", "_ids").mapInPandas(_ends, "_end binary, _rep long, _weight long, _sha string")
    distinct = pin(rows.join(ends, F.col("_conv") == F.col("_rep")).drop("_end", "_rep"), "paths")

    # How many paths share a node decides where it is handled; the root is always an upper node.
    shared = distinct.where("_depth > 0").groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    n = F.when(F.col("_depth") == 0, F.lit(1 << 62)).otherwise(F.coalesce("_n", F.lit(1)))
    below = distinct.where("_depth > 0").join(shared, "_key", "left")
    below = below.unionByName(distinct.where("_depth = 0").withColumn("_n", F.lit(0).cast("long")))
    kind = F.when(n > max(paths, 1), 2).when(n > 1, 1).otherwise(0)  # 2: upper node, 1: in a shard, 0: tail of one path
    path = Window.partitionBy("_conv")
    from_end = path.orderBy(F.desc("_depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = (F.col("_weight") - 1) * F.col("_words")
    placed = below.withColumn("_kind", kind)
    placed = placed.withColumns({
        "_shard": F.min(F.when(F.col("_kind") == 1, F.struct("_depth", "_key"))).over(path)["_key"],
        "_deepest": F.max(F.when(F.col("_kind") == 1, F.col("_depth"))).over(path),
        "_tail_top": F.min(F.when(F.col("_kind") == 0, F.col("_depth"))).over(path),
        "_tail_sum": F.sum(F.when(F.col("_kind") == 0, own).otherwise(0)).over(from_end)})
    placed = placed.withColumn("_tail_saved", F.max(F.when(F.col("_depth") == F.col("_tail_top"), F.col("_tail_sum"))).over(path))
    placed = pin(placed.drop("_n"), "placed")

    dealt = placed.where("_kind = 1").withColumn("_tail", (F.col("_depth") == F.col("_deepest")) & F.col("_tail_top").isNotNull())
    dealt = dealt.withColumn("_tail_saved", F.coalesce("_tail_saved", F.lit(0)))
    dealt = dealt.repartition("_shard").sortWithinPartitions("_shard", "_conv", "_depth")
    inner = pin(dealt.mapInPandas(_tries, _NODE), "inner")

    top = F.col("_depth") == F.col("_tail_top")
    tails = placed.where("_kind = 0").select(
        "_key", F.col("_conv").alias("conv_id"), F.col("_depth").alias("depth"), F.when(~top, F.col("_conv")).alias("parent_conv_id"),
        F.when(top, F.col("_up")).alias("_up"), F.col("_weight").alias("n_convs"), F.when(F.col("_last"), 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.col("_tail_sum").alias("saved_tokens"), F.when(F.col("_last"), F.col("_sha")).alias("ends_sha256"),
        F.col("_shard").isNull().alias("_loose"))

    upper = _upper(placed.where("_kind = 2"), inner, tails.where("_up IS NOT NULL AND _loose"), own)
    inner_ids = inner.select(F.col("_key").alias("_up"), F.col("conv_id").alias("_parent"))
    upper_ids = upper.select(F.col("_key").alias("_up"), F.col("conv_id").alias("_parent"))
    node = [c for c in inner.columns]

    def under(rows: DataFrame, ids: DataFrame) -> DataFrame:
        return rows.join(ids, "_up", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_parent")).select(*_COLUMNS)

    # The root is the parent of very many nodes: the upper nodes, which are few, are joined on their own.
    nodes = [
        under(upper.select(*node).unionByName(inner.where("_up IS NOT NULL")).unionByName(tails.where("_up IS NOT NULL AND _loose").select(*node)), upper_ids),
        under(tails.where("_up IS NOT NULL AND NOT _loose").select(*node), inner_ids),
        inner.where("_up IS NULL").select(*_COLUMNS), tails.where("_up IS NULL").select(*_COLUMNS)]
    every = nodes[0].unionByName(nodes[1]).unionByName(nodes[2]).unionByName(nodes[3])
    return every.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NONE)))


def _upper(rows: DataFrame, inner: DataFrame, tails: DataFrame, own: Column) -> DataFrame:
    """The upper nodes, from the rows of all paths at them and the sums of the shards and tails below.

    A shard's sums count once, on the path of its smallest conversation; what an upper node saves itself counts for the upper
    nodes above it on its own smallest path.
    """
    tops = inner.where("_up IS NOT NULL").select("_up", "conv_id", "n_leaves", "saved_tokens").unionByName(
        tails.select("_up", "conv_id", "n_leaves", "saved_tokens"))
    rows = rows.join(tops.select(F.col("conv_id").alias("_conv"), "n_leaves", "saved_tokens"), "_conv", "left")
    upper = pin(rows.groupBy("_key").agg(
        F.min("_conv").alias("conv_id"), F.min("_depth").alias("depth"), F.max("_up").alias("_up"), F.sum("_weight").alias("n_convs"),
        F.max("_words").alias("_words"), F.coalesce(F.sum("n_leaves"), F.lit(0)).alias("_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("_saved"),
        F.max(F.when(F.col("_last"), F.col("_sha"))).alias("ends_sha256")), "upper")

    mine = upper.select("_key", F.col("conv_id").alias("_conv"), ((F.col("n_convs") - 1) * F.col("_words")).alias("_own"))
    on_path = rows.select("_conv", "_key", "_depth").join(mine.select("_conv").distinct(), "_conv").join(mine, ["_conv", "_key"], "left")
    from_end = Window.partitionBy("_conv").orderBy(F.desc("_depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = on_path.select("_key", F.sum(F.coalesce("_own", F.lit(0))).over(from_end).alias("_own")).groupBy("_key").agg(F.sum("_own").alias("_own"))
    children = tops.select("_up").unionByName(upper.where("depth > 0").select("_up")).groupBy("_up").agg(F.count(F.lit(1)).alias("_children"))
    whole = upper.join(above, "_key").join(children.withColumnRenamed("_up", "_key"), "_key", "left")
    n = F.coalesce("_children", F.lit(0))
    whole = whole.select("_key", "conv_id", "depth", F.lit(None).cast("long").alias("parent_conv_id"), "_up", "n_convs", n.alias("n_children"),
                         F.when(n == 0, 1).otherwise(F.col("_leaves")).cast("long").alias("n_leaves"), (F.col("_saved") + F.col("_own")).alias("saved_tokens"), "ends_sha256")
    return pin(whole, "upper_nodes")
