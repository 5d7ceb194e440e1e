"""Benchmark decontamination: suffix arrays over the training texts, searched for every suffix of the test items.

A task cuts its documents into shards of about ``SHARD`` words and sorts the suffixes of a shard: first by as many words as
fit in one number, then by doubling, and only where suffixes are still equal, up to the length of the longest item. Suffixes
that start with a word of no item can match nothing and are left out. Every suffix of every item is then searched by binary
search, one word deeper at a time: the last depth that is found is its longest verbatim match, the interval holds the places,
and the interval at the depth of the window holds all occurrences of the window. Documents never leave their task, so
nothing is shuffled; a long text is cut into overlapping pieces. The items are sent to the tasks in blocks of
bounded size; every further block is one more pass.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator, Sequence
from functools import partial, reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockhealth.llm.common import pin, small_batches

WINDOW = 10
SHARD = 1 << 20  # words in one suffix array
BLOCK = 2_000_000  # bytes of the items that are sent to the tasks at once
_CUT = 1 << 24  # bytes that are split into words at a time

# Words are runs of bytes other than 00-2F, 3A-40, 5B-60 and 7B-7F; A-Z become a-z first.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded size."""
    data = (text or "").encode().translate(_TABLE)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + _CUT)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


class Tests:
    """Test items as word numbers from 1, each followed by a 0, which no text matches.

    ``starts`` has the place of every suffix, ``owner`` its item and ``wants`` the words of the window that starts there, 0 for none.
    """

    __test__ = False  # no test case

    def __init__(self, items: Iterable[tuple[str | None, str | None]], window: int = WINDOW, shard: int = SHARD):
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str | None] = []
        texts, owners, wants = [], [], []
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for part in words(text) for w in part]
            if not ids:
                continue
            n = len(ids)
            texts.append(np.array([*ids, 0], np.int32))
            owners.append(np.full(n + 1, len(self.names)))
            wants.append(np.where(np.arange(n + 1) <= n - window, window, 0) if n >= window else np.array([n] + [0] * n))
            self.names.append(name)
        self.text, self.owner, self.wants = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (texts, owners, wants))
        self.starts = np.flatnonzero(self.text)
        self.depth = max(map(len, texts), default=1) - 1  # words of the longest item
        self.shard = max(shard, 2 * self.depth)
        self.offset = self.starts - np.searchsorted(self.owner, self.owner[self.starts])

    def numbers(self, text: str | None) -> np.ndarray:
        get = self.vocabulary.get
        parts = [np.fromiter(map(get, part, repeat(0)), np.int32, len(part)) for part in words(text)]
        return parts[0] if len(parts) == 1 else np.concatenate([*parts, np.empty(0, np.int32)])


def suffix_array(text: np.ndarray, top: int, depth: int) -> np.ndarray:
    """Places of the numbers 1 to ``top`` in the order of what follows, up to ``depth`` numbers; a 0 ends a suffix."""
    bits = max(1, int(top).bit_length())
    known = min(63 // bits, depth)
    n = len(text)
    padded = np.concatenate([text.astype(np.int64), np.zeros(known, np.int64)])
    key, whole = padded[:n].copy(), padded[:n] > 0
    for k in range(1, known):
        whole &= padded[k:k + n] > 0
        key = key << bits | np.where(whole, padded[k:k + n], 0)
    order = np.flatnonzero(text)
    order = order[np.argsort(key[order], kind="stable")]
    if not len(order):
        return order
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    del key
    while known < depth:
        group = np.cumsum(new)
        equal = ~(new & np.append(new[1:], True)) & whole[order]
        if not equal.any():
            break
        rank = np.zeros(n + known + 1, np.int64)
        rank[order] = group
        slots = np.flatnonzero(equal)
        places = order[slots]
        # Equal suffixes keep the slots of their group; what follows the known numbers orders them.
        pair = group[slots] * (group[-1] + 1) + rank[places + known]
        turn = np.argsort(pair, kind="stable")
        places, pair = places[turn], pair[turn]
        order[slots] = places
        new[slots] |= np.concatenate(([True], pair[1:] != pair[:-1]))
        whole = whole & np.append(whole[known:], np.zeros(min(known, n), bool))[:n]
        known *= 2
    return order


def search(text: np.ndarray, order: np.ndarray, tests: Tests) -> tuple[np.ndarray, ...]:
    """For every suffix of the items: interval of its window (empty if not found), length and interval of its longest match."""
    padded = np.concatenate([text, np.zeros(tests.depth + 1, text.dtype)])
    low, high = np.zeros(len(tests.starts), np.int64), np.full(len(tests.starts), len(order))
    window_low, window_high, length = np.zeros_like(low), np.zeros_like(low), np.zeros_like(low)
    live = np.arange(len(tests.starts))
    for j in range(tests.depth):
        wanted = tests.text[tests.starts[live] + j]
        live, wanted = live[wanted > 0], wanted[wanted > 0]

        def first(bound: np.ndarray) -> np.ndarray:
            """The first slot of each interval whose number ``j`` is not below the bound."""
            a, b = low[live].copy(), high[live].copy()
            while (open_ := a < b).any():
                middle = (a + b) >> 1
                below = open_ & (padded[order[np.minimum(middle, len(order) - 1)] + j] < bound)
                a = np.where(below, middle + 1, a)
                b = np.where(open_ & ~below, middle, b)
            return a

        a, b = first(wanted), first(wanted + 1)
        found = a < b
        live, a, b = live[found], a[found], b[found]
        if not len(live):
            break
        low[live], high[live], length[live] = a, b, j + 1
        done = live[tests.wants[tests.starts[live]] == j + 1]
        window_low[done], window_high[done] = low[done], high[done]
    return window_low, window_high, length, low, high


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All slots of the intervals, and the interval of each."""
    n = high - low
    which = np.repeat(np.arange(len(low)), n)
    return np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum()), which


def _shards(rows: Iterable[np.ndarray], tests: Tests) -> Iterator[tuple[np.ndarray, ...]]:
    """Texts in shards: the numbers, and per piece its row, its place in the shard, its place in the row's text and where it ends.

    A piece overlaps the next one of its text by one word less than the longest item; a match that starts in the overlap is the next one's.
    """
    size, over = tests.shard, max(tests.depth - 1, 0)
    parts, row, place, start, end, total = [], [], [], [], [], 0
    gap = np.zeros(1, np.int32)
    for i, numbers in enumerate(rows):
        for at in range(0, max(len(numbers) - over, 1), size):
            piece = numbers[at:at + size + over]
            row.append(i)
            place.append(total)
            start.append(at)
            end.append(total + (size if at + size < len(numbers) - over else len(piece)))
            parts += [piece, gap]
            total += len(piece) + 1
            if total >= size:
                yield np.concatenate(parts), np.array(row), np.array(place), np.array(start), np.array(end)
                parts, row, place, start, end, total = [], [], [], [], [], 0
    if parts:
        yield np.concatenate(parts), np.array(row), np.array(place), np.array(start), np.array(end)


def _hits(tests: Tests, rows: int, texts: Iterable[np.ndarray]) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
    """Per row the runs of its text that are inside windows (they may overlap) and the names of the items."""
    runs, items = [[] for _ in range(rows)], [set() for _ in range(rows)]
    for text, row, place, start, _ in _shards(texts, tests):
        order = suffix_array(text, len(tests.vocabulary), tests.depth)
        low, high, *_ = search(text, order, tests)
        found = np.flatnonzero(low < high)
        if not len(found):
            continue
        # Items may share a window: the same interval at the same depth.
        wants = tests.wants[tests.starts[found]]
        window, which = np.unique(np.stack([low[found], high[found], wants]), axis=1, return_inverse=True)
        which = which.ravel()
        slots, w = _expand(window[0], window[1])
        at = order[slots]
        edge = np.zeros(len(text) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window[2][w], -1)
        edge = np.diff(np.concatenate(([0], (np.cumsum(edge)[:-1] > 0).astype(np.int8), [0])))
        begin, end = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
        piece = np.searchsorted(place, begin, side="right") - 1
        shift = start[piece] - place[piece]
        for i, a, b in zip(row[piece].tolist(), (begin + shift).tolist(), (end + shift).tolist()):
            runs[i].append((a, b))
        pairs = np.unique(row[np.searchsorted(place, at, side="right") - 1] * len(window[0]) + w)
        owners: list[set[str]] = [set() for _ in window[0]]
        for k, o in zip(which.tolist(), tests.owner[tests.starts[found]].tolist()):
            if tests.names[o] is not None:
                owners[k].add(tests.names[o])
        for pair in pairs.tolist():
            items[pair // len(window[0])] |= owners[pair % len(window[0])]
    return runs, items


def merged(runs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _pass(tests: Tests, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs, items and number of words of every row, those of earlier passes included."""
    for frame in frames:
        sizes: list[int] = []

        def texts(sizes=sizes, frame=frame) -> Iterator[np.ndarray]:
            for text in frame["_text"]:
                numbers = tests.numbers(text)
                sizes.append(len(numbers))
                yield numbers

        runs, items = _hits(tests, len(frame), texts())
        for i, (before, named) in enumerate(zip(frame["_runs"], frame["_items"])):
            if before is not None:
                runs[i] += map(tuple, np.frombuffer(before, np.int64).reshape(-1, 2).tolist())
            if named is not None:
                items[i] |= set(named)
        frame["_runs"] = [np.array(merged(r), np.int64).tobytes() for r in runs]
        frame["_items"] = [sorted(s) for s in items]
        frame["_words"] = sizes
        yield frame


def _blocks(items: DataFrame, id_col: str, text_col: str, window: int, shard: int) -> Iterator[Tests]:
    """The items in blocks of about ``BLOCK`` bytes; just one is on the driver at a time."""
    rows = items.select(F.col(id_col).cast("string").alias("name"), F.col(text_col).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / BLOCK))
    for b in range(blocks):
        some = rows.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == b) if blocks > 1 else rows
        yield Tests((tuple(r) for r in some.collect()), window, shard)


def search_documents(
    docs: DataFrame, items: DataFrame, keep: Sequence[str], text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, shard: int = SHARD,
) -> DataFrame:
    """Per row the ``keep`` columns, ``_words``, ``_runs`` (hit words as pairs of longs, in bytes) and ``_items``."""
    small_batches(docs.sparkSession)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    rows = docs.select(*keep, docs[text_col].alias("_text"), F.lit(None).cast("binary").alias("_runs"),
                       F.lit(None).cast("array<string>").alias("_items"), F.lit(0).cast("long").alias("_words"))
    schema = f"{kinds}, _text string, _runs binary, _items array<string>, _words long"
    before = None
    for tests in _blocks(items, item_id, item_text, window, shard):
        rows = rows if before is None else pin(before, "passes")
        before = rows.mapInPandas(partial(_pass, tests), schema)
    return before.drop("_text")


def report(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, shard: int = SHARD,
) -> DataFrame:
    """One row per input row: id, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. A word inside any
    occurrence of a window is hit. Null texts have no words. Items that share an id count once; an item without an id hits
    words but is not counted or named. Rows that share an id, or have none, are reported one by one. Empty tables give an empty
    result, or no hits.
    """
    found = search_documents(docs.select(F.col(id_col), F.col(text_col)), items, [id_col], text_col, item_id, item_text, window, shard)
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            hit = [int((r := np.frombuffer(b, np.int64).reshape(-1, 2))[:, 1].sum() - r[:, 0].sum()) for b in frame["_runs"]]
            lists = [sorted(x) for x in frame["_items"]]
            yield pd.DataFrame(dict(zip(names, (
                frame[id_col], frame["_words"], hit, [len(x) for x in lists],
                [hashlib.sha256(",".join(x).encode()).hexdigest() for x in lists], [h > 0 for h in hit]))))

    return found.mapInPandas(digest, f"`{id_col}` {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def remove(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold a window of an item; rows that share an id go together."""
    bad = report(docs, items, id_col, text_col, **options).where("contaminated").select(F.col(id_col).alias("_bad")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_bad"]), "left_anti")


def longest_matches(
    docs: DataFrame, items: DataFrame, least: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", shard: int = SHARD,
) -> DataFrame:
    """Per item suffix with a verbatim match of ``least`` words or more: the longest one, and where it is.

    ``item_id`` (as text), ``item_word`` (where the suffix starts, from 0), ``n_words`` (of the longest match in any document),
    ``n_places``, and the first place by id: ``doc_id``, ``doc_word``. Every shard sends one row for a suffix it holds.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(tests: Tests, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids = frame["_id"]
            for text, row, place, start, end in _shards(map(tests.numbers, frame["_text"]), tests):
                order = suffix_array(text, len(tests.vocabulary), tests.depth)
                *_, length, low, high = search(text, order, tests)
                found = np.flatnonzero(length >= least)
                if not len(found):
                    continue
                slots, which = _expand(low[found], high[found])
                at = order[slots]
                piece = np.searchsorted(place, at, side="right") - 1
                own = at < end[piece]
                at, which, piece = at[own], which[own], piece[own]
                out = pd.DataFrame({"which": which, "_id": ids.iloc[row[piece]].to_numpy(), "_word": at - place[piece] + start[piece]})
                out = out.sort_values(["which", "_id", "_word"])
                out["n_places"] = out.groupby("which")["which"].transform("size")
                out = out.drop_duplicates("which")
                found = found[out.pop("which").to_numpy()]
                if not len(found):
                    continue
                suffix = tests.starts[found]
                yield pd.DataFrame({
                    "item_id": [tests.names[o] for o in tests.owner[suffix]], "item_word": tests.offset[found], "n_words": length[found],
                    "n_places": out["n_places"].to_numpy(), "_id": out["_id"].to_numpy(), "_word": out["_word"].to_numpy()})

    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    schema = f"item_id string, item_word long, n_words long, n_places long, _id {kind}, _word long"
    blocks = [rows.mapInPandas(partial(run, tests), schema) for tests in _blocks(items, item_id, item_text, least, shard)]
    every = reduce(DataFrame.unionByName, blocks)
    best = every.groupBy("item_id", "item_word", "n_words").agg(F.sum("n_places").alias("n_places"), F.min(F.struct("_id", "_word")).alias("_at"))
    top = best.groupBy("item_id", "item_word").agg(F.max_by(F.struct("n_words", "n_places", "_at"), "n_words").alias("v"))
    return top.select("item_id", "item_word", "v.n_words", "v.n_places", F.col("v._at._id").alias(id_col), F.col("v._at._word").alias("doc_word"))
