"""Removal of repeated byte strings with suffix arrays.

A byte goes if it lies in a string of ``SIZE`` bytes that also starts in a document with a smaller id. The place of
the smallest hash among the ``GRAM``-byte strings of a window is its anchor; it depends on the window's bytes
alone, so equal windows have equal anchors at equal places. Windows with the same anchor are a piece of text.
Marks of all pieces (anchor and digest of the bytes, no text) meet by anchor once. A piece that a smaller document has
too goes as a whole, within a batch before the marks move, so an anchor of very many copies is no large key. What is left
of an anchor are different pieces. The more text there is, the more documents share an anchor by chance, but a window that two pieces
share holds the ``SIDE`` bytes before the anchor or those after it, so a piece stays only if another one has the same bytes on a side
(a mark holds hashes of both). Only for these text is fetched, one for each, and they are sorted together in one suffix array;
an anchor with too many of them is split into parts by the bytes around it first. Neighbouring suffixes that agree in
``SIZE`` bytes are the equal windows, and the smallest id among them decides.

The suffix array comes from a linear grouping. Suffixes start in groups by their first byte. Groups are processed in descending
order: each suffix finds the previous smaller one by pointers that skip what is done, and that one's Lyndon prefix grows by the
group's, once for each repeat, which moves it to a group right above its own. In the end a group holds the suffixes of one Lyndon prefix;
then the groups are filled in ascending order, each suffix right after the one that follows its prefix. Nothing is renamed or compared again.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockhealth.llm.common import pin, pin_last, small_batches
from stockhealth.llm.simhash import chunks

SIZE, GRAM = 50, 16
SIDE = (SIZE - GRAM) // 2  # a window holds so many bytes before its anchor, or so many after it
_SIDE = 18  # bits of the hash of a side, 0 if the piece ends before; those of the anchor are above both
GROUP = 2000  # pieces of an anchor that go into one suffix array at most
RANGE = 7  # windows of a piece that are looked up by their common bytes
_ARRAY = 1 << 12  # bytes of the small groups that share a suffix array
_PART = 1 << 20  # bytes hashed at a time
_LOW = np.uint64(0xFFFFFF)
_BASE = 0x9E3779B97F4A7C15
_WEIGHTS = np.random.default_rng(SIZE).integers(0, 2**64, SIZE, np.uint64)  # of the bytes in a hash
_TAGS = 1 << 12  # texts under one id are told apart by a tag


def suffix_array(text: bytes) -> list[int]:
    """Start of every suffix of ``text`` in ascending order, in time linear in its length."""
    n = len(text)
    first = np.frombuffer(text, np.uint8)
    by_byte = np.argsort(first, kind="stable")
    sizes = np.bincount(first, minlength=256)
    starts = np.cumsum(sizes) - sizes
    rank = np.empty(n, np.int64)
    rank[by_byte] = np.arange(n)
    # The suffixes of a group stand together in ``at``; a group is named by its first place, where ``size`` has its size.
    at, place, group, size = by_byte.tolist(), rank.tolist(), starts[first].tolist(), [0] * n
    for start, many in zip(starts[sizes > 0].tolist(), sizes[sizes > 0].tolist()):
        size[start] = many
    end, smaller = list(range(1, n + 1)), [-1] * n

    # Descending: all groups above ``low`` are done, and the pointers of their suffixes skip what is not smaller.
    high = n
    while high:
        low = group[at[high - 1]]
        if high - low == 1:
            i = at[low]
            p = i - 1
            while p >= 0 and group[p] > low:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                end[p] = end[i]
                g = group[p]
                if size[g] > 1:  # p leaves its group, as below
                    size[g] = rest = size[g] - 1
                    k, to = place[p], g + rest
                    other = at[to]
                    at[k], at[to], place[other], place[p] = other, p, k, to
                    group[p], size[to] = to, 1
            high = low
            continue
        members = at[low:high]
        length = end[members[0]] - members[0]
        once: list[int] = []
        times: dict[int, list[int]] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] > low:
                p = smaller[p]
            if p >= 0 and group[p] == low:
                continue  # the repeat of a member before it, which is counted from there
            smaller[i] = p
            e = i + length
            if e < n and group[e] == low:
                count = 1
                while e < n and group[e] == low:
                    smaller[e] = p
                    e, count = e + length, count + 1
                if p >= 0:
                    end[p] = e
                    times.setdefault(count, []).append(p)
            elif p >= 0:
                end[p] = e
                once.append(p)
        # The prefix of these suffixes has grown by as many repeats of the group's: they leave to a group right above their own.
        for leaving in [*[times[k] for k in range(max(times), 1, -1) if k in times], once] if times else (once,):
            for p in leaving:
                g = group[p]
                size[g] = rest = size[g] - 1
                k, to = place[p], g + rest
                other = at[to]
                at[k], at[to], place[other], place[p] = other, p, k, to
            if len(leaving) == 1:
                group[p], size[to] = to, 1
                continue
            news = [g + size[g] for g in map(group.__getitem__, leaving)]
            for p, g in zip(leaving, news):
                group[p] = g
                size[g] += 1
        high = low

    # Ascending: the suffixes whose prefix ends where a placed suffix starts come next in their groups: the one before
    # it and, up the pointers, those whose prefix ends there too. ``group`` has the next place of each group at its start.
    front, order = size, [n] * (n + 1)
    for g in group:
        front[g] = g
    for k in range(-1, n):
        s = order[k]
        i = s - 1
        while i >= 0 and end[i] == s:
            g = group[i]
            order[front[g]] = i
            front[g] += 1
            i = smaller[i]
    return order[:n]


def anchors(text: bytes, size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each anchor and its sides, its piece packed into a number (start << 16 | windows << 8 | place of the anchor), and a digest of the piece.

    The hash has 28 bits of the anchor, ``_SIDE`` of the bytes before it and as many of those after it. The digest sums the mixed hashes of the piece's ``gram``-byte strings, each times a power of ``_BASE`` by its place.
    """
    hashes, packed, digests, side = [], [], [], (size - gram) // 2
    for at in range(0, len(text) - size + 1, _PART):
        x = np.frombuffer(text, np.uint8, min(_PART + size - 1, len(text) - at), at).astype(np.uint64)
        h, step, factor = (x + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9), 1, 0x9E3779B97F4A7C15
        h ^= h >> np.uint64(29)
        while step < gram:
            h = h[:-step] * np.uint64(factor) + h[step:]
            h ^= h >> np.uint64(31)
            factor, step = factor * 0xD6E8FEB86659FD93 % 2**64 | 1, step * 2
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
        # The smallest hash of each window, the last one among equals: the place is packed below the hash.
        least, width, wide = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64)), 1, size - gram + 1
        whole = len(least) - wide + 1
        while 2 * width <= wide:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        if width < wide:
            least = np.minimum(least[:whole], least[wide - width:][:whole])
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        place = (_LOW - (least[first] & _LOW)).astype(np.int64)
        windows = np.append(first[1:], len(least)) - first
        before = np.where(place - first >= side, _side(h, place - side, place - gram), 0)
        after = np.where(first + windows + size - 1 - place - gram >= side, _side(h, place + gram, place + side), 0)
        # The smallest hashes are anchors: their upper bits are mixed again.
        x = (h[place] ^ (h[place] >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        hashes.append((x >> np.uint64(2 * _SIDE) << np.uint64(2 * _SIDE) | before << np.uint64(_SIDE) | after).view(np.int64))
        packed.append(first + at << 16 | windows << 8 | place - first)
        power, back = _powers(1 << max(12, len(h).bit_length()))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * power[:len(h)])))
        x = (sums[first + windows + size - gram] - sums[first]) * back[first] + windows.astype(np.uint64)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        digests.append((x ^ (x >> np.uint64(29))).view(np.int64))
    if not hashes:
        return (np.empty(0, np.int64),) * 3
    return np.concatenate(hashes), np.concatenate(packed), np.concatenate(digests)


def _side(h: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hash, not 0, of the bytes of the strings at both places; places outside count as the nearest one."""
    first, second = (np.clip(x, 0, len(h) - 1) for x in (first, second))
    x = (h[first] + (h[second] ^ (h[second] >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)) * np.uint64(0xBF58476D1CE4E5B9)
    return np.maximum(x >> np.uint64(64 - _SIDE), np.uint64(1))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``_BASE`` and of its inverse, modulo 2 ** 64."""
    return tuple(np.cumprod(np.array([1] + [x] * (n - 1), np.uint64)) for x in (_BASE, pow(_BASE, -1, 2**64)))


def repeated(pieces: list[bytes], ids: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte runs of the pieces whose windows are also in a piece of a smaller id: number of the piece, start and end."""
    # A zero byte between pieces keeps most Lyndon prefixes inside one.
    text = b"\0".join(pieces)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
    first = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(pieces)), lengths)
    order = np.array(suffix_array(text), np.int64)
    order = order[order + size < (first + lengths)[owner[order]]]  # a whole window of the piece starts here
    gone = np.zeros(len(owner) + 1, np.int8)
    if len(order):
        window = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), size)[order]
        new = np.concatenate(([True], (window[1:] != window[:-1]).any(axis=1)))
        number = ids[owner[order]]
        low = np.minimum.reduceat(number, np.flatnonzero(new))[np.cumsum(new) - 1]
        gone[order] = low < number
    edge = np.diff(gone, prepend=0)
    a, b = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    piece = owner[a]
    return piece, a - first[piece], b - first[piece] + size - 1


def _marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pieces of every text. ``packed`` is start << 24 | tag << 12 | windows << 6 | place of the anchor.

    ``packed`` is inverted if a smaller document of the batch has the same piece; nothing more is to be found out then, and
    the mixed id stands for the anchor, so these rows spread. Small numbers come last in a row, where they compress.
    """
    for frame in batches:
        for at in range(0, len(frame), 500):
            part = frame.iloc[at:at + 500]
            anchor, content, ids, packed = [], [], [], []
            for i, tag, text in zip(part["_id"].tolist(), part["_tag"].tolist(), part["_text"]):
                hashes, places, digests = anchors(text.encode())
                starts = places >> 16
                content.append(digests)
                anchor.append(hashes)
                ids.append(np.full(len(starts), i, np.int64))
                packed.append(starts << 24 | tag << 12 | (places >> 8 & 255) << 6 | places & 255)
            anchor, content, ids, packed = (np.concatenate(x) for x in (anchor, content, ids, packed))
            order = np.argsort(content)
            first = np.concatenate(([True], content[order][1:] != content[order][:-1])) if len(order) else np.empty(0, bool)
            later = np.empty(len(order), bool)
            low = np.minimum.reduceat(ids[order], np.flatnonzero(first)) if len(order) else ids
            later[order] = ids[order] > low[np.cumsum(first) - 1]
            spread = (ids.view(np.uint64) * np.uint64(_BASE)).view(np.int64)
            yield pd.DataFrame({"_id": ids, "anchor": np.where(later, spread, anchor), "content": np.where(later, 0, content),
                                "packed": np.where(later, ~packed, packed)})


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    press = zstandard.ZstdCompressor(level=3)
    for frame in batches:
        yield pd.DataFrame({"_id": frame["_id"], "_tag": frame["_tag"], "_pressed": [press.compress((t or "").encode()) for t in frame["_text"]]})


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The text of the pieces asked for."""
    press = zstandard.ZstdDecompressor()
    for frame in batches:
        texts = [t.encode() if isinstance(t, str) else press.decompress(t) for t in frame["_pressed" if "_pressed" in frame else "_text"]]
        anchor, content, packed = (np.concatenate([np.empty(0, np.int64), *frame[c]]) for c in ("_anchors", "_contents", "_packed"))
        owner = np.repeat(np.arange(len(frame)), list(map(len, frame["_packed"])))
        start = packed >> 24
        end = start + (packed >> 6 & 63) + SIZE - 1
        piece = [texts[k][a:b] for k, a, b in zip(owner.tolist(), start.tolist(), end.tolist())]
        yield pd.DataFrame({"anchor": anchor, "content": content, "_low": frame["_id"].to_numpy()[owner], "place": packed & 63, "piece": piece})


def _ranges(piece: bytes, place: int) -> Iterator[tuple[int, int, int, bytes]]:
    """The windows of a piece in ranges of ``RANGE`` places of the anchor: first place, start, end, bytes that all of them hold.

    The anchor is at the same place of equal windows, so these are in one range and share its bytes.
    """
    reach = SIZE - GRAM
    right = len(piece) - place - GRAM
    for least in range(max(0, reach - right) // RANGE * RANGE, min(place, reach) + 1, RANGE):
        most = min(least + RANGE - 1, reach)
        yield least, place - min(most, place), place + GRAM + min(reach - least, right), piece[place - least:place + GRAM + reach - most]


def _shared(pieces: list[bytes], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the ranges of each piece (as in ``_ranges``) whose bytes another piece holds too; start >= end: none.

    Bytes are compared by a hash; by chance a range too many may stay in, never one too few.
    """
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    begin = np.cumsum(lengths) - lengths
    text = np.frombuffer(b"".join(pieces), np.uint8)
    reach, right = SIZE - GRAM, lengths - place - GRAM
    low = np.maximum(0, reach - right) // RANGE * RANGE
    start, end = lengths.copy(), np.zeros(len(pieces), np.int64)
    for least in range(0, reach + 1, RANGE):
        most = min(least + RANGE - 1, reach)
        rows = np.flatnonzero((low <= least) & (least <= np.minimum(place, reach)))
        if len(rows):
            held = np.lib.stride_tricks.sliding_window_view(text, least + GRAM + reach - most)[begin[rows] + place[rows] - least]
            _, same, many = np.unique(held @ _WEIGHTS[:held.shape[1]], return_inverse=True, return_counts=True)
            rows = rows[many[same] > 1]
            start[rows] = np.minimum(start[rows], place[rows] - np.minimum(most, place[rows]))
            end[rows] = np.maximum(end[rows], place[rows] + GRAM + np.minimum(reach - least, right[rows]))
    return start, end


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces cut by ranges; the range and its shared bytes are the ``_group`` of a part."""
    digest = xxhash.xxh3_64_intdigest
    for frame in batches:
        rows = []
        for anchor, content, i, place, piece in zip(*(frame[c].tolist() for c in ("anchor", "content", "_low", "place", "piece"))):
            for least, lo, hi, shared in _ranges(piece, place):
                part = piece[lo:hi]
                rows.append((anchor, content, i, lo, place - lo, part, digest(shared, least) - 2**63, digest(part, place - lo) - 2**63))
        yield pd.DataFrame(rows, columns=["anchor", "content", "_low", "at", "place", "piece", "_group", "_part"])


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digest of every window of a piece."""
    for frame in batches:
        rows = []
        for anchor, content, i, piece in zip(frame["anchor"], frame["content"], frame["_low"], frame["piece"]):
            rows.extend((anchor, content, i, k, xxhash.xxh3_64_intdigest(piece[k:k + SIZE]) - 2**63) for k in range(len(piece) - SIZE + 1))
        yield pd.DataFrame(rows, columns=["anchor", "content", "_low", "at", "window"])


def _decided(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Byte runs of the pieces whose windows are also in a piece of a smaller id.

    Only ranges whose bytes another piece holds too go into the arrays. Whole groups share an array of about ``_ARRAY`` bytes;
    equal windows have equal anchors, so groups do not mix.
    """
    for frame in chunks(batches, ["anchor"], 20_000):
        anchor, content, ids = (frame[c].to_numpy(np.int64) for c in ("anchor", "content", "_low"))
        pieces = frame["piece"].tolist()
        lo, hi = _shared(pieces, frame["place"].to_numpy(np.int64))
        able = np.flatnonzero(lo < hi)
        first = lo[able]
        texts = [pieces[k][a:b] for k, a, b in zip(able.tolist(), first.tolist(), hi[able].tolist())]
        starts = np.flatnonzero(np.concatenate(([True], anchor[able][1:] != anchor[able][:-1]))) if len(able) else able
        before = np.concatenate(([0], np.cumsum(list(map(len, texts)))))
        cuts = [0]
        for at in starts[1:].tolist():
            if before[at] - before[cuts[-1]] >= _ARRAY:
                cuts.append(at)
        found = []
        for lo, hi in zip(cuts, [*cuts[1:], len(able)]):
            if hi - lo > 1:
                k, a, b = repeated(texts[lo:hi], ids[able[lo:hi]])
                found.append((k + lo, a, b))
        k, a, b = map(np.concatenate, zip(*found)) if found else [np.empty(0, np.int64)] * 3
        yield pd.DataFrame({"anchor": anchor[able[k]], "content": content[able[k]], "a": a + first[k], "b": b + first[k]})


def _merged(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """The runs, ascending, that the spans cover; those that meet are one, empty ones none."""
    order = np.argsort(starts, kind="stable")
    order = order[starts[order] < ends[order]]
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    apart = starts[1:] > ends[:-1]
    some = np.ones(min(1, len(order)), bool)
    return zip(starts[np.concatenate((some, apart))].tolist(), ends[np.concatenate((apart, some))].tolist())


def _digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    press = zstandard.ZstdDecompressor()
    for frame in batches:
        rows = []
        for i, pressed, starts, ends in zip(frame["_id"], frame["_pressed"], frame["_starts"], frame["_ends"]):
            text = press.decompress(pressed)
            left, kept, runs, removed = hashlib.sha256(), 0, 0, 0
            for a, b in _merged(starts, np.minimum(ends, len(text))) if starts is not None else ():
                left.update(text[kept:a])
                runs += 1
                removed += b - a
                kept = b
            left.update(text[kept:])
            rows.append((i, len(text), removed, runs, left.hexdigest()))
        out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        yield out.astype({"doc_id": "Int64"})


def _in_parts(large: DataFrame, decided: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Repeated byte runs of the pieces of large groups: a part equal to one of a smaller id goes, different parts go through arrays."""
    schema = "anchor long, content long, _low long, at int, place int, piece binary, _group long, _part long"
    parts = pin(large.mapInPandas(_parts, schema), "parts")
    each = parts.groupBy("_group", "_part").agg(F.min("_low").alias("_low"), F.first("place").alias("place"), F.first("piece").alias("piece"))
    each = pin(each.select(F.col("_group").alias("anchor"), F.col("_part").alias("content"), "_low", "place", "piece"), "each")
    sizes = each.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n"))
    runs = decided(each.join(sizes.where(f"_n BETWEEN 2 AND {GROUP}").select("anchor"), "anchor", "left_semi"))
    # Parts of a group that is still too large differ in a few bytes at their ends; their windows are compared one by one.
    rest = each.join(sizes.where(f"_n > {GROUP}").select("anchor"), "anchor", "left_semi")
    windows = pin(rest.mapInPandas(_windows, "anchor long, content long, _low long, at int, window long"), "windows")
    low = windows.groupBy("anchor", "window").agg(F.min("_low").alias("_first"), F.max("_low").alias("_last")).where("_first < _last")
    gone = windows.join(low, ["anchor", "window"]).where("_first < _low").select(
        "anchor", "content", F.col("at").cast("long").alias("a"), (F.col("at") + SIZE).cast("long").alias("b"))
    runs = runs.unionByName(gone).withColumnsRenamed({"anchor": "_group", "content": "_part"})
    rows = parts.select("anchor", "content", "_low", "at", "_group", "_part", F.octet_length("piece").alias("_n"))
    rows = rows.join(each.select(F.col("anchor").alias("_group"), F.col("content").alias("_part"), F.col("_low").alias("_first")), ["_group", "_part"])
    whole = rows.where("_first < _low").select("anchor", "content", F.col("at").cast("long").alias("a"), (F.col("at") + F.col("_n")).cast("long").alias("b"))
    cut = rows.where("_first = _low").join(runs, ["_group", "_part"])
    return whole.unionByName(cut.select("anchor", "content", (F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("b")).alias("b")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``.

    Texts are UTF-8 bytes, null is empty, matches never cross documents. Rows with one id are one document as far as
    order goes, so they take nothing from each other (different texts under one id are told apart by ``_TAGS`` tags, so two of
    them may, by chance, be cut at each other's spans); a row with a null id loses nothing and takes nothing. An empty table gives an
    empty result.
    """
    small_batches(docs.sparkSession)
    tag = F.pmod(F.xxhash64(docs[text_col]), F.lit(_TAGS))
    rows = docs.select(docs[id_col].cast("long").alias("_id"), tag.alias("_tag"), docs[text_col].alias("_text"))
    text = rows.where(f"_id IS NOT NULL AND octet_length(_text) >= {SIZE}")
    marks = text.mapInPandas(_marks, "_id long, anchor long, content long, packed long")

    # All rows of an anchor, then of a piece, then of each side: one exchange serves all windows, and a large group spills.
    hashed = F.shiftright("anchor", 2 * _SIDE)
    met = marks.repartition(hashed).withColumn("_anchor", hashed)
    anchor, piece = Window.partitionBy("_anchor"), Window.partitionBy("_anchor", "content")
    met = met.select("*", F.min("_id").over(anchor).alias("_first"), F.max("_id").over(anchor).alias("_last"))
    met = met.where("packed < 0 OR _first < _last").withColumn("_low", F.min("_id").over(piece))
    mask = F.lit((1 << _SIDE) - 1)
    for name, value in (("_before", F.shiftright("anchor", _SIDE).bitwiseAND(mask)), ("_after", F.col("anchor").bitwiseAND(mask))):
        side, open_id = Window.partitionBy("_anchor", name), F.when(F.col("packed") >= 0, F.col("_id"))
        met = met.withColumn(name, value)
        met = met.withColumn(f"{name}_shared", (F.col(name) > 0) & (F.min(open_id).over(side) < F.max(open_id).over(side)) & (
            F.min("content").over(side) < F.max("content").over(side)))
    met = met.withColumn("_differ", F.col("_before_shared") | F.col("_after_shared")).withColumn("anchor", F.col("_anchor"))
    whole = (F.col("packed") < 0) | (F.col("_low") < F.col("_id"))
    met = met.where(whole | F.col("_differ")).select(
        "_id", F.greatest("packed", F.bitwise_not("packed")).alias("packed"), *[F.when(~whole, F.col(c)).alias(c) for c in ("anchor", "content")])
    met = pin_last(met.withColumn("_tag", F.shiftright("packed", 12).bitwiseAND(F.lit(_TAGS - 1))), "met")
    start, windows = F.shiftright("packed", 24), F.shiftright("packed", 6).bitwiseAND(F.lit(63))

    # Different pieces of an anchor: one text for each. Groups too large for one array are split by the bytes around the anchor.
    open_ = met.where("anchor IS NOT NULL")
    one = open_.groupBy("anchor", "content").agg(F.min(F.struct("_id", "_tag", "packed")).alias("v")).select("anchor", "content", "v.*")
    many = pin(open_.groupBy("anchor").agg(F.count_distinct("content").alias("_n")).where(F.col("_n") > GROUP).select("anchor"), "many")
    # The joins below read the same exchange of the texts.
    pressed = rows.where("_id IS NOT NULL").mapInPandas(_packed, "_id long, _tag long, _pressed binary").where("_id IS NOT NULL AND _tag IS NOT NULL")

    def asked(wanted: DataFrame) -> DataFrame:
        found = wanted.groupBy("_id", "_tag").agg(F.collect_list(F.struct("anchor", "content", "packed")).alias("_found"))
        return found.select("_id", "_tag", F.col("_found.anchor").alias("_anchors"), F.col("_found.content").alias("_contents"), F.col("_found.packed").alias("_packed"))

    def pieces(texts: DataFrame, wanted: DataFrame) -> DataFrame:
        return texts.join(wanted, ["_id", "_tag"]).mapInPandas(_pieces, "anchor long, content long, _low long, place int, piece binary")

    def decided(groups: DataFrame) -> DataFrame:
        dealt = groups.repartition("anchor").sortWithinPartitions("anchor")
        return dealt.mapInPandas(_decided, "anchor long, content long, a long, b long")

    runs = decided(pieces(pressed, asked(one.join(many, "anchor", "left_anti"))))
    if not many.isEmpty():
        # The texts move as they are: compressing them a second time costs more than it saves. The join is a merge at every size.
        few = asked(one.join(many, "anchor", "left_semi")).hint("merge")
        runs = runs.unionByName(_in_parts(pieces(text, few), decided))

    parts = open_.join(runs, ["anchor", "content"]).select("_id", "_tag", (start + F.col("a")).alias("a"), (start + F.col("b")).alias("b"))
    spans = met.where("anchor IS NULL").select("_id", "_tag", start.alias("a"), (start + windows + SIZE - 1).alias("b")).unionByName(parts)
    spans = spans.groupBy("_id", "_tag").agg(F.collect_list(F.struct("a", "b")).alias("_spans"))
    spans = spans.select("_id", "_tag", F.col("_spans.a").alias("_starts"), F.col("_spans.b").alias("_ends"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    done = pressed.join(spans, ["_id", "_tag"], "left").mapInPandas(_digested, schema)
    alone = rows.where("_id IS NULL").mapInPandas(_packed, "_id long, _tag long, _pressed binary")
    alone = alone.select("*", *[F.lit(None).cast("array<long>").alias(c) for c in ("_starts", "_ends")]).mapInPandas(_digested, schema)
    return done.unionByName(alone).withColumnRenamed("doc_id", id_col)
