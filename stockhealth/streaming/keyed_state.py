"""Keyed state of the change log and the alerts.

The rows of a key stay in state in the order of their event time, in runs of at most ``2 * RUN`` rows: an index holds the
first and last row of every run, the runs are values of a map state. New rows, late ones too, load the runs they belong in and
no others, so an epoch's work follows its own rows, however long a key's history is. A call for a key costs milliseconds whatever
it holds, so a key of the change log is a bucket of many pairs, ordered by pair first.
"""
from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RUN = 2048  # rows of a run after a split
NEVER, NO_TIME = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Runs:
    """The ordered rows of one key: a structured array cut into runs. ``order`` names its fields, ``id`` numbers rows by arrival."""

    def __init__(self, kind: np.dtype, order: list[str], index, runs, size: int = RUN, ttl: int | None = None, packed: bool = False):
        self.packed = packed
        self.kind, self.order, self.state, self.store, self.size, self.ttl = kind, order, index, runs, size, ttl
        self.entry = np.dtype([("run", "<i8"), ("held", "<i8"), ("newest", "<i8"), ("alert", "<i8"), ("first", kind), ("last", kind)])
        self.next_id, self.next_run, self.index = 0, 0, np.empty(0, self.entry)
        if index.exists():
            blob = index.get()[0]
            self.next_id, self.next_run = np.frombuffer(blob, "<i8", 2).tolist()
            self.index = np.frombuffer(blob, self.entry, offset=16).copy()
        self.loaded: dict[int, np.ndarray] = {}

    def sort(self, rows: np.ndarray) -> np.ndarray:
        return rows[np.lexsort([rows[f] for f in reversed([*self.order, "id"])])]

    def run(self, at: int) -> np.ndarray:
        """The rows of a run. Of a run that has outlived its time to live, the last row is known."""
        if at not in self.loaded:
            if self.index["held"][at]:
                blob = self.store.getValue((int(self.index["run"][at]),))[0]
                self.loaded[at] = np.frombuffer(_unpacked(blob) if self.packed else blob, self.kind).copy()
            else:
                self.loaded[at] = self.index["last"][at:at + 1].copy()
        return self.loaded[at]

    def add(self, rows: np.ndarray) -> list[int]:
        """Number the rows, put them where they belong and return the runs that got any, in order."""
        rows = rows.copy()
        rows["id"] = self.next_id + np.arange(len(rows))
        self.next_id += len(rows)
        if not len(self.index):
            self.index = np.zeros(1, self.entry)
            self.index["run"], self.next_run = self.next_run, self.next_run + 1
            self.loaded[0] = self.sort(rows)
            return [0]
        both = np.concatenate([self.index["first"], rows])
        turn = np.lexsort([both[f] for f in reversed([*self.order, "id"])])
        before = np.empty(len(both), np.int64)
        before[turn] = np.cumsum(turn < len(self.index))
        home = np.maximum(before[len(self.index):] - 1, 0)
        turn = np.argsort(home, kind="stable")
        touched, first = np.unique(home[turn], return_index=True)
        for at, mine in zip(touched.tolist(), np.split(turn, first[1:])):
            self.loaded[at] = self.sort(np.concatenate([self.run(at), rows[mine]]))
        return touched.tolist()

    def last_before(self, at: int) -> np.ndarray | None:
        """The row before a run."""
        return None if not at else self.loaded[at - 1][-1] if at - 1 in self.loaded else self.index["last"][at - 1]

    def save(self, changed: list[int]) -> None:
        """Write the changed runs, split where they have grown, and the index."""
        entries, touched = [], set(changed)
        for at in range(len(self.index)):
            if at not in touched:
                entries.append(self.index[at:at + 1])
                continue
            rows = self.loaded[at]
            parts = [rows] if len(rows) <= 2 * self.size else np.array_split(rows, -(-len(rows) // self.size))
            for i, part in enumerate(parts):
                one = np.zeros(1, self.entry)
                if i:
                    one["run"], self.next_run = self.next_run, self.next_run + 1
                else:
                    one["run"] = self.index["run"][at]
                one["first"], one["last"], one["held"], one["newest"] = part[0], part[-1], 1, part["at"].max()
                one["alert"] = part["at"][part["alert"] == 1].max() if "alert" in self.kind.names and part["alert"].any() else NEVER
                self.store.updateValue((int(one["run"][0]),), (_packed(part.tobytes()) if self.packed else part.tobytes(),))
                entries.append(one)
        self.index = np.concatenate(entries)
        if self.ttl is not None:
            for entry in self.index[(self.index["held"] == 1) & (self.index["newest"] < self.index["newest"].max() - self.ttl)]:
                self.store.removeKey((int(entry["run"]),))
            self.index["held"][self.index["newest"] < self.index["newest"].max() - self.ttl] = 0
        self.state.update((np.array([self.next_id, self.next_run], "<i8").tobytes() + self.index.tobytes(),))


def _packed(blob: bytes) -> bytes:
    return len(blob).to_bytes(8, "little") + pa.compress(blob, codec="zstd", asbytes=True)


def _unpacked(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def _arrived(frames: Iterator[pd.DataFrame], kind: np.dtype) -> np.ndarray:
    """One key's rows of an epoch; columns and fields have the same names."""
    parts = []
    for frame in frames:
        part = np.zeros(len(frame), kind)
        for name in kind.names:
            if name in frame:
                part[name] = frame[name].to_numpy()
        parts.append(part)
    return np.concatenate([*parts, np.empty(0, kind)])


def _columns(key: tuple, rows: np.ndarray, **more) -> pd.DataFrame:
    out = pd.DataFrame({n: rows[n] for n in rows.dtype.names})
    out.insert(0, "location", pd.Series([key[0]] * len(out), dtype=object))
    out.insert(1, "item", pd.Series([key[1]] * len(out), dtype=object))
    return out.assign(**more)


# Null days, times and stocks are told by flags: whole numbers stay whole. ``pair`` is the number of a pair in its bucket.
CHANGE = np.dtype([("pair", "<i8"), ("day", "<i8"), ("at", "<i8"), ("kind", "<i8"), ("has_stock", "<i8"), ("stock", "<i8"), ("id", "<i8")])
CHANGE_OUT = ("location string, item string, day long, at long, kind long, has_stock long, stock long, id long, "
              "has_old long, old long, correction boolean")
_CHUNK = 250_000  # rows of an input task that are packed together
ID_BITS = 40  # a bucket's number stands above the numbers of its rows
_TOLD = 20_000  # rows that are sent on at once


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (``bucket`` and others) as one blob for each bucket of a chunk: Spark gives a row to a processor by many Python steps, a blob by as many."""
    def chunks() -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= _CHUNK:
                yield pa.Table.from_batches(held)
                held = []
        if held:
            yield pa.Table.from_batches(held)

    for table in chunks():
        table = table.sort_by("bucket").combine_chunks()
        bucket = table["bucket"].to_numpy()
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        blobs = []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table.slice(a, b - a))
            blobs.append(sink.getvalue().to_pybytes())
        if len(bucket):
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[[0, *cuts]], pa.int32()), "blob": pa.array(blobs, pa.binary())})


def _rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of a key, packed or not."""
    for frame in frames:
        if "blob" in frame:
            yield pa.concat_tables(pa.ipc.open_stream(blob).read_all() for blob in frame["blob"]).to_pandas()
        else:
            yield frame


class ChangeLog(StatefulProcessor):
    """Every change with the stock of the version before it; a row that comes late corrects the one after it.

    A key is the number of a bucket of pairs, or one pair. A time to live is that of a pair, so it needs a pair as key.
    """

    def __init__(self, ttl: timedelta | None = None, size: int = RUN):
        self.ttl, self.size = None if ttl is None else ttl // timedelta(microseconds=1), size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pairs = handle.getValueState("pairs", "blob binary")
        self.index = handle.getValueState("index", "blob binary")
        self.runs = handle.getMapState("runs", "run long", "blob binary")

    def _numbered(self, frames: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray]:
        """An epoch's rows with the numbers of their pairs, and the pairs by number."""
        known = {tuple(p): i for i, p in enumerate(json.loads(_unpacked(self.pairs.get()[0])))} if self.pairs.exists() else {}
        before, parts = len(known), []
        for frame in _rows(frames):
            (a, locations), (b, items) = (pd.factorize(frame[c]) for c in ("location", "item"))  # -1: null
            both, row = np.unique((a + 1) * (len(items) + 1) + b + 1, return_inverse=True)
            name = lambda names, i: None if i < 0 else names[i]
            pairs = [(name(locations, x // (len(items) + 1) - 1), name(items, x % (len(items) + 1) - 1)) for x in both.tolist()]
            numbers = np.array([known.setdefault(p, len(known)) for p in pairs], np.int64)
            parts.append(_arrived([frame.assign(pair=numbers[row])], CHANGE))
        if len(known) > before:
            self.pairs.update((_packed(json.dumps(list(known)).encode()),))
        names = np.empty((len(known), 2), object)
        names[:] = list(known)
        return np.concatenate(parts), names

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = Runs(CHANGE, ["pair", "day", "at", "kind", "has_stock", "stock"], self.index, self.runs, self.size, self.ttl, packed=True)
        fresh = held.next_id
        arrived, names = self._numbered(rows)
        touched = held.add(arrived)
        above = int(key[0]) << ID_BITS if len(key) == 1 else 0
        told: list[tuple] = []
        for at in touched:
            mine, before = held.loaded[at], held.last_before(at)
            after = held.index["first"][at + 1:at + 2] if at + 1 not in held.loaded else np.empty(0, CHANGE)
            chain = np.concatenate([np.array([] if before is None else [before], CHANGE), mine, after])
            same = np.concatenate(([False], (chain["pair"][1:] == chain["pair"][:-1]) & (chain["day"][1:] == chain["day"][:-1])))
            old = np.concatenate((chain[:1], chain[:-1]))
            new = chain["id"] >= fresh
            out = new | same & np.concatenate(([False], new[:-1]))
            out[:int(before is not None)] = False
            has = (same & (old["has_stock"] == 1)).astype(np.int64)
            told.append((chain[out], has[out], np.where(has, old["stock"], 0)[out], ~new[out]))
            if at == touched[-1] or sum(len(x[0]) for x in told) >= _TOLD:
                change, has, old, late = map(np.concatenate, zip(*told))
                told = []
                fields = {n: change[n] for n in CHANGE.names[1:]} | {"id": change["id"] + above}
                pair = names[change["pair"]]
                yield pd.DataFrame({"location": pair[:, 0], "item": pair[:, 1]} | fields | {"has_old": has, "old": old, "correction": late})
        held.save(touched)

    def close(self) -> None:
        pass


ALERT = np.dtype([("at", "<i8"), ("has_action", "<i8"), ("action", "<i8"), ("has_days", "<i8"), ("days", "<f8"), ("has_reorder", "<i8"),
                  ("reorder", "<f8"), ("id", "<i8"), ("alert", "<i8")])
ALERT_OUT = ("location string, item string, at long, has_action long, action long, has_days long, days double, has_reorder long, reorder double, "
             "id long, alert long, correction boolean")


class Cooldown(StatefulProcessor):
    """Observations that alert. A late one may change the chain of alerts after it, up to the first alert that both chains share."""

    def __init__(self, wait: timedelta, size: int = RUN):
        self.wait, self.size = wait // timedelta(microseconds=1), size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.index = handle.getValueState("index", "blob binary")
        self.runs = handle.getMapState("runs", "run long", "blob binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = Runs(ALERT, ["at", "has_action", "action"], self.index, self.runs, self.size)
        fresh = held.next_id
        touched = held.add(_arrived(rows, ALERT))
        changed, out = set(touched), []
        waiting = sum(int((held.loaded[at]["id"] >= fresh).sum()) for at in touched)  # new rows still ahead
        at = touched[0]
        place = int(np.flatnonzero(held.loaded[at]["id"] >= fresh)[0])
        here = held.loaded[at][:place]
        alerts = [int(t) for t in (*held.index["alert"][:at], *here["at"][here["alert"] == 1]) if t != NEVER]
        last = max(alerts, default=None)
        done = False
        while at < len(held.index) and not done:
            mine = held.run(at)
            while place < len(mine):
                # The next row that may alert; rows without a time stand last and alert only if no other did.
                if last is None:
                    up = place
                else:
                    up = len(mine) if last == NO_TIME else max(place, int(np.searchsorted(mine["at"], min(last + self.wait, NO_TIME), side="left")))
                    up = len(mine) if up < len(mine) and mine["at"][up] == NO_TIME else up
                skipped = mine[place:up]
                waiting -= int((skipped["id"] >= fresh).sum())
                off = skipped["alert"] == 1
                if off.any():
                    skipped["alert"] = 0
                    out.append(skipped[off].copy())
                    changed.add(at)
                place = up
                if place == len(mine):
                    break
                row = mine[place:place + 1]
                waiting -= int(row["id"][0] >= fresh)
                if row["alert"][0] == 1 and not waiting:
                    done = True  # from here on the alerts are as they were
                    break
                if row["alert"][0] == 0:
                    row["alert"] = 1
                    out.append(row.copy())
                    changed.add(at)
                last, place = int(row["at"][0]), place + 1
            at, place = at + 1, 0
        held.save(sorted(changed))
        if out:
            told = np.concatenate(out)
            yield _columns(key, told, correction=told["id"] < fresh)

    def close(self) -> None:
        pass


class TimedCooldown(StatefulProcessor):
    """The same rule with bounded state: rows wait until the watermark has passed them, then are decided in order and forgotten."""

    def __init__(self, wait: timedelta):
        self.wait = wait // timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")
        self.pending = handle.getValueState("pending", "blob binary")

    def _waiting(self) -> np.ndarray:
        return np.frombuffer(self.pending.get()[0], ALERT) if self.pending.exists() else np.empty(0, ALERT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        waiting = np.concatenate([self._waiting(), _arrived(rows, ALERT)])
        waiting = waiting[np.lexsort((waiting["action"], waiting["has_action"], waiting["at"]))]
        self.pending.update((waiting.tobytes(),))
        self.handle.registerTimer(-(-int(waiting["at"][0]) // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # A row alerts or not by rows before it alone, so all rows up to the watermark are decided.
        until = timerValues.getCurrentWatermarkInMs() * 1000
        waiting, last, told = self._waiting(), self.last.get()[0] if self.last.exists() else None, []
        ready = int(np.searchsorted(waiting["at"], until, side="right"))
        for i, at in enumerate(waiting["at"][:ready].tolist()):
            if last is None or at >= last + self.wait:
                last = at
                told.append(i)
        if last is not None:
            self.last.update((last,))
        rest = waiting[ready:]
        if len(rest):
            self.pending.update((rest.tobytes(),))
            self.handle.registerTimer(-(-int(rest["at"][0]) // 1000))
        else:
            self.pending.clear()
        if told:
            rows = waiting[told].copy()
            rows["alert"] = 1
            yield _columns(key, rows, correction=False)

    def close(self) -> None:
        pass
