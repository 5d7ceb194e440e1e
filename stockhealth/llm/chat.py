"""Chat formatting from an event log: fold streamed deltas, edits and regenerations, then render.

Events of a message are sorted by sequence and folded one message at a time as the sorted partition streams by,
so memory is bounded by one message whatever a conversation's share of the log. The template is

    ### <Role>: <text></turn>\\n

with ``\\``, ``#``, ``<``, ``:`` and line ends of roles, and ``\\``, ``#`` and ``<`` of texts, written as a backslash and a
letter: no text can hold a mark of the template, and ``parse`` gives every text back.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_HEAD, _COLON, _END = "### ", ": ", "</turn>\n"
_TEXT = {"\\": "\\\\", "#": "\\h", "<": "\\l"}
_ROLE = _TEXT | {":": "\\c", "\n": "\\n"}
_BACK = {"\\": "\\", "h": "#", "l": "<", "c": ":", "n": "\n"}
_TURN = re.compile(r"### ([^:]*): ([^<]*)</turn>\n")
LOSS_ROLE = "assistant"


def _write(text: str, marks: dict[str, str]) -> str:
    return text.translate(str.maketrans(marks))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The turn in the template and the code points at which its escaped text starts and ends.

    A role of the letters a to z starts with a capital; any other has ``^`` in front and is escaped.
    """
    shown = role.capitalize() if re.fullmatch("[a-z]+", role) else "^" + _write(role, _ROLE)
    body = _write(text, _TEXT)
    start = len(_HEAD) + len(shown) + len(_COLON)
    return f"{_HEAD}{shown}{_COLON}{body}{_END}", start, start + len(body)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn; raises on anything the template doesn't make."""
    at = 0
    while at < len(formatted):
        turn = _TURN.match(formatted, at)
        if not turn:
            raise ValueError(f"no turn at character {at}")
        shown = turn[1]
        role = unescape(shown[1:]) if shown[:1] == "^" else shown.lower()
        yield role, unescape(turn[2])
        at = turn.end()


def _none(value):
    return None if pd.isna(value) else value


def _groups(batches: Iterable[pd.DataFrame], keys: Sequence[str]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Consecutive rows with equal keys, across batches; each group must be read before the next."""
    from itertools import groupby

    n = len(keys)

    def rows():
        for frame in batches:
            others = [c for c in frame.columns if c not in keys]
            for row in frame[[*keys, *others]].itertuples(index=False, name=None):
                yield tuple(_none(v) for v in row[:n]), row[n:]

    for key, group in groupby(rows(), key=lambda r: r[0]):
        yield key, (r[1] for r in group)


def fold(events: Iterable[tuple[str, str | None, str | None]]) -> tuple[str, str]:
    """The final role and text of one message from its (kind, role, text) events in order.

    ``delta`` appends, ``edit`` replaces, ``regenerate`` discards what was said. Null text is empty, the last role that
    is not null counts, none is an empty role; other kinds are ignored.
    """
    role, pieces = "", []
    for kind, said, text in events:
        role = role if said is None else said
        if kind in ("edit", "regenerate"):
            pieces = []
        if kind in ("delta", "edit") and text is not None:
            pieces.append(text)
    return role, "".join(pieces)


def format_log(events: DataFrame, message: Sequence[str] = ("conv_id", "turn")) -> DataFrame:
    """One formatted turn per message: the ``message`` columns, ``role``, ``formatted``, ``loss_start``, ``loss_end``.

    ``events`` has the message columns, ``seq``, ``kind``, ``role`` and ``text``; others are ignored. The last two columns
    delimit the text under the loss mask in code points of ``formatted`` (equal for roles other than assistant). Null keys are values like any
    other, events with equal ``seq`` count in the order kind, role, text; an empty log gives an empty result.
    """
    keys = list(message)
    log = events.select(*keys, "seq", "kind", "role", "text")
    fields = [log.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("role", T.StringType()), T.StructField("formatted", T.StringType()),
                           T.StructField("loss_start", T.LongType()), T.StructField("loss_end", T.LongType())])

    def run(batches):
        done = []
        for key, rows in _groups(batches, keys):
            role, text = fold((_none(r[1]), _none(r[2]), _none(r[3])) for r in rows)
            formatted, start, end = render(role, text)
            done.append((*key, role, formatted, start, end if role == LOSS_ROLE else start))
            if len(done) >= 1000:
                yield _typed(done, schema)
                done = []
        yield _typed(done, schema)

    parts = log.repartition(*keys).sortWithinPartitions(*keys, "seq", "kind", "role", "text")
    return parts.mapInPandas(run, schema)


def _typed(rows: list[tuple], schema: T.StructType) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=schema.fieldNames(), dtype=object)
    whole = [f.name for f in schema if isinstance(f.dataType, (T.LongType, T.IntegerType))]
    return frame.astype({c: "Int64" for c in whole})


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(turns: DataFrame, order: Sequence[str] = ("turn",)) -> DataFrame:
    """Digests of each conversation, read back from its formatted turns in order; a running hash keeps memory small."""

    def run(batches):
        done = []
        for (conv,), rows in _groups(batches, ["conv_id"]):
            said, loss, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for formatted, start, end in rows:
                for role, text in parse(formatted):
                    said.update(f"{role}\n{text}\n".encode())
                    n += 1
                masked = unescape(formatted[int(start):int(end)])
                loss.update(masked.encode())
                loss_chars += len(masked)
                chars += len(formatted)
            done.append((conv, n, said.hexdigest(), loss_chars, loss.hexdigest(), chars))
        yield _typed(done, schema)

    schema = T._parse_datatype_string(DIGEST)
    rows = turns.repartition("conv_id").sortWithinPartitions("conv_id", *order)
    return rows.select("conv_id", "formatted", "loss_start", "loss_end").mapInPandas(run, DIGEST)
