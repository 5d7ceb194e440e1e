"""Exact SentencePiece BPE by backtracking over longest matches.

An Aho-Corasick automaton proposes the longest piece at a position. Two adjacent pieces fit if merging their
joined text anew gives just these two; a sequence whose neighbours all fit is what merging the whole text gives.
Where no piece fits, the position goes into a bit field of failed positions, the piece before it gives way to
its next shorter one, and a failed position is never entered again. The vocabulary is read from a model file; nothing is trained here.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from stockhealth.llm.common import slices, small_batches

SPACE = "▁"
_WORDS_KEPT = 250_000  # encoded words a task remembers; only speed depends on it
_PAIRS_KEPT = 250_000
_LONGEST_KEPT = 64
_NEVER = float("-inf")


class Codec:
    """Encoder and decoder for one vocabulary: (piece, score, kind) rows; kind is normal, byte, control or unknown."""

    def __init__(self, vocabulary: list[tuple[str, float, str]], bos: int = 1, eos: int = 2):
        import ahocorasick

        self.bos, self.eos, self.vocabulary = bos, eos, vocabulary
        self.ids = {p: i for i, (p, _, kind) in enumerate(vocabulary) if kind == "normal"}
        self.score = {p: vocabulary[i][1] for p, i in self.ids.items()}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(vocabulary) if kind == "byte"}
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.fits: dict[tuple[str, str], bool] = {}
        self.formed: dict[str, tuple | None] = {}
        self.shorter: dict[str, str] = {}
        self.longest = max(map(len, self.ids))
        self.words: dict[str, bytes] = {}
        self.text = [self._bytes_of(i) for i in range(len(vocabulary))]
        # Texts may be cut where no piece reaches across: before a run of spaces, if no piece has one
        # inside, and around characters that are in no piece of several characters.
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("pieces that go on after a space are not supported")
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        alone = "".join(re.escape(c) for c in "\n\t" if c not in joined)
        self.units = re.compile(f"[{alone}]|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    @classmethod
    def read(cls, path: str) -> Codec:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        kind = lambda i: "byte" if m.is_byte(i) else "unknown" if m.is_unknown(i) else "control" if m.is_control(i) else "normal"
        return cls([(m.id_to_piece(i), m.get_score(i), kind(i)) for i in range(m.get_piece_size())], m.bos_id(), m.eos_id())

    def _bytes_of(self, i: int) -> bytes:
        piece, _, kind = self.vocabulary[i]
        if kind == "byte":
            return bytes([int(piece[3:5], 16)])
        return {"control": b"", "unknown": " ⁇ ".encode()}.get(kind, piece.replace(SPACE, " ").encode())

    def spines(self, piece: str) -> tuple[list[tuple[str, float]], list[tuple[str, float]]] | None:
        """How merging forms a piece, seen from its left and its right end; None if merging never forms it.

        A spine lists the parts at that end, from one character up to the piece, each with the score of the
        lowest merge that has to be made before the next part of the list exists.
        """
        known = self.formed.get(piece, 0)
        if known != 0:
            return known
        parts = [(c, [(c, _NEVER)], [(c, _NEVER)], -_NEVER) for c in piece]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i][0] + parts[i + 1][0])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            (x, x_left, _, x_low), (y, _, y_right, y_low) = parts[at:at + 2]
            left = [*x_left[:-1], (x, min(best, y_low)), (x + y, _NEVER)]
            right = [*y_right[:-1], (y, min(best, x_low)), (x + y, _NEVER)]
            parts[at:at + 2] = [(x + y, left, right, min(best, x_low, y_low))]
        known = self.formed[piece] = (parts[0][1], parts[0][2]) if len(parts) == 1 else None
        return known

    def _merge_apart(self, left: str, right: str) -> bool:
        """Whether merging ``left + right`` anew never merges across the border.

        Walks through the parts that meet at the border as merging makes them. A pair that could merge does so
        unless the next part on either side comes first: by a higher score, or an equal one further left.
        """
        a, b = self.spines(left), self.spines(right)
        if a is None or b is None:
            return False
        (x, t), (y, u) = a[1][0], b[0][0]
        i = j = 0
        while True:
            s = self.score.get(x + y)
            if s is not None and s > t and s >= u:
                return False
            if t == u == _NEVER:
                return True
            if t >= u:
                i += 1
                x, t = a[1][i]
            else:
                j += 1
                y, u = b[0][j]

    def fit(self, left: str, right: str) -> bool:
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) > _PAIRS_KEPT:
                self.fits.clear()
            known = self.fits[left, right] = self._merge_apart(left, right)
        return known

    def _shorter(self, piece: str) -> str:
        """The next shorter piece that begins ``piece``, or its first character; "" after that."""
        known = self.shorter.get(piece)
        if known is None:
            n = len(piece) - 1
            while n > 1 and piece[:n] not in self.ids:
                n -= 1
            known = self.shorter[piece] = piece[:n]
        return known

    def pieces(self, unit: str, begun: list[str] | None = None) -> list[str]:
        """The pieces of a unit; ``begun`` are first longest matches already found to fit."""
        out = begun or []
        n, at, failed = len(unit), sum(map(len, out)), 0
        ids, fits, prefix = self.ids, self.fits, self.automaton.longest_prefix
        piece = ""
        while at < n:
            if not piece:
                # The longest match here; a character without a piece stands for itself.
                piece = unit[at:at + (prefix(unit[at:at + self.longest]) or 1)]
                if piece not in ids and len(piece) > 1:
                    piece = self._shorter(piece)
            while piece:
                end = at + len(piece)
                if not failed >> end & 1:
                    known = fits.get((out[-1], piece)) if out else self.spines(piece) is not None
                    if known or known is None and self.fit(out[-1], piece):
                        break
                piece = self.shorter.get(piece) or self._shorter(piece)
            if piece:
                out.append(piece)
                at, piece = end, ""
                continue
            while not piece:
                failed |= 1 << at
                piece = out.pop()
                at -= len(piece)
                piece = self._shorter(piece)
        return out

    def _ids(self, unit: str) -> bytes:
        """The ids of a unit; often its longest matches fit at once, else ``pieces`` goes on from the first that doesn't."""
        fitted, ids, before, reached = [], self.ids, "", -1
        fits = self.fits
        for end, piece in self.automaton.iter_long(unit):
            if end - reached != len(piece):
                break
            known = fits.get((before, piece)) if before else self.spines(piece) is not None
            if not known and (known is not None or not self.fit(before, piece)):
                break
            fitted.append(piece)
            before, reached = piece, end
        if reached + 1 != len(unit):
            fitted = self.pieces(unit, fitted)
        try:
            found = [ids[p] for p in fitted]
        except KeyError:
            found = [i for p in fitted for i in ((ids[p],) if p in ids else [self.bytes[b] for b in p.encode()])]
        return pack(f"<{len(found)}I", *found)

    def _new(self, unit: str) -> bytes:
        ids = self._ids(unit)
        if len(unit) <= _LONGEST_KEPT:
            if len(self.words) >= _WORDS_KEPT:
                self.words.clear()
            self.words[unit] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Begin id, ids of the text and end id as little-endian 32-bit integers."""
        get, new = self.words.get, self._new
        units = self.units.findall(SPACE + text.replace(" ", SPACE)) if text else ()
        return pack("<I", self.bos) + b"".join([get(u) or new(u) for u in units]) + pack("<I", self.eos)

    def decode(self, ids: bytes) -> str:
        """The text of ids; the space that encoding put in front is taken away."""
        text = b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return text.removeprefix(b" ").decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _codec(key: str, vocabulary: tuple, bos: int, eos: int) -> Codec:
    return Codec(list(vocabulary), bos, eos)


def _tasks(docs: DataFrame, model: str, columns, schema: str) -> DataFrame:
    """Apply ``columns(codec, texts)`` to (id, text) batches with the vocabulary as a broadcast.

    The model file is read on the driver alone; a vocabulary is bounded by its model.
    """
    small_batches(docs.sparkSession)
    read = Codec.read(model)
    shared = docs.sparkSession.sparkContext.broadcast((model, tuple(read.vocabulary), read.bos, read.eos))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(*shared.value)
        for frame in slices(batches):
            texts = frame.pop("_text")
            for name, values in columns(codec, ["" if t is None else t for t in texts]).items():
                frame[name] = values
            yield frame

    return docs.mapInPandas(run, schema)


def _digests(codec: Codec, texts: list[str]) -> dict[str, list]:
    out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
    for text in texts:
        ids = codec.encode(text)
        out["n_tokens"].append(len(ids) // 4)
        out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
        out["decoded_sha256"].append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
    return out


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token count, digest of the ids and digest of the decoded text of every row; null text counts as empty."""
    rows = docs.select(id_col, docs[text_col].alias("_text"))
    return _tasks(rows, model, _digests, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _tokens(codec: Codec, texts: list[str]) -> dict[str, list]:
    """Equal texts of a part are encoded and decoded once: a mix holds a document once for each epoch, side by side."""
    done: dict[str, tuple[np.ndarray, str]] = {}
    for text in texts:
        if text not in done:
            ids = codec.encode(text)
            done[text] = np.frombuffer(ids, "<u4").astype("int32"), codec.decode(ids)
    return {"ids": [done[t][0] for t in texts], "decoded": [done[t][1] for t in texts]}


def tokens(docs: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep`` columns, the ids of every row as ``ids: array<int>`` and the text decoded from them as ``decoded``.

    Null text counts as empty. Repeated rows and null ids give a row each; an empty table gives an empty result.
    """
    rows = docs.select(*keep, docs[text_col].alias("_text"))
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return _tasks(rows, model, _tokens, f"{kept}, ids array<int>, decoded string")
