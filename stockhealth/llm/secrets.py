"""Secret scans: patterns propose candidates, a random forest takes the false positives out.

Candidates are known key formats, values assigned to a name, and long mixed tokens. Features are length, how often
and how the kind of character changes, coverage by dictionary words (the words of the document itself and a fixed
list), the kind of place it stands in (path, address, assignment, quotes) and the words around it. The forest is
trained in numpy from labelled findings, true and false; it is small, of a bounded size, and goes to the tasks as a
broadcast. A document is scanned in the task that reads it: nothing is shuffled.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stockhealth.llm.common import slices, small_batches

# Public key formats.
FORMATS = (
    ("aws", r"(?<![0-9A-Za-z])(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])"),
    ("github", r"(?<![0-9A-Za-z])gh[pousr]_[0-9A-Za-z]{36,}"),
    ("slack", r"(?<![0-9A-Za-z])xox[abprs]-[0-9A-Za-z-]{10,}"),
    ("google", r"(?<![0-9A-Za-z])AIza[0-9A-Za-z_-]{35}"),
    ("stripe", r"(?<![0-9A-Za-z])[rs]k_(?:live|test)_[0-9A-Za-z]{16,}\b"),
    ("openai", r"(?<![0-9A-Za-z])sk-[0-9A-Za-z_-]{20,}"),
    ("jwt", r"(?<![0-9A-Za-z])eyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}"),
)
PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:(?!-----BEGIN)[\s\S])*?-----END [A-Z ]*PRIVATE KEY-----|[0-9A-Za-z+/=\s]*)")
SHORTEST = 16  # characters of a candidate, also of every format above
GENERIC = r"[0-9A-Za-z+/_=.-]{16,}"
_FORMAT = re.compile("|".join(f"(?P<{k}>{p})" for k, p in FORMATS))
_TOKEN = re.compile(GENERIC)
# Words near a secret, words near a harmless token, and common words of identifiers.
SECRET_WORDS = frozenset(
    "access api apikey auth authorization bearer client credential credentials key passphrase passwd password private pwd "
    "secret signing token".split())
HARMLESS_WORDS = frozenset(
    "checksum commit crc digest etag example fixture hash id integrity md5 placeholder revision sample sha sha1 sha256 "
    "sha512 test uuid version".split())
DICTIONARY = frozenset(
    "access account admin api app application archive auth base build cache change client code com commit common component config "
    "content controller core count data database default demo document download error event example factory field file "
    "filter format function handler header home html http https image index input interface internal item java key label "
    "lang library license line link list local log main manager message method model module name network node null number "
    "object option org output package page param password path placeholder plugin private process project property protocol public "
    "query read record release remote report request resource response result return root sample schema script search secret "
    "server service session setting simple size source src standard start state static status storage stream string system "
    "table target task template test text time title token tool type update upload user util value version view web write www your".split())
LEVEL = 0.5
_NEAR = 80  # characters on each side that count as neighbouring
_WORD = re.compile(r"[^\W\d_]{3,}")


def _kinds(s: str) -> np.ndarray:
    return np.fromiter((0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in s), np.int8, len(s))


def features(text: str, start: int, end: int, kind: str, known: frozenset[str]) -> list[float]:
    """Numbers the forest sees for text[start:end]; ``known`` are dictionary words of at least three letters."""
    s = text[start:end]
    kinds = _kinds(s)
    changes = kinds[1:] != kinds[:-1]
    n = len(s)
    _, counts = np.unique(np.frombuffer(s.encode("utf-32-le"), np.uint32), return_counts=True)
    entropy = float(-(counts / n * np.log2(counts / n)).sum())
    words = _WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", s))
    covered = sum(len(w) for w in words if w.lower() in known or w.lower() in DICTIONARY)
    before, after = text[max(0, start - _NEAR):start], text[end:end + _NEAR]
    near = [w.lower() for w in _WORD.findall(before)[-3:]]
    near_after = [w.lower() for w in _WORD.findall(after)[:3]]
    tail = before.rstrip("\"'` ")
    last = near[-1:] if re.search(r"[\w\"'`]\s*[:=]\s*[\"'`]?$", before) else []
    return [
        n, kind != "token", entropy, float(changes.mean()) if n > 1 else 0.0,
        float(((kinds[1:] == 2) != (kinds[:-1] == 2)).mean()) if n > 1 else 0.0,
        float(((kinds[1:] == 1) & (kinds[:-1] == 0)).mean()) if n > 1 else 0.0,
        float((kinds == 2).mean()), float((kinds == 1).mean()), float((kinds == 3).mean()),
        covered / n, bool(re.fullmatch(r"[0-9a-fA-F]+", s)), s.count("/") / n, s.count(".") / n, s.count("-") / n,
        bool(re.search(r"(?:https?:|www\.|[\w-]+/|\\)$", before)), tail[-1:] in ("=", ":") and bool(tail),
        before[-1:] in "\"'`" and bool(before) and after[:1] in "\"'`" and bool(after),
        any(w in SECRET_WORDS for w in near), any(w in SECRET_WORDS for w in last),
        any(w in HARMLESS_WORDS for w in near), any(w in HARMLESS_WORDS for w in near_after),
    ]


def candidates(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of what might be a secret, left to right, none overlapping.

    Only words of at least ``SHORTEST`` characters can hold one, besides key blocks, which go over lines.
    """
    blocks = [(*m.span(), "pem") for m in PEM.finditer(text)] if "-----BEGIN" in text else []
    at = 0
    for word in text.split():
        if len(word) < SHORTEST:
            continue
        at = text.index(word, at)
        while blocks and blocks[0][1] <= at:
            yield blocks.pop(0)
        if not blocks or at + len(word) <= blocks[0][0]:
            yield from _in_word(text, at, at + len(word))
        at += len(word)
    yield from blocks


def _in_word(text: str, first: int, last: int) -> Iterator[tuple[int, int, str]]:
    """Key formats are found first; generic tokens are what lies between them."""
    for m in _FORMAT.finditer(text, first, last):
        yield from _tokens(text, first, m.start())
        yield *m.span(), m.lastgroup
        first = m.end()
    yield from _tokens(text, first, last)


def _tokens(text: str, first: int, last: int) -> Iterator[tuple[int, int, str]]:
    for m in _TOKEN.finditer(text, first, last):
        start = m.start()
        # a name with its value: only the value; sentence marks at the end do not belong to it
        stripped = m[0].rstrip(".=-_/")
        if (at := stripped.find("=")) > 0 and len(stripped) - at > 12:
            start += at + 1
            stripped = stripped[at + 1:]
        if len(stripped) < SHORTEST or not any(c.isdigit() for c in stripped):
            continue
        yield start, start + len(stripped), "token"


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: feature (-1: leaf), threshold, children, share of true findings."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for feature, cut, low, high, share in self.trees:
            at = np.zeros(len(rows), np.int64)
            while (inner := feature[at] >= 0).any():
                i = np.flatnonzero(inner)
                node = at[i]
                at[i] = np.where(rows[i, feature[node]] <= cut[node], low[node], high[node])
            total += share[at]
        return total / len(self.trees)


def fit(rows: np.ndarray, truth: np.ndarray, trees: int = 30, depth: int = 9, seed: int = 19) -> Forest:
    """Random forest: bootstrap rows, a random part of the features at each split, Gini impurity."""
    rng = np.random.default_rng(seed)
    tried = max(2, int(np.sqrt(rows.shape[1])) + 1)
    grown = []
    for _ in range(trees):
        feature, cut, low, high, share = [], [], [], [], []

        def grow(at: np.ndarray, left: int) -> int:
            me = len(feature)
            y = truth[at]
            for column, value in ((feature, -1), (cut, 0.0), (low, 0), (high, 0), (share, float(y.mean()))):
                column.append(value)
            if not left or len(at) < 4 or y.min() == y.max():
                return me
            best = (y.mean() * (1 - y.mean()) * len(at) - 1e-9, -1, 0.0)
            for f in rng.choice(rows.shape[1], tried, replace=False):
                x = rows[at, f]
                order = np.argsort(x, kind="stable")
                x, ones = x[order], np.cumsum(y[order])
                n = np.arange(1, len(x) + 1)
                p, q = ones / n, (ones[-1] - ones) / np.maximum(len(x) - n, 1)
                cost = n * p * (1 - p) + (len(x) - n) * q * (1 - q)
                cost[np.append(x[1:] == x[:-1], True)] = np.inf
                i = int(cost.argmin())
                if cost[i] < best[0]:
                    best = (cost[i], int(f), float((x[i] + x[i + 1]) / 2))
            if best[1] >= 0:
                side = rows[at, best[1]] <= best[2]
                feature[me], cut[me] = best[1], best[2]
                low[me] = grow(at[side], left - 1)
                high[me] = grow(at[~side], left - 1)
            return me

        grow(rng.integers(0, len(rows), len(rows)), depth)
        grown.append(tuple(np.array(x) for x in (feature, cut, low, high, share)))
    return Forest(grown)


def labelled_findings(n: int = 3000, seed: int = 23) -> list[tuple[str, int, int, str, bool]]:
    """Reviewed kinds of findings, ``n`` drawn: text, start, end, kind and whether it is a secret.

    True ones are keys in the public formats and random values assigned to secret names; false ones are digests, commit
    and document numbers, paths, names in code, encoded images, long words and placeholders.
    """
    rng = np.random.default_rng(seed)
    hexa, upper = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = sorted(DICTIONARY)
    syllables = "an ar be cha da el en er fo ga he in ka la mo ne or pa ra se ti un ve wi zo".split()
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    some = lambda chars, k: "".join(pick(chars) for _ in range(k))
    prose = lambda k: " ".join("".join(pick(syllables) for _ in range(int(rng.integers(1, 4)))) for _ in range(k))
    name = lambda: pick(["token", "api_key", "secret", "password", "access_token", "client_secret", "auth_token", "private_key", "TOKEN", "API_KEY", "SECRET_KEY", "PASSWORD"])
    number = lambda lo, hi: int(rng.integers(lo, hi))
    quote = lambda: pick(['"', "'", ""])
    out = []
    while len(out) < n:
        true = bool(rng.random() < 0.5)
        if true:
            value = pick([
                lambda: "AKIA" + some(upper, 16), lambda: "gh" + pick("pous") + "_" + some(mixed, 36), lambda: "xoxb-" + some("0123456789", 11) + "-" + some(mixed, 24),
                lambda: "AIza" + some(mixed, 35), lambda: "sk_live_" + some(mixed, 24), lambda: "sk-" + some(mixed, 40),
                lambda: some(hexa, pick([32, 40, 48, 64])), lambda: some(hexa.upper(), pick([32, 40, 64])), lambda: some(mixed, number(20, 60)), lambda: some(mixed + "+/", number(24, 64)) + "="])()
            bare = value[:4] in ("AKIA", "AIza", "xoxb") or value[:3] in ("ghp", "gho", "ghu", "ghs", "sk_", "sk-")
            q = quote()
            before = f"{pick(['', '', 'Authorization: Bearer ', 'https://host.com/', 'auth/', 'v1.', 'key_', 'x-'])}{q}" if bare and rng.random() < 0.4 else f"{name()}{pick([' = ', '=', ': ', ' := '])}{q}"
        else:
            q = ""
            value, before = pick([
                lambda: (some(hexa, 64), pick(["sha256: ", "sha256=", "checksum ", "integrity: ", "digest = "])),
                lambda: (some(hexa, 40), pick(["commit ", "revision ", "commit: ", "at commit ", "sha1: "])),
                lambda: (some(hexa, 32), pick(["md5: ", "etag: ", "hash ", "md5sum "])),
                lambda: ("-".join(some(hexa, k) for k in (8, 4, 4, 4, 12)), pick(["uuid: ", "id = ", "request id ", ""])),
                lambda: ("/".join(pick(words) for _ in range(number(3, 7))) + str(number(0, 99)), pick(["path: ", "in ", "https://", "/usr/", "see "])),
                lambda: ("".join(pick(words).capitalize() for _ in range(number(3, 6))) + str(number(1, 9)), pick(["class ", "new ", "", "import "])),
                lambda: ("_".join(pick(words) for _ in range(number(3, 6))) + str(number(1, 99)), pick(["def ", "call ", "", "key = "])),
                lambda: ("-".join(pick(words) for _ in range(number(3, 6))) + f"-{number(2000, 2030)}", pick(["slug: ", "page ", ""])),
                lambda: (f"{pick(words)}-{number(1, 9)}.{number(0, 99)}.{number(0, 99)}.tar.gz", pick(["download ", "file: ", ""])),
                lambda: (some(mixed + "+/", 80), pick(["data:image/png;base64,", "src=data:image/gif;base64,"])),
                lambda: (some("0123456789", number(16, 30)), pick(["number ", "isbn ", "phone ", "id: "])),
                lambda: (pick(["your", "example", "placeholder", "test", "sample"]) + pick(["-", "_", ""]) + pick(["token", "secret", "api-key", "password"]) + pick(["-here-", "-value-", "_"]) + some("0123456789", 4), f"{name()} = "),
                lambda: ("".join(pick(syllables) for _ in range(number(8, 14))) + str(number(0, 9)), ""),
            ])()
        text = f"{prose(number(0, 12))} {before}"
        start = len(text)
        text += f"{value}{q} {prose(number(0, 12))}"
        for a, b, kind in candidates(text):
            if a >= start and b <= start + len(value) + 1:
                out.append((text, a, b, kind, true))
    return out[:n]


@lru_cache(maxsize=2)
def trained(findings: int = 3000) -> Forest:
    """The forest from ``findings`` labelled findings, which bound its training."""
    rows = labelled_findings(findings)
    return fit(np.array([features(t, a, b, k, frozenset()) for t, a, b, k, _ in rows], float), np.array([y for *_, y in rows], float))


def scan_text(text: str | None, forest: Forest, level: float = LEVEL) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of every candidate, in code points of the whole text; a secret has a score of at least ``level``."""
    found = list(candidates(text or ""))
    if not found:
        return []
    spans, outside = [0] + [x for a, b, _ in found for x in (a, b)] + [len(text)], []
    for a, b in zip(spans[::2], spans[1::2]):
        outside += _WORD.findall(text[a:b])
    known = frozenset(w.lower() for w in outside)
    scores = forest.score(np.array([features(text, a, b, k, known) for a, b, k in found], float))
    return [(a, b, k, float(s)) for (a, b, k), s in zip(found, scores)]


def redact(text: str, secrets: Sequence[tuple[int, int, str, float]]) -> str:
    out, at = [], 0
    for a, b, kind, _ in secrets:
        out += [text[at:a], f"[{kind.upper()} REMOVED]"]
        at = b
    return "".join(out) + text[at:]


_COLUMNS = [
    T.StructField("n_candidates", T.LongType()), T.StructField("n_secrets", T.LongType()), T.StructField("spans", T.StringType()),
    T.StructField("top_score", T.DoubleType()), T.StructField("redacted", T.StringType()),
]


def scan(
    docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",), level: float = LEVEL, forest: Forest | None = None,
    digest: bool = False,
) -> DataFrame:
    """``keep`` columns with the findings of every row, in place.

    ``n_candidates``, ``n_secrets``, ``spans`` ("start:end:kind" of the secrets, by code points, joined by ";"), ``top_score`` (largest score of a candidate, 0 without
    one) and ``redacted``, the text with secrets replaced, or with ``digest`` its SHA-256. Null text has no finding and stays null;
    repeated rows and null ids give a row each; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(forest or trained())
    schema = T.StructType([*(docs.schema[c] for c in keep), *_COLUMNS])
    rows = docs.select(*keep, docs[text_col].alias("_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(batches):
            done = []
            for text in frame.pop("_text"):
                found = scan_text(text, shared.value, level)
                secrets = [f for f in found if f[3] >= level]
                clean = None if text is None else redact(text, secrets)
                if digest and clean is not None:
                    clean = hashlib.sha256(clean.encode()).hexdigest()
                done.append((len(found), len(secrets), ";".join(f"{a}:{b}:{k}" for a, b, k, _ in secrets), max([f[3] for f in found], default=0.0), clean))
            for i, field in enumerate(_COLUMNS):
                frame[field.name] = [d[i] for d in done]
            yield frame

    return rows.mapInPandas(run, schema)
