"""Plain re-computations of the operators for small inputs."""
from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import xxhash


def roots(ids, pairs):
    """Smallest id reachable from each id."""
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def simhash(text, words=3):
    parts = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not parts:
        return 0
    shingles = [" ".join(parts[i:i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def op1(docs):
    prints = {d: simhash(t) for d, t in docs}
    ids = list(prints)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (prints[a] ^ prints[b]).bit_count() <= 2]
    root = roots(ids, pairs)
    return sorted((d, f"{prints[d]:016x}", root[d]) for d in ids)


def op2(docs, size=50):
    texts = {d: (t or "").encode() for d, t in docs}
    first = {}
    for d in sorted(texts):
        for i in range(len(texts[d]) - size + 1):
            first.setdefault(texts[d][i:i + size], d)
    out = []
    for d, b in texts.items():
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - size + 1):
            if first[b[i:i + size]] < d:
                gone[i:i + size] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        spans = int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))[: len(b)]).sum()) if b else 0
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def op7(rows, k=20):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for q, x in ok:
        if q % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(x.tolist(), v.tolist())), i) for i, v in ok if i != q)[:k]
            out[q] = [(i, -s) for s, i in found]
    return out


def op8(rows, cosine=0.93):
    fit = [(i, np.array(v, float), lab) for i, v, lab in rows
           if v is not None and lab is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    pairs = []
    for j, (b, y, m) in enumerate(fit):
        for a, x, lab in fit[:j]:
            if lab == m and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= cosine:
                pairs.append((a, b))
    root = roots([r[0] for r in rows], pairs)
    n = {r[0]: 0 for r in rows}
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    return sorted((i, n[i], root[i], root[i] == i) for i in n)


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def op13(docs, items, window=10):
    windows = []
    for name, text in items:
        w = plain_words(text)
        size = min(window, len(w))
        windows += [(w[i:i + size], name) for i in range(len(w) - size + 1)] if w else []
    out = []
    for d, text in docs:
        w, hit, named = plain_words(text), set(), set()
        for said, name in windows:
            for i in range(len(w) - len(said) + 1):
                if w[i:i + len(said)] == said:
                    hit |= set(range(i, i + len(said)))
                    named |= {str(name)} if name is not None else set()
        out.append((d, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def longest(docs, items, least):
    """(item, word) -> (words, places, first place) of the longest match of each item suffix."""
    out, texts = {}, [(d, plain_words(t)) for d, t in docs]
    for name, text in items:
        w = plain_words(text)
        for s in range(len(w)):
            best, places = 0, []
            for d, words in texts:
                for i in range(len(words)):
                    n = 0
                    while s + n < len(w) and i + n < len(words) and w[s + n] == words[i + n]:
                        n += 1
                    if n > best:
                        best, places = n, []
                    if n == best and n:
                        places.append((d, i))
            if best >= least:
                out[str(name), s] = (best, len(places), min(places))
    return out


def op11(rows, top=16):
    """(id, component) -> (n, deviation, size of the whitened value, explained) by an eigenvalue routine of numpy."""
    ok = [(i, v) for i, v in rows if v is not None and len(v) and None not in v and all(map(math.isfinite, v))]
    x = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in ok]
    fit = sorted({tuple(v) for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(n * c - s) / n for c, s in zip(v, sums)] for v in fit])
    covariance = centred.T @ centred / n
    e, u = np.linalg.eigh(covariance)
    out = {}
    for i, v in x:
        d = [n * c - s for c, s in zip(v, sums)]
        for k in range(1, min(top, int((e > 1e-9 * e[-1]).sum())) + 1):
            whitened = float(np.array(d, float) / n @ u[:, -k]) / math.sqrt(e[-k])
            out[i, k] = (n, sum(c * c for c in d), abs(whitened), e[-k] / np.trace(covariance))
    return out


def op12(rows, group=20, heads=4):
    """Nodes of the trie of rebuilt conversations; rows are (conv, turn, role, text) without ties."""
    turns = {}
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        turns.setdefault(c, []).append((r or "", x or ""))
    nodes, ends = {}, {}
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % heads
        whole = tuple(turns.get(c - c % group, [])[:h] + turns[c][h:])
        ends.setdefault(whole, []).append(c)
        for d in range(len(whole) + 1):
            nodes.setdefault(whole[:d], []).append(c)
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[:len(key)] == key]
        saved = sum((len(nodes[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) for k in below if k)
        out.append((members[0], len(key), nodes[key[:-1]][0] if key else None, len(members), sum(len(k) == len(key) + 1 for k in below),
                    sum(not any(len(x) == len(k) + 1 and x[:len(k)] == k for x in below) for k in below), saved,
                    hashlib.sha256(",".join(map(str, ends.get(key, []))).encode()).hexdigest()))
    return sorted(out, key=repr)
