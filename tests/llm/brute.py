"""Plain versions of the operators that SQL cannot express, for small tables."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import xxhash


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def repeats(rows, length=400):
    """[(doc_id, n_bytes, n_removed, n_spans, kept_sha256)]"""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def phrases(rows, size=50):
    """[(doc_id, n_words, n_removed, kept_sha256)]; null ids come last."""
    late = 1 << 62
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        own = late if i is None else i
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, late), own)
    out = []
    for i, w in words:
        own = late if i is None else i
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < own:
                gone[k : k + size] = [True] * size
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), sha(kept)))
    return out


def fingerprint(text) -> int:
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    size = min(3, len(w))
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[k : k + size]), 42) for k in range(len(w) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: dict[int, int], bits=3) -> dict[int, int]:
    """fingerprint -> root over all pairs within ``bits``."""
    values = np.array(sorted(prints), dtype=np.uint64)
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= bits) + i + 1:
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    return {int(v): find(i) for i, v in enumerate(values)}


def near_duplicates(rows):
    """[(doc_id, fingerprint, component_id)]"""
    prints = [(i, fingerprint(t)) for i, t in rows]
    roots = components({f: 0 for _, f in prints})
    least = {}
    for i, f in prints:
        if i is not None:
            least[roots[f]] = min(least.get(roots[f], i), i)
    return [(i, f"{f:016x}", least.get(roots[f])) for i, f in prints]


def shingle_sets(rows, size=5):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        n = min(size, len(w))
        out.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set())
    return out


def near_copies(rows, least=0.8):
    """Groups of places of ``rows`` over all pairs of similarity ``least`` or more."""
    sets = shingle_sets(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or len(a & b) >= least * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return list(groups.values())


def merkle(rows, fan_out=16):
    """[(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, source)] of
    [(doc_id, source, lang, n_chars, text)]"""

    def digest(text):
        return sha(text.encode())

    def leaf(row):
        return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def now(row):
        i, *rest, text = row
        if i is None or text is None or zlib.crc32(str(i).encode()) % 5:
            return leaf(row)
        return leaf((i, *rest, "".join(c.lower() if "A" <= c <= "Z" else c for c in text)))

    def up(hashes):
        """(root, for each of the hashes its siblings on the way up, as
        (those before, those after), level by level)"""
        at = [[k] for k in range(len(hashes))]
        steps = [[] for _ in hashes]
        while len(hashes) > 1:
            parents, groups = [], []
            for a in range(0, len(hashes), fan_out):
                run = hashes[a : a + fan_out]
                for k, h in enumerate(run):
                    for leaf_at in at[a + k]:
                        steps[leaf_at].append((run[:k], run[k + 1 :]))
                parents.append(digest("".join(run)))
                groups.append([x for k in range(len(run)) for x in at[a + k]])
            hashes, at = parents, groups
        return hashes[0], steps

    sources = {}
    for row in rows:
        sources.setdefault(row[1], []).append(row)
    ordered = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in ordered:
        own = sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((own, *up([leaf(r) for r in own])))
    if not trees:
        return []
    root, over = up([t[1] for t in trees])
    out = []
    for (own, subroot, steps), top in zip(trees, over):
        for row, way in zip(own, steps):
            folded, proof = now(row), ""
            # A lone node that goes up by itself has no step.
            for before, after in way + top:
                folded = digest("".join([*before, folded, *after]))
                proof += "".join(before + after)
            out.append((row[0], leaf(row), subroot, root, digest(proof), folded, folded == root, row[1]))
    return out


def planted_words(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def _least_period(w):
    fail = [0] * (len(w) + 1)
    k = 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = fail[k]
        k += w[i] == w[k]
        fail[i + 1] = k
    return len(w) - fail[len(w)]


def runs_of(words, min_length=24):
    """[(start, length, period)] by start, then period: every period at every place."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(min_length, 3 * q) and _least_period(words[i : i + length]) == q:
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(rows):
    """[(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256)]"""
    out = []
    for i, text in rows:
        words = planted_words(i, text)
        runs = runs_of(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
        gone = {k for a, length, q in runs for k in range(a + q, a + length)}
        facts = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{a},{length},{q}\n" for a, length, q in runs)
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(runs), *facts, sha(lines.encode()), sha(kept)))
    return out
