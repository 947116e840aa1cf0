"""Plain versions of the operators, for small inputs."""

import hashlib
import re

import numpy as np
import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def substring(docs, k):
    """doc_id -> (n_words, n_removed, sha of the words kept); ids may repeat only with equal texts."""
    docs = [(i, words(t)) for i, t in docs]
    first = {}
    for i, w in docs:
        if i is not None:
            for p in range(len(w) - k + 1):
                key = tuple(w[p : p + k])
                first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in docs:
        gone = [False] * len(w)
        for p in range(len(w) - k + 1):
            if i is not None and first[tuple(w[p : p + k])] < i:
                gone[p : p + k] = [True] * k
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


def suffix(docs, k):
    seen, out = set(), {}
    for i, t in sorted((x for x in set(docs) if x[0] is not None)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - k + 1):
            if b[p : p + k] in seen:
                gone[p : p + k] = b"\1" * k
            seen.add(b[p : p + k])
        runs = sum(1 for x in bytes(gone).split(b"\0") if x)
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def fingerprint(text):
    w = WORD.findall((text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[j : j + 3]), 42) for j in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(prints, near=2):
    """For (id, fingerprint) rows: [(n_near, component)] in order."""
    ids = [i for i, _ in prints]
    f = np.array([p for _, p in prints], dtype=np.uint64)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    count = []
    for a in range(len(ids)):
        at = np.flatnonzero(np.bitwise_count(f ^ f[a]) <= near)
        count.append(len(at) - 1)
        for b in at:
            x, y = find(a), find(int(b))
            root[max(x, y)] = min(x, y)
    best = {}
    for a, i in enumerate(ids):
        r = find(a)
        if i is not None:
            best[r] = i if best.get(r) is None else min(best[r], i)
    return [(n, best.get(find(a))) for a, n in enumerate(count)]


def targets(sizes, weights=(1, 2, 3), most=3):
    """source -> target of source -> size, by resharing again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        open_ = sum(w[s] for s in order if s not in full)
        left = total - sum(most * sizes[s] for s in full)
        t = {s: most * sizes[s] if s in full else left * w[s] / open_ for s in order}
        more = {s for s in order if t[s] > most * sizes[s] * (1 + 1e-12)}
        if not more:
            return t
        full |= more
