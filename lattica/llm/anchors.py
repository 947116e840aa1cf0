"""Content-defined anchors: the routing that substring operators share.

A window is ``k`` consecutive symbols of one document. Of the ``k - q + 1`` runs of ``q`` symbols inside a window, the
one with the smallest hash (the leftmost of equals) is its anchor. Equal windows have equal anchors, wherever they
stand, so all occurrences of a repeat of ``k`` symbols or more meet under one anchor. Successive windows mostly share
an anchor; such a row of windows is one *phrase*: (anchor, hash of its symbols, document, start, number of windows).
A phrase stands for about ``(k - q) / 2`` windows, and that is what is shuffled instead of windows.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
POS_BITS = 28
#: Windows handled at once: bounds the memory for very long texts; a phrase ends where such a part ends.
PART = 1 << 17
_BASES = (U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95))
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def _powers(base: int, inverse: bool, n: int) -> np.ndarray:
    """Successive powers of a base, or of its inverse, modulo 2**64."""
    have = _POWERS.get((base, inverse))
    if have is None or len(have) < n:
        x = int(_BASES[base])
        if inverse:
            x = pow(x, -1, 1 << 64)
        size = max(n, PART + 4096)
        steps = np.full(size, x, dtype=U)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        _POWERS[base, inverse] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: Random 64-bit symbols of the 256 bytes.
BYTE_SYMBOLS = mix((np.arange(256, dtype=U) + U(1)) * U(0xA0761D6478BD642F))


def prefix(symbols: np.ndarray, base: int) -> np.ndarray:
    out = np.empty(len(symbols) + 1, dtype=U)
    out[0] = 0
    np.cumsum(symbols * _powers(base, True, len(symbols)), out=out[1:])
    return out


def window_hashes(symbols: np.ndarray, k: int, base: int = 0) -> np.ndarray:
    """A 64-bit hash of every ``k`` consecutive symbols; empty for fewer symbols."""
    n = len(symbols) - k + 1
    if n < 1:
        return np.empty(0, dtype=U)
    p = prefix(symbols, base)
    return mix((p[k:] - p[:n]) * _powers(base, False, n))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every ``w`` consecutive values, by doubling."""
    done = 1
    while done * 2 <= w:
        x = np.minimum(x[: len(x) - done], x[done:])
        done *= 2
    if done < w:
        x = np.minimum(x[: len(x) - (w - done)], x[w - done :])
    return x


def phrases(symbols: np.ndarray, k: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, hash, start, windows) of every phrase of a document; no rows when it is shorter than a window."""
    total = len(symbols) - k + 1
    if total < 1:
        none = np.empty(0, dtype=np.int64)
        return none, none, none, none
    parts = [_phrases(symbols[at : min(at + PART, total) + k - 1], k, q, at) for at in range(0, total, PART)]
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts))


def _phrases(symbols: np.ndarray, k: int, q: int, at: int):
    n = len(symbols) - k + 1
    grams = window_hashes(symbols, q)
    low = U((1 << POS_BITS) - 1)
    keyed = (grams & ~low) | np.arange(len(grams), dtype=U)
    place = (sliding_min(keyed, k - q + 1) & low).astype(np.int64)
    starts = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
    ends = np.append(starts[1:], n)
    p = prefix(symbols, 1)
    whole = mix((p[ends + k - 1] - p[starts]) * _powers(1, False, n)[starts])
    return grams[place[starts]].view(np.int64), whole.view(np.int64), starts + at, ends - starts
