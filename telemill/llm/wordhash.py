"""Words of many UTF-8 texts as 64-bit hashes, in numpy.

Words are runs of ASCII letters and digits (A-Z as a-z) and of all bytes from
128 up. Equal words have equal hashes; different ones collide with a chance of
about 2^-64 a pair.
"""

from __future__ import annotations

import numpy as np

_FOLD = np.zeros(256, np.uint8)
for _b in (*range(48, 58), *range(97, 123), *range(128, 256)):
    _FOLD[_b] = _b
for _b in range(65, 91):
    _FOLD[_b] = _b + 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[np.uint64, np.ndarray] = {}

#: Bytes that are summed at once, eight bytes of memory each and more; a longer word goes whole.
SUMMED_AT_ONCE = 1 << 18


def _power(base: np.uint64, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        x = np.full(max(n, 1 << 16), base, np.uint64)
        x[0] = 1
        _powers[base] = np.cumprod(x, dtype=np.uint64)
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_words(texts: list[str | bytes | None], fold: np.ndarray = _FOLD) -> tuple[np.ndarray, np.ndarray]:
    """All words' hashes in order, and where each text's begin (one more entry than texts). fold: what each byte counts as, zero apart words."""
    coded = [t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = fold[np.frombuffer(b" ".join([*coded, b""]), np.uint8)]
    ends = np.cumsum([len(c) + 1 for c in coded]) if coded else np.zeros(0, int)
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = data != 0
    turn = np.diff(word)
    first, last = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    hashes = np.zeros(len(first), np.uint64)
    at = 0
    while at < len(first):
        stop = max(at + 1, int(np.searchsorted(last, first[at] + SUMMED_AT_ONCE, "right")))
        part = data[first[at] : last[stop - 1]]
        lo, hi = first[at:stop] - first[at], last[at:stop] - first[at]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * _power(_BASE, len(part)), out=sums[1:])
        hashes[at:stop] = mix((sums[hi] - sums[lo]) * _power(_INVERSE, len(part) + 1)[lo])
        at = stop
    return hashes, np.concatenate([[0], np.searchsorted(first, ends)])


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of so many words."""
    n = len(words) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out ^ words[k : k + n]) * np.uint64(0x9FB21C651E98DF25 + 2 * k)
        out ^= out >> np.uint64(28)
    return out
