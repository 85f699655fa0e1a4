"""Suffix order by induced sorting, with queues that go to disk and common prefixes carried along.

Positions are of type S if their suffix is smaller than the next one, else L; an
S after an L is leftmost (LMS). From the order of the LMS suffixes one scan
upward induces the L suffixes and one scan downward the S suffixes: a suffix
that is scanned puts the one before it at the end of its first byte's queue.
Since places are taken in order, a queue for each byte is a priority queue whose
smallest entry is always at its head; queues hold tuples (position, common
prefix with the entry before) and spill to a temporary file beyond QUEUE_BYTES.

The order of the LMS suffixes comes by recursion: the same two scans, begun with
the LMS positions in any order, order the LMS substrings; equal ones get one
name; names are named again in pairs, pairs of pairs and so on, until all differ
or cover WIDTH bytes, beyond which order is of no interest here.

A common prefix is 1 plus the least common prefix among the scanned suffixes
since the last one put in that queue; where L and S suffixes of a byte meet it
is the shorter of their runs of that byte.
"""

from __future__ import annotations

import tempfile

import numpy as np

from .wordhash import _BASE, _INVERSE, _power, mix

WIDTH = 50
#: Bytes of a queue kept in memory.
QUEUE_BYTES = 8 << 20


def slices(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The given slices, end to end."""
    out = np.cumsum(size)
    total = int(out[-1]) if len(out) else 0
    step = np.ones(total, np.int64)
    if total:
        heads = out - size
        step[heads] = begin
        step[heads[1:]] -= begin[:-1] + size[:-1] - 1
    return data[np.cumsum(step)] if total else data[:0]


def same_slices(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a : a + size] and data[b : b + size] are the same bytes, eight at a time."""
    eight = np.ndarray((len(data),), "<u8", data.tobytes() + bytes(8), 0, (1,))
    out = np.ones(len(a), bool)
    words = (size + 7) // 8
    at = 0
    ends = np.cumsum(words)
    while at < len(a):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 18), "right")))
        n = words[at:stop]
        of = np.repeat(np.arange(at, stop), n)
        k = 8 * (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n))
        unlike = eight[a[of] + k] ^ eight[b[of] + k]
        rest = np.minimum(size[of] - k, 8)  # the last word may have fewer bytes
        unlike[rest < 8] &= (np.uint64(1) << (8 * rest[rest < 8]).astype(np.uint64)) - np.uint64(1)
        out[of[unlike != 0]] = False
        at = stop
    return out


class Queue:
    """First in, first out, of (positions, common prefixes)."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0
        self.file = None
        self.counts: list[int] = []

    def push(self, at: np.ndarray, lcp: np.ndarray) -> None:
        self.parts.append((at, lcp))
        self.held += at.nbytes + lcp.nbytes
        if self.held > QUEUE_BYTES:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            for a, c in self.parts:
                self.file.write(a.tobytes())
                self.file.write(c.tobytes())
                self.counts.append(len(a))
            self.parts, self.held = [], 0

    def pop_all(self):
        """Everything pushed before the call, part by part, oldest first; what is pushed meanwhile waits for the next."""
        file, counts, parts = self.file, self.counts, self.parts
        self.file, self.counts, self.parts, self.held = None, [], [], 0
        if file is not None:
            file.seek(0)
            for n in counts:
                yield np.frombuffer(file.read(4 * n), np.int32), np.frombuffer(file.read(n), np.uint8)
            file.close()
        if parts:
            yield np.concatenate([a for a, _ in parts]), np.concatenate([c for _, c in parts])

    def __bool__(self) -> bool:
        return bool(self.parts) or self.file is not None


def _least(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minima of x over the ranges lo..hi, both included, by doubling."""
    levels = [x]
    longest = int((hi - lo + 1).max())
    while 2 << (len(levels) - 1) <= longest:
        w = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-w], levels[-1][w:]))
    power = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    out = np.empty(len(lo), x.dtype)
    for k, level in enumerate(levels):
        of = np.flatnonzero(power == k)
        if len(of):
            out[of] = np.minimum(level[lo[of]], level[hi[of] - (1 << k) + 1])
    return out


class _Scan:
    """One direction's queues: takes scanned suffixes, puts their predecessors of the wanted type in line."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray):
        self.text, self.wanted = text, wanted
        self.queues = [Queue() for _ in range(256)]
        self.since = np.full(256, 255, np.uint8)
        self.begun = np.zeros(256, bool)

    def take(self, at: np.ndarray, lcp: np.ndarray) -> None:
        before = at - 1
        index = np.flatnonzero((at > 0) & self.wanted[before])
        if not len(index):
            np.minimum(self.since, lcp.min(), out=self.since)
            return
        byte = self.text[before[index]]
        order = np.argsort(byte, kind="stable")
        index, byte = index[order], byte[order]
        head = np.ones(len(index), bool)
        head[1:] = byte[1:] != byte[:-1]
        lo = np.zeros(len(index), np.int64)
        lo[1:] = np.where(head[1:], 0, index[:-1] + 1)
        common = _least(lcp, lo, index)
        h = np.flatnonzero(head)
        common[h] = np.minimum(common[h], self.since[byte[h]])
        common = np.minimum(common, WIDTH - 1) + np.uint8(1)
        common[h[~self.begun[byte[h]]]] = 0
        bounds = np.append(h, len(index))
        target = before[index].astype(np.int32)
        for k, b in enumerate(byte[h].tolist()):
            self.queues[b].push(target[bounds[k] : bounds[k + 1]], common[bounds[k] : bounds[k + 1]])
        rest = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.uint8(255))
        np.minimum(self.since, rest[0], out=self.since)
        self.since[byte[h]] = rest[index[bounds[1:] - 1] + 1]
        self.begun[byte[h]] = True


def _join(parts: list) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.uint8)
    return np.concatenate([a for a, _ in parts]), np.concatenate([c for _, c in parts])


def _induce(text: np.ndarray, small: np.ndarray, run: np.ndarray, lms: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """All suffixes by first byte, ascending, from the LMS suffixes of each byte."""
    up, down = _Scan(text, ~small), _Scan(text, small)
    large: list[tuple[np.ndarray, np.ndarray]] = []
    for b in range(256):
        parts = []
        while up.queues[b]:
            for at, lcp in up.queues[b].pop_all():
                parts.append((at, lcp))
                up.take(at, lcp)
        large.append(_join(parts))
        at, lcp = lms[b]
        if len(at):
            lcp = lcp.copy()
            lcp[0] = min(run[at[0]], run[large[b][0][-1]]) if len(large[b][0]) else 0
            up.take(at, lcp)
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int32), np.zeros(0, np.uint8))] * 256
    for b in range(255, -1, -1):
        parts = []
        while down.queues[b]:
            for at, lcp in down.queues[b].pop_all():
                parts.append((at, lcp))
                down.take(at, lcp)
        at, lcp = _join(parts)  # falling
        lat, llcp = large[b]
        meet = 0
        if len(lat):
            back = np.zeros(len(lat), np.uint8)
            back[1:] = llcp[:0:-1]
            if len(at):
                meet = min(run[lat[-1]], run[at[-1]])
                back[0] = meet
            down.take(lat[::-1], back)
        rising = np.zeros(len(at), np.uint8)
        if len(at):
            rising[1:] = lcp[:0:-1]
            rising[0] = meet
        out[b] = (np.concatenate([lat, at[::-1]]), np.concatenate([llcp, rising]))
    return out


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """text: bytes without 0 but for one at the end of each stretch, which ends it.

    Positions in the order of their suffixes (to WIDTH bytes and within their
    stretch), and the common prefix of each with the one before, at most WIDTH.
    """
    n = len(text)
    ends = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)
    end = np.repeat(ends, np.diff(ends, prepend=-1))
    small = np.append(text, np.uint8(255))[end + 1] > text[end]
    run = np.minimum(end - np.arange(n) + 1, WIDTH).astype(np.uint8)
    del end
    is_lms = small.copy()
    is_lms[0] = False
    is_lms[1:] &= ~small[:-1]
    lms = np.flatnonzero(is_lms)
    none = (np.zeros(0, np.int32), np.zeros(0, np.uint8))

    def by_byte(at: np.ndarray, lcp: np.ndarray):
        byte = text[at]
        cuts = np.searchsorted(byte, np.arange(257))
        return [(at[a:b].astype(np.int32), lcp[a:b]) if b > a else none for a, b in zip(cuts, cuts[1:], strict=False)]

    any_order = lms[np.argsort(text[lms], kind="stable")]
    first = _induce(text, small, run, by_byte(any_order, np.zeros(len(lms), np.uint8)))
    order = np.concatenate([a for a, _ in first])
    order = order[is_lms[order]]
    order = np.concatenate([lms[text[lms] == 0], order[text[order] != 0]])
    # names of LMS substrings
    number = np.full(n, -1, np.int32)
    number[lms] = np.arange(len(lms))
    size = np.diff(lms, append=n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), out=sums[1:])
    stop = np.minimum(lms + size + 1, n)
    value = mix((sums[stop] - sums[lms]) * _power(_INVERSE, n + 1)[lms]) ^ (stop - lms).astype(np.uint64)
    ending = text[lms] == 0
    value[ending] = 0
    k = number[order]
    new = np.ones(len(k), bool)
    new[1:] = value[k[1:]] != value[k[:-1]]
    # equal hashes are no proof: the bytes decide (stretch ends are alike by definition)
    like = 1 + np.flatnonzero(~new[1:] & ~ending[k[1:]])
    x, y = k[like - 1], k[like]
    new[like] = (stop - lms)[x] != (stop - lms)[y]
    like, x, y = like[~new[like]], x[~new[like]], y[~new[like]]
    new[like] = ~same_slices(text, lms[x], lms[y], (stop - lms)[x])
    name = np.empty(len(k), np.int64)
    name[k] = np.cumsum(new)
    stretch = np.cumsum(ending) - ending
    step = 1
    while step < 32 and int(name.max(initial=0)) < len(name):
        ahead = np.zeros(len(name), np.int64)
        ahead[:-step] = np.where(stretch[step:] == stretch[:-step], name[step:], 0)
        _, name = np.unique(name * (len(name) + 2) + ahead, return_inverse=True)
        name = name + 1
        step *= 2
    at = lms[np.argsort(name, kind="stable")]
    lcp = np.zeros(len(at), np.uint8)
    padded = np.concatenate([text, np.zeros(WIDTH + 8, np.uint8)])
    eight = np.ndarray((n + WIDTH,), "<u8", padded.tobytes(), 0, (1,))
    open_ = np.arange(1, len(at))
    for w in range(0, WIDTH, 8):
        if not len(open_):
            break
        x = eight[at[open_] + w].astype(np.uint64) ^ eight[at[open_ - 1] + w].astype(np.uint64)
        same = np.where(x == 0, 8, np.frexp((x & (~x + np.uint64(1))).astype(np.float64))[1] - 1 >> 3)
        lcp[open_] = np.minimum(w + same, WIDTH)
        open_ = open_[same == 8]
    got = _induce(text, small, run, by_byte(at, lcp))
    return np.concatenate([a for a, _ in got]).astype(np.int64), np.concatenate([c for _, c in got])


def sorted_strings(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of starts (ascending) in the order of their WIDTH bytes, and where the common prefix with the one before is shorter."""
    head = np.ones(len(starts), bool)
    head[1:] = np.diff(starts) > WIDTH
    a = np.flatnonzero(head)
    begin = starts[a]
    size = starts[np.append(a[1:], len(starts)) - 1] + WIDTH - begin
    place = np.cumsum(size + 1) - (size + 1)
    text = np.zeros(int((size + 1).sum()), np.uint8)
    inside = np.ones(len(text), bool)
    inside[place + size] = False
    text[inside] = slices(data, begin, size) + np.uint8(1)
    of = np.cumsum(head) - 1
    where = starts - begin[of] + place[of]
    number = np.full(len(text), -1, np.int64)
    number[where] = np.arange(len(starts))
    order, lcp = suffix_order(text)
    group = np.cumsum(lcp < WIDTH)
    wanted = number[order] >= 0
    group = group[wanted]
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    return number[order[wanted]], new
