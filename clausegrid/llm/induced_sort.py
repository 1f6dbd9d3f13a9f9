"""Suffix order and common-prefix lengths of many short texts by external induced sorting.

The leftmost smaller suffixes (LMS: those smaller than the next, after one that is larger) are put
in order first; all others are then induced from them in two sweeps over the first symbols, up for
suffixes larger than their successor and down for the rest. What a sweep induces waits in a
priority queue of (first symbol, order of arrival, position, common prefix with the suffix that
arrived before), kept in memory up to ``memory`` bytes and in unlinked files beyond. A suffix that
is induced from another has its common prefix plus one, so common-prefix values travel with the
tuples and no text is compared in the sweeps. Every step treats a whole queue of one symbol at a
time in numpy.

The order of LMS suffixes is the smaller problem of the recursion. Its symbols are as many as its
positions, which leaves no queues to sweep, so it is solved by doubling over ranks, up to ``depth``
bytes: suffixes that agree on so many count as equal.
"""

from __future__ import annotations

import tempfile

import numpy as np

MEMORY = 96 << 20
#: Symbols: the end of all texts, then bytes + 1 (UTF-8 has none above 0xF4), and the end of each text.
LAST, GAP = 0, 0xFF
CAP = 250


def scratch(n: int, kind, memory: int = MEMORY) -> np.ndarray:
    """An array in memory, or in an unlinked file if it is large."""
    if n * np.dtype(kind).itemsize <= memory:
        return np.zeros(n, kind)
    return np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=(n,))


class Queue:
    """Tuples by symbol, in order of arrival, in memory or on disk."""

    def __init__(self, memory: int = MEMORY):
        self.memory, self.held = memory, 0
        self.parts: list[list] = [[] for _ in range(256)]
        self.file, self.end = None, 0

    def push(self, symbol: int, position: np.ndarray, shared: np.ndarray) -> None:
        size = position.nbytes + shared.nbytes
        if self.held + size > self.memory:
            self._spill()
        self.parts[symbol].append((position, shared))
        self.held += size

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        for parts in self.parts:
            for k, part in enumerate(parts):
                if not isinstance(part[0], int):
                    position, shared = part
                    self.file.seek(self.end)
                    self.file.write(position.tobytes())
                    self.file.write(shared.tobytes())
                    parts[k] = (self.end, len(position), position.dtype)
                    self.end += position.nbytes + shared.nbytes
        self.held = 0

    def pop(self, symbol: int, kind) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for part in self.parts[symbol]:
            if isinstance(part[0], int):
                at, n, held = part
                self.file.seek(at)
                out.append((np.frombuffer(self.file.read(n * held.itemsize), held), np.frombuffer(self.file.read(n), np.uint8)))
            else:
                out.append(part)
                self.held -= part[0].nbytes + part[1].nbytes
        self.parts[symbol] = []
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, kind), np.zeros(0, np.uint8))


def _kinds(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is smaller than the next, and the length of its run of one symbol (CAP at most)."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    change = np.append(change, n - 1)
    sizes = np.diff(np.append(-1, change))
    rising = np.append(text[change[:-1] + 1] > text[change[:-1]], True)
    run = np.repeat(change + 1, sizes) - np.arange(n)
    return np.repeat(rising, sizes), np.minimum(run, CAP).astype(np.uint8)


def _words(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as big-endian numbers would compare; views, no copy."""
    return np.ndarray((len(text) - 7,), ">u8", buffer=text.data, strides=(1,))


def _rank(keys: list[np.ndarray]) -> np.ndarray:
    """Ranks from 0 of rows by their keys, the first key first; equal rows have equal ranks."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _lms_order(text: np.ndarray, lms: np.ndarray, depth: int) -> np.ndarray:
    """LMS suffixes in order, as far as ``depth`` bytes decide."""
    n = len(lms)
    size = np.diff(np.append(lms, lms[-1])) + 1  # both ends included; the last is the end alone
    padded = np.concatenate([text, np.full(16, 0xFF, np.uint8)])
    words = _words(padded)
    rank, step = np.zeros(n, np.int64), 0
    while True:
        live = np.flatnonzero(size > 8 * step)
        if not len(live):
            break
        left = np.minimum(size[live] - 8 * step, 8)
        word = words[lms[live] + 8 * step].astype(np.uint64)
        fill = np.where(left < 8, (np.uint64(1) << ((8 - left) * 8 % 64).astype(np.uint64)) - np.uint64(1), np.uint64(0))
        whole = np.full(n, ~np.uint64(0))
        whole[live] = word | fill
        # A piece that ends where another goes on is the greater: its last symbol begins a rise.
        rank = _rank([rank, whole, -np.minimum(size, 8 * (step + 1))] if step else [whole, -np.minimum(size, 8)])
        step += 1
        if 8 * step >= depth + 8:
            break
    # Doubling: a piece spans two symbols at least, so depth / 2 pieces are enough.
    reach = 1
    while reach < depth // 2 + 1 and int(rank.max()) < n - 1:
        ahead = np.full(n, -1, np.int64)
        ahead[: n - reach] = rank[reach:] if reach < n else ahead[: n - reach]
        rank = _rank([rank * np.int64(n + 1) + ahead + 1])
        reach *= 2
    return np.argsort(rank, kind="stable")


def _shared(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix lengths of pairs of suffixes, CAP at most."""
    padded = np.concatenate([text, np.zeros(CAP + 16, np.uint8)])
    words = _words(padded)
    out = np.full(len(a), CAP, np.uint8)
    live = np.arange(len(a))
    for k in range(0, CAP, 8):
        differ = words[a[live] + k].astype(np.uint64) ^ words[b[live] + k].astype(np.uint64)
        done = differ != 0
        if done.any():
            lead = 63 - np.floor(np.log2(differ[done].astype(np.float64))).astype(np.int64)
            # log2 of a number just below a power may round up to it; the quotient is unharmed but at a byte's edge.
            lead = np.where((differ[done] >> np.minimum(63 - lead, 63).astype(np.uint64)) == 0, lead + 1, lead)
            out[live[done]] = np.minimum(k + lead // 8, CAP)
        live = live[~done]
        if not len(live):
            break
    return out


def _induce(queue: Queue, text: np.ndarray, position: np.ndarray, shared: np.ndarray, wanted: np.ndarray) -> None:
    """Queue what comes before the wanted positions of a sequence; ``shared`` is each one's common prefix with the one before it."""
    index = np.flatnonzero(wanted)
    if not len(index):
        return
    before = position[index] - 1
    symbol = text[before]
    order = np.argsort(symbol, kind="stable")
    index, before, symbol = index[order], before[order], symbol[order]
    same = np.zeros(len(index), bool)
    same[1:] = symbol[1:] == symbol[:-1]
    value = np.ones(len(index), np.uint8)
    if same.any():
        at = np.flatnonzero(same)
        bounds = np.stack([index[at - 1] + 1, index[at] + 1], 1).ravel()
        low = np.minimum.reduceat(np.append(shared, np.uint8(CAP)), bounds)[::2]
        value[at] = np.minimum(low, CAP - 1) + 1
    heads = np.flatnonzero(~same)
    for a, b in zip(heads.tolist(), np.append(heads[1:], len(index)).tolist()):
        queue.push(int(symbol[a]), before[a:b], value[a:b])


def _grow(text: np.ndarray, run: np.ndarray, c: int, position: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A symbol's sequence with all that it induces within itself, round by round of longer runs."""
    positions, values = [position], [shared]
    while len(position):
        index = np.flatnonzero((position > 0) & (text[position - 1] == c))
        if not len(index):
            break
        value = np.empty(len(index), np.uint8)
        value[0] = min(int(run[positions[-1][-1]]), int(run[position[index[0]] - 1]))
        if len(index) > 1:
            bounds = np.stack([index[:-1] + 1, index[1:] + 1], 1).ravel()
            value[1:] = np.minimum(np.minimum.reduceat(np.append(shared, np.uint8(CAP)), bounds)[::2], CAP - 1) + 1
        position, shared = position[index] - 1, value
        positions.append(position)
        values.append(shared)
    return np.concatenate(positions), np.concatenate(values)


def suffix_runs(texts: list[bytes], depth: int, memory: int = MEMORY):
    """Yields, for each first symbol, (position, shared): its suffixes from the greatest down, and what each has in common with the one above.

    Positions count through ``symbols(texts)``. Order and values are exact up to ``depth`` bytes.
    """
    text = symbols(texts, memory)
    n = len(text)
    if n == 1:
        return
    kind = np.int32 if n < 2**31 - 1 else np.int64
    rising, run = _kinds(text)
    lms = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
    lms = lms[_lms_order(text, lms, depth)].astype(kind)
    shared = np.zeros(len(lms), np.uint8)
    shared[1:] = _shared(text, lms[:-1].astype(np.int64), lms[1:].astype(np.int64), depth)
    first = text[lms]
    cuts = np.searchsorted(first, np.arange(257))

    queue, falling = Queue(memory // 2), Queue(memory // 2)
    for c in range(256):
        position, value = _grow(text, run, c, *queue.pop(c, kind))
        own, own_value = lms[cuts[c] : cuts[c + 1]], shared[cuts[c] : cuts[c + 1]].copy()
        if len(position):
            falling.push(c, position, value)
        if len(own):
            own_value[0] = min(int(run[position[-1]]), int(run[own[0]])) if len(position) else 0
        whole, values = np.concatenate([position, own]), np.concatenate([value, own_value])
        if len(whole):
            _induce(queue, text, whole, values, (whole > 0) & (text[whole - 1] > c))
    queue = Queue(memory // 2)
    for c in range(255, -1, -1):
        # Down the symbol: suffixes that rise first, then those that fall, each with what it shares with the one above.
        position, value = _grow(text, run, c, *queue.pop(c, kind))
        up, up_value = falling.pop(c, kind)
        seam = np.uint8(min(int(run[position[-1]]), int(run[up[-1]])) if len(position) and len(up) else 0)
        whole, values = np.concatenate([position, up[::-1]]), np.concatenate([value, [seam][: len(up)], up_value[:0:-1]]).astype(np.uint8)
        if len(whole):
            values[0] = 0
            yield whole, values
            _induce(queue, text, whole, values, (whole > 0) & (text[whole - 1] < c))


def symbols(texts: list[bytes], memory: int = MEMORY) -> np.ndarray:
    """All texts, each with a gap behind it, and the end."""
    out = scratch(sum(map(len, texts)) + len(texts) + 1, np.uint8, memory)
    at = 0
    for t in texts:
        out[at : at + len(t)] = np.frombuffer(t, np.uint8) + np.uint8(1)
        out[at + len(t)] = GAP
        at += len(t) + 1
    out[-1] = LAST
    return out


def repeated(texts: list[bytes], depth: int, memory: int = MEMORY) -> np.ndarray:
    """For each position of ``symbols(texts)`` whether ``depth`` bytes from there on occur at another position too."""
    out = scratch(sum(map(len, texts)) + len(texts) + 1, bool, memory)
    for position, shared in suffix_runs(texts, depth, memory):
        close = np.flatnonzero(shared >= depth)
        out[position[close]] = True
        out[position[close - 1]] = True
    at = 0
    for t in texts:  # what runs over the end of its text is no string of it
        out[at + max(0, len(t) - depth + 1) : at + len(t) + 1] = False
        at += len(t) + 1
    out[-1] = False
    return out
