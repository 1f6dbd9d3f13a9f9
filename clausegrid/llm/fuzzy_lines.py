"""Line dedup: SimHash of normalised lines, joined on pigeonhole blocks, verified by edit similarity.

A line is what stands between newlines; its normal form is its words (digits 0-9 as 0, A-Z
lower-cased, bytes from 0x80), joined by single spaces. Lines without words are left alone. Lines
of equal normal form are one node. A line has a 64-bit SimHash of all its words, and a number of blocks
(``CLASSES``, by its number of words). A word's hash deals it to one block, and a block is the 32-bit SimHash of
its own different words. So an edited word changes two blocks at most, that of the old word and that of the
new one, and by the pigeonhole principle lines that differ in fewer words than half their blocks agree on a
block. (In blocks cut from one SimHash every word has a vote in every block; one word in ten
changes nine bits of 64, all over.) Lines that agree on a block of two words or more, or on three of five blocks where lines have fewer than
ten words, are compared: they link if their SimHashes differ in at most ``BITS`` bits, by their length, and their normal forms have
an edit similarity (1 - distance / longer length) of ``SIMILARITY`` or more. Lines near the upper
end of a class are in the next one too, so that lines of similar length always meet.

Of each connected group of lines the first occurrence by (doc_id, row, line number) stays, all others are
removed. README gives the recall against all pairs.

Only groups are asked for, so a key first gives pairs until each of its lines that has a partner is
in one, and the other pairs of a key are formed only where its lines are still in several groups. No
pair is left out otherwise.

Null and empty texts have no lines with words. A null doc_id comes last. Rows that repeat both id
and text count as one row and are answered each. A very long text is read in its Arrow batch, a very long
line is one line. An empty table gives no rows. Other columns, whatever their names, are ignored (``drop_lines`` keeps
them, but for such as are called n_lines or n_removed).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

#: Bits that SimHashes may differ in, of lines of fewer than ``SHORT`` characters and of longer ones; an edited word weighs more in a short line.
SHORT, BITS, SIMILARITY = 80, (18, 12), 0.8
#: Characters of a line that a key counts; longer lines pass the test of lengths.
LONG = (1 << 15) - 1
#: Lines of so many words or more have so many blocks, of which so many together are a key; from the last class on, twice the words have twice the blocks.
CLASSES = [(1, 5, 3), (10, 5, 1), (20, 6, 1), (40, 10, 1), (80, 16, 1), (160, 24, 1)]
#: Different words that a key must stand for.
LEAST = 2
#: Words that are dealt to blocks together.
TOGETHER = 1 << 18
HELD = 2_000_000
#: Cuts of lines that are compared together, words of their table, fewest cuts and longest lines for which that pays.
CHUNK, TABLE, FEW, LONGEST = 4096, 1 << 21, 64, 4096
#: Words of cells of a column that are found together; so many pairs and one for each word of a column must be for that to pay.
CELLS, FEWEST = 1 << 14, 16
#: Words of either side to look ahead, the nearest first.
_AHEAD = sorted(((p, q) for p in range(5) for q in range(5) if p or q), key=lambda x: (x[0] + x[1], abs(x[0] - x[1])))
_WORD = common.byte_class([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
_NORMAL = common.LOWER.copy()
_NORMAL[0x30:0x3A] = 0x30
_STEP = np.uint64(0xD6E8FEB86659FD93)


def begins_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the lines of one block begin, their documents and their numbers in these; what is empty at a text's end is no line."""
    breaks = np.flatnonzero(data == 10)
    begins = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    begins = begins[begins < len(data)]
    doc = np.searchsorted(offsets, begins, "right") - 1
    number = np.arange(len(begins)) - np.searchsorted(begins, offsets[:-1])[doc] if len(begins) else np.zeros(0, np.int64)
    return begins, doc, number


def lines_of(data: np.ndarray, offsets: np.ndarray, sketched: bool = True):
    """Of one block: document and number of each line with words, its node, SimHash, characters of its normal form, and words' (low bytes, starts, ends, first word, hashes)."""
    low = np.take(_NORMAL, data, mode="clip")
    begins, doc, number = begins_of(data, offsets)
    starts, ends, _ = common.words(low, np.append(begins, len(data)), _WORD)
    cut = np.searchsorted(starts, begins)
    full = np.flatnonzero(np.diff(np.append(cut, len(starts))) > 0)
    first = cut[full]
    if not len(full):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, (low, starts, ends, first, none.view(np.uint64))
    hashed = common.word_hash(low, starts, ends)
    n = np.diff(np.append(first, len(starts)))
    place = np.arange(len(starts)) - np.repeat(first, n)
    powers = np.multiply.accumulate(np.full(int(n.max()) + 1, _STEP))
    node = common.mix(np.add.reduceat(hashed * powers[place], first) + n.astype(np.uint64)).view(np.int64)
    sketch = np.zeros(len(full), np.int64)
    for k in range(0, len(full) if sketched else 0, 4096):  # bounded scratch space
        a, b = first[k], first[k + 4096] if k + 4096 < len(first) else len(starts)
        size = n[k : k + 4096]
        votes = _votes(np.unpackbits(hashed[a:b].view(np.uint8).reshape(-1, 8), axis=1), first[k : k + 4096] - a, size)
        sketch[k : k + 4096] = np.packbits(votes > (size // 2)[:, None], axis=1).view(np.int64).ravel()
    size = np.add.reduceat(ends - starts, first) + n - 1
    later = np.flatnonzero((low & 0xC0) == 0x80)  # bytes of a character after its first
    if len(later):
        size -= np.diff(np.searchsorted(later, np.append(starts[first], len(low))))
    return doc[full], number[full], node, sketch, size, (low, starts, ends, first, hashed)


def _votes(bits: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the rows of 0 and 1 of each run that begins at ``heads``: eight columns at a time, as the bytes of one number, and so at most 255 rows at once."""
    parts = -(-sizes // 255)
    starts = np.cumsum(parts) - parts
    begin = np.repeat(heads, parts) + 255 * (np.arange(parts.sum()) - np.repeat(starts, parts))
    wide = bits.view(np.uint64)
    out = np.empty((len(begin), wide.shape[1]), np.uint64)
    for k in range(wide.shape[1]):
        out[:, k] = np.add.reduceat(np.ascontiguousarray(wide[:, k]), begin)
    out = out.view(np.uint8)
    return out if len(begin) == len(heads) else np.add.reduceat(out, starts, axis=0, dtype=np.int32)


def _simhash(hashed: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Majority of the last 32 bits of the hashes, of runs of words."""
    votes = _votes(np.unpackbits(hashed.astype(np.uint32).view(np.uint8).reshape(-1, 4), axis=1), heads, sizes)
    return np.packbits(votes > (sizes // 2)[:, None], axis=1).view(np.uint32).ravel().astype(np.uint64)


def classes(most: int):
    """(least words, most words, blocks, blocks of a key) of every class that lines of up to ``most`` words need, the upper end of the class below included."""
    found = list(CLASSES)
    while found[-1][0] * 4 // 5 <= most:
        low, blocks, together = found[-1]
        found.append((2 * low, 2 * blocks, together))
    for (low, blocks, together), (high, *_) in zip(found, found[1:]):
        yield low * 4 // 5, high, blocks, together


def block_keys(hashed: np.ndarray, first: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(line, key): the keys of lines (only of the wanted ones, if given) whose words have these hashes and begin at ``first``."""
    lines, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    if not len(first):
        return lines[0], keys[0]
    n = np.diff(np.append(first, len(hashed)))
    for k, (low, high, blocks, together) in enumerate(classes(int(n.max()))):
        chosen = np.flatnonzero((n >= low) & (n < high) & (True if wanted is None else wanted))
        ends = np.cumsum(n[chosen])
        for own in np.split(chosen, np.unique(np.searchsorted(ends, np.arange(TOGETHER, ends[-1] + 1, TOGETHER)) + 1)) if len(chosen) else ():
            if not len(own):
                continue
            size = n[own]
            of = np.repeat(np.arange(len(own)), size)
            word = common.mix(hashed[np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + first[own][of]] + np.uint64(k))
            # In the order of (line, hash), so in that of blocks too, which are ranges of hashes; a word counts once.
            order = np.argsort(of.astype(np.uint64) << np.uint64(44) | word >> np.uint64(20))
            of, word = of[order], word[order]
            new = np.r_[True, (word[1:] != word[:-1]) | (of[1:] != of[:-1])]
            of, word = of[new], word[new]
            at = of * blocks + (((word >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)
            heads = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            held = np.diff(np.append(heads, len(at)))
            block = common.mix(_simhash(common.mix(word), heads, held) * np.uint64(2 * k + 3) + held.astype(np.uint64))
            at = at[heads]
            if together == 1:
                good = held >= LEAST
                lines.append(own[at[good] // blocks])
                keys.append(common.mix(block[good] + (at[good] % blocks).astype(np.uint64)))
            else:
                grid, count = np.zeros(len(own) * blocks, np.uint64), np.zeros(len(own) * blocks, np.int64)
                grid[at], count[at] = block, held
                grid, count = grid.reshape(-1, blocks), count.reshape(-1, blocks)
                for t, choice in enumerate(combinations(range(blocks), together)):
                    good = count[:, choice].sum(1) >= LEAST
                    lines.append(own[good])
                    keys.append(common.mix((grid[:, choice] * _STEP ** np.arange(1, together + 1, dtype=np.uint64)).sum(1, dtype=np.uint64) + np.uint64(t))[good])
    return np.concatenate(lines), np.concatenate(keys)


def distance(a: str, b: str, most: int | None = None) -> int:
    """Edit distance, all cells of a column at once in the bits of an integer; with ``most``, any greater number once it is sure to be greater."""
    if len(a) < len(b):
        a, b = b, a
    n = len(b)
    if not n:
        return len(a)
    where: dict[str, int] = {}
    for i, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << i
    mask, top = (1 << n) - 1, 1 << n - 1
    plus, minus, score = mask, 0, n
    for left, c in zip(range(len(a) - 1, -1, -1), a):
        same = where.get(c, 0)
        vertical = same | minus
        horizontal = ((same & plus) + plus ^ plus) | same
        up, down = minus | ~(horizontal | plus) & mask, plus & horizontal
        score += 1 if up & top else -1 if down & top else 0
        up = (up << 1 | 1) & mask
        plus = (down << 1 & mask) | ~(vertical | up) & mask
        minus = up & vertical
        if most is not None and score - left > most:
            break  # a column lowers it by one at most
    return score


def _common(same, most: int) -> int:
    """The greatest k up to ``most`` for which ``same(k)`` holds, if it holds for all that are less."""
    low = 0
    while low < most:
        mid = (low + most + 1) // 2
        low, most = (mid, most) if same(mid) else (low, mid - 1)
    return low


def _most(length, similarity: float):
    """The greatest distance that the similarity allows at a length."""
    return np.floor((1 - similarity) * length + 1e-9).astype(np.int64)


def _apart(a: str, b: str) -> int:
    """Fewest edits that account for the three-letter strings of one that the other lacks, as each edit breaks three at most."""
    if len(a) < 24:
        return 0
    known = set(zip(b, b[1:], b[2:]))
    return -(-(len(a) - 2 - sum(map(known.__contains__, zip(a, a[1:], a[2:])))) // 3)


def _anchored(a: str, b: str, most: int) -> int:
    """A cost that turns one into the other: words of one, in order, stay where they stand once in the other and are not moved by more than ``most``; what lies between is replaced."""
    where: dict[str, int] = {}
    at = 0
    for w in b.split(" "):
        where[w] = -1 if w in where else at
        at += len(w) + 1
    cost = at = x = y = 0
    for w in a.split(" "):
        to = where.get(w, -1)
        if to >= y and abs(to - at) <= most:
            if a[x:at] != b[y:to]:
                cost += max(at - x, to - y)
            x, y = at + len(w), to + len(w)
        at += len(w) + 1
    return cost if a[x:] == b[y:] else cost + max(len(a) - x, len(b) - y)


def _near(a: str, b: str, similarity: float) -> tuple[str, str, int] | bool:
    """Whether two lines are similar enough, or, where cheap bounds do not tell, what of them differs and its greatest distance."""
    most = int(_most(np.float64(max(len(a), len(b))), similarity))
    if abs(len(a) - len(b)) > most:
        return False
    shorter = min(len(a), len(b))
    start = _common(lambda k: a[:k] == b[:k], shorter)
    stop = _common(lambda k: a[len(a) - k :] == b[len(b) - k :], shorter - start)
    a, b = a[start : len(a) - stop], b[start : len(b) - stop]
    if max(len(a), len(b)) <= most:
        return True
    if not a or not b:
        return False
    # Replacing word by word costs no less than the distance; where that is little enough, it need not be found.
    x, y = a.split(" "), b.split(" ")
    if len(x) == len(y) and sum(max(len(v), len(w)) for v, w in zip(x, y) if v != w) <= most:
        return True
    return (a, b, most) if len(a) >= len(b) else (b, a, most)


def _walked(a: str, b: str, most: int) -> int:
    """A cost that turns one into the other: word by word, and where words differ, all up to the nearest two that are equal is replaced. Ends beyond ``most``."""
    x, y = a.split(" "), b.split(" ")
    i = j = cost = 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        for p, q in _AHEAD:
            if i + p < len(x) and j + q < len(y) and x[i + p] == y[j + q]:
                break
        else:
            p = q = 1
        # One side without words loses or gains those of the other with a space each.
        cost += max(sum(map(len, x[i : i + p])) + p - 1, sum(map(len, y[j : j + q])) + q - 1) + (not p or not q)
        if cost > most:
            return cost
        i, j = i + p, j + q
    return cost + sum(map(len, x[i:])) + len(x) - i + sum(map(len, y[j:])) + len(y) - j


def far_apart(pairs: list[tuple[str, str, int]]) -> np.ndarray:
    """Which (longer, shorter, most), neither empty, have an edit distance of more than ``most`` for sure.

    The shorter line is cut into 64 characters a time. Each cut has a least distance to any part of the longer line
    where an alignment of ``most`` edits can place it (off by half of what the lengths leave), and these add up to no more than the whole's.
    """
    if not pairs:
        return np.zeros(0, bool)
    m, n, most = (np.array(x, np.int64) for x in zip(*((len(a), len(b), k) for a, b, k in pairs)))
    longer, shorter = (np.frombuffer("".join(x).encode("utf-32-le", "surrogatepass"), np.uint32) for x in zip(*((a, b) for a, b, _ in pairs)))
    begin_a, begin_b = np.cumsum(m) - m, np.cumsum(n) - n
    known = np.unique(shorter)
    of_shorter = np.searchsorted(known, shorter) + 1
    at = np.minimum(np.searchsorted(known, longer), len(known) - 1)
    of_longer = np.where(known[at] == longer, at + 1, 0)  # 0 stands for all that no shorter line has
    together = max(1, min(CHUNK, TABLE // (len(known) + 1)))
    total, cuts, done = np.zeros(len(pairs), np.int64), np.where(n <= LONGEST, -(-n // 64), 0), np.zeros(len(pairs), np.int64)
    for share in (8, 2, 1):  # an eighth of the cuts, half of them, all
        # Those whose cuts so far would not add up to ``most`` are likely alike, and left to others.
        rows = np.flatnonzero((done < cuts) & (total <= most) & ((total * n > most * 64 * done) | (done == 0)))
        new = np.minimum(cuts[rows] // share + 1, cuts[rows])
        rows, new = rows[new > done[rows]], new[new > done[rows]]
        k = new - done[rows]
        row = np.repeat(rows, k)
        cut = 64 * (np.arange(len(row)) - np.repeat(np.cumsum(k) - k - done[rows], k))
        done[rows] = new
        left = np.maximum(cut - ((most - (m - n)) // 2)[row], 0)
        width = np.minimum(cut + 64 + ((most + (m - n)) // 2)[row], m[row]) - left
        order = np.argsort(-width, kind="stable")
        for k in range(0, len(order), together):
            own = order[k : k + together]
            if len(own) >= FEW:
                at = row[own]
                np.add.at(total, at, _least(of_shorter, begin_b[at] + cut[own], np.minimum(n[at] - cut[own], 64), of_longer, begin_a[at] + left[own], width[own], len(known) + 1))
    return total > most


def _least(of_shorter: np.ndarray, cut: np.ndarray, length: np.ndarray, of_longer: np.ndarray, first: np.ndarray, width: np.ndarray, step: int) -> np.ndarray:
    """Least edit distances of cuts of up to 64 characters to any part of a stretch of other characters (by falling width), with a column's cells in the bits of a word."""
    base = np.arange(len(cut)) * step
    same = np.zeros(len(cut) * step, np.uint64)
    for k in range(int(length.max())):
        have = np.flatnonzero(length > k)
        same[base[have] + of_shorter[cut[have] + k]] |= np.uint64(1 << k)
    one, top = np.uint64(1), (length - 1).astype(np.uint64)
    plus, minus = np.full(len(cut), ~np.uint64(0)), np.zeros(len(cut), np.uint64)
    score, least = length.copy(), length.copy()
    live = np.searchsorted(-width, -np.arange(int(width[0])))  # so many are wider than that
    for j, k in enumerate(live.tolist()):
        equal, p, q = same[base[:k] + of_longer[first[:k] + j]], plus[:k], minus[:k]
        across = (((equal & p) + p) ^ p) | equal
        rise, fall = q | ~(across | p), p & across
        score[:k] += ((rise >> top[:k]) & one).view(np.int64)
        score[:k] -= ((fall >> top[:k]) & one).view(np.int64)
        np.minimum(least[:k], score[:k], out=least[:k])
        vertical = equal | q
        rise, fall = rise << one, fall << one
        plus[:k], minus[:k] = fall | ~(vertical | rise), rise & vertical
    return least


def within(pairs: list[tuple[str, str, int]]) -> np.ndarray:
    """Which (longer, shorter, most), neither empty, have an edit distance of ``most`` or less.

    Pairs of like length are found together: of a column only the words of 64 cells that a path of ``most`` edits can lead through
    (off by half of what the lengths leave), each word of all pairs at once. Cells outside count as reached by insertions only, so no distance comes out too little, and those of ``most`` or less are exact.
    """
    out = np.zeros(len(pairs), bool)
    if not pairs:
        return out
    length, most = np.array([len(a) for a, _, _ in pairs]), np.array([k for *_, k in pairs])
    wide = 4 * most > length  # what differs of lines that are alike at the ends: more edits for its length
    order = np.lexsort((-length, wide))
    falling, k, whole = -length[order], 0, int((~wide).sum())
    while k < len(order):
        words = int(-(-length[order[k]] // 64))
        end = whole if k < whole else len(order)
        own = order[k : min(k + int(np.searchsorted(falling[k:end], falling[k] * 3 // 4, "right")), k + max(1, CELLS // words))]
        k += len(own)
        if len(own) >= FEWEST + words:
            out[own] = _within([pairs[j] for j in own])
            continue
        for j in own.tolist():
            a, b, most = pairs[j]
            out[j] = _apart(a, b) <= most and distance(a, b, most) <= most
    return out


def _within(pairs: list[tuple[str, str, int]]) -> np.ndarray:
    """``within`` of pairs by falling length of the longer."""
    m, n, most = (np.array(x, np.int64) for x in zip(*((len(a), len(b), k) for a, b, k in pairs)))
    longer, shorter = (np.frombuffer("".join(x).encode("utf-32-le", "surrogatepass"), np.uint32) for x in zip(*((a, b) for a, b, _ in pairs)))
    begin_a, begin_b = np.cumsum(m) - m, np.cumsum(n) - n
    number = np.zeros(int(max(longer.max(), shorter.max())) + 1, np.int64)  # 0 stands for all that no shorter line has
    number[shorter] = 1
    known = np.flatnonzero(number)
    number[known] = np.arange(1, len(known) + 1)
    step, words = len(known) + 1, int(-(-n.max() // 64))
    if len(pairs) > 1 and len(pairs) * step * words > TABLE:
        half = len(pairs) // 2
        return np.concatenate([_within(pairs[:half]), _within(pairs[half:])])
    row = np.repeat(np.arange(len(pairs)), n)
    at = np.arange(len(shorter)) - begin_b[row]
    cell = ((at >> 6) * len(pairs) + row) * step + number[shorter]
    same, spread = np.zeros(words * len(pairs) * step, np.uint64), np.argsort((at & 63).astype(np.uint8), kind="stable")
    cuts = np.concatenate([[0], np.cumsum(np.bincount(at & 63, minlength=64))])
    for bit in range(64):  # a cell has a bit of a number once only
        same[cell[spread[cuts[bit] : cuts[bit + 1]]]] |= np.uint64(1 << bit)
    same, of_longer = same.reshape(words, -1), number[longer]
    one, high, full = np.uint64(1), np.uint64(63), ~np.uint64(0)
    base = np.arange(len(pairs)) * step
    plus, minus = np.full((words, len(pairs)), full), np.zeros((words, len(pairs)), np.uint64)
    room = [np.empty(len(pairs), np.uint64) for _ in range(8)]
    last, over = (n - 1) >> 6, np.where(n & 63, full << (n & 63).astype(np.uint64), np.uint64(0))
    up, down, low = int(((most + m - n) // 2).max()), int(((most - m + n) // 2).max()), -1
    ends = np.searchsorted(-m, -np.arange(int(m[0]) + 1))  # so many are longer than that
    score, found = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    live = -1
    for j in range(int(m[0])):
        if live != ends[j]:
            live = int(ends[j])
            equal, vertical, across, fall, *carried = (x[:live] for x in room)
            columns, first = base[:live], begin_a[:live]
        while low < min(words - 1, (j + down) >> 6):
            low += 1
            score += 64
        place = of_longer[first + j]
        place += columns
        rise_in, fall_in = one, None
        for b in range(max(0, (j - up) >> 6), low + 1):
            p, q, rise_out, fall_out = plus[b, :live], minus[b, :live], carried[b & 1], carried[2 + (b & 1)]
            np.take(same[b], place, out=equal, mode="clip")
            np.bitwise_or(equal, q, out=vertical)
            if fall_in is not None:
                equal |= fall_in
            np.bitwise_and(equal, p, out=across)
            across += p
            across ^= p
            across |= equal
            np.bitwise_and(p, across, out=fall)
            across |= p
            np.invert(across, out=across)
            across |= q
            np.right_shift(across, high, out=rise_out)
            np.right_shift(fall, high, out=fall_out)
            across <<= one
            across |= rise_in
            fall <<= one
            if fall_in is not None:
                fall |= fall_in
            np.bitwise_and(across, vertical, out=q)
            vertical |= across
            np.invert(vertical, out=vertical)
            np.bitwise_or(vertical, fall, out=p)
            rise_in, fall_in = rise_out, fall_out
        score[:live] += rise_in.view(np.int64)
        score[:live] -= fall_in.view(np.int64)
        done = slice(int(ends[j + 1]), live)
        if done.start < live:  # back from the lowest cell to that of the shorter line's end
            found[done] = score[done]
            for b in range(int(last[done].min()), low + 1):
                below = np.where(last[done] == b, over[done], np.where(last[done] < b, full, np.uint64(0)))
                found[done] += np.bitwise_count(minus[b, done] & below).astype(np.int64) - np.bitwise_count(plus[b, done] & below)
    return found <= most


def all_alike(pairs: Iterator[tuple[str, str]], similarity: float = SIMILARITY) -> np.ndarray:
    """``alike`` of each pair; most pairs are told together."""
    near = [_near(a, b, similarity) for a, b in pairs]
    out = np.array([x is True for x in near], bool)
    open_ = [k for k, x in enumerate(near) if not isinstance(x, bool)]
    short = [k for k in open_ if len(near[k][1]) <= 64]
    long = [k for k in open_ if len(near[k][1]) > 64]
    left = short
    for k, far in zip(long, far_apart([near[k] for k in long]).tolist()):
        if not far:
            a, b, most = near[k]
            out[k] = _walked(a, b, most) <= most or _anchored(a, b, most) <= most
            left += [] if out[k] else [k]
    out[left] = within([near[k] for k in left])
    return out


def alike(a: str, b: str, similarity: float = SIMILARITY) -> bool:
    return bool(all_alike([(a, b)], similarity)[0])


def _row_key(doc_id, text):
    return F.xxhash64(F.coalesce(doc_id, F.lit(-1)), doc_id.isNull(), F.coalesce(text, F.lit("")))


def _packed(*columns: np.ndarray) -> bytes:
    return b"".join(x.tobytes() for x in columns)


def _unpacked(blobs, kinds: tuple) -> list[np.ndarray]:
    """The columns of packed blobs, one after another."""
    width, parts = sum(np.dtype(k).itemsize for k in kinds), [[np.zeros(0, k)] for k in kinds]
    for blob in blobs:
        blob, at = blob.as_buffer(), 0
        n = blob.size // width
        for part, kind in zip(parts, kinds):
            part.append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(x) for x in parts]


#: Columns of blobs: node, sketch, key, size of a key; node, row_key, number of an occurrence; node and what of it comes first, with the number of its occurrences.
_KEY = (np.int64, np.uint64, np.uint32, np.int16)
_PLACE = (np.int64, np.int64, np.int32)
_NODE = (np.int64, np.bool_, np.int64, np.int64, np.int32, np.int64)
#: Nodes of a blob.
PACKED = 1 << 16
PAIR, KEYED, KEYS, PLACES, NODES = range(5)


def _firsts(node, none, doc, row, number, count) -> list[np.ndarray]:
    """Of each node, by rising node, what comes first by (doc_id, row, number), a null doc_id last, and the sum of counts."""
    order = np.lexsort((number, row, doc, none, node))
    node = node[order]
    heads = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, np.int64)
    sums = np.add.reduceat(count[order], heads) if len(heads) else count[:0]
    return [node[heads], *(x[order[heads]] for x in (none, doc, row, number)), sums]


def _dealt(home: np.ndarray, n_buckets: int, *columns: np.ndarray):
    """(bucket, blob) of columns that are sorted by bucket."""
    cuts = np.searchsorted(home, np.arange(n_buckets + 1, dtype=np.uint64))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        yield k, _packed(*(x[cuts[k] : cuts[k + 1]] for x in columns))


def _scanned(docs: DataFrame, n_buckets: int) -> DataFrame:
    """(bucket, kind, blob) of each batch: its different lines' keys by bucket of the key, and themselves by bucket of the node; all its occurrences of lines, in any bucket."""

    def mapped(batches):
        for batch in batches:
            data, offsets = common.utf8(batch.column("text"))
            none = np.asarray(batch.column("doc_id").is_null())
            ids, rows = batch.column("doc_id").fill_null(0).to_numpy(), batch.column("row_key").to_numpy()
            keyed: list[tuple] = []
            lines: list[tuple] = []
            known = np.zeros(0, np.int64)
            for i, j in common.blocks(offsets):
                doc, number, node, sketch, size, (*_, first, hashed) = lines_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                if not len(node):
                    continue
                own, at = np.unique(node, return_index=True)
                new = np.zeros(len(node), bool)
                new[at[~np.isin(own, known, assume_unique=True)]] = True
                known = np.append(known, node[new])
                line, key = block_keys(hashed, first, new)
                keyed.append((key, node[line], sketch[line], np.minimum(size[line], LONG).astype(np.int16)))
                lines.append((node, doc + i, number.astype(np.int32)))
            if not lines:
                continue
            out: list[tuple] = []
            node, doc, number = (np.concatenate(x) for x in zip(*lines))
            row = rows[doc]
            out.append((int(row[0]) % n_buckets, PLACES, _packed(node, row, number)))
            found = _firsts(node, none[doc], ids[doc], row, number, np.ones(len(node), np.int64))
            home = (common.mix(found[0].view(np.uint64)) >> np.uint64(33)) % np.uint64(n_buckets)
            order = np.argsort(home, kind="stable")
            out += [(k, NODES, blob) for k, blob in _dealt(home[order], n_buckets, *(x[order] for x in found))]
            key, node, sketch, size = (np.concatenate(x) for x in zip(*keyed))
            home = (common.mix(key) >> np.uint64(33)) % np.uint64(n_buckets)
            order = np.argsort(home.astype(np.uint16) if n_buckets <= 1 << 16 else home, kind="stable")
            key, node, sketch, size, home = (x[order] for x in (key, node, sketch, size, home))
            # 32 bits are enough within a bucket; who shares them by chance is not close.
            out += [(k, KEYS, blob) for k, blob in _dealt(home, n_buckets, node, sketch, key.astype(np.uint32), size)]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary()))], ["bucket", "kind", "blob"])

    return docs.mapInArrow(common.tidy(mapped), "bucket int, kind int, blob binary")


def _gathered(bits: tuple[int, int], similarity: float):
    """Reducer of a bucket: pairs and keys as of ``_close``, the different nodes with their first occurrences, and the occurrences as they are."""

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[pa.RecordBatch] = []
        nodes: list[list[np.ndarray]] = []
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            blobs = [batch.column("blob").filter(pa.array(kind == k)) for k in (KEYS, PLACES, NODES)]
            keys.append(pa.RecordBatch.from_arrays(blobs[:1], ["blob"]))
            yield _blobs(PLACES, blobs[1])
            nodes.append(_unpacked(blobs[2], _NODE))
        found = _firsts(*(np.concatenate(x) for x in zip(*nodes)))
        for k in range(0, len(found[0]), PACKED):
            yield _blobs(NODES, pa.array([_packed(*(x[k : k + PACKED] for x in found))], pa.binary()))
        for batch in _close(bits, similarity)(iter(keys)):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(batch.num_rows, pa.binary())], _GATHERED)

    return reduced


def _blobs(kind: int, blobs: pa.Array) -> pa.RecordBatch:
    n = len(blobs)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *(pa.nulls(n, pa.int64()) for _ in range(4)), blobs], _GATHERED)


def _lines(gathered: DataFrame, wanted: common.Marks, several: bool) -> DataFrame:
    """(node, first, rows) of the wanted nodes (and of few others), and of those with several occurrences if asked for."""

    def mapped(batches):
        for batch in batches:
            node, none, doc, row, number, count = _unpacked(batch.column("blob"), _NODE)
            good = wanted(node) | (several & (count > 1))
            arrays = [pa.array(node[good]), pa.array(none[good]), pa.array(doc[good], mask=none[good]), pa.array(row[good]), pa.array(number[good]), pa.array(count[good])]
            yield pa.RecordBatch.from_arrays(arrays, ["node", "none", "doc_id", "row_key", "number", "rows"])

    found = gathered.where(F.col("kind") == NODES).select("blob").mapInArrow(common.tidy(mapped), "node bigint, none boolean, doc_id bigint, row_key bigint, number int, rows bigint")
    return found.select("node", F.struct("none", "doc_id", "row_key", "number").alias("first"), "rows")


def _occurrences(gathered: DataFrame, wanted: common.Marks) -> DataFrame:
    """(row_key, number, node): all occurrences of the wanted nodes (and of few others)."""

    def mapped(batches):
        for batch in batches:
            node, row, number = _unpacked(batch.column("blob"), _PLACE)
            good = wanted(node)
            yield pa.RecordBatch.from_arrays([pa.array(row[good]), pa.array(number[good]), pa.array(node[good])], ["row_key", "number", "node"])

    return gathered.where(F.col("kind") == PLACES).select("blob").mapInArrow(common.tidy(mapped), "row_key bigint, number int, node bigint")


#: A prime that spreads the numbers of a row's lines over a bitmap.
_SPREAD = 40503


def _texts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(node, found): the normal forms of nodes (distinct), each made again from one of its places (node, row_key, number)."""
    at = (F.shiftrightunsigned("row_key", 38) + F.col("number") * F.lit(_SPREAD).cast("bigint")).bitwiseAND(F.lit(common.REDUCER_BITS - 1))
    wanted = common.Marks(places.select(F.shiftleft(at, 38).alias("node")))

    def mapped(batches):
        for batch in batches:
            data, offsets = common.utf8(batch.column("text"))
            rows = batch.column("row_key").to_numpy().view(np.uint64) >> np.uint64(38)
            seen = {}
            for i, j in common.blocks(offsets):
                own = data[offsets[i] : offsets[j]]
                begins, doc, number = begins_of(own, offsets[i : j + 1] - offsets[i])
                if not len(begins):
                    continue
                good = np.flatnonzero(wanted((rows[doc + i] + number.astype(np.uint64) * np.uint64(_SPREAD)) % np.uint64(common.REDUCER_BITS) << np.uint64(38)))
                if not len(good):
                    continue
                spans = np.append(begins, len(own))
                size = np.diff(spans)[good]
                ends = np.cumsum(size)
                part = own[np.arange(ends[-1]) + np.repeat(begins[good] - ends + size, size)]
                *_, node, _, _, (low, starts, stops, first, _) = lines_of(part, np.append(0, ends), sketched=False)
                low, cuts = low.tobytes(), np.append(first, len(starts)).tolist()
                starts, stops = starts.tolist(), stops.tolist()
                for key, a, b in zip(node.tolist(), cuts, cuts[1:]):
                    if key not in seen:
                        seen[key] = b" ".join([low[s:e] for s, e in zip(starts[a:b], stops[a:b])])
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.binary())], ["node", "found"])

    made = docs.select("row_key", "text").mapInArrow(common.tidy(mapped), "node bigint, found binary")
    return made.join(places.select("node"), "node", "left_semi").groupBy("node").agg(F.first("found").alias("found"))


_GATHERED = ["kind", "a", "b", "sketch", "size", "blob"]
_FOUND = "kind int, a bigint, b bigint, sketch bigint, size bigint, blob binary"


def _partners(key, node, sketch, size, group, bits: tuple[int, int], similarity: float, all_pairs: bool):
    """Pairs of lines (places in the columns, which are sorted by key) with one key, in different groups, whose SimHashes are close and whose lengths allow the similarity; without ``all_pairs`` only those of which either line has had no partner at the key. And which lines have one."""
    lone, held, n = np.ones(len(node), bool), [], 0
    live, step = np.arange(len(node)), 1
    while len(live):
        live = live[live + step < len(node)]
        live = live[key[live] == key[live + step]]
        other = live + step
        longer = np.maximum(size[live], size[other])
        good = (np.bitwise_count(sketch[live] ^ sketch[other]) <= np.where(longer < SHORT, *bits)) & (group[live] != group[other])
        good &= (np.abs(size[live] - size[other]) <= _most(longer, similarity)) | (longer >= LONG)
        if not all_pairs:
            good &= lone[live] | lone[other]
        i, j = live[good], other[good]
        lone[i] = lone[j] = False
        held.append((i, j))
        n += len(i)
        step += 1
        if n >= HELD:
            yield *map(np.concatenate, zip(*held)), None
            held, n = [], 0
    none = np.zeros(0, np.int64)
    yield *(map(np.concatenate, zip(*held)) if held else (none, none)), np.flatnonzero(~lone)


def _rows(kind: int, a, b, sketch, size) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), *(pa.array(x.astype(np.int64), pa.int64()) for x in (a, b, sketch, size))], ["kind", "a", "b", "sketch", "size"])


def _close(bits: tuple[int, int], similarity: float):
    """Reducer of a bucket of keys: a partner for every line that has one, as (a, b), and the keys of these lines, as (node, key, sketch, size)."""

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sketch, key, size = _unpacked((blob for batch in batches for blob in batch.column("blob")), _KEY)
        order = np.argsort(key, kind="stable")
        shared = key[order][1:] == key[order][:-1]
        order = order[np.r_[shared, False] | np.r_[False, shared]]
        order = order[np.lexsort((node[order], key[order]))]
        key, node = key[order], node[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])] if len(order) else np.zeros(0, bool)
        key, node, sketch, size = key[new], node[new], sketch[order][new], size[order][new].astype(np.int64)
        for i, j, met in _partners(key, node, sketch, size, node, bits, similarity, False):
            yield _rows(PAIR, np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), i, i)
            if met is not None:
                yield _rows(KEYED, node[met], key[met].astype(np.int64), sketch[met].view(np.int64), size[met])

    return reduced


def _close_again(bits: tuple[int, int], similarity: float):
    """Reducer of a bucket of keys: all pairs of lines of different groups."""

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(batches)
        node, key, sketch, size, group = (whole[c].to_numpy() for c in ("node", "key", "sketch", "size", "group"))
        order = np.lexsort((node, key))
        key, node, sketch, size, group = (x[order] for x in (key, node, sketch.view(np.uint64), size, group))
        for i, j, _ in _partners(key, node, sketch, size, group, bits, similarity, True):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], ["a", "b"])

    return reduced


def _verify(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    def mapped(batches):
        for batch in batches:
            keep = pa.array(all_alike(((x.decode(), y.decode()) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())), similarity))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    joined = pairs.join(texts.select(F.col("node").alias("a"), F.col("found").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("found").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(common.tidy(mapped), "a bigint, b bigint")


def removed(docs: DataFrame, bits: tuple[int, int] = BITS, similarity: float = SIMILARITY) -> DataFrame:
    """(row_key, numbers): the numbers of the lines to remove from each row that loses any."""
    docs = common.own_columns(docs, "doc_id", "text").withColumn("row_key", _row_key(F.col("doc_id"), F.col("text")))
    n_buckets = common.buckets(docs)
    close = common.checkpoint(_scanned(docs, n_buckets).groupBy("bucket").applyInArrow(common.tidy(_gathered(bits, similarity)), _FOUND))
    one = common.checkpoint(close.where(F.col("kind") == PAIR).select("a", "b").distinct())
    ends = common.checkpoint(one.select(F.col("a").alias("node")).unionByName(one.select(F.col("b").alias("node"))).distinct())  # a line with any partner has one in ``one``
    places = common.checkpoint(_lines(close, common.Marks(ends), False).join(ends, "node", "left_semi").select("node", "first.row_key", "first.number"))
    texts = common.checkpoint(_texts(docs, places))
    # Of a line's partners the least and the greatest first; whom these leave in other groups comes next.
    first = common.checkpoint(one.groupBy("b").agg(F.min("a").alias("x"), F.max("a").alias("y")).select(F.explode(F.array_distinct(F.array("x", "y"))).alias("a"), "b"))
    links = common.checkpoint(_verify(first, texts, similarity))
    group = components(links)
    again = close.where(F.col("kind") == KEYED).select(F.col("a").alias("node"), F.col("b").alias("key"), "sketch", "size").join(group, "node", "left")
    again = again.withColumn("group", F.coalesce("component", "node")).drop("component").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(n_buckets)))
    rest = again.groupBy("bucket").applyInArrow(common.tidy(_close_again(bits, similarity)), "a bigint, b bigint").distinct().join(first, ["a", "b"], "left_anti")
    more = common.checkpoint(_verify(rest, texts, similarity))
    if not more.isEmpty():
        group = components(links.unionByName(more))
    # Lines of one occurrence without a link lose nothing, and are left out.
    members = group.select("node").unionByName(group.select(F.col("component").alias("node"))).distinct()
    lines = common.checkpoint(_lines(close, common.Marks(members), True))
    grouped = lines.join(group, "node", "left").select("node", "rows", "first", F.coalesce("component", "node").alias("group"))
    least = common.checkpoint(grouped.groupBy("group").agg(F.min("first").alias("kept"), F.count("*").alias("nodes"), F.sum("rows").alias("of_group")).where("of_group > 1"))
    known = common.join_known(grouped, least, "group", "nodes").select("node", "rows", F.col("kept.row_key").alias("kept_row"), F.col("kept.number").alias("kept_number"))
    known = common.checkpoint(known)  # lines of groups with several occurrences
    several = _occurrences(close, common.Marks(known.select("node")))
    placed = common.join_known(several, known, "node", "rows")
    gone = placed.where((F.col("row_key") != F.col("kept_row")) | (F.col("number") != F.col("kept_number")))
    return gone.groupBy("row_key").agg(F.sort_array(F.collect_set("number")).alias("numbers"))


def drop_lines(docs: DataFrame, bits: tuple[int, int] = BITS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with all their columns and texts without the removed lines, and ``n_lines`` and ``n_removed``."""
    gone = removed(docs, bits, similarity).select("row_key", F.col("numbers").alias("lost"))
    keyed, text = common.plain(docs), F.col(common.place(docs, "text"))
    joined = keyed.withColumn("row_key", _row_key(F.col(common.place(docs, "doc_id")).cast("bigint"), text)).join(gone, "row_key", "left").withColumn("own", F.split(text, "\n", -1))
    kept = F.array_join(F.filter("own", lambda x, i: ~F.array_contains("lost", i)), "\n")
    counts = {"n_lines": F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.size("own")).cast("long"), "n_removed": F.greatest(F.coalesce(F.size("lost"), F.lit(0)), F.lit(0)).cast("long")}
    names = [(c, k) for c, k in zip(docs.columns, keyed.columns) if c.lower() not in counts]
    cut = F.when(F.col("lost").isNull(), text).otherwise(kept)
    return joined.select(*((cut if k == common.place(docs, "text") else F.col(k)).alias(k) for _, k in names), *counts.values()).toDF(*(c for c, _ in names), *counts)


def op9_fuzzy_lines(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return drop_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
