"""SentencePiece encoding and decoding by batched numpy Viterbi.

Texts are cut into units that no piece crosses: spaces with the word behind them, and newlines.
Distinct units of equal length in bytes advance together: the hashes of all their substrings of one
length probe the sorted keys of the pieces at once, those that begin no longer piece stop there, and at
each position the best arc and its score are kept with a backpointer.

For a unigram model an arc adds its piece's score and the maximum is the encoding. A BPE model's
encoding is not that maximum: it is what merging by rank gives. There an arc is admitted only if
merging would leave its piece beside the piece that ends where the arc begins, which the pieces'
last merges decide without running any; exactly one arc of each position is then left on the
path, and the path is the merged encoding. Units of more than ``LONGEST`` bytes, as of scripts without spaces, are too few of a
length to advance together: each advances alone, with the substrings of ``STRIDE`` positions probed at
once. Units with several spaces in a row are merged one by one, as those pieces share one score and the rule about
last merges does not hold for ties.

Texts are not normalised but for a leading space, as the model says; a text with U+2581 in it
encodes as if that were a space, so decoding it gives a space. Characters without a piece become byte pieces.
Null and empty texts have no pieces and decode to an empty text. Among equal scores the arc with the
longest piece wins, which in BPE never decides. Rows that repeat are answered each; an empty table gives no rows; other
columns, whatever their names, are ignored. A text is encoded as a whole, a very long one in a block of its own.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Units of more bytes advance one by one, so many positions probed at once.
LONGEST, STRIDE = 64, 1 << 14
#: Distinct units whose encodings a worker keeps.
CACHED = 1_000_000
#: Bytes of text whose units are made distinct together.
BLOCK = 1 << 20
#: Bytes of an Arrow batch; less than other operators take, as workers hold the vocabulary and the known units too.
BATCH_BYTES = "4m"
#: Units that advance together.
TOGETHER = 20_000
UNIGRAM, BPE = 1, 2
_FILTER_BITS, _MEMO_BITS = 21, 20
#: What a substring may be: a piece, the beginning of a longer one.
PIECE, BEGIN = np.uint8(1), np.uint8(2)


class Codec:
    def __init__(self, path: str = MODEL):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        self.kind = proto.trainer_spec.model_type
        norm = proto.normalizer_spec
        if self.kind not in (UNIGRAM, BPE) or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only unigram and BPE models without a normalisation table are supported")
        self.lead = b" " if norm.add_dummy_prefix else b""
        self.bytes_of: list[bytes] = []
        self.byte_id = np.full(256, -1, np.int32)
        self.unknown = 0
        score, normal = [], []
        for i, p in enumerate(proto.pieces):
            is_byte = p.type == p.BYTE
            if is_byte:
                self.byte_id[int(p.piece[3:5], 16)] = i
            if p.type == p.UNKNOWN:
                self.unknown = i
            self.bytes_of.append(bytes([int(p.piece[3:5], 16)]) if is_byte else p.piece.replace(SPACE, " ").encode() if p.type in (p.NORMAL, p.USER_DEFINED) else b"")
            score.append(p.score)
            normal.append(p.type in (p.NORMAL, p.USER_DEFINED))
            if normal[-1] and SPACE in p.piece.lstrip(SPACE):
                raise ValueError("pieces that cross words are not supported")
        self.score = np.array(score)
        self.id_of = {b: i for i, (b, ok) in enumerate(zip(self.bytes_of, normal)) if ok}
        ids = np.array(sorted(self.id_of.values()), np.int32)
        self.raw = np.zeros(len(self.bytes_of), np.uint64)
        self.size = np.array([len(b) for b in self.bytes_of], np.int64)
        for i in ids.tolist():
            self.raw[i] = common.prefix_hash(np.frombuffer(self.bytes_of[i], np.uint8))[-1]
        keys = self._key(self.raw[ids], self.size[ids])
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]
        self.maybe = np.zeros(1 << _FILTER_BITS, np.uint8)
        self.maybe[self._cell(self.keys)] = PIECE
        for i in ids.tolist():
            sums = common.prefix_hash(np.frombuffer(self.bytes_of[i], np.uint8))[1:-1]
            self.maybe[self._cell(self._key(sums, np.arange(1, len(sums) + 1)))] |= BEGIN
        self.longest = int(self.size[ids].max())
        single = np.array([len(b.decode()) == 1 if ok else True for b, ok in zip(self.bytes_of, normal)])
        # Merge order: characters first, then pieces by falling score.
        self.rank = np.zeros(len(score), np.int64)
        merged = [i for i in ids.tolist() if not single[i]]
        for k, i in enumerate(sorted(merged, key=lambda i: (-score[i], i))):
            self.rank[i] = k + 1
        self.left = np.arange(len(score), dtype=np.int32)
        self.right = np.arange(len(score), dtype=np.int32)
        self.whole = np.ones(len(score), bool)  # merging the piece's text gives the piece
        if self.kind == BPE:
            for i in merged:
                parts = self.merge(self.bytes_of[i], stop=i)
                if len(parts) == 2:
                    self.left[i], self.right[i] = parts
                else:
                    self.whole[i] = False
        joined = [np.frombuffer(b, np.uint8) for b in self.bytes_of]
        self.flat = np.concatenate(joined)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.memo_key = np.full(1 << _MEMO_BITS, -1, np.int64)
        self.memo = np.zeros(1 << _MEMO_BITS, bool)
        self._forget()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith(("memo", "seen", "store", "alone"))}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.memo_key = np.full(1 << _MEMO_BITS, -1, np.int64)
        self.memo = np.zeros(1 << _MEMO_BITS, bool)
        self._forget()

    def _forget(self) -> None:
        self.alone: dict[int, bool] = {}
        self.seen = np.zeros(0, np.uint64)
        self.seen_at = np.zeros(0, np.int32)
        self.seen_n = np.zeros(0, np.int32)
        self.store = np.zeros(0, np.int32)

    @staticmethod
    def _key(raw: np.ndarray, size) -> np.ndarray:
        return common.mix(raw + np.asarray(size).astype(np.uint64))

    @staticmethod
    def _cell(keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - _FILTER_BITS)).view(np.int64)

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """The piece of each substring key, or -1."""
        out = np.full(len(keys), -1, np.int32)
        at = np.flatnonzero(self.maybe[self._cell(keys)] & PIECE)
        if len(at):
            place = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
            same = self.keys[place] == keys[at]
            out[at[same]] = self.ids[place[same]]
        return out

    def merge(self, text: bytes, stop: int = -1) -> list[int]:
        """Merging by rank, the leftmost of equals first; with ``stop``, the parts before the merge that makes that piece."""
        symbols = [c.encode() for c in text.decode()]
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list = []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < n:
                found = self.id_of.get(symbols[i] + symbols[j])
                if found is not None:
                    heapq.heappush(heap, (-self.score[found], i, j, symbols[i], symbols[j], found))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, x, y, found = heapq.heappop(heap)
            if symbols[i] != x or after[i] != j or symbols[j] != y:
                continue
            if found == stop and before[i] < 0 and after[j] >= n:
                return [self.id_of.get(x, self.unknown), self.id_of.get(y, self.unknown)]
            symbols[i], symbols[j] = x + y, b""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        out: list[int] = []
        i = 0
        while i < n:
            found = self.id_of.get(symbols[i])
            out += [found] if found is not None else self.byte_id[list(symbols[i])].tolist()
            i = after[i]
        return out

    def _stay(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether merging the text of two pieces leaves those two; negative numbers never merge."""
        out = np.ones(len(first), bool)
        live = np.flatnonzero((first >= 0) & (second >= 0))
        a, b = first[live].astype(np.int64), second[live].astype(np.int64)
        limit = np.full(len(live), 1 << 40)
        base = common.powers(self.longest * 2 + 2)[0]
        while len(live):
            both = self.probe(self._key(self.raw[a] + self.raw[b] * base[self.size[a]], self.size[a] + self.size[b]))
            broken = (both >= 0) & (self.rank[both] < limit)
            out[live[broken]] = False
            # Undo the later of the two pieces' last merges; the part at the seam is what the other piece then stood beside.
            ra, rb = self.rank[a], self.rank[b]
            of_a = ra > rb
            done = ~of_a & (rb == 0)
            limit = np.where(of_a, ra, rb + 1)
            a, b = np.where(of_a, self.right[a], a), np.where(of_a, b, self.left[b])
            go = ~broken & ~done
            live, a, b, limit = live[go], a[go], b[go], limit[go]
        return out

    def stay(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        key = first.astype(np.int64) * len(self.size) + second
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _MEMO_BITS)).astype(np.int64)
        new = np.flatnonzero(self.memo_key[slot] != key)
        out = self.memo[slot]
        if len(new):
            keys, back = np.unique(key[new], return_inverse=True)
            found = self._stay(keys // len(self.size), keys % len(self.size))
            out[new] = found[back]
            slots = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _MEMO_BITS)).astype(np.int64)
            _, last = np.unique(slots, return_index=True)  # one key a slot
            self.memo_key[slots[last]], self.memo[slots[last]] = keys[last], found[last]
        return out

    def _arcs(self, units: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Arcs of all units, as (place of the start, of the end, piece or -1 for a character without one), by end and the longer first; a place is position * len(units) + unit.

        All substrings of one length are probed at once, only those that begin as a longer piece does go on to the next length.
        """
        n, length = units.shape
        base, back_base = common.powers(length + 1)
        sums = np.zeros((length + 1, n), np.uint64)
        np.cumsum((common._BYTE[units] * base[:length]).T, axis=0, out=sums[1:])
        sums = sums.reshape(-1)
        live = np.flatnonzero(begins[:length])
        after = np.where(begins, np.arange(length + 1)[:, None], length)
        after = np.minimum.accumulate(after[::-1], axis=0)[::-1][1:].reshape(-1)  # where the next character begins
        alone = begins[:length].reshape(-1).copy()
        starts, stops, pieces = [], [], []
        for size in range(1, min(self.longest, length) + 1):
            live = live[: np.searchsorted(live, (length - size + 1) * n)]
            if not len(live):
                break
            place = live // n
            key = self._key((sums[live + size * n] - sums[live]) * back_base[place], np.full(1, size))
            maybe = self.maybe[self._cell(key)]
            at = np.flatnonzero(maybe & PIECE)
            slot = np.minimum(np.searchsorted(self.keys, key[at]), len(self.keys) - 1)
            same = self.keys[slot] == key[at]
            at, piece = at[same], self.ids[slot[same]]
            single = live[at[after[live[at]] == place[at] + size]]
            alone[single] = False
            if self.kind == BPE:
                at, piece = at[self.whole[piece]], piece[self.whole[piece]]
            starts.append(live[at])
            stops.append(live[at] + size * n)
            pieces.append(piece)
            live = live[(maybe & BEGIN) > 0]
        alone = np.flatnonzero(alone)
        starts.append(alone)
        stops.append(after[alone] * n + alone % n)
        pieces.append(np.full(len(alone), -1, np.int32))
        start, stop, piece = (np.concatenate(x) for x in (starts, stops, pieces))
        order = np.lexsort((start, stop))
        return start[order], stop[order], piece[order]

    def viterbi(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodings of units of one length, a row of bytes each: all piece numbers, and how many each unit has."""
        n, length = units.shape
        begins = np.ones((length + 1, n), bool)  # of characters
        begins[:length] = ((units & 0xC0) != 0x80).T
        last = np.full((length + 1, n), -2, np.int32)  # -2: not reached, -1: nothing that merges ends here
        last[0] = -1
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        origin = np.zeros((length + 1, n), np.int16)
        start, stop, piece = self._arcs(units, begins)
        value = np.where(piece >= 0, self.score[piece], float(self.score[self.ids].min()) - 10 if self.kind == UNIGRAM else -1e12)
        cuts = np.searchsorted(stop, np.arange(length + 2) * n)
        flat_last, flat_best, flat_origin = last.reshape(-1), best.reshape(-1), origin.reshape(-1)
        for i in range(1, length + 1):
            own = slice(cuts[i], cuts[i + 1])
            before = flat_last[start[own]]
            good = before > -2
            if self.kind == BPE:
                test = np.flatnonzero((before >= 0) & (piece[own] >= 0))
                good[test] = self.stay(before[test], piece[own][test])
            at, to, p = start[own][good], stop[own][good], piece[own][good]
            total = flat_best[at] + value[own][good]
            np.maximum.at(flat_best, to, total)
            won = np.flatnonzero(total == flat_best[to])[::-1]  # of equals the longest is written last
            flat_last[to[won]], flat_origin[to[won]] = p[won], at[won] // n
        # Walk back from the ends; each step is one arc of every unit that is not at its start yet.
        place, live, steps = np.full(n, length), np.arange(n), []
        while len(live):
            stop = place[live]
            start = origin[stop, live].astype(np.int64)
            steps.append((live, last[stop, live], start, stop))
            place[live] = start
            live = live[start > 0]
        unit, piece, start, stop = (np.concatenate(x) for x in zip(*reversed(steps)))
        order = np.argsort(unit, kind="stable")
        unit, piece, start, stop = unit[order], piece[order], start[order], stop[order]
        if (piece < 0).any():  # characters as bytes
            size = np.where(piece < 0, stop - start, 1)
            ends = np.cumsum(size)
            inner = np.arange(ends[-1]) - np.repeat(ends - size, size)
            unit, first = np.repeat(unit, size), np.repeat(start, size)
            piece = np.repeat(piece, size)
            piece = np.where(piece < 0, self.byte_id[units[unit, np.minimum(first + inner, length - 1)]], piece)
        return piece.astype(np.int32), np.bincount(unit, minlength=n)

    def _stays(self, first: int, second: int) -> bool:
        """``_stay`` of one pair."""
        key = first * len(self.size) + second
        found = self.alone.get(key)
        if found is None:
            a, b, limit, found = first, second, 1 << 40, True
            while True:
                both = self.id_of.get(self.bytes_of[a] + self.bytes_of[b])
                if both is not None and self.rank[both] < limit:
                    found = False
                    break
                ra, rb = int(self.rank[a]), int(self.rank[b])
                if ra > rb:
                    a, limit = int(self.right[a]), ra
                elif rb:
                    b, limit = int(self.left[b]), rb + 1
                else:
                    break
            if len(self.alone) >= CACHED:
                self.alone.clear()
            self.alone[key] = found
        return found

    def viterbi_alone(self, unit: np.ndarray) -> np.ndarray:
        """The encoding of one unit: from each position that is reached, in order, the arcs to later ones."""
        n = len(unit)
        back = common.powers(n + 1)[1]
        sums = common.prefix_hash(unit)
        begins = np.append((unit & 0xC0) != 0x80, True)
        starts = np.flatnonzero(begins[:-1])
        after = np.append(starts[1:], n)  # the end of each character
        last, origin, best = array("i", [-2]) * (n + 1), array("q", [0]) * (n + 1), array("d", [-np.inf]) * (n + 1)
        last[0], best[0] = -1, 0.0
        lowest = float(self.score[self.ids].min()) - 10 if self.kind == UNIGRAM else -1e12
        for k in range(0, len(starts), STRIDE):
            own, ends = starts[k : k + STRIDE], after[k : k + STRIDE]
            arcs = []
            for size in range(1, self.longest + 1):
                at = own[own + size <= n]
                at = at[begins[at + size]]
                piece = self.probe(self._key((sums[at + size] - sums[at]) * back[at], np.full(1, size)))
                hit = piece >= 0
                arcs.append((at[hit], at[hit] + size, piece[hit]))
            at, to, piece = (np.concatenate(x) for x in zip(*arcs))
            alone = np.ones(len(own), bool)
            alone[np.searchsorted(own, at[to == ends[np.searchsorted(own, at)]])] = False  # characters that are a piece
            at, to, piece = (np.concatenate(x) for x in ((at, own[alone]), (to, ends[alone]), (piece, np.full(int(alone.sum()), -1))))
            order = np.lexsort((-to, at))
            value = np.where(piece[order] >= 0, self.score[piece[order]], lowest)
            fit = (piece[order] < 0) | self.whole[piece[order]] if self.kind == BPE else np.ones(len(order), bool)
            for j, i, p, v, ok in zip(at[order].tolist(), to[order].tolist(), piece[order].tolist(), value.tolist(), fit.tolist()):
                before = last[j]
                if before == -2 or not ok or best[j] + v <= best[i]:
                    continue
                if self.kind == BPE and before >= 0 and p >= 0 and not self._stays(before, p):
                    continue
                best[i], last[i], origin[i] = best[j] + v, p, j
        out, i = [], n
        while i:
            j = origin[i]
            out.append([last[i]] if last[i] >= 0 else self.byte_id[unit[j:i]].tolist())
            i = j
        return np.array([p for part in reversed(out) for p in part], np.int32)

    def _learn(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encode units that were not seen before."""
        if len(self.seen) + len(keys) > CACHED:
            self._forget()
        length = ends - starts
        sizes, at, parts, end = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), [self.store], len(self.store)
        tied = np.zeros(len(keys), bool)  # several spaces in a row
        if self.kind == BPE:
            tied = (data[np.minimum(starts + 1, len(data) - 1)] == 32) & (length > 1) & (data[starts] == 32)
        plain = (length <= LONGEST) & ~tied
        groups: list = []
        for n in np.unique(length[plain]).tolist():
            same = np.flatnonzero(plain & (length == n))
            groups += np.array_split(same, -(-len(same) // TOGETHER))
        for part in [*groups, *np.flatnonzero(~plain)[:, None]]:
            rows = data[starts[part][:, None] + np.arange(length[part[0]])]
            if plain[part[0]]:
                ids, n = self.viterbi(rows)
            else:
                ids = np.array(self.merge(rows.tobytes()), np.int32) if tied[part[0]] else self.viterbi_alone(rows[0])
                n = np.array([len(ids)])
            parts.append(ids)
            sizes[part], at[part] = n, end + np.cumsum(n) - n
            end += len(ids)
        self.store = np.concatenate(parts)
        whole, whole_at, whole_n = (np.concatenate(x) for x in ((self.seen, keys), (self.seen_at, at.astype(np.int32)), (self.seen_n, sizes.astype(np.int32))))
        order = np.argsort(whole)
        self.seen, self.seen_at, self.seen_n = whole[order], whole_at[order], whole_n[order]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of all texts, and len + 1 offsets into them."""
        texts = [self.lead + t.replace(SPACE.encode(), b" ") if t else b"" for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        if not len(data):
            return np.zeros(0, np.int32), offsets
        space, line = data == 32, data == 10
        begins = line.copy()
        begins[1:] |= line[:-1] | (space[1:] & ~space[:-1])
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        keys = common.word_hash(data, starts, ends)
        units, first, back = np.unique(keys, return_index=True, return_inverse=True)
        missing = np.ones(len(units), bool)
        if len(self.seen):
            missing = self.seen[np.minimum(np.searchsorted(self.seen, units), len(self.seen) - 1)] != units
        if missing.any():
            if len(self.seen) + int(missing.sum()) > CACHED:
                missing[:] = True  # the cache starts anew
            self._learn(data, units[missing], starts[first[missing]], ends[first[missing]])
        place = np.searchsorted(self.seen, units)
        n, at = self.seen_n[place][back].astype(np.int64), self.seen_at[place][back].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(n)])
        out = self.store[np.arange(total[-1]) + np.repeat(at - total[:-1], n)]
        return out, total[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, and len + 1 offsets into them."""
        n = self.size[ids]
        total = np.concatenate([[0], np.cumsum(n)])
        data = self.flat[np.arange(total[-1]) + np.repeat(self.at[ids] - total[:-1], n)]
        ends = total[offsets]
        if self.lead:
            begin = ends[:-1][(ends[1:] > ends[:-1])]
            begin = begin[data[begin] == 32]
            keep = np.ones(len(data), bool)
            keep[begin] = False
            gone = np.concatenate([[0], np.cumsum(~keep)])
            data, ends = data[keep], ends - gone[ends]
        return data, ends


def encode_column(codec: Codec, column: pa.Array):
    """Of each block of texts: piece numbers, offsets, and whether decoding gives each text back."""
    data, offsets = common.utf8(column)
    for i, j in common.blocks(offsets, BLOCK):
        texts = [data[a:b].tobytes() for a, b in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist())]
        ids, ends = codec.encode(texts)
        back, back_ends = codec.decode(ids, ends)
        raw = back.tobytes()
        yield ids, ends, [raw[a:b] == t for t, a, b in zip(texts, back_ends.tolist(), back_ends[1:].tolist())]


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, round_trip, token_ids) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(Codec(path))  # a vocabulary

    def mapped(batches):
        for batch in batches:
            k = 0
            for ids, ends, same in encode_column(sent.value, batch.column("text")):
                rows = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(k, len(same)), pa.array(np.diff(ends), pa.int64()), pa.array(same), rows], ["doc_id", "n_tokens", "round_trip", "token_ids"])
                k += len(same)

    return common.own_columns(docs, "doc_id", "text", batch=BATCH_BYTES).mapInArrow(common.tidy(mapped), "doc_id bigint, n_tokens bigint, round_trip boolean, token_ids array<int>")


def decode(tokens: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, token_ids)."""
    sent = tokens.sparkSession.sparkContext.broadcast(Codec(path))

    def mapped(batches):
        for batch in batches:
            column = batch.column("token_ids").fill_null([])
            ids, offsets = np.asarray(column.flatten()), np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths()))])
            data, ends = sent.value.decode(ids, offsets)
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([raw[a:b].decode(errors="replace") for a, b in zip(ends.tolist(), ends[1:].tolist())], pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "token_ids").mapInArrow(common.tidy(mapped), "doc_id bigint, text string")


def op10_piece_codec(spark, sf_dir: str) -> DataFrame:
    """ids_sha256: of the piece numbers as little-endian 32-bit integers."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sent = spark.sparkContext.broadcast(Codec(MODEL))

    def mapped(batches):
        for batch in batches:
            k = 0
            for ids, ends, same in encode_column(sent.value, batch.column("text")):
                raw = ids.astype("<i4").tobytes()
                digests = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(ends.tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(k, len(same)), pa.array(np.diff(ends), pa.int64()), pa.array(digests), pa.array(same)], ["doc_id", "n_tokens", "ids_sha256", "round_trip"])
                k += len(same)

    return common.own_columns(docs, "doc_id", "text", batch=BATCH_BYTES).mapInArrow(common.tidy(mapped), "doc_id bigint, n_tokens bigint, ids_sha256 string, round_trip boolean")
