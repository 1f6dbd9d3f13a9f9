"""Secret scan: fixed patterns, and a battery of randomness tests over unnamed tokens.

Patterns (assign, access, hex) are matched leftmost, without overlaps, over the whole text; their
spans always stay. The battery adds spans of kind ``random``: runs of 20 or more encoding
characters that hold digits and letters, whose encoding (hexadecimal, base32, base64) is inferred
from the characters they use. Each run takes three tests of the hypothesis that its symbols are
drawn evenly and independently: chi-squared uniformity over the encoding's alphabet, the number
of runs above and below its middle, and the correlation of neighbouring symbols. Three times the
least of their p-values, 1 at most, is the token's score: near 0 for words and counters.

False discoveries are held by length: runs of letters alone, which are words, take the battery
too, as decoys, read as base 36 numerals. In each length class, with the decoys of that length or less, the tokens at or above a score are accepted if, were all
tokens like the decoys, at most ``rate`` of the accepted would be false. Counts of tokens and
decoys by length and score cover the whole table. Where a class has fewer than ``SIMULATED`` decoys,
as many simulated ones join them: letters drawn by their shares in English, of the class's least
length, so a table without long words accepts random tokens too.

Null counts as empty and has no spans. Offsets are code points, ends exclusive. Spans that begin at one place
are in the order of their kinds. Rows that repeat are answered each, and each counts in the statistics. A very long text is
scanned as a whole. An empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX, MIN_TOKEN = 6, 20, 24, 20
KINDS = ("assign", "access", "hex", "random")
_HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEX = common.byte_class(b"0123456789abcdef")
_TOKEN = common.byte_class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
_DIGIT, _LETTERS = common.byte_class(b"0123456789"), common.byte_class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
#: Shares of false spans that are accepted among the added ones.
RATE = 0.05
SCORE_BINS = 20
SIMULATED = 2000
#: Uses of the letters a to z in 10,000 of English text.
_LETTER_USE = np.array([817, 149, 278, 425, 1270, 223, 202, 609, 697, 15, 77, 403, 241, 675, 751, 193, 10, 599, 633, 906, 276, 98, 236, 15, 197, 7])
#: Length classes begin at these lengths.
LENGTHS = np.array([20, 24, 32, 40, 56, 80, 128])

#: Each encoding's symbols in the order of their values.
ALPHABETS = {
    "hex": b"0123456789abcdef",
    "HEX": b"0123456789ABCDEF",
    "base32": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "letters36": b"0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_VALUE = {}
for _name, _symbols in ALPHABETS.items():
    _VALUE[_name] = np.full(256, -1, np.int16)
    _VALUE[_name][list(_symbols)] = np.arange(len(_symbols))


def infer(token: bytes) -> str | None:
    """The smallest alphabet that holds all symbols of a token."""
    raw = np.frombuffer(token, np.uint8)
    return next((k for k, values in _VALUE.items() if (values[raw] >= 0).all()), None)


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(symbols: np.ndarray, size: int) -> float:
    """Three times the least p-value, at most 1, of the three tests on symbol values 0 .. size - 1."""
    n = len(symbols)
    if n < 2:
        return 0.0
    chi = float((np.bincount(symbols, minlength=size).astype(float) ** 2).sum()) * size / n - n
    free = size - 1
    # Chi-squared by the cube-root normal approximation, with the variance that so short a sample has.
    spread = 2 / (9 * free) * (1 - 1 / n)
    uniform = _tail(((max(chi, 0) / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(spread))
    high = symbols * 2 >= size
    a = int(high.sum())
    b = n - a
    if not a or not b:
        return 0.0
    mean = 2 * a * b / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    runs = 2 * _tail(abs(float((high[1:] != high[:-1]).sum() + 1) - mean) / math.sqrt(var)) if var > 0 else 0.0
    centred = symbols - symbols.mean()
    total = float((centred**2).sum())
    serial = 2 * _tail(abs(float((centred[1:] * centred[:-1]).sum()) / total + 1 / n) * math.sqrt(n)) if total else 0.0
    return min(1.0, 3 * min(uniform, runs, serial))


def _points(raw: np.ndarray) -> np.ndarray:
    """How many code points begin before each byte."""
    out = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=out[1:])
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns in one text."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= MIN_ASSIGN]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= MIN_HEX]
    return sorted(out)


def scan(data: np.ndarray, offsets: np.ndarray):
    """Of each document: its base spans, its other tokens as (start, end, score), and its decoys as (length, score)."""
    for i, j in common.blocks(offsets):
        raw, ends_at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        low = common.LOWER[raw].tobytes()
        starts, ends, _ = common.words(raw, ends_at, _HEX)
        long = ends - starts >= MIN_HEX
        hexes = list(zip(starts[long].tolist(), ends[long].tolist()))
        starts, ends, _ = common.words(raw, ends_at, _TOKEN)
        long = ends - starts >= MIN_TOKEN
        tokens = list(zip(starts[long].tolist(), ends[long].tolist()))
        h = t = 0
        for a, b in zip(ends_at.tolist(), ends_at[1:].tolist()):
            own = raw[a:b]
            base, more, decoys = [], [], []
            points = None
            if any(low.find(w, a, b) >= 0 for w in _HINTS):
                text = own.tobytes().decode()
                base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= MIN_ASSIGN]
            if low.find(b"akia", a, b) >= 0:
                text = own.tobytes().decode()
                base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
            while h < len(hexes) and hexes[h][1] <= b:
                points = _points(own) if points is None else points
                base.append((int(points[hexes[h][0] - a]), 2, int(points[hexes[h][1] - a])))
                h += 1
            while t < len(tokens) and tokens[t][1] <= b:
                s, e = tokens[t]
                t += 1
                part = raw[s:e]
                digits, letters = _DIGIT[part].any(), _LETTERS[part]
                if letters.all():
                    decoys.append((e - s, battery(_VALUE["letters36"][common.LOWER[part]].astype(np.int64), 36)))
                elif digits and letters.any() and (kind := infer(part.tobytes())):
                    points = _points(own) if points is None else points
                    more.append((int(points[s - a]), int(points[e - a]), battery(_VALUE[kind][part].astype(np.int64), len(ALPHABETS[kind]))))
            base.sort()
            yield base, [x for x in more if not any(s <= x[0] and x[1] <= e for s, _, e in base)], decoys


def _class(length) -> np.ndarray:
    return np.searchsorted(LENGTHS, length, "right") - 1


def _bin(score) -> np.ndarray:
    return np.minimum((np.asarray(score) * SCORE_BINS).astype(int), SCORE_BINS - 1)


@functools.cache
def simulated() -> np.ndarray:
    """Counts of ``SIMULATED`` simulated decoys of each length class by score bin."""
    rng, share = np.random.default_rng(5), _LETTER_USE / _LETTER_USE.sum()
    scores = ([battery(x, 36) for x in rng.choice(26, (SIMULATED, n), p=share) + 10] for n in LENGTHS.tolist())  # letters are 10 to 35
    return np.array([np.bincount(_bin(s), minlength=SCORE_BINS) for s in scores])


def thresholds(tokens: np.ndarray, decoys: np.ndarray, rate: float = RATE) -> list[float]:
    """For each length class the least accepted score, above 1 if none; counts by length class and score bin."""
    out = []
    for found, like, drawn in zip(tokens, decoys.cumsum(0), simulated()):  # longer words pass less often, so shorter decoys err on the safe side
        own = like[::-1].cumsum()[::-1] / max(like.sum(), 1)
        like = like + drawn if like.sum() < SIMULATED else like
        at_least, false = found[::-1].cumsum()[::-1], np.maximum(own, (like[::-1].cumsum()[::-1] + 1) / (like.sum() + 1))
        good = np.flatnonzero(found.sum() * false <= rate * np.maximum(at_least, 1))
        good = good[good >= 1]  # a score in the lowest bin rejects randomness
        out.append(good[0] / SCORE_BINS if len(good) and at_least[good[0]] else 2.0)
    return out


SPAN = "array<struct<start:int,kind:int,end:int>>"
TOKENS = "array<struct<start:int,end:int,score:double>>"


def find(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, base, spans): pattern spans, and all spans, as arrays of (start, kind, end) in order."""
    rows = common.own_columns(docs, "doc_id", "text")
    span = pa.list_(pa.struct([(k, pa.int32()) for k in ("start", "kind", "end")]))
    token = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    cells = len(LENGTHS) * SCORE_BINS

    def mapped(batches):
        for batch in batches:
            found = list(scan(*common.utf8(batch.column("text"))))
            base = [[{"start": s, "kind": k, "end": e} for s, k, e in b] for b, *_ in found]
            more = [[{"start": s, "end": e, "score": p} for s, e, p in m] for _, m, _ in found]
            decoys = [(_class(np.array([n for n, _ in d])) * SCORE_BINS + _bin([p for _, p in d])).tolist() if d else [] for *_, d in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, span), pa.array(more, token), pa.array(decoys, pa.list_(pa.int32()))], ["doc_id", "base", "more", "decoys"])

    found = common.checkpoint(rows.mapInArrow(common.tidy(mapped), f"doc_id bigint, base {SPAN}, more {TOKENS}, decoys array<int>"))
    classes = F.lit(0)
    for k, n in enumerate(LENGTHS.tolist()):
        classes = F.when(F.col("x.end") - F.col("x.start") >= n, k).otherwise(classes)
    seen = found.select(F.explode("more").alias("x")).select((classes * SCORE_BINS + F.least(F.floor(F.col("x.score") * SCORE_BINS), F.lit(SCORE_BINS - 1))).alias("cell"), F.lit(True).alias("token"))
    seen = seen.unionByName(found.select(F.explode("decoys").alias("cell")).select(F.col("cell").cast("long"), F.lit(False).alias("token")))
    tokens, decoys = np.zeros(cells), np.zeros(cells)
    for r in seen.groupBy("cell", "token").count().collect():  # two counts for each length class and score bin
        (tokens if r.token else decoys)[r.cell] += r["count"]
    least = thresholds(tokens.reshape(-1, SCORE_BINS), decoys.reshape(-1, SCORE_BINS), rate)

    def accepted(x):
        limit = F.lit(2.0)
        for n, t in zip(LENGTHS.tolist(), least):
            limit = F.when(x["end"] - x["start"] >= n, t).otherwise(limit)
        return x["score"] >= limit

    more = F.transform(F.filter("more", accepted), lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", more)).alias("spans"))


def listed(spans) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {k})) as bigint) AS n_{KINDS[k]}") for k in range(3)]  # a lambda's second argument would be the place
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
