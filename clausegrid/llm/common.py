"""Shared helpers of the corpus operators: checkpoints, Arrow text buffers, word hashing.

Texts reach Python as Arrow batches (Spark bounds them by bytes) and are worked on as byte
buffers in blocks of a few MB, so memory stays the same whatever the corpus holds.
"""

from __future__ import annotations

import ctypes
import functools
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.checkpoints import checkpoint, shared_dir  # noqa: F401

BLOCK_BYTES = 1 << 20
#: Bytes of an Arrow batch; a task holds a batch or two in the JVM and in Python each.
BATCH_BYTES = "16m"
U64 = np.uint64


def buckets(df: DataFrame) -> int:
    """How many buckets keyed blobs are dealt to: grows with the input's splits, so a bucket's size does not."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def plain(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named c0, c1, ... by place, as names that differ in case only cannot be told apart."""
    return docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))


def place(docs: DataFrame, name: str) -> str:
    """What ``plain(docs)`` calls the first column of exactly that name."""
    return f"c{docs.columns.index(name)}"


def own_columns(docs: DataFrame, *wanted: str, batch: str = BATCH_BYTES) -> DataFrame:
    """The wanted columns, by exact name; missing ones become nulls, all others (clashing or not) are left out.

    Sets the session's size of Arrow batches for what follows.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", batch)
    kinds = {"doc_id": "bigint", "item_id": "bigint"}
    return plain(docs).select(*((F.col(place(docs, c)) if c in docs.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in wanted))


#: Seconds between two calls of the system to take freed memory back.
TRIM_SECONDS = 0.5
_trimmed = [0.0]


def trim() -> None:
    """Hand freed memory back to the system, every few seconds at most."""
    if time.monotonic() - _trimmed[0] > TRIM_SECONDS:
        try:
            pa.default_memory_pool().release_unused()
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass
        _trimmed[0] = time.monotonic()


def tidy(run):
    """A mapper or reducer that trims memory when it ends, so that idle workers hold little."""

    @functools.wraps(run)
    def tidied(batches):
        yield from run(batches)
        trim()

    return tidied


def as_id(column) -> Column:
    """A document's id as a number that is never null; a null id compares as the least number, which no document should have."""
    return F.coalesce(F.col(column).cast("bigint"), F.lit(-(1 << 63)))


def text_key(column="text") -> Column:
    """A 64-bit hash of a text; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")))


def keep_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` with all its columns, without the rows of ``gone`` (ident, text_key; distinct), and once each of those that repeat in both."""
    out = plain(docs).withColumns({"ident": as_id(place(docs, "doc_id")), "text_key": text_key(place(docs, "text"))})
    twice = checkpoint(out.groupBy("ident", "text_key").count().where("count > 1").select("ident", "text_key"))
    out = out.join(gone, ["ident", "text_key"], "left_anti")
    if not twice.isEmpty():
        out = out.join(twice, ["ident", "text_key"], "left_anti").unionByName(out.join(twice, ["ident", "text_key"], "left_semi").dropDuplicates(["ident", "text_key"]))
    return out.drop("ident", "text_key").toDF(*docs.columns)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string or binary column as its bytes and len + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES):
    """Runs (i, j) of documents of about ``limit`` bytes; a longer document has a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def byte_class(pattern_bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(pattern_bytes)] = True
    return table


#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of word bytes that do not cross documents: starts, ends, and the index of each document's first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = word_byte[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_BACK = U64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BACK)):
            whole = np.full(max(n, 1 << 16), base, U64)
            whole[0] = 1
            _powers[k] = np.multiply.accumulate(whole)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(29))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(32))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums S of a polynomial rolling hash; the string [s, e) hashes to (S[e] - S[s]) times the s-th inverse power."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts] + (ends - starts).astype(U64))


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_hash(data), starts, ends)


def hash_of(text: bytes) -> int:
    """The same hash of one string."""
    data = np.frombuffer(text, np.uint8)
    return int(word_hash(data, np.array([0]), np.array([len(data)]))[0])


#: Bits of a semi-join reducer; its broadcast side has at most REDUCER_BITS / 64 rows, whatever the data's size.
REDUCER_BITS = 1 << 26


def reduce_to(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """``df`` without most rows whose ``column`` is not in ``wanted`` (one column of that name); no wanted row is lost.

    A bitmap of hashes, of bounded size, drops rows before they are shuffled; an exact join should
    follow. Where ``wanted`` is too long for the bitmap to be of use, ``df`` comes back as it is.
    """
    if wanted.count() > REDUCER_BITS // 2:
        return df
    place = F.pmod(F.xxhash64(column), F.lit(REDUCER_BITS))
    word, bit = F.shiftright(place, 6), F.pmod(place, F.lit(64)).cast("int")
    marks = wanted.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_mask"))
    return df.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(marks), "_word").where(F.expr("(shiftright(_mask, _bit) & 1L) = 1L")).drop("_word", "_bit", "_mask")


#: A key with more than this share of all rows is hot; there are fewer than 1 / HOT_SHARE hot keys.
HOT_SHARE = 1e-3


def join_known(rows: DataFrame, known: DataFrame, key: str, weight: str) -> DataFrame:
    """Inner join of ``rows`` with ``known``, whose ``key`` is unique and whose ``weight`` is the key's number of rows.

    Rows of hot keys never meet in one task: those keys, fewer than 1 / HOT_SHARE, are broadcast.
    """
    total = known.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) > max(1, int(total * HOT_SHARE))
    hot = F.broadcast(known.where(is_hot))
    rest = rows.join(hot.select(key), key, "left_anti").join(known.where(~is_hot), key)
    return rows.join(hot, key).unionByName(rest)


class Marks:
    """A bitmap of wanted nodes, of bounded size, that tasks hold: which of some nodes may be wanted (all that are, and few others)."""

    def __init__(self, nodes: DataFrame):
        """nodes: one column, ``node``."""
        marks = np.zeros(REDUCER_BITS // 64, np.uint64)
        if nodes.count() > REDUCER_BITS // 2:
            marks[:] = ~np.uint64(0)
        else:
            got = nodes.select(F.shiftrightunsigned(F.col("node"), 44).alias("hi"), F.expr("shiftleft(1L, cast(shiftrightunsigned(node, 38) & 63 as int))").alias("mask")).groupBy("hi").agg(F.bit_or("mask").alias("mask")).toArrow()  # REDUCER_BITS / 64 rows at most
            marks[got.column("hi").to_numpy()] = got.column("mask").to_numpy().view(np.uint64)
        self.sent = nodes.sparkSession.sparkContext.broadcast(marks)

    def __call__(self, node: np.ndarray) -> np.ndarray:
        place = node.view(np.uint64) >> U64(38)
        return (self.sent.value[(place >> U64(6)).astype(np.int64)] >> (place & U64(63)) & U64(1)).astype(bool)


def fetch(docs: DataFrame, nodes: DataFrame, make) -> DataFrame:
    """(node, found) of the wanted nodes (distinct, one column), made again from the column ``text``.

    ``make`` takes a batch and yields node numbers with a function that gives the payload of one of
    them. A bitmap of bounded size tells the tasks which to make; an exact join drops the few others.
    """
    marked = Marks(nodes)

    def mapped(batches):
        for batch in batches:
            seen = {}
            for node, payload in make(batch):
                for k in np.flatnonzero(marked(node)).tolist():
                    if (key := int(node[k])) not in seen:
                        seen[key] = payload(k)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.binary())], ["node", "found"])

    made = docs.select("text").mapInArrow(tidy(mapped), "node bigint, found binary")
    return made.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("found").alias("found"))
