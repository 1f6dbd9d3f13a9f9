"""Exact dedup by an extendible-hash index on shared files.

1. Every row becomes an index entry: a 64-bit hash of the text as key, its length and its id.
2. The directory starts with one bucket and doubles: a bucket that holds more keys than
   ``capacity`` is split by the next hash bit, until it fits or ``max_depth`` bits are used. What
   the directory needs, keys by hash prefix, is at most 2**max_depth numbers.
3. Entries go to the owner task of their key's bucket, one task to a bucket, that is, to a range of
   keys. Entries of one key are combined in each batch before, so that a key of a third
   of all rows comes as one entry a batch. The owner adds them up; its entries are written to the shared
   folder, so that a lost executor costs only a rerun of its tasks.
4. Keys of a single row are settled there. Of the others the texts follow to the same owner, again
   one a batch, in the order of their keys. It compares them byte by byte with the chain of
   the different texts that the key has had: an equal text joins its member of the chain, another
   is chained as a new one. It holds one key's chain at a time, a single text but for collisions.
5. A row belongs to its key's only member, or to the one with its digest where the key has several.

Nulls count as empty texts. The row with the largest doc_id of a group stays (ties are the same
id); rows that repeat a doc_id are counted each, and a null doc_id stays only if no other row has the
text. Very long texts are hashed in the JVM and move only if their key repeats. An empty table gives
no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

CAPACITY = 20_000
MAX_DEPTH = 14


class Directory:
    """The directory of an extendible-hash index: 2**depth slots that point to buckets."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, max_depth: int = MAX_DEPTH):
        """counts: keys by their first ``max_depth`` bits."""
        self.depth, self.max_depth = 0, max_depth
        self.slots: list[tuple[int, int]] = [(0, 0)]  # a bucket is its local depth and its prefix
        below = [counts]
        for _ in range(max_depth):
            up: dict[int, int] = {}
            for k, n in below[-1].items():
                up[k >> 1] = up.get(k >> 1, 0) + n
            below.append(up)
        self.size = {(max_depth - k, prefix): n for k, level in enumerate(below) for prefix, n in level.items()}
        while any(b[0] == self.depth and self.size.get(b, 0) > capacity for b in self.slots) and self.depth < max_depth:
            self._double()
            self.slots = [self._split(s, b, capacity) for s, b in enumerate(self.slots)]
        order = {b: i for i, b in enumerate(dict.fromkeys(self.slots))}
        self.bucket_of_slot = [order[b] for b in self.slots]

    def _double(self) -> None:
        self.slots = [b for b in self.slots for _ in range(2)]
        self.depth += 1

    def _split(self, slot: int, bucket: tuple[int, int], capacity: int) -> tuple[int, int]:
        deep, _ = bucket
        return (deep + 1, slot >> (self.depth - deep - 1)) if deep < self.depth and self.size.get(bucket, 0) > capacity else bucket

    @property
    def buckets(self) -> int:
        return len(set(self.slots))

    def deal(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with a column ``key``) in the partition of their bucket's owner, in the order of their keys."""
        slots = rows.sparkSession.createDataFrame(list(enumerate(self.bucket_of_slot)), "slot int, bucket int")  # 2**max_depth rows at most
        placed = rows.withColumn("slot", _slot(F.col("key"), self.depth)).join(F.broadcast(slots), "slot").drop("slot")
        return placed.repartitionById(self.buckets, "bucket").sortWithinPartitions("key", "n_bytes")


def _slot(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits).cast("int") if bits else F.lit(0)


def _key(text: Column, key_bits: int) -> Column:
    """The hash of a text; of fewer than 64 bits only where collisions are wanted."""
    return F.xxhash64(text).bitwiseAND(F.lit(np.uint64((1 << 64) - (1 << 64 - key_bits)).view(np.int64).item()))


def _entries(docs: DataFrame, key_bits: int = 64) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return common.own_columns(docs, "doc_id", "text").select("doc_id", _key(text, key_bits).alias("key"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))


def _combine(*by: str):
    """Mapper: rows of a batch that agree in ``by`` as one, with their number and largest id."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.table({**{k: batch.column(k) for k in by}, "doc_id": batch.column("doc_id")}).group_by(list(by), use_threads=False).aggregate([("doc_id", "max"), ("doc_id", "count", pa.compute.CountOptions("all"))])
            yield from found.select([*by, "doc_id_max", "doc_id_count"]).rename_columns([*by, "last_id", "rows"]).combine_chunks().to_batches()

    return mapped


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Owner of a bucket: the sums of each key and length."""
    parts = list(batches)
    if parts:
        found = pa.Table.from_batches(parts).group_by(["key", "n_bytes"], use_threads=False).aggregate([("last_id", "max"), ("rows", "sum")])
        yield from found.select(["key", "n_bytes", "last_id_max", "rows_sum"]).rename_columns(["key", "n_bytes", "last_id", "rows"]).to_batches()


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Owner of a bucket: the members (different texts) of each key and length, whose rows follow one another."""
    names = ["key", "n_bytes", "chain", "keep_id", "group_size", "text_sha256"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    at, members, out = None, [], []

    def settled():
        for text, last, rows in members:
            out.append((*at, len(members), last, rows, hashlib.sha256(text).hexdigest()))

    for batch in batches:
        for key, n_bytes, text, last, rows in zip(*(batch.column(k).to_pylist() for k in ("key", "n_bytes", "text", "last_id", "rows"))):
            if at != (key, n_bytes):
                settled()
                at, members = (key, n_bytes), []
            for member in members:
                if member[0] == text:
                    member[1] = last if member[1] is None else member[1] if last is None else max(member[1], last)
                    member[2] += rows
                    break
            else:
                members.append([text, last, rows])
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)
        out.clear()
    settled()
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)


def build_index(entries: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, Directory]:
    """The index on shared files, (key, n_bytes, last_id, rows) with one entry a key and length, a partition a bucket; and its directory."""
    # At most 2**max_depth rows come to the driver, whatever the table's size.
    counts = {r.prefix: r.n for r in entries.groupBy(_slot(F.col("key"), max_depth).alias("prefix")).agg(F.approx_count_distinct("key").alias("n")).collect()}
    directory = Directory(counts, capacity, max_depth)
    combined = entries.select("key", "n_bytes", "doc_id").mapInArrow(common.tidy(_combine("key", "n_bytes")), "key bigint, n_bytes bigint, last_id bigint, rows bigint")
    return common.checkpoint(directory.deal(combined).select("key", "n_bytes", "last_id", "rows").mapInArrow(common.tidy(_settle), "key bigint, n_bytes bigint, last_id bigint, rows bigint")), directory


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, key_bits: int = 64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, key, chain) for every row of ``docs``."""
    entries = common.checkpoint(_entries(docs, key_bits))
    index, directory = build_index(entries, capacity, max_depth)
    # Texts move only where a key has several rows.
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = common.own_columns(docs, "doc_id", "text").select("doc_id", _key(text, key_bits).alias("key"), F.octet_length(text).cast("long").alias("n_bytes"), text.cast("binary").alias("text"))
    repeated = common.reduce_to(texts, "key", index.where("rows > 1").select("key")).select("doc_id", "key", "n_bytes", "text")
    combined = repeated.mapInArrow(common.tidy(_combine("key", "n_bytes", "text")), "key bigint, n_bytes bigint, text binary, last_id bigint, rows bigint")
    members = directory.deal(combined).select("key", "n_bytes", "text", "last_id", "rows").mapInArrow(common.tidy(_chain), "key bigint, n_bytes bigint, chain bigint, keep_id bigint, group_size bigint, text_sha256 string")
    members = common.checkpoint(members)
    one = index.where("rows = 1").select("key", "n_bytes", F.lit(1).cast("long").alias("chain"), F.col("last_id").alias("keep_id"), F.col("rows").alias("group_size"))
    # The bitmap lets a few keys of one row through, whose texts were chained all the same.
    several = members.join(index.where("rows > 1").select("key", "n_bytes"), ["key", "n_bytes"], "left_semi")
    found = one.unionByName(several.groupBy("key", "n_bytes").agg(F.max("chain").alias("chain"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")))
    found = found.withColumn("at", F.struct("key", "n_bytes")).drop("key", "n_bytes")
    both = common.join_known(entries.withColumn("at", F.struct("key", "n_bytes")), found, "at", "group_size").drop("at")
    split = both.where("chain > 1").drop("chain", "keep_id", "group_size").join(members.where("chain > 1"), ["key", "n_bytes", "text_sha256"])
    out = both.where("chain = 1").unionByName(split)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "key", "chain")


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, one row of each group of equal texts: the one with the largest doc_id, and one of those that repeat it."""
    gone = exact_dedup(docs).where("not kept").select(common.as_id("doc_id").alias("ident"), F.col("key").alias("text_key")).distinct()
    return common.keep_rows(docs, gone)


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP3_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text) AS keep_id,
       count(*) OVER (PARTITION BY text) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text) AS kept,
       sha256(text) AS text_sha256
FROM t
"""
