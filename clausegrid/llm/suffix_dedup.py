"""Removal of repeated byte strings by external induced sorting of suffixes, in shards.

A byte goes if a string of ``depth`` bytes covers it that also starts anywhere else. Only suffixes
whose first bytes occur elsewhere can decide that, so the texts are reduced first, without loss:

1. In every string of ``depth`` bytes a fixed rule picks an anchor: of its first 3/4, the byte where
   the least hashed 8-gram begins. Equal strings pick alike. The starts of strings with one anchor
   are a stretch; its context is all bytes from its first start to its last string's end.
2. Stretches are dealt by the hash of the ``depth`` / 4 bytes from their anchor, which equal strings
   share. A stretch that is alone with its hash repeats nothing. Stretches with the whole context in
   common are one tuple with a count, and repeat in full; a task counts its own before they
   are dealt, so that a passage of any number of documents is one tuple a task.
3. The different contexts of one hash go, as shards of many hashes, to ``induced_sort``: suffixes
   with a neighbour of ``depth`` common bytes in the sorted order are repeated.

Hashes are of 64 bits; contexts are taken for equal if two of them agree, of the anchor's bytes and
of the context. Null counts as empty; texts shorter than ``depth`` bytes keep all. Matches never
cross documents. Rows that repeat (in id and text) are each other's copies. A text of more than 4 MB is
read in pieces that overlap. An empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, induced_sort
from .ngram_join import _pack, _unpack

DEPTH = 200
#: Bytes of context in a shard.
SHARD_BYTES = 2 << 20
PIECE = 1 << 21
MARKS, REQUEST = 0, 1


def _pieces(data: np.ndarray, offsets: np.ndarray, depth: int):
    """(first document, bytes, offsets, position of the first byte, starts to take) of blocks; a very long document comes in pieces."""
    for i, j in common.blocks(offsets, PIECE):
        part, ends = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if j == i + 1 and len(part) > 2 * PIECE:
            for a in range(0, len(part), PIECE):
                own = part[a : a + PIECE + depth - 1]
                yield i, own, np.array([0, len(own)]), a, PIECE
        else:
            yield i, part, ends, 0, len(part)


def stretches(part: np.ndarray, ends: np.ndarray, depth: int, take: int):
    """Of one block: document, first start, number of starts, anchor hash and context hash of each stretch."""
    n = len(part)
    reach, gram = depth - depth // 4 + 1, min(8, depth // 4)
    none = np.zeros(0, np.int64)
    if n < depth:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    padded = np.concatenate([part, np.zeros(8, np.uint8)])
    value = np.ndarray((n,), np.uint64, buffer=padded.data, strides=(1,)) & np.uint64((1 << 8 * gram) - 1)
    least = (common.mix(value) & ~np.uint64((1 << 24) - 1)) | np.arange(n, dtype=np.uint64)
    size = 1
    while size < reach:  # least of ``reach`` from each position on
        step = min(size, reach - size)
        least = np.minimum(least[: len(least) - step], least[step:])
        size += step
    anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[: len(anchor)]
    valid = np.arange(len(anchor)) + depth <= np.minimum(ends[1:][doc], n)
    valid[take:] = False
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (valid[1:] != valid[:-1])
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, len(anchor)))
    good = valid[heads]
    heads, sizes = heads[good], sizes[good]
    sums = common.prefix_hash(part)
    at = anchor[heads]
    key = common.span_hash(sums, at, at + depth // 4)
    whole = common.mix(common.span_hash(sums, heads, heads + sizes - 1 + depth) + (sizes * 512 + at - heads).astype(np.uint64))
    return doc[heads], heads, sizes, key, whole


def _homes(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(n)


def _marks(row: np.ndarray, start: np.ndarray, stop: np.ndarray, n_buckets: int):
    """Blobs of removed spans by bucket of rows."""
    home = _homes(row, n_buckets)
    order = np.argsort(home, kind="stable")
    cuts = np.searchsorted(home[order], np.arange(n_buckets + 1, dtype=np.uint64))
    for b in range(n_buckets):
        if len(o := order[cuts[b] : cuts[b + 1]]):
            yield b, _pack(row[o], start[o].astype(np.int32), stop[o].astype(np.int32))


def _deal(depth: int, n_buckets: int):
    """Mapper: stretches by bucket of their anchor hash; spans of what repeats within the batch."""

    def mapped(batches):
        for batch in batches:
            rows = np.asarray(batch.column("row_key"))
            found = []
            for i, part, ends, base, take in _pieces(*common.utf8(batch.column("text")), depth):
                doc, start, size, key, whole = stretches(part, ends, depth, take)
                found.append((rows[doc + i], start - ends[doc] + base, size, key, whole))
            row, start, size, key, whole = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 5
            out = []
            if len(row):
                order = np.lexsort((whole, key))
                row, start, size, key, whole = (x[order] for x in (row, start, size, key, whole))
                new = np.r_[True, (key[1:] != key[:-1]) | (whole[1:] != whole[:-1])]
                heads = np.flatnonzero(new)
                times = np.diff(np.append(heads, len(row)))
                again = np.repeat(times > 1, times)
                out += [(b, MARKS, blob) for b, blob in _marks(row[again], start[again], (start + size - 1 + depth)[again], n_buckets)]
                row, start, size, key, whole = (x[heads] for x in (row, start, size, key, whole))
                home = _homes(key, n_buckets)
                order = np.argsort(home, kind="stable")
                cuts = np.searchsorted(home[order], np.arange(n_buckets + 1, dtype=np.uint64))
                for b in range(n_buckets):
                    if len(o := order[cuts[b] : cuts[b + 1]]):
                        used, of = np.unique(row[o], return_inverse=True)
                        out.append((b, REQUEST, _pack(used, of.astype(np.int32), start[o].astype(np.int32), size[o].astype(np.int16), (times[o] > 1).astype(np.uint8), key[o], whole[o])))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["bucket", "kind", "blob"])

    return mapped


_FOUND = "kind int, home int, blob binary, node bigint, key bigint, row_key bigint, start int, size int, single boolean"
_FOUND_SCHEMA = pa.schema([("kind", pa.int32()), ("home", pa.int32()), ("blob", pa.binary()), ("node", pa.int64()), ("key", pa.int64()), ("row_key", pa.int64()), ("start", pa.int32()), ("size", pa.int32()), ("single", pa.bool_())])


def _as_rows(marks) -> pa.RecordBatch:
    homes, blobs = zip(*marks)
    n = len(homes)
    return pa.RecordBatch.from_arrays([pa.array([MARKS] * n, pa.int32()), pa.array(homes, pa.int32()), pa.array(blobs, pa.binary()), *(pa.nulls(n, t) for t in _FOUND_SCHEMA.types[3:])], schema=_FOUND_SCHEMA)


def _match(depth: int, n_buckets: int):
    """Reducer of a bucket of anchor hashes: spans of stretches with equal contexts, requests for the contexts that differ."""

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for b, kind, blob in zip(batch.column("bucket").to_pylist(), batch.column("kind").to_pylist(), batch.column("blob")):
                if kind == MARKS:
                    yield _as_rows([(b, blob.as_py())])
                else:
                    used, of, start, size, twice, key, whole = _unpack(blob.as_buffer(), np.int64, np.int32, np.int32, np.int16, np.uint8, np.uint64, np.uint64)
                    parts.append((used[of], start, size, twice, key, whole))
        if not parts:
            return
        row, start, size, twice, key, whole = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        order = np.lexsort((whole, key))
        row, start, size, twice, key, whole = (x[order] for x in (row, start, size, twice, key, whole))
        new_key = np.r_[True, key[1:] != key[:-1]]
        new = new_key | np.r_[True, whole[1:] != whole[:-1]]
        heads = np.flatnonzero(new)
        times = np.diff(np.append(heads, len(row)))
        repeated = (times > 1) | (twice[heads] > 0)
        all_of = np.repeat(repeated, times) & (twice == 0)  # the others were marked in their batch
        stop = start.astype(np.int64) + size - 1 + depth
        if marks := list(_marks(row[all_of], start[all_of], stop[all_of], n_buckets)):
            yield _as_rows(marks)
        # A hash with several contexts: one stretch of each is asked for.
        group = np.cumsum(new_key)[heads]
        many = np.bincount(group)[group] > 1
        h = heads[many]
        n = len(h)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, REQUEST, np.int32)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(whole[h].view(np.int64)), pa.array(key[h].view(np.int64)), pa.array(row[h]), pa.array(start[h]), pa.array(size[h].astype(np.int32)), pa.array(~repeated[many])], schema=_FOUND_SCHEMA)

    return reduced


def _sort_shard(depth: int, n_buckets: int, memory: int):
    """Reducer of a shard: spans of repeated strings in contexts that occur once."""

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(batches).select(["row_key", "start", "size", "single", "found"])
        texts = whole["found"].to_pylist()
        row, start, size, single = (whole[k].to_numpy() for k in ("row_key", "start", "size", "single"))
        again = induced_sort.repeated(texts, depth, memory)
        at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]])
        at, size, row, start = at[single], size[single], row[single], start[single].astype(np.int64)
        # The first ``size`` positions of a context are its stretch's starts.
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        hit = np.flatnonzero(again[np.repeat(at, size) + inner]) if len(size) else np.zeros(0, np.int64)
        of = np.repeat(np.arange(len(size)), size)[hit]
        begin = inner[hit]
        new = np.r_[True, (of[1:] != of[:-1]) | (begin[1:] != begin[:-1] + 1)] if len(hit) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(hit)) - 1
        if len(first):
            yield _as_rows(list(_marks(row[of[first]], start[of[first]] + begin[first], start[of[first]] + begin[last] + depth, n_buckets)))

    return reduced


def _merge():
    """Reducer of a bucket of rows: the maximal removed spans of each row."""

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_unpack(blob.as_buffer(), np.int64, np.int32, np.int32) for batch in batches for blob in batch.column("blob")]
        row, start, stop = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((start, row))
        row, start, stop = row[order], start[order].astype(np.int64), stop[order].astype(np.int64)
        lines = np.cumsum(np.r_[True, row[1:] != row[:-1]]) - 1
        far = np.maximum.accumulate(stop + (lines << 32))  # ends so far, within the row as rows follow one another
        new = np.r_[True, (start[1:] + (lines[1:] << 32)) > far[:-1]]
        first = np.flatnonzero(new)
        ends = far[np.append(first[1:], len(row)) - 1] - (lines[first] << 32)
        rows = np.flatnonzero(np.r_[True, row[first][1:] != row[first][:-1]])
        offsets = pa.array(np.append(rows, len(first)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (start[first], ends)]
        yield pa.RecordBatch.from_arrays([pa.array(row[first][rows]), *lists], ["row_key", "starts", "stops"])

    return reduced


def _keyed(docs: DataFrame) -> DataFrame:
    docs = common.own_columns(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    return docs.withColumn("row_key", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull(), "text"))


def repeats(docs: DataFrame, depth: int = DEPTH, shard_bytes: int = SHARD_BYTES, memory: int = induced_sort.MEMORY) -> DataFrame:
    """(row_key, starts, stops): the maximal byte spans to remove of each row that has any; ``docs`` as ``_keyed`` gives them."""
    if depth < 8:
        raise ValueError("strings of at least 8 bytes are supported")
    n_buckets = common.buckets(docs)
    dealt = docs.select("row_key", "text").mapInArrow(common.tidy(_deal(depth, n_buckets)), "bucket int, kind int, blob binary")
    found = common.checkpoint(dealt.groupBy("bucket").applyInArrow(common.tidy(_match(depth, n_buckets)), _FOUND))
    requests = found.where(F.col("kind") == REQUEST).select("node", "key", "row_key", "start", "size", "single")

    def contexts(batch):
        for _, part, ends, _, take in _pieces(*common.utf8(batch.column("text")), depth):
            _, start, size, _, whole = stretches(part, ends, depth, take)
            yield whole.view(np.int64), lambda k, part=part, start=start, size=size: part[start[k] : start[k] + size[k] - 1 + depth].tobytes()

    texts = common.fetch(docs, common.checkpoint(requests.select("node").distinct()), contexts)
    total = requests.agg(F.sum(F.col("size") + depth)).first()[0] or 0
    n_shards = max(1, -(-total // shard_bytes))
    shards = requests.join(texts, "node").withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(n_shards)))
    sorted_marks = shards.groupBy("shard").applyInArrow(common.tidy(_sort_shard(depth, n_buckets, memory)), _FOUND)
    marks = found.where(F.col("kind") == MARKS).select("home", "blob").unionByName(sorted_marks.select("home", "blob"))
    return common.checkpoint(marks.groupBy("home").applyInArrow(common.tidy(_merge()), "row_key bigint, starts array<int>, stops array<int>"))


def drop_repeats(docs: DataFrame, depth: int = DEPTH, shard_bytes: int = SHARD_BYTES, memory: int = induced_sort.MEMORY) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, starts, stops) of every row; ``kept`` (binary) is what is left of its bytes."""
    keyed = _keyed(docs)
    gone = repeats(keyed, depth, shard_bytes, memory)
    none = F.array().cast("array<int>")
    same = keyed.select("doc_id", "row_key", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), F.col("text").cast("binary").alias("kept"), none.alias("starts"), none.alias("stops"))
    same = same.join(gone.select("row_key"), "row_key", "left_anti").drop("row_key")

    def cut(batches):
        for batch in batches:
            data, offsets = common.utf8(batch.column("text"))
            rows = []
            for k, (starts, stops) in enumerate(zip(batch.column("starts").to_pylist(), batch.column("stops").to_pylist())):
                raw, at, parts = data[offsets[k] : offsets[k + 1]].tobytes(), 0, []
                for s, e in zip(starts, stops):
                    parts.append(raw[at:s])
                    at = e
                kept = b"".join([*parts, raw[at:]])
                rows.append((len(raw), len(raw) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)), batch.column("starts"), batch.column("stops")], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "starts", "stops"])

    changed = common.reduce_to(keyed, "row_key", gone.select("row_key")).join(gone, "row_key")
    changed = changed.mapInArrow(common.tidy(cut), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary, starts array<int>, stops array<int>")
    return same.unionByName(changed)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
