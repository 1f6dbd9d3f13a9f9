"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of hashed word shingles in the order of the hashes. If two sets of similarity
``percent`` / 100 or more have at least c common shingles, then for any L up to c their prefixes of
n - c + L shingles have L in common. A longer prefix costs postings but asks for more matches
before a pair is verified, so each document has the L that is cheapest for it:

1. The prefixes of L = 1 of all documents are dealt out by shingle, which gives each shingle's
   frequency, over the whole table, and each document's estimated candidates: the sum S of how many others
   share each of its p prefix shingles. By a longer prefix these are S (p + L - 1) / p postings, and
   S (p + L - 1) / p / L documents at most that have L of them.
2. ``level`` weighs postings, pairs and verifications, in microseconds, for L = 1 and for 5, 10 and
   20 % of n, and takes the cheapest. Documents with few candidates keep L = 1 (they are
   shallow, S is ``FREQUENT`` at most), the others are deep.
3. A pair is a candidate if it shares the lesser of its two L. As prefixes only grow with L, both
   prefixes hold those of the lesser L, so no pair is lost whose documents chose differently. Pairs
   with a shallow document need one match: they come from step 1's postings. Deep documents
   are read again, post their longer prefixes, and are counted against each other only.

Among deep documents, rare shingles (in ``FREQUENT`` prefixes at most) are joined in full and matches are
counted by pair; a pair is a candidate if its matches, and the frequent shingles that both may have
in common beside them, can reach the lesser L. A document with so few frequent shingles that
every partner shares a rare one with it needs no more. The others are also indexed by
frequent shingles, as many as it takes for every pair of them to share one indexed.

Only components are asked for. Candidates by rare shingles are verified one partner a document
first, then wherever components still differ. Documents that are indexed by frequent shingles meet
under leads: a shingle's lead is the document whose prefix its frequent shingles cover best, so the
shingles of one group of near copies have one lead, and each document comes to a few leads
instead of all its shingles. Each is compared, in blocks of ``BLOCK`` documents by classes of size, with its lead and its block first,
by matrix products over whole sets that return a forest of links and no list of pairs. Only what then is
in another component than its lead meets the other blocks, and only those of its own or the next class of size: others are too
long or too short. A lead with N documents, most of them like it, so costs N sets and no more.

Sets are known by a 64-bit hash of all their shingles; documents of equal sets are one node, and
copies cost a row each. Of n nodes, about n**2 / 2**65 pairs would be taken for equal by chance.

Words are runs of bytes that are no white space, A-Z lower-cased. A document with fewer words than a
shingle has its whole sequence as one; without words (or null) it has none and links with nothing.
A very long text is one set like any other. Rows that repeat are answered each; a null doc_id
is no component's least while another is there. An empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components, forest

WORDS, PERCENT = 4, 85
#: A shingle in more prefixes than this is frequent.
FREQUENT = 32
#: L beyond 1 by level, in per cent of a set.
LEVELS = (0, 5, 10, 20)
#: Microseconds of a posting, of a pair of postings, of verifying a pair, of each shingle of one, and of reading a document again.
POSTING, MATCH, VERIFY, PER_SHINGLE, AGAIN = 0.3, 0.2, 10.0, 0.02, 130.0
WORD_BYTES = ~common.byte_class([0x20, *range(9, 14)])
_STEPS = [np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(64)]
#: Kinds of rows that the first join returns.
DOC, PAIR, INDEX, COST = 0, 1, 2, 3
#: Candidate pairs that a task holds before it writes them.
HELD = 2_000_000
#: Documents of a lead that are compared at a time, and shingles of one matrix product.
BLOCK, COLUMNS = 512, 4096


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS):
    """The sorted distinct shingle hashes of each document."""
    for i, j in common.blocks(offsets):
        low = common.LOWER[data[offsets[i] : offsets[j]]]
        starts, ends, first = common.words(low, offsets[i : j + 1] - offsets[i], WORD_BYTES)
        if not len(starts):
            yield from (np.zeros(0, np.uint64) for _ in range(j - i))
            continue
        hashed = common.word_hash(low, starts, ends)
        padded = np.concatenate([hashed, np.zeros(words, np.uint64)])
        whole = common.mix(sum(padded[k : k + len(hashed)] * _STEPS[k + 1] for k in range(words)))
        for a, b in zip(first.tolist(), first[1:].tolist()):
            if b - a >= words:
                yield np.unique(whole[a : b - words + 1])
            elif b > a:
                yield common.mix(np.array([sum(int(h) * int(_STEPS[k + 1]) for k, h in enumerate(hashed[a:b])) + b - a & (1 << 64) - 1], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def fingerprint(found: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    return int(common.mix(np.array([found.sum(dtype=np.uint64) + np.uint64(len(found))], np.uint64)).view(np.int64)[0])


def required(n, percent: int = PERCENT):
    """Fewest common shingles of a set of n and any set that it links with."""
    return (percent * n + 99) // 100


def matches(n, level=0, percent: int = PERCENT):
    """L at a level: the prefix matches that are asked for."""
    return np.minimum(1 + n * np.asarray(LEVELS)[level] // 100, required(n, percent))


def prefix(n, level=0, percent: int = PERCENT):
    return n - required(n, percent) + matches(n, level, percent)


def least_matches(n, percent: int = PERCENT):
    """The least L of any pair of deep documents that a set of n is in: that of the smallest set it can link with, at the lowest level."""
    return matches(required(n, percent), 1, percent)


def level(n: Column, candidates: Column, percent: int = PERCENT) -> Column:
    """The cheapest level of a set of n whose prefix of L = 1 has so many estimated candidates."""
    c = F.floor((F.lit(percent) * n + 99) / 100)
    costs = []
    for k, share in enumerate(LEVELS):
        match = F.least(1 + F.floor(n * share / 100), c)
        whole = n - c + match
        postings = candidates / (n - c + 1) * whole
        costs.append(whole * POSTING + postings * MATCH + postings / match * (VERIFY + n * PER_SHINGLE) + (AGAIN if k else 0))
    best = F.array_position(F.array(*costs), F.least(*costs)).cast("int") - 1
    return F.when(candidates > FREQUENT, F.greatest(best, F.lit(1))).otherwise(best)


def _pack(*arrays: np.ndarray) -> bytes:
    return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, np.int64, len(kinds))
    at, out = 8 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds):
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _level_of(marks: np.ndarray, node: int) -> int:
    cell = (node & (1 << 64) - 1) >> 39
    return int(marks[cell >> 5] >> np.uint64(2 * (cell & 31))) & 3


def _postings(column: int, n_buckets: int, percent: int, words: int, levels=None):
    """Mapper: blobs of prefix shingles by bucket; shingles that are frequent in a batch alone are only named there.

    Without ``levels`` (a broadcast of two bits a cell of nodes) prefixes are those of L = 1 and rows are
    passed on; with it only deep documents are read.
    """

    def mapped(batches):
        turn = 0
        for batch in batches:
            prints, sizes, parts, seen = [], [], [], {}
            for found in shingles(*common.utf8(batch.column(column)), words):
                sizes.append(len(found))
                prints.append(fingerprint(found) if len(found) else 0)
                if len(found) and prints[-1] not in seen:
                    deep = 0 if levels is None else _level_of(levels.value, prints[-1])
                    if levels is None or deep:
                        seen[prints[-1]] = len(found), deep
                        parts.append(found[: prefix(len(found), deep, percent)].copy())
            rows = []
            if levels is None:
                ids = batch.column("doc_id")
                rows.append((turn % n_buckets, DOC, _pack(np.asarray(ids.fill_null(0)), np.asarray(ids.is_valid()).astype(np.uint8), np.array(sizes, np.int64), np.array(prints, np.int64), np.asarray(batch.column("text_key")))))
            if parts:
                node, (size, deep) = np.array(list(seen), np.int64), np.array(list(seen.values()), np.int32).T
                token, of = np.concatenate(parts), np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
                order = np.argsort(token, kind="stable")
                token, of = token[order], of[order]
                heads = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
                count = np.diff(np.r_[heads, len(token)])
                hot = np.repeat(count > FREQUENT, count)
                if hot.any():
                    if levels is None:
                        used, times = np.unique(of[hot], return_counts=True)
                        rows.append((turn % n_buckets, COST, _pack(node[used], size[used], times)))
                    else:
                        rows.append((turn % n_buckets, INDEX, _pack(node[of[hot]], size[of[hot]], deep[of[hot]], token[hot])))
                named = token[heads[count > FREQUENT]]
                token, of = token[~hot], of[~hot]
                home, named_home = (((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(n_buckets) for x in (token, named))
                order = np.lexsort((of, home))
                token, of, home = token[order], of[order], home[order]
                cuts = np.searchsorted(home, np.arange(n_buckets + 1, dtype=np.uint64))
                for b in range(n_buckets):
                    own, of_own = token[cuts[b] : cuts[b + 1]], of[cuts[b] : cuts[b + 1]]
                    hot_own = named[named_home == b]
                    if len(own) or len(hot_own):
                        used, times = np.unique(of_own, return_counts=True)
                        rows.append((b, PAIR, _pack(node[used], size[used], deep[used], times.astype(np.int32), own, hot_own)))
            turn += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "kind", "blob"])

    return mapped


_JOINED = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("times", pa.int64())])
_JOINED_DDL = "kind int, a bigint, b bigint, n_a bigint, n_b bigint, times bigint"


def _joined(kind: int, a, b, n_a, n_b, times) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), a if isinstance(a, pa.Array) else pa.array(a, pa.int64()), *(pa.array(x, pa.int64()) for x in (b, n_a, n_b, times))], schema=_JOINED)


def _bucket(batches: Iterator[pa.RecordBatch], passed):
    """The postings of one bucket that share a shingle (token, node, size, level; by token and node), where each shingle begins, how many nodes have it, and whether it was frequent in a batch. ``passed`` takes the other rows."""
    node, size, deep, token, named = [], [], [], [], []
    for batch in batches:
        for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob")):
            blob = blob.as_buffer()
            if kind != PAIR:
                passed(kind, blob)
                continue
            of, n, at, times, tokens, hot = _unpack(blob, np.int64, np.int32, np.int32, np.int32, np.uint64, np.uint64)
            node.append(np.repeat(of, times))
            size.append(np.repeat(n, times))
            deep.append(np.repeat(at, times))
            token.append(tokens)
            named.append(hot)
    if not node:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none, none, none, none.astype(bool)
    token, node, size, deep = (np.concatenate(x) for x in (token, node, size, deep))
    order = np.argsort(token, kind="stable")
    token = token[order]
    many = np.zeros(len(token), bool)
    many[1:] = token[1:] == token[:-1]
    many[:-1] |= many[1:]
    hot = np.unique(np.concatenate(named))
    if len(hot):
        many |= hot[np.minimum(np.searchsorted(hot, token), len(hot) - 1)] == token
    order, token = order[many], token[many]  # shingles of one prefix alone match nothing
    node, size, deep = node[order], size[order], deep[order]
    order = np.lexsort((node, token))
    token, node, size, deep = token[order], node[order], size[order], deep[order]
    new = np.r_[True, (token[1:] != token[:-1]) | (node[1:] != node[:-1])] if len(token) else np.zeros(0, bool)
    token, node, size, deep = token[new], node[new], size[new], deep[new]  # copies in several batches
    heads = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
    count = np.diff(np.r_[heads, len(token)])
    known = hot[np.minimum(np.searchsorted(hot, token[heads]), len(hot) - 1)] == token[heads] if len(hot) else np.zeros(len(heads), bool)
    return token, node, size, deep, heads, count, known


def _count_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reducer of prefixes of L = 1: each node's estimated candidates by this bucket's shingles, and the postings of shingles that shallow documents may share."""
    out = []

    def passed(kind, blob):
        if kind == DOC:
            ids, valid, sizes, prints, keys = _unpack(blob, np.int64, np.uint8, np.int64, np.int64, np.int64)
            out.append(_joined(DOC, pa.array(ids, mask=valid == 0), prints, sizes, keys, sizes))
        else:
            of, n, times = _unpack(blob, np.int64, np.int32, np.int64)
            out.append(_joined(COST, of, of, n, n, times * (FREQUENT + 1)))

    token, node, size, _, heads, count, known = _bucket(batches, passed)
    yield from out
    if len(token):
        others = np.repeat(count - 1 + known * (FREQUENT + 1), count)
        used, first, back = np.unique(node, return_index=True, return_inverse=True)
        yield _joined(COST, used, used, size[first], size[first], np.bincount(back, others).astype(np.int64))
        low = others <= FREQUENT
        yield _joined(PAIR, node[low], token[low].view(np.int64), size[low], size[low], others[low])


def _sum_pairs(a, b, n_a, n_b, times):
    order = np.lexsort((b, a))
    a, b, n_a, n_b, times = (x[order] for x in (a, b, n_a, n_b, times))
    heads = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
    return a[heads], b[heads], n_a[heads], n_b[heads], np.add.reduceat(times, heads) if len(heads) else times


def _pairs_of(token, node, size, need, percent: int):
    """Candidate pairs (a < b), each with the matches it needs, of rows with one token. Rows are sorted by token."""
    held, n = [], 0
    live = np.arange(len(token))
    step = 1
    while len(live):
        live = live[live + step < len(token)]
        live = live[token[live] == token[live + step]]
        i, j = live, live + step
        good = 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])
        i, j = i[good], j[good]
        swap = node[i] > node[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        held.append((node[i], node[j], need[i].astype(np.int64), need[j].astype(np.int64), np.ones(len(i), np.int64)))
        n += len(i)
        if n >= HELD:
            held = [_sum_pairs(*map(np.concatenate, zip(*held)))]
            if len(held[0][0]) >= HELD // 2:
                yield held.pop()
            n = len(held[0][0]) if held else 0
        step += 1
    if held:
        yield _sum_pairs(*map(np.concatenate, zip(*held)))


def _join_bucket(percent: int):
    """Reducer: joins the postings of one bucket of shingles of deep documents; passes the rest on as rows."""

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []

        def passed(_, blob):
            of, n, at, tokens = _unpack(blob, np.int64, np.int32, np.int32, np.uint64)
            out.append(_joined(INDEX, of, tokens.view(np.int64), n, at, n))

        token, node, size, deep, heads, count, known = _bucket(batches, passed)
        yield from out
        frequent = np.repeat((count > FREQUENT) | known, count)
        yield _joined(INDEX, node[frequent], token[frequent].view(np.int64), size[frequent], deep[frequent], size[frequent])
        rare = ~frequent
        for found in _pairs_of(token[rare], node[rare], size[rare], matches(size[rare], deep[rare], percent), percent):
            yield _joined(PAIR, *found)

    return reduced


def _links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) whose sets are similar enough, of one list (i < j) or across two."""
    both = left + (right or [])
    sizes = np.array([len(x) for x in both])
    _, column, df = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(both)), sizes)
    shared = df[column] > 1
    column, row = np.unique(column[shared], return_inverse=True)[1], row[shared]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    n = len(left)
    common_count = np.zeros((n, len(right) if right else n), np.float32)
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [begin, begin + COLUMNS])
        x = np.zeros((len(both), COLUMNS), np.float32)
        x[row[a:b], column[a:b] - begin] = 1
        common_count += x[:n] @ (x[n:] if right else x).T
    i, j = np.nonzero(100 * common_count >= percent * (sizes[:n, None] + (sizes[n:] if right else sizes)[None, :] - common_count))
    keep = np.ones(len(i), bool) if right else i < j
    return i[keep], j[keep]


def _under_lead(percent: int):
    """Reducer: links among the documents of one group, or of those of its first list with those of its second, as a forest."""

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: dict[bool, list] = {False: [], True: []}
        sets: dict[bool, list] = {False: [], True: []}
        for batch in batches:
            for node, second, found in zip(batch.column("node").to_pylist(), batch.column("second").to_pylist(), batch.column("found")):
                nodes[second].append(node)
                sets[second].append(np.frombuffer(found.as_buffer(), np.uint64))
        if not sets[False]:
            return
        i, j = _links(sets[False], sets[True] or None, percent)
        first = np.array(nodes[False], np.int64)
        second = np.array(nodes[True], np.int64) if nodes[True] else first
        found = forest(first[i], second[j])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b"])

    return reduced


def _lead_links(under: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect all similar documents under each lead; ``under`` is (lead, node, n), distinct."""
    share = (np.log(100 / percent) if percent < 100 else 1e-9) * (1 + 1e-9)
    # Sizes of two classes that are not next to each other differ by more than ``percent`` allows.
    placed = under.select("lead", "node", F.struct("lead", F.floor(F.log("n") / F.lit(float(share))).cast("long").alias("class")).alias("of"))
    size = placed.groupBy("of").agg(F.count("*").alias("rows")).withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int"))
    placed = common.join_known(placed, common.checkpoint(size), "of", "rows")
    placed = common.checkpoint(placed.select("lead", F.col("of.class").alias("class"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "node"))
    cells = common.checkpoint(placed.select("lead", "class", "block").distinct())
    by = ["lead", "class", "block"]
    both = placed.select(*by, "node").unionByName(cells.select(*by, F.col("lead").alias("node"))).distinct().withColumn("second", F.lit(False))
    links = common.checkpoint(both.join(sets, "node").groupBy(*by).applyInArrow(common.tidy(_under_lead(percent)), "a bigint, b bigint"))
    group = components(links)
    homes = placed.groupBy("lead").agg(F.count("*").alias("rows")).join(group.select(F.col("node").alias("lead"), F.col("component").alias("home")), "lead", "left")
    left = common.join_known(placed.join(group, "node", "left"), common.checkpoint(homes), "lead", "rows")
    left = left.where(F.coalesce("component", "node") != F.coalesce("home", "lead")).select("lead", "node", F.struct("lead", "class").alias("of"))
    left = common.checkpoint(left)
    if left.isEmpty():
        return links
    size = left.groupBy("of").agg(F.count("*").alias("rows")).withColumn("chunks", F.ceil(F.col("rows") / BLOCK).cast("int"))
    probes = common.join_known(left, common.checkpoint(size), "of", "rows")
    probes = common.checkpoint(probes.select("lead", F.col("of.class").alias("of"), F.pmod(F.xxhash64(F.lit(7), "node"), F.col("chunks")).cast("int").alias("chunk"), "node"))
    met = probes.select("lead", "of", "chunk").distinct().join(cells, "lead").where(F.abs(F.col("of") - F.col("class")) <= 1)
    met = common.checkpoint(met)
    key = ["lead", "of", "chunk", "class", "block"]
    rows = placed.join(met, by).select(*key, "node", F.lit(True).alias("second")).unionByName(probes.join(met, ["lead", "of", "chunk"]).select(*key, "node", F.lit(False).alias("second")))
    return links.unionByName(common.checkpoint(rows.join(sets, "node").groupBy(*key).applyInArrow(common.tidy(_under_lead(percent)), "a bigint, b bigint")))


def _sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, found): the whole shingle sets of the wanted nodes."""

    def make(batch):
        for found in shingles(*common.utf8(batch.column("text")), words):
            if len(found):
                yield np.array([fingerprint(found)], np.int64), lambda _, found=found: found.tobytes()

    return common.fetch(docs, nodes, make)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def mapped(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("found").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("found").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(common.tidy(mapped), "a bigint, b bigint")


def _texts_of(docs: DataFrame, found: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the text of a wanted node, one text a node, and a few others; sifted in the JVM."""
    wanted = found.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("text_key").alias("text_key")).select("text_key")
    return common.reduce_to(docs, "text_key", common.checkpoint(wanted.distinct()))


def _deep_pairs(docs: DataFrame, deep: DataFrame, n_buckets: int, percent: int, words: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b, times) among deep documents by rare shingles, and (lead, node, n) of those that are indexed by frequent ones."""
    # Two bits a cell; nodes that share one have the same level, the bits of both.
    got = deep.select(F.shiftrightunsigned("node", 44).alias("hi"), F.expr("shiftleft(cast(level as bigint), cast(2 * (shiftrightunsigned(node, 39) & 31) as int))").alias("mask")).groupBy("hi").agg(F.bit_or("mask").alias("mask")).toArrow()  # 2**20 rows at most
    marks = np.zeros(1 << 20, np.uint64)
    marks[got.column("hi").to_numpy()] = got.column("mask").to_numpy().view(np.uint64)
    levels = docs.sparkSession.sparkContext.broadcast(marks)
    blobs = docs.select("text").mapInArrow(common.tidy(_postings(0, n_buckets, percent, words, levels)), "bucket int, kind int, blob binary")
    joined = common.checkpoint(blobs.groupBy("bucket").applyInArrow(common.tidy(_join_bucket(percent)), _JOINED_DDL))

    # What each document's prefix has of frequent shingles, and by how many of them, the less frequent first, it is indexed.
    frequent = joined.where(F.col("kind") == INDEX).select(F.col("a").alias("node"), F.col("b").alias("token"), F.col("n_a").alias("n")).distinct()
    c = lambda n: F.floor((F.lit(percent) * n + 99) / 100)  # noqa: E731  required
    limit = F.least(1 + F.floor(c(F.col("n")) * LEVELS[1] / 100), c(c(F.col("n"))))  # least_matches
    held = common.checkpoint(frequent.groupBy("node", "n").agg(F.count("*").alias("k")))
    dense = held.where(F.col("k") >= limit).select("node", "k", (F.col("k") - limit + 1).alias("q"), (F.col("k") / F.col("n")).alias("cover"))
    of_dense = common.checkpoint(frequent.join(dense, "node"))
    used = common.checkpoint(of_dense.groupBy("token").agg(F.count("*").alias("df")))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("df", "token"))  # over one document's prefix
    index = common.checkpoint(common.join_known(of_dense, used, "token", "df").withColumn("rank", rank).where("rank <= q").select("token", "node", "n", "cover", "k"))
    leads = index.groupBy("token").agg(F.max(F.struct("cover", "k", "node")).alias("x"), F.count("*").alias("df")).select("token", F.col("x.node").alias("lead"), "df")
    under = common.checkpoint(common.join_known(index, common.checkpoint(leads), "token", "df").select("lead", "node", "n").distinct())

    # Pairs by rare shingles; enough matches for the lesser L, with those that frequent shingles may add.
    pairs = joined.where(F.col("kind") == PAIR).groupBy("a", "b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), F.sum("times").alias("times"))
    k_of = lambda side: held.select(F.col("node").alias(side), F.col("k").alias(f"k_{side}"))
    pairs = pairs.join(k_of("a"), "a", "left").join(k_of("b"), "b", "left")
    enough = F.col("times") + F.least(F.coalesce("k_a", F.lit(0)), F.coalesce("k_b", F.lit(0))) >= F.least("n_a", "n_b")
    return pairs.where(enough).select("a", "b", "times"), under


def linked(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, keep_key) of every row; keep_key is the text_key of the component's first row, by (doc_id, text_key)."""
    docs = common.own_columns(docs, "doc_id", "text").withColumn("text_key", common.text_key())
    n_buckets = common.buckets(docs)
    blobs = docs.mapInArrow(common.tidy(_postings(1, n_buckets, percent, words)), "bucket int, kind int, blob binary")
    counted = common.checkpoint(blobs.groupBy("bucket").applyInArrow(common.tidy(_count_bucket), _JOINED_DDL))
    found = counted.where(F.col("kind") == DOC).select(F.col("a").alias("doc_id"), F.col("n_b").alias("text_key"), F.col("n_a").alias("n_shingles"), F.col("b").alias("node"))
    cost = counted.where(F.col("kind") == COST).groupBy(F.col("a").alias("node")).agg(F.first("n_a").alias("n"), F.sum("times").alias("candidates"))
    deep = common.checkpoint(cost.select("node", level(F.col("n"), F.col("candidates"), percent).alias("level")).where("level > 0"))

    # Pairs with a shallow document share a shingle that no more than FREQUENT others have.
    postings = counted.where(F.col("kind") == PAIR).select(F.col("a").alias("node"), F.col("b").alias("token"), F.col("n_a").alias("n"))
    postings = common.checkpoint(postings.join(deep.select("node", F.lit(True).alias("deep")), "node", "left").select("node", "token", "n", F.coalesce("deep", F.lit(False)).alias("deep")))
    some = postings.where("not deep").select("token").distinct()
    postings = postings.join(some, "token", "left_semi")
    left, right = (postings.select("token", *(F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "deep"))) for side in "ab")
    alike = (F.col("node_a") < F.col("node_b")) & ~(F.col("deep_a") & F.col("deep_b")) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    pairs = left.join(right, "token").where(alike).groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b")).agg(F.count("*").alias("times"))
    under = None
    if not deep.isEmpty():
        more, under = _deep_pairs(_texts_of(docs, found, deep.select("node")), deep, n_buckets, percent, words)
        pairs = pairs.unionByName(more)
    pairs = common.checkpoint(pairs)

    # The sets of all that may have to be verified, once.
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    if under is not None:
        nodes = nodes.unionByName(under.select("node"))
    nodes = common.checkpoint(nodes.distinct())
    sets = common.checkpoint(_sets(_texts_of(docs, found, nodes), nodes, words))

    # One partner for each node by rare shingles, the one it shares most with; then all whose components still differ.
    ends = pairs.select("a", "b", "times", F.col("a").alias("node")).unionByName(pairs.select("a", "b", "times", F.col("b").alias("node")))
    first = common.checkpoint(ends.groupBy("node").agg(F.max_by(F.struct("a", "b"), F.struct("times", "a", "b")).alias("x")).select("x.a", "x.b").distinct())
    links = _verify(first, sets, percent)
    if under is not None:
        links = links.unionByName(_lead_links(under, sets, percent))
    links = common.checkpoint(links)
    group = components(links)
    in_group = lambda side: group.select(F.col("node").alias(side), F.col("component").alias(f"g_{side}"))
    rest = pairs.select("a", "b").join(first, ["a", "b"], "left_anti").join(in_group("a"), "a", "left").join(in_group("b"), "b", "left")
    rest = rest.where(F.coalesce("g_a", "a") != F.coalesce("g_b", "b")).select("a", "b").distinct()
    more = common.checkpoint(_verify(rest, sets, percent))
    if not more.isEmpty():
        group = components(links.unionByName(more))

    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("least")
    by_node = common.checkpoint(found.where("n_shingles > 0").groupBy("node").agg(least, F.count("*").alias("rows")).join(group, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "least", "rows"))
    of_component = common.checkpoint(by_node.groupBy("component").agg(F.min("least").alias("first"), F.count("*").alias("nodes")))
    answer = common.join_known(by_node, of_component, "component", "nodes").select("node", F.col("first.doc_id").alias("component_id"), F.col("first.text_key").alias("keep_key"), "rows")
    answered = common.join_known(found.where("n_shingles > 0"), common.checkpoint(answer), "node", "rows").select("doc_id", "text_key", "n_shingles", "component_id", "keep_key")
    return answered.unionByName(found.where("n_shingles = 0").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"), F.col("text_key").alias("keep_key")))


def similar(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the least doc_id that its links reach."""
    return linked(docs, percent, words).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """``docs`` with all their columns, one row of each component: the first by (doc_id, hash of the text), null ids last, and one of those that repeat it.

    Documents without words are no copies of each other, so all different rows of them stay.
    """
    gone = linked(docs, percent, words).where(~(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("keep_key"))))
    return common.keep_rows(docs, gone.select(common.as_id("doc_id").alias("ident"), "text_key").distinct())


def op7_ngram_join(spark, sf_dir: str) -> DataFrame:
    return similar(spark.read.parquet(f"{sf_dir}/documents.parquet"))
