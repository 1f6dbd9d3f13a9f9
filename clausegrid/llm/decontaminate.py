"""Benchmark decontamination by a generalised suffix automaton of the test items.

The items, normalised to words, become one automaton over word numbers. A document's words are
streamed through it: each word moves to the state of the longest suffix read so far that occurs in
an item, and where that is a window long or longer, the words under the window are hit. Only
stretches of words that all occur in some item, and are as long as the shortest window, can match;
the others are passed over in bulk by word hashes, which loses nothing.

Words: A-Z lower-cased, then runs of digits, letters a-z and all bytes from 0x80. A window is
``window`` consecutive words of an item; an item of fewer words, but not none, is one window.
Null and empty texts have no words; items without words are never found. Items that repeat are
found each; an item without an id counts as hit but is not listed. Rows that repeat are answered
each. An empty benchmark hits nothing. Other columns pass through or are ignored.

The automaton goes to the tasks, so the benchmark is split into blocks of at most ``block_words``
words (about 60 bytes each in a worker); each block is one pass over the documents, whose spans are joined by
document. A text is hashed word by word as a whole; one of any length costs its own bytes several times.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 10
#: A document with a larger share of hit words is dropped as a whole.
MAX_COVERAGE = 0.5
BLOCK_WORDS = 1_000_000
WORD_BYTES = common.byte_class([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])


class Automaton:
    """Suffix automaton of several word sequences, with the items of each window, in flat arrays.

    A state's first move is in two arrays; all further ones are in one sorted list of (state, word).
    """

    def __init__(self, items: list[tuple[int | None, bytes]], window: int = WINDOW):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.word, self.next = array("i", [-1]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        self.edge = None
        sequences = []
        for item, text in items:
            low = common.LOWER[np.frombuffer(text, np.uint8)]
            starts, ends, _ = common.words(low, np.array([0, len(low)]), WORD_BYTES)
            raw = low.tobytes()
            sequence = array("i", [self.number.setdefault(raw[s:e], len(self.number)) for s, e in zip(starts.tolist(), ends.tolist())])
            if sequence:
                sequences.append((item, sequence))
        for _, sequence in sequences:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        edges = np.array([(state << 32 | word, to) for state, moves in self.more.items() for word, to in moves.items()], np.int64).reshape(-1, 2)
        edges = edges[np.argsort(edges[:, 0])]
        self.edge, self.edge_next = array("q", edges[:, 0].tobytes()), array("i", edges[:, 1].astype(np.int32).tobytes())
        self.more = {}
        windows = array("q")  # (state of a whole window, item)
        self.short_at: dict[int, list] = {}  # by state: (length, item) of items that are one short window
        self.shortest = min([min(len(s), window) for _, s in sequences], default=window)
        for item, sequence in sequences:
            state, matched = 0, 0
            for word in sequence:
                state, matched = self.step(state, matched, word)
                if matched >= window and item is not None:
                    windows.extend((self.at_length(state, window), item))
            if len(sequence) < window:
                self.short_at.setdefault(self.at_length(state, len(sequence)), []).append((len(sequence), item))
        pairs = np.unique(np.frombuffer(windows, np.int64).reshape(-1, 2), axis=0) if windows else np.zeros((0, 2), np.int64)
        self.window_state, self.window_item = (array("q", np.ascontiguousarray(pairs[:, k]).tobytes()) for k in (0, 1))
        self.hashes = np.sort(np.array([common.hash_of(w) for w in self.number], np.uint64))
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def move(self, state: int, word: int) -> int:
        """The state after ``word``, or -1."""
        if self.word[state] == word:
            return self.next[state]
        if self.edge is None:  # still being built
            return self.more.get(state, {}).get(word, -1)
        key = state << 32 | word
        at = bisect_left(self.edge, key)
        return self.edge_next[at] if at < len(self.edge) and self.edge[at] == key else -1

    def _set(self, state: int, word: int, to: int) -> None:
        if self.word[state] in (-1, word):
            self.word[state], self.next[state] = word, to
        else:
            self.more.setdefault(state, {})[word] = to

    def _extend(self, last: int, word: int) -> int:
        link, length = self.link, self.length
        old = self.move(last, word)
        if old >= 0:
            return old if length[old] == length[last] + 1 else self._clone(last, word, old)
        new = self._state(0, length[last] + 1)
        at = last
        while at >= 0 and (old := self.move(at, word)) < 0:
            self._set(at, word, new)
            at = link[at]
        if at >= 0:
            link[new] = old if length[old] == length[at] + 1 else self._clone(at, word, old)
        return new

    def _state(self, link: int, length: int) -> int:
        self.link.append(link)
        self.length.append(length)
        self.word.append(-1)
        self.next.append(-1)
        return len(self.link) - 1

    def _clone(self, at: int, word: int, old: int) -> int:
        copy = self._state(self.link[old], self.length[at] + 1)
        self.word[copy], self.next[copy] = self.word[old], self.next[old]
        if old in self.more:
            self.more[copy] = dict(self.more[old])
        self.link[old] = copy
        while at >= 0 and self.move(at, word) == old:
            self._set(at, word, copy)
            at = self.link[at]
        return copy

    def step(self, state: int, matched: int, word: int) -> tuple[int, int]:
        """The state and length of the longest match that ends with ``word``."""
        while (to := self.move(state, word)) < 0 and state:
            state = self.link[state]
            matched = self.length[state]
        return (to, matched + 1) if to >= 0 else (0, 0)

    def at_length(self, state: int, n: int) -> int:
        """The state of the suffix of n words."""
        while self.length[self.link[state]] >= n if state else False:
            state = self.link[state]
        return state

    def items_of(self, state: int) -> array:
        """The items of the window that ends in a state."""
        return self.window_item[bisect_left(self.window_state, state) : bisect_right(self.window_state, state)]

    def known(self, hashes: np.ndarray) -> np.ndarray:
        out = self.maybe[(hashes >> np.uint64(48)).astype(np.int64)]
        at = np.flatnonzero(out)
        if len(at):
            place = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
            out[at] = self.hashes[place] == hashes[at]
        return out

    def stream(self, found: list[int]) -> tuple[list[tuple[int, int]], set, int]:
        """Spans of hit words (end exclusive), the items found, and the longest match, of a stretch of word numbers."""
        state, matched, longest, spans, items, states = 0, 0, 0, [], set(), set()
        for i, word in enumerate(found):
            state, matched = self.step(state, matched, word) if word >= 0 else (0, 0)
            longest = max(longest, matched)
            reach = 0
            if matched >= self.window:
                reach = self.window
                states.add(self.at_length(state, self.window))
            if self.short_at:
                at = state
                while at > 0:
                    for n, item in self.short_at.get(at, ()):
                        if n <= matched:
                            items.add(item)
                            reach = max(reach, n)
                    at = self.link[at]
            if reach:
                start = i + 1 - reach
                if spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        for s in states:
            items.update(self.items_of(s))
        return spans, items, longest

    def scan(self, data: np.ndarray, offsets: np.ndarray):
        """Of each document: its number of words, and its hits as (first word, end word, first byte, end byte), items and longest match."""
        for i, j in common.blocks(offsets):
            low = common.LOWER[data[offsets[i] : offsets[j]]]
            starts, ends, first = common.words(low, offsets[i : j + 1] - offsets[i], WORD_BYTES)
            hits: dict[int, tuple[list, set, int]] = {}
            if len(starts) and len(self.hashes):
                known = self.known(common.word_hash(low, starts, ends))
                begins = known.copy()
                begins[1:] &= ~known[:-1]
                edge = first[:-1][first[:-1] < len(known)]
                begins[edge] = known[edge]
                heads = np.flatnonzero(begins)
                stops = ~known
                stops[edge] = True
                stop_at = np.append(np.flatnonzero(stops), len(known))
                tails = stop_at[np.searchsorted(stop_at, heads, "right")]
                for a, b in zip(*((x[tails - heads >= self.shortest]).tolist() for x in (heads, tails))):
                    spans, items, longest = self.stream([self.number.get(low[s:e].tobytes(), -1) for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist())])
                    doc = int(np.searchsorted(first, a, "right")) - 1
                    own = hits.setdefault(doc, ([], set(), 0))
                    base = int(first[doc])
                    begin = int(offsets[i + doc] - offsets[i])
                    own[0].extend((a + s - base, a + e - base, int(starts[a + s]) - begin, int(ends[a + e - 1]) - begin) for s, e in spans)
                    own[1].update(items)
                    hits[doc] = (own[0], own[1], max(own[2], longest))
            for k in range(j - i):
                yield int(first[k + 1] - first[k]), *hits.get(k, ([], set(), 0))


def _automata(benchmark: DataFrame, window: int, block_words: int):
    """One automaton for each block of items; items reach the driver one block at a time."""
    items = common.own_columns(benchmark, "item_id", "text").where("text is not null")
    block, size = [], 0
    for row in items.toLocalIterator():
        block.append((row.item_id, row.text.encode()))
        size += len(row.text) // 2 + 1  # words are one character and one gap at least
        if size >= block_words:
            yield Automaton(block, window)
            block, size = [], 0
    yield Automaton(block, window)


SPANS = "array<struct<first:int,end:int,start:int,stop:int>>"


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, text_key, n_words, spans, items, longest): hit words of each document and the items they are from."""
    spark = docs.sparkSession
    texts = common.own_columns(docs, "doc_id", "text").select("doc_id", common.text_key().alias("text_key"), "text")
    schema = f"doc_id bigint, text_key bigint, n_words bigint, spans {SPANS}, items array<bigint>, longest int"
    kinds = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([(k, pa.int32()) for k in ("first", "end", "start", "stop")]))), ("items", pa.list_(pa.int64())), ("longest", pa.int32())])

    def one_pass(automaton: Automaton, last: bool) -> DataFrame:
        sent = spark.sparkContext.broadcast(automaton)  # of block_words words at most

        def mapped(batches):
            for batch in batches:
                found = list(sent.value.scan(*common.utf8(batch.column("text"))))
                columns = [batch.column("doc_id"), batch.column("text_key"), [n for n, *_ in found], [[dict(zip(("first", "end", "start", "stop"), s)) for s in spans] for _, spans, *_ in found], [sorted(x for x in items if x is not None) for _, _, items, _ in found], [longest for *_, longest in found]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds.types)], schema=kinds)

        out = texts.mapInArrow(common.tidy(mapped), schema)
        if not last:  # one block at a time is in memory
            out = common.checkpoint(out)
            sent.destroy()
        return out

    # Of documents without a hit, the first block's row is enough.
    automata, out, n_passes = _automata(benchmark, window, block_words), None, 0
    this = next(automata)
    while this is not None:
        after = next(automata, None)
        found = one_pass(this, last=after is None and not n_passes)
        out = found if out is None else out.unionByName(found.where("size(spans) > 0 or longest > 0"))
        this, n_passes = after, n_passes + 1
    if n_passes > 1:
        merged = f"""aggregate(array_sort(flatten(collect_list(spans))), cast(array() as {SPANS}), (a, x) ->
            if(size(a) > 0 and element_at(a, -1).end >= x.first,
               concat(slice(a, 1, size(a) - 1), array(named_struct('first', element_at(a, -1).first, 'end', greatest(element_at(a, -1).end, x.end), 'start', element_at(a, -1).start, 'stop', greatest(element_at(a, -1).stop, x.stop)))),
               concat(a, array(x))))"""
        times = common.checkpoint(texts.groupBy("doc_id", "text_key").count().where("count > 1"))
        out = out.groupBy("doc_id", "text_key").agg(F.max("n_words").alias("n_words"), F.expr(merged).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.max("longest").alias("longest"))
        if not times.isEmpty():  # rows that repeat are answered each
            again = times.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_text"), F.col("count").alias("_times"))
            out = out.join(again, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_text")), "left").withColumn("_times", F.explode(F.sequence(F.lit(1), F.coalesce("_times", F.lit(1)).cast("int")))).drop("_doc", "_text", "_times")
    return out


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with hit spans cut from ``text``; documents with a larger share of hit words than ``max_coverage`` are dropped.

    Spans are those of the whole benchmark on the text as it came, whatever the blocks.
    """
    names, own = docs.columns, common.plain(docs)
    where, width, schema = names.index("text"), len(names), own.schema
    automata = _automata(benchmark, window, block_words)
    only, second = next(automata), next(automata, None)
    sent = docs.sparkSession.sparkContext.broadcast(only if second is None else None)
    if second is not None:  # the spans of all blocks first, then one join with the documents that have any
        marks = find(docs, benchmark, window, block_words).where("size(spans) > 0").select(common.as_id("doc_id").alias("ident"), "text_key", "n_words", "spans").dropDuplicates(["ident", "text_key"])
        keyed = own.withColumns({"ident": common.as_id(common.place(docs, "doc_id")), "text_key": common.text_key(common.place(docs, "text"))})
        own = keyed.join(marks, ["ident", "text_key"], "left").select(*keyed.columns[:width], "n_words", "spans")

    def hits(batch):
        """Of each row its number of words and its spans, as far as it has any."""
        if sent.value is None:
            for k, (n, spans) in enumerate(zip(batch.column("n_words").to_pylist(), batch.column("spans").to_pylist())):
                if spans:
                    yield k, n, [tuple(s.values()) for s in spans]
        else:
            yield from ((k, n, spans) for k, (n, spans, _, _) in enumerate(sent.value.scan(*common.utf8(batch.column(where)))) if spans)

    def mapped(batches):
        for batch in batches:
            column = batch.column(where)
            data, offsets = common.utf8(column)
            keep, changed = np.ones(batch.num_rows, bool), {}
            for k, n, spans in hits(batch):
                keep[k] = sum(e - s for s, e, _, _ in spans) <= max_coverage * n
                raw, at, parts = data[offsets[k] : offsets[k + 1]].tobytes(), 0, []
                for *_, start, stop in spans:
                    parts.append(raw[at:start])
                    at = stop
                changed[k] = b"".join([*parts, raw[at:]]).decode()
            if changed:
                texts = column.to_pylist()
                for k, text in changed.items():
                    texts[k] = text
                batch = batch.set_column(where, batch.schema.field(where), pa.array(texts, batch.schema.field(where).type))
            kept = batch.select(range(width)).filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays(kept.columns, schema.names)

    return own.mapInArrow(common.tidy(mapped), schema).toDF(*names)


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["first"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "longest")
