"""Every corpus operator on awkward tables, and against plain Python."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausegrid.llm import components, decontaminate, exact_dedup, fuzzy_lines, induced_sort, language_id, license_scan, ngram_join, piece_codec, secret_scan, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node long, bucket int, _key int, row_key int, TEXT string, DOC_ID string, Lang int, c0 int, Key string"
ODD = [
    (1, None), (2, ""), (3, "   \n\n "), (4, "Halo dunia"), (5, "Halo dunia"), (5, "Halo dunia"), (6, "é日本🎉 \x00 AKIA"), (7, "x" * 30_000), (8, "kata " * 9000), (9, "kata " * 9000 + "akhir"),
    (10, "123 456"), (None, "tanpa nomor"), (None, "tanpa nomor"), (11, "HALO DUNIA"), (12, "a\r\nb\tc"),
    (13, "kata lain " * 100_000), (None, "nomor lain"), (14, "kalimat yang sama dua kali"), (14, "kalimat yang berbeda sekali ini"),
]


def odd(spark, rows=ODD):
    return spark.createDataFrame([(i, t, "id" if i and i % 2 else None, "s", len(t or ""), "k", 0, 1, 2, 3, "lain", "7", 5, 6, "K") for i, t in rows], SCHEMA)


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words1(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))


def words7(t):
    return re.findall(r"[^\x20\x09-\x0D]+", low(t))


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def prose(rng, vocabulary, n):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Documents with copies, near copies, shared passages and repeated lines."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    passages = [prose(rng, vocabulary, 45) for _ in range(6)]
    texts = ["\n".join(prose(rng, vocabulary, rng.randint(5, 40)) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    texts += [rng.choice(texts) for _ in range(15)]
    for _ in range(50):
        w = re.split(r"(\s)", rng.choice(texts[:6]))
        for _ in range(rng.randint(1, 6)):
            w[2 * rng.randrange(len(w) // 2)] = rng.choice(vocabulary)
        texts.append("".join(w))
    texts += [prose(rng, vocabulary, 20) + " " + rng.choice(passages) + " " + prose(rng, vocabulary, 20) for _ in range(30)]
    rng.shuffle(texts)
    return [(k + 100, t) for k, t in enumerate(texts)] + [(1, None), (2, ""), (3, "a b"), (4, "a  B")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_empty_tables(spark):
    none = odd(spark).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([], "item_id long, text string")
    frames = [
        exact_dedup.exact_dedup(none), decontaminate.find(none, benchmark), decontaminate.remove(none, benchmark), language_id.predict(none, language_id.learned(none)), language_id.keep_known(none, language_id.learned(none)),
        secret_scan.find(none), license_scan.find(none, license_scan.fit(none)), ngram_join.similar(none), toxicity.predict(none, toxicity.fit(none, labels, F.lit(True))), fuzzy_lines.drop_lines(none), piece_codec.encode(none), suffix_dedup.drop_repeats(none),
        exact_dedup.drop_copies(none), ngram_join.keep_one(none),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_odd_rows_are_all_answered(spark):
    docs, n = odd(spark), len(ODD)
    labels = spark.createDataFrame([(4, 1, 1), (8, 0, 0), (8, 0, 0), (9, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "kata " * 12), (2, None), (3, ""), (4, "Halo, dunia!"), (4, "halo dunia")], "item_id long, text string")
    assert exact_dedup.exact_dedup(docs).count() == n
    found = decontaminate.find(docs, benchmark)
    assert found.count() == n
    assert {r.doc_id for r in found.where("size(spans) > 0").collect()} == {4, 5, 8, 9, 11}
    predicted = language_id.predict(docs, language_id.learned(docs)).collect()
    assert len(predicted) == n
    assert {r.doc_id for r in predicted if r.lang_pred == "und"} == {1, 2, 3, 10}
    assert secret_scan.find(docs).count() == n
    assert license_scan.find(docs, license_scan.fit(docs)).count() == n
    assert ngram_join.similar(docs).count() == n
    assert toxicity.predict(docs, toxicity.fit(docs, labels, F.lit(True))).count() == n
    assert fuzzy_lines.drop_lines(docs).count() == n
    assert all(r.round_trip for r in piece_codec.encode(docs).collect())
    assert suffix_dedup.drop_repeats(docs).count() == n
    split = {t: words7(t) for _, t in ODD}
    sets = {t: frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else None for t, w in split.items()}
    classes = {(i, t or "") if sets[t] is None else sets[t] for i, t in ODD}
    for stage, left in ((exact_dedup.drop_copies, len({t or "" for _, t in ODD})), (ngram_join.keep_one, len(classes)), (lambda x: language_id.keep_known(x, language_id.learned(x)), None), (lambda x: decontaminate.remove(x, benchmark), None), (fuzzy_lines.drop_lines, n)):
        kept = stage(docs)
        assert kept.columns[: len(docs.columns)] == docs.columns
        rows = kept.collect()
        assert left is None or len(rows) == left
        assert all(r[-5:] == ("lain", "7", 5, 6, "K") or r[-7:-2] == ("lain", "7", 5, 6, "K") for r in map(tuple, rows))


def test_null_ids_are_copies_too(spark):
    same = "satu dua tiga empat lima enam tujuh delapan sembilan sepuluh sebelas dua belas"
    rows = [(None, same), (None, same), (None, same + " akhir"), (3, "lain sama sekali"), (3, same + "  akhir")]
    for subset, left in ((rows[:3], 1), (rows, 2)):
        kept = ngram_join.keep_one(frame(spark, subset), percent=80).collect()
        assert len(kept) == left
    assert {(r.doc_id, r.text) for r in kept} == {(3, "lain sama sekali"), (3, same + "  akhir")}


def test_exact_dedup(spark, corpus):
    want = collections.defaultdict(list)
    for i, t in corpus:
        want[t or ""].append(i)
    # With 3 bits of the hash almost every key holds several texts.
    for bits in (64, 3):
        for r in exact_dedup.exact_dedup(frame(spark, corpus), capacity=20, max_depth=6, key_bits=bits).collect():
            group = next(g for g in want.values() if r.doc_id in g)
            assert (r.keep_id, r.group_size, r.kept) == (max(group), len(group), r.doc_id == max(group))


def test_one_owner_task_a_bucket(spark, corpus):
    entries = exact_dedup._entries(frame(spark, corpus)).cache()
    owners = []
    for capacity in (10**6, 60, 20):
        index, directory = exact_dedup.build_index(entries, capacity, 6)
        assert index.rdd.getNumPartitions() == directory.buckets
        held = index.select("key", F.spark_partition_id().alias("owner")).collect()
        assert {r.owner for r in held if directory.bucket_of_slot[(r.key % 2**64) >> (64 - directory.depth)] != r.owner} == set() if directory.depth else True
        assert sorted(r.key for r in held) == sorted(r.key for r in entries.select("key").distinct().collect())
        owners.append(directory.buckets)
    assert owners[0] == 1 < owners[1] < owners[2]
    entries.unpersist()


def test_directory_splits_overfull_buckets():
    d = exact_dedup.Directory({0: 5, 1: 50, 2: 3, 3: 7}, capacity=10, max_depth=2)
    assert (d.depth, d.bucket_of_slot) == (2, [0, 1, 2, 2])


def test_decontaminate(spark, corpus):
    rng = random.Random(3)
    items = [(k, " ".join(words7(t)[3 : 3 + rng.randint(4, 30)])) for k, (_, t) in enumerate(corpus[:8])] + [(90, "Halo, dunia"), (91, None)]
    windows = collections.defaultdict(set)
    for k, t in items:
        w = words1(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(k)
    docs = frame(spark, corpus)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for blocks in (10**6, 20):
        got = {r.doc_id: r for r in decontaminate.find(docs, benchmark, block_words=blocks).collect()}
        for i, t in corpus:
            w, hit, of = words1(t), set(), set()
            for n in {len(k) for k in windows}:
                for a in range(len(w) - n + 1):
                    if k := windows.get(tuple(w[a : a + n])):
                        hit |= set(range(a, a + n))
                        of |= k
            assert (got[i].n_words, sum(s["end"] - s["first"] for s in got[i].spans), set(got[i]["items"])) == (len(w), len(hit), of)
    left = {r.doc_id: r.text for r in decontaminate.remove(docs, benchmark, max_coverage=1.0).collect()}
    assert not any(s in " ".join(words1(left[i])) for i, _ in corpus for s in (" ".join(k) for k in windows if len(k) == 10) if left[i])


def test_decontaminate_removes_the_same_by_any_block(spark):
    rng = random.Random(7)
    w = ["".join(rng.choice("bcdfgklmn") + rng.choice("aeiou") for _ in range(3)) + str(k) for k in range(100)]
    # Windows of one item overlap those of the next; 30 words in 100 from either of two items are more than half.
    items = [(1, " ".join(w[10:25])), (2, " ".join(w[20:34])), (3, " ".join(w[40:60])), (4, " ".join(w[60:80]))]
    other = [f"lain{k}" for k in range(100)]
    texts = [" ".join(w[5:40] + other), " ".join(w[10:40] + other[:30]), " ".join(other[:20] + w[40:70] + other[20:50]), " ".join(w[40:80] + other[:39]), None, ""]
    docs = frame(spark, list(enumerate(texts)) + [(0, texts[0])])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole, blocks = (sorted(map(str, decontaminate.remove(docs, benchmark, block_words=n).collect())) for n in (10**6, 5))
    assert whole == blocks
    assert not any(x in " ".join(whole) for x in w[10:34])
    assert "doc_id=3" not in " ".join(whole)


def test_induced_sort_against_counting():
    rng = random.Random(5)
    for _ in range(300):
        alphabet = rng.choice([b"ab", b"a", b"abc", bytes(range(245))])
        base = bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        texts = [base[rng.randint(0, len(base)) :] if rng.random() < 0.6 else bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(0, 6))]
        depth = rng.choice([1, 3, 9, 17])
        count = collections.Counter(t[i : i + depth] for t in texts for i in range(len(t) - depth + 1))
        want = [x for t in texts for x in [*(i + depth <= len(t) and count[t[i : i + depth]] > 1 for i in range(len(t))), False]] + [False]
        assert induced_sort.repeated(texts, depth, rng.choice([induced_sort.MEMORY, 64])).tolist() == want


def test_suffix_dedup(spark, corpus):
    rows = corpus + [(50, "ab" * 200), (51, "z" * 500), (52, "y" * 39)]
    texts = [(t or "").encode() for _, t in rows]
    for depth, more in ((40, {}), (200, {}), (9, {"shard_bytes": 2000, "memory": 5000})):
        count = collections.Counter(t[i : i + depth] for t in texts for i in range(len(t) - depth + 1))
        got = {r.doc_id: r for r in suffix_dedup.drop_repeats(frame(spark, rows), depth, **more).collect()}
        for (i, _), t in zip(rows, texts):
            gone = [False] * len(t)
            for a in range(len(t) - depth + 1):
                if count[t[a : a + depth]] > 1:
                    gone[a : a + depth] = [True] * depth
            kept = bytes(b for b, g in zip(t, gone) if not g)
            assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(t), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), sha(kept))


def linked(sets, percent):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize(("percent", "words", "frequent"), [(85, 4, 32), (85, 4, 2), (80, 5, 5)])
def test_ngram_join(spark, corpus, monkeypatch, percent, words, frequent):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    sets = {}
    for i, t in corpus:
        w = words7(t)
        sets[i] = frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()
    want = linked(sets, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar(frame(spark, corpus), percent, words).collect()}
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    want = linked({i: {i} for e in links for i in e}, 101)
    for a, b in links:
        x, y = want[a], want[b]
        want = {k: min(x, y) if v in (x, y) else v for k, v in want.items()}
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    for small in (10**6, 0):
        assert dict(map(tuple, components.components(df, small).collect())) == {k: v for k, v in want.items() if k != v}


def test_fuzzy_lines(spark, corpus):
    line = "satu dua tiga empat lima enam tujuh delapan sembilan sepuluh " * 8
    rows = corpus + [(5000, line + "akhir\nunik baris ini saja"), (5001, line.replace("tujuh delapan", "tujuh  delapan,") + "AKHIR\n\n!!"), (5002, "unik baris ini saja\nlain")]
    got = {r.doc_id: r for r in fuzzy_lines.drop_lines(frame(spark, rows)).collect()}
    assert (got[5000].n_removed, got[5001].text, got[5002].text) == (0, "\n!!", "lain")
    # Of lines with one normal form exactly one is left in the whole table.
    normal = lambda x: " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[0-9]", "0", low(x))))
    before = {normal(x) for _, t in rows for x in (t or "").split("\n")} - {""}
    after = collections.Counter(normal(x) for r in got.values() for x in (r.text or "").split("\n"))
    assert max(after[k] for k in before) == 1
    assert sum(r.n_removed for r in got.values()) == sum(len([1 for x in (t or "").split("\n") if normal(x)]) for _, t in rows) - sum(v for k, v in after.items() if k)


def test_every_line_with_a_close_line_has_a_pair():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(4)
    keys, sketches = [], []
    for k in range(60):  # stars: variants are close to their centre, not to each other
        centre = rng.getrandbits(64)
        own = [centre] + [centre ^ sum(1 << k for k in rng.sample(range(64), 15)) for _ in range(4)]
        keys += [k // 3] * len(own)
        sketches += own
    nodes = rng.sample(range(10**6), len(sketches))
    close = {(min(a, b), max(a, b)) for k, (a, x) in enumerate(zip(nodes, sketches)) for j, (b, y) in enumerate(zip(nodes[:k], sketches)) if (x ^ y).bit_count() <= 22 and keys[j] == keys[k]}
    blob = b"".join(np.array(x, t).tobytes() for x, t in ((nodes, np.int64), (sketches, np.uint64), (keys, np.uint32), ([50] * len(nodes), np.int16)))
    found = [r for batch in fuzzy_lines._close((22, 22), 0.8)(iter([pa.RecordBatch.from_arrays([pa.array([blob])], ["blob"])])) for r in batch.to_pylist()]
    pairs = {(r["a"], r["b"]) for r in found if r["kind"] == fuzzy_lines.PAIR}
    assert pairs <= close
    assert {x for p in pairs for x in p} == {x for p in close for x in p}
    keyed = [r for r in found if r["kind"] == fuzzy_lines.KEYED]
    again = pa.RecordBatch.from_pydict({"node": [r["a"] for r in keyed], "key": [r["b"] for r in keyed], "sketch": [r["sketch"] for r in keyed], "size": [r["size"] for r in keyed], "group": [r["a"] for r in keyed]})
    assert {(r["a"], r["b"]) for batch in fuzzy_lines._close_again((22, 22), 0.8)(iter([again])) for r in batch.to_pylist()} == close


def test_cuts_tell_lines_apart_and_lose_none():
    r = random.Random(7)
    words = ["".join(r.choices("abcdefghijé漢", k=r.randint(2, 9))) for _ in range(400)]
    pairs = []
    for _ in range(300):
        x = r.choices(words, k=r.randint(1, 120))
        y = [w for v in x for w in ([], [v], [r.choice(words)], [v, r.choice(words)])[r.choices((1, 2, 0, 3), (90, r.choice((2, 8, 80)), 2, 2))[0]]] or ["a"]
        pairs.append(tuple(sorted((" ".join(x), " ".join(y)), key=len, reverse=True)))
    most = [int(fuzzy_lines._most(len(a), 0.8)) for a, _ in pairs]
    distances = [fuzzy_lines.distance(a, b) for a, b in pairs]
    near = [k for k, (a, b) in enumerate(pairs) if len(a) - len(b) <= most[k]]
    far = dict(zip(near, fuzzy_lines.far_apart([(*pairs[k], most[k]) for k in near]).tolist()))
    assert not any(far[k] for k in near if distances[k] <= most[k])
    assert sum(far.values()) > sum(distances[k] > 2 * most[k] for k in near) * 0.9 > 0
    assert all(fuzzy_lines._walked(a, b, 10**9) >= d for (a, b), d in zip(pairs, distances))
    assert fuzzy_lines.all_alike(iter(pairs)).tolist() == [d <= m for d, m in zip(distances, most)]


def test_distances_of_many_pairs_together():
    r = random.Random(11)
    pairs = []
    for n in [r.randint(1, 70) for _ in range(150)] + [r.randint(60, 420) for _ in range(150)] + [900, 1500]:
        x = r.choices("abcdeé漢\U0001f600 ", k=n)
        y = [c for v in x for c in ([v], [r.choice("abcdeé ")], [], [v, "z"])[r.choices(range(4), (90, r.choice((1, 10, 40)), r.choice((1, 9)), r.choice((1, 9))))[0]]] or ["a"]
        a, b = sorted(("".join(x), "".join(y)), key=len, reverse=True)
        d = fuzzy_lines.distance(a, b)
        pairs += [(a, b, most) for most in {d - 1, d, d + r.randint(1, 9), len(a) // 5} if len(a) - len(b) <= most]
    want = [fuzzy_lines.distance(a, b) <= most for a, b, most in pairs]
    assert fuzzy_lines.within(pairs).tolist() == want and 0.3 < sum(want) / len(want) < 0.9
    pairs.sort(key=lambda p: -len(p[0]))
    assert fuzzy_lines._within(pairs).tolist() == [fuzzy_lines.distance(a, b) <= most for a, b, most in pairs]
    assert fuzzy_lines.within([]).tolist() == []


def test_one_scan_gives_lines_and_occurrences(spark):
    from clausegrid.llm import common

    rows = [(None, "aa bb\n\ncc dd\naa  bb"), (7, "!!\ncc dd\nee ff"), (3, "ee ff 1"), (5, ""), (6, None)]
    docs = frame(spark, rows).select(F.col("doc_id").cast("bigint"), "text", F.monotonically_increasing_id().alias("row_key"))
    key = {r.text: r.row_key for r in docs.collect()}
    scanned = fuzzy_lines._scanned(docs, 3)
    gathered = scanned.groupBy("bucket").applyInArrow(fuzzy_lines._gathered(fuzzy_lines.BITS, 0.8), fuzzy_lines._FOUND)
    gathered = gathered.persist()
    nodes = {t: int(fuzzy_lines.lines_of(*(lambda x: (x, np.array([0, len(x)])))(np.frombuffer(t.encode(), np.uint8)))[2][0]) for t in ("aa bb", "cc dd", "ee ff", "ee ff 1")}
    only = lambda *t: common.Marks(spark.createDataFrame([(nodes[x],) for x in t], "node bigint"))
    # Of a node with several occurrences what comes first by document, a null one last; those of one occurrence only where wanted.
    got = {r.node: (r.first.doc_id, r.first.row_key, r.first.number, r.rows) for r in fuzzy_lines._lines(gathered, only("ee ff"), True).collect()}
    assert got == {nodes["aa bb"]: (None, key[rows[0][1]], 0, 2), nodes["cc dd"]: (7, key[rows[1][1]], 1, 2), nodes["ee ff"]: (7, key[rows[1][1]], 2, 1)}
    got = sorted((r.row_key, r.number) for r in fuzzy_lines._occurrences(gathered, only("aa bb", "ee ff 1")).collect())
    assert got == sorted([(key[rows[0][1]], 0), (key[rows[0][1]], 3), (key[rows[2][1]], 0)])
    places = spark.createDataFrame([(nodes["cc dd"], key[rows[1][1]], 1), (nodes["aa bb"], key[rows[0][1]], 3)], "node bigint, row_key bigint, number int")
    assert {(r.node, bytes(r.found)) for r in fuzzy_lines._texts(docs, places).collect()} == {(nodes["cc dd"], b"cc dd"), (nodes["aa bb"], b"aa bb")}


def test_cheap_costs_bound_the_distance():
    r = random.Random(5)
    for _ in range(3000):
        a, b = (" ".join(r.choices(["a", "bb", "ccc", "dddd", "e", "ffffffff"], k=r.randint(1, 14))) for _ in "ab")
        d = fuzzy_lines.distance(a, b)
        assert fuzzy_lines._anchored(a, b, 99) >= d and fuzzy_lines._anchored(a, b, 3) >= d and fuzzy_lines._apart(a, b) <= d
        assert fuzzy_lines.alike(a, b) == (d <= int(fuzzy_lines._most(max(len(a), len(b)), 0.8)))


def test_votes_of_long_runs():
    bits = np.random.default_rng(1).integers(0, 2, (6000, 64)).astype(np.uint8)
    for heads in ([0, 1, 256, 511, 800], [0, 255], [0]):
        sizes = np.diff([*heads, len(bits)])
        assert (fuzzy_lines._votes(bits, np.array(heads), sizes) == np.add.reduceat(bits, heads, axis=0, dtype=np.int32)).all()


def test_fuzzy_lines_against_all_pairs(spark):
    rng = random.Random(17)
    vocabulary = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(900)]
    texts = []
    for n in (14, 30, 60, 100):
        for _ in range(2):
            centre = [rng.choice(vocabulary) for _ in range(n)]
            star = [list(centre) for _ in range(5)]
            for variant in star:  # each one word from the centre
                variant[rng.randrange(n)] = rng.choice(vocabulary)
            chain = [list(centre)]
            for _ in range(4 + n // 8):  # each one word from the one before; the last ones are too far from the first
                chain.append(list(chain[-1]))
                chain[-1][rng.randrange(n)] = rng.choice(vocabulary)
            texts += [" ".join(x) for x in [*star, *chain]]
    rng.shuffle(texts)
    root = dict(enumerate(texts))
    root = {k: k for k in root}
    for a in root:
        for b in range(a):
            if root[a] != root[b] and fuzzy_lines.alike(texts[a], texts[b]):
                root = {k: min(root[a], root[b]) if v in (root[a], root[b]) else v for k, v in root.items()}
    got = {r.doc_id: r.n_removed for r in fuzzy_lines.drop_lines(frame(spark, list(enumerate(texts)))).collect()}
    assert got == {k: int(root[k] != k) for k in root}


@pytest.mark.parametrize(("edits", "least"), [(1, {6: 0.7, 12: 0.95, 25: 0.98, 50: 0.98, 120: 0.98}), (2, {12: 0.7, 25: 0.93, 50: 0.98, 120: 0.98}), (3, {25: 0.75, 50: 0.95, 120: 0.98})])
def test_fuzzy_recall_by_length(edits, least):
    import numpy as np

    rng = random.Random(edits)
    vocabulary = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    for n, wanted in least.items():
        lines = []
        while len(lines) < 400:
            one = [rng.choice(vocabulary) for _ in range(n)]
            two = list(one)
            for k in rng.sample(range(n), edits):
                two[k] = rng.choice(vocabulary)
            if one != two and fuzzy_lines.alike(" ".join(one), " ".join(two)):
                lines += [" ".join(one), " ".join(two)]
        raw = np.frombuffer("\n".join(lines).encode(), np.uint8)
        *_, sketch, _, (*_, first, hashed) = fuzzy_lines.lines_of(raw, np.array([0, len(raw)]))
        keys = collections.defaultdict(set)
        for k, key in zip(*(x.tolist() for x in fuzzy_lines.block_keys(hashed, first))):
            keys[k].add(key)
        found = [bool(keys[k] & keys[k + 1]) and ((int(sketch[k]) ^ int(sketch[k + 1])) & (1 << 64) - 1).bit_count() <= fuzzy_lines.BITS[max(len(lines[k]), len(lines[k + 1])) >= fuzzy_lines.SHORT] for k in range(0, len(lines), 2)]
        assert sum(found) >= wanted * len(found), (n, sum(found) / len(found))


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert fuzzy_lines.distance(a, b) == row[-1]
        assert fuzzy_lines.alike(a, b) == (row[-1] <= int(0.2 * max(len(a), len(b)) + 1e-9))


def test_secret_scan(spark):
    rng = random.Random(9)
    token = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rows = [
        (1, 'é password = "hunter2-abc" TOKEN:abc secret:token:abcdefgh'), (2, f"AKIA{token(16, 'ABC123')} AKIAshort"), (3, token(40, "0123456789abcdef") + "g"), (4, None), (5, "paſsword=abcdefgh"),
        *((100 + k, " ".join(rng.choice(["internationalisierungen", "donaudampfschifffahrtsgesellschaft"]) for _ in range(40)) + " " + token(44, base64) * (k % 2)) for k in range(40)),
    ]
    got = {r.doc_id: r for r in secret_scan.find(frame(spark, rows)).collect()}
    for i, t in rows:
        assert [tuple(s) for s in got[i].base] == secret_scan.base_spans(t or "")
    assert [tuple(s) for s in got[1].base] == [(2, 0, 25)]
    assert got[5].base == []
    added = {i: len(r.spans) - len(r.base) for i, r in got.items()}
    assert sum(added[100 + k] for k in range(1, 40, 2)) >= 15
    assert sum(added[100 + k] for k in range(0, 40, 2)) == 0


def test_random_tokens_without_long_words(spark):
    rng = random.Random(21)
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rows = [(k, "kata lain " + "".join(rng.choice(base64) for _ in range(44)) + " akhir") for k in range(30)]
    got = secret_scan.find(frame(spark, rows + [(50, "wxyz1234" * 6 + " bagian " + "x1" * 20), (51, None)])).collect()
    assert sum(any(s.kind == 3 for s in r.spans) for r in got if r.doc_id is not None and r.doc_id < 30) >= 22
    assert not any(r.spans for r in got if r.doc_id >= 50)
    # Like words, false tokens do not pass.
    worst = secret_scan.thresholds(secret_scan.simulated().astype(float), 0 * secret_scan.simulated())
    assert worst == [2.0] * len(secret_scan.LENGTHS)


def test_license_scan(spark):
    rows = [(1, "Isi biasa.\nLicensed under the Apache License, Version 2.0.\nLagi."), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "Released under the MIT License."), (4, "Licensed under CC BY-NC 4.0."), (5, "the license of the work was under review by the public"), (6, None)]
    docs = frame(spark, rows)
    got = {r.doc_id: [f.family for f in r.found] for r in license_scan.find(docs, license_scan.fit(docs)).collect()}
    assert got == {1: ["Apache-2.0"], 2: ["GPL"], 3: ["MIT"], 4: ["CC-BY-NC"], 5: [], 6: []}


def test_license_model_on_held_out_copies():
    rng = random.Random(6)
    model = license_scan.train([["kata", "lain", str(k)] for k in range(50)])
    right = total = 0
    for family, texts in license_scan.TEMPLATES.items():
        for text in texts:
            w = license_scan.split(text)
            for _ in range(10):
                copy = " ".join(x for x in w if rng.random() > 0.03)
                import numpy as np

                raw = np.frombuffer(copy.encode(), np.uint8)
                ((_, found),) = license_scan.scan(raw, np.array([0, len(raw)]), model)
                total += 1
                right += [f[0] for f in found] == [family]
    assert right >= 0.9 * total


def test_language_id(spark):
    rng = random.Random(8)
    words = {"id": "yang dan dengan untuk dalam tidak adalah pasal wajib dapat".split(), "de": "der die und nicht ein sich auf für über schon".split(), "fr": "le la les des est que pour dans avec être".split()}
    rows = [(k, prose(rng, words[lang], rng.randint(8, 40)), lang) for k in range(400) for lang in [rng.choice(list(words))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.predict(docs, language_id.learned(docs)).collect()}
    held = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].lang_pred == lang for i, lang in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language_id.keep_known(docs, language_id.learned(docs)).count() >= 0.98 * len(rows)


def test_toxicity(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("bcdfgklmn") + rng.choice("aeiou") for _ in range(3)) for _ in range(200)]
    rows = [(k, prose(rng, words, 60) + (" idiot scum " if k % 5 == 0 else " ") + prose(rng, words, 30), int(k % 5 == 0)) for k in range(900)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, language_id.remainder(F.col("doc_id"), 5) != 0)
    got = {r.doc_id: r.score for r in toxicity.predict(docs, model).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((got[i] >= 0.5) == bool(y) for i, y in held)
    ((start, stop, p),) = toxicity.passages(rows[0][1], model)
    assert rows[0][1].encode()[start:stop] == b"idiot scum" and p < 0.01


def test_toxic_terms_that_are_rare_each(spark):
    import numpy as np

    toxic, other = np.zeros(toxicity.BUCKETS), np.full(toxicity.BUCKETS, 5.0)
    toxic[7], other[7] = 150, 0
    assert toxicity.log_odds(toxic, other, (8000, 8000))[7] > 1
    rng = random.Random(14)
    words = ["".join(rng.choice("bcdfgklmn") + rng.choice("aeiou") for _ in range(3)) for _ in range(200)]
    terms = [f"zq{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(70)]  # each in 1.4 % of toxic documents
    rows = [(k, prose(rng, words, 15) + (f" {rng.choice(terms)} " if k % 4 == 0 else " ") + prose(rng, words, 15), int(k % 4 == 0)) for k in range(6000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.predict(docs, toxicity.fit(docs, labels, language_id.remainder(F.col("doc_id"), 5) != 0)).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    recall = sum(got[i] for i, y in held if y) / sum(y for _, y in held)
    assert not any(got[i] for i, y in held if not y)
    assert recall >= 0.75  # terms in fewer than nine counted documents are not significant


def test_several_moderate_passages_count_together():
    import numpy as np

    table = np.full(toxicity.BUCKETS, -0.25, np.float32)
    mark = lambda w: int(toxicity.token_rows(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[2][0])
    table[mark(b"idiot")] = 3.0
    model = toxicity.Model(table, 1.0, -4.0)
    text = lambda n: ("kata " * 40 + "idiot ") * n + "kata " * 41 * (12 - n)
    raw = [text(n).encode() for n in (1, 12)]
    (one, none), (many, all_of) = toxicity.judge(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]), model)
    assert none == [] and many > one + 5
    assert [raw[1][a:b] for a, b, _ in all_of] == [b"idiot"] * 12


def test_segments_are_maximal():
    import numpy as np

    found = toxicity.segments(np.array([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5], float))
    assert [(a, b, s) for a, b, s in found] == [(0, 1, 4.0), (2, 3, 3.0), (4, 11, 7.0)]


def test_texts_of_no_language_are_rejected(spark):
    rng = random.Random(8)
    words = {"id": "yang dan dengan untuk dalam tidak adalah pasal wajib dapat".split(), "de": "der die und nicht ein sich auf fuer ueber schon".split()}
    rows = [(k, prose(rng, words[lang], rng.randint(20, 40)), lang) for k in range(600) for lang in [rng.choice(list(words))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learned(docs)
    junk = [(k, " ".join("".join(rng.sample(w, len(w))) for w in "qzxwv jjkqx vvbzq xxqjz kwqzz".split() for _ in range(6))) for k in range(50)]
    assert sum(r.rejected for r in language_id.predict(frame(spark, junk), model).collect()) >= 45
    assert sum(r.rejected for r in language_id.predict(docs, model).collect()) <= 6


def test_every_language_is_learned(spark):
    docs = spark.createDataFrame([(k * 8 + c, f"{chr(97 + k % 26)}{chr(97 + k // 26)}o" * 12, f"x{k:03}") for k in range(240) for c in range(8)], "doc_id long, text string, lang string")
    assert len(language_id.learned(docs).languages) >= 238  # every one has learnable rows; a hash may miss one


def test_unigram_pieces_match_the_library(tmp_path):
    sentencepiece = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2

    rng = random.Random(3)
    model = sentencepiece_model_pb2.ModelProto()
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback = piece_codec.UNIGRAM, True
    model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces, model.normalizer_spec.escape_whitespaces = True, False, True
    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)] + [(f"<0x{b:02X}>", 0, 6) for b in range(256)] + [(c, -8 - k / 8, 1) for k, c in enumerate("abcdé日▁")]
    words = {rng.choice(["▁", ""]) + "".join(rng.choice("abcdé日") for _ in range(rng.randint(2, 6))) for _ in range(300)}
    for piece, score, kind in pieces + [(w, -2 - rng.randrange(100) / 8, 1) for w in sorted(words)]:  # eighths add up exactly
        model.pieces.add(piece=piece, score=score, type=kind)
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    library, codec = sentencepiece.SentencePieceProcessor(model_file=str(path)), piece_codec.Codec(str(path))
    score = {k: p.score for k, p in enumerate(model.pieces)}
    texts = ["".join(rng.choice("abcdé日 x🎉") for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["".join(rng.choice("abcdé日x") for _ in range(rng.randint(70, 300))) for _ in range(60)]
    ids, ends = codec.encode([t.encode() for t in texts])
    for k, t in enumerate(texts):
        own, theirs = ids[ends[k] : ends[k + 1]].tolist(), library.encode(t)
        assert sum(score[i] for i in own) == sum(score[i] for i in theirs) and library.decode(own) == t


def test_piece_codec_matches_the_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=piece_codec.MODEL)
    rng = random.Random(1)
    texts = ["Hello world", "  two  spaces   here ", "a\n\nb", "日本語 🎉", "x" * 200, "", " " * 40, "naïve\tcafé\x00", "人工智能" * 90, "x" * 3000, "=-" * 100, "日本語テキスト" * 20 + "  " + "한국어" * 40] + ["".join(rng.choice(of) for _ in range(rng.randint(0, 40))) for of in ("ab ", "etaoin  ", "aé日🎉 \n", "thetionin") for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokens = piece_codec.encode(docs)
    got = {r.doc_id: r for r in tokens.collect()}
    assert all(got[k].token_ids == library.encode(t) and got[k].round_trip for k, t in enumerate(texts))
    assert {r.doc_id: r.text for r in piece_codec.decode(tokens).collect()} == dict(enumerate(texts))


def test_checkpoints_collect_the_drivers_garbage(spark, monkeypatch):
    from clausegrid import checkpoints

    seen = []
    monkeypatch.setattr(checkpoints, "release", seen.append)
    for _ in range(checkpoints.RELEASE_AFTER):
        checkpoints.checkpoint(spark.range(1))
    assert len(seen) == 1


def test_encoding_takes_small_batches(spark):
    docs = spark.createDataFrame([(1, "eins zwei")], "doc_id long, text string")
    assert [r["round_trip"] for r in piece_codec.encode(docs).collect()] == [True]
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4m" and piece_codec.BLOCK <= 1 << 20


def test_a_units_substrings_are_probed_a_length_at_a_time(monkeypatch):
    codec, called = piece_codec.Codec(), []
    monkeypatch.setattr(codec, "stay", lambda a, b: codec._stay(a, b))
    monkeypatch.setattr(codec, "_key", lambda raw, size, real=codec._key: called.append(len(raw)) or real(raw, size))
    unit = np.frombuffer(b" internationalisation-of-representatives-and-understanding-them", np.uint8)
    ids, n = codec.viterbi(np.stack([unit, unit[::-1]]))
    assert ids.tolist() == codec.merge(unit.tobytes()) + codec.merge(unit[::-1].tobytes()) and n.sum() == len(ids)
    assert len(called) < 8 * len(unit)  # and not a call for each start and end


def test_checkpoints_leave_few_shuffle_files(spark, monkeypatch):
    from clausegrid import checkpoints

    monkeypatch.setattr(checkpoints, "_written", [0])
    on_disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    checkpoints.release(spark)
    time.sleep(1)
    files = []
    for k in range(12):
        checkpoints.checkpoint(spark.range(1000, numPartitions=20).selectExpr(f"id % 97 + {k} as id").distinct())
        files.append(on_disk.getAllFiles().size())
    assert max(files) - files[0] < 6 * 60  # a shuffle of 20 tasks has 60 files
