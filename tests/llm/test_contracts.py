"""The queries as they are registered, and the pipeline, against plain Python on a small fixture."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import duckdb
import pytest

import corpus_pipeline
from clausegrid.llm import queries
from tests.llm.test_documents import linked, prose, sha, words1, words7

BENCH = "tentang benda kecil yang jatuh dari atas meja lalu pecah menjadi seribu keping di lantai rumah"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """documents, benchmark and labels with copies, near copies, leaks, secrets, toxic words and repeated lines; and the documents' rows."""
    rng = random.Random(5)
    vocabulary = {lang: ["".join(rng.choice(c) + rng.choice(v) for _ in range(rng.randint(1, 4))) for _ in range(300)] for lang, c, v in (("aa", "bdgkl", "ae"), ("bb", "mnprst", "iou"))}
    texts = []
    for k in range(60):
        lang = rng.choice("ab") * 2
        texts.append(("\n".join(prose(rng, vocabulary[lang], rng.randint(8, 40)) for _ in range(rng.randint(1, 4))), lang))
    for k in range(6):
        text, lang = texts[k]
        texts += [(text, lang), (text, lang), (text.replace(" ", "  ", 1), lang), (text + " " + vocabulary[lang][0], lang)]
    texts += [(prose(rng, vocabulary["aa"], 30) + " " + BENCH.upper() + ", " + prose(rng, vocabulary["aa"], 30), "aa") for _ in range(3)]
    texts += [(prose(rng, vocabulary["bb"], 20) + f' api_key = "{"".join(rng.choice("abcXYZ019") for _ in range(24))}" é AKIA{"B7" * 9} ' + "0a9f" * 9, "bb") for _ in range(3)]
    for k in range(600):
        lang = rng.choice("ab") * 2
        texts.append((prose(rng, vocabulary[lang], 40) + (" dungu keparat " if k % 2 else " ") + prose(rng, vocabulary[lang], 10), lang))
    rng.shuffle(texts)
    rows = [(k + 10, t, lang if k % 7 else None) for k, (t, lang) in enumerate(texts)] + [(1, None, None), (2, "", "aa"), (3, "12 34 !", "bb"), (4, "a  B", None)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(7, BENCH), (10, "benda kecil yang jatuh dari atas meja lalu pecah menjadi debu"), (11, "benda kecil"), (12, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int("keparat" in (t or ""))) for i, t, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def run(spark, sf, name):
    got = queries.QUERIES[name](spark, sf[0]).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, *_ in sf[1])
    return {r.doc_id: r for r in got}


def crc(i):
    return zlib.crc32(str(i).encode())


def test_op1(spark, sf):
    got, windows = run(spark, sf, "op1_decontaminate"), collections.defaultdict(set)
    for k, t in ((7, BENCH), (10, "benda kecil yang jatuh dari atas meja lalu pecah menjadi debu"), (11, "benda kecil")):
        w = words1(t)
        for a in range(max(1, len(w) - 9)):
            windows[tuple(w[a : a + 10])].add(str(k))
    for i, t, _ in sf[1]:
        w, hit, of = words1(t), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if found := windows.get(tuple(w[a : a + n])):
                    hit |= set(range(a, a + n))
                    of |= found
        assert tuple(got[i])[:6] == (i, len(w), len(hit), len(of), sha(",".join(sorted(of))), bool(hit))


def test_op2(spark, sf):
    got, depth = run(spark, sf, "op2_suffix_dedup"), 200
    raw = {i: (t or "").encode() for i, t, _ in sf[1]}
    count = collections.Counter(t[a : a + depth] for t in raw.values() for a in range(len(t) - depth + 1))
    for i, t in raw.items():
        gone = [False] * len(t)
        for a in range(len(t) - depth + 1):
            if count[t[a : a + depth]] > 1:
                gone[a : a + depth] = [True] * depth
        kept = bytes(b for b, g in zip(t, gone) if not g)
        assert tuple(got[i])[:5] == (i, len(t), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), sha(kept))


def test_op3(spark, sf):
    got = run(spark, sf, "op3_exact_dedup")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf[0]}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, got.values())) == sorted(con.execute(queries.SQL["op3_exact_dedup"]).fetchall())


def test_op4(spark, sf):
    got = run(spark, sf, "op4_language_id")
    assert all(got[i].held_out == (crc(i) % 4 == 2) for i in got)
    assert all((got[i].lang_pred == "und") == (not re.search("[^\\W\\d_]", t or "")) for i, t, _ in sf[1])
    held = [(i, lang) for i, t, lang in sf[1] if lang and got[i].held_out and len(t) > 50]
    assert sum(got[i].lang_pred == lang for i, lang in held) >= 0.97 * len(held)
    assert {r.lang_pred for r in got.values()} == {"aa", "bb", "und"} and all(0 <= r.score <= 1 for r in got.values())


def test_op5(spark, sf):
    got = run(spark, sf, "op5_secret_scan")
    assign = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for i, t, _ in sf[1]:
        spans = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t or "") if len(m[2]) >= 6]
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 20]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 24]
        base = [f"{k}:{s}:{e}" for s, _, k, e in sorted(spans)]
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))
        assert got[i].base_sha256 == sha(",".join(base))
        assert set(base) <= set(got[i].spans.split(","))


def test_op6(spark, sf):
    got = run(spark, sf, "op6_license_scan")
    assert not any(r.n_licensed for r in got.values())
    assert all(got[i].n_paragraphs == sum(bool(words1(x)) for x in (t or "").split("\n")) for i, t, _ in sf[1])


def sets_of(rows, words):
    out = {}
    for i, t in rows:
        w = words7(t)
        out[i] = frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()
    return out


def test_op7(spark, sf):
    got = run(spark, sf, "op7_ngram_join")
    sets = sets_of([(i, t) for i, t, _ in sf[1]], 4)
    want = linked(sets, 85)
    assert {i: tuple(r) for i, r in got.items()} == {i: (i, len(s), want[i]) for i, s in sets.items()}


def test_op8(spark, sf):
    got = run(spark, sf, "op8_toxicity")
    assert all(r.held_out == (crc(i) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for i, r in got.items())
    assert sum(got[i].predicted == int("keparat" in (t or "")) for i, t, _ in sf[1]) >= 0.99 * len(got)
    for i, t, _ in sf[1]:
        passages = [t.encode()[slice(*map(int, x.split(":")))].decode() for x in got[i].passages.split(",") if x]
        assert not got[i].predicted or any("keparat" in x or "dungu" in x for x in passages)


def test_op9(spark, sf):
    got = run(spark, sf, "op9_fuzzy_lines")
    lines = collections.Counter(x for _, t, _ in sf[1] for x in (t or "").split("\n"))
    for i, t, _ in sf[1]:
        own = (t or "").split("\n")
        assert got[i].n_lines == (len(own) if t else 0)
        assert got[i].n_removed > 0 or got[i].kept_sha256 == sha(t or "")
    repeated = sum(n - 1 for x, n in lines.items() if words1(x))
    assert sum(r.n_removed for r in got.values()) >= repeated


def test_op10(spark, sf):
    sentencepiece = pytest.importorskip("sentencepiece")
    from clausegrid.llm import piece_codec

    library = sentencepiece.SentencePieceProcessor(model_file=piece_codec.MODEL)
    got = run(spark, sf, "op10_piece_codec")
    for i, t, _ in sf[1]:
        ids = library.encode(t or "")
        digest = hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert tuple(got[i]) == (i, len(ids), digest, True)


def test_pipeline(spark, sf):
    docs = [(i, t) for i, t, _ in sf[1] if re.search("[^\\W\\d_]", t or "")]
    docs = [(i, t) for i, t in docs if i == max(j for j, u in docs if u == t)]
    want = linked(sets_of(docs, 5), 80)
    docs = [(i, t) for i, t in docs if want[i] == i]
    left = {}
    for i, t in docs:
        found = re.search(f"(?i){BENCH}", t)
        left[i] = t[: found.start()] + t[found.end() :] if found else t
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf[0]).collect()}
    # Language ID may reject a few documents as of no language.
    assert set(got) <= set(left) and len(got) >= 0.98 * len(left)
    sentencepiece = pytest.importorskip("sentencepiece")
    from clausegrid.llm import piece_codec

    library = sentencepiece.SentencePieceProcessor(model_file=piece_codec.MODEL)
    assert all(r.token_ids == library.encode(left[i]) and r.round_trip for i, r in got.items())
    assert len(corpus_pipeline.STAGES) == 5 and [name for name, _ in corpus_pipeline.STAGES][0] == "language ID"
