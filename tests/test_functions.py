"""Scalar functions: text, numerals, markers, headings, citations."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from clausegrid.functions import headings, markers, numerals, references
from clausegrid.functions import text as T


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_normalize(spark):
    assert column(spark, ["“a” ‘b’…", "x   y\tz ", "a​b­", "–—−", "", None], T.normalize) == ["\"a\" 'b'...", "x y z", "ab", "---", "", None]


def test_aggressive_and_bare(spark):
    assert column(spark, ["Pasal 1, (Ayat)!", "--"], T.normalize_aggressive) == ["pasal 1 ayat", ""]
    assert column(spark, ["Pihak, Pertama."], T.strip_punctuation) == ["Pihak Pertama"]


def test_tokens_are_lossless(spark):
    text = "a1, b  é!\n日本"
    assert "".join(column(spark, [text], T.tokens)[0]) == text


def test_snippet_and_clip(spark):
    assert column(spark, ["a " * 60], T.snippet)[0] == ("a " * 24).strip() + "…"
    assert column(spark, ["abcdef", "abc"], lambda c: T.clip(c, 3, "...")) == ["abc...", "abc"]


def test_title_case_and_language(spark):
    assert column(spark, ["KETENTUAN UMUM", "Ketentuan", "AB"], T.is_title_case) == [True, False, False]
    votes = column(spark, ["yang dan dengan", "the party hereof", "xyz"], lambda c: T.language(*T.language_votes(c)))
    assert votes == ["id", "en", ""]


def test_heading_renumber_title(spark):
    title = lambda a, b: column(spark, [b], lambda c: T.change_title(F.lit("modified"), F.lit(False), F.lit(a), c, F.lit("Pasal 1")))[0]
    assert title("PASAL 5", "PASAL 8") == "Penomoran diubah: PASAL 5 → PASAL 8"
    assert title("jangka waktu 30 hari", "jangka waktu 60 hari") == "Teks diubah pada Pasal 1"
    assert title('x "y"', "") == 'Teks dihapus pada Pasal 1: "x \\"y\\""'


def test_article_of(spark):
    assert column(spark, ["pasal:3/ayat:2", "root/huruf:a", "bab:IV", "root/article:2/x:1", ""], T.article_of) == ["pasal:3", "", "", "article:2", ""]


def test_numerals_round_trip(spark):
    n = list(range(1, 200)) + [444, 999, 3999]
    assert column(spark, n, lambda c: numerals.parse_roman(numerals.roman(c)), "int") == n
    assert column(spark, n, lambda c: numerals.parse_alpha(numerals.alpha(c)), "int") == n
    assert column(spark, ["IIII", "ic", "", None, "abc"], numerals.parse_roman) == [None] * 5


def test_article_number(spark):
    assert column(spark, ["12", "2.3", "IV", "y", ""], numerals.article_number) == [12, 3, 4, None, None]


@pytest.mark.parametrize(
    ("text", "kind", "form", "ordinal", "alt"),
    [
        ("(1) isi", "DIGIT", "BRACKET", 1, None), ("( a ) isi", "LOWER", "BRACKET", 1, None), ("1. isi", "DIGIT", "DOT", 1, None),
        ("a) isi", "LOWER", "PAREN", 1, None), ("iv. isi", "L_ROM", "DOT", 4, 256), ("c. isi", "L_ROM", "DOT", 100, 3), ("IX) x", "U_ROM", "PAREN", 9, 258),
        ("1.2 isi", "DECIMAL", "BARE", 2, None), ("1.2.7. isi", "DECIMAL", "DOT", 7, None), ("PT. ABC", "UPPER", "DOT", 436, None),
    ],
)
def test_markers(spark, text, kind, form, ordinal, alt):
    m = column(spark, [text], markers.parse_marker)[0]
    assert (m.kind, m.form, m.ordinal, m.alt_ordinal) == (kind, form, ordinal, alt)


def test_no_markers(spark):
    assert column(spark, ["Dst. x", "No. 3", "(abcde) x", "0. x", "prose", "", None, "1.2x"], markers.parse_marker) == [None] * 8


def test_headings(spark):
    found = column(spark, ["Pasal 12", "BAB IV", "Bagian Kedua Belas", "Bagian dari x", "dalam Pasal 1", "Article 2.3 x", "paragraf 3"], headings.parse_heading)
    assert [(h.kind, h.number, h.ordinal) if h else None for h in found] == [("pasal", "12", 12), ("bab", "IV", 4), ("bagian", "Kedua Belas", 12), None, None, ("article", "2.3", 3), ("paragraf", "3", 3)]


def test_citations():
    text = "Pasal 5 ayat (2) huruf B dan Section 7(a), lalu ayat (3), huruf c, angka 2"
    found = references.extract(text)
    assert [(r["kind"], r["lang"], r["pasal"], r["ayat"], r["huruf"], r["angka"]) for r in found] == [("absolute", "id", "5", "2", "b", ""), ("absolute", "en", "7", "", "a", ""), ("relative", "id", "", "3", "", ""), ("relative", "id", "", "", "c", ""), ("relative", "id", "", "", "", "2")]
    assert all(text[r["start"] : r["end"]] == r["raw"] for r in found)
    assert references.extract("Pasal 12", skip=8) == []


def test_targets(spark):
    df = spark.createDataFrame([("id", "12", "3", "a", "1"), ("en", "5", "", "", ""), ("id", "", "3", "", "")], "lang string, pasal string, ayat string, huruf string, angka string")
    out = df.select(references.target_id(*map(F.col, df.columns)).alias("t"), references.citation(*map(F.col, df.columns)).alias("c")).collect()
    assert [tuple(r) for r in out] == [("pasal:12/ayat:3/huruf:a/angka:1", "Pasal 12 ayat (3) huruf a angka 1"), ("article:5", "Article 5"), ("", "ayat (3)")]
