"""Headings: the known vocabulary, and words that a document itself uses as headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import numerals

# Heading patterns in the order they are tried, with the level of each.
NUMBER = r"([0-9]{1,4}(?:\.[0-9]{1,3})*|[IVXLCDM]{1,7})"
PATTERNS = [
    ("bab", r"(?i)^\s*BAB\s+([IVXLCDM]{1,7}|[0-9]{1,3})\b"),
    ("bagian", r"(?i)^\s*Bagian\s+([A-Za-z]+(?:\s+[A-Za-z]+)?|[IVXLCDM]{1,7}|[0-9]{1,3})\b"),
    ("paragraf", r"(?i)^\s*Paragraf\s+([0-9]{1,3}|[IVXLCDM]{1,7})\b"),
    ("pasal", rf"(?i)^\s*Pasal\s+{NUMBER}\b"),
    ("article", rf"(?i)^\s*(?:Article|Clause|Section)\s+{NUMBER}\b"),
]
BEGINS = r"(?i)^\s*(?:BAB|Bagian|Paragraf|Pasal|Article|Clause|Section)\s"
DEPTHS = {"root": 0, "bab": 1, "bagian": 2, "paragraf": 3, "pasal": 4, "article": 4, "clause": 5, "ayat": 6, "huruf": 7, "angka": 8, "item": 9}
LEARNED = r"^\s*(\p{L}{2,15})\s+([0-9]{1,4}(?:\.[0-9]{1,3})*|[IVXLCDM]{1,7})\s*[.:)-]?\s*$"
MIN_HITS, MIN_ASCENDING = 3, 0.7

# Ordinal words; those from twelve to nineteen add "belas".
ORDINAL_WORDS = {"pertama": 1, "kesatu": 1, "kedua": 2, "ketiga": 3, "keempat": 4, "kelima": 5, "keenam": 6, "ketujuh": 7, "kedelapan": 8, "kesembilan": 9, "kesepuluh": 10, "kesebelas": 11}
ORDINAL_WORDS |= {f"{w} belas": n + 10 for w, n in ORDINAL_WORDS.items() if 2 <= n <= 9} | {"kedua puluh": 20}


def ordinal_word(text: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in ORDINAL_WORDS.items() for x in pair))
    return F.try_element_at(known, F.lower(F.trim(text)))


def parse_heading(text: Column) -> Column:
    """(kind, number, ordinal, label) of a paragraph that begins with a known heading, else null."""
    found = []
    for kind, pattern in PATTERNS:
        number = F.trim(F.regexp_extract(text, pattern, 1))
        ordinal = (lambda n: F.coalesce(ordinal_word(n), numerals.article_number(n))) if kind == "bagian" else numerals.article_number
        made = lambda n, kind=kind, pattern=pattern, ordinal=ordinal: F.when(n != "", F.struct(F.lit(kind).alias("kind"), n.alias("number"), ordinal(n).cast("int").alias("ordinal"), F.trim(F.regexp_extract(text, pattern, 0)).alias("label")))
        found.append(numerals.let(number, made))
    first = F.get(F.filter(F.array(*found), lambda h: h["ordinal"].isNotNull()), F.lit(0))
    return F.when(text.rlike(BEGINS), first)  # most paragraphs are done with here


def learned_vocabulary(paragraphs: DataFrame, keys: list[str], position: str, text: str) -> DataFrame:
    """(keys, word, hits, ascending): words that stand before mostly rising numbers on lines of their own.

    Lines that the known patterns read are no candidates.
    """
    word = F.lower(F.regexp_extract(text, LEARNED, 1))
    ordinal = numerals.article_number(F.regexp_extract(text, LEARNED, 2))
    found = paragraphs.where(F.col(text).rlike(LEARNED)).where(parse_heading(F.col(text)).isNull())
    found = found.select(*keys, position, word.alias("word"), ordinal.alias("ordinal")).where("ordinal is not null")
    before = F.lag("ordinal").over(Window.partitionBy(*keys, "word").orderBy(position))
    counted = found.withColumn("rises", (F.col("ordinal") > before).cast("int")).groupBy(*keys, "word").agg(F.count("*").alias("hits"), F.avg("rises").alias("ascending"))
    return counted.where((F.col("hits") >= MIN_HITS) & (F.col("ascending") >= MIN_ASCENDING))
