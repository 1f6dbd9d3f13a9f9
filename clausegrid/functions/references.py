"""Citations: finding them, naming their targets, and writing them out."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# An absolute citation with its optional parts, what may follow one, and the three relative kinds.
ABSOLUTE = (
    r"(?i)\b(Pasal|Article|Clause|Section)\s+([0-9]+(?:\.[0-9]+)*|[IVXLCDM]{1,15})"
    r"(?:\s*(?:ayat|paragraph|para\.?)\s*\(\s*([0-9]{1,3})\s*\))?"
    r"(?:\s*(?:huruf|letter)\s+([a-zA-Z]{1,2})\b)?"
    r"(?:\s*(?:angka|number|no\.?)\s+([0-9]{1,3})\b)?"
)
SUFFIX = r"\(\s*([0-9]{1,3}|[a-zA-Z]{1,2})\s*\)"
RELATIVE = {
    "ayat": r"(?i)\bayat\s*\(\s*([0-9]{1,3})\s*\)",
    "huruf": r"(?i)\bhuruf\s+([a-zA-Z]{1,2})\b",
    "angka": r"(?i)\bangka\s+([0-9]{1,3})\b",
}


def absolute(text: Column) -> Column:
    """Absolute citations in order, as an array of (keyword, pasal, ayat, huruf, angka, lang), by JVM expressions alone."""
    # The optional suffix is one more group: it counts only where the citation names neither ayat nor huruf.
    pattern = F.lit(ABSOLUTE + rf"({SUFFIX})?")
    groups = [F.regexp_extract_all(text, pattern, F.lit(k)) for k in (1, 2, 3, 4, 5, 7)]
    rows = F.arrays_zip(*(g.alias(n) for g, n in zip(groups, ("keyword", "pasal", "ayat", "huruf", "angka", "tail"))))

    def row(r):
        bare = (r["ayat"] == "") & (r["huruf"] == "")
        number = r["tail"].rlike("^[0-9]+$")
        return F.struct(
            r["keyword"].alias("keyword"),
            r["pasal"].alias("pasal"),
            F.when(bare & number, r["tail"]).otherwise(r["ayat"]).alias("ayat"),
            F.lower(F.when(bare & ~number, r["tail"]).otherwise(r["huruf"])).alias("huruf"),
            r["angka"].alias("angka"),
            F.when(F.lower(r["keyword"]) == "pasal", "id").otherwise("en").alias("lang"),
        )

    return F.transform(rows, row)


def target_id(lang: Column, pasal: Column, ayat: Column, huruf: Column, angka: Column) -> Column:
    """The id of the node that a citation names; empty without an article."""
    part = lambda name, value: F.when(value != "", F.concat(F.lit(f"/{name}:"), value)).otherwise("")
    head = F.concat(F.when(lang == "en", "article:").otherwise("pasal:"), pasal)
    return F.when(pasal != "", F.concat(head, part("ayat", ayat), part("huruf", huruf), part("angka", angka))).otherwise("")


def citation(lang: Column, pasal: Column, ayat: Column, huruf: Column, angka: Column) -> Column:
    """A citation as it is written."""
    part = lambda before, value, after="": F.when(value != "", F.concat(F.lit(before), value, F.lit(after)))
    return F.concat_ws(" ", F.when(pasal != "", F.concat(F.when(lang == "en", "Article ").otherwise("Pasal "), pasal)), part("ayat (", ayat, ")"), part("huruf ", huruf), part("angka ", angka))


_ABSOLUTE = re.compile(ABSOLUTE, re.ASCII)
_SUFFIX = re.compile(SUFFIX, re.ASCII)
_RELATIVE = {k: re.compile(p, re.ASCII) for k, p in RELATIVE.items()}
_PARTS = ("pasal", "ayat", "huruf", "angka")


def extract(text: str, skip: int = 0) -> list[dict]:
    """All citations with character offsets: absolute ones first, then relative ones by kind that stand outside of those.

    What begins within the first ``skip`` characters (a paragraph's own heading) does not count.
    """
    out: list[dict] = []
    taken: list[tuple[int, int]] = []

    def add(start: int, end: int, kind: str, lang: str, **parts: str) -> None:
        out.append({"raw": text[start:end], "start": start, "end": end, "kind": kind, "lang": lang} | {p: parts.get(p) or "" for p in _PARTS})
        taken.append((start, end))

    for m in _ABSOLUTE.finditer(text):
        if m.start() < skip:
            continue
        word, pasal, ayat, huruf, angka = m.groups()
        end = m.end()
        if not ayat and not huruf and (tail := _SUFFIX.match(text, end)):
            end = tail.end()
            ayat, huruf = (tail[1], huruf) if tail[1].isdigit() else (ayat, tail[1])
        add(m.start(), end, "absolute", "id" if word.lower() == "pasal" else "en", pasal=pasal, ayat=ayat, huruf=(huruf or "").lower(), angka=angka)
    for part, pattern in _RELATIVE.items():
        for m in pattern.finditer(text):
            if m.start() >= skip and not any(a <= m.start() < b for a, b in taken):
                add(m.start(), m.end(), "relative", "id", **{part: m[1].lower()})
    return out
