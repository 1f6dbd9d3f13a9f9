"""Text functions as Column expressions; none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that normalisation folds or drops, and what counts as white space.
SINGLE_QUOTES = "‘’‚′"
DOUBLE_QUOTES = "“”„″"
DASHES = "‐‑‒–—―−"
DROPPED = "­​‌‍﻿"
ELLIPSIS = "…"
SPACES = r"[\s\u0085   -     　]+"
NOT_WORD = r"[^\p{L}\p{Nd}]+"

# Letters whose full upper case is longer than one character, and the one character that stands for each instead.
WIDENED = "".join(c for c in map(chr, range(0x10000)) if len(c.upper()) > 1)
NOT_WIDENED = "".join("ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in WIDENED)

# Function words that tell the two languages apart.
INDONESIAN_WORDS = "yang dan dengan untuk dalam pada dari atau tidak adalah pasal ayat wajib dapat sebagaimana dimaksud ketentuan peraturan huruf".split()
ENGLISH_WORDS = "the and of to in shall any such this agreement article clause party hereof which".split()
TRIMMED = ".,;:()[]\"'"

# Words that begin a heading, for telling a renumbered heading from an edit.
HEADING_WORDS = "pasal article bab bagian paragraf clause section chapter".split()


def normalize(text: Column) -> Column:
    """Quotes, dashes and ellipses folded, invisible characters dropped, white space collapsed; case stays."""
    folded = F.translate(text, SINGLE_QUOTES + DOUBLE_QUOTES + DASHES + DROPPED, "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES) + "-" * len(DASHES))
    return F.trim(F.regexp_replace(F.replace(folded, F.lit(ELLIPSIS), F.lit("...")), SPACES, " "))


def strip_punctuation(text: Column) -> Column:
    """Runs of anything but letters and digits as one space; case stays."""
    return F.trim(F.regexp_replace(text, NOT_WORD, " "))


def normalize_aggressive(text: Column) -> Column:
    return strip_punctuation(F.lower(normalize(text)))


def is_cosmetic(a: Column, b: Column) -> Column:
    """Whether two texts, neither empty, differ in punctuation only."""
    return (a != "") & (b != "") & (strip_punctuation(a) == strip_punctuation(b))


def equal_ignoring_whitespace(a: Column, b: Column) -> Column:
    return normalize(a) == normalize(b)


def tokens(text: Column) -> Column:
    """Runs of letters and digits, and every other character by itself; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{Nd}]+|[^\p{L}\p{Nd}])"), F.lit(1))


def escape_html(text: Column) -> Column:
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def clip(text: Column, n: int, mark: str = "…") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def snippet(text: Column, n: int = 48) -> Column:
    """One line of at most n characters."""
    line = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(line) > n, F.concat(F.trim(F.substring(line, 1, n)), F.lit("…"))).otherwise(line)


def excerpt(text: Column, start: Column, end: Column, around: int = 60) -> Column:
    """The characters around [start, end), with dots where it was cut."""
    low = F.greatest(F.lit(0), start - around)
    high = F.least(F.length(text), end + around)
    dots = F.lit("...")
    return F.concat(F.when(low > 0, dots).otherwise(""), F.substr(text, low + 1, high - low), F.when(high < F.length(text), dots).otherwise(""))


def table_label(table: Column, row: Column, column: Column) -> Column:
    return F.when(table > 0, F.concat(F.lit("tabel "), table.cast("string"), F.lit(" baris "), row.cast("string"), F.lit(" kolom "), column.cast("string"))).otherwise("")


def is_title_case(text: Column) -> Column:
    """At least three ASCII letters, 80 in 100 of them upper-case."""
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    upper = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    return (letters >= 3) & (F.floor(upper * 100 / F.greatest(letters, F.lit(1))) >= 80)


def upper(text: Column) -> Column:
    """Upper case, one character for one; ``F.upper`` makes several of some, as SS of a sharp s."""
    text = F.replace(text, F.lit("ß"), F.lit("ẞ"))  # the only one of them in common use
    parts = F.split(text, f"(?<=[{WIDENED}])|(?=[{WIDENED}])", -1)
    single = F.array_join(F.transform(parts, lambda x: F.when(x.rlike(f"^[{WIDENED}]"), F.translate(x, WIDENED, NOT_WIDENED)).otherwise(F.upper(x))), "")
    return F.when(F.length(F.upper(text)) == F.length(text), F.upper(text)).otherwise(single)


def language_votes(text: Column) -> tuple[Column, Column]:
    """How many function words of either language a text has."""
    words = F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.btrim(w, F.lit(TRIMMED)))
    count = lambda known: F.size(F.filter(words, lambda w: w.isin(known)))
    return count(INDONESIAN_WORDS), count(ENGLISH_WORDS)


def language(id_votes: Column, en_votes: Column) -> Column:
    return F.when((id_votes == 0) & (en_votes == 0), "").when(id_votes >= en_votes, "id").otherwise("en")


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token sets; 0 where either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def token_set(text: Column) -> Column:
    """Distinct words of the aggressively normalised text."""
    return F.filter(F.array_distinct(F.split(normalize_aggressive(text), " ")), lambda x: x != "")


def article_of(node_id: Column) -> Column:
    """The article in a node's id: its first segment if that is an article or clause, else any article segment, else empty."""
    parts = F.split(node_id, "/")
    first = F.get(parts, F.lit(0))
    inner = F.get(F.filter(parts, lambda p: p.rlike("^(pasal|article):")), F.lit(0))
    return F.when(first.rlike("^(pasal|article|clause):"), first).otherwise(F.coalesce(inner, F.lit("")))


def is_heading_renumber(prev: Column, curr: Column) -> Column:
    """Whether two short headings differ in one number only."""
    a, b = F.split(F.trim(prev), r"\s+"), F.split(F.trim(curr), r"\s+")
    changed = F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: p["a"] != p["b"])
    bare = lambda x: F.btrim(x, F.lit(".:)-"))
    is_number = lambda x: bare(x).rlike("^([0-9]+|[IVXLCDMivxlcdm]+)$")
    begins = lambda x: F.lower(bare(F.get(x, F.lit(0)))).isin(HEADING_WORDS)
    one = F.get(changed, F.lit(0))
    found = (F.size(a) == F.size(b)) & (F.size(a) <= 4) & begins(a) & begins(b) & (F.size(changed) == 1) & is_number(one["a"]) & is_number(one["b"])
    return F.coalesce(found, F.lit(False))


def change_title(kind: Column, cosmetic: Column, prev: Column, curr: Column, context: Column) -> Column:
    """What a reader is told about a change, in the language of the reports."""
    prev, curr = F.trim(prev), F.trim(curr)
    where = F.when(context != "", F.concat(F.lit(" pada "), context)).otherwise("")
    quoted = lambda x: F.concat(F.lit(': "'), F.replace(F.replace(snippet(x), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return (
        F.when((curr == "") & (prev != ""), F.concat(F.lit("Teks dihapus"), where, quoted(prev)))
        .when((prev == "") & (curr != ""), F.concat(F.lit("Teks ditambahkan"), where, quoted(curr)))
        .when(kind == "added", F.concat(F.lit("Bagian baru ditambahkan"), where))
        .when(kind == "removed", F.concat(F.lit("Bagian dihapus"), where))
        .when(is_heading_renumber(prev, curr), F.concat(F.lit("Penomoran diubah: "), prev, F.lit(" → "), curr))
        .when(cosmetic, F.concat(F.lit("Perubahan kosmetik"), where))
        .otherwise(F.concat(F.lit("Teks diubah"), where))
    )


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 0).when(severity == "major", 1).when(severity == "minor", 2).when(severity == "info", 3).otherwise(4)


def normalize_severity(severity: Column) -> Column:
    s = F.lower(F.trim(severity))
    return F.when(s.isin("critical", "kritis"), "critical").when(s.isin("major", "mayor"), "major").when(s == "info", "info").otherwise("minor")


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
