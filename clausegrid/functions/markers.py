"""List markers: reading one from a paragraph's start, and settling the family of a whole list."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import numerals

# The three written forms, tried in this order.
BRACKET = r"^[\s\p{Zs}]*\(\s*([0-9]{1,3}|[A-Za-z]{1,4})\s*\)"
DECIMAL = r"^[\s\p{Zs}]*([0-9]{1,3}(?:\.[0-9]{1,3})+)\.?(\s|$)"
SIMPLE = r"^[\s\p{Zs}]*([0-9]{1,3}|[A-Za-z]{1,4})\s*([.)])(\s|$)"
BEGINS = r"^[\s\p{Zs}]*(?:\(|[0-9A-Za-z]{1,4}\s*[.)])"
#: Highest ordinal with which a list may begin.
HIGHEST_START = 26

_FIELDS = "struct<kind:string,form:string,token:string,ordinal:int,ambiguous:boolean,alt_kind:string,alt_ordinal:int,raw:string>"


def classify(token: Column) -> Column:
    """(kind, ordinal, ambiguous, alt_kind, alt_ordinal) of a bare token; null if it is no ordinal."""
    return numerals.let(token, _classify)


def _classify(token: Column) -> Column:
    upper = token == F.upper(token)
    uniform = upper | (token == F.lower(token))
    readings = F.struct(numerals.parse_roman(token).alias("roman"), F.when(F.length(token) <= 2, numerals.parse_alpha(token)).alias("alpha"))
    roman_kind, alpha_kind = F.when(upper, "U_ROM").otherwise("L_ROM"), F.when(upper, "UPPER").otherwise("LOWER")
    none, no_kind = F.lit(None).cast("int"), F.lit(None).cast("string")
    made = lambda kind, n, both, alt, alt_n: F.struct(kind.alias("kind"), n.cast("int").alias("ordinal"), F.lit(both).alias("ambiguous"), alt.alias("alt_kind"), alt_n.alias("alt_ordinal"))
    letters = lambda r: (
        F.when(r["roman"].isNotNull() & r["alpha"].isNotNull(), made(roman_kind, r["roman"], True, alpha_kind, r["alpha"]))
        .when(r["roman"].isNotNull(), made(roman_kind, r["roman"], False, no_kind, none))
        .when(r["alpha"].isNotNull(), made(alpha_kind, r["alpha"], False, no_kind, none))
    )
    number = token.try_cast("int")
    return F.when(token.rlike("^[0-9]+$"), F.when(number > 0, made(F.lit("DIGIT"), number, False, no_kind, none))).when(uniform, numerals.let(readings, letters))


def parse_marker(text: Column) -> Column:
    """The marker at a paragraph's start as a struct, null if it has none. A bracketed token that is no ordinal ends the search."""
    group = lambda pattern, k=1: F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))
    parts = F.struct(group(BRACKET).alias("bracket"), group(DECIMAL).alias("decimal"), group(SIMPLE).alias("simple"))

    def read(p):
        bracket, decimal = p["bracket"], p["decimal"]
        whole = F.when(bracket.isNotNull(), F.regexp_extract(text, BRACKET, 0)).when(decimal.isNotNull(), F.regexp_extract(text, DECIMAL, 0)).otherwise(F.regexp_extract(text, SIMPLE, 0))
        raw = F.regexp_replace(whole, r"^[\s\p{Zs}]+|\s+$", "")
        form = F.when(bracket.isNotNull(), "BRACKET").when(decimal.isNotNull(), F.when(raw.endswith("."), "DOT").otherwise("BARE")).otherwise(F.when(F.regexp_extract(text, SIMPLE, 2) == ".", "DOT").otherwise("PAREN"))
        token = F.coalesce(bracket, p["simple"])
        dotted = F.struct(F.lit("DECIMAL").alias("kind"), form.alias("form"), decimal.alias("token"), F.regexp_extract(decimal, r"([0-9]+)$", 1).try_cast("int").alias("ordinal"), F.lit(False).alias("ambiguous"), F.lit(None).cast("string").alias("alt_kind"), F.lit(None).cast("int").alias("alt_ordinal"), raw.alias("raw"))
        plain = lambda c: F.when(c.isNotNull(), F.struct(c["kind"].alias("kind"), form.alias("form"), token.alias("token"), c["ordinal"].alias("ordinal"), c["ambiguous"].alias("ambiguous"), c["alt_kind"].alias("alt_kind"), c["alt_ordinal"].alias("alt_ordinal"), raw.alias("raw")).cast(_FIELDS))
        return F.when(bracket.isNull() & decimal.isNotNull(), dotted.cast(_FIELDS)).when(token.isNotNull(), numerals.let(classify(token), plain))

    return F.when(text.rlike(BEGINS), numerals.let(parts, read))  # most paragraphs are done with here


def node_kind(kind: Column, form: Column) -> Column:
    """What a marker of a kind and form is called in the tree."""
    return F.when(kind == "DECIMAL", "clause").when(kind.isin("LOWER", "UPPER"), "huruf").when(kind.isin("L_ROM", "U_ROM"), "item").when(form == "BRACKET", "ayat").otherwise("angka")


def plausible_start(ordinal: Column, ambiguous: Column, alt_ordinal: Column) -> Column:
    """Whether a marker may open a list, whatever is open before it."""
    return (ordinal <= HIGHEST_START) | (F.coalesce(ambiguous, F.lit(False)) & (alt_ordinal <= HIGHEST_START))


def run_score(ordinals: Column) -> Column:
    """How many members, in order, go on counting 1, 2, 3."""
    return F.aggregate(ordinals, F.lit(0), lambda n, x: F.when(x == n + 1, n + 1).otherwise(n))


def resolve_family(markers: Column) -> Column:
    """The kind that a list's markers (an ordered array of structs) agree on: that of the first unambiguous one, else the reading that counts further."""
    sure = F.get(F.filter(markers, lambda m: ~m["ambiguous"]), F.lit(0))["kind"]
    first = F.get(markers, F.lit(0))
    counts_on = run_score(F.transform(markers, lambda m: m["alt_ordinal"])) > run_score(F.transform(markers, lambda m: m["ordinal"]))
    return F.coalesce(sure, F.when(counts_on, first["alt_kind"]).otherwise(first["kind"]))
