"""Roman numerals, letter ordinals and their rendering as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numerals of one decimal place, from 0 to 9.
HUNDREDS = ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"]
TENS = ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"]
ONES = ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def _digit(n: Column, place: int, words: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, words)), (F.floor(n / place) % 10).cast("int"))


def _roman(n: Column) -> Column:
    text = F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), _digit(n, 100, HUNDREDS), _digit(n, 10, TENS), _digit(n, 1, ONES))
    return F.when(n.between(1, 3999), text)


def roman(n: Column) -> Column:
    """Upper-case numeral of 1 .. 3999, else null."""
    return let(n.cast("int"), _roman)


def parse_roman(text: Column) -> Column:
    """Value of a canonical numeral in either case, else null."""
    value = lambda c: F.when(c == "I", 1).when(c == "V", 5).when(c == "X", 10).when(c == "L", 50).when(c == "C", 100).when(c == "D", 500).when(c == "M", 1000).otherwise(0)
    # From the right: a smaller value than the one before is taken away.
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("last"))
    step = lambda a, v: F.struct((a["total"] + F.when(v < a["last"], -v).otherwise(v)).alias("total"), v.alias("last"))

    def canonical(upper):
        total = F.aggregate(F.transform(F.split(F.reverse(upper), ""), value), start, step, lambda a: a["total"])
        return F.when(upper.rlike("^[IVXLCDM]{1,15}$"), let(total, lambda t: F.when(_roman(t) == upper, t)))

    return let(F.upper(text), canonical)


def alpha(n: Column) -> Column:
    """Lower-case letters of 1 .. 18278 (a .. zzz), else null."""
    return let(n.cast("int"), _alpha)


def _alpha(n: Column) -> Column:
    letter = lambda k: F.char(k + 97)
    one = letter((n - 1) % 26)
    two = F.concat(letter(F.floor((n - 27) / 26) % 26), one)
    three = F.concat(letter(F.floor((n - 703) / 676)), two)
    return F.when(n.between(1, 26), one).when(n.between(27, 702), two).when(n.between(703, 18278), three)


def parse_alpha(text: Column) -> Column:
    """a is 1, z is 26, aa is 27; null for anything but ASCII letters."""
    value = F.aggregate(F.split(F.lower(text), ""), F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 96)
    return F.when(text.rlike("^[A-Za-z]{1,6}$"), value)


def format_ordinal(kind: Column, n: Column) -> Column:
    return (
        F.when(kind == "L_ROM", F.lower(roman(n)))
        .when(kind == "U_ROM", roman(n))
        .when(kind == "LOWER", alpha(n))
        .when(kind == "UPPER", F.upper(alpha(n)))
        .otherwise(n.cast("int").cast("string"))
    )


def render(kind: Column, form: Column, n: Column) -> Column:
    """An ordinal as its list writes it."""
    return let(format_ordinal(kind, n), lambda text: F.when(form == "BRACKET", F.concat(F.lit("("), text, F.lit(")"))).when(form == "PAREN", F.concat(text, F.lit(")"))).when(form == "DOT", F.concat(text, F.lit("."))).otherwise(text))


def article_number(text: Column) -> Column:
    """The number itself, else the last part of a dotted number, else a roman numeral's value."""
    digits = lambda t: F.when(t.rlike("^[0-9]{1,9}$"), t.try_cast("int"))
    return let(text, lambda t: F.coalesce(digits(t), F.regexp_extract(t, r"\.([0-9]{1,9})$", 1).try_cast("int"), parse_roman(t)))
