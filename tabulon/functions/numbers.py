"""Number grammars as column expressions: null where a text is no unambiguous number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Currency marks that a number cell may carry.
CURRENCY = r"RUB|USD|EUR|KZT|TRY|руб\.?|тенге|тг\.?|₽|₸|\$|€"
GAP = "[\\s\u00a0\u202f]"
#: Accepted shapes once gaps are gone, and what each loses and has for a point.
PLAIN = r"^[+-]?[0-9]+$"
ONE_MARK = r"^[+-]?[0-9]+[.,][0-9]{1,2}$"
COMMA_LAST = r"^[+-]?[0-9]{1,3}(\.[0-9]{3})+,[0-9]{1,2}$"
POINT_LAST = r"^[+-]?[0-9]{1,3}(,[0-9]{3})+\.[0-9]{1,2}$"
#: What most numbers look like, and characters that no number and no currency mark has: each spares the whole grammar.
SIMPLE = r"^[0-9]+(?:\.[0-9]{1,2})?$"
#: Next most frequent, whole texts of plain digits, spaces and marks: grouped or not with a comma before the decimals and maybe a code, and grouped by commas.
COMMA = r"^[0-9]+,[0-9]{1,2}\z|^[0-9]{1,3}(?: [0-9]{3})*,[0-9]{1,2}(?: (?:RUB|USD|EUR|KZT|TRY))?\z"
POINT = r"^[0-9]{1,3}(?:,[0-9]{3})+\.[0-9]{1,2}\z"
NEVER = "[acf-jl-qv-xACF-JL-QV-XавджзийклмопсфхцчшщъыьэюяАВДЖЗИЙКЛМОПСФХЦЧШЩЪЫЬЭЮЯ#:№/_]"


#: White space of any kind, as ``(?U)\\s`` has it.
SPACES = "\t\n\x0b\x0c\r \x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends; only the ends are looked at."""
    return F.btrim(c, F.lit(SPACES))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def _maybe(c: Column) -> Column:
    return c.rlike("[0-9]") & ~c.rlike(NEVER)


def _number(c: Column, loose=None) -> Column:
    """``parse_number``, and ``loose`` of the stripped text where it finds none."""

    def shaped(bare: Column) -> Column:
        return (
            F.when(bare.rlike(PLAIN), bare)
            .when(bare.rlike(ONE_MARK), F.translate(bare, ",", "."))
            .when(bare.rlike(COMMA_LAST), F.translate(bare, ",.", "."))
            .when(bare.rlike(POINT_LAST), F.translate(bare, ",", ""))
        ).try_cast("double")

    def whole(raw: Column) -> Column:
        spaced = raw.rlike(f"[0-9]{GAP}+[0-9]")
        grouped = raw.rlike(f"^[+-]?[0-9]{{1,3}}(?:{GAP}+[0-9]{{3}})+(?:[,.][0-9]{{1,2}})?$")
        return F.when(raw.rlike(r"^[+-]?[0-9]") & (~spaced | grouped), let(F.regexp_replace(raw, GAP, ""), shaped))

    # most cells are words or plain numbers: a look or two at them spares the rest
    found = let(strip(F.regexp_replace(strip(c), f"(?iu)(?:{CURRENCY})", "")), whole)
    more = (lambda x: x) if loose is None else lambda x: F.coalesce(x, loose(strip(c)))
    plain = F.when(c.rlike(SIMPLE), more(c.try_cast("double"))).when(c.rlike(COMMA), F.translate(c, ", RUBSDEKZTY", ".").try_cast("double")).when(c.rlike(POINT), F.translate(c, ",", "").try_cast("double"))
    return plain.when(_maybe(c), more(found))


def parse_number(c: Column) -> Column:
    """The number that fills the whole cell, but for a currency mark. ``1,234`` may be a
    decimal or a thousand: null. Dates, codes and blanks are null."""
    return _number(c)


def numeric_quote(c: Column) -> Column:
    """As ``parse_number``; else comma decimals with up to six digits and any inner spaces."""
    return _number(c, lambda raw: F.when(raw.rlike("^[+]?[0-9 \u00a0\u202f]+,[0-9]{1,6}$"), F.translate(raw, ",+ \u00a0\u202f", ".").try_cast("double")))


def matrix_number(c: Column) -> Column:
    """As ``parse_number``; else digits with any gaps and exactly two decimals."""
    return _number(c, lambda raw: F.when(raw.rlike(rf"^[0-9](?:[0-9]|{GAP})*[,.][0-9]{{2}}$"), F.translate(F.regexp_replace(raw, GAP, ""), ",", ".").try_cast("double")))


def cents(c: Column) -> Column:
    """A number in whole hundredths."""
    return F.round(c * 100).cast("long")
