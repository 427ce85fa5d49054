"""Scalar rules of offer texts as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import strip

# Currency marks and their codes.
CURRENCY_CODES = {"₽": "RUB", "руб": "RUB", "rub": "RUB", "₸": "KZT", "тенге": "KZT", "тг": "KZT", "kzt": "KZT", "$": "USD", "usd": "USD", "€": "EUR", "eur": "EUR"}


def clean_cell(c: Column) -> Column:
    """Null as empty, soft hyphens as hyphens, stripped."""
    return strip(F.replace(F.coalesce(c, F.lit("")), F.lit("­"), F.lit("-")))


def dense(c: Column) -> Column:
    """Without white space and soft hyphens, in lower case: for comparing two readings of a cell."""
    return F.lower(F.regexp_replace(c, "(?U)[\\s­]+", ""))


#: Full-width forms and what they stand for: a fixed distance in the code charts.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(chr(ord(x) - 0xFEE0) for x in _WIDE)
#: Latin ligatures from U+FB00 in order, and the fixed values they stand for.
_LIGATURES = ("ff", "fi", "fl", "ffi", "ffl")
ODD = "[ё‐‑‒–—―−\u00a0\u202f\u3000\uFB00-\uFB04\uFF01-\uFF5E]"


def compatible(c: Column) -> Column:
    """Full-width forms, ligatures and odd spaces by their compatibility equivalents."""
    v = F.translate(c, _WIDE + "\u00a0\u202f\u3000", _NARROW + "   ")
    for i, plain in enumerate(_LIGATURES):
        v = F.replace(v, F.lit(chr(0xFB00 + i)), F.lit(plain))
    return v


def normalize_label(c: Column) -> Column:
    """Compatibility forms as plain letters, lower case, dashes and marks as spaces, one space
    between words."""
    low = F.lower(F.coalesce(c, F.lit("")))
    # most texts have none of what is replaced here; full-width letters have a lower case of their own
    v = F.when(low.rlike(ODD), F.regexp_replace(F.translate(compatible(low), "ё", "е"), "[‐‑‒–—―−]+", "-")).otherwise(low)
    v = F.regexp_replace(v, "[/.:]+", " ")
    v = F.regexp_replace(v, r"(?U)[^\w\s-]+", " ")
    return F.trim(F.regexp_replace(v, r"(?U)[-\s]+", " "))


def maybe_known(text: Column, known: list[str]) -> Column:
    """Whether a text may say one of the known labels: it opens with the first word of one, or has characters that labels do not have. One look at
    a text spares the most of them all that follows."""
    firsts = sorted({w for w in (re.sub(r"[^\w]+", " ", k.lower().replace("ё", "е")).split()[0] for k in known)})
    return text.rlike(r"(?iu)(?U)^[^\w]*(?:" + "|".join(firsts) + ")|" + ODD.replace("ё", "ёЁ"))


def document_date(c: Column) -> Column:
    """The date after "от" of a heading, as written."""
    return F.nullif(F.regexp_extract(c, r"(?iu)(?U)\bот\s+(\d{2}[./-]\d{2}[./-]\d{4})", 1), F.lit(""))


def document_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?U)№\s*([\w/.-]+)", 1), F.lit(""))


def calendar_date(c: Column) -> Column:
    """A written day.month.year as a date; null where no calendar has it."""
    return F.try_to_timestamp(F.regexp_replace(c, "[/-]", "."), F.lit("dd.MM.yyyy")).cast("date")


def currency_code(c: Column) -> Column:
    """Code of the first currency mark in a text."""
    mark = F.lower(F.regexp_extract(c, r"(?iu)(₽|руб|rub|₸|тенге|тг|kzt|\$|usd|€|eur)", 1))
    return F.create_map(*[F.lit(x) for kv in CURRENCY_CODES.items() for x in kv])[mark]


def percent(c: Column) -> Column:
    """The first percentage in a text."""
    return F.replace(F.nullif(F.regexp_extract(c, r"([0-9]+(?:[.,][0-9]+)?)\s*%", 1), F.lit("")), F.lit(","), F.lit(".")).cast("double")


def vat_is_inside(c: Column) -> Column:
    return F.lower(c).rlike("включ|в том числе|без ндс")


def label_value(c: Column) -> tuple[Column, Column]:
    """Label and value of ``label: value``; nulls where a text is none."""
    shape = r"^([^:\n]{2,100}):\s*(\S[^\n]*)$"
    t = strip(c)
    return F.nullif(F.regexp_extract(t, shape, 1), F.lit("")), F.nullif(F.regexp_extract(t, shape, 2), F.lit(""))


def hash_bucket(group: Column) -> Column:
    """0 to 99 from a name, whatever its case and outer spaces."""
    return F.conv(F.substring(F.sha2(F.lower(strip(group)), 256), 1, 8), 16, 10).cast("long") % 100


def split_of(bucket: Column) -> Column:
    return F.when(bucket < 80, "train").when(bucket < 90, "val").otherwise("test")


def confidence(native: Column, table: Column, model: Column, agreement: Column) -> Column:
    """Thousandths of trust in a value by how it was read."""
    points = F.when(native, 900).otherwise(760) + F.when(table, 30).otherwise(0) + F.when(model, 0).otherwise(20)
    points = points + F.when(agreement.isNull(), 0).when(agreement, 40).otherwise(-180)
    return F.least(F.greatest(points, F.lit(0)), F.lit(990)).cast("long")


def retry_delay_ms(retry_after: Column, attempt: Column) -> Column:
    """Milliseconds before the next try: what the server asks for, else doubling; 0.1 to 8 seconds."""
    return F.least(F.greatest(F.coalesce(retry_after * 1000, 500 * F.pow(F.lit(2), attempt)), F.lit(100)), F.lit(8000)).cast("long")


def bounded_setting(text: Column, default: float, low: float, high: float) -> Column:
    """A setting as a number in its range; the default where it is none."""
    v = text.try_cast("double")
    v = F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(float(default))).otherwise(v)
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), v))


def spreadsheet_safe(c: Column) -> Column:
    """A CSV field that no spreadsheet takes for a formula, quoted."""
    guarded = F.when(c.rlike(r"^\s*[=+@-]"), F.concat(F.lit("'"), c)).otherwise(c)
    return F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))


def text_quality(c: Column) -> Column:
    """Whether a native text can be trusted: some letter or digit, nothing replaced, mostly printable."""
    unseen = F.length(F.regexp_replace(c, r"[^\p{Cc}\p{Cf}\p{Co}\p{Cs}\p{Cn}]", ""))
    return (F.length(c) > 0) & ~c.contains("�") & ~c.contains("\u0000") & c.rlike(r"[\p{L}\p{N}]") & (20 * unseen < F.length(c))
