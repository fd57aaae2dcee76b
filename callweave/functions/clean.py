"""Column expressions that clean dirty call-record fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callweave import constants as C

# Every character that counts as white space in Unicode text.
BLANKS = (" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
          "\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def trim_blank(c: Column) -> Column:
    """Trim every Unicode blank at both ends."""
    return F.btrim(c, F.lit(BLANKS))


def text_or_null(c: Column) -> Column:
    """Trimmed text; blank becomes null."""
    return F.nullif(trim_blank(c), F.lit(""))


def clean_na(c: Column) -> Column:
    """Trimmed text, or null when it is one of the "no value" spellings."""
    text = trim_blank(c.cast("string"))
    return F.when(~F.upper(text).isin(C.NULL_TOKENS), text)


def normalize_mobile(c: Column) -> Column:
    """Canonical ten-digit mobile, null when the number is unreachable.

    One chain of replacements: each step uses its input once, so the expression
    stays small however often it is nested.
    """
    digits = F.regexp_replace(F.regexp_replace(trim_blank(c.cast("string")), r"\.0$", ""), r"\P{Nd}", "")
    national = F.regexp_replace(digits, r"^(?:91|0)(?=\p{Nd}{10}$)", "")
    return F.nullif(F.regexp_extract(national, r"^[6-9]\p{Nd}{9}$", 0), F.lit(""))


def parse_started_at(c: Column) -> Column:
    """Timestamp without zone from ISO text or a day-first layout; null when neither fits.

    Compact ISO (20240131, 20240131T1015) counts as ISO.  Of a zoned time the wall clock stays, its offset goes.
    """
    text = F.regexp_replace(trim_blank(c), r"^(\d{4})(\d{2})(\d{2})(?=$|[T ])", "$1-$2-$3")
    text = F.regexp_replace(text, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2})(\d{2})(?:(\d{2}))?(?=$|[.Z+-])", "$1:$2:$3")
    text = F.regexp_replace(text, r":(?=$|[.Z+-])", "")
    text = F.regexp_replace(text, r"^(\d{4}-\d{1,2}-\d{1,2}[T ][\d:.]+)(?:Z|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)$", "$1")
    iso = F.regexp_replace(text, r"^(\d{1,2})([-/])(\d{1,2})\2(\d{4})( \d{1,2}:\d{1,2}:\d{1,2})?$", "$4-$3-$1$5")
    shape = r"^\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}(:\d{1,2}(:\d{1,2}(\.\d{1,6})?)?)?)?$"
    return F.regexp_replace(F.regexp_extract(iso, shape, 0), r"^(\S+[T ]\d{1,2})$", "$1:00").try_cast("timestamp_ntz")


def parse_direction(c: Column) -> Column:
    token = F.lower(clean_na(c))
    return (
        F.when(token.isin(C.INBOUND_TOKENS), F.lit("inbound"))
        .when(token.isin(C.OUTBOUND_TOKENS), F.lit("outbound"))
        .otherwise(F.lit("unknown"))
    )


def normalize_product(c: Column) -> Column:
    return F.lower(clean_na(c))


def clamp_unit(c: Column) -> Column:
    """Number in [0, 1]; anything unreadable counts as 0."""
    value = F.coalesce(c.try_cast("double"), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def descending_date(c: Column) -> Column:
    """Text key whose ascending order is newest ISO date first, with '' before all."""
    return F.translate(F.coalesce(c, F.lit("")), "0123456789", "9876543210")


def map_literal(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
