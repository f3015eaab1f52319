"""Text expressions: stripping, truncation, and numbers spelled as in the prompts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# All characters that count as blank at the ends of a text.
BLANKS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(col: Column) -> Column:
    """Remove every kind of blank at both ends (a plain ``trim`` removes spaces only)."""
    return F.btrim(col, F.lit(BLANKS))


def rstrip(col: Column) -> Column:
    return F.rtrim(col, F.lit(BLANKS))


def clean(col: Column) -> Column:
    """Text without surrounding blanks; empty when missing."""
    return F.coalesce(strip(col.cast("string")), F.lit(""))


def truncate(col: Column, limit: int) -> Column:
    """Cut a longer text to ``limit`` characters at most, ending in three dots."""
    head = rstrip(F.substring(col, 1, limit - 3))
    return F.when(F.length(col) <= limit, col).otherwise(F.concat(head, F.lit("...")))


def as_text(col: Column, dtype: T.DataType) -> Column:
    """A value as text; floats as 12345678.9 or 1e+16 rather than 1.23456789E7."""
    text = col.cast("string")
    if isinstance(dtype, T.BooleanType):
        return F.initcap(text)
    if not isinstance(dtype, (T.DoubleType, T.FloatType)):
        return text
    size = F.abs(col)
    plain = F.regexp_replace(text.try_cast("decimal(38,20)").cast("string"), r"0+$", "")
    plain = F.regexp_replace(plain, r"\.$", ".0")
    # Spark writes E16 and E-5 where the prompts have e+16 and e-05
    power = F.regexp_replace(text, r"(?:\.0)?E(\d)", "e+$1")
    power = F.regexp_replace(power, r"(?:\.0)?E-", "e-")
    power = F.regexp_replace(power, r"e([+-])(\d)$", "e$10$2")
    return (
        F.when(F.isnan(col), F.lit(None))
        .when((size >= 1e16) | ((size < 1e-4) & (size > 0)), power)
        .when((size >= 1e7) | ((size < 1e-3) & (size > 0)), F.coalesce(plain, text))
        .otherwise(text)
    )
