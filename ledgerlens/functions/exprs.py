"""Reusable column expressions (all JVM-side built-ins, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from . import rules

# A number as text: optional sign, digits with optional fraction (or a bare
# fraction), optional exponent, surrounding blanks allowed.  try_cast alone
# would also accept 'NaN', 'Infinity' and '1d'.
NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_currency(c) -> Column:
    # a character-level translate: no regex, no decode of the UTF-8 bytes
    return F.translate(col(c).cast("string"), rules.CURRENCY_CHARS, "")


# Characters a number text can start with (NUMBER_TEXT's first token).
# Checked on the first character before the regex, which decodes the
# value: text columns (names, labels) fail here without a regex run.
NUMBER_FIRST = list("0123456789+-. \t\n\r\f\x0b")


def parse_number(c) -> Column:
    """Text with '$' and ',' removed, parsed as double; bad values -> null."""
    s = strip_currency(c)
    return F.when(F.substring(s, 1, 1).isin(*NUMBER_FIRST) & s.rlike(NUMBER_TEXT), s.try_cast("double"))


def logical_type(dt: T.DataType) -> str | None:
    """Logical type of a native Spark type, None for strings."""
    if isinstance(dt, INTEGRAL_TYPES):
        return "Integer"
    if isinstance(dt, NUMERIC_TYPES):
        return "Float"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "DateTime"
    if isinstance(dt, T.BooleanType):
        return "Boolean"
    return None


def np_round(c, decimals: int) -> Column:
    """Round half-even the numpy way: scale, round to integer, unscale.

    Spark's round/bround round the shortest decimal text of the double;
    numpy (and so the reference) rounds the scaled binary value.
    """
    f = float(10 ** decimals)
    return F.rint(col(c) * F.lit(f)) / F.lit(f)


def np_round_sql(e: str, decimals: int) -> str:
    f = float(10 ** decimals)
    return f"(round_even(({e}) * {f}, 0) / {f})"


def title_words(c) -> Column:
    """'net_amount' -> 'Net Amount'."""
    return F.initcap(F.regexp_replace(col(c), "_", " "))


def grouped(x, decimals: int) -> Column:
    """Thousands-separated text with a fixed number of decimals."""
    return F.format_number(col(x), decimals)


def corrected_skewness(skew: Column, n: Column) -> Column:
    """Spark's skewness is the population g1; the sample-adjusted G1
    (what DuckDB and pandas report) is g1 * sqrt(n(n-1)) / (n-2)."""
    return F.when(n > 2, skew * F.sqrt(n * (n - 1)) / (n - 2))


def as_text(c, dt: T.DataType | None = None) -> Column:
    """Text form of a value the way Python prints it for the common types."""
    c = col(c)
    if isinstance(dt, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    if isinstance(dt, T.DoubleType):
        return float_text(c)
    return c.cast("string")


def norm_token(c) -> Column:
    return F.lower(F.trim(col(c).cast("string")))


def float_text(c) -> Column:
    """Plain decimal text of a double, the way Python prints short floats
    ('300000000.0', '1234.56'); Spark's own cast switches to E-notation
    from 1e7 on and below 1e-3.

    Spark's text is the shortest that reads back as the value; its digits
    are moved to plain notation between 1e-4 and 1e16, as Python does.
    Outside that, and for NaN and infinities, Spark's text stays."""
    s = col(c).cast("string")
    sign = F.when(s.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    exp = F.regexp_extract(s, r"E(-?\d+)$", 1).try_cast("int")
    digits = F.regexp_replace(F.regexp_extract(s, r"^-?([\d.]+)E", 1), r"\.0$|\.", "")
    whole = F.concat(F.rpad(digits, F.greatest(exp + 1, F.length(digits)), "0"))
    left = F.substring(whole, F.lit(1), exp + 1)
    right = F.substring(whole, exp + 2, F.length(whole))
    large = F.concat(sign, left, F.lit("."), F.when(right == "", F.lit("0")).otherwise(right))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exp - 1), digits)
    # almost every value has no exponent: the first test spares it all the rest
    return (F.when(~s.contains("E"), s).when(exp.between(0, 15), large).when(exp.between(-4, -1), small).otherwise(s))


def ascii_digits(c) -> Column:
    """Decimal digits of the common scripts as ASCII digits (one translate)."""
    zeros = [0x660, 0x6F0, 0x7C0, 0x966, 0x9E6, 0xA66, 0xAE6, 0xB66, 0xBE6, 0xC66, 0xCE6, 0xD66, 0xE50, 0xED0,
             0xF20, 0x1040, 0x17E0, 0x1810, 0xFF10]
    every = "".join(chr(z + d) for z in zeros for d in range(10))
    return F.translate(col(c), every, "0123456789" * len(zeros))


def nan_to_null(df):
    """NaN in float and double columns is a missing value, as in pandas."""
    return df.select(*[F.nanvl(F.col(sql_ident(f.name)), F.lit(None).cast(f.dataType)).alias(f.name)
                       if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.col(sql_ident(f.name))
                       for f in df.schema.fields])


def float_text_sql(e: str) -> str:
    # DuckDB prints the shortest round-trip form without E-notation here
    return f"CAST({e} AS VARCHAR)"


# --- the same expressions as Spark SQL text -------------------------------
# Wide plans (every statistic of every column) are built as SQL strings:
# one call into the JVM per expression instead of one per function node.

def sql_str(v: str) -> str:
    """A Spark SQL string literal."""
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sql_double(v: float) -> str:
    """A double literal that round-trips exactly."""
    import math
    if math.isfinite(v):
        return f"({float(v)!r}D)"
    return f"CAST({sql_str(repr(float(v)))} AS DOUBLE)"


def parse_number_sql(c: str) -> str:
    """SQL text of ``parse_number`` applied to the SQL expression ``c``."""
    return read_number_sql(strip_currency_sql(f"CAST({c} AS STRING)"))


def strip_currency_sql(v: str) -> str:
    """SQL text of ``strip_currency`` of a text.  Only values that hold such a
    character are translated: that goes through the text character by character."""
    marked = " OR ".join(f"contains({v}, {sql_str(ch)})" for ch in rules.CURRENCY_CHARS)
    return f"(CASE WHEN {marked} THEN translate({v}, {sql_str(rules.CURRENCY_CHARS)}, '') ELSE {v} END)"


def read_number_sql(s: str) -> str:
    """SQL text of the number that a stripped text reads as."""
    first = ", ".join(str(ord(ch)) for ch in NUMBER_FIRST)
    return (f"CASE WHEN ascii({s}) IN ({first}) AND {s} RLIKE {sql_str(NUMBER_TEXT)} "
            f"THEN try_cast({s} AS DOUBLE) END")


def np_round_text(e: str, decimals: int) -> str:
    """SQL text of ``np_round`` (Spark dialect)."""
    f = sql_double(float(10 ** decimals))
    return f"(rint(({e}) * {f}) / {f})"
