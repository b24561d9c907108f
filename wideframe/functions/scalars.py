"""Scalar helpers, as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType


def floor_div(a: Column, b: Column) -> Column:
    """Whole numbers divided, rounded down, without a double in between; b is above 0."""
    below = F.when(a % b < 0, F.lit(1)).otherwise(F.lit(0))
    return F.call_function("div", a, b) - below


def epoch_day(text: Column) -> Column:
    """Days since 1970 of a strict YYYY-MM-DD; null if it is none."""
    ok = F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}$"))
    return F.when(ok, F.unix_date(F.try_to_date(text, "yyyy-MM-dd")))


def split_nanos(ns: Column) -> Column:
    """struct<millis, nanos_of_milli> of nanoseconds since the epoch; before it too, nanos_of_milli is 0 to 999999."""
    nanos = F.pmod(ns, F.lit(1_000_000))
    millis = floor_div(ns.cast("long"), F.lit(1_000_000).cast("long"))
    return F.struct(millis.cast("long").alias("millis"), nanos.cast("int").alias("nanos_of_milli"))


def join_nanos(millis: Column, nanos: Column) -> Column:
    """Nanoseconds since the epoch; an error if nanos is not 0 to 999999."""
    ok = nanos.between(0, 999_999)
    return F.when(ok, millis * F.lit(1_000_000) + nanos).otherwise(F.raise_error(F.lit("nanos_of_milli out of range")))


def json_string(c: Column) -> Column:
    """The characters of a JSON string, without quotes: short escapes where there are, else \\u00xx below a space."""
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    c = F.replace(c, F.lit('"'), F.lit('\\"'))
    for raw, escaped in (("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(raw), F.lit(escaped))
    rest = [chr(k) for k in range(32) if chr(k) not in "\b\f\n\r\t"]
    once = c
    for ch in rest:
        c = F.replace(c, F.lit(ch), F.lit(f"\\u{ord(ch):04x}"))
    return F.when(F.rlike(once, F.lit(r"[\x00-\x1f]")), c).otherwise(once)


def strip_control(c: Column) -> Column:
    """Control characters become U+FFFD."""
    return F.regexp_replace(c, r"\p{Cc}", "�")


def valid_utf8(c: Column) -> Column:
    """Whether bytes, or a string's bytes, are UTF-8."""
    return F.is_valid_utf8(c.cast("string"))


def hex_bytes(c: Column) -> Column:
    return F.lower(F.hex(c))


def decimal_text(c: Column) -> Column:
    """All digits of the scale, without an exponent."""
    return c.cast("string")


def double_text(c: Column) -> Column:
    """As the Java platform prints a double: 1.0E7, 1.0E-4, -0.0."""
    return c.cast("string")


def number_text(c: Column) -> Column:
    """As NDJSON has a double: digits from 1e-5 up to 1e9, else a lower-case exponent; null if it is not finite."""
    s, a = c.cast("double").cast("string"), F.abs(c)
    sign = F.when(F.startswith(s, F.lit("-")), "-").otherwise("")
    digits = F.regexp_replace(F.substring_index(s, "E", 1), r"[-.]", "")
    e = F.substring_index(s, "E", -1).cast("int")
    whole = F.rpad(digits, F.greatest(F.length(digits), e + 2), F.lit("0"))
    large = F.concat(sign, F.substring(whole, F.lit(1), e + 1), F.lit("."), F.substring(whole, e + 2, F.length(whole)))
    small = F.concat(
        sign, F.lit("0."), F.repeat(F.lit("0"), F.greatest(-e - 1, F.lit(0))), F.regexp_replace(digits, "(?<=.)0+$", "")
    )
    return (
        F.when(F.isnan(c) | (a == float("inf")), F.lit(None))
        .when(~F.contains(s, F.lit("E")), s)
        .when((a >= 1e7) & (a < 1e9), large)
        .when((a < 1e-3) & (a >= 1e-5), small)
        .otherwise(F.replace(F.lower(s), F.lit("+"), F.lit("")))
    )


def exact_double(token: Column) -> Column:
    """Whether a whole-number token is a double without loss. No SQL cast can tell; null and other tokens are exact."""

    # Defined here, so that it is sent by value and workers need not find this module.
    @F.pandas_udf(BooleanType())
    def run(tokens: pd.Series) -> pd.Series:
        def ok(t: str | None) -> bool:
            if t is None or not t.lstrip("+-").isdigit():
                return True
            try:
                return int(float(t)) == int(t)
            except OverflowError:
                return False

        return tokens.map(ok)

    return run(token)


def inexact(token: Column) -> Column:
    """As exact_double, but only tokens of 16 digits or more leave the JVM: shorter ones are all exact."""
    long = F.rlike(token, F.lit(r"^[+-]?\d{16,}$"))
    return long & ~exact_double(F.when(long, token))
