"""One condition, `column op literal`: parsed, bound to a column's type, and turned into a row filter or a row-group one."""

from __future__ import annotations

import datetime as dt
import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import INTEGERS, TableError

#: In the order in which they are looked for, anywhere in the text.
OPERATORS = (">=", "<=", "!=", "=", ">", "<")
ORDERED = (">=", "<=", ">", "<")
_RANGES = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}
_EPOCH = dt.date(1970, 1, 1)
_FLOAT = re.compile(r"[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|infinity|nan)", re.I | re.A)


@dataclass(frozen=True)
class Where:
    column: str
    op: str
    literal: str


def parse_where(text: str) -> Where:
    for op in OPERATORS:
        left, found, right = text.partition(op)
        if found:
            left, right = left.strip(), right.strip()
            if left and right:
                return Where(left, op, right)
            break
    raise TableError(f"bad --where '{text}': expected column op value")


def _compare(c: Column, op: str, v) -> Column:
    value = F.lit(v)
    return {
        "=": lambda: c == value,
        "!=": lambda: c != value,
        ">": lambda: c > value,
        ">=": lambda: c >= value,
        "<": lambda: c < value,
        "<=": lambda: c <= value,
    }[op]()


def epoch_day(text: str) -> int | None:
    """Of an integer, or of a strict YYYY-MM-DD that is in the calendar."""
    if re.fullmatch(r"[+-]?\d+", text, re.A):
        return int(text)
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text, re.A):
        try:
            return (dt.date.fromisoformat(text) - _EPOCH).days
        except ValueError:
            return None
    return None


def literal_of(t: T.DataType, text: str):
    """The literal as a value of the column's kind; None if it is none."""
    if isinstance(t, INTEGERS):
        return int(text) if re.fullmatch(r"[+-]?\d+", text, re.A) and abs(int(text)) < 1 << 127 else None
    if isinstance(t, T.DateType):
        return epoch_day(text)
    if isinstance(t, (T.FloatType, T.DoubleType)):
        if not _FLOAT.fullmatch(text):
            return None
        with np.errstate(over="ignore"):
            return float(np.float32(float(text))) if isinstance(t, T.FloatType) else float(text)
    if isinstance(t, T.BooleanType):
        return {"true": True, "false": False}.get(text)
    return text


def bind(schema: T.StructType, where: Where) -> Column:
    """The filter. Nulls never match; whole numbers compare exactly; a NaN cell only ever matches `!=`."""
    if where.column not in schema.names:
        raise TableError(f"unknown column '{where.column}'")
    t, op, c = schema[where.column].dataType, where.op, F.col(f"`{where.column.replace('`', '``')}`")
    v = literal_of(t, where.literal)
    every, none = c.isNotNull(), F.lit(False)
    if isinstance(t, T.BooleanType):
        if op in ORDERED or v is None:
            raise TableError(f"unsupported operator or value for Boolean column '{where.column}'")
        return _compare(c, op, v)
    if isinstance(t, T.StringType):
        if op in ORDERED:
            raise TableError(f"unsupported operator {op} for string column '{where.column}'")
        return _compare(c, op, v)
    if not isinstance(t, (*INTEGERS, T.DateType, T.FloatType, T.DoubleType)):
        raise TableError(f"unsupported type of column '{where.column}': {t.simpleString()}")
    if v is None:
        if op in ORDERED:
            raise TableError(f"bad value '{where.literal}' for column '{where.column}'")
        return every if op == "!=" else none
    if isinstance(t, INTEGERS):
        bits = _RANGES[type(t)]
        if v >= 1 << bits:
            return every if op in ("!=", "<", "<=") else none
        if v < -(1 << bits):
            return every if op in ("!=", ">", ">=") else none
        return _compare(c, op, F.lit(v).cast(t))
    if isinstance(t, T.DateType):
        try:
            return _compare(c, op, _EPOCH + dt.timedelta(days=v))
        except OverflowError:
            return _compare(F.unix_date(c).cast("decimal(38,0)"), op, F.lit(v).cast("decimal(38,0)"))
    if math.isnan(v):
        return every if op == "!=" else none
    value = F.lit(v).cast(t)
    return (F.isnan(c) | _compare(c, op, value)) & every if op == "!=" else ~F.isnan(c) & _compare(c, op, value)


def may_match(t: T.DataType, where: Where, low: Column, high: Column) -> Column:
    """Whether a row group with these statistics (typed, null if missing) can have a match; `!=` always can."""
    v = literal_of(t, where.literal)
    if where.op == "!=" or v is None or not isinstance(t, (*INTEGERS, T.DateType, T.FloatType, T.DoubleType)):
        return F.lit(True)
    if isinstance(v, float) and math.isnan(v):
        return F.lit(True)
    if isinstance(t, T.DateType):
        low, high = F.unix_date(low), F.unix_date(high)
    if isinstance(t, (T.FloatType, T.DoubleType)):
        value, odd = F.lit(v).cast(t), F.isnan(low) | F.isnan(high)
    else:
        value, odd = F.lit(v).cast("decimal(38,0)"), F.lit(False)
    out = {
        "=": (value < low) | (value > high),
        ">": high <= value,
        ">=": high < value,
        "<": low >= value,
        "<=": low > value,
    }[where.op]
    return ~F.coalesce(out & ~odd, F.lit(False))
