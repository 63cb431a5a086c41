"""Operators and scalar functions. Nothing depends on the session's ANSI setting."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..bind.types import BOOLEAN, FLOATING, INTEGER, NULL, STRING, Expr
from ..sources.timestamps import to_epoch
from .jsonpath import json_value

SPARK_TYPES = {NULL: "void", BOOLEAN: "boolean", INTEGER: "bigint", FLOATING: "float", STRING: "string"}


def literal(value, type_: str, wide: bool = False) -> Column:
    if type_ == FLOATING:
        return F.lit(float(value)) if wide else F.lit(float(value)).cast("float")
    return F.lit(value).cast(SPARK_TYPES[type_])


def _narrow(value: Column, wide: bool) -> Column:
    return value if wide else value.cast("float")


def float_text(x: Column) -> Column:
    """Six decimals, as the language prints floats."""
    return F.when(x.isNotNull(), F.format_string("%.6f", x.cast("double")))


def cast(x: Column, source: str, target: str, wide: bool) -> Column:
    if target == NULL or source == NULL:
        return F.lit(None).cast(SPARK_TYPES[target])
    if source == target:
        return x
    if target == STRING:
        return float_text(x) if source == FLOATING else x.cast("string")
    if target == BOOLEAN:
        return F.length(x) > 0 if source == STRING else x != 0
    if source == STRING:
        if target == INTEGER:
            # Spark would also take blanks around a number and a plus before it: a digit or a minus comes first, a digit last.
            first, last = F.ascii(x), F.ascii(F.right(x, F.lit(1)))
            return F.when((first.between(48, 57) | (first == 45)) & last.between(48, 57), x.try_cast("bigint"))
        number = F.when(x.rlike(r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"), x.try_cast("float"))
        return F.when(F.abs(number) < F.lit(float("inf")).cast("float"), number)
    if target == INTEGER:
        return x.try_cast("bigint")
    return x.cast("float")


def binary(op: str, a: Column, b: Column, type_: str, wide: bool) -> Column:
    """type_: of the operands."""
    if op == "=":
        return a.eqNullSafe(b)
    if op == "!=":
        return ~a.eqNullSafe(b)
    if op in ("<", ">", "<=", ">="):
        return {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
    if op == "AND":
        return a & b
    if op == "OR":
        return a | b
    if op == "+":
        return F.concat(a, b) if type_ == STRING else _narrow(a + b, wide) if type_ == FLOATING else F.try_add(a, b)
    if op == "-":
        return _narrow(a - b, wide) if type_ == FLOATING else F.try_subtract(a, b)
    if type_ == FLOATING:
        return _narrow(F.try_divide(a, b), wide)
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def full_match(x: Column, pattern: str) -> Column:
    return x.rlike(rf"\A(?:{pattern})\z")


def lower_ascii(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def substr_bytes(x: Column, start: int, size: int | None) -> Column:
    """``size`` bytes from byte ``start`` on, from 0; a start beyond the end is an error."""
    octets = x.cast("binary")
    part = F.substring(octets, F.lit(start + 1), F.lit(size) if size is not None else F.octet_length(x)).cast("string")
    beyond = F.raise_error(F.concat(F.lit(f"SUBSTR from {start} is beyond the end of a text of length "), F.octet_length(x).cast("string")))
    return F.when(F.octet_length(x) < start, beyond).otherwise(part) if start else part


# What has one longest match wherever it begins: no alternative, no group, at most one repeat, and that one greedy.
_ATOM = r"(?:\\[^bB]|\[\^?\]?(?:\\.|[^\]\\])*\]|[^\\\[\](){}|?*+^$])"
_ONE_REPEAT = re.compile(rf"{_ATOM}*(?:{_ATOM}(?:[*+?]|\{{[0-9]+(?:,[0-9]*)?\}})(?![?+*]){_ATOM}*)?")


def leftmost_longest(x: Column, pattern: str) -> Column:
    """The first match, of those the longest; null without one.

    Java's patterns take the first branch that matches. Where that can differ, the match is found by a matcher with POSIX
    rules in batches on the Python side, if it is installed; else by Java's rules.
    """
    if _ONE_REPEAT.fullmatch(pattern):
        return F.regexp_substr(x, F.lit(pattern))
    try:
        import regex

        regex.compile(pattern, regex.POSIX)
    except Exception:  # not installed, or a pattern that only Java knows
        return F.regexp_substr(x, F.lit(pattern))

    @F.pandas_udf("string")
    def longest(texts: pd.Series) -> pd.Series:
        import regex

        search = regex.compile(pattern, regex.POSIX | regex.ASCII).search
        return pd.Series([m[0] if t is not None and (m := search(t)) else None for t in texts], dtype=object)

    return longest(x)


def call(e: Expr, args: list[Column]) -> Column:
    """A bound scalar function over its argument columns."""
    data = e.data if isinstance(e.data, tuple) else (e.data,)
    name, x = data[0], args[0]
    if name == "NOT":
        return ~x
    if name == "cast":
        return cast(x, e.args[0].type, data[1], e.wide)
    if name == "LIKE":
        return full_match(x, data[1])
    if name == "lower":
        return lower_ascii(x)
    if name == "splitpart":
        return F.get(F.split(x, re.escape(data[1]) if data[1] != "\n" else "\n", -1), F.lit(data[2]))
    if name == "substr":
        return substr_bytes(x, data[1], data[2] if len(data) > 2 else None)
    if name == "coalesce":
        return F.coalesce(*[c for c, a in zip(args, e.args, strict=True) if a.type != NULL] or args)
    if name == "rsubstr":
        return leftmost_longest(x, data[1])
    if name == "json_value":
        return json_value(x, data[1])
    if name == "parse_timestamp":
        return to_epoch(x, data[1])
    return binary(name, x, args[1], e.args[0].type if e.args[0].type != NULL else e.args[1].type, e.wide)
