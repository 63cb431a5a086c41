"""JSON values by path, as exact text.

Spark's own extractor rewrites numbers and objects, so values are cut from the document: strings are decoded, everything
else keeps its text. A line that is one object of a plain shape (no escapes, containers at most one level deep) is cut
by patterns in the JVM; any other goes to a scanner that leans on the standard library's C routines.
"""

from __future__ import annotations

import json
import re
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _reject(name: str):
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_constant=_reject)
_SPACE = re.compile(r"[ \t\n\r]*").match


def parse_path(path: str) -> tuple[str, ...] | None:
    """Steps of a dotted path (``a.b[0]``, optionally after ``$`` or a dot) or a JSON pointer; None if malformed."""
    if not path:
        return ()
    if path[0] == "/":
        if re.search(r"~(?![01])", path):
            return None
        return tuple(s.replace("~1", "/").replace("~0", "~") for s in path[1:].split("/"))
    rest = path
    if rest[0] == "$":
        rest = rest[1:]
        if not rest:
            return ()
        if rest[0] not in ".[":
            return None
    rest = rest.removeprefix(".")
    # One leading key or index, then .key and [index] in any order.
    if not re.fullmatch(r"(?:[^.\[]+|\[[0-9]+\])(?:\.[^.\[]+|\[[0-9]+\])*", rest):
        return None
    return tuple(a or b for a, b in re.findall(r"\[([0-9]+)\]|([^.\[]+)", rest))


def members(text: str, at: int = 0):
    """(key or index, start, end, value) of the container that starts at ``at``; then its end as the only item of a tuple."""
    pair = {"{": "}", "[": "]"}[text[at]]
    at = _SPACE(text, at + 1).end()
    index = 0
    if text[at] == pair:
        yield (at + 1,)
        return
    while True:
        key = str(index)
        if pair == "}":
            if text[at] != '"':
                raise ValueError("key")
            key, at = scanstring(text, at + 1, True)
            at = _SPACE(text, at).end()
            if text[at] != ":":
                raise ValueError("colon")
            at = _SPACE(text, at + 1).end()
        value, end = _DECODER.raw_decode(text, at)
        yield key, at, end, value
        index += 1
        at = _SPACE(text, end).end()
        if text[at] == pair:
            yield (at + 1,)
            return
        if text[at] != ",":
            raise ValueError("comma")
        at = _SPACE(text, at + 1).end()


def as_text(text: str, start: int, end: int, value) -> str | None:
    if value is None:
        return None
    if isinstance(value, str):
        value.encode()  # a lone surrogate is no text
        return value
    return text[start:end]


def json_text(text: str | None, steps: tuple[str, ...]) -> str | None:
    """The value at the path; None for null, a missing path or a malformed document."""
    if text is None:
        return None
    try:
        start = _SPACE(text).end()
        value, end = _DECODER.raw_decode(text, start)
        if _SPACE(text, end).end() != len(text):
            return None
        for step in steps:
            if not isinstance(value, (dict, list)) or (isinstance(value, list) and not re.fullmatch(r"0|[1-9][0-9]*", step)):
                return None
            found = None
            for m in members(text, start):
                if len(m) == 4 and m[0] == step:
                    found = m[1:]
                    if isinstance(value, dict):
                        break  # the first of repeated keys
            if found is None:
                return None
            start, end, value = found
        return as_text(text, start, end, value)
    except (ValueError, IndexError, RecursionError):
        return None


def json_value(col: Column, steps: tuple[str, ...]) -> Column:
    @F.pandas_udf("string")
    def extract(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json_text(t, steps), na_action="ignore")

    return extract(col)


def json_fields(line: str | None, names: list[str]) -> list[str | None] | None:
    """Root values of one JSON object by name, the last of repeated keys; None if the line is malformed."""
    try:
        start = _SPACE(line).end()
        if line[start] != "{":
            return None
        found: dict[str, str | None] = {}
        for m in members(line, start):
            if len(m) == 1:
                if _SPACE(line, m[0]).end() != len(line):
                    return None
            else:
                found[m[0]] = as_text(line, *m[1:])
        return [found.get(k) for k in names]
    except (ValueError, IndexError, RecursionError, TypeError):
        return None


def json_line(col: Column, names: list[str]) -> Column:
    """array<string> of the named root values, null for a malformed line."""

    @F.pandas_udf("array<string>")
    def extract(lines: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else json_fields(t, names) for t in lines], dtype=object)

    return extract(col)


_BLANK = r"[ \t\n\r]*+"
_STRING = r'"[^"\\\x00-\x1f]*+"'
_SCALAR = rf"(?:{_STRING}|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+|true|false|null)"
_PAIR = rf"{_BLANK}{_STRING}{_BLANK}:{_BLANK}{_SCALAR}{_BLANK}"
_ITEM = rf"{_BLANK}{_SCALAR}{_BLANK}"
_FLAT = rf"(?:{_SCALAR}|\{{(?:{_BLANK}|{_PAIR}(?:,{_PAIR})*+)\}}|\[(?:{_BLANK}|{_ITEM}(?:,{_ITEM})*+)\])"
_MEMBER = rf"{_BLANK}{_STRING}{_BLANK}:{_BLANK}{_FLAT}{_BLANK}"
#: Longer lines go to the scanner: the search for the last of repeated keys recurses once a member.
_LONGEST = 8192


def simple_line(line: Column) -> Column:
    """Whether a line is one well-formed object that ``simple_field`` can read."""
    shape = rf"\A{_BLANK}\{{(?:{_BLANK}|{_MEMBER}(?:,{_MEMBER})*+)\}}{_BLANK}\z"
    return F.coalesce((F.length(line) <= _LONGEST) & line.rlike(shape), F.lit(False))


def simple_field(line: Column, name: str) -> Column:
    """The root value of a simple line by name, the last of repeated keys: a string's content, else the text; null for null or none."""
    if re.search(r'["\\\x00-\x1f]', name):
        return F.lit(None).cast("string")  # such a key needs an escape, which no simple line has
    key = "".join(re.escape(c) if c.isascii() else c for c in name)
    found = F.regexp_extract(line, rf'\A{_BLANK}\{{(?:{_MEMBER},)*{_BLANK}"{key}"{_BLANK}:{_BLANK}({_FLAT})', 1)
    inner = F.substring(found, F.lit(2), F.length(found) - 2)
    return F.when(F.startswith(found, F.lit('"')), inner).when((found != "") & (found != "null"), found)
