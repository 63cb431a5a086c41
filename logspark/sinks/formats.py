"""JSON lines, TSKV, CSV with a header, and a table. Rows reach the driver partition by partition."""

from __future__ import annotations

import json
import math
import tempfile
import unicodedata
from collections.abc import Iterator
from typing import TextIO

from pyspark.sql import DataFrame

from ..engine import Result


def plain(value) -> str:
    """A value as all formats but JSON print it."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    return f"{value:.6f}" if isinstance(value, float) else str(value)


def json_value(value) -> str:
    if value is None or isinstance(value, bool) or isinstance(value, int):
        return json.dumps(value)
    if isinstance(value, float):
        return f"{value:.6f}" if math.isfinite(value) else "null"
    return json.dumps(str(value), ensure_ascii=False).replace("/", "\\/")


def json_rows(names: list[str], rows: Iterator) -> Iterator[str]:
    keys = [json_value(n) for n in names]
    for row in rows:
        yield "{" + ",".join(f"{k}:{json_value(v)}" for k, v in zip(keys, row, strict=True)) + "}"


def tskv_rows(names: list[str], rows: Iterator) -> Iterator[str]:
    for row in rows:
        yield "".join(f"{n}={plain(v)}\t" for n, v in zip(names, row, strict=True))


def csv_rows(names: list[str], rows: Iterator) -> Iterator[str]:
    yield ",".join(names)
    for row in rows:
        yield ",".join(map(plain, row))


def _shown(text: str) -> str:
    """Control characters as escapes, so that a row stays a line."""
    known = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\\": "\\\\"}
    return "".join(known.get(c) or (f"\\x{ord(c):02x}" if ord(c) < 32 or ord(c) == 127 else c) for c in text)


def _width(text: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


#: Bytes of a table that stay in memory while its widths are found; more go to a file.
_IN_MEMORY = 16 << 20


def table_rows(names: list[str], rows: Iterator) -> Iterator[str]:
    """Gone through once for its widths, kept in a file meanwhile, so that a long table takes disk and not memory; nothing at all for no rows."""
    heads = [_shown(n) for n in names]
    widths, some = [_width(h) for h in heads], False
    with tempfile.SpooledTemporaryFile(_IN_MEMORY, "w+", encoding="utf-8", newline="\n") as body:
        for row in rows:
            line = [_shown(plain(v)) for v in row]
            widths = [max(w, _width(c)) for w, c in zip(widths, line, strict=True)]
            body.write("\t".join(line) + "\n")  # no cell holds a tab or a line break any more
            some = True
        if not some:
            return
        rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
        show = lambda line: "|" + "|".join(f" {c}{' ' * (w - _width(c))} " for c, w in zip(line, widths, strict=True)) + "|"
        yield from (rule, show(heads), rule)
        body.seek(0)
        for line in body:
            yield show(line[:-1].split("\t"))
        yield rule


FORMATS = {"JSON": json_rows, "TSKV": tskv_rows, "CSVHeader": csv_rows, "PrettyTable": table_rows}


def write(result: Result, fmt: str, out: TextIO, frame: DataFrame | None = None) -> None:
    """One result and the blank line after it; ``frame``: the result's, if the caller wants to look at it later."""
    rows = (tuple(row) for row in (result.frame if frame is None else frame).toLocalIterator(prefetchPartitions=True))
    for line in FORMATS[fmt]([f.name for f in result.fields], rows):
        out.write(line + "\n")
    out.write("\n")
