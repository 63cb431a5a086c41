"""Line formats: detection on the driver, one native expression per requested field.

Only fields that a query needs are ever cut from a line; a row's validity is an expression of its own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.jsonpath import json_fields, json_line, simple_field, simple_line

LINE = "_line"
#: Fixed value: keyless parts of a line have names up to this number.
MOST_ANON = 32


def anon_index(name: str) -> int | None:
    """k for ``anonK`` with K from 1 on, less one."""
    m = re.fullmatch(r"anon([1-9][0-9]?)", name)
    return int(m[1]) - 1 if m and int(m[1]) <= MOST_ANON else None


def _after_last(text: Column, mark: str, end: str) -> Column:
    """What stands between the last ``mark`` and the next ``end``; null without a mark. Byte search, no pattern."""
    return F.when(F.contains(text, F.lit(mark)), F.substring_index(F.substring_index(text, mark, -1), end, 1))


def _keyless(parts: Column, k: int) -> Column:
    return F.get(F.filter(parts, lambda p: ~F.contains(p, F.lit("="))), F.lit(k))


@dataclass(frozen=True)
class Format:
    name: str
    time_format: str | None = None
    #: Where every line's timestamp begins, from 1 on, if the format fixes it and nothing stands before it.
    time_place: int | None = None

    def detect(self, line: str) -> bool:
        raise NotImplementedError

    def valid(self, line: Column) -> Column | None:
        """None: every line is."""
        return None

    def fields(self, line: Column, names: list[str]) -> dict[str, Column]:
        return {k: self.field(line, k) for k in names}

    def field(self, line: Column, name: str) -> Column:
        raise NotImplementedError


class Tskv(Format):
    def detect(self, line: str) -> bool:
        return "tskv" in line.split("\t")

    def field(self, line: Column, name: str) -> Column:
        keyed = _after_last(F.concat(F.lit("\t"), line), f"\t{name}=", "\t")
        if (k := anon_index(name)) is None:
            return keyed
        return F.coalesce(_keyless(F.split(line, "\t", -1), k), keyed)


class TsLogfmt(Format):
    def detect(self, line: str) -> bool:
        return line.startswith("[") and len(line.encode()) >= 21

    def valid(self, line: Column) -> Column:
        return F.octet_length(line) >= 21

    def field(self, line: Column, name: str) -> Column:
        rest = F.substring(line, 22, 2_000_000_000)
        keyed = _after_last(rest, f" {name}=", " ")
        if name == "timestamp":
            return F.coalesce(keyed, F.substring(line, 2, 20))
        if (k := anon_index(name)) is None:
            return keyed
        tail = F.when(F.contains(rest, F.lit(" ")), F.substring(rest, F.instr(rest, " ") + 1, F.length(rest)))
        return F.coalesce(_keyless(F.split(tail, " ", -1), k), keyed)


class Jsonl(Format):
    def detect(self, line: str) -> bool:
        return json_fields(line, []) is not None

    def fields(self, line: Column, names: list[str]) -> dict[str, Column]:
        raise NotImplementedError  # read as one array by ``parse``


# A quoted field with doubled quotes, or a bare one; possessive, so that long fields don't recurse.
_CSV_FIELD = r'(?:"[^"\r]*+(?:""[^"\r]*+)*+"|[^",\r]*+)'


class Csv(Format):
    def detect(self, line: str) -> bool:
        line = line.removesuffix("\r")
        bare = re.sub(r'"[^"]*(?:"|$)', "", line)
        return "\t" not in bare and "," in line and bool(re.fullmatch(rf"{_CSV_FIELD}(?:,{_CSV_FIELD})+", line))

    def _stripped(self, line: Column) -> Column:
        return F.regexp_replace(line, r"\r\z", "")

    def valid(self, line: Column) -> Column:
        return self._stripped(line).rlike(rf"\A{_CSV_FIELD}(?:,{_CSV_FIELD})*+\z")

    def field(self, line: Column, name: str) -> Column:
        if (k := anon_index(name)) is None:
            return F.lit(None).cast("string")
        # One expression for all fields of a line, which Spark evaluates once; a comma in front gives each field one.
        own = F.get(F.regexp_extract_all(F.concat(F.lit(","), self._stripped(line)), F.lit(rf",({_CSV_FIELD})"), F.lit(1)), F.lit(k))
        return F.when(F.startswith(own, F.lit('"')), F.replace(F.substring(own, F.lit(2), F.length(own) - 2), F.lit('""'), F.lit('"'))).otherwise(own)


class Tsv(Format):
    def detect(self, line: str) -> bool:
        return "\t" in line

    def _stripped(self, line: Column) -> Column:
        return F.regexp_replace(line, r"\r\z", "")

    def valid(self, line: Column) -> Column:
        return ~F.contains(self._stripped(line), F.lit("\r"))

    def field(self, line: Column, name: str) -> Column:
        if (k := anon_index(name)) is None:
            return F.lit(None).cast("string")
        return F.get(F.split(self._stripped(line), "\t", -1), F.lit(k))


#: In the order of detection.
ALL = (Tskv("TSKV", "SQL"), TsLogfmt("TS_LOGFMT", "ORACLE", 2), Jsonl("JSONL"), Csv("CSV"), Tsv("TSV"))


def detect(line: str) -> Format | None:
    return next((f for f in ALL if f.detect(line)), None)


def parse(lines, fmt: Format | None, names: list[str]):
    """The named String fields of a DataFrame with one column ``value``; malformed lines go. ``_line`` is the line itself."""
    value = F.col("value")
    wanted = [k for k in names if k != LINE]
    line = [value.alias(LINE)] if LINE in names else []
    if not wanted:
        return lines.select(*line)
    if fmt.name == "JSONL":
        # Lines of a plain shape are read in place; only the others go to the scanner.
        plain = simple_line(value)
        row = lines.select("value", plain.alias("plain"), json_line(F.when(~plain, value), wanted).alias("parts")).filter("plain or parts is not null")
        return row.select(*[F.when(F.col("plain"), simple_field(value, k)).otherwise(F.get("parts", F.lit(i))).alias(k) for i, k in enumerate(wanted)], *line)
    valid = fmt.valid(value)
    kept = lines if valid is None else lines.filter(valid)
    return kept.select(*[c.alias(k) for k, c in fmt.fields(value, wanted).items()], *line)
