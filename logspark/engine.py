"""The engine: programs in, DataFrames out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .bind import bind_program
from .bind import relations as r
from .bind.types import BOOLEAN, FLOATING, INTEGER, NULL, OPAQUE, STRING, Field
from .errors import BindError
from .lang import expand_program, parse
from .plans import Lowering, Options
from .ship import ship


def field_type(kind: T.DataType) -> str:
    """The language's type of a Spark type; what it has no type for can be passed on only."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INTEGER
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return FLOATING
    return {T.BooleanType: BOOLEAN, T.StringType: STRING, T.NullType: NULL}.get(type(kind), OPAQUE)


@dataclass
class Result:
    relation: r.Relation
    lowering: Lowering

    @property
    def fields(self) -> list[Field]:
        return self.relation.fields()

    @property
    def frame(self) -> DataFrame:
        """Columns under the user's names; two of one name (of different types) are kept apart by printing only."""
        return self.lowering.query(self.relation)


class Engine:
    """Runs programs on a session. Paths are relative to ``base``; ``$name`` also means a registered table, or one that ``find`` knows."""

    def __init__(
        self, spark: SparkSession, base: str | None = None, time_from: str | None = None, time_to: str | None = None, allow_stream: bool = False,
        find: Callable[[str], DataFrame | None] | None = None,
    ):
        self.spark, self.find = spark, find or (lambda name: None)
        self.options = Options(base, time_from, time_to, allow_stream)
        self.tables: dict[str, r.Catalog] = {}

    def register(self, name: str, frame: DataFrame) -> None:
        """Make a DataFrame known as ``$name``. Its 64-bit floats stay so; other columns take the language's types."""
        fields = [Field(f.name, field_type(f.dataType)) for f in frame.schema.fields]
        wide = {f.name for f in frame.schema.fields if isinstance(f.dataType, T.DoubleType)}
        self.tables[name] = r.Catalog(name, frame, fields, wide)

    def table(self, name: str) -> r.Catalog | None:
        if name not in self.tables and (frame := self.find(name)) is not None:
            self.register(name, frame)
        return self.tables.get(name)

    def bind(self, program: str) -> list[tuple[str | None, r.Relation]]:
        ranged = bool(self.options.time_from or self.options.time_to)
        return bind_program(expand_program(parse(program)), self.table, ranged)

    def results(self, program: str) -> list[Result]:
        """One result per query of the program, in order; named relations are shared between them."""
        ship(self.spark)
        lowering = Lowering(self.spark, self.options)
        return [Result(rel, lowering) for name, rel in self.bind(program) if name is None]

    def run(self, program: str) -> list[DataFrame]:
        out = []
        for result in self.results(program):
            names = [f.name for f in result.fields]
            if len(set(names)) < len(names):
                raise BindError(f"two output columns have one name: {', '.join(sorted({x for x in names if names.count(x) > 1}))}", result.relation.span)
            out.append(result.frame)
        return out

    def sql(self, program: str) -> DataFrame:
        """The only query of a program."""
        frames = self.run(program)
        if len(frames) != 1:
            raise BindError(f"expected one query, got {len(frames)}")
        return frames[0]
