"""Types, fields and bound expressions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

NULL, BOOLEAN, INTEGER, FLOATING, STRING = "Null", "Boolean", "Integer", "Floating", "String"
#: Types of catalog columns that the language can only pass on, compare and count.
OPAQUE = "Opaque"
ORDERED = (INTEGER, FLOATING, STRING, OPAQUE)


@dataclass(frozen=True)
class Field:
    """A column is its name and its type: one name may occur with several types."""

    name: str
    type: str

    @property
    def column(self) -> str:
        return f"{self.name}:{self.type}"


@dataclass(eq=False)
class Expr:
    """op: lit, ref, fn, agg or in. level: const, row or group. data: what the op needs beside its arguments.

    wide: a Floating that is held in 64 bits, as catalog columns may be; literals adapt.
    """

    op: str
    type: str
    level: str
    args: list[Expr] = field(default_factory=list)
    data: object = None
    wide: bool = False
    span: tuple[int, int] = (0, 0)

    def walk(self) -> Iterator[Expr]:
        yield self
        for a in self.args:
            yield from a.walk()

    def aggregates(self) -> list[Expr]:
        """Outermost aggregates."""
        return [self] if self.op == "agg" else [x for a in self.args for x in a.aggregates()]

    def refs(self) -> set[tuple[str, Field]]:
        return {x.data for x in self.walk() if x.op == "ref"}

    def dump(self, indent: int = 0) -> str:
        label = {"ref": lambda: f"{self.data[0]}:{self.data[1].name}", "lit": lambda: repr(self.data), "in": lambda: "in"}.get(self.op, lambda: str(self.data))()
        return f"{'  ' * indent}{self.op} {label}: {self.type} ({self.level})\n" + "".join(a.dump(indent + 1) for a in self.args)
