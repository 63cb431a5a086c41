"""Syntax tree. Every node has the span of its text."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass

Span = tuple[int, int]


@dataclass
class Node:
    span: Span = field(default=(0, 0), kw_only=True, compare=False)


# ---- expressions


@dataclass
class Lit(Node):
    value: object
    type: str


@dataclass
class Name(Node):
    name: str


@dataclass
class Call(Node):
    name: str
    args: list
    star: bool = False


@dataclass
class Unary(Node):
    op: str
    arg: object


@dataclass
class Binary(Node):
    op: str
    left: object
    right: object


@dataclass
class Like(Node):
    arg: object
    pattern: str


@dataclass
class In(Node):
    key: object
    match: object


# ---- relations


@dataclass
class Values(Node):
    values: list[Lit]


@dataclass
class File(Node):
    path: str
    time_from: str | None = None
    seconds: int | None = None
    time_format: str | None = None


@dataclass
class Stream(Node):
    command: str


@dataclass
class Ref(Node):
    name: str


@dataclass
class Materialize(Node):
    source: object


@dataclass
class Alias(Node):
    source: object
    name: str


@dataclass
class LeftJoin(Node):
    left: object
    right: object
    on: object


@dataclass
class Union(Node):
    left: object
    right: object


@dataclass
class Merge(Node):
    left: object
    right: object
    keys: list
    descending: bool


@dataclass
class Item(Node):
    """One entry of a select or group list: ``*`` (expr None), or an expression with its name; plain: a bare field."""

    expr: object
    name: str | None
    plain: bool = False


@dataclass
class Select(Node):
    items: list[Item]
    source: object
    where: object = None
    group: list[Item] | None = None
    having: object = None
    order: list | None = None
    descending: bool = False
    limit: int | None = None


# ---- statements


@dataclass
class Query(Node):
    relation: object


@dataclass
class Named(Node):
    name: str
    relation: object


@dataclass
class Macro(Node):
    name: str
    params: list[str]
    body: object


def dump(node, indent: int = 0) -> str:
    """Indented text of a tree."""
    pad = "  " * indent
    if isinstance(node, list):
        return "".join(dump(x, indent) for x in node)
    if not is_dataclass(node):
        return f"{pad}{node!r}\n"
    flat, deep = [], []
    for f in fields(node):
        value = getattr(node, f.name)
        if f.name == "span" or value is None:
            continue
        if is_dataclass(value) or isinstance(value, list) and value and is_dataclass(value[0]):
            deep.append((f.name, value))
        else:
            flat.append(f"{f.name}={value!r}")
    out = f"{pad}{type(node).__name__}({', '.join(flat)})\n"
    for name, value in deep:
        out += f"{pad}  {name}:\n{dump(value, indent + 2)}"
    return out
