"""Lowering. Each relation is asked for the fields that are needed of it, from the query down to the scan.

A frame's columns are named by field (name and type). Catalyst prunes and pushes down from there; what it cannot know
is that a scan of which no field is needed counts raw lines, malformed ones included, so needs are passed explicitly.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bind import relations as r
from ..bind.types import FLOATING, NULL, OPAQUE, Expr, Field
from ..errors import SourceError
from ..functions import aggregate as agg
from ..functions import scalar
from ..operators import joins, ordering, percentile
from ..sources import files, formats

Needs = frozenset


@dataclass
class Options:
    base: str | None = None
    time_from: str | None = None
    time_to: str | None = None
    allow_stream: bool = False


class Env:
    """Columns of references, by tag and field, and of marks and aggregates, by expression."""

    def __init__(self, tags: dict[str, dict[Field, Column] | None] | None = None):
        self.tags = tags or {}
        self.known: dict[int, Column] = {}

    def ref(self, tag: str, f: Field) -> Column:
        own = self.tags.get(tag)
        return own[f] if own and f in own else F.col(f"`{f.column}`")


class Lowering:
    def __init__(self, spark: SparkSession, options: Options | None = None):
        self.spark, self.options = spark, options or Options()
        self.frames: dict[tuple[int, Needs], DataFrame] = {}
        self.kept: dict[int, DataFrame] = {}
        self.scans: dict[int, tuple[str, DataFrame]] = {}
        self.detected: dict[int, formats.Format | None] = {}

    def query(self, rel: r.Relation) -> DataFrame:
        """All fields of a relation, columns under the user's names."""
        own = rel.fields()
        df = self.frame(rel, frozenset(own))
        return df.select(*[F.col(f"`{f.column}`").alias(f.name) for f in own])

    def frame(self, rel: r.Relation, needs: Needs) -> DataFrame:
        """The needed fields, and only those."""
        key = (id(rel), needs)
        if key not in self.frames:
            df = getattr(self, "_" + type(rel).__name__.lower())(rel, needs)
            self.frames[key] = df.select(*[F.col(f"`{f.column}`") for f in sorted(needs, key=lambda f: f.column)])
        return self.frames[key]

    # ---- sources

    def _values(self, rel: r.Values, needs: Needs) -> DataFrame:
        kind = scalar.SPARK_TYPES[rel.type]
        column = rel.fields()[0].column
        if rel.type == NULL:
            return self.spark.range(len(rel.values)).select(F.lit(None).alias(column))
        return self.spark.createDataFrame([(v,) for v in rel.values], f"`{column}` {kind}").coalesce(1)

    def _catalog(self, rel: r.Catalog, needs: Needs) -> DataFrame:
        return rel.frame.select(*[scalar_column(f, f.name in rel.wide).alias(f.column) for f in needs])

    def _file(self, rel: r.File, needs: Needs) -> DataFrame:
        if id(rel) not in self.scans:
            path = files.located(rel.path, self.options.base)
            self.scans[id(rel)] = (path, files.lines(self.spark, path))
        path, lines = self.scans[id(rel)]
        names = sorted(f.name for f in needs)
        start, end = (rel.time_from, None) if rel.time_from else (self.options.time_from, self.options.time_to)
        ranged = (start or end) and not files.is_archive(path)
        fmt = None
        if any(k != formats.LINE for k in names) or (ranged and not rel.time_format):
            if id(rel) not in self.detected:
                self.detected[id(rel)] = files.detect(lines, path)
            fmt = self.detected[id(rel)]
        if ranged:
            lines = files.in_range(lines, path, fmt, rel.time_format, start, end, rel.seconds)
        return self._parsed(lines, fmt, names)

    def _parsed(self, lines: DataFrame, fmt: formats.Format | None, names: list[str]) -> DataFrame:
        if fmt is None and any(k != formats.LINE for k in names):
            lines = lines.filter(F.lit(False))  # no line has any format
            df = lines.select(*[F.lit(None).cast("string").alias(k) if k != formats.LINE else F.col("value").alias(k) for k in names])
        else:
            df = formats.parse(lines, fmt, names) if names else lines
        return df.select(*[F.col(f"`{k}`").alias(f"{k}:String") for k in names])

    def _stream(self, rel: r.Stream, needs: Needs) -> DataFrame:
        if not self.options.allow_stream:
            raise SourceError("STREAM runs a command on the driver; allow it with allow_stream")
        lines = files.command_lines(self.spark, rel.command)
        names = sorted(f.name for f in needs)
        fmt = None
        if any(k != formats.LINE for k in names):
            first = lines.first()
            fmt = formats.detect(first["value"]) if first else None
            if first and fmt is None:
                raise SourceError(f"can't detect the format of '{rel.command}'")
        return self._parsed(lines, fmt, names)

    # ---- wrappers and pairs

    def _alias(self, rel: r.Alias, needs: Needs) -> DataFrame:
        inner = {f: rel.inner(f) for f in needs}
        df = self.frame(rel.source, frozenset(inner.values()))
        return df.select(*[F.col(f"`{i.column}`").alias(o.column) for o, i in inner.items()])

    def _materialize(self, rel: r.Materialize, needs: Needs) -> DataFrame:
        if id(rel) not in self.kept:
            self.kept[id(rel)] = self.frame(rel.source, frozenset(rel.fields())).persist(StorageLevel.MEMORY_AND_DISK)
        return self.kept[id(rel)]

    def release(self) -> None:
        for df in self.kept.values():
            df.unpersist()

    def _union(self, rel: r.Union, needs: Needs) -> DataFrame:
        return ordering.union_all(self.frame(rel.left, needs), self.frame(rel.right, needs))

    def _merge(self, rel: r.Merge, needs: Needs) -> DataFrame:
        more = needs | {f for k in rel.keys for _, f in k.refs()}
        marked = [self.marks(self.frame(side, more), rel.keys, Env()) for side in (rel.left, rel.right)]
        keyed = [df.withColumns({f"__key{i}": self.column(k, env) for i, k in enumerate(rel.keys)}) for df, env in marked]
        wanted = [f"`{f.column}`" for f in more] + [f"__key{i}" for i in range(len(rel.keys))]
        left, right = (df.select(*[F.col(c) for c in wanted]) for df in keyed)
        return ordering.merge_sorted(left, right, [F.col(f"__key{i}") for i in range(len(rel.keys))], rel.descending)

    def _leftjoin(self, rel: r.LeftJoin, needs: Needs) -> DataFrame:
        sides = []
        for side, key in zip((rel.left, rel.right), rel.keys, strict=True):
            own = set(side.fields())
            df, env = self.marks(self.frame(side, frozenset(needs & own) | {f for _, f in key.refs()}), [key], Env())
            sides.append((df, self.column(key, env)))
        (left, a), (right, b) = sides
        return joins.left_join(left, right, a, b)

    # ---- select

    def _select(self, rel: r.Select, needs: Needs) -> DataFrame:
        outputs = [(f, e) for f, e in rel.outputs if f in needs]
        own = {f for f, _ in rel.outputs}
        passed = [f for f in rel.passed() if f in needs and f not in own]
        if rel.keys is not None or rel.aggregated:
            return self._grouped(rel, outputs, passed)
        exprs = [e for _, e in outputs] + rel.order
        # ORDER BY may name outputs: what those are made of is needed too.
        by_output = dict(rel.outputs)
        reached = [by_output[f] for k in rel.order for tag, f in k.refs() if tag == "out"]
        asked = [*exprs, *reached, *([rel.where] if rel.where else [])]
        source = frozenset(passed) | {f for e in asked for tag, f in e.refs() if tag == "src"}
        df, env = self.frame(rel.source, frozenset(source)), Env()
        if rel.where is not None:
            df = self.filter(df, rel.where, env)
        df, env = self.marks(df, [*exprs, *reached], env)
        env.tags["out"] = {f: self.column(e, env) for f, e in rel.outputs if e in reached or f in needs}
        if rel.order:
            df = ordering.sort(df, [self.column(k, env) for k in rel.order], rel.descending)
        df = df.select(*[F.col(f"`{f.column}`") for f in passed], *[env.tags["out"][f].alias(f.column) for f, _ in outputs])
        return df if rel.limit is None else df.limit(rel.limit)

    def _grouped(self, rel: r.Select, outputs: list, passed: list) -> DataFrame:
        keys = rel.keys or []
        by_output = dict(rel.outputs)
        after = [e for _, e in outputs] + rel.order + ([rel.having] if rel.having is not None else [])
        after += [by_output[f] for k in after for tag, f in k.refs() if tag == "out"]
        aggregates = list(dict.fromkeys(a for e in after for a in e.aggregates()))
        inner = [a for x in aggregates for a in x.args]
        source = {f for e in [*inner, *(k for _, k in keys), *([rel.where] if rel.where is not None else [])] for tag, f in e.refs() if tag == "src"}
        df, env = self.frame(rel.source, frozenset(source)), Env()
        if rel.where is not None:
            df = self.filter(df, rel.where, env)
        if any(agg.needs_order(a) for a in aggregates):
            df = df.withColumn(agg.ORDINAL, F.monotonically_increasing_id())
        # Keys are computed from the source and then stand for it: within aggregates they shadow fields of their name.
        if keys:
            df, env = self.marks(df, [e for _, e in keys], env)
            made = [self.column(e, env).alias(f.column) for f, e in keys]
            key_columns = {f.column for f, _ in keys}
            rest = [F.col(f"`{f.column}`") for f in source if f.column not in key_columns]
            df = df.select(*made, *rest, *([F.col(agg.ORDINAL)] if agg.ORDINAL in df.columns else []))
        df, env = self.marks(df, inner, Env())
        shares = [(i, a) for i, a in enumerate(aggregates) if a.data[0] == "percentile"]
        made = [agg.aggregate(a, self.column(a.args[0], env) if a.args else None).alias(f"__agg{i}") for i, a in enumerate(aggregates) if a.data[0] != "percentile"]
        rows = df
        names = [f.column for f, _ in keys]
        if keys:
            by = [F.col(f"`{k}`") for k in names]
            df = df.groupBy(*by).agg(*made) if made else df.select(*by).distinct()
        else:
            df = df.agg(*(made or [F.count(F.lit(1)).alias("__agg")]))
            if shares:
                names, df, rows = [percentile.ONE], df.withColumn(percentile.ONE, F.lit(1)), rows.withColumn(percentile.ONE, F.lit(1))
        for i, a in shares:
            df = percentile.attach(df, percentile.percentiles(rows, names, self.column(a.args[0], env), a.args[0].type, a.data[1], f"__agg{i}"), names)
        env = Env()
        env.known |= {id(a): F.col(f"__agg{i}") for i, a in enumerate(aggregates)}
        df, env = self.marks(df, [by_output[f] for f in by_output if by_output[f] in after], env)
        env.tags["out"] = {f: self.column(e, env) for f, e in rel.outputs if e in after}
        if rel.having is not None:
            df = self.filter(df, rel.having, env)
        if rel.order:
            df, env = self.marks(df, rel.order, env)
            df = ordering.sort(df, [self.column(k, env) for k in rel.order], rel.descending)
        df = df.select(*[F.col(f"`{f.column}`") for f in passed], *[env.tags["out"][f].alias(f.column) for f, _ in outputs])
        return df if rel.limit is None else df.limit(rel.limit)

    # ---- expressions

    def match(self, e: Expr) -> tuple[DataFrame, str]:
        """What an IN looks in. Spark doesn't know the size of rows that stand in the program: without a hint it deals out the other side by key."""
        own = e.data.fields()[0]
        df = self.frame(e.data, frozenset([own]))
        return F.broadcast(df) if _short(e.data) else df, own.column

    def filter(self, df: DataFrame, e: Expr, env: Env) -> DataFrame:
        """A bare IN is a semi-join, its negation an anti-join; any other IN becomes a column first."""
        flipped = e.op == "fn" and e.data == "NOT"
        inside = e.args[0] if flipped else e
        if inside.op == "in" and self._listed(inside, Env()) is None:
            df, env = self.marks(df, inside.args, env)
            return (joins.anti_join if flipped else joins.semi_join)(df, self.column(inside.args[0], env), *self.match(inside))
        df, env = self.marks(df, [e], env)
        return df.filter(self.column(e, env))

    def _listed(self, e: Expr, env: Env, key: Column | None = None) -> Column | bool | None:
        """IN over literal values needs no join."""
        if not isinstance(e.data, r.Values) or len(e.data.values) > 50:
            return None
        if key is None:
            return True
        wide = e.args[0].wide
        out = F.lit(False)
        for v in e.data.values:
            out = out | key.eqNullSafe(scalar.literal(v, e.data.type, wide))
        return out

    def marks(self, df: DataFrame, exprs: list[Expr], env: Env) -> tuple[DataFrame, Env]:
        """A column for every IN within ``exprs`` that needs a join; those within aggregates are left to the aggregate's own step."""
        done = Env(dict(env.tags))
        done.known = dict(env.known)

        def visit(e: Expr) -> None:
            nonlocal df
            if id(e) in done.known:
                return
            for a in e.args:
                visit(a)
            if e.op == "in" and self._listed(e, done) is None:
                df, mark = joins.mark_join(df, self.column(e.args[0], done), *self.match(e))
                done.known[id(e)] = mark

        for e in exprs:
            visit(e)
        return df, done

    def column(self, e: Expr, env: Env, wide: bool = False) -> Column:
        if id(e) in env.known:
            return env.known[id(e)]
        if e.op == "lit":
            return scalar.literal(e.data, e.type, wide)
        if e.op == "ref":
            return env.ref(*e.data)
        if e.op == "in":
            return self._listed(e, env, self.column(e.args[0], env, e.args[0].wide))
        # Literals are as wide as what they meet.
        meets = any(a.wide for a in e.args if a.type == FLOATING)
        return scalar.call(e, [self.column(a, env, meets or wide) for a in e.args])


def _short(rel: r.Relation) -> bool:
    """Whether a relation has no more rows than the program: literals and what is made of each of them, or one row of aggregates."""
    if isinstance(rel, r.Select) and rel.aggregated and rel.keys is None:
        return True
    return isinstance(rel, r.Values) or isinstance(rel, (r.Select, r.Alias, r.Materialize, r.Union)) and all(_short(x) for x in rel.inputs())


def scalar_column(f: Field, wide: bool) -> Column:
    """A catalog column in the width of its type."""
    x = F.col(f"`{f.name}`")
    return x if f.type == OPAQUE or wide else x.cast(scalar.SPARK_TYPES[f.type])
