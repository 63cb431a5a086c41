"""Personal data by candidate gradient boosting, in DataFrame and SQL expressions only.

Exact rules give the base spans. High-recall generators propose more: obfuscated addresses, numbers in the shapes of
cards and phones that the rules pass over, long strings that look like credentials. Format and context features of each
candidate go to boosted trees, which are applied as SQL conditions; a threshold for each kind selects what is added.
The trees are fitted on the driver: generated texts hold planted data and look-alikes, the same generators and feature
expressions run over them, and a candidate's label is whether it covers a planted span. Thresholds are calibrated on the
third of those texts that the trees have not seen.

Candidates that touch a base span are dropped; of those of different kinds that overlap, one that meets a better one is
dropped. Spans of a kind are sorted and disjoint, so both are binary searches.
"""

from __future__ import annotations

import json
import math
import random
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import let

# The kinds in order, and their patterns in the engine's syntax. Possessive repeats and the checks of
# what stands before a match change no match: they keep long runs linear and off the stack.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_CHEAP = {"email": "@", "ip": ".", "card": None, "phone": "+"}  # a character without which there is no match
#: What the method may add; ``secret`` has no base rule.
ADDED_KINDS = ("email", "card", "phone", "secret")
ALL_KINDS = (*KINDS, "secret")
GENERATORS = {
    "email": r"(?i)\b[a-z0-9][a-z0-9._-]{0,63}+\s?(?:\[at\]|\(at\)|\{at\}|@)\s?[a-z0-9-]{1,63}+(?:\s?(?:\[dot\]|\(dot\)|\{dot\}|\.)\s?[a-z0-9-]{1,63}+){1,8}+",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{12,19}+|[0-9]{3,6}+(?:[./_: -][0-9]{2,7}+){2,5}+)(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])(?:\([0-9]{2,4}\)|[0-9]{2,4}+)[ ./-][0-9]{3,4}+[ ./-]?[0-9]{3,4}(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,200}+={0,2}+(?![A-Za-z0-9+/_=-])",
}
#: Without a match of these there is no candidate.
_HINTS = {"email": r"(?i)@|[\[({]at[\])}]", "card": r"[0-9]{2}", "phone": r"[0-9]{2}", "secret": r"[A-Za-z0-9+/_-]{20}"}
CONTEXT = 24
CUES = {
    "email": "mail|contact|write|reply", "card": "card|visa|credit|account|pay|iban", "phone": "tel|phone|call|mobile|fax|dial",
    "secret": "token|secret|key|passw|pwd|auth|bearer|credential",
}
FEATURES = (
    "kind", "length", "digits", "groups", "parens", "masks", "same_separator", "luhn", "cue", "letter_before", "letter_after", "sum_mark", "upper", "hex", "switches", "words",
)
_BLOCK = 256


def _running(values: Column, op, start: int) -> Column:
    """Running values of ``op`` (a sum or a maximum) in two levels, so that arrays are copied by blocks and not whole for each element."""
    first = F.lit(start).cast("long")

    def run(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(v) - 1) / _BLOCK).cast("int")), lambda b: F.slice(v, b * _BLOCK + 1, _BLOCK))
        empty = F.array().cast("array<long>")

        def ends(blocks: Column) -> Column:
            total = lambda x: F.aggregate(x, first, op)
            grown = lambda acc, add: F.concat(acc, F.array(op(F.coalesce(F.try_element_at(acc, F.lit(-1)), first), add)))
            starts = F.aggregate(F.transform(blocks, total), F.array(first), grown)
            inner = F.zip_with(
                blocks, F.slice(starts, 1, F.size(blocks)),
                lambda b, s: F.aggregate(b, empty, lambda acc, y: F.concat(acc, F.array(op(F.coalesce(F.try_element_at(acc, F.lit(-1)), s), y)))),
            )
            return F.flatten(inner)

        return let(blocks, ends)

    return let(values, lambda v: F.when(F.size(v) == 0, F.array().cast("array<long>")).otherwise(run(v)))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def find(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<s, e, m, b, a>>: code points, end exclusive; b and a: the text next to it, up to the neighbouring matches.

    Positions come from the gaps between matches, so that a text of any length is gone through a few times only.
    """
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def build(x: Column) -> Column:
        sizes = F.zip_with(x["m"], F.slice(x["g"], 1, F.size(x["m"])), lambda m, g: (F.length(m) + F.length(g)).cast("long"))

        def one(ends: Column):
            return lambda m, i: F.struct(
                (F.get(ends, i) - F.length(m)).alias("s"), F.get(ends, i).alias("e"), m.alias("m"),
                F.right(F.get(x["g"], i), F.lit(CONTEXT)).alias("b"), F.left(F.get(x["g"], i + 1), F.lit(CONTEXT)).alias("a"),
            )

        return let(_running(sizes, _sum, 0), lambda ends: F.transform(x["m"], one(ends)))

    none = F.array().cast("array<struct<s:bigint,e:bigint,m:string,b:string,a:string>>")
    return F.when(F.size(matches) == 0, none).otherwise(let(F.struct(matches.alias("m"), gaps.alias("g")), build))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when(i % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + value(i))
    return F.when(n > 0, total % 10 == 0).otherwise(F.lit(False))


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))
    if kind == "card":
        return let(_digits(m), lambda d: F.length(d).between(12, 19) & luhn(d))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


_SPAN = "array<struct<s:bigint,k:int,e:bigint>>"


def base_spans(text: Column, kind: str) -> Column:
    found = F.transform(F.filter(find(text, BASE[kind]), lambda x: _valid(kind, x["m"])), lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e")))
    cheap = F.contains(text, F.lit(_CHEAP[kind])) if _CHEAP[kind] else F.lit(True)
    if kind != "email":
        cheap = cheap & text.rlike("[0-9]")
    return F.when(cheap, found).otherwise(F.array()).cast(_SPAN)


def _features(kind: str, m: Column, before: Column, after: Column) -> dict[str, Column]:
    digits = _digits(m)
    marks = F.regexp_replace(m, r"[0-9A-Za-z]+", "")
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    count = lambda pattern: F.regexp_count(m, F.lit(pattern)).cast("double")
    return {
        "kind": F.lit(float(ALL_KINDS.index(kind))), "length": F.length(m).cast("double"), "digits": F.length(digits).cast("double"),
        "groups": F.size(F.split(m, r"[^0-9A-Za-z]+")).cast("double"), "parens": one(m.rlike(r"\(")), "masks": one(m.rlike(r"(?i)[\[({](?:at|dot)[\])}]")),
        "same_separator": one((F.length(marks) > 0) & (F.length(F.replace(marks, F.substring(marks, 1, 1), F.lit(""))) == 0)),
        "luhn": one(luhn(F.right(digits, F.lit(19)))), "cue": one(before.rlike(rf"(?i)(?:{CUES[kind]})")),
        "letter_before": one(before.rlike(r"[A-Za-z0-9=\"'#$./]$")), "letter_after": one(after.rlike(r"^[A-Za-z0-9\"'%$./]")),
        "sum_mark": one(before.rlike(r"(?i)(?:total|sum|no\.?|id|version|page|usd|eur|time|\$)[^A-Za-z]{0,3}$")),
        "upper": count("[A-Z]"), "hex": one(m.rlike(r"\A[0-9a-fA-F]+\z")), "switches": count("[A-Za-z][0-9]"), "words": count("[A-Za-z]{4,}"),
    }


def generated(n: int = 700, seed: int = 23) -> list[dict]:
    """Texts of invented words with planted data and look-alikes: [{text, planted: [(kind, start, end)]}]."""
    rng = random.Random(seed)
    pick = rng.choice
    d = lambda k: "".join(pick("0123456789") for _ in range(k))
    w = lambda a=2, b=9: "".join(pick("abcdefghijklmnoprstuvwéñö") for _ in range(rng.randint(a, b)))
    plain = lambda a=3, b=9: "".join(pick("abcdefghijklmnoprstuvw") for _ in range(rng.randint(a, b)))
    mixed = lambda letters, k: "".join(pick(letters) for _ in range(k))
    hexes, base = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def card() -> str:
        x = d(16)
        for last in "0123456789":  # the one check digit that Luhn's rule accepts
            y = x[:15] + last
            if sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(y))) % 10 == 0:
                x = y
                break
        sep = pick("./_:")
        return sep.join(x[i : i + 4] for i in range(0, 16, 4))

    def personal() -> tuple[str, str, str]:
        """(kind, words before, data)"""
        kind = pick(ADDED_KINDS)
        cue = f"{pick(CUES[kind].split('|'))}{pick([' ', ': ', ' is '])}" if rng.random() < 0.4 else ""
        if kind == "email":
            at, dot, space = pick(["[at]", "(at)", "{at}"]), pick(["[dot]", "(dot)", "."]), pick(["", " "])
            return kind, cue, f"{plain()}.{plain()}{space}{at}{space}{plain()}{space}{dot}{space}{pick(['com', 'net', 'org'])}"
        if kind == "card":
            return kind, cue, pick([card(), d(pick([15, 16, 16, 16, 19]))])
        if kind == "phone":
            a, b, c = d(3), d(3), d(4)
            return kind, cue, pick([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}"])
        value = pick([mixed(hexes, pick([32, 40, 64])), mixed(base, rng.randint(24, 64)), f"{pick(['sk-', 'AKIA', 'ghp_', 'key-'])}{mixed(base, rng.randint(20, 40))}"])
        cue = pick(["token", "secret", "api_key", "password", "Bearer", "auth"]) if rng.random() < 0.8 else ""
        quote = pick(['"', "'", ""])
        return kind, f"{cue}{pick([' = ', '=', ': ', ' '])}{quote}" if cue else "", value

    def alike() -> str:
        y, m, day = str(rng.randint(1900, 2040)), f"{rng.randint(1, 12):02}", f"{rng.randint(1, 28):02}"
        return pick([
            f"{y}-{m}-{day} {d(2)}:{d(2)}:{d(2)}", f"{y}.{m}.{day}", f"{day}/{m}/{y}", f"{y}-{y}", f"{y} {d(4)}{d(4)}", f"{d(2)} {d(4)}", f"{d(3)} {d(3)}{d(3)}", f"v{d(1)}.{d(2)}.{d(3)}",
            f"version {d(3)}.{d(3)}.{d(3)}", f"{d(1)}.{d(15)}", f"id {d(12)}", f"id={d(14)}", f"no. {d(13)}", f"time 1{d(12)}", f"total {d(3)} {d(3)} {d(4)}", f"page {d(3)}-{d(3)}-{d(4)}",
            f"usd {d(3)} {d(3)} {d(3)}", f"{plain()} @ {plain()}. {plain()}", f"{plain()} at {plain()} dot {plain()}", f"http://{plain()}.org/{plain()}/{plain()}/{plain()}-{plain()}",
            f"{plain(6, 9)}_{plain(6, 9)}_{plain(6, 9)}", f"{plain(8, 9)}-{plain(8, 9)}-{plain(6, 9)}", "".join(plain(5, 8).title() for _ in range(4)), plain(20, 30), "-" * rng.randint(20, 60), "_" * 30,
            f"{plain()}/{plain()}/{plain()}/{plain()}/{plain()}", f"{mixed(hexes, 8)}-{mixed(hexes, 4)}-4{mixed(hexes, 3)}-a{mixed(hexes, 3)}-{mixed(hexes, 12)}", f"isbn 978-{d(1)}-{d(3)}-{d(5)}-{d(1)}",
        ])

    out = []
    for _ in range(n):
        text, planted = "", []
        for _ in range(rng.randint(1, 6)):
            text += " ".join(w() for _ in range(rng.randint(2, 8))) + pick([" ", " ", ". ", ", "])
            if rng.random() < 0.5:
                kind, before, data = personal()
                text += before
                planted.append((kind, len(text), len(text) + len(data)))
                text += data + pick(['"' if before.endswith('"') else " ", " ", ".", "!! ", "### ", ", "])
            else:
                text += alike() + pick([" ", ". ", ", "])
        out.append({"text": text, "planted": planted})
    return out


def _grow(x: list[list[float]], g: list[float], h: list[float], rows: list[int], depth: int):
    """A tree as (feature, threshold, left, right) or a leaf's value; left: at most the threshold."""
    total_g, total_h = sum(g[i] for i in rows), sum(h[i] for i in rows)
    leaf = -total_g / (total_h + 1.0)
    if not depth or len(rows) < 12:
        return leaf
    best = (1e-3, None, None)
    for f in range(len(FEATURES)):
        by_value: dict[float, list[float]] = {}
        for i in rows:
            s = by_value.setdefault(x[i][f], [0.0, 0.0])
            s[0] += g[i]
            s[1] += h[i]
        left_g = left_h = 0.0
        values = sorted(by_value)
        for v, after in zip(values, values[1:], strict=False):
            left_g += by_value[v][0]
            left_h += by_value[v][1]
            gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
            if gain > best[0]:
                best = (gain, f, (v + after) / 2)
    _, f, t = best
    if f is None:
        return leaf
    return (f, t, _grow(x, g, h, [i for i in rows if x[i][f] <= t], depth - 1), _grow(x, g, h, [i for i in rows if x[i][f] > t], depth - 1))


def _value(tree, row: list[float]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def boost(x: list[list[float]], y: list[int], rounds: int = 16, rate: float = 0.4, depth: int = 3) -> list:
    score, trees = [0.0] * len(x), []
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in score]
        tree = _grow(x, [pi - yi for pi, yi in zip(p, y, strict=True)], [pi * (1 - pi) for pi in p], list(range(len(x))), depth)
        trees.append(tree)
        score = [s + rate * _value(tree, r) for s, r in zip(score, x, strict=True)]
    return trees


def _sql_tree(tree, row: Column, rate: float) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(rate * tree)
    f, t, left, right = tree
    return F.when(row[FEATURES[f]] <= t, _sql_tree(left, row, rate)).otherwise(_sql_tree(right, row, rate))


def _candidate(kind: str, x: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in _features(kind, x["m"], x["b"], x["a"]).items()])


def candidates(text: Column, kind: str) -> Column:
    """What the generator of a kind proposes: sorted and disjoint."""
    none = F.array().cast("array<struct<s:bigint,e:bigint,m:string,b:string,a:string>>")
    return F.when(text.rlike(_HINTS[kind]), find(text, GENERATORS[kind])).otherwise(none)


def proposals(texts: list[dict]) -> list[dict]:
    """Candidates of generated texts: kind, features in order, and whether a planted span of the kind is what they cover."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rows = json.dumps([{"i": i, "t": x["text"]} for i, x in enumerate(texts)])
    df = spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<i:int,t:string>>")))
    out = []
    for kind in ADDED_KINDS:
        found = df.select("i", F.explode(candidates(F.col("t"), kind)).alias("x"))
        for r in found.select("i", "x.s", "x.e", _candidate(kind, F.col("x")).alias("f")).collect():  # as many as the generated texts hold
            same = any(k == kind and min(e, r["e"]) - max(s, r["s"]) >= 0.8 * max(e - s, r["e"] - r["s"]) for k, s, e in texts[r["i"]]["planted"])
            out.append({"i": r["i"], "kind": kind, "x": [r["f"][n] for n in FEATURES], "y": int(same)})
    return out


def score(trees: list, x: list[float], rate: float) -> float:
    """Added up tree by tree as the SQL form does: sum() would round differently."""
    total = 0.0
    for t in trees:
        total += rate * _value(t, x)
    return total


@lru_cache(maxsize=4)
def fitted(rounds: int = 24, rate: float = 0.4, precision: float = 0.98) -> tuple[list, dict[str, float]]:
    """(trees, threshold of each kind): fitted on the candidates of two thirds of the texts, calibrated on the others to ``precision``."""
    rows = proposals(generated())
    fit = [r for r in rows if r["i"] % 3]
    trees = boost([r["x"] for r in fit], [r["y"] for r in fit], rounds, rate)
    limits = {}
    for kind in ADDED_KINDS:
        held = sorted(((score(trees, r["x"], rate), r["y"]) for r in rows if r["i"] % 3 == 0 and r["kind"] == kind), reverse=True)
        limit, good = math.inf, 0
        for n, (value, label) in enumerate(held, 1):
            good += label
            if good / n >= precision and value > 0:
                limit = value
        limits[kind] = limit
    return trees, limits


_SCORED = "array<struct<s:bigint,k:int,e:bigint,v:double>>"


def _until(spans: Column, field: str, at: Column, inclusive: bool) -> Column:
    """How many of sorted, disjoint spans have ``field`` < ``at`` (or <=): a binary search."""

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        value = F.get(spans, mid)[field]
        below = (value <= at) if inclusive else (value < at)
        more = acc["lo"] < acc["hi"]
        return F.struct(F.when(more & below, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(more & ~below, mid).otherwise(acc["hi"]).alias("hi"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi")), halve, lambda acc: acc["lo"])


def _touches(spans: Column, x: Column) -> Column:
    """Whether any of sorted, disjoint spans overlaps ``x``: the first that ends behind its start does, or none."""
    return F.coalesce(F.get(spans, _until(spans, "e", x["s"], True))["s"] < x["e"], F.lit(False))


def _beaten(spans: Column, x: Column) -> Column:
    """Whether ``x`` overlaps one of sorted, disjoint spans that is better: a higher score; of equal ones the first start, then the first kind."""
    better = lambda y: (y["v"] > x["v"]) | ((y["v"] == x["v"]) & ((y["s"] < x["s"]) | ((y["s"] == x["s"]) & (y["k"] < x["k"]))))
    around = let(_until(spans, "e", x["s"], True), lambda lo: F.slice(spans, lo + 1, F.greatest(F.lit(0), _until(spans, "s", x["e"], False) - lo)))
    return F.exists(around, better)


def _selected(text: Column, kind: str, base: dict[str, Column]) -> Column:
    """Candidates of a kind that reach its threshold and touch no base span."""
    rate = 0.4
    trees, limits = fitted(rate=rate)

    def scored(x: Column) -> Column:
        total = lambda f: sum((_sql_tree(t, f, rate) for t in trees), F.lit(0.0))
        return F.struct(x["s"].alias("s"), F.lit(ALL_KINDS.index(kind)).alias("k"), x["e"].alias("e"), let(_candidate(kind, x), total).alias("v"))

    def free(own: Column):
        def test(x: Column) -> Column:
            touched = F.lit(False)
            for k in KINDS:
                touched = touched | _touches(own[k], x)
            return ~touched

        return test

    found = F.filter(F.transform(candidates(text, kind), scored), lambda x: x["v"] >= limits[kind])
    every = F.struct(*[base[k].alias(k) for k in KINDS])
    return let(F.struct(found.alias("found"), every.alias("every")), lambda z: F.filter(z["found"], free(z["every"]))).cast(_SCORED)


def _added(picked: dict[str, Column]) -> Column:
    """Of the selected candidates of all kinds, those that meet no better one of another kind."""

    def left(kind: str):
        def of(z: Column) -> Column:
            def test(x: Column) -> Column:
                beaten = F.lit(False)
                for other in ADDED_KINDS:
                    if other != kind:
                        beaten = beaten | _beaten(z[other], x)
                return ~beaten

            return F.filter(z[kind], test)

        return of

    every = F.struct(*[picked[k].alias(k) for k in ADDED_KINDS])
    groups = [let(every, left(kind)) for kind in ADDED_KINDS]
    return F.transform(F.concat(*groups), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))).cast(_SPAN)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, one array of base spans per kind (s, k, e), base (all of them), added: of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    out = out.select("doc_id", "text", *[base_spans(F.col("text"), k).alias(k) for k in KINDS])
    own = {k: F.col(k) for k in KINDS}
    out = out.select("*", *[_selected(F.col("text"), k, own).alias(f"more_{k}") for k in ADDED_KINDS])
    more = {k: F.col(f"more_{k}") for k in ADDED_KINDS}
    none = F.array().cast(_SPAN)
    some = sum((F.size(c) for c in more.values()), F.lit(0)) > 0
    return out.select("doc_id", "text", *KINDS, F.concat(*KINDS).alias("base"), F.when(some, _added(more)).otherwise(none).alias("added"))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans.

    Null texts count as empty. Base spans of different kinds may overlap; added ones overlap nothing. ``n_``: base spans;
    n_added: what the method adds, credentials (``secret``) included; n_spans: all. Repeated rows stay and get the same
    result; null ids stay null. An empty table gives an empty result. Other columns are ignored.
    """
    found = spans(docs, id_col, text_col)
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the text with every span, overlapping ones merged, replaced by [KIND] of the first."""
    found = spans(docs, id_col, text_col).select("doc_id", "text", F.array_sort(F.concat("base", "added")).alias("all"))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in ALL_KINDS])

    def merged(z: Column) -> Column:
        """Runs of overlapping spans: a span that starts at or behind all ends so far begins one."""
        n = F.size(z["all"])
        begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(z["all"], i)["s"] >= F.get(z["end"], i - 1)))
        return let(begins, lambda b: F.transform(b, lambda i, j: F.struct(
            F.get(z["all"], i)["s"].alias("s"), F.get(names, F.get(z["all"], i)["k"]).alias("name"), F.get(z["end"], F.coalesce(F.get(b, j + 1), n) - 1).alias("e"),
        )))

    ends = _running(F.transform("all", lambda x: x["e"]), lambda a, b: F.greatest(a, b), 0)
    cut = lambda start, size: F.substring(F.col("text"), (start + 1).cast("int"), size.cast("int"))

    def pieces(runs: Column) -> Column:
        before = F.transform(runs, lambda x, i: let(F.coalesce(F.get(runs, i - 1)["e"], F.lit(0).cast("long")), lambda at: F.concat(cut(at, x["s"] - at), x["name"])))
        tail = cut(F.element_at(runs, -1)["e"], F.length("text"))
        return F.concat(F.array_join(before, ""), tail)

    runs = let(F.struct(F.col("all").alias("all"), ends.alias("end")), merged)
    return found.select("doc_id", F.when(F.size("all") == 0, F.col("text")).otherwise(let(runs, pieces)).alias("text"))
