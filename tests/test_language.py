"""Lexer, parser, macros and binding errors: nothing here runs Spark jobs."""

import pytest

from logspark import BindError, Engine, ParseError
from logspark.lang import expand_program, parse
from logspark.lang import nodes as n
from logspark.lang.lexer import tokens


def kinds(text):
    return [t.kind for t in tokens(text)][:-1]


def test_longest_match():
    assert kinds("8/2") == ["path"] and kinds("a-b") == ["path"] and kinds("8 / 2") == ["int", "/", "int"]
    assert kinds("1+2.5") == ["int", "float"]
    assert kinds("a.b input.1.txt ./x 2026-05-06T12:00:00") == ["dotted", "path", "path", "time"]
    assert kinds("SELECTED SELECT def define") == ["name", "SELECT", "def", "name"]
    assert kinds("UNION ALL SORTED BY x -- rest\n-----\n'it' $a") == ["UNION ALL SORTED BY", "name", "str", "$", "name"]
    with pytest.raises(ParseError):
        tokens("a ? b")


def expr(text):
    return parse(f"SELECT {text} AS x FROM (0)")[0].relation.items[0].expr


def test_precedence():
    assert expr("NOT a = b") == n.Unary("NOT", n.Binary("=", n.Name("a"), n.Name("b")))
    assert expr("!a = b") == n.Binary("=", n.Unary("NOT", n.Name("a")), n.Name("b"))
    assert expr("a OR b AND c") == n.Binary("OR", n.Name("a"), n.Binary("AND", n.Name("b"), n.Name("c")))
    assert expr("1 - 2 - 3 / 4") == n.Binary("-", n.Binary("-", n.Lit(1, "Integer"), n.Lit(2, "Integer")), n.Binary("/", n.Lit(3, "Integer"), n.Lit(4, "Integer")))
    assert isinstance(expr("a + 1 IN (1) AND b"), n.Binary) and isinstance(expr("a + 1 IN (1)"), n.In)
    assert expr("a LIKE 'x' = true").op == "="


def test_statements_need_no_separator():
    program = parse("a = x.log\nSELECT b FROM $a ORDER BY b\nc = $a AS d\n('v') AS top")
    assert [type(s).__name__ for s in program] == ["Named", "Query", "Named", "Query"]


def test_sorted_union_binds_tighter():
    rel = parse("(1) UNION ALL (2) UNION ALL SORTED BY (anon) (3)")[0].relation
    assert isinstance(rel, n.Union) and isinstance(rel.right, n.Merge)
    assert parse("(1) UNION ALL SORTED BY anon DESC (2)")[0].relation.descending


def test_macros_expand():
    (q,) = expand_program(parse("def Add(x, y) = x + y\ndef twice(x) = ADD(x, x)\nSELECT twice(3) AS r FROM (0)"))
    assert q.relation.items[0].expr == n.Binary("+", n.Lit(3, "Integer"), n.Lit(3, "Integer"))


@pytest.mark.parametrize(
    ("program", "message"),
    [
        ("SELECT a FROM x.log WHERE COUNT(*) = 1", "WHERE condition cannot be aggregate"),
        ("SELECT l.missing FROM (1) AS l", "unknown identifier 'l.missing'"),
        ("SELECT anon FROM (1) AS l", "unknown identifier 'anon'"),
        ("a = x.log.gz @ 2026-05-06T12:00:00 + 1\nSELECT u FROM $a", "time intervals cannot be applied to archives"),
        ("SELECT u FROM x.log @ 2026-05-06T12:00:02 'ODD'", "invalid time format 'ODD'"),
        ("SELECT COUNT(*) AS n FROM x.log HAVING COUNT(*) > 1", "HAVING requires GROUP BY"),
        ("SELECT u FROM x.log WHERE u IN (1, 2)", "in key type mismatch"),
        ("SELECT (u IN (1, 2)) IN (true) AS k FROM x.log", "in key type mismatch"),
        ("s = (SELECT * FROM x.log WHERE u = 'a')\nSELECT u FROM x.log WHERE u IN $s\nSELECT v FROM $s", "in match should contain one column, got 2"),
        ("s = x.log\nSELECT u IN $s AS k FROM x.log\nSELECT u, v FROM $s", "in match should contain one column, got 2"),
        ("SELECT u FROM x.log WHERE u IN (SELECT u, v FROM x.log)", "in match should contain one column, got 2"),
        ("SELECT l.anon FROM (1) AS l LEFT JOIN (1) AS r ON COUNT(l.anon) = r.anon", "LEFT JOIN keys cannot be aggregate expressions"),
        ("SELECT l.anon FROM ('a') AS l LEFT JOIN ('a') AS l ON l.anon = l.anon", "LEFT JOIN inputs have overlapping field 'l.anon'"),
        ("SELECT anon FROM (1) LEFT JOIN (1) ON anon = anon", "LEFT JOIN inputs have overlapping field 'anon'"),
        ("SELECT l.anon FROM ('a') AS l LEFT JOIN ('a') AS r ON l.anon != r.anon", "LEFT JOIN ON requires a single equality"),
        ("SELECT l.anon FROM ('a') AS l LEFT JOIN ('a') AS r ON l.anon = r.anon AND true", "LEFT JOIN ON requires a single equality"),
        ("SELECT l.anon FROM (1) AS l LEFT JOIN ('a') AS r ON l.anon = r.anon", "unsupported operand types Integer, String for binary operation Equal"),
        ("SELECT l.anon FROM (1) AS l LEFT JOIN (1) AS r ON (l.anon + r.anon) = r.anon", "LEFT JOIN keys must each reference only their own input"),
        ("SELECT l.anon FROM ('a') AS l LEFT JOIN ('a') AS r ON l.anon = l.anon", "LEFT JOIN keys must each reference only their own input"),
        ("SELECT l.anon FROM ('a') AS l LEFT JOIN ('a') AS r ON l.anon = x.anon", "unknown identifier 'x.anon'"),
        (
            "s = x.log\na = (SELECT *, 1 AS k FROM $s)\nb = (SELECT *, 1 AS m FROM $s)\nj = $a LEFT JOIN $b ON k = m\nSELECT k FROM $j\nSELECT shared FROM $s",
            "LEFT JOIN inputs have overlapping field 'shared'",
        ),
        ("def maximum(x) = MAX(x)\nSELECT anon FROM (1, 2) WHERE maximum(anon) > 0", "WHERE condition cannot be aggregate"),
        ("def add(x, y) = x + y\nSELECT add(1) AS r FROM (0)", "macro 'add' expects 2 arguments, got 1"),
        ("def LOWER(x) = x", "macro 'lower' conflicts with a built-in function"),
        ("def value() = 1\ndef VALUE() = 2", "duplicate macro 'value'"),
        ("def add(x, x) = x + x", "duplicate macro parameter 'x'"),
        ("SELECT later(1) AS r FROM (0)\ndef later(x) = x", "unknown function or macro 'later'; macros must be defined before use"),
        ("def r(x) = r(x)", "unknown function or macro 'r'; macros must be defined before use"),
        ("def bad(x) = x + Int(uid)\nSELECT bad(1) AS r FROM f.log", "unknown macro parameter 'uid'; pass fields as macro arguments"),
        ("def inc(x) = x + 1\nSELECT inc('t') AS r FROM (0)", "unsupported operand types String, Integer for binary operation Add"),
        ("SELECT u, COUNT(*) AS n FROM x.log", "identifier projectors are not allowed in aggregates"),
        ("SELECT u FROM $missing", "unknown named relation 'missing'"),
        ("p = (SELECT u FROM x.log)\nSELECT status FROM $p", "unknown identifier 'status'"),
        ("SELECT MAX(COUNT(*)) AS m FROM (1)", "aggregates cannot be nested"),
        ("SELECT SUM(true) AS s FROM (1)", "function 'sum' does not take Boolean"),
        ("(1, 'a')", "values have different types"),
        ("(1) UNION ALL ('a')", "UNION ALL inputs have different fields"),
        ("SELECT anon FROM (1) GROUP BY anon HAVING COUNT(*) IN (1)", "IN key cannot be an aggregate"),
        ("SELECT JSON_VALUE(a, 'x..y') AS v FROM f.log", "invalid JSON path"),
    ],
)
def test_bind_errors(program, message):
    with pytest.raises(BindError) as e:
        Engine(None).bind(program)
    assert message in e.value.message
    assert e.value.span is not None and message in e.value.shown(program)


def test_late_fields_widen_star():
    (_, source), (_, star), (_, other) = Engine(None).bind("s = x.log\nSELECT * FROM $s\nSELECT a, b FROM $s")
    assert [f.name for f in star.fields()] == ["a", "b"] == [f.name for f in source.fields()]
    assert [f.name for f in other.fields()] == ["a", "b"]


def test_dumps():
    from logspark.lang.nodes import dump

    text = "SELECT a AS b, COUNT(*) AS n FROM x.log WHERE a LIKE 'q' GROUP BY a AS b ORDER BY n LIMIT 3"
    assert "Select(" in dump(parse(text)) and "limit=3" in dump(parse(text))
    assert "agg ('count_all',): Integer (group)" in Engine(None).bind(text.replace("a AS b, C", "b, C"))[0][1].dump()
