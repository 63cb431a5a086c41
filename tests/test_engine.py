"""Programs against expected rows, printed as JSON."""

import gzip
import io
import json

import pytest

from logspark import BindError, Engine, SourceError
from logspark.cli import main
from logspark.sinks import write

LOG = """[2026-May-06 12:00:00.000000] uid=aaa status=ok latency=12 kind=api
[2026-May-06 12:00:01.000000] uid=bbb status=fail latency=x
short
[2026-May-06 12:00:02.000000] uid=aaa status= latency=30 tail = uid=zzz
[2026-May-06 12:00:04.000000] status=ok=1  latency=7
"""


@pytest.fixture(scope="session")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("logs")
    (d / "a.log").write_text(LOG)
    (d / "b.log").write_text("[2026-May-06 12:00:01.000000] uid=bbb path=/x\n[2026-May-06 12:00:03.000000] uid=ccc path=/y\n")
    (d / "open.log").write_text("[2026-May-06 12:00:01.000000] n=1\n[2026-May-06 12:00:01.000000] n=2")
    (d / "one.log").write_text("[2026-May-06 12:00:01.000000] n=1")
    (d / "crlf.log").write_bytes(b"[2026-May-06 12:00:01.000000] n=1\r\n")
    (d / "empty.log").write_text("")
    with gzip.open(d / "open.log.gz", "wt") as f:
        f.write((d / "open.log").read_text())
    (d / "t.tskv").write_text("tskv\ttimestamp=2026-05-06 12:00:01\tuid=a\tnote=x=y\tlone\ntskv\tuid=b\ttimestamp=2026-05-06 12:00:09\tuid=c\n")
    (d / "c.csv").write_text('1,"a, ""b""",,x\nbroken,"open\n2,mid"quote,3\n3,"x"y,1\n4,plain\r\n5,cr\rin,side\n')
    (d / "t.tsv").write_text('1\t"q"\t\n2\ta\tb\tc\r\n')
    (d / "j.jsonl").write_text(
        '{"id": 1, "u": "a\\"b", "n": null, "m": {"k": [1, 2.50]}, "r": 1.2300, "t": true}\n{"id": 2, "id": 3} x\n{bad\n [1]\n {"id": 4, "id": 5, "u": "\\u00e9"} \n{"id": NaN}\n{}\n'
    )
    return d


@pytest.fixture(scope="session")
def engine(spark, folder):
    return Engine(spark, str(folder), allow_stream=True)


def printed(engine, program):
    out = []
    for result in engine.results(program):
        buffer = io.StringIO()
        write(result, "JSON", buffer)
        out.append([json.loads(x) for x in buffer.getvalue().splitlines() if x])
    return out[0] if len(out) == 1 else out


def values(engine, program, *names):
    rows = printed(engine, program)
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in rows]


def test_logfmt(engine):
    assert values(engine, "SELECT timestamp, uid, status, anon1, anon2 FROM a.log ORDER BY timestamp", "uid", "status", "anon1", "anon2") == [
        ("aaa", "ok", None, None), ("bbb", "fail", None, None), ("zzz", "", "tail", None), (None, "ok=1", "", None),
    ]


def test_count_of_lines_and_of_rows(engine):
    assert values(engine, "SELECT COUNT(*) AS n FROM a.log", "n") == [5]
    assert values(engine, "SELECT COUNT(*) AS n FROM (SELECT uid FROM a.log)", "n") == [5]
    assert values(engine, "SELECT COUNT(*) AS n FROM a.log WHERE uid != 'q'", "n") == [4]
    assert values(engine, "SELECT COUNT(_line) AS n FROM a.log", "n") == [5]


def test_line_boundaries(engine):
    assert values(engine, "SELECT n FROM open.log", "n") == ["1"]
    assert values(engine, "SELECT n FROM ./open.log.gz", "n") == ["1", "2"]
    assert values(engine, "SELECT COUNT(*) AS n FROM one.log", "n") == [0]
    assert values(engine, "SELECT COUNT(*) AS n FROM empty.log", "n") == [0]
    assert values(engine, "SELECT x FROM empty.log", "x") == []
    assert values(engine, "SELECT SUBSTR(_line, 30) AS t FROM crlf.log", "t") == ["n=1\r"]
    assert values(engine, "SELECT n FROM STREAM 'cat /dev/null; printf \"[2026-May-06 12:00:01.000000] n=1\"'", "n") == ["1"]
    with pytest.raises(SourceError):
        printed(engine, "SELECT n FROM none.log")
    with pytest.raises(SourceError):
        printed(engine, "SELECT n FROM STREAM 'exit 3'")
    with pytest.raises(SourceError):
        Engine(engine.spark).run("SELECT n FROM STREAM 'true'")


def test_other_formats(engine):
    assert values(engine, "SELECT anon1, anon2, uid, note FROM t.tskv", "anon1", "anon2", "uid", "note") == [("tskv", "lone", "a", "x=y"), ("tskv", None, "c", None)]
    assert values(engine, "SELECT anon1, anon2, anon3, anon4 FROM c.csv", "anon1", "anon2", "anon3", "anon4") == [("1", 'a, "b"', "", "x"), ("4", "plain", None, None)]
    assert values(engine, "SELECT anon1, anon2, anon3, anon4, other FROM t.tsv", "anon1", "anon2", "anon3", "anon4", "other") == [
        ("1", '"q"', "", None, None), ("2", "a", "b", "c", None),
    ]
    assert values(engine, "SELECT id, u, n, m, r, t FROM j.jsonl", "id", "u", "n", "m", "r", "t") == [
        ("1", 'a"b', None, '{"k": [1, 2.50]}', "1.2300", "true"), ("5", "é", None, None, None, None), (None,) * 6,
    ]


def test_time_ranges(engine, spark, folder):
    assert values(engine, "SELECT uid, timestamp FROM a.log @ 2026-05-06T12:00:01 + 1 ORDER BY timestamp", "uid") == ["bbb", "zzz"]
    assert values(engine, "SELECT COUNT(*) AS n FROM a.log @ 2026-05-06T12:00:02", "n") == [2]
    assert values(engine, "SELECT uid FROM t.tskv @ 2026-05-06T12:00:02", "uid") == ["c"]
    assert values(engine, "SELECT COUNT(*) AS n FROM c.csv 'SQL'", "n") == [6]
    with pytest.raises(SourceError, match="can't pull timestamp from file"):
        printed(engine, "SELECT anon1 FROM c.csv @ 2026-05-06T12:00:02")
    ranged = Engine(spark, str(folder), "2026-05-06T12:00:01", "2026-05-06T12:00:03")
    assert values(ranged, "SELECT uid, timestamp FROM a.log ORDER BY timestamp", "uid") == ["bbb", "zzz"]
    assert values(ranged, "SELECT COUNT(*) AS n FROM a.log @ 2026-05-06T12:00:00", "n") == [4]
    with pytest.raises(BindError):
        ranged.bind("SELECT n FROM ./open.log.gz")


def test_late_widening(engine):
    first, second = printed(engine, "s = b.log\nSELECT *, 1 AS one FROM $s ORDER BY uid\nSELECT path FROM $s ORDER BY uid")
    assert first == [{"uid": "bbb", "path": "/x", "one": 1}, {"uid": "ccc", "path": "/y", "one": 1}] and second == [{"path": "/x"}, {"path": "/y"}]


def test_groups(engine):
    counted = "SELECT minute, COUNT(minute) AS seen, SUM(Int(anon)) AS whole FROM ('20', '020', 'late', 'soon', '45') GROUP BY Int(anon) AS minute ORDER BY minute"
    assert printed(engine, counted) == [{"minute": None, "seen": 0, "whole": 0}, {"minute": 20, "seen": 2, "whole": 40}, {"minute": 45, "seen": 1, "whole": 45}]
    # A key may take the name of the field that it is made of; the field goes on under another key.
    shifted = "SELECT anon, was, COUNT(was) AS n FROM (10, 30, 30) GROUP BY anon - 10 AS anon, anon AS was ORDER BY was DESC"
    assert printed(engine, shifted) == [{"anon": 20, "was": 30, "n": 2}, {"anon": 0, "was": 10, "n": 1}]
    odd = "SELECT weekend, COUNT(*) AS days FROM (1, 2, 3, 4, 5, 6, 7) GROUP BY anon IN (6, 7) AS weekend ORDER BY weekend DESC"
    assert printed(engine, odd) == [{"weekend": True, "days": 2}, {"weekend": False, "days": 5}]
    assert printed(engine, "SELECT port, COUNT(port IN (80, 443)) AS n FROM (443, 22, 443) GROUP BY anon AS port ORDER BY port") == [{"port": 22, "n": 1}, {"port": 443, "n": 2}]
    assert values(engine, "SELECT anon FROM ('a', 'b', 'b', 'c') GROUP BY anon HAVING COUNT(*) > 1", "anon") == ["b"]
    labelled = "SELECT 'shelf ' + String(anon) AS shelf, COUNT(*) AS books FROM (8, 8, 5, 5, 9) GROUP BY anon HAVING books = 2 ORDER BY anon LIMIT 1"
    assert printed(engine, labelled) == [{"shelf": "shelf 5", "books": 2}]
    assert values(engine, "SELECT anon, COUNT(*) AS c FROM (6, 6, 4) GROUP BY anon HAVING c IN (SELECT anon FROM (1, 2, 3) WHERE anon < 2)", "anon", "c") == [(4, 1)]
    assert printed(engine, "SELECT MAX(anon) - MIN(anon) AS width, COUNT(Int('none')) AS nothing FROM (12, 31, 20)") == [{"width": 19, "nothing": 0}]


def test_percentiles(engine):
    assert printed(engine, "SELECT PERCENTILE(anon, 0.1, 0.5, 0.9) AS p FROM (30, 5, 20, 10)") == [{"p": "[5,20,30]"}]
    assert printed(engine, "SELECT PERCENTILE(anon, 0.0, 1.0) AS p FROM (1.5, 1000000.0, 0.25)") == [{"p": "[0.25,1e+06]"}]
    assert printed(engine, "SELECT PERCENTILE(anon, 0.5) AS p FROM ('b', 'a', 'c')") == [{"p": "[b]"}]


def test_global_percentile_is_parted(engine, spark):
    import random

    rng = random.Random(3)
    for numbers in ([rng.randrange(50) for _ in range(3000)], [rng.random() for _ in range(2000)], [7] * 500, list(range(1000))):
        engine.register("numbers", spark.createDataFrame([(x,) for x in numbers], "x double" if isinstance(numbers[0], float) else "x bigint"))
        (got,) = printed(engine, "SELECT PERCENTILE(x, 0.0, 0.3, 0.5, 1.0) AS p FROM $numbers")
        ordered, n = sorted(numbers), len(numbers)
        want = [ordered[min(n - 1, int(n * p + 1e-9))] for p in (0.0, 0.3, 0.5, 1.0)]
        assert [float(x) for x in got["p"].strip("[]").split(",")] == pytest.approx(want, rel=1e-5)


def test_json_lines_read_in_place_equal_the_scanner(spark):
    from pyspark.sql import functions as F

    from logspark.functions import jsonpath

    texts = [
        '{"a": 1, "b": "x", "c": null, "d": {"a": 9}, "e": [1, "a"], "f": -1.50e+3}', '{"a": 1, "a": 2}', '{"a":"1","b":"a"}', "{}", " { } ", '{"a": {}}', '{"a": []}', '{"a": [ ]}', '{"a": {"b": {"c": 1}}}',
        '{"a": "q\\"b"}', '{"a": "\\u00e9"}', '{"a": 01}', '{"a": 1.}', '{"a": .5}', '{"a": +1}', '{"a": NaN}', '{"a": tru}', '{"a": true}', '{"a" : false , "b":0}', '{"a": 1,}', '{"a": 1} x', '{"a" 1}', "[1]", "", "{",
        '{"a": "\x01"}', '{"a": "b: \'a\'", "x.y": "z", "": 3}', '{"é": "ü", "a": "漢"}', '{"a": 1}\t', '{"a": 1}\x0b', '{"a": -0}', '{"a": 1e5, "b": 1E-5}', '{"b": "}, {", "a": "[1,2]"}', '{"a": [1, [2]]}', '{"a": "' + "x" * 9000 + '"}',
        "{" + ", ".join(f'"k{i}": {i}' for i in range(300)) + ', "a": "end"}', '{"a": [1 2]}', '{"a": {"b" 1}}', '{"a": null, "a": 3}', '{"a": 3, "a": null}',
    ]
    names = ["a", "b", "x.y", "", "é", "k7", 'q"']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", jsonpath.simple_line(F.col("t")).alias("plain"), *[jsonpath.simple_field(F.col("t"), n).alias(f"f{k}") for k, n in enumerate(names)]).collect()
    plain = 0
    for r in got:
        want = jsonpath.json_fields(texts[r["i"]], names)
        if r["plain"]:
            plain += 1
            assert want == [r[f"f{k}"] for k in range(len(names))], texts[r["i"]][:80]
    assert plain >= 18


def test_longest_match(engine):
    assert values(engine, "SELECT RSUBSTR(anon, 'a|ab') AS m FROM ('xab', 'a', 'b')", "m") == ["ab", "a", None]
    assert values(engine, "SELECT RSUBSTR(anon, '(a?)(ab)?c*') AS m FROM ('abcc')", "m") == ["abcc"]


def test_bytes_of_a_text(engine):
    assert printed(engine, "SELECT SUBSTR(anon, 2) AS a, SUBSTR(anon, 0, 2) AS b, SUBSTR(anon, 4) AS c FROM ('éab')") == [{"a": "ab", "b": "é", "c": ""}]
    with pytest.raises(Exception, match="beyond the end"):
        printed(engine, "SELECT SUBSTR(anon, 3) AS a FROM ('ab')")


def test_first_timestamp_is_read_where_it_stands(spark, tmp_path):
    lines = ["[2026-May-06 12:00:01.000000] a=1", "[2026-may-06 12:00:01.000000] a=2", "[nothing at all in here..] 2026-May-06 12:00:02 a=3", "[2026-Feb-31 12:00:01.000000] 2026-May-06 12:00:02 a=4", "[2026-May-06 12:00:09.000000] a=5"]
    (tmp_path / "t.log").write_text("\n".join(lines) + "\n")
    assert values(Engine(spark, str(tmp_path)), "SELECT a FROM t.log @ 2026-05-06T12:00:00 + 3", "a") == ["1", "3"]


def test_a_command_of_much_output(engine):
    assert values(engine, "SELECT COUNT(*) AS n, MAX(Int(i)) AS last FROM STREAM 'seq 1 60000 | sed \"s/^/[2026-May-06 12:00:01.000000] i=/\"'", "n", "last") == [(60000, 60000)]


def test_sum_of_strings_keeps_order(engine):
    assert printed(engine, "SELECT SUM(uid) AS s, SUM(none) AS e FROM a.log") == [{"s": "aaabbbzzz", "e": ""}]


def test_joins(engine):
    assert values(engine, "SELECT l.anon AS a, r.anon AS b FROM (1, 1, 2, 3) AS l LEFT JOIN (1, 1, 2) AS r ON r.anon = l.anon ORDER BY a", "a", "b") == [
        (1, 1), (1, 1), (1, 1), (1, 1), (2, 2), (3, None),
    ]
    assert values(engine, "SELECT l.uid AS u, r.path AS p FROM a.log AS l LEFT JOIN b.log AS r ON l.uid = r.uid ORDER BY u", "u", "p") == [
        (None, None), ("aaa", None), ("bbb", "/x"), ("zzz", None),
    ]
    assert values(engine, "SELECT COUNT(*) AS n FROM (1, 2) AS l LEFT JOIN (3, 4) AS r ON 1 = 1", "n") == [4]
    assert values(engine, "SELECT uid FROM a.log WHERE uid IN (SELECT uid FROM b.log)", "uid") == ["bbb"]
    assert values(engine, "SELECT anon AS x FROM ('1', 'x') WHERE NOT Int(anon) IN (SELECT Int(anon) AS y FROM ('y'))", "x") == ["1"]
    assert printed(engine, "SELECT anon, NOT anon IN (1) AND anon IN (SELECT anon FROM (2)) AS k FROM (1, 2) ORDER BY anon") == [{"anon": 1, "k": False}, {"anon": 2, "k": True}]


def test_unions(engine):
    assert values(engine, "SELECT anon FROM ((4, 3, 3, 1) UNION ALL SORTED BY anon DESC (3, 2, 1)) WHERE anon > 1 LIMIT 4", "anon") == [4, 3, 3, 3]
    assert values(engine, "SELECT anon FROM ((1, 2, 3) UNION ALL SORTED BY (anon) (2, 3) UNION ALL SORTED BY (anon) (1, 3)) WHERE anon >= 2", "anon") == [2, 2, 3, 3, 3]
    assert sorted(values(engine, "SELECT uid FROM a.log UNION ALL SELECT uid FROM b.log", "uid"), key=str) == [None, "aaa", "bbb", "bbb", "ccc", "zzz"]
    assert values(engine, "SELECT COUNT(*) AS n FROM ($a UNION ALL $a)".replace("$a", "(1, 2)"), "n") == [4]


def test_scalars(engine):
    assert printed(engine, "SELECT 7 / 2 AS a, 1 / 0 AS b, 1.5 + 1.0 AS c, LOWER('ÀB') AS d, SPLITPART('a:b', ':', 2) AS e, SUBSTR('hello', 1, 2) AS f, COALESCE(null, 'x') AS g FROM (0)") == [
        {"a": 3, "b": None, "c": 2.5, "d": "Àb", "e": None, "f": "el", "g": "x"}
    ]
    assert printed(engine, "SELECT anon LIKE 'error' AS a, anon LIKE '.*error.*' AS b FROM ('error', 'an error\n')".replace("\\n", "\n")) == [{"a": True, "b": True}, {"a": False, "b": False}]
    assert values(engine, "SELECT Float(anon) AS f FROM ('1.5', ' 1', 'inf', '1e1000', '-.5', '0x10')", "f") == [1.5, None, None, None, -0.5, None]
    assert values(engine, "SELECT Int(anon) AS f FROM (1.9, -1.9)", "f") == [1, -1]
    assert values(engine, "SELECT String(anon) AS f FROM (1.5)", "f") == ["1.500000"]
    assert printed(engine, "SELECT Null(anon) AS n, Bool(anon) AS b, !Bool(anon) AS c FROM ('', 'false')") == [{"n": None, "b": False, "c": True}, {"n": None, "b": True, "c": False}]


def test_json_values(engine):
    doc = '{"a/b": 1, "t~x": "é", "m": [{"title": "T", "n": 1.2300}, 1e3], "o": { "k" : [1 , 2] }, "z": null, "d": 1, "d": 2}'
    got = printed(
        engine,
        f"SELECT JSON_VALUE(anon, '/a~1b') AS a, JSON_VALUE(anon, '/t~0x') AS b, JSON_VALUE(anon, 'm[0].title') AS c, JSON_VALUE(anon, '$.m[0].n') AS d, JSON_VALUE(anon, 'm[1]') AS e, "
        f"JSON_VALUE(anon, 'o') AS f, JSON_VALUE(anon, 'z') AS g, JSON_VALUE(anon, 'none.x') AS h, JSON_VALUE(anon + 'x', 'd') AS i FROM ('{doc}')",
    )
    assert got == [{"a": "1", "b": "é", "c": "T", "d": "1.2300", "e": "1e3", "f": '{ "k" : [1 , 2] }', "g": None, "h": None, "i": None}]


def test_materialize_and_alias(engine):
    assert printed(engine, "k = MATERIALIZE(SELECT uid FROM a.log) AS m\nSELECT m.uid, COUNT(*) AS n FROM $k GROUP BY m.uid ORDER BY m.uid")[0] == {"m.uid": None, "n": 1}
    assert values(engine, "x = (1, 2) AS v\nSELECT w.v.anon AS a FROM $x AS w ORDER BY a", "a") == [1, 2]


def test_same_name_two_types(engine):
    with pytest.raises(BindError):
        engine.run("SELECT *, 'x' AS anon FROM (1)")
    (result,) = engine.results("SELECT *, 'x' AS anon FROM (1)")
    buffer = io.StringIO()
    write(result, "TSKV", buffer)
    assert buffer.getvalue() == "anon=1\tanon=x\t\n\n"


def test_sinks(engine):
    shown = {}
    for fmt in ("JSON", "TSKV", "CSVHeader", "PrettyTable"):
        buffer = io.StringIO()
        (result,) = engine.results("SELECT anon AS p, 1.5 AS f, null AS z, true AS b FROM ('a/b')")
        write(result, fmt, buffer)
        shown[fmt] = buffer.getvalue()
    assert shown["JSON"] == '{"p":"a\\/b","f":1.500000,"z":null,"b":true}\n\n'
    assert shown["TSKV"] == "p=a/b\tf=1.500000\tz=null\tb=true\t\n\n"
    assert shown["CSVHeader"] == "p,f,z,b\na/b,1.500000,null,true\n\n"
    assert shown["PrettyTable"].splitlines()[1].split() == ["|", "p", "|", "f", "|", "z", "|", "b", "|"]
    buffer = io.StringIO()
    write(engine.results("SELECT anon FROM (1) WHERE false")[0], "PrettyTable", buffer)
    assert buffer.getvalue() == "\n"


def test_cli(spark, tmp_path, capsys, monkeypatch):
    program = tmp_path / "q.sql"
    program.write_text("SELECT anon AS x FROM (1, 2) ORDER BY x DESC\n")
    out = io.StringIO()
    assert main(["-f", "JSON", str(program)], spark, out) == 0 and out.getvalue() == '{"x":2}\n{"x":1}\n\n'
    out = io.StringIO()
    assert main(["--print-ast", "--print-bound", "--explain", "--print-ir-optimized", "--print-optimize-report", str(program)], spark, out) == 0
    assert "Select(" in out.getvalue() and "Physical Plan" in out.getvalue() and '{"x"' not in out.getvalue()
    monkeypatch.chdir(tmp_path)
    assert main(["--profile-text", "--profile-flamegraph", "--profile-dot-graph", "-f", "TSKV", str(program)], spark, io.StringIO()) == 0
    assert "digraph" in (tmp_path / "prof.dot").read_text() and (tmp_path / "prof.1.folded").read_text().strip()
    program.write_text("SELECT y FROM (1)")
    assert main([str(program)], spark, out) == 1 and "unknown identifier 'y'" in capsys.readouterr().err


def test_plans(engine, spark):
    """A limit over a sort keeps a heap, an equality with nulls stays a hash join, unused columns aren't read."""
    engine.register("orders", spark.read.parquet("/root/testdata/sf0.001/orders.parquet"))
    plan = lambda q: engine.sql(q)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan("SELECT o_orderkey FROM $orders ORDER BY o_totalprice DESC LIMIT 5")
    semi = plan("SELECT o_orderkey FROM $orders WHERE o_custkey IN (SELECT o_custkey FROM $orders WHERE o_totalprice > 10.0)")
    assert "LeftSemi" in semi and "NestedLoop" not in semi and "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,10.0)]" in semi
    assert "ReadSchema: struct<o_totalprice:double>" in plan("SELECT MAX(o_totalprice) AS m FROM $orders")


def test_follow(spark, tmp_path):
    from logspark.streaming import follow

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.log").write_text("[2026-May-06 12:00:00.000000] uid=a s=1\n[2026-May-06 12:00:00.000000] uid=b s=2\n")
    seen = []
    engine = Engine(spark)
    query = "SELECT uid, Int(s) + 1 AS s FROM x.log WHERE uid IN ('a', 'c')"
    run = lambda: follow(engine, query, f"file://{tmp_path}/in", "TS_LOGFMT", lambda df, n: seen.extend(map(tuple, df.collect())), f"file://{tmp_path}/ck", once=True).awaitTermination()
    run()
    (tmp_path / "in" / "2.log").write_text("[2026-May-06 12:00:00.000000] uid=c s=5\n")
    run()
    assert seen == [("a", 2), ("c", 6)]
    with pytest.raises(BindError):
        follow(engine, "SELECT COUNT(*) AS n FROM x.log", f"file://{tmp_path}/in", "TS_LOGFMT", print, "x")
