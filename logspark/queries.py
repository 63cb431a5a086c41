"""Registered queries: programs of the language over the driver's tables, each with its DuckDB equivalent."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .sinks import single
from .sources import files

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def engine(spark: SparkSession, sf_dir: str, base: str | None = None) -> Engine:
    """An engine that knows the tables; one is only looked at if a program names it."""
    return Engine(spark, base, allow_stream=True, find=lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet") if name in TABLES else None)


# name: (program, DuckDB SQL)
PROGRAMS: dict[str, tuple[str, str]] = {
    "filter_not_equal": (
        "SELECT o_orderkey, o_orderstatus, o_totalprice FROM $orders WHERE o_orderstatus != 'O' AND o_totalprice > 100000.0",
        "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus IS DISTINCT FROM 'O' AND o_totalprice > 100000.0",
    ),
    "null_equality": (
        "SELECT anon = null AS a, null = null AS b, anon != 1 AS c, anon FROM (SELECT Int(anon) AS anon FROM ('1', 'x', '2'))",
        "SELECT anon IS NULL AS a, TRUE AS b, anon IS DISTINCT FROM 1 AS c, anon FROM (SELECT try_cast(v AS BIGINT) AS anon FROM (VALUES ('1'), ('x'), ('2')) t(v))",
    ),
    "group_having_order": (
        """SELECT l_returnflag, l_linestatus, COUNT(*) AS n, MAX(l_quantity) AS most, SUM(l_linenumber) AS lines FROM $lineitem
           GROUP BY l_returnflag, l_linestatus HAVING n > 10 AND most >= 1.0 ORDER BY n, l_returnflag, l_linestatus DESC""",
        """SELECT l_returnflag, l_linestatus, count(*) AS n, max(l_quantity) AS most, sum(l_linenumber)::BIGINT AS lines FROM lineitem
           GROUP BY l_returnflag, l_linestatus HAVING n > 10 AND most >= 1.0""",
    ),
    "group_expression_key": (
        "SELECT bucket, COUNT(*) AS n, COUNT(bucket) AS m, MIN(o_totalprice) AS least FROM $orders GROUP BY o_custkey / 100 AS bucket",
        "SELECT o_custkey // 100 AS bucket, count(*) AS n, count(o_custkey) AS m, min(o_totalprice) AS least FROM orders GROUP BY 1",
    ),
    "group_key_shadows_field": (
        "SELECT l_linenumber, COUNT(l_linenumber) AS n, SUM(l_linenumber) AS total FROM $lineitem GROUP BY l_linenumber + 1 AS l_linenumber",
        "SELECT l_linenumber + 1 AS l_linenumber, count(*) AS n, sum(l_linenumber + 1)::BIGINT AS total FROM lineitem GROUP BY lineitem.l_linenumber",
    ),
    "group_constant_key": (
        "SELECT key, COUNT(*) AS n FROM $nation GROUP BY 1 AS key",
        "SELECT 1 AS key, count(*) AS n FROM nation HAVING count(*) > 0",
    ),
    "group_star": (
        "SELECT *, COUNT(*) AS n FROM $customer GROUP BY c_mktsegment, c_nationkey",
        "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ALL",
    ),
    "global_aggregates": (
        """SELECT COUNT(*) AS n, COUNT(l_quantity) AS m, MAX(l_quantity) - MIN(l_quantity) AS spread, SUM(l_linenumber) AS total,
                  SUM(Int(l_returnflag)) AS nothing, MAX(Int(l_returnflag)) AS none, MIN(7) AS seven FROM $lineitem""",
        """SELECT count(*) AS n, count(l_quantity) AS m, max(l_quantity) - min(l_quantity) AS spread, sum(l_linenumber)::BIGINT AS total,
                  0 AS nothing, NULL::BIGINT AS none, 7 AS seven FROM lineitem""",
    ),
    "global_aggregate_of_nothing": (
        "SELECT COUNT(*) AS n, SUM(o_orderkey) AS total, MAX(o_orderstatus) AS most, PERCENTILE(o_orderkey, 0.5) AS half FROM $orders WHERE false",
        "SELECT 0 AS n, 0 AS total, NULL::VARCHAR AS most, NULL::VARCHAR AS half",
    ),
    "percentile_by_key": (
        "SELECT l_returnflag, PERCENTILE(l_linenumber, 0.1, 0.5, 0.95) AS p, PERCENTILE(l_linestatus, 0.0, 1.0) AS s FROM $lineitem GROUP BY l_returnflag",
        """SELECT l_returnflag, '[' || a[least(n - 1, floor(n * 0.1))::INT + 1] || ',' || a[least(n - 1, floor(n * 0.5))::INT + 1] || ',' || a[least(n - 1, floor(n * 0.95))::INT + 1] || ']' AS p,
                  '[' || b[1] || ',' || b[n] || ']' AS s
           FROM (SELECT l_returnflag, count(*) AS n, list_sort(list(l_linenumber)) AS a, list_sort(list(l_linestatus)) AS b FROM lineitem GROUP BY 1)""",
    ),
    "semi_in": (
        "SELECT c_custkey, c_name FROM $customer WHERE c_custkey IN (SELECT o_custkey FROM $orders WHERE o_totalprice > 300000.0)",
        "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000.0)",
    ),
    "anti_not_in": (
        "SELECT c_custkey, c_name FROM $customer WHERE NOT c_custkey IN (SELECT o_custkey FROM $orders WHERE o_totalprice > 250000.0)",
        "SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey IS NOT DISTINCT FROM c_custkey AND o_totalprice > 250000.0)",
    ),
    "anti_null_safe": (
        "SELECT l_orderkey, l_linenumber FROM $lineitem WHERE NOT Int(l_returnflag + String(l_linenumber)) IN (SELECT Int(anon) AS y FROM ('7', 'none')) OR l_linenumber > 6",
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber > 6",
    ),
    "mark_in_select": (
        "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM $orders WHERE o_orderstatus = 'F') AS has, c_nationkey IN (1, 2, 3) OR NOT c_mktsegment IN ('BUILDING') AS other FROM $customer",
        """SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS has,
                  c_nationkey IN (1, 2, 3) OR c_mktsegment <> 'BUILDING' AS other FROM customer""",
    ),
    "in_null_safe": (
        "SELECT x, x IN (SELECT Int(anon) AS y FROM ('1', 'bad')) AS found FROM (SELECT Int(anon) AS x FROM ('1', '2', 'none'))",
        "SELECT x, coalesce(x = 1, TRUE) AS found FROM (VALUES (1::BIGINT), (2), (NULL)) t(x)",
    ),
    "having_in": (
        "SELECT c_nationkey, COUNT(*) AS n FROM $customer GROUP BY c_nationkey HAVING c_nationkey IN (SELECT n_nationkey FROM $nation WHERE n_regionkey = 1)",
        "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 HAVING c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    ),
    "left_join_rows": (
        "SELECT n.n_name AS nation, r.r_name AS region FROM $nation AS n LEFT JOIN (SELECT * FROM $region WHERE r_regionkey < 3) AS r ON n.n_regionkey = r.r_regionkey",
        "SELECT n_name AS nation, r_name AS region FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3",
    ),
    "left_join_count": (
        """SELECT custkey, COUNT(*) AS rows, COUNT(o.o_orderkey) AS orders FROM $customer AS c
           LEFT JOIN $orders AS o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey AS custkey""",
        "SELECT c_custkey AS custkey, count(*) AS rows, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1",
    ),
    "left_join_chain": (
        """SELECT region, COUNT(*) AS n FROM $supplier AS s LEFT JOIN $nation AS n ON s.s_nationkey = n.n_nationkey
           LEFT JOIN $region AS r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name AS region""",
        "SELECT r_name AS region, count(*) AS n FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    ),
    "left_join_null_keys": (
        "SELECT l.k AS a, r.k AS b FROM (SELECT Int(anon) AS k FROM ('1', 'x', '2')) AS l LEFT JOIN (SELECT Int(anon) AS k FROM ('1', '1', 'y')) AS r ON l.k = r.k",
        "SELECT l.k AS a, r.k AS b FROM (VALUES (1::BIGINT), (NULL), (2)) l(k) LEFT JOIN (VALUES (1::BIGINT), (1), (NULL)) r(k) ON l.k = r.k",
    ),
    "topk": (
        "SELECT o_orderkey, o_totalprice FROM $orders ORDER BY o_totalprice, o_orderkey DESC LIMIT 100",
        "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 100",
    ),
    "topk_hidden_key": (
        "SELECT c_name FROM $customer ORDER BY c_acctbal, c_custkey LIMIT 50",
        "SELECT c_name FROM customer ORDER BY c_acctbal, c_custkey LIMIT 50",
    ),
    "sort_full": (
        "SELECT o_orderkey, o_orderpriority FROM $orders ORDER BY o_orderpriority, o_orderkey",
        "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderkey",
    ),
    "limit_rows": (
        "SELECT COUNT(*) AS n FROM (SELECT l_orderkey FROM $lineitem LIMIT 1000) UNION ALL SELECT COUNT(*) AS n FROM (SELECT r_name FROM $region LIMIT 1000)",
        "SELECT count(*) AS n FROM (SELECT l_orderkey FROM lineitem LIMIT 1000) UNION ALL SELECT count(*) AS n FROM (SELECT r_name FROM region LIMIT 1000)",
    ),
    "count_names": (
        "SELECT o_orderstatus, COUNT_ALL() AS a, COUNT_NONNULL(Int(o_orderpriority)) AS b, COUNT_NONNULL(o_custkey) AS c FROM $orders GROUP BY o_orderstatus",
        "SELECT o_orderstatus, count(*) AS a, 0::BIGINT AS b, count(o_custkey) AS c FROM orders GROUP BY 1",
    ),
    "sum_of_strings": (
        "SELECT region, SUM(n_name) AS names FROM (SELECT n_regionkey AS region, n_name FROM $nation ORDER BY n_nationkey) GROUP BY region",
        "SELECT n_regionkey AS region, string_agg(n_name, '' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1",
    ),
    "null_cast": (
        "SELECT r_regionkey, Null(r_name) = null AS gone, COALESCE(Null(r_name), r_name) AS name FROM $region",
        "SELECT r_regionkey, TRUE AS gone, r_name AS name FROM region",
    ),
    "percentile_global": (
        "SELECT PERCENTILE(o_custkey, 0.0, 0.25, 0.5, 0.99, 1.0) AS p, PERCENTILE(o_orderstatus, 0.5) AS s, COUNT(*) AS n FROM $orders",
        """SELECT '[' || a[1] || ',' || a[least(n - 1, floor(n * 0.25::FLOAT))::INT + 1] || ',' || a[least(n - 1, floor(n * 0.5::FLOAT))::INT + 1] || ',' || a[least(n - 1, floor(n * 0.99::FLOAT))::INT + 1] || ',' || a[n] || ']' AS p,
                  '[' || b[least(n - 1, floor(n * 0.5))::INT + 1] || ']' AS s, n FROM (SELECT count(*) AS n, list_sort(list(o_custkey)) AS a, list_sort(list(o_orderstatus)) AS b FROM orders)""",
    ),
    "longest_match": (
        "SELECT p_partkey, RSUBSTR(p_type, 'S|ST|STA|STANDARD|E[A-Z]*') AS m, RSUBSTR(p_brand, 'B(r|ra)(nd|and)?') AS b FROM $part",
        """SELECT p_partkey, nullif(regexp_extract(p_type, 'STANDARD|STA|ST|S|E[A-Z]*'), '') AS m, nullif(regexp_extract(p_brand, 'Brand|Bra|Br'), '') AS b FROM part""",
    ),
    "union_all": (
        "SELECT l_orderkey, l_shipdate FROM $lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey, l_shipdate FROM $lineitem WHERE l_linenumber = 1",
        "SELECT l_orderkey, l_shipdate FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey, l_shipdate FROM lineitem WHERE l_linenumber = 1",
    ),
    "union_sorted": (
        """SELECT o_orderkey, o_totalprice FROM (SELECT o_orderkey, o_totalprice FROM $orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice
           UNION ALL SORTED BY o_totalprice SELECT o_orderkey, o_totalprice FROM $orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice) LIMIT 500""",
        "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'P') ORDER BY o_totalprice LIMIT 500",
    ),
    "string_functions": (
        """SELECT p_partkey, LOWER(p_name) AS low, SUBSTR(p_name, 2, 5) AS mid, SUBSTR(p_type, 3) AS tail, SPLITPART(p_type, ' ', 1) AS part,
                  SPLITPART(p_type, ' ', 9) AS missing, p_brand + '/' + String(p_size) AS joined, COALESCE(SPLITPART(p_type, ' ', 9), p_brand) AS either FROM $part""",
        """SELECT p_partkey, lower(p_name) AS low, substr(p_name, 3, 5) AS mid, substr(p_type, 4) AS tail, string_split(p_type, ' ')[2] AS part,
                  NULL::VARCHAR AS missing, p_brand || '/' || p_size AS joined, p_brand AS either FROM part""",
    ),
    "regex_functions": (
        "SELECT p_partkey, RSUBSTR(p_brand, '[0-9]+') AS digits, RSUBSTR(p_type, 'ZZ+') AS none, p_type LIKE '.*S.*' AS has_s, p_brand LIKE 'Brand' AS whole FROM $part WHERE p_brand LIKE 'Brand.*'",
        """SELECT p_partkey, CASE WHEN regexp_matches(p_brand, '[0-9]+') THEN regexp_extract(p_brand, '[0-9]+') END AS digits,
                  CASE WHEN regexp_matches(p_type, 'ZZ+') THEN regexp_extract(p_type, 'ZZ+') END AS none,
                  regexp_full_match(p_type, '.*S.*') AS has_s, regexp_full_match(p_brand, 'Brand') AS whole FROM part WHERE regexp_full_match(p_brand, 'Brand.*')""",
    ),
    "casts": (
        """SELECT Int(anon) AS i, Float(anon) AS f, Bool(anon) AS b, String(Int(anon)) AS s, Int(Float(anon)) AS t, Bool(Int(anon)) AS z, String(Bool(anon)) AS w
           FROM ('1', '+1', ' 1', '-7', '1.5', '', 'x', '1e3', 'nan', '99999999999999999999')""",
        """SELECT CASE WHEN regexp_full_match(v, '-?[0-9]+') THEN try_cast(v AS BIGINT) END AS i,
                  CASE WHEN regexp_full_match(v, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(v AS FLOAT) END AS f, length(v) > 0 AS b,
                  CASE WHEN regexp_full_match(v, '-?[0-9]+') THEN try_cast(v AS BIGINT) END::VARCHAR AS s,
                  CASE WHEN regexp_full_match(v, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(trunc(try_cast(v AS FLOAT)) AS BIGINT) END AS t,
                  CASE WHEN regexp_full_match(v, '-?[0-9]+') THEN try_cast(v AS BIGINT) END <> 0 AS z, (length(v) > 0)::VARCHAR AS w
           FROM (VALUES ('1'), ('+1'), (' 1'), ('-7'), ('1.5'), (''), ('x'), ('1e3'), ('nan'), ('99999999999999999999')) t(v)""",
    ),
    "null_arithmetic": (
        "SELECT anon, Int(anon) + 1 AS a, Int(anon) - 2 AS b, 10 / Int(anon) AS c, Int(anon) / 0 AS d, (0 - 7) / 2 AS e, anon + 'x' AS f FROM ('4', '0', 'bad')",
        "SELECT v AS anon, try_cast(v AS BIGINT) + 1 AS a, try_cast(v AS BIGINT) - 2 AS b, 10 // nullif(try_cast(v AS BIGINT), 0) AS c, NULL::BIGINT AS d, -3 AS e, v || 'x' AS f FROM (VALUES ('4'), ('0'), ('bad')) t(v)",
    ),
    "float_arithmetic": (
        "SELECT l_orderkey, l_linenumber, l_extendedprice - l_discount AS a, l_quantity / l_tax AS b, l_tax + 0.5 AS c FROM $lineitem WHERE l_quantity >= 45.0",
        "SELECT l_orderkey, l_linenumber, l_extendedprice - l_discount AS a, l_quantity / nullif(l_tax, 0) AS b, l_tax + 0.5 AS c FROM lineitem WHERE l_quantity >= 45.0",
    ),
    "boolean_logic": (
        "SELECT o_orderkey, NOT o_orderstatus = 'F' AND o_totalprice < 50000.0 OR o_orderpriority = '1-URGENT' AS pick, !(o_orderkey > 100) AS low FROM $orders",
        "SELECT o_orderkey, (NOT o_orderstatus = 'F') AND o_totalprice < 50000.0 OR o_orderpriority = '1-URGENT' AS pick, NOT (o_orderkey > 100) AS low FROM orders",
    ),
    "json_value": (
        "SELECT event_id, Int(JSON_VALUE(props, 'k')) AS k, JSON_VALUE(props, '/missing') AS none FROM $events WHERE event_type = 'click'",
        "SELECT event_id, (props->>'k')::BIGINT AS k, NULL::VARCHAR AS none FROM events WHERE event_type = 'click'",
    ),
    "parse_timestamp": (
        "SELECT PARSE_TIMESTAMP(anon, 'SQL') AS a, PARSE_TIMESTAMP(anon, 'ISO8601') AS b, PARSE_TIMESTAMP(anon, 'ORACLE') AS c FROM ('2026-05-06 12:00:01', '2026-05-06T12:00:02.5', '2026-May-06 12:00:03')",
        "SELECT * FROM (VALUES (1778068801::BIGINT, NULL::BIGINT, NULL::BIGINT), (NULL, 1778068802, NULL), (NULL, NULL, 1778068803)) t(a, b, c)",
    ),
    "macro_expression": (
        """def cents(x) = x + x
           def in_region(x) = x IN (SELECT n_nationkey FROM $nation WHERE n_regionkey = 2)
           SELECT c_custkey, cents(c_acctbal) AS twice, in_region(c_nationkey) AS asia FROM $customer""",
        "SELECT c_custkey, c_acctbal + c_acctbal AS twice, c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) AS asia FROM customer",
    ),
    "alias_nested": (
        "inner = (SELECT r_regionkey AS k, r_name AS v FROM $region) AS a\nSELECT b.a.k, b.a.v AS v FROM $inner AS b WHERE b.a.k > 0",
        'SELECT r_regionkey AS "b.a.k", r_name AS v FROM region WHERE r_regionkey > 0',
    ),
    "materialize_reuse": (
        """kept = MATERIALIZE(SELECT o_custkey, o_totalprice FROM $orders WHERE o_orderstatus = 'F')
           SELECT c_mktsegment, COUNT(*) AS n FROM $customer WHERE c_custkey IN (SELECT o_custkey FROM $kept WHERE o_custkey IN (SELECT o_custkey FROM $kept WHERE o_totalprice > 200000.0))
           GROUP BY c_mktsegment""",
        "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000.0) GROUP BY 1",
    ),
    "literal_relation": ("SELECT anon AS v, anon + 1 AS w FROM (5, 6, 6)", "SELECT v, v + 1 AS w FROM (VALUES (5), (6), (6)) t(v)"),
    "command_stream": (
        """SELECT uid, Int(latency) AS latency FROM STREAM 'printf "[2026-May-06 12:00:00.000000] uid=a latency=3\\n[2026-May-06 12:00:01.000000] uid=b latency=x"'""",
        "SELECT * FROM (VALUES ('a', 3::BIGINT), ('b', NULL)) t(uid, latency)",
    ),
}

# Formats: events are written as lines of each format, read back by the engine and summed up.
_SUMS = "SELECT kind, COUNT(*) AS n, COUNT({user}) AS users, MAX(Int({id})) AS last, MIN({value}) AS least FROM $log GROUP BY {type} AS kind"
_SUMS_SQL = "SELECT event_type AS kind, count(*) AS n, count(user_id) AS users, max(event_id) AS last, min(round(value, 2)::DECIMAL(18,2)::VARCHAR) AS least FROM events GROUP BY 1"
_NAMES = {"type": "event_type", "user": "user_id", "id": "event_id", "value": "value"}
_ANON = {"type": "anon3", "user": "anon2", "id": "anon1", "value": "anon4"}


def _stamp(fmt: str):
    return F.date_format("ts", fmt)


def _value():
    return F.col("value").cast("decimal(18,2)").cast("string")


def _logfmt():
    return F.format_string("[%s.000000] event_id=%s user_id=%s event_type=%s value=%s", _stamp("yyyy-MMM-dd HH:mm:ss"), "event_id", "user_id", "event_type", _value())


RENDERED: dict[str, tuple[Callable, str, str]] = {
    "fmt_logfmt": (_logfmt, _SUMS.format(**_NAMES), _SUMS_SQL),
    "fmt_tskv": (
        lambda: F.format_string("tskv\ttimestamp=%s\tevent_id=%s\tuser_id=%s\tevent_type=%s\tvalue=%s", _stamp("yyyy-MM-dd HH:mm:ss"), "event_id", "user_id", "event_type", _value()),
        _SUMS.format(**_NAMES), _SUMS_SQL,
    ),
    "fmt_csv": (lambda: F.format_string('%s,"%s",%s,"%s"', "event_id", "user_id", "event_type", _value()), _SUMS.format(**_ANON), _SUMS_SQL),
    "fmt_tsv": (lambda: F.format_string("%s\t%s\t%s\t%s", "event_id", "user_id", "event_type", _value()), _SUMS.format(**_ANON), _SUMS_SQL),
    "fmt_jsonl": (
        lambda: F.format_string('{"event_id": %s, "user_id": %s, "event_type": "%s", "value": %s, "props": %s}', "event_id", "user_id", "event_type", _value(), "props"),
        _SUMS.format(**_NAMES), _SUMS_SQL,
    ),
    "time_range": (
        _logfmt,
        "SELECT Int(event_id) AS event_id, PARSE_TIMESTAMP(timestamp, 'ORACLE') AS at FROM {path} @ 2024-01-05T00:00:00 + 432000",
        "SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS at FROM events WHERE date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10'",
    ),
    "time_range_explicit_format": (
        lambda: F.format_string("%s,%s", _stamp("yyyy-MM-dd'T'HH:mm:ss"), "event_id"),
        "SELECT COUNT(anon2) AS n FROM {path} @ 2024-01-05T00:00:00 'ISO8601'",
        "SELECT count(*) AS n FROM events WHERE date_trunc('second', ts) >= TIMESTAMP '2024-01-05'",
    ),
    "raw_line_count": (_logfmt, "SELECT COUNT(*) AS n FROM {path}", "SELECT count(*) AS n FROM events"),
}


#: Files as a command writes them, whole or with a last line that nothing ends; (lines of the file, program, DuckDB SQL).
SINGLE: dict[str, tuple[str, bool, str, str]] = {
    "file_unterminated": ("open.log", False, "SELECT COUNT(event_id) AS n, MAX(Int(event_id)) AS last FROM ./open.log", "SELECT count(*) - 1 AS n, max(event_id) - 1 AS last FROM events"),
    "gzip_single": ("one.log.gz", True, _SUMS.format(**_NAMES).replace("$log", "./one.log.gz"), _SUMS_SQL),
    "default_range": ("ranged.log", False, "SELECT COUNT(*) AS n FROM ./ranged.log", "SELECT count(*) AS n FROM events WHERE date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10'"),
}


def _single(spark: SparkSession, sf_dir: str, name: str, archive: bool) -> str:
    """Write the events, by id, as one logfmt file under a new folder, which is returned; without a newline at the end unless it is the ranged one."""
    folder = _folder(spark, "single")
    lines = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("event_id").select(_logfmt().alias("value"))
    single.write(lines, f"{folder}/{name}", archive, ended=name == "ranged.log")
    return folder


def _one_file(name: str, archive: bool, text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        span = ("2024-01-05T00:00:00", "2024-01-10T00:00:00") if name == "ranged.log" else ()
        return Engine(spark, _single(spark, sf_dir, name, archive), *span).sql(text)

    return run


def _printed(fmt: str) -> Callable[[SparkSession, str], DataFrame]:
    """What a sink prints of a program over the nations, by line."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        import io

        from .sinks import write

        buffer = io.StringIO()
        (result,) = engine(spark, sf_dir).results("SELECT n_nationkey AS k, n_name AS name, Int(n_name) AS none, n_nationkey > 10 AS big FROM $nation ORDER BY n_nationkey")
        write(result, fmt, buffer)
        shown = buffer.getvalue().removesuffix("\n").split("\n")
        return spark.createDataFrame(list(enumerate(shown)), "at int, line string")

    return run


def _followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program that follows a folder of log files; its batches are written and read back."""
    from .streaming import follow

    root = _folder(spark, "follow")
    lines = spark.read.parquet(f"{sf_dir}/events.parquet").select(_logfmt().alias("value"))
    lines.repartition(3).write.option("lineSep", "\n").text(f"{root}/in")
    sink = lambda df, n: df.write.mode("overwrite").parquet(f"{root}/out/batch={n}")  # noqa: E731  a repeated batch replaces itself
    program = "SELECT Int(event_id) AS event_id, event_type, LOWER(event_type) IN ('click', 'view') AS some FROM log.txt WHERE Float(value) > 50.0"
    follow(engine(spark, sf_dir), program, f"{root}/in", "TS_LOGFMT", sink, f"{root}/checkpoint", once=True).awaitTermination()
    return spark.read.parquet(f"{root}/out").select("event_id", "event_type", "some")


_FOLLOWED_SQL = "SELECT event_id, event_type, lower(event_type) IN ('click', 'view') AS some FROM events WHERE round(value, 2)::DECIMAL(18,2)::FLOAT > 50.0::FLOAT"
_NATIONS = "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 + {first} AS at, {line} AS line FROM nation"
PRINTED = {
    "sink_json": ("JSON", _NATIONS.format(first=0, line="""'{"k":' || n_nationkey || ',"name":"' || n_name || '","none":null,"big":' || (n_nationkey > 10) || '}'""") + " UNION ALL SELECT count(*), '' FROM nation"),
    "sink_tskv": ("TSKV", _NATIONS.format(first=0, line="'k=' || n_nationkey || chr(9) || 'name=' || n_name || chr(9) || 'none=null' || chr(9) || 'big=' || (n_nationkey > 10) || chr(9)") + " UNION ALL SELECT count(*), '' FROM nation"),
    "sink_csv": ("CSVHeader", "SELECT 0 AS at, 'k,name,none,big' AS line UNION ALL " + _NATIONS.format(first=1, line="n_nationkey || ',' || n_name || ',null,' || (n_nationkey > 10)") + " UNION ALL SELECT count(*) + 1, '' FROM nation"),
}


def _folder(spark: SparkSession, kind: str) -> str:
    """A new folder that executors reach; it goes when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{root or 'file://' + tempfile.mkdtemp(prefix='logspark-')}/{kind}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    atexit.register(files.drop, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at)
    return path


def _program(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir).sql(text)


def _rendered(render: Callable, text: str, gzip: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = _folder(spark, "lines")
        lines = spark.read.parquet(f"{sf_dir}/events.parquet").select(render().alias("value"))
        lines.write.option("lineSep", "\n").option("compression", "gzip" if gzip else "none").text(f"{folder}/log.d")
        program = text.replace("{path}", "./log.d") if "{path}" in text else "log = ./log.d\n" + text
        return engine(spark, sf_dir, folder).sql(program)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {k: _program(text) for k, (text, _) in PROGRAMS.items()}
    out |= {k: _rendered(render, text) for k, (render, text, _) in RENDERED.items()}
    out["gzip_group"] = _rendered(_logfmt, _SUMS.format(**_NAMES), gzip=True)
    out |= {k: _one_file(name, archive, text) for k, (name, archive, text, _) in SINGLE.items()}
    out["stream_follow"] = _followed
    return out | {k: _printed(fmt) for k, (fmt, _) in PRINTED.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in PROGRAMS.items()} | {k: sql for k, (_, _, sql) in RENDERED.items()} | {"gzip_group": _SUMS_SQL} | {"stream_follow": _FOLLOWED_SQL} | {k: v[-1] for k, v in (SINGLE | PRINTED).items()}
