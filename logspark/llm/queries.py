"""The registered queries of the training-data operators and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import exactdedup, langid, mixing, packing, pii, quality, rules, simhash, tokencounts, urlfilter
from ._common import table

#: A file name among the public tokenizers; a path works as well.
TOKENIZER = "word_bpe_49k.json"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.maintained(table(spark, sf_dir, "documents"), TOKENIZER, "word_bpe_49k")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.apply_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_best_fit_packing, op3_url_filter, op4_quality, op5_token_counts, op6_exact_dedup, op7_pii, op8_simhash, op9_quality_rules, op10_source_mix,
)}

ORACLES = {
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op3_url_filter": r"""
        WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        rules(rule, rhost, rpath, action) AS (VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
            ('net/de/', 'net', '/de/', 'allow'), ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
        fit AS (SELECT page_id, rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS nth FROM p, rules
                WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
        bad(name) AS (SELECT a || '.example.' || b FROM (VALUES ('spam-farm'), ('cheap-pills'), ('free-bets'), ('adult-x'), ('casino-win'), ('ads-track')) x(a), (VALUES ('com'), ('net'), ('org')) y(b))
        SELECT p.page_id, p.host, p.path, f.rule,
               coalesce(f.action, CASE WHEN EXISTS (SELECT 1 FROM bad WHERE p.host = name OR ends_with(p.host, '.' || name)) THEN 'block' ELSE 'allow' END) AS verdict
        FROM p LEFT JOIN fit f ON p.page_id = f.page_id AND f.nth = 1
    """,
    "op9_quality_rules": r"""
        WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
        win AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
        rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
        cov AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n FROM
                (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id),
        f AS (SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
                     len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
                     (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
                      - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
                     coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
        b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
                     n_symbols > 0.1::DOUBLE * n_words OR n_dup_lines > 0.05::DOUBLE * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS odd FROM f),
        h AS (SELECT source, count(*)::DOUBLE AS n, sum((base_failed OR odd)::INT)::DOUBLE AS failed FROM b GROUP BY source),
        m AS (SELECT sum(n) / count(*) AS size, greatest(0, sum(failed * failed / n) / sum(n) - (sum(failed) / sum(n)) ** 2) AS spread,
                     least(greatest(sum(failed) / sum(n), 1e-6), 1 - 1e-6) AS mean FROM h),
        p AS (SELECT mean, least(greatest(CASE WHEN spread > mean * (1 - mean) / size THEN mean * (1 - mean) / (spread - mean * (1 - mean) / size) - 1 ELSE size END, 2), size + 2) AS weight FROM m),
        r AS (SELECT source, (failed + mean * weight) / (n + weight) AS rate FROM h, p)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.5 AS kept
        FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source
    """,
}
