"""Quality rules with host verdicts, in DataFrame expressions only.

Each document is measured against fixed rules: too few words, repeated passages, many symbols, repeated lines, words of
an unlikely length. Failures of any rule are aggregated by host (here: the source), failure rates are shrunk towards an
empirical beta prior fitted to all hosts by moments, and the hosts' verdicts are joined back. The features are computed
once and written, the host table is an aggregate of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import BLANKS, let, materialise

#: A host whose shrunken failure rate exceeds this loses all its documents.
WORST_RATE = 0.5
#: A document counts against its host if it has more symbols than this share of its words, more repeated lines than this
#: share of its words, or words whose mean length lies outside of these limits.
MOST_SYMBOLS, MOST_DUP_LINES, WORD_CHARS = 0.1, 0.05, (2, 15)
#: Host tables up to this many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_HOSTS = 100_000
WINDOW = 5
_SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    trimmed = F.trim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def _covered(windows: Column) -> Column:
    """Words within windows that occur twice or more, from all windows of a text in order. Exact: compares the windows."""
    pairs = F.array_sort(F.transform(windows, lambda s, i: F.struct(s.alias("s"), i.alias("i"))))

    def positions(p: Column) -> Column:
        here = lambda k: F.get(p, k)["s"]
        twice = lambda k: F.coalesce(here(k) == here(k - 1), F.lit(False)) | F.coalesce(here(k) == here(k + 1), F.lit(False))
        at = F.transform(p, lambda x, k: F.when(twice(k), x["i"]))
        return F.array_sort(F.filter(at, lambda i: i.isNotNull()))

    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).cast("long").alias("n"))
    return F.aggregate(let(pairs, positions), start, step, lambda acc: acc["n"])


def repeat_words(words: Column) -> Column:
    """Words in windows of five that are found twice or more. Distinct hashes prove distinct windows; only where two agree are texts compared."""

    def count(w: Column) -> Column:
        last = F.size(w) - WINDOW
        hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
        exact = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(w, i + 1, WINDOW), " "))
        return F.when(last < 1, F.lit(0).cast("long")).when(F.size(F.array_distinct(hashes)) == last + 1, F.lit(0).cast("long")).otherwise(_covered(exact))

    return let(words, count)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rule_failed (any rule) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text.alias("text"), words_of(text).alias("words"))
    word_lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != "")
    out = base.select(
        "doc_id", "host", F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(word_lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
    )
    out = out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    n, low, high = F.col("n_words"), *WORD_CHARS
    odd = (F.col("n_symbols") > MOST_SYMBOLS * n) | (F.col("n_dup_lines") > MOST_DUP_LINES * n) | (F.col("word_chars") < low * n) | (F.col("word_chars") > high * n)
    return out.withColumn("rule_failed", F.col("base_failed") | odd)


def prior(hosts: DataFrame) -> tuple[float, float]:
    """Beta parameters by moments over hosts (n, failed): the mean rate, and a weight from the spread beyond binomial noise.

    Hosts count by their documents; with no spread beyond noise the prior weighs as much as all documents of a mean host.
    """
    rate = F.col("failed") / F.col("n")
    r = hosts.agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.count(F.lit(1)).alias("hosts"), F.sum(rate * rate * F.col("n")).alias("square")).first()
    if not r["n"]:
        return 1.0, 1.0
    mean = min(max(r["failed"] / r["n"], 1e-6), 1 - 1e-6)
    spread = max(0.0, r["square"] / r["n"] - (r["failed"] / r["n"]) ** 2)
    size = r["n"] / r["hosts"]
    noise = mean * (1 - mean) / size
    weight = mean * (1 - mean) / (spread - noise) - 1 if spread > noise else size
    weight = min(max(weight, 2.0), size + 2.0)
    return mean * weight, (1 - mean) * weight


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", worst: float = WORST_RATE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_rate.

    base_failed: fewer than ten words, or over a fifth of the words in repeated five-word windows. kept: not base_failed,
    and the host's shrunken rate of documents that fail any rule is at most ``worst``. Null texts count as empty (failed); a null host is a
    host of its own. Repeated rows stay and count each. An empty table gives an empty result. Other columns are ignored.
    """
    rows = materialise(features(docs, id_col, text_col, host_col), "rule-features")
    failed = F.sum(F.col("rule_failed").cast("long")).alias("failed")
    hosts = materialise(rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), failed), "rule-hosts")
    a, b = prior(hosts)
    key = lambda c: F.when(F.col(c).isNull(), "n").otherwise(F.concat(F.lit("h"), F.col(c).cast("string")))
    rates = hosts.select(key("host").alias("k"), ((F.col("failed") + a) / (F.col("n") + (a + b))).alias("host_rate"))
    if hosts.count() <= BROADCAST_HOSTS:
        rates = F.broadcast(rates)
    joined = rows.withColumn("k", key("host")).join(rates, "k")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("host_rate") <= worst)).alias("kept"), "host_rate",
    )
