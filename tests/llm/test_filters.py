"""URL filter, personal data, quality rules and token totals against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logspark.llm import pii, queries, rules, tokencounts, urlfilter

BLANK = r"[^\x20\x09-\x0D]+"


def rows(df):
    return [r.asDict() for r in df.collect()]


# ---- url filter


def brute_judge(url, rule_list=urlfilter.RULES, hosts=urlfilter.BLOCKED_HOSTS):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1])
    path = m[2]
    fits = [(len(r), r, a) for r, a in rule_list for h, p in [(r[: r.index("/")], r[r.index("/") :])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        _, rule, action = max(fits)
        return host, path, rule, action
    return host, path, None, "block" if any(host == h or host.endswith("." + h) for h in hosts) else "allow"


ODD_URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/7", "http://example.com/en/7?x#y", "http://example.com/en/#a", "https://a.b.net/de/1", "x://net/de/",
    "http://sub.example.net/de/80", "http://badexample.net/de/8", "http://.com/en/", "http://spam-farm.example.org", "http://m.spam-farm.example.org?q", "http://xspam-farm.example.org/",
    "http://a..org/es/x", "http://ünï.org/es/ß", "http://host\nname.com/en/7\nb", "http://a://b.com/en/", "http://cheap-pills.example.com/en/1", "http://e.com/en",
]


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_url_filter(spark, sf, limit):
    urls = [r["url"] for r in rows(spark.read.parquet(f"{sf}/pages.parquet").select("url"))] + ODD_URLS * 2
    df = spark.createDataFrame([(i if i % 50 else None, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, keys string")
    got = rows(urlfilter.judge(df, max_bytes=limit))
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got) == Counter(
        (i if i % 50 else None, *brute_judge(u)) for i, u in enumerate(urls)
    )


def test_long_hosts_and_a_listed_table(spark):
    urls = ["http://" + "a." * 150_000 + "bad.org/x", "http://" + "." * 200_000, "http://" + "x" * 300_000 + ".com/en/", "http://a.b.c.d.e.f.g/", "http://f.g/", "http://bad.org.evil/"]
    hosts = spark.createDataFrame([("bad.org",), ("c.d.e.f.g",), (None,), ("",), ("bad.org",)], "host string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in rows(urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), blocked_hosts=hosts))}
    assert got == {0: (None, "block"), 1: (None, "allow"), 2: ("com/en/", "block"), 3: (None, "block"), 4: (None, "allow"), 5: (None, "allow")}


def test_url_filter_empty(spark):
    assert rows(urlfilter.judge(spark.createDataFrame([], "page_id long, url string"))) == []


def test_cascade_is_exact(spark):
    keys = spark.range(6000).selectExpr("xxhash64(id) as h1", "xxhash64(id, 7) as h2", "id")
    listed = keys.filter("id % 5 = 0")
    cascade = urlfilter.build(listed.select("h1", "h2"), keys.select("h1", "h2"))
    assert len(cascade.levels) > 2
    table = keys.collect()
    got = cascade.member(np.array([r["h1"] for r in table]).view(np.uint64), np.array([r["h2"] for r in table]).view(np.uint64))
    assert got.tolist() == [r["id"] % 5 == 0 for r in table]
    assert urlfilter.build(listed.select("h1", "h2"), keys.select("h1", "h2"), max_bytes=10) is None


# ---- personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(text):
    out = []
    for k, kind in enumerate(PATTERNS):
        for m in re.finditer(PATTERNS[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


TRICKY = [
    "a@b.cc_d@e.ff%g@h.i", "x@y", "@a.b", "a@b.c.d.", "1.2.3.4.5.6.7.8", "0255.0000.1.2 256.1.1.1 1.2.3", "4111 1111 1111 1111-", "4111-1111-1111-1111 4111111111111111",
    "+1 (212) 555-1234 +12345678", "+1--------------------2", "++491234567890", "é@b.c 𝒳 me@x.org 𝒳 10.0.0.1", "1" * 3000, "1 2-" * 400, "a" * 5000 + "@" + "b." * 300 + "c",
    "1.1.1.1 " * 700, "mail: joe.doe [at] example [dot] com, call (212) 555-0199 or 212-555-0188", "card 4111/1111/1111/1111 paid", "2024.01.02 total 123 456 7890", "",
]


@pytest.mark.parametrize("name", ["documents", "odd", "empty", "tricky"])
def test_pii_base(request, spark, name):
    if name == "tricky":
        docs = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    else:
        docs = request.getfixturevalue(name)
    table = rows(docs)
    got = rows(pii.detect(docs))
    want = Counter()
    for r in table:
        found = brute_spans(r["text"] or "")
        joined = ",".join(f"{list(PATTERNS)[k]}:{s}:{e}" for s, k, e in found)
        n = Counter(k for _, k, _ in found)
        want[r["doc_id"], *(n[k] for k in range(4)), hashlib.sha256(joined.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], *(r[f"n_{k}"] for k in PATTERNS), r["base_sha256"]) for r in got) == want
    texts = {r["doc_id"]: r["text"] or "" for r in table}
    for r in got:
        spans = [x.split(":") for x in r["spans"].split(",")] if r["spans"] else []
        assert [(int(s), pii.ALL_KINDS.index(k)) for k, s, _ in spans] == sorted((int(s), pii.ALL_KINDS.index(k)) for k, s, _ in spans)
        assert r["n_spans"] == len(spans)
        if list(texts).count(r["doc_id"]) == 1 and r["doc_id"] not in (2, 11) or name == "documents":
            base = {f"{list(PATTERNS)[k]}:{s}:{e}" for s, k, e in brute_spans(texts[r["doc_id"]])}
            assert base <= {":".join(x) for x in spans}
            assert len(spans) == len(base) + r["n_added"]


def test_pii_method_adds(spark):
    text = TRICKY[16]
    got = rows(pii.detect(spark.createDataFrame([(1, text), (2, "version 2024.01.02 of 12 3456")], "doc_id long, text string")))
    cut = {r["doc_id"]: {k: text[int(s) : int(e)] for k, s, e in (x.split(":") for x in r["spans"].split(","))} if r["spans"] else {} for r in got}
    assert cut[1]["email"] == "joe.doe [at] example [dot] com" and cut[1]["phone"] in ("212-555-0188", "(212) 555-0199")
    assert cut[2] == {}


def brute_candidates(text, kind):
    """The generator's matches with their surroundings up to the neighbouring matches."""
    found = list(re.finditer(pii.GENERATORS[kind], text, re.A))
    ends, starts = [0, *[m.end() for m in found]], [*[m.start() for m in found[1:]], len(text)]
    return [(m.start(), m.end(), m[0], text[a : m.start()][-24:], text[m.end() : b][:24]) for m, a, b in zip(found, ends, starts, strict=False)]


def brute_features(kind, m, before, after):
    has = lambda pattern, x: float(bool(re.search(pattern, x, re.A)))
    digits, marks = re.sub("[^0-9]", "", m), re.sub("[0-9A-Za-z]+", "", m)
    return [
        float(pii.ALL_KINDS.index(kind)), float(len(m)), float(len(digits)), float(len(re.split("[^0-9A-Za-z]+", m))), has(r"\(", m), has(r"(?i)[\[({](?:at|dot)[\])}]", m),
        float(bool(marks) and marks == marks[0] * len(marks)), float(bool(digits) and luhn(digits[-19:])), has(f"(?i){pii.CUES[kind]}", before),
        has(r"[A-Za-z0-9=\"'#$./]\Z", before), has(r"\A[A-Za-z0-9\"'%$./]", after), has(r"(?i)(?:total|sum|no\.?|id|version|page|usd|eur|time|\$)[^A-Za-z]{0,3}\Z", before),
        float(len(re.findall("[A-Z]", m))), has(r"\A[0-9a-fA-F]+\Z", m), float(len(re.findall("[A-Za-z][0-9]", m))), float(len(re.findall("[A-Za-z]{4,}", m))),
    ]


def brute_added(text):
    trees, limits = pii.fitted(rate=0.4)
    base = [(s, e) for s, _, e in brute_spans(text)]
    picked = []
    for kind in pii.ADDED_KINDS:
        for s, e, m, before, after in brute_candidates(text, kind):
            v = pii.score(trees, brute_features(kind, m, before, after), 0.4)
            if v >= limits[kind] and not any(s < b and a < e for a, b in base):
                picked.append((-v, s, pii.ALL_KINDS.index(kind), e))
    return {f"{pii.ALL_KINDS[k]}:{s}:{e}" for v, s, k, e in picked if not any(o != k and a < e and s < b and (w, a, o) < (v, s, k) for w, a, o, b in picked)}


@pytest.mark.parametrize("name", ["documents", "made", "tricky"])
def test_pii_added_equals_brute_force(request, spark, name):
    made = [x["text"] for x in pii.generated(120, seed=77)]
    texts = {"made": made, "tricky": TRICKY}.get(name)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string") if texts else request.getfixturevalue(name)
    text = {r["doc_id"]: r["text"] or "" for r in rows(docs)}
    total = 0
    for r in rows(pii.detect(docs)):
        own = text[r["doc_id"]]
        base = {f"{list(PATTERNS)[k]}:{s}:{e}" for s, k, e in brute_spans(own)}
        added = (set(r["spans"].split(",")) if r["spans"] else set()) - base
        assert added == brute_added(own) - base, own[:300]
        assert r["n_added"] == len(added)
        total += len(added)
    assert total > 0


def test_pii_finds_what_was_planted(spark):
    """Recall and precision by kind on generated texts that the trees have not seen, base spans included."""
    texts = pii.generated(400, seed=1234)
    got = {r["doc_id"]: r["spans"] for r in rows(pii.detect(spark.createDataFrame([(i, x["text"]) for i, x in enumerate(texts)], "doc_id long, text string")))}
    planted, found, right, caught = Counter(), Counter(), Counter(), Counter()
    for i, x in enumerate(texts):
        spans = [(k, int(s), int(e)) for k, s, e in (y.split(":") for y in got[i].split(","))] if got[i] else []
        same = lambda a, b: min(a[2], b[2]) - max(a[1], b[1]) >= 0.8 * max(a[2] - a[1], b[2] - b[1])
        for p in x["planted"]:
            planted[p[0]] += 1
            caught[p[0]] += any(same(p, y) for y in spans)
        for y in spans:
            found[y[0]] += 1
            right[y[0]] += any(same(p, y) for p in x["planted"])
    for kind in pii.ADDED_KINDS:
        print(kind, "recall", caught[kind] / planted[kind], "precision", right[kind] / max(1, found[kind]))
        assert caught[kind] >= 0.9 * planted[kind] and right[kind] >= 0.9 * found[kind], kind


def test_pii_of_the_corpus(spark, documents):
    """Credentials and card-like numbers of the documents are caught; documents without a digit are left alone."""
    for r in rows(documents.join(pii.detect(documents).select("doc_id", "spans"), "doc_id")):
        spans = {x.split(":")[0]: x for x in r["spans"].split(",")} if r["spans"] else {}
        if re.search(r'token = "[0-9a-f]{40}"', r["text"] or ""):
            assert "secret" in spans
        if re.search(r"(?<!\S)[0-9]{16}(?!\S)", r["text"] or ""):
            assert "card" in spans
        if not re.search(r"[0-9]", r["text"] or ""):
            assert not spans


def test_pii_long_text_in_seconds(spark):
    import time

    docs = spark.createDataFrame([(1, "call (212) 555-0188 or 4111/1111/1111/1112, me@x.org " * 6600), (2, "4" * 350_000), (3, "a1" * 175_000)], "doc_id long, text string")
    pii.fitted(rate=0.4)
    start = time.time()
    got = {r["doc_id"]: r for r in rows(pii.detect(docs))}
    assert time.time() - start < 60
    assert got[1]["n_email"] == 6600 and got[1]["n_added"] >= 6600


def test_redact(spark):
    texts = [(1, "write a@b.cc now, 10.0.0.1!"), (2, None), (3, "no data"), (4, "+1 (212) 555-1234 4111111111111111"), (5, "a@b.cc 1.1.1.1 " * 400)]
    got = {r["doc_id"]: r["text"] for r in rows(pii.redact(spark.createDataFrame(texts, "doc_id long, text string")))}
    assert got[1] == "write [EMAIL] now, [IP]!" and got[2] == "" and got[3] == "no data"
    assert got[4] == "[PHONE] [CARD]" or "[PHONE]" in got[4]
    assert got[5] == "[EMAIL] [IP] " * 400


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.random((300, len(pii.FEATURES))).tolist()
    y = [int(r[1] > 0.5 and r[2] < 0.7) for r in x]
    trees = pii.boost(x, y)
    assert sum((sum(0.4 * pii._value(t, r) for t in trees) > 0) == bool(k) for r, k in zip(x, y, strict=True)) > 285


# ---- quality rules


def brute_rules(text):
    words = re.findall(BLANK, text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(BLANK, line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


@pytest.mark.parametrize("name", ["documents", "odd", "empty"])
def test_rules(request, name):
    docs = request.getfixturevalue(name)
    want = Counter((r["doc_id"], *brute_rules(r["text"] or "")) for r in rows(docs))
    got = rows(rules.apply_rules(docs))
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert Counter(tuple(r[c] for c in cols) for r in got) == want
    assert all(not (r["kept"] and r["base_failed"]) for r in got)
    if name == "documents":
        assert all(r["kept"] != r["base_failed"] for r in got)


def test_repeats(spark):
    texts = ["a b c d e a b c d e", "a a a a a a", "a b c d e f a b c d e g a b c d e", "a b c d", "x " * 40 + "y z", "a\tb c d e\na b c d e", "a b c d e f g h i a b c d e f g h i j k"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    assert {r["doc_id"]: r["n_repeat_words"] for r in rows(rules.features(docs))} == {i: brute_rules(t)[4] for i, t in enumerate(texts)}


def test_bad_host_loses_its_documents(spark):
    good = " ".join(f"word{i}" for i in range(30))
    docs = spark.range(400).selectExpr("id as doc_id", f"case when id % 4 = 0 and id % 16 > 0 then 'too short' else '{good}' end as text", "concat('h', id % 4) as source")
    got = rows(rules.apply_rules(docs))
    assert not any(r["kept"] for r in got if r["doc_id"] % 4 == 0) and all(r["kept"] for r in got if r["doc_id"] % 4)
    assert any(not r["base_failed"] and not r["kept"] for r in got)


@pytest.mark.parametrize("name", ["symbols", "lines", "short", "long"])
def test_every_rule_counts_against_a_host(spark, name):
    good = [f"word{i}" for i in range(40)]
    bad = {"symbols": " ".join(w + "###" for w in good), "lines": "\n".join(["same"] * 4 + good), "short": " ".join("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMN"), "long": " ".join(w * 5 for w in good)}[name]
    docs = spark.range(300).selectExpr("id as doc_id", "concat('h', id % 3) as source").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.lit(bad)).otherwise(" ".join(good)))
    got = rows(rules.apply_rules(docs))
    assert not any(r["base_failed"] for r in got)
    assert all(r["kept"] == (r["doc_id"] % 3 > 0) for r in got)


def test_rates_are_shrunk_to_the_prior(spark):
    """Against the formulas written out: a host of few documents keeps near the mean of all."""
    good, short = " ".join(f"word{i}" for i in range(30)), "too short"
    plan = {"a": (200, 20), "b": (100, 40), "c": (2, 2), "d": (50, 0), None: (3, 1)}
    docs = [(len(plan) * i, short if i < bad else good, h) for h, (n, bad) in plan.items() for i in range(n)]
    got = {}
    for r in rows(rules.apply_rules(spark.createDataFrame(docs, "doc_id long, text string, source string")).join(spark.createDataFrame(docs, "doc_id long, text string, source string").select("doc_id", "source").distinct(), "doc_id")):
        got.setdefault(round(r["host_rate"], 9), 0)
    n, bad = sum(v[0] for v in plan.values()), sum(v[1] for v in plan.values())
    mean = bad / n
    spread = sum(b * b / m for m, b in plan.values()) / n - mean**2
    size = n / len(plan)
    noise = mean * (1 - mean) / size
    weight = min(max(mean * (1 - mean) / (spread - noise) - 1 if spread > noise else size, 2), size + 2)
    assert set(got) == {round((b + mean * weight) / (m + weight), 9) for m, b in plan.values()}


# ---- token totals


@pytest.mark.parametrize("name", ["documents", "odd", "empty"])
def test_token_counts(request, name):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(name)
    tok = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    want = Counter()
    for r in rows(docs):
        text = r["text"] or ""
        if words := len(re.findall(BLANK, text)):
            for version, n in (("v", len(tok.encode(text, add_special_tokens=False).ids) + 1), ("words", words)):
                want[r["source"], r["lang"], version, "n"] += 1
                want[r["source"], r["lang"], version, "t"] += n
    got = Counter()
    for r in rows(tokencounts.maintained(docs, queries.TOKENIZER, "v")):
        got[r["source"], r["lang"], r["tokenizer"], "n"] = r["documents"]
        got[r["source"], r["lang"], r["tokenizer"], "t"] = r["tokens"]
    assert got == want


def test_rollup_commits(spark, tmp_path):
    rollup = tokencounts.Rollup(spark, f"file://{tmp_path}/totals")
    changes = lambda *r: spark.createDataFrame(list(r), "source string, lang string, tokenizer string, sign int, tokens long")
    assert rows(rollup.totals()) == []
    assert rollup.commit("a/1", changes(("s", "en", "v", 1, 10), ("s", None, "v", 1, None)))
    assert not rollup.commit("a/1", changes(("s", "en", "v", 1, 10)))
    assert rollup.commit("b", changes(("s", "en", "v", -1, 10), ("s", "en", "v", 1, 12)))
    want = {("s", "en", "v", 1, 12), ("s", None, "v", 1, 0)}
    assert {tuple(r.values()) for r in rows(rollup.totals())} == want
    rollup.compact()
    assert {tuple(r.values()) for r in rows(rollup.totals())} == want and rollup.batches() == {"a/1", "b"}
    assert not rollup.commit("b", changes(("s", "en", "v", 1, 1))) and rollup.committed("a/1") and not rollup.committed("c")
    with pytest.raises(OSError):  # another writer's folder is never moved into
        rollup._publish(rollup.totals(), rollup._names()[0])
    assert {tuple(r.values()) for r in rows(rollup.totals())} == want
    rollup.commit("c", changes(("s", "en", "v", -1, 12)))
    rollup.compact()
    assert {tuple(r.values()) for r in rows(rollup.totals())} == {("s", None, "v", 1, 0)} and rollup.batches() == {"a/1", "b", "c"}


def test_folds(spark, documents):
    assert zlib.crc32(b"7") % 5 == rows(documents.filter("doc_id = 7").selectExpr("crc32(cast(cast(doc_id as string) as binary)) % 5 as x"))[0]["x"]
