"""Operators over documents against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from logspark.llm import _common, exactdedup, graph, langid, mixing, packing, quality, queries, simhash

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [r.asDict() for r in df.collect()]


# ---- exact dedup


def brute_dedup(table):
    groups = defaultdict(list)
    for r in table:
        groups[r["text"] or ""].append(r["doc_id"])
    out, seen = [], set()
    for r in table:
        ids = [i for i in groups[r["text"] or ""] if i is not None]
        keep = max(ids) if ids else None
        once = (r["doc_id"], r["text"] or "")
        kept = r["doc_id"] == keep and once not in seen
        if kept:
            seen.add(once)
        out.append((str(r["doc_id"]), str(keep), len(groups[r["text"] or ""]), kept, hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("block", [700, 8192])
@pytest.mark.parametrize("name", ["documents", "odd", "empty"])
def test_exact_dedup(request, name, block):
    docs = request.getfixturevalue(name)
    if name == "documents" and block == 700:
        docs = docs.limit(60)
    table = rows(docs)
    got = exactdedup.exact_dedup(docs, block_bytes=block)
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in rows(got)) == brute_dedup(table)


def test_dedup_hot_block(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then repeat('hot text ', 40) else concat('text ', id % 100) end as text")
    got = rows(exactdedup.exact_dedup(docs, block_bytes=64))
    assert sum(r["kept"] for r in got) == 1 + len({f"text {i % 100}" for i in range(3000) if i % 3})
    assert {r["keep_id"] for r in got if r["doc_id"] % 3 == 0} == {2997}
    assert all(r["group_size"] == 1000 for r in got if r["doc_id"] % 3 == 0)


def test_dedup_in_the_jvm(spark, odd, monkeypatch):
    """Blocks are named where the shuffle left them: no copies of them in Arrow buffers and Python workers beside the heap."""
    plans, write = [], exactdedup.materialise
    monkeypatch.setattr(exactdedup, "materialise", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or write(df, name))
    exactdedup.exact_dedup(odd)
    assert plans and not any("MapInArrow" in p or "Python" in p for p in plans)
    # One shuffle brings equal blocks together; naming them adds none.
    assert plans[0].split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 1


def test_dedup_equal_hashes(spark, monkeypatch):
    """Names come from the blocks, not from their hashes, in salted groups and others."""
    for n in (40, 400):
        docs = spark.range(n).selectExpr("id as doc_id", "concat('text ', id % 20, repeat('=', 70)) as text")
        with monkeypatch.context() as m:
            m.setattr(exactdedup.F, "xxhash64", lambda *cols: exactdedup.F.lit(5).cast("long"))
            got = rows(exactdedup.exact_dedup(docs, block_bytes=64))
        assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in got} == {(i, n - 20 + i % 20, n // 20) for i in range(n)}


def test_many_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(exactdedup, "RUN", 64)
    docs = spark.range(1000).selectExpr("case when id < 900 then 7 else id end as doc_id", "case when id < 900 then 'same' else 'other' end as text")
    got = rows(exactdedup.exact_dedup(docs))
    assert len(got) == 1000 and sum(r["kept"] for r in got) == 2
    assert {(r["keep_id"], r["group_size"]) for r in got} == {(7, 900), (999, 100)}


def test_keep_distinct(odd):
    kept = rows(exactdedup.keep_distinct(odd))
    assert sorted((str(r["doc_id"]), (r["text"] or "")[:60] + str(len(r["text"] or ""))) for r in kept) == sorted(
        (a, t) for a, t in {(str(r["doc_id"]), (r["text"] or "")[:60] + str(len(r["text"] or ""))) for r in rows(odd)} if (a, t) in _kept(odd)
    )
    assert set(kept[0]) == set(odd.columns)


def _kept(odd):
    best = {}
    for r in rows(odd):
        t = r["text"] or ""
        old = best.get(t)
        best[t] = r["doc_id"] if old is None or r["doc_id"] is not None and r["doc_id"] > old else old
    return {(str(i), t[:60] + str(len(t))) for t, i in best.items()}


# ---- simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius=4):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i in range(len(ids)):
        least[find(i)].append(ids[i])
    return [min((x for x in least[find(i)] if x is not None), default=None) for i in range(len(ids))]


@pytest.mark.parametrize("name", ["documents", "odd", "empty"])
def test_simhash(request, name):
    docs = request.getfixturevalue(name)
    table = rows(docs)
    fps = [brute_fingerprint(r["text"]) for r in table]
    comp = brute_components([r["doc_id"] for r in table], fps)
    want = Counter((r["doc_id"], f"{f:016x}", c) for r, f, c in zip(table, fps, comp, strict=True))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows(simhash.near_duplicates(docs))) == want


@pytest.mark.parametrize("limit", [3, 40, 20_000])
def test_links_exact(spark, limit):
    import random

    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for b in base[:12]:
        for _ in range(25):
            x = b
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    roots = {r["node"]: r["root"] for r in rows(graph.components(simhash.links(df, 4, limit)))}
    comp = brute_components(list(range(len(fps))), fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    mine = [roots.get(s, s) for s in signed]
    assert len(set(zip(mine, comp, strict=True))) == len(set(comp)) == len(set(mine))


def test_manhattan_is_lower_bound():
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 2000, dtype=np.uint64), rng.integers(0, 2**63, 2000, dtype=np.uint64)
    counts = [simhash.segment_counts(x) for x in (a, b)]
    lanes = [(c[:, None] >> np.arange(0, 64, 2, dtype=np.uint64)) & np.uint64(3) for c in counts]
    exact = np.abs(lanes[0].astype(int) - lanes[1].astype(int)).sum(axis=1)
    assert (simhash.manhattan(*counts) == exact).all()
    assert (exact <= np.bitwise_count(a ^ b)).all()


def test_keep_one(odd):
    kept = rows(simhash.keep_one(odd))
    fps = [brute_fingerprint(r["text"]) for r in rows(odd)]
    assert len(kept) == len(set(brute_components(list(range(len(fps))), fps)))
    assert set(kept[0]) == set(odd.columns)


def test_hub_components(spark):
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(60)]
    roots = {r["node"]: r["root"] for r in rows(graph.components(spark.createDataFrame(edges, "u long, v long")))}
    assert all(roots[i] == 0 for i in range(400)) and all(roots[1000 + i] == 1000 for i in range(61))


# ---- packing


@pytest.mark.parametrize("name", ["documents", "odd", "empty"])
def test_packing(request, name):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(name)
    tok = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    want = Counter()
    for r in rows(docs):
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), 4096)):
            part = ids[s : s + 4096]
            want[r["doc_id"], k, s, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))] += 1
    got = rows(packing.pack(docs, queries.TOKENIZER, group_pieces=40))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r["length"] for r in got)
    if name == "documents":
        assert len(bins) <= 1.02 * math.ceil(total / 4096) + 1
    # Certificates: no packing of these pieces has fewer sequences than the bound, nor has any partition.
    used, bound = packing.certificate(packing.pack(docs, queries.TOKENIZER, group_pieces=40))
    import numpy as np

    assert used == len(bins) and bound == packing.lower_bound(np.array([r["length"] for r in got], dtype=np.int64), 4096)
    assert bound <= used <= 1.02 * bound + 1
    assert all(r["partition_bound"] <= r["partition_bins"] for r in got)


def test_tokens_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    from logspark.llm.tokenize import WordTokenizer

    path = public_tokenizers.path(queries.TOKENIZER)
    own, tok = WordTokenizer(path), Tokenizer.from_file(path)
    assert own.fast
    for text in ["", " ", "It's the 'tis 're\t\n x's!!'s ''d", "ÀÉÎ straße ÿŸ 12٣½", "a<|endoftext|>b", "<|", "é́", "İıK", "x y z\x1cw\x85", "漢字 🙂 a_b", "''''s 'll'd", "ŉ ſ ª º µ"]:
        import numpy as np

        assert np.frombuffer(own.ids(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_lower_bound_holds():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(60):
        lengths = np.sort(rng.integers(1, 100, rng.integers(1, 40)))[::-1].copy()
        bins, offsets, used = packing.best_fit(lengths, 100)
        fill = np.bincount(bins, weights=lengths)
        assert fill.max() <= 100 and used == bins.max() + 1
        assert packing.lower_bound(lengths, 100) <= used
    assert packing.lower_bound(np.array([51, 51, 51]), 100) == 3
    assert packing.lower_bound(np.array([60, 60, 30, 30, 30]), 100) == 3


# ---- mixing


def brute_targets(table):
    sizes = Counter()
    for r in table:
        sizes[r["source"]] += len(BLANK.findall(r["text"] or ""))
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    w = {s: i % 3 + 1 for i, s in enumerate(order)}
    total = sum(sizes.values())
    target = {s: total * w[s] / sum(w.values()) for s in order} if order else {}
    for _ in range(100):
        excess = sum(max(0, target[s] - 3 * sizes[s]) for s in order)
        if excess < 1e-9:
            break
        for s in order:
            target[s] = min(target[s], 3 * sizes[s])
        free = [s for s in order if target[s] < 3 * sizes[s]]
        for s in free:
            target[s] += excess * w[s] / sum(w[x] for x in free)
    return sizes, target


@pytest.mark.parametrize("name", ["documents", "odd", "empty"])
def test_mix(request, name):
    docs = request.getfixturevalue(name)
    table = rows(docs)
    sizes, target = brute_targets(table)
    got = rows(mixing.mix(docs))
    assert len(got) == len(table)
    by_id = defaultdict(list)
    for r in table:
        by_id[r["doc_id"]].append((len(BLANK.findall(r["text"] or "")), r["source"]))
    taken = Counter()
    for r in got:
        match = [s for n, s in by_id[r["doc_id"]] if n == r["size"] and sizes[s] == r["source_size"] and abs(target[s] - r["target"]) < 1e-6]
        assert match
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
        taken[match[0]] += r["taken"]
    if name == "documents":
        for s in sizes:
            assert abs(taken[s] - target[s]) <= 0.02 * target[s] + 5
    assert got == rows(mixing.mix(docs)) or Counter(map(str, got)) == Counter(map(str, rows(mixing.mix(docs))))


def test_flow_overlap():
    patterns = {("a",): 100, ("a", "b"): 100, ("b",): 10}
    sent = mixing.flow(patterns, {"a": 100, "b": 100})
    used = Counter()
    got = Counter()
    for (p, s), n in sent.items():
        used[p] += n
        got[s] += n
    assert got["a"] == pytest.approx(100) and got["b"] == pytest.approx(100)
    assert all(used[p] <= patterns[p] + 1e-6 for p in patterns)  # all fits without a repetition
    sent = mixing.flow(patterns, {"a": 300, "b": 300})
    assert sum(sent.values()) == pytest.approx(600)


def lap_cost(used, words):
    """The k-th repetition of a word costs k."""
    return sum(k * max(0, min(used - (k - 1) * words, words)) for k in (1, 2, 3))


def cheapest(patterns, quotas):
    """(most words sent, least cost of that), over all whole-numbered flows."""
    names = list(patterns)
    best = (0, 0)

    def deals(p, need, room):
        if not p:
            yield {}
            return
        for n in range(min(room, need[p[0]]) + 1):
            for rest in deals(p[1:], need, room - n):
                yield {p[0]: n} | rest

    def go(i, need, sent, cost):
        nonlocal best
        if i == len(names):
            best = max(best, (sent, -cost))
            return
        p = names[i]
        for deal in deals(p, need, 3 * patterns[p]):
            n = sum(deal.values())
            go(i + 1, {s: q - deal.get(s, 0) for s, q in need.items()}, sent + n, cost + lap_cost(n, patterns[p]))

    go(0, quotas, 0, 0)
    return best[0], -best[1]


def test_flow_is_cheapest():
    import random

    rng = random.Random(6)
    shapes = [[("a",), ("a", "b"), ("b",)], [("a", "b"), ("b", "c"), ("a", "c")], [("a",), ("a", "b", "c"), ("c",)]]
    for k in range(45):
        patterns = {p: rng.randint(0, 3) for p in shapes[k % 3]}
        quotas = {s: rng.randint(0, 6) for s in "abc" if any(s in p for p in patterns)}
        sent = mixing.flow(patterns, quotas)
        used, got = Counter(), Counter()
        for (p, s), n in sent.items():
            assert s in p and n > 0
            used[p] += n
            got[s] += n
        assert all(used[p] <= 3 * patterns[p] + 1e-6 for p in patterns) and all(got[s] <= quotas[s] + 1e-6 for s in quotas)
        words, cost = cheapest(patterns, quotas)
        assert sum(sent.values()) == pytest.approx(words) and sum(lap_cost(used[p], patterns[p]) for p in patterns) == pytest.approx(cost)


def test_mix_overlapping_members(spark):
    """The words that the patterns give add up to what the quotas of their sources ask for."""
    from pyspark.sql import functions as F

    docs = spark.range(1200).selectExpr("id as doc_id", "repeat('w ', int(id % 7) + 1) as text", "case when id % 4 = 0 then 'a' when id % 4 < 3 then 'b' else 'c' end as source")
    member = lambda i: ("a", "b") if i % 4 == 1 else ({0: "a", 2: "b", 3: "c"}[i % 4],)
    members = F.when(F.col("doc_id") % 4 == 1, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array("source"))
    got = rows(mixing.mix(docs, members))
    words, taken = Counter(), Counter()
    for r in got:
        words[member(r["doc_id"])] += r["size"]
        taken[member(r["doc_id"])] += r["taken"]
    sizes = Counter()
    for p, n in words.items():
        for s in p:
            sizes[s] += n
    target = mixing.targets(sizes)
    want = Counter()
    for (p, _), n in mixing.flow(dict(words), target).items():
        want[p] += n
    assert len(got) == 1200 and set(words) == {("a",), ("b",), ("a", "b"), ("c",)}
    # Flows of one cost can differ in where they take: the cost is what is compared, and each pattern's laps.
    assert abs(sum(lap_cost(taken[p], words[p]) - lap_cost(want[p], words[p]) for p in words)) <= 30
    assert all(taken[p] <= 3 * words[p] for p in words)
    assert abs(taken["c",] - target["c"]) <= 3
    assert abs(taken["a",] + taken["b",] + taken["a", "b"] - target["a"] - target["b"]) <= 9
    assert taken["a",] <= target["a"] + 3 and taken["b",] <= target["b"] + 3
    assert {r["source_size"] for r in got if r["doc_id"] % 4 == 0} == {sizes["a"]}


def test_mix_many_sources(spark, monkeypatch):
    """More sources than are broadcast; one of them holds a third of the rows."""
    monkeypatch.setattr(mixing, "HEAVY_KEYS", 64)
    monkeypatch.setattr(_common, "HEAVY_KEYS", 64)
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', int(id % 5) + 1) as text", "case when id % 3 = 0 then 'hot' else concat('s', id div 2) end as source")
    sizes, target = brute_targets(rows(docs))
    got = rows(mixing.mix(docs))
    assert len(sizes) > 10 * mixing.HEAVY_KEYS and len(got) == 3000
    own = {r["doc_id"]: r["source"] for r in rows(docs)}
    taken = Counter()
    for r in got:
        s = own[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - target[s]) < 1e-6 and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 5 for s in sizes)


@pytest.mark.parametrize("boundary", [3, 50])
def test_cut_of_many_passes(spark, monkeypatch, boundary):
    monkeypatch.setattr(mixing, "BOUNDARY_DOCS", boundary)
    docs = spark.range(6000).selectExpr("id as doc_id", "repeat('w ', int(id % 5) + 1) as text", "case when id % 3 = 0 then null else 'b' end as source")
    got = rows(mixing.mix(docs))
    taken, target = Counter(), {}
    for r in got:
        s = None if r["doc_id"] % 3 == 0 else "b"
        taken[s] += r["taken"]
        target[s] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 3 for s in target) and target


def test_source_targets(spark):
    import random

    rng = random.Random(8)
    for n in (0, 1, 2, 7, 300):
        sizes = {f"s{k:04}": rng.choice([0, 1, rng.randrange(10), rng.randrange(10_000)]) for k in range(n)}
        if n > 5:
            sizes[None] = 50
        df = spark.createDataFrame([(s, k) for s, k in sizes.items()], "source string, size long")
        got = {r["source"]: r["target"] for r in rows(mixing.source_targets(df))}
        assert got == pytest.approx(mixing.targets(sizes))


def test_mixture_repeats(documents):
    want = sum(r["times"] for r in rows(mixing.mix(documents)))
    out = mixing.mixture(documents)
    assert out.columns == documents.columns and out.count() == want


# ---- language


def brute_phrases(text, sample):
    n = i = 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in sample:
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


def test_cross_parse_equals_brute_force(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 40)
    samples = {"en": "the cat sat on the mat and the rat ate that", "de": "die katze sass auf der matte und die ratte"}
    model = langid.Model(samples)
    texts = ["the mat and die matte zebra qq! the rat", "", None, "ratte und katze " * 9, "?"]
    counts, _ = model.phrases(texts)
    marks = {c: chr(200 + c) for c in range(60)}
    for t, row in zip(texts, counts.tolist(), strict=True):
        for lang, n in zip(model.languages, row, strict=True):
            norm = lambda x: "".join(marks[c] if c else "\x00" for c in model.normal(x).tolist())
            s, own = norm(samples[lang]), norm(t) if t else ""
            assert n == sum(brute_phrases(own[k : k + 40], s.replace("\x00", "\x01")) for k in range(0, len(own), 40))


def test_unknown_letters_are_phrases():
    model = langid.Model({"en": "the cat sat on the mat"})
    counts, _ = model.phrases(["the qq mat", "the zcat", "zzz", "the cat", ""])
    assert counts[:, 0].tolist() == [4, 3, 3, 1, 0]


def test_a_language_of_copies_is_learned(spark):
    rows_ = [(i, "la casa blanca de la montaña verde", "es") for i in range(4000)]
    rows_ += [(10_000 + i, f"number {i} of the many english lines that we have here", "en") for i in range(300)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string")
    samples = langid.learn(docs)
    assert set(samples) == {"en", "es"} and samples["es"] == "la casa blanca de la montaña verde"
    got = rows(langid.identify(docs))
    assert all(r["lang_pred"] == ("es" if r["doc_id"] < 10_000 else "en") for r in got)


def test_a_thousand_languages(spark, monkeypatch):
    word = lambda k: "".join(chr(97 + (k // 26**i) % 26) for i in range(3))
    own = lambda k: " ".join(f"{word(k)}{word(3 * k + j)}" for j in range(12))
    docs = spark.createDataFrame([(j * 1000 + k, own(k), f"l{k:04}") for j in range(3) for k in range(1000)], "doc_id long, text string, lang string")
    assert len(langid.learn(docs)) == 1000
    some = docs.filter("doc_id >= 1000 and doc_id < 1040")
    samples = langid.learn(docs.filter(~langid.held_out()))
    got = rows(langid.predict(some, samples, carry=("doc_id", "lang")))
    assert sum(r["lang"] == r["lang_pred"] for r in got if r["lang"] in samples) >= 0.9 * len(got)
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 5)
    assert sorted(langid.learn(docs)) == [f"l{k:04}" for k in range(5)]
    monkeypatch.setattr(langid, "TABLE_BYTES", 8 * 100 * 5)
    assert max(map(len, langid.learn(docs).values())) <= 5 * 100


def test_unlearned_latin_languages_are_rejected(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    other = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    ]
    odd = spark.createDataFrame([(10_001 + i, t, None, "x", len(t)) for i, t in enumerate(other)], docs.schema)
    kept = {r["doc_id"] for r in rows(langid.accepted(docs.unionByName(odd)).select("doc_id"))}
    assert not kept & {10_001, 10_002}
    assert {r["doc_id"] for r in rows(docs) if any(c.isalpha() for c in r["text"] or "")} <= kept


def test_language_accuracy(documents):
    lang = {r["doc_id"]: r["lang"] for r in rows(documents)}
    got = rows(langid.identify(documents))
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(lang) and held
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_odd(odd, empty):
    got = rows(langid.identify(odd))
    assert len(got) == odd.count()
    for r, t in zip(sorted(got, key=lambda r: str(r["doc_id"])), sorted(rows(odd), key=lambda r: str(r["doc_id"])), strict=True):
        if r["doc_id"] not in (None, 11):
            assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in t["text"] or ""))
    assert rows(langid.identify(empty)) == []
    assert set(langid.accepted(odd).columns) == set(odd.columns)


# ---- quality


def test_quality(spark, sf, documents, odd, empty):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["doc_id"]: r for r in rows(quality.classify(documents, labels))}
    assert len(got) == documents.count()
    known = [(r["quality"], got[r["doc_id"]]) for r in rows(labels) if r["doc_id"] in got]
    assert sum(q == r["predicted"] for q, r in known) >= 0.85 * len(known)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert quality.classify(odd, labels).count() == odd.count()
    assert rows(quality.classify(empty, labels.limit(0))) == []


def brute_score(net, text):
    """Chunk by chunk, window by window, tap by tap."""
    data = (text or "").encode()
    chunks = []
    for start in range(0, max(1, len(data) - quality.OVERLAP), quality.CHUNK - quality.OVERLAP):
        own = data[start : start + quality.CHUNK]
        best = [0.0] * quality.FILTERS
        for at in range(0, max(1, len(own)), quality.STRIDE):
            taps = [data[start + at + k] if start + at + k < len(data) else 0 for k in range(quality.WIDTH)]
            for f in range(quality.FILTERS):
                z = net.bias[f] + sum(float(net.embed[b] @ net.filters[k][:, f]) for k, b in enumerate(taps))
                best[f] = max(best[f], float(z))
        chunks.append(best)
    mean = [sum(c[f] for c in chunks) / len(chunks) for f in range(quality.FILTERS)]
    most = [max(c[f] for c in chunks) for f in range(quality.FILTERS)]
    logit = sum(x * float(w) for x, w in zip(mean + most, net.out, strict=True)) + float(net.out_bias[0])
    return 1 / (1 + math.exp(-max(-30, min(30, logit))))


def test_score_equals_brute_force():
    import numpy as np

    net = quality.Network()
    net.out = np.linspace(-0.3, 0.3, len(net.out)).astype(np.float32)
    for text in [None, "", "a", "seven b", "é" * 40, "plain words " * 60, "### " * 130 + "end", "x" * 512, "y" * 513, "z" * 961]:
        assert net.score(text) == pytest.approx(brute_score(net, text), abs=1e-4), text


def test_quality_reads_whole_texts():
    import numpy as np

    net = quality.Network()
    net.out = np.full_like(net.out, 0.01)  # weights that keep the score away from 0 and 1
    text = "plain words " * 30_000
    assert 0.05 < net.score(text) < 0.95
    assert net.score(text) != net.score(text[:-400] + "$$$ ### !!!" * 20)
    assert net.score(text) != net.score("$$$ ### !!!" * 20 + text[400:])
    # Parts of a long text see what one piece sees.
    data = np.frombuffer((text + "## " * 9).encode(), dtype=np.uint8)
    pool = net.pooled(data)[0]
    logit = float(np.concatenate((pool.mean(axis=0), pool.max(axis=0))) @ net.out + net.out_bias[0])
    assert net.score(text + "## " * 9) == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, logit)))), abs=1e-6)


def test_repeated_labels_count_once(spark, sf, documents):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    once = quality.sample(documents, labels, rows=60)
    many = quality.sample(documents.unionAll(documents), labels.withColumn("x", spark_range(200)).select("doc_id", "quality"), rows=60)
    assert once == many and len(once) == 60
    assert len(quality.sample(documents, labels)) == len({r["doc_id"] for r in rows(labels) if zlib.crc32(str(r["doc_id"]).encode()) % 5} & {r["doc_id"] for r in rows(documents)})


def spark_range(n):
    from pyspark.sql import functions as F

    return F.explode(F.sequence(F.lit(1), F.lit(n)))
