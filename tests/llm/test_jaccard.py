"""Near duplicates by Jaccard similarity against brute force over all pairs."""

import random

import corpus_pipeline
import numpy as np
import pytest
from test_documents import rows

from logspark.llm import jaccard, simhash


def brute_kept(table):
    """The ids that stay: the least of each component of pairs with 5-word Jaccard similarity >= 0.8, words compared as bytes."""
    sets = []
    for _, text in table:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(table)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(table)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(table):
        root = find(i)
        least[root] = min(least.get(root, key), key)
    return sorted(least.values())


@pytest.fixture(scope="module")
def copies():
    """Near copies on both sides of the threshold, chains of them, a large group, a line that many texts share, short and blank texts."""
    rnd, out = random.Random(4), []
    fresh = lambda n: [f"w{rnd.randrange(5000)}" for _ in range(n)]
    line = fresh(14)
    for _ in range(60):
        text = fresh(rnd.randrange(20, 200))
        for _ in range(rnd.randrange(1, 4)):
            out.append(" ".join(line * (rnd.random() < 0.5) + text))
            text = list(text)
            for _ in range(rnd.randrange(0, 6)):
                text[rnd.randrange(len(text))] = f"x{rnd.randrange(10**6)}"
    base = fresh(120)
    for _ in range(150):
        text = list(base)
        for _ in range(rnd.randrange(0, 4)):
            text[rnd.randrange(len(text))] = f"y{rnd.randrange(10**6)}"
        out.append(" ".join(text))
    out += [None, "", " \n", "one", "ONE", "a b c d e", "A b  c d e", "a b c d e f", *(" ".join(line[:k]) for k in range(5, 15))]
    rnd.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("count", [5, 10**9])
def test_keep_one_equals_brute_force(spark, copies, monkeypatch, count):
    monkeypatch.setattr(jaccard, "ORDER_COUNT", count)  # with and without common shingles put last
    docs = spark.createDataFrame(copies, "doc_id long, text string").repartition(5)
    assert sorted(r["doc_id"] for r in rows(jaccard.keep_one(docs))) == brute_kept(copies)


def test_stage_links_similar_texts_of_distant_fingerprints(spark, sf, documents):
    docs = corpus_pipeline.exact(spark, documents, sf)
    kept = sorted(r["doc_id"] for r in rows(corpus_pipeline.near(spark, docs, sf)))
    assert kept == brute_kept([(r["doc_id"], r["text"]) for r in rows(docs)])
    assert 177 not in kept  # similarity 0.83 with document 1, nine bits away


def test_bucket_bound():
    rng = np.random.default_rng(2)
    for n in (0, 1, 3, 40, 700, 30_000):
        for share in (0.0, 0.5, 0.95):
            both = rng.integers(0, 2**64, int(n * share), dtype=np.uint64)
            x, y = (np.unique(np.concatenate((both, rng.integers(0, 2**64, n - len(both) + k, dtype=np.uint64)))) for k in (0, n // 7))
            assert len(np.intersect1d(x, y)) <= jaccard.most_common(jaccard.buckets(x), jaccard.buckets(y), min(len(x), len(y)))
    low = np.arange(900, dtype=np.uint64)  # all in one bucket
    assert jaccard.most_common(jaccard.buckets(low), jaccard.buckets(low[:800]), 800) >= 800
    x, y = (np.unique(rng.integers(0, 2**64, 400, dtype=np.uint64)) for _ in range(2))
    assert not jaccard.linked(jaccard.most_common(jaccard.buckets(x), jaccard.buckets(y), 400), 400, 400)


def test_few_common_shingles(spark, copies, monkeypatch):
    monkeypatch.setattr(jaccard, "ORDER_SHINGLES", 3)
    docs = spark.createDataFrame(copies, "doc_id long, text string")
    assert len(jaccard._order(docs.selectExpr("doc_id", "xxhash64(text) as h", "text"))[0]) <= 3
    assert sorted(r["doc_id"] for r in rows(jaccard.keep_one(docs))) == brute_kept(copies)


def test_odd_and_empty(odd, empty):
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows(kept)) == [(False, i) for i in (1, 3, 6, 9, 10, 11, 11, 12)] + [(True, 0)]
    assert rows(jaccard.keep_one(empty)) == []


def test_runs_of_a_token_across_batches():
    import pyarrow as pa

    cols = np.array([[1, 1, 2, 3, 3, 3, 4], [5, 5, 5, 5, 5, 6, 5], [1, 2, 1, 1, 1, 3, 9]])
    batch = lambda a, b: pa.RecordBatch.from_arrays([pa.array(c[a:b]) for c in cols], names=list("tns"))
    for cut in range(8):
        got = [[c.tolist() for c in cell] for cell in jaccard._cells(iter([batch(0, cut), batch(cut, 7)]), 3) if len(cell[0]) > 1]
        assert got == [[[1, 1], [5, 5], [1, 2]], [[3, 3], [5, 6], [1, 3]]]


def test_group_of_near_copies_costs_its_size(spark, monkeypatch):
    """Most copies resemble their origin and not each other: pairs that are compared one by one don't grow with the square of the group."""
    rnd, out = random.Random(9), []
    base = [f"w{k}" for k in range(150)]
    for _ in range(400):
        text = list(base)
        for at in rnd.sample(range(5, 145), rnd.randrange(1, 4)):
            text[at] = f"x{rnd.randrange(10**9)}"
        out.append(" ".join(text))
    table = list(enumerate([*out, " ".join(base)]))
    made, own = {}, jaccard.materialise

    def counted(df, name):
        done = own(df, name)
        made[name] = done.count()
        return done

    monkeypatch.setattr(jaccard, "materialise", counted)
    assert sorted(r["doc_id"] for r in rows(jaccard.keep_one(spark.createDataFrame(table, "doc_id long, text string").repartition(3)))) == brute_kept(table)
    assert made["chains"] + made["across"] < 10 * len(table), made


def test_fingerprint_is_simhash_of_the_set():
    words = [f"w{k}" for k in range(40)]
    s = jaccard.shingle_set(" ".join(words))
    assert jaccard.fingerprint(s) == int(simhash.fingerprints_of([" ".join(words)], jaccard.SHINGLE).view(np.int64)[0])
    assert jaccard.fingerprint(s[:0]) == 0
    many = np.random.default_rng(1).integers(0, 2**64, 40_000, dtype=np.uint64)
    assert jaccard.fingerprint(many) == sum(1 << b for b in range(63) if 2 * int((many >> np.uint64(b) & np.uint64(1)).sum()) > 40_000) - (2 * int((many >> np.uint64(63)).sum()) > 40_000) * 2**63


def test_stage_takes_links_from_fingerprints(spark, monkeypatch):
    """Without the search by prefixes, texts within four bits are linked, if they are similar."""
    monkeypatch.setattr(jaccard, "_chains", lambda batches: (b for b in batches if False))
    words = [f"w{k}" for k in range(400)]
    s = lambda t: jaccard.fingerprint(jaccard.shingle_set(t)) & (1 << 64) - 1
    text = " ".join(words)
    near = next(t for k in range(400) if 0 < (s(t := " ".join(words[:k] + ["x"] + words[k + 1 :])) ^ s(text)).bit_count() <= 4)
    rnd = random.Random(3)
    alike = [(0, text), (1, near), (2, " ".join(rnd.sample(words, 400)))]
    assert sorted(r["doc_id"] for r in rows(jaccard.keep_one(spark.createDataFrame(alike, "doc_id long, text string")))) == [0, 2]
