"""The pipeline's stages against brute force on the smallest tables."""

from collections import Counter

import corpus_pipeline
import pytest
from test_documents import _kept, rows
from test_jaccard import brute_kept

from logspark.llm import langid


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{tmp_path_factory.mktemp('stages')}/{name}"
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "mixed", "packed"]


def test_language_keeps_clean_documents(stages, documents):
    want = {r["doc_id"] for r in rows(documents) if any(c.isalpha() for c in r["text"] or "")}
    assert {r["doc_id"] for r in rows(stages[0])} == want and stages[0].columns == documents.columns


def test_exact(stages):
    best = {}
    for r in rows(stages[0]):
        best[r["text"]] = max(best.get(r["text"], -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in rows(stages[1])) == sorted(best.values())


def test_near(stages):
    """By brute-force Jaccard similarity; the links of op8_simhash, four bits of 4-word fingerprints, are another contract."""
    table = rows(stages[1])
    assert sorted(r["doc_id"] for r in rows(stages[2])) == brute_kept([(r["doc_id"], r["text"]) for r in table])


def test_mixed_and_packed(stages):
    before, mixed = rows(stages[2]), rows(stages[3])
    assert stages[3].columns == corpus_pipeline.COLUMNS
    times = Counter(r["doc_id"] for r in mixed)
    assert max(times.values()) <= 3 and set(times) <= {r["doc_id"] for r in before}
    first = Counter(r["doc_id"] for r in rows(stages[4]) if r["piece"] == 0)
    assert first == times


def test_run_is_the_stages(spark, sf, stages):
    got = Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows(corpus_pipeline.run(spark, sf)))
    assert got == Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows(stages[4]))


def test_gibberish_is_rejected(spark, documents):
    odd = spark.createDataFrame([(10_001, "漢字仮名交文章 " * 30, None, "x", 1), (10_002, "12 34 !!", None, "x", 1), (10_003, None, None, "x", 1)], documents.schema)
    kept = {r["doc_id"] for r in rows(langid.accepted(documents.unionByName(odd)))}
    assert not kept & {10_001, 10_002, 10_003} and len(kept) > 150


@pytest.mark.parametrize("name", ["odd", "empty"])
def test_stages_on_odd_and_empty_tables(spark, request, sf, name):
    """Each stage by itself on nulls, empty and long texts, ties, repeated rows and clashing columns; rows are told apart by id and text."""
    docs = request.getfixturevalue(name)
    table = rows(docs)
    got = {n: rows(stage(spark, docs, sf)) for n, stage in corpus_pipeline.STAGES}
    own = lambda r: (str(r["doc_id"]), r["text"])
    lettered = Counter(own(r) for r in table if any(c.isalpha() for c in r["text"] or ""))
    assert set(map(own, got["language"])) <= set(lettered)
    assert all(n == lettered[k] for k, n in Counter(map(own, got["language"])).items())
    assert {(i, (t or "")[:60] + str(len(t or ""))) for i, t in map(own, got["exact"])} == _kept(docs)
    assert len(got["near"]) == len(brute_kept([((r["doc_id"] is None, r["doc_id"] or 0), r["text"]) for r in table]))
    worded = {own(r) for r in table if (r["text"] or "").strip(" \t\n\x0b\x0c\r")}
    assert set(map(own, got["mixed"])) <= worded and all(n <= 6 for n in Counter(map(own, got["mixed"])).values())
    assert Counter(str(r["doc_id"]) for r in got["packed"] if r["piece"] == 0) == Counter(str(r["doc_id"]) for r in table)
    assert all(set(got[n][0]) == set(corpus_pipeline.COLUMNS) for n in ("language", "exact", "near", "mixed") if got[n])


def test_run_leaves_little_behind(spark, sf):
    import pathlib

    from logspark.llm._common import shared_dir

    root = pathlib.Path(shared_dir(spark).removeprefix("file://"))
    before = {p.name for p in root.iterdir()}
    corpus_pipeline.run(spark, sf).count()
    stages = {p.name for p in root.iterdir() if p.name.startswith("stage-")} - before
    assert len(stages) == 1 and next(iter(stages)).startswith("stage-mixed")
