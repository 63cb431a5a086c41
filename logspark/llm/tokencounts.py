"""Delta-maintained token totals by source, language and tokenizer version.

A batch of changes is reduced to signed sums before it is written, under a name made from the batch id. A batch that
is there already is left alone, so committing one twice, or again after a lost driver, changes nothing. A total is
the sum over batches; ``compact`` folds them into one and remembers their ids.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship
from ._common import materialise, release, shared_dir
from .tokenize import load

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["documents", "tokens"]
_SCHEMA = "source string, lang string, tokenizer string, documents long, tokens long"


class Rollup:
    """Totals in a folder that all executors reach. One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._at = jvm.org.apache.hadoop.fs.Path

    def _names(self) -> list[str]:
        root = self._at(self.path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(root) if s.getPath().getName().startswith("batch-")) if self._fs.exists(root) else []

    def committed(self, batch_id: str) -> bool:
        """Whether a batch is there, by its own name or among the ids of a fold."""
        if self._fs.exists(self._at(f"{self.path}/batch-{batch_id.encode().hex()}")):
            return True
        folds = [f"{self.path}/{n}/ids" for n in self._names() if n.startswith("batch-fold-")]
        return bool(folds) and not self.spark.read.text(folds).filter(F.col("value") == F.lit(batch_id.encode().hex())).isEmpty()

    def batches(self) -> set[str]:
        """Ids of all committed batches; for small rollups and tests, as all reach the driver."""
        found = set()
        for name in self._names():
            if name.startswith("batch-fold-"):
                found |= {bytes.fromhex(r["value"]).decode() for r in self.spark.read.text(f"{self.path}/{name}/ids").collect()}
            else:
                found.add(bytes.fromhex(name.removeprefix("batch-")).decode())
        return found

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add ``changes`` (source, lang, tokenizer, sign, tokens) as one batch; False if it was committed before.

        sign 1: an insert, -1: a delete. A revised count is the delete of the old one and the insert of the new one.
        Null keys are keys; null counts are 0.
        """
        if self.committed(batch_id):
            return False
        sums = changes.groupBy(*KEYS).agg(
            F.sum(F.col("sign").cast("long")).alias("documents"), F.sum(F.col("sign") * F.coalesce(F.col("tokens").cast("long"), F.lit(0))).alias("tokens")
        )
        self._publish(sums, f"batch-{batch_id.encode().hex()}")
        return True

    def _publish(self, sums: DataFrame, name: str, ids: DataFrame | None = None) -> None:
        """Write aside, then rename: a batch is there whole or not at all."""
        aside = f"{self.path}/tmp-{uuid.uuid4().hex}"
        sums.select(*[F.col(c) for c in KEYS + SUMS]).write.parquet(f"{aside}/sums")
        if ids is not None:
            ids.write.text(f"{aside}/ids")
        to = self._at(f"{self.path}/{name}")
        # A rename onto a folder that is there would move into it.
        if self._fs.exists(to) or not self._fs.rename(self._at(aside), to):
            self._fs.delete(self._at(aside), True)
            raise OSError(f"could not publish {name}: another writer was there first")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, documents, tokens; keys whose sums are all zero are gone."""
        names = self._names()
        if not names:
            return self.spark.createDataFrame([], _SCHEMA)
        deltas = self.spark.read.schema(_SCHEMA).parquet(*[f"{self.path}/{n}/sums" for n in names])
        total = deltas.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
        return total.filter("documents <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Fold all batches into one; their ids stay known. A fold that a lost driver left half done is ended first."""
        if not self._fs.exists(self._at(f"{self.path}/fold")):
            names = self._names()
            if len(names) < 2:
                return
            single = [(n.removeprefix("batch-"),) for n in names if not n.startswith("batch-fold-")]  # as many as the folders just listed
            ids = self.spark.createDataFrame(single, "value string")
            if folds := [f"{self.path}/{n}/ids" for n in names if n.startswith("batch-fold-")]:
                ids = ids.unionAll(self.spark.read.text(folds))
            self._publish(self.totals(), "fold", ids)
        known = self.spark.read.text(f"{self.path}/fold/ids")
        single = self.spark.createDataFrame([(n.removeprefix("batch-"),) for n in self._names() if not n.startswith("batch-fold-")], "value string")
        folded = {r["value"] for r in single.join(known, "value", "left_semi").collect()}
        for n in self._names():
            if n.removeprefix("batch-") in folded or n.startswith("batch-fold-"):
                self._fs.delete(self._at(f"{self.path}/{n}"), True)
        self._fs.rename(self._at(f"{self.path}/fold"), self._at(f"{self.path}/batch-fold-{uuid.uuid4().hex}"))

    def delete(self) -> None:
        self._fs.delete(self._at(self.path), True)


def _count(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    ids = load(tokenizer).ids
    for batch in batches:
        texts = [t.as_py() or "" for t in batch.column(3)]
        pieces = np.fromiter((len(ids(t)) // 4 for t in texts), dtype=np.int64, count=len(texts))
        words = np.fromiter((len(t.encode("utf-8").split()) for t in texts), dtype=np.int64, count=len(texts))
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], pa.array(pieces), pa.array(words)], names=["doc_id", "source", "lang", "pieces", "words"])


def counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, source, lang, pieces, words) of every row: ids of ``tokenizer``, and words between ASCII blanks; null texts count as empty."""
    ship(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col(text_col).alias("text"))
    return base.mapInArrow(lambda it: _count(it, tokenizer), f"doc_id {dict(docs.dtypes)[id_col]}, source string, lang string, pieces long, words long")


def maintained(docs: DataFrame, tokenizer: str, version: str) -> DataFrame:
    """Totals after a life of batches, by source, lang and tokenizer version.

    load: every document, under ``version`` and under ``words``. revise: each count of ``version`` grows by the end
    token that a training sequence adds. retract: documents without a word leave both versions. ``load`` is then
    committed again, which changes nothing. Repeated rows count each; null keys are keys; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = materialise(counts(docs, tokenizer), "token-counts")
    change = lambda df, name, sign, tokens: df.select("source", "lang", F.lit(name).alias("tokenizer"), F.lit(sign).alias("sign"), tokens.alias("tokens"))
    load_ = change(rows, version, 1, F.col("pieces")).unionAll(change(rows, "words", 1, F.col("words")))
    revise = change(rows, version, -1, F.col("pieces")).unionAll(change(rows, version, 1, F.col("pieces") + 1))
    none = rows.filter("words = 0")
    retract = change(none, version, -1, F.col("pieces") + 1).unionAll(change(none, "words", -1, F.col("words")))
    rollup = Rollup(spark, f"{shared_dir(spark)}/token-rollup-{uuid.uuid4().hex}")
    for batch_id, changes in (("load", load_), ("revise", revise), ("retract", retract), ("load", load_)):
        rollup.commit(batch_id, changes)
    totals = materialise(rollup.totals(), "token-totals")
    rollup.delete()
    release(rows)
    return totals
