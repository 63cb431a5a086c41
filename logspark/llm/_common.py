"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship

#: ASCII blanks, the separators of words in every contract of this subpackage.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

_written: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``). Unset, it is a temporary one in local mode and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="logspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is gone; the shared folder's owner removes the rest
        pass


def _at_exit(spark: SparkSession) -> None:
    for path in list(_written):
        _delete(spark, path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _remember(spark, path)
    df.write.parquet(path)
    return owned(spark.read.schema(df.schema).parquet(path), path)


def _remember(spark: SparkSession, path: str) -> None:
    """The folder goes with the driver, if ``release`` doesn't delete it before."""
    if not _written:
        atexit.register(_at_exit, spark)
    _written.add(path)


def owned(df: DataFrame, path: str) -> DataFrame:
    """``df`` reads a folder of its own, which ``release`` deletes."""
    _remember(df.sparkSession, path)
    df._logspark_path = path
    return df


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete what ``materialise`` writes meanwhile, at the end."""
    before = set(_written)
    try:
        yield
    finally:
        for path in _written - before:
            _delete(spark, path)
            _written.discard(path)


def release(df: DataFrame) -> None:
    """Delete a table of ``materialise`` that no later step reads."""
    if path := getattr(df, "_logspark_path", None):
        _delete(df.sparkSession, path)
        _written.discard(path)


#: Keys that go to every task in ``spread_join``, at most.
HEAVY_KEYS = 4096


def spread_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join without a hot task: ``right`` has one row a key and in ``weight`` at least the number of ``left``'s rows with it.

    ``total``: the sum of all weights. Keys of more than ``total / HEAVY_KEYS`` rows, of which there are fewer than
    HEAVY_KEYS, are broadcast; the others are joined by a shuffle. Both sides should be written tables: they are read twice.
    """
    limit = total // HEAVY_KEYS + 1
    heavy = F.broadcast(right.filter(F.col(weight) > limit))
    light = right.filter(F.col(weight) <= limit)
    few = left.join(heavy.select(key), key, "left_anti")
    return left.join(heavy, key).unionByName(few.join(light, key))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_caches: dict[str, dict] = {}


def only_cache(name: str) -> dict:
    """The cache of that name in this process; those of other operators are emptied, as Python workers outlive the stage they began with."""
    for other, held in _caches.items():
        if other != name:
            held.clear()
    return _caches.setdefault(name, {})


def trim() -> None:
    """Give freed memory back to the system, which shares it between the JVM and the Python workers of an executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it has
        pass


def trimmed(batches: Iterator) -> Iterator:
    """The batches, and ``trim`` behind the last one."""
    try:
        yield from batches
    finally:
        trim()


def let(value, body):
    """``body(x)`` with ``x`` bound once to ``value``: a lambda variable is evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; extra ones, clashing or not, never reach an operator."""
    ship(df.sparkSession)
    return df.select(*[F.col(f"`{n}`") for n in names])


def crc_mod5(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns c0, c1, ... and the new name of each old one, so that helper columns can't clash."""
    ship(docs.sparkSession)
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), {n: f"c{i}" for i, n in enumerate(docs.columns)}


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Undo ``numbered``; helper columns go."""
    return df.select(*[F.col(new).alias(old) for old, new in names.items()])
