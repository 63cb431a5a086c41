"""The files of the queries over single files: their bytes, and who writes them."""

import gzip
import uuid
from urllib.parse import urlparse

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark import queries as core
from logspark.sinks import single

NAMES = ("ranged.log", "open.log", "one.log.gz")


@pytest.fixture
def parted(spark):
    """Small tables make several parts, too."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture
def events(parted, tmp_path):
    """A folder with a table of 500 events, out of order, and the lines that they make."""
    rows = parted.range(500).select(
        F.col("id").alias("event_id"), (F.lit("2024-01-04 12:00:00").cast("timestamp") + F.make_dt_interval(hours=F.col("id"))).alias("ts"), (F.col("id") % 7).alias("user_id"),
        F.when(F.col("id") % 3 == 0, "click").otherwise("näher").alias("event_type"), (F.col("id") / 8).alias("value"),
    )
    rows.orderBy(F.xxhash64("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path), [r[0] for r in rows.orderBy("event_id").select(core._logfmt()).collect()]


def written(folder, name):
    with (gzip.open if name.endswith(".gz") else open)(f"{urlparse(folder).path}/{name}", "rb") as f:
        return f.read().decode()


@pytest.mark.parametrize("name", NAMES)
def test_written_by_tasks(parted, events, monkeypatch, name):
    """The driver gets no line, and the file has all of them in order."""

    def refuse(self, *args, **kwargs):
        raise AssertionError("lines go to the driver")

    for way in ("toLocalIterator", "collect", "toPandas", "toArrow", "take", "tail"):
        monkeypatch.setattr(DataFrame, way, refuse)
        monkeypatch.setattr(type(parted.range(0)), way, refuse)
    folder = core._single(parted, events[0], name, name.endswith(".gz"))
    assert written(folder, name) == "\n".join(events[1]) + ("\n" if name == "ranged.log" else "")


@pytest.mark.parametrize("name", NAMES)
def test_store(parted, tmp_path, name):
    """A file system where a file has one writer gives the same bytes."""
    (tmp_path / "store").mkdir()
    store = f"store{uuid.uuid4().hex}"  # another one each time: Hadoop keeps what it has opened
    parted.sparkContext._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{store}.link./out", f"file://{tmp_path}/store")
    lines = parted.range(0, 1000, 1, 4).select(F.format_string("line %s", "id").alias("value"))
    archive, ended = name.endswith(".gz"), name == "ranged.log"
    single.write(lines, f"viewfs://{store}/out/{name}", archive, ended)
    single.write(lines, f"file://{tmp_path}/{name}", archive, ended)
    text = "\n".join(f"line {i}" for i in range(1000)) + ("\n" if ended else "")
    assert written(f"{tmp_path}/store", name) == written(str(tmp_path), name) == text
    assert not list(tmp_path.rglob("*.parts"))


@pytest.mark.parametrize("name", NAMES)
def test_no_lines(parted, tmp_path, name):
    lines = parted.range(0).select(F.lit("x").alias("value"))
    single.write(lines, f"file://{tmp_path}/{name}", name.endswith(".gz"), False)
    assert written(str(tmp_path), name) == ""
