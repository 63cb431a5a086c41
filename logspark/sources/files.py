"""Files of lines, plain or gzip, and the output of commands."""

from __future__ import annotations

import atexit
import os
import subprocess
import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SourceError
from . import formats
from .timestamps import FORMATS, first_epoch, fixed_epoch

ARCHIVES = (".gz", ".gzip")
_HEAD = 1000
#: Bytes of a file that are looked at on the driver, and of a command's output that are passed on at once.
_PEEK = 1 << 18


def is_archive(path: str) -> bool:
    return path.endswith(ARCHIVES)


def located(path: str, base: str | None) -> str:
    """Paths are relative to ``base``, or to the working directory of the driver; a path with a scheme stays."""
    if "://" in path:
        return path
    path = path.replace("\\", "/")
    if base and "://" in base:
        return path if path.startswith("/") else f"{base.rstrip('/')}/{path}"
    return "file://" + os.path.abspath(os.path.join(base or ".", path))


def _found(spark: SparkSession, path: str):
    """(file system, path) of something that exists."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise SourceError(f"can't open {path}")
    return fs, at


def _read(spark: SparkSession, fs, at, start: int, size: int) -> bytes:
    stream = fs.open(at)
    try:
        stream.seek(start)
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size))
    finally:
        stream.close()


def _open_tail(spark: SparkSession, path: str) -> bool:
    """Whether nothing ends the last line of a plain file: its last byte tells."""
    fs, at = _found(spark, path)
    status = fs.getFileStatus(at)
    return not status.isDirectory() and status.getLen() > 0 and _read(spark, fs, at, status.getLen() - 1, 1) != b"\n"


def head(spark: SparkSession, path: str) -> tuple[list[str], bool]:
    """(lines at the start of a file or of a folder's first one, whether those are all lines), read on the driver: a bounded number of bytes."""
    fs, at = _found(spark, path)
    whole = True
    if fs.getFileStatus(at).isDirectory():
        inside = sorted((s.getPath().getName(), s) for s in fs.listStatus(at) if s.isFile() and s.getPath().getName()[0] not in "._")
        if not inside:
            return [], False
        whole, at = len(inside) == 1, inside[0][1].getPath()
    size = fs.getFileStatus(at).getLen()
    data = _read(spark, fs, at, 0, min(size, _PEEK)) if size else b""
    whole = whole and size <= _PEEK
    if is_archive(at.getName()):
        data, whole = zlib.decompressobj(31).decompress(data, _PEEK), False
    lines = data.decode("utf-8", "replace").split("\n")
    lines.pop()  # cut off, or never ended
    return lines, whole


def lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line in a column ``value``. A carriage return stays. A last line that nothing ends is dropped from a plain file, not from an archive."""
    _found(spark, path)
    df = spark.read.option("lineSep", "\n").text(path)
    if is_archive(path) or not _open_tail(spark, path):
        return df
    # Numbers grow along a file: the last line has the greatest.
    numbered = df.withColumn("n", F.monotonically_increasing_id())
    return numbered.filter(F.col("n") != F.lit(numbered.agg(F.max("n")).first()[0])).select("value")


def detect(df: DataFrame, path: str) -> formats.Format | None:
    """The format of the first line that has one: looked for in the head, then anywhere."""
    start, whole = head(df.sparkSession, path)
    for line in start:
        if fmt := formats.detect(line):
            return fmt
    if whole:
        return None
    first = [r["value"] for r in df.limit(_HEAD).collect()]
    for line in first:
        if fmt := formats.detect(line):
            return fmt
    if len(first) < _HEAD:
        return None

    @F.pandas_udf("boolean")
    def any_format(values):
        return values.map(lambda v: formats.detect(v) is not None)

    first = df.filter(any_format("value")).limit(1).collect()
    return formats.detect(first[0]["value"]) if first else None


def session_epoch(stamp: str):
    return F.unix_timestamp(F.to_timestamp(F.lit(stamp), "yyyy-MM-dd'T'HH:mm:ss"))


def in_range(df: DataFrame, path: str, fmt: formats.Format | None, time_format: str | None, start: str | None, end: str | None, seconds: int | None) -> DataFrame:
    """Lines whose first timestamp lies in the range, both ends included; lines without one are outside.

    Where the format puts a timestamp at a fixed place, nothing stands before it, and it is read there; only lines without
    one there are searched.
    """
    kind = time_format or (fmt and fmt.time_format)
    if kind is None:
        raise SourceError(f"can't pull timestamp from file at {path}")
    low = session_epoch(start) if start else None
    high = session_epoch(start) + seconds if start and seconds is not None else session_epoch(end) if end else None

    def inside(at: Column) -> Column:
        keep = at.isNotNull()
        if low is not None:
            keep = keep & (at >= low)
        if high is not None:
            keep = keep & (at <= high)
        return keep

    place = fmt.time_place if fmt else None
    searched = inside(first_epoch(F.col("value"), kind))
    if place is None or kind != fmt.time_format:
        return df.filter(searched)
    here = F.substring("value", place, FORMATS[kind][2])
    return df.filter(F.when(here.rlike(rf"\A{FORMATS[kind][0]}\z"), inside(fixed_epoch(here, kind))).otherwise(searched))


#: The most bytes of an unfinished command's error messages that are kept.
_MESSAGES = 2000


def command_lines(spark: SparkSession, command: str) -> DataFrame:
    """Run a shell command on the driver; its output lines, the last one whether ended or not. A failure raises with the end of its messages.

    The output is passed on by pieces to a file that executors reach (in ``spark.checkpoint.dir``, or a temporary folder in
    local mode), so none of it stays on the driver. The file goes when the driver ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise SourceError("STREAM needs spark.checkpoint.dir: a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="logspark-command-")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{root}/command-{uuid.uuid4().hex}/output.txt")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    with tempfile.TemporaryFile() as messages:
        out = fs.create(at)
        try:
            process = subprocess.Popen(["/bin/sh", "-c", command], stdout=subprocess.PIPE, stderr=messages)
            while piece := process.stdout.read(_PEEK):
                out.write(piece)
            code = process.wait()
        finally:
            out.close()
        if code:
            messages.seek(max(0, messages.seek(0, os.SEEK_END) - _MESSAGES))
            fs.delete(at.getParent(), True)
            raise SourceError(f"command failed with {code}: {messages.read().decode('utf-8', 'replace')}")
    atexit.register(drop, fs, at.getParent())
    return spark.read.option("lineSep", "\n").text(at.toString())


def drop(fs, at) -> None:
    """Delete a folder, if its session still lives."""
    try:
        fs.delete(at, True)
    except Exception:  # the session is gone
        pass
