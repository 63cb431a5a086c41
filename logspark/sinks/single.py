"""One file of lines, written by all tasks.

Tasks write the lines as parts in their order; of each part the driver learns only the length, which tells its place in the
file. On a file system that all machines mount (``file:``) tasks then copy the parts to their places. Others take one writer
for a file: there the driver passes the bytes of the parts on, by pieces. A gzip file has a member for each part.
"""

from __future__ import annotations

import gzip
import re
import shutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..ship import ship

#: Bytes that are passed on at once.
_PIECE = 1 << 20


def write(lines: DataFrame, path: str, archive: bool, ended: bool) -> None:
    """Write the column ``value`` of ``lines``, in their order, as one file, whose last line has a newline at its end only if ``ended``.

    The parts lie beside the file meanwhile, in a folder of its name and ``.parts``.
    """
    spark = lines.sparkSession
    ship(spark)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.suffix(".parts")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    lines.write.option("lineSep", "\n").option("compression", "gzip" if archive else "none").text(folder.toString())
    try:
        # By the number of the task, then of its file; names sort otherwise from 100,000 tasks on.
        found = [(int(m[1]), s.getPath().getName(), s) for s in fs.listStatus(folder) if (m := re.match(r"part-([0-9]+)", s.getPath().getName())) and s.getLen()]
        parts = [(s.getPath(), s.getLen()) for _, _, s in sorted(found, key=lambda x: x[:2])]
        (_placed if fs.getUri().getScheme() == "file" else _streamed)(spark, fs, parts, at, archive, ended)
    finally:
        fs.delete(folder, True)


def _shorn(read: Callable[[int], bytes], put: Callable[[bytes], object]) -> None:
    """Pass bytes on, without a newline at their very end."""
    held = b""
    while piece := read(_PIECE):
        put(held)
        held = bytes(piece)
    put(held.removesuffix(b"\n"))


def _placed(spark: SparkSession, fs, parts: list, at, archive: bool, ended: bool) -> None:
    path, pieces, place = at.toUri().getPath(), [], 0
    for part, size in parts:
        pieces.append((part.toUri().getPath(), place, not ended and len(pieces) == len(parts) - 1))
        place += size
    with open(path, "xb"):
        pass

    def copy(piece: tuple[str, int, bool]) -> None:
        """A repeated task writes the same bytes to the same place."""
        part, start, last = piece
        with open(part, "rb") as source, open(path, "r+b") as target:
            target.seek(start)
            if not last:
                shutil.copyfileobj(source, target, _PIECE)
            elif archive:
                with gzip.GzipFile(fileobj=source) as inside, gzip.GzipFile("", "wb", 6, target, 0) as member:
                    _shorn(inside.read, member.write)
            else:
                _shorn(source.read, target.write)

    if pieces:
        spark.sparkContext.parallelize(pieces, len(pieces)).foreach(copy)


def _streamed(spark: SparkSession, fs, parts: list, at, archive: bool, ended: bool) -> None:
    jvm = spark.sparkContext._jvm
    target = fs.create(at, False)
    try:
        for i, (part, _) in enumerate(parts):
            source = fs.open(part)
            try:
                if ended or i < len(parts) - 1:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, target, _PIECE, False)
                elif archive:
                    member = jvm.java.util.zip.GZIPOutputStream(target)
                    _shorn(jvm.java.util.zip.GZIPInputStream(source).readNBytes, member.write)
                    member.finish()
                else:
                    _shorn(source.readNBytes, target.write)
            finally:
                source.close()
    finally:
        target.close()
