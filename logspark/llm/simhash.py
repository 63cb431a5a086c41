"""SimHash near-duplicates through segment popcounts.

A 64-bit fingerprint is mapped to 32 counts, the set bits of each 2-bit segment. The Manhattan distance of two such
vectors never exceeds the Hamming distance of the fingerprints, so a range join on the vectors finds every link and
an exact comparison drops the rest.

The range join is a grid join: the 32 coordinates are dealt into G groups. Within a Manhattan distance of r at most
r groups differ, so any linked pair agrees on some G - r groups, and meets in the grid cell of that choice of
groups. G follows the number of fingerprints, so that a cell holds a few of them at any scale. Within a cell, rows
are compared in place: pairs are never emitted, only the edges of a star per local component. A cell with more than
``CELL_LIMIT`` fingerprints is not compared pair by pair: its members go to an exact meeting-point join, where every
fingerprint is sent to all words within r/2 bits of it; two fingerprints within r bits share one of those words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, numbered, only, partitions, renamed, spread_join
from .graph import components

#: Fingerprints of one cell that a task compares in place.
CELL_LIMIT = 20_000
_PLAIN = 12  # cells up to this size are compared by shifting


def _spread() -> np.ndarray:
    """For each byte, its eight bits in eight byte lanes of a word."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view(np.uint64).ravel()


def fingerprints_of(texts: list[str | None], shingle: int = 4, seed: int = 42) -> np.ndarray:
    """Unsigned 64-bit fingerprints; zero for a text without words."""
    import xxhash

    h64, hashes, counts = xxhash.xxh64_intdigest, [], np.zeros(len(texts), dtype=np.int64)
    for k, text in enumerate(texts):
        words = text.encode("utf-8").lower().split() if text else []  # bytes: only A-Z fold, only ASCII blanks part words
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= shingle:
            hashes.append(h64(joined, seed))
            counts[k] = 1
            continue
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        n = len(words) - shingle + 1
        hashes += [h64(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
        counts[k] = n
    out = np.zeros(len(texts), dtype=np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    octets = np.array(hashes, dtype=np.uint64).view(np.uint8).reshape(-1, 8)
    # Byte lanes hold up to 255: sum runs of at most 255 shingles in one word for each octet, then the runs of a text.
    n = counts[some]
    runs = (n + 254) // 255
    first_run = np.concatenate(([0], np.cumsum(runs)[:-1]))
    offset = np.concatenate(([0], np.cumsum(n)[:-1]))
    run_at = np.repeat(offset, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first_run, runs))
    spread = _spread()
    lanes = np.stack([np.add.reduceat(spread[octets[:, k]], run_at) for k in range(8)], axis=1)
    ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 64).astype(np.int64), first_run, axis=0)
    bits = (2 * ones > n[:, None]).astype(np.uint8)
    out[some] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            fp = fingerprints_of(part.column(2).to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fp.view(np.int64))], names=["doc_id", "h", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, h, fp long): one row per row of ``docs``; h is a hash of the text, which tells apart rows with one id."""
    base = only(docs, id_col, text_col).toDF("doc_id", "text").select("doc_id", text_hash("text").alias("h"), "text")
    return base.mapInArrow(lambda it: _fingerprint(it, shingle), f"doc_id {dict(docs.dtypes)[id_col]}, h long, fp long")


def text_hash(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def segment_counts(fp: np.ndarray) -> np.ndarray:
    """The 32 two-bit popcounts of each word, packed in place."""
    return fp - ((fp >> np.uint64(1)) & np.uint64(0x5555555555555555))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of packed counts (lanes hold 0, 1 or 2, so one lane's difference is its unary code's Hamming distance)."""
    low = np.uint64(0x5555555555555555)
    unary = lambda v: v | ((v >> np.uint64(1)) & low)  # noqa: E731  0, 1, 2 become 00, 01, 11
    return np.bitwise_count(unary(a) ^ unary(b))


def grid(n: int, radius: int) -> tuple[int, list[int]]:
    """(groups, a mask for each choice of groups): the more fingerprints, the more coordinates a cell fixes."""
    groups = radius + 2
    while n > 40 * 2.0 ** (1.5 * 32 * (groups - radius) / groups) and groups < radius + 6:
        groups += 1
    own = [sum(3 << (2 * c) for c in range(32) if c % groups == g) for g in range(groups)]
    return groups, [sum(own[g] for g in pick) for pick in combinations(range(groups), groups - radius)]


def _star(fps: np.ndarray, radius: int) -> tuple[list, list]:
    """Edges (member, root) that connect what is linked within one cell; a visited row is never compared again."""
    left, u, v = np.unique(fps), [], []
    while len(left) > 1:
        root, front, left = left[0], [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                new = left[near]
                left = left[~near]
                front += list(new)
                u += new.tolist()
                v += [root] * len(new)
    return u, v


def _cells(batches: Iterator[pa.RecordBatch], radius: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Links within the cells of a sorted partition: (u, v); a row of a cell beyond the limit comes back as (u, null)."""

    def edges(u, v) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    def close(fps: list[np.ndarray]) -> pa.RecordBatch:
        u, v = _star(np.concatenate(fps), radius)
        return edges(np.array(u, dtype=np.uint64).view(np.int64), np.array(v, dtype=np.uint64).view(np.int64))

    open_key, open_fps, held, over = None, [], 0, False
    for batch in batches:
        if not batch.num_rows:
            continue
        pick, cell = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        fp = batch.column(2).to_numpy().view(np.uint64)
        starts = np.concatenate(([0], np.flatnonzero((pick[1:] != pick[:-1]) | (cell[1:] != cell[:-1])) + 1))
        ends = np.append(starts[1:], len(fp))
        # The first run may continue the cell that the last batch left open; the last run stays open.
        if open_key == (pick[0], cell[0]):
            lo = 1
            run = fp[: ends[0]]
            if over:
                yield edges(run.view(np.int64), [None] * len(run))
            else:
                open_fps.append(run)
                held += len(run)
                if held > limit:
                    yield edges(np.concatenate(open_fps).view(np.int64), [None] * held)
                    open_fps, over = [], True
            if len(starts) == 1:
                continue
        else:
            lo = 0
        if open_fps and held > 1:
            yield close(open_fps)
        last = len(starts) - 1
        open_key, over = (pick[-1], cell[-1]), False
        open_fps = [fp[starts[last] :].copy()]
        held = len(open_fps[0])
        if held > limit:
            yield edges(open_fps[0].view(np.int64), [None] * held)
            open_fps, over = [], True
        size = (ends - starts)[lo:last]
        small = (size > 1) & (size <= _PLAIN)
        if small.any():
            s, n = starts[lo:last][small], size[small]
            run = np.repeat(np.arange(len(n)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(s, n)
            x = fp[at]
            counts = segment_counts(x)
            us, vs = [], []
            for d in range(1, int(n.max())):
                pair = np.flatnonzero(run[d:] == run[:-d])
                pair = pair[manhattan(counts[pair], counts[pair + d]) <= radius]
                pair = pair[np.bitwise_count(x[pair] ^ x[pair + d]) <= radius]
                us.append(x[pair])
                vs.append(x[pair + d])
            yield edges(np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64))
        for k in np.flatnonzero(size > _PLAIN).tolist():
            run = fp[starts[lo + k] : ends[lo + k]]
            yield close([run]) if len(run) <= limit else edges(run.view(np.int64), [None] * len(run))
    if open_fps and held > 1:
        yield close(open_fps)


def links(fps: DataFrame, radius: int = 4, limit: int = CELL_LIMIT) -> DataFrame:
    """(u, v): edges that connect exactly the distinct ``fp`` within ``radius`` bits of each other, by way of others or not."""
    spark = fps.sparkSession
    _, masks = grid(fps.count(), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    # segment_counts() in SQL, by halves: a 64-bit subtraction could overflow under ANSI rules.
    high = F.expr("((shiftrightunsigned(fp, 32) & 4294967295L) - (shiftrightunsigned(fp, 33) & 1431655765L))")
    low = F.expr("((fp & 4294967295L) - (shiftrightunsigned(fp, 1) & 1431655765L))")
    vector = F.shiftleft(high, 32).bitwiseOR(low)
    cells = fps.select(
        "fp", F.posexplode(F.array(*[vector.bitwiseAND(F.lit(m)) for m in signed])).alias("pick", "cell")
    ).select("pick", "cell", "fp")
    dealt = cells.repartition(partitions(spark), "pick", "cell").sortWithinPartitions("cell", "pick")
    found = materialise(dealt.mapInArrow(lambda it: _cells(it, radius, limit), "u long, v long"), "cell-links")
    exact = found.filter("v is not null").distinct()
    over = found.filter("v is null").select("u").distinct()
    if not over.isEmpty():
        flips = [0] + [sum(1 << b for b in pick) for k in range(1, radius // 2 + 1) for pick in combinations(range(64), k)]
        masks = F.split(F.lit(",".join(str(m - (1 << 64) if m >> 63 else m) for m in flips)), ",").cast("array<bigint>")
        points = over.select("u", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("u")))).alias("z"))
        least = points.groupBy("z").agg(F.min("u").alias("v"), F.max("u").alias("w")).filter("v <> w").select("z", "v")
        exact = exact.unionByName(points.join(least, "z").filter("u <> v").select("u", "v")).distinct()
    return exact


def _classes(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, h, fp), and (fp, root, least, n) for each distinct fingerprint; least: the least of its n rows, null ids last."""
    if radius % 2 or radius < 2:
        raise ValueError("radius must be even and at least 2")
    rows = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    nodes = materialise(rows.groupBy("fp").agg(F.min(row).alias("least"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    roots = components(links(nodes.select("fp"), radius, limit))
    member = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    return rows, materialise(member, "fingerprint-roots")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, limit: int = CELL_LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable).

    Null and blank texts have fingerprint zero and are linked like any other. Texts shorter than a shingle are one
    shingle. Repeated rows stay. Null ids take part; a component of null ids alone has a null id. An empty table gives
    an empty result. Other columns are ignored. ``radius`` is even.
    """
    rows, member = _classes(docs, id_col, text_col, shingle, radius, limit)
    least = materialise(member.groupBy("root").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("nodes")), "component-names")
    named = spread_join(member, least, "root", "nodes", member.count()).select("fp", "n", F.col("first.doc_id").alias("component_id"))
    named = materialise(named, "fingerprint-names")
    return spread_join(rows, named, "fp", "n", rows.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, limit: int = CELL_LIMIT) -> DataFrame:
    """One document of each component stays, the one with the least id, with all its columns; of repeated rows one stays."""
    return keep_first(docs, _classes(docs, id_col, text_col, shingle, radius, limit)[1], id_col, text_col)


def keep_first(docs: DataFrame, member: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that are the least of a root in ``member`` (least, root), all columns; of repeated rows one."""
    key = lambda c: F.when(c.isNull(), "n").otherwise(F.concat(F.lit("i"), c.cast("string")))  # noqa: E731  a null-safe key that is plain equality
    first = member.groupBy("root").agg(F.min("least").alias("first"))
    stay = first.select(key(F.col("first.doc_id")).alias("__id"), F.col("first.h").alias("__h"))
    plain, names = numbered(docs)
    own = plain.withColumn("__id", key(F.col(names[id_col]))).withColumn("__h", text_hash(names[text_col]))
    return renamed(own.join(stay, ["__id", "__h"], "left_semi").dropDuplicates(["__id", "__h"]), names)
