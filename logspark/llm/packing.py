"""Best-fit packing of tokenised documents with certified bin counts.

Pieces of at most one sequence's length are dealt into partitions of a fixed number of pieces, and each partition is
packed by best fit decreasing. A lower bound from dual feasible functions certifies each partition's bin count; both are
kept with its pieces, and ``certificate`` compares the whole packing with the bound of all pieces. Partitions give the documents of their loosest sequences, the more the wider their gap, to a common pool,
which is dealt anew and packed again; what the pool leaves open goes on to the next round, until one partition holds
the pool.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, only, trimmed
from .tokenize import load

CAPACITY = 4096
#: Pieces of one packing partition.
GROUP_PIECES = 40_000
ROUNDS = 6


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    encode = load(tokenizer).ids
    end = np.array([end_id], dtype="<u4").tobytes()
    row = TaskContext.get().partitionId() << 36
    for batch in batches:
        out: list[list] = [[], [], [], [], [], []]
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for k, doc_id in enumerate(ids):
            data = encode(texts[k].as_py() or "") + end
            n = len(data) // 4
            for piece, start in enumerate(range(0, n, capacity)):
                part = data[4 * start : 4 * (start + capacity)]
                for col, value in zip(out, (row, doc_id, piece, start, len(part) // 4, zlib.crc32(part)), strict=True):
                    col.append(value)
                row += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int64()), pa.array(out[1], batch.schema.field(0).type), pa.array(out[2], pa.int32()), *[pa.array(x, pa.int64()) for x in out[3:]]],
            names=["row", "doc_id", "piece", "start", "length", "ids_crc32"],
        )


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32) of every document; ``row`` is a number of the piece."""
    base = only(docs, id_col, text_col).toDF("doc_id", "text")
    kind = dict(docs.dtypes)[id_col]
    return base.mapInArrow(lambda it: trimmed(_pieces(it, tokenizer, end_id, capacity)), f"row long, doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of three families of dual feasible functions: whole size, threshold (one for each length) and rounding."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1), capacity) if len(lengths) else 0


def bound_of_counts(count: np.ndarray, capacity: int) -> int:
    """``lower_bound`` from the number of pieces of each length."""
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    total, words = np.cumsum(count), np.cumsum(count * size)
    # Threshold e: what is above capacity - e fills a bin alone, what is below e is left out.
    e = np.arange(1, capacity // 2 + 1)
    alone = total[capacity] - total[capacity - e]
    kept = words[capacity - e] - words[e - 1]
    best = max(best, int((alone + -(-kept // capacity)).max()))
    # At most one piece above half fits a bin; the rest of those bins takes what of the others it can.
    half = capacity // 2
    wide = total[capacity] - total[half]
    wide_room = (total[capacity - e] - total[half]) * capacity - (words[capacity - e] - words[half])
    rest = words[half] - words[e - 1] - wide_room
    best = max(best, int((wide + np.maximum(0, -(-rest // capacity))).max()))
    # Rounding by k: (k + 1) x / C as a share of k, unless it is whole.
    for k in range(1, 21):
        scaled = (k + 1) * size
        share = np.where(scaled % capacity == 0, size * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((count * share).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best fit in the given order: each piece's bin and its place there, and the number of bins."""
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    have, used = 0, 0  # bit r of have: some bin has r free
    for i, n in enumerate(lengths.tolist()):
        fits = have >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                have ^= 1 << r
        else:
            r, b = capacity, used
            used += 1
        bins[i], offsets[i] = b, capacity - r
        if left := r - n:
            free[left].append(b)
            have |= 1 << left
    return bins, offsets, used


def _pack(pdf: pd.DataFrame, capacity: int, tag: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "row"], ascending=[False, True], kind="stable")
    lengths = pdf["length"].to_numpy()
    bins, offsets, used = best_fit(lengths, capacity)
    # Beside the certified gap there is what rounding up to whole sequences leaves open in each partition.
    gap = used - lower_bound(lengths, capacity)
    fill = np.bincount(bins, weights=lengths, minlength=used)
    loose = np.argsort(fill, kind="stable")
    loose = loose[fill[loose] < 0.99 * capacity]
    give = np.zeros(used, dtype=bool)
    give[loose[: 8 + 4 * gap]] = True
    group = int(pdf["g"].iloc[0])
    return pd.DataFrame({
        "row": pdf["row"], "length": lengths, "sequence_id": (tag << 56) + (group << 24) + bins, "offset": offsets,
        "given": give[bins], "bins": used, "bound": used - gap,
    })


def _packer(capacity: int, tag: int):
    return lambda pdf: _pack(pdf, capacity, tag)


def assign(lengths: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """(row, length) in; (row, sequence_id, offset, partition_bins, partition_bound) out, one row per piece.

    The last two are of the partition that packed the piece: its sequences, before it gave any away, and their lower
    bound. A partition with as many sequences as its bound is packed best. Rounds end when one partition holds the pool,
    or after ``rounds``: each leaves some sequences of a partition open, whatever the partition's size.
    """
    pool, done = lengths, []
    own = ["row", "sequence_id", "offset", F.col("bins").alias("partition_bins"), F.col("bound").alias("partition_bound")]
    for tag in range(rounds):
        n = pool.count()
        if tag and not n:
            break
        groups = max(1, -(-n // (group_pieces << tag)))  # the pool is smaller than what it came from: its partitions can be larger
        dealt = pool.withColumn("g", F.pmod(F.xxhash64(F.lit(tag), "row"), F.lit(groups)))
        packed = dealt.groupBy("g").applyInPandas(_packer(capacity, tag), "row long, length long, sequence_id long, offset long, given boolean, bins long, bound long")
        packed = materialise(packed, "packed")
        if groups == 1 or tag == rounds - 1:  # one partition has nobody to exchange with
            done.append(packed.select(*own))
            break
        done.append(packed.filter("not given").select(*own))
        pool = packed.filter("given").select("row", "length")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """(sequences of the packing, lower bound for any packing of its pieces), from counts by length."""
    count = np.zeros(capacity + 1, dtype=np.int64)
    for r in packed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # one row a length
        count[r["length"]] = r["n"]
    return packed.agg(F.count_distinct("sequence_id")).first()[0], bound_of_counts(count, capacity)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, partition_bins, partition_bound.

    A document is its ids and ``end_id``; only one longer than ``capacity`` is cut, into pieces of that length and a
    last shorter one. Null texts count as empty (one token). Repeated rows are packed each for itself; null ids stay
    null. An empty table gives an empty result. Other columns are ignored.
    """
    parts = materialise(pieces(docs, tokenizer, end_id, capacity, id_col, text_col), "pieces")
    places = assign(parts.select("row", "length"), capacity, group_pieces)
    return parts.join(places, "row").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "partition_bins", "partition_bound")
