"""Quality score by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are read whole, in overlapping chunks. Learned filters slide over byte embeddings; each filter is
rectified and max-pooled within a chunk. The chunks' maxima are averaged and maximised over the text, and a logistic
layer combines them into one probability. Training is plain back-propagation with Adam on the driver, over a bounded
sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import crc_mod5, only

#: Labelled rows that the network is fitted on, and the most bytes that one of them gives.
SAMPLE_ROWS = 2_500
SLICE_BYTES = 4_096
CHUNK, OVERLAP, WIDTH, STRIDE = 512, 64, 8, 4
EMBED, FILTERS, EPOCHS = 8, 24, 12
PREDICT_AT = 0.3
_NOTHING = np.zeros(0, dtype=np.uint8)


def _windows(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of all windows, and where each chunk's windows begin among them; chunks overlap and cover the text."""
    n = max(1, -(-(len(data) - OVERLAP) // (CHUNK - OVERLAP)))
    starts = np.arange(n) * (CHUNK - OVERLAP)
    per = (np.minimum(CHUNK, np.maximum(len(data) - starts, 1)) + STRIDE - 1) // STRIDE
    first = np.concatenate(([0], np.cumsum(per)[:-1]))
    at = np.repeat(starts, per) + STRIDE * (np.arange(per.sum()) - np.repeat(first, per))
    return at, first


class Network:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.filters = rng.normal(0, 1 / np.sqrt(WIDTH * EMBED), (WIDTH, EMBED, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, dtype=np.float32)
        self.out = np.zeros(2 * FILTERS, dtype=np.float32)
        self.out_bias = np.zeros(1, dtype=np.float32)

    def params(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out, self.out_bias]

    def responses(self, padded: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Filter responses of the windows; a filter tap on a byte is a row of a small table."""
        z = np.tile(self.bias, (len(at), 1))
        for k in range(WIDTH):
            z += (self.embed @ self.filters[k]).take(padded[at + k], axis=0)
        return z

    def pooled(self, data: np.ndarray, after: np.ndarray = _NOTHING) -> tuple[np.ndarray, ...]:
        """Maxima of the chunks of ``data``, and what they are made of; ``after``: the bytes that follow, seen by the last windows only."""
        at, first = _windows(data)
        padded = np.concatenate((data, after, np.zeros(WIDTH + STRIDE, dtype=np.uint8)))
        at = np.minimum(at, len(data))
        z = self.responses(padded, at)
        return np.maximum(np.maximum.reduceat(z, first, axis=0), 0), z, at, first, padded

    def score(self, text: str | None) -> float:
        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
        # Long texts go through in parts of whole chunks, so that each chunk sees what it would in one piece.
        step = 512 * (CHUNK - OVERLAP)
        total, most, chunks = np.zeros(FILTERS, dtype=np.float64), np.zeros(FILTERS, dtype=np.float32), 0
        for start in range(0, max(1, len(data) - OVERLAP), step):
            end = start + step + OVERLAP
            pool = self.pooled(data[start:end], data[end : end + WIDTH])[0]
            total += pool.sum(axis=0)
            most = np.maximum(most, pool.max(axis=0))
            chunks += len(pool)
        logit = float(np.concatenate((total / chunks, most)) @ self.out + self.out_bias[0])
        return 1.0 / (1.0 + np.exp(-np.clip(logit, -30, 30)))


def train(rows: list[tuple[bytes, int]], epochs: int = EPOCHS, seed: int = 11) -> Network:
    """Fit on (bytes, label) rows: cross entropy, Adam, gradients only through each chunk's maxima."""
    net = Network(seed)
    if not rows:
        return net
    rng = np.random.default_rng(seed)
    share = np.clip(np.mean([y for _, y in rows]), 0.01, 0.99)
    net.out_bias[0] = np.log(share / (1 - share))
    datas = [np.frombuffer(d, dtype=np.uint8) for d, _ in rows]
    mean, square, step = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()], 0
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 32):
            grads = [np.zeros_like(p) for p in net.params()]
            batch = order[lo : lo + 32]
            for i in batch.tolist():
                _, z, at, first, padded = net.pooled(datas[i])
                peak = np.maximum.reduceat(z, first, axis=0)
                pool = np.maximum(peak, 0)
                top = pool.argmax(axis=0)
                feats = np.concatenate((pool.mean(axis=0), pool.max(axis=0)))
                p = 1 / (1 + np.exp(-np.clip(feats @ net.out + net.out_bias[0], -30, 30)))
                g = np.float32(p - rows[i][1])
                grads[3] += g * feats
                grads[4] += g
                d_pool = np.repeat((g * net.out[:FILTERS] / len(pool))[None, :], len(pool), axis=0)
                d_pool[top, np.arange(FILTERS)] += g * net.out[FILTERS:]
                d_pool *= peak > 0
                # The window of each chunk's and filter's maximum.
                ends = np.append(first[1:], len(at))
                where = np.empty(peak.shape, dtype=np.int64)
                for c in range(len(first)):
                    where[c] = first[c] + z[first[c] : ends[c]].argmax(axis=0)
                win = at[where]
                grads[2] += d_pool.sum(axis=0)
                for k in range(WIDTH):
                    octets = padded[win + k]
                    grads[1][k] += np.einsum("cfe,cf->ef", net.embed[octets], d_pool)
                    np.add.at(grads[0], octets.ravel(), (d_pool[:, :, None] * net.filters[k].T[None]).reshape(-1, EMBED))
            step += 1
            rate = 0.02 * (1 - 0.9 * epoch / epochs)
            for j, (p, g) in enumerate(zip(net.params(), grads, strict=True)):
                g = g / len(batch) + 1e-4 * p
                mean[j] = 0.9 * mean[j] + 0.1 * g
                square[j] = 0.99 * square[j] + 0.01 * g * g
                p -= (rate * (mean[j] / (1 - 0.9**step)) / (np.sqrt(square[j] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS, seed: int = 3) -> list[tuple[bytes, int]]:
    """At most ``rows`` distinct labels, those with the least hashes, with at most SLICE_BYTES of each text: (bytes, label).

    Repeated labels and documents count once; a document with both labels gives both.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("label is not null and id is not null")
    known = known.filter(crc_mod5("id") != 0).withColumn("h", F.xxhash64(F.lit(seed), "id", "label"))
    n = known.agg(F.approx_count_distinct("h")).first()[0]
    if not n:
        return []
    # Twice the share that is needed, so that the estimate can't leave too few; the least hashes of those stay.
    scale = 1 << 30
    some = known.filter(F.pmod("h", F.lit(scale)) < min(scale, 2 * scale * rows // n + 1)).distinct()
    order = [F.pmod("h", F.lit(scale)), "h", "id", "label"]
    chosen = spark.createDataFrame(some.orderBy(*order).limit(rows).collect(), some.schema)
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    start = F.pmod(F.xxhash64(text_col), F.greatest(F.lit(1), F.length(data) - SLICE_BYTES + 1)).cast("int") + 1
    slices = docs.select(F.col(id_col).alias("id"), F.substring(data, start, F.lit(SLICE_BYTES)).alias("data"))
    got = slices.join(F.broadcast(chosen), "id").select("h", "id", "label", "data").distinct()
    # An id may stand for many texts: as many rows as labels stay, the first text of each label before any second one.
    nth = F.row_number().over(Window.partitionBy("id", "label").orderBy(F.xxhash64("data"), "data"))
    got = got.withColumn("nth", nth).orderBy("nth", *order, F.xxhash64("data")).limit(rows).collect()
    return [(bytes(r["data"]), r["label"]) for r in sorted(got, key=lambda r: (str(r["id"]), r["label"], bytes(r["data"])))]


def _score(batches: Iterator[pa.RecordBatch], weights: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    net = Network()
    net.embed, net.filters, net.bias, net.out, net.out_bias = weights
    for batch in batches:
        score = np.array([net.score(t.as_py()) for t in batch.column(2)], dtype=np.float64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= PREDICT_AT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
        )


def held_out(id_col: str = "doc_id") -> Column:
    return crc_mod5(id_col) == 0


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (likelihood of label 1), predicted (score >= 0.3).

    Labels of held-out rows are never read. Null texts count as empty; empty texts have the score of a chunk of zeros.
    Repeated rows stay and score alike. Null ids are scored; labels without an id or a value are passed over. Without
    labels all scores are equal. An empty table gives an empty result. Other columns are ignored.
    """
    weights = train(sample(docs, labels, id_col, text_col, label_col)).params()
    base = only(docs, id_col, text_col).toDF("doc_id", "text").select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return base.mapInArrow(lambda it: _score(it, weights), f"doc_id {dict(docs.dtypes)[id_col]}, held_out boolean, score double, predicted int")
