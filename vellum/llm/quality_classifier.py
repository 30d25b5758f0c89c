"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover it from end to end. Each byte has a learned
embedding, each filter weighs the embedded bytes of a chunk; over all chunks the largest response of each filter is
kept, and a logistic layer combines these into one probability. Training backpropagates through the chunk that won
each filter's maximum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sampling import bounded_sample
from .sentencepiece_codec import slices
from .shared import crc_bucket, small_side

#: Bytes of a chunk and from one chunk's start to the next's; embedding size; filters.
WIDTH, STRIDE, EMBED, FILTERS = 16, 8, 8, 32
#: Labelled documents for training, about, and bytes of all of them together. Texts are trained on whole: the more bytes
#: they have, the fewer of them are taken.
SAMPLE_DOCS, SAMPLE_BYTES = 2000, 16 * 1024 * 1024
EPOCHS, BATCH, RATE, SEED = 10, 16, 0.01, 7
#: The byte that fills the last chunk.
PAD = 256
#: Chunks that are worked on at once.
BLOCK = 16_384


@dataclass
class ByteNet:
    embed: np.ndarray  # PAD + 1, EMBED
    filters: np.ndarray  # WIDTH * EMBED, FILTERS
    bias: np.ndarray  # FILTERS
    weight: np.ndarray  # FILTERS
    offset: np.ndarray  # 1

    @staticmethod
    def new() -> ByteNet:
        r = np.random.default_rng(SEED)
        f32 = lambda x: x.astype(np.float32)
        return ByteNet(f32(r.normal(0, 0.3, (PAD + 1, EMBED))), f32(r.normal(0, 0.12, (WIDTH * EMBED, FILTERS))), np.zeros(FILTERS, np.float32), f32(r.normal(0, 0.2, FILTERS)), np.zeros(1, np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.weight, self.offset]

    def responses(self, windows: np.ndarray) -> np.ndarray:
        """Filter responses of chunks (rows of WIDTH bytes)."""
        return self.embed[windows].reshape(len(windows), -1) @ self.filters + self.bias

    def probability(self, data: bytes) -> float:
        windows = chunks(data)
        top = np.full(FILTERS, -np.inf, np.float32)
        for k in range(0, len(windows), BLOCK):
            top = np.maximum(top, self.responses(windows[k : k + BLOCK]).max(axis=0))
        return logistic(float(np.maximum(top, 0) @ self.weight + self.offset[0]))


def logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def chunks(data: bytes) -> np.ndarray:
    """Overlapping chunks of all bytes; the last is filled up, an empty text is one chunk of filling."""
    n = max(1, -(-max(0, len(data) - WIDTH) // STRIDE) + 1)
    x = np.full((n - 1) * STRIDE + WIDTH, PAD, np.int16)
    x[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(x, WIDTH)[::STRIDE]


def train(texts: list[bytes], labels: list[int]) -> ByteNet:
    """A network fitted by Adam on the logistic loss to whole texts; the same data give the same network."""
    net, order = ByteNet.new(), np.random.default_rng(SEED)
    if len(set(labels)) < 2:  # nothing to tell apart: the smoothed share of label 1
        net.weight[:] = 0
        net.offset[:] = np.log((sum(labels) + 0.5) / (len(labels) - sum(labels) + 0.5))
        return net
    cut = [chunks(t) for t in texts]
    net.offset[:] = np.log((sum(labels) + 0.5) / (len(labels) - sum(labels) + 0.5))
    first = [np.zeros_like(a) for a in net.arrays()]
    second = [np.zeros_like(a) for a in net.arrays()]
    step, columns = 0, np.arange(FILTERS)
    for epoch in range(EPOCHS):
        shuffled = order.permutation(len(cut))
        for k in range(0, len(cut), BATCH):
            some = shuffled[k : k + BATCH]
            windows = np.concatenate([cut[i] for i in some])
            starts = np.concatenate([[0], np.cumsum([len(cut[i]) for i in some])])
            answers = net.responses(windows)
            grads = [np.zeros_like(a) for a in net.arrays()]
            for j, i in enumerate(some):
                own = answers[starts[j] : starts[j + 1]]
                best = own.argmax(axis=0)
                top = own[best, columns]
                pooled = np.maximum(top, 0)
                error = np.float32(logistic(float(pooled @ net.weight + net.offset[0])) - labels[i])
                grads[3] += error * pooled
                grads[4] += error
                back = error * net.weight * (top > 0)
                won = windows[starts[j] + best]  # FILTERS, WIDTH
                grads[1] += (net.embed[won].reshape(FILTERS, -1) * back[:, None]).T
                grads[2] += back
                np.add.at(grads[0], won, (net.filters * back).T.reshape(FILTERS, WIDTH, EMBED))
            step += 1
            rate = RATE * (1 - 0.9 * epoch / EPOCHS)
            for a, g, m, v in zip(net.arrays(), grads, first, second, strict=True):
                g /= len(some)
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                a -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def learn_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES
) -> ByteNet:
    """Trains on a bounded sample of the labelled documents, on the driver: at most 2 * sample_docs rows, whole texts, of
    ``sample_bytes`` together (or one row).

    ``labels`` has the ids that may be learned from. The ids drawn are few and broadcast; each brings its document. Rows
    are taken in the order of hashes as long as the bytes of all taken keep within the bound, whatever their lengths; of
    an id that stands on several documents as many count as the bounds allow.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("l_id")).agg(F.max(label_col).cast("int").alias("l_label"))
    drawn = small_side(bounded_sample(known, "l_id", sample_docs, "quality"), 2 * sample_docs)
    found = docs.select(F.col(id_col).alias("d_id"), F.coalesce(F.col(text_col), F.lit("")).alias("d_text")).join(drawn, F.col("d_id") == F.col("l_id"))
    hashed = found.select(F.xxhash64("d_id", F.lit("order")).alias("h"), F.xxhash64("d_text").alias("t"), "l_label", "d_text")
    few = hashed.select("h", "t", "l_label", F.octet_length("d_text").cast("long").alias("size")).orderBy("h", "t").limit(2 * sample_docs)
    taken, used = [], 0
    for r in few.collect():
        if taken and used + r.size > sample_bytes:
            break
        taken.append(r)
        used += r.size
    if not taken:
        return train([], [])
    inside = F.struct("h", "t") <= F.struct(F.lit(taken[-1].h), F.lit(taken[-1].t))
    rows = hashed.where(inside).orderBy("h", "t").limit(len(taken)).collect()
    return train([r.d_text.encode() for r in rows], [r.l_label for r in rows])


def score_quality(docs: DataFrame, net: ByteNet, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with score (probability of label 1, of the whole text) and predicted (1 if score >= threshold).

    Null texts score as empty ones. Texts of any length are scored whole, in blocks. Repeated rows and null ids are
    kept. An empty table gives no rows. Columns named score or predicted are replaced.
    """
    made = ("score", "predicted")
    base = docs.drop(*(x for x in made if x != text_col))
    at = base.columns.index(text_col)
    schema = T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, 8_000_000):
                scores = np.array([net.probability((t or "").encode()) for t in part.column(at).to_pylist()], np.float64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=[*part.schema.names, *made])

    return base.mapInArrow(run, schema)


def classify_held_out(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 0) -> DataFrame:
    """Learns from labels whose crc32(id) mod ``folds`` is not ``held`` and scores all documents; adds held_out."""
    fold = F.coalesce(crc_bucket(id_col, folds), F.lit(held))
    net = learn_quality(docs, labels.where(fold != held), id_col, text_col)
    return score_quality(docs.withColumn("held_out", fold == held), net, text_col)
