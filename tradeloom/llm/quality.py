"""Quality score from a small byte-level convolutional network in numpy.

A text is read as UTF-8 bytes. Learned filters of eight bytes move over it in
steps of four; each filter's largest response is taken in overlapping chunks of
256 bytes that cover the whole text, and the chunks' responses are averaged and
combined into one probability.

The network is fitted on the whole texts of a bounded sample of labelled rows
(``Settings``), which wait in a file of the driver until a step needs them; fitting
and scoring read every byte of their texts. Null texts count
as empty; an empty text has one chunk of padding, so it has a score too. A
column named like the score column is replaced. An empty table gives no rows.
Where the sample lacks one label, every text gets (n1 + 1) / (n + 2), n1 of the n
labels being 1: a half if there are none.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeloom.llm.common import nullable, small_batches

#: Half a chunk: responses are pooled over blocks, and two neighbouring blocks make a chunk.
BLOCK = 128
STRIDE, WIDTH = 4, 8
PAD = WIDTH - STRIDE
POSITIONS = BLOCK // STRIDE
#: Blocks convolved at once; bounds memory for texts of any length.
PIECE = 2048


@dataclass(frozen=True)
class Settings:
    """Bounds of the fit: texts in the sample, and the training itself."""

    texts: int = 4000
    filters: int = 24
    embedding: int = 4
    epochs: int = 12
    batch: int = 100
    rate: float = 0.01
    seed: int = 7


@dataclass
class Network:
    embed: np.ndarray  # (256, embedding)
    kernel: np.ndarray  # (WIDTH * embedding, filters)
    shift: np.ndarray  # (filters,)
    weight: np.ndarray  # (filters,)
    bias: np.ndarray  # (1,)


def lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts padded to whole blocks in one array, and the first block of each (one more at the end)."""
    blocks = [max(1, -(-(len(t) + PAD) // BLOCK)) for t in texts]
    starts = np.concatenate([[0], np.cumsum(blocks)]).astype(np.int64)
    data = np.zeros(int(starts[-1]) * BLOCK + PAD, np.uint8)
    for t, s in zip(texts, starts):
        data[s * BLOCK : s * BLOCK + len(t)] = np.frombuffer(t, np.uint8)
    return data, starts


def inputs(net: Network, data: np.ndarray, first: int, last: int) -> np.ndarray:
    """Filter inputs of blocks ``first`` to ``last``: one row per position."""
    x = net.embed[data[first * BLOCK : last * BLOCK + PAD]].reshape(-1, STRIDE * net.embed.shape[1])
    return np.concatenate([x[:-1], x[1:]], axis=1)


def pooled_blocks(net: Network, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Largest response of each filter in each block."""
    n = int(starts[-1])
    out = np.empty((n, len(net.shift)), np.float32)
    for a in range(0, n, PIECE):
        b = min(n, a + PIECE)
        z = (inputs(net, data, a, b) @ net.kernel).reshape(b - a, POSITIONS, -1)
        leave_out_crossing(z, starts, a)
        out[a:b] = z.max(1)
    return out + net.shift


def leave_out_crossing(z: np.ndarray, starts: np.ndarray, first: int) -> None:
    """A text's last position sees only padding and the next text's bytes."""
    ends = starts[1:] - 1 - first
    z[ends[(ends >= 0) & (ends < len(z))], -1] = -np.inf


def chunk_pairs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Second block of the chunk that each block begins (its last block ends its text), and chunks per text."""
    n = int(starts[-1])
    second = np.arange(1, n + 1)
    second[starts[1:] - 1] = starts[1:] - 1
    counts = np.diff(starts)
    # A text of several blocks has one chunk less than blocks: its last block begins none of its own.
    return second, np.maximum(counts - 1, 1)


def text_features(blocks: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean over a text's chunks of the pooled responses; also which block won, and each block's share."""
    second, chunks = chunk_pairs(starts)
    other = blocks[second]
    wins = other > blocks
    best = np.maximum(np.maximum(blocks, other), 0)
    counts = np.diff(starts)
    begins = np.ones(len(blocks), np.float32)
    begins[starts[1:] - 1] = counts == 1
    share = begins / np.repeat(chunks, counts).astype(np.float32)
    return np.add.reduceat(best * share[:, None], starts[:-1], axis=0), wins, share


def probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    data, starts = lay_out(texts)
    features, _, _ = text_features(pooled_blocks(net, data, starts), starts)
    z = (features @ net.weight + net.bias[0]).astype(np.float64)
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def gradients(net: Network, texts: list[bytes], labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean log loss and its gradient by each of the network's arrays."""
    data, starts = lay_out(texts)
    n = int(starts[-1])
    pieces = [(a, min(n, a + PIECE)) for a in range(0, n, PIECE)]
    at = np.empty((n, len(net.shift)), np.int16)
    blocks = np.empty((n, len(net.shift)), net.kernel.dtype)
    for a, b in pieces:
        z = (inputs(net, data, a, b) @ net.kernel).reshape(b - a, POSITIONS, -1)
        leave_out_crossing(z, starts, a)
        best = z.argmax(1)
        at[a:b], blocks[a:b] = best, np.take_along_axis(z, best[:, None, :], 1)[:, 0, :]
    blocks += net.shift
    features, wins, share = text_features(blocks, starts)
    p = 1 / (1 + np.exp(-np.clip(features @ net.weight + net.bias[0], -60, 60)))
    loss = float(-np.mean(np.where(labels == 1, np.log(p + 1e-9), np.log(1 - p + 1e-9))))
    d = ((p - labels) / len(labels)).astype(np.float32)

    second, _ = chunk_pairs(starts)
    g = np.repeat(d, np.diff(starts))[:, None] * net.weight * share[:, None]
    g = g * (np.maximum(blocks, blocks[second]) > 0)
    to_block = np.where(wins, 0, g)
    to_second = np.where(wins, g, 0)
    to_block[1:] += to_second[:-1]  # a chunk's second block follows it; where it has none, it never wins
    d_kernel, d_embed = np.zeros_like(net.kernel), np.zeros(net.embed.shape)
    for a, b in pieces:
        rows = np.arange(b - a)[:, None] * POSITIONS + at[a:b]
        picked = inputs(net, data, a, b)[rows]  # (blocks, filters, inputs)
        d_kernel += np.einsum("bf,bfi->if", to_block[a:b], picked, optimize=True)
        d_inputs = (to_block[a:b, :, None] * net.kernel.T[None]).reshape(-1, WIDTH, net.embed.shape[1])
        offsets = (rows.reshape(-1, 1) * STRIDE + np.arange(WIDTH)).reshape(-1) + a * BLOCK
        byte = data[offsets]
        d_embed += np.stack([np.bincount(byte, d_inputs[:, :, e].reshape(-1), 256) for e in range(net.embed.shape[1])], 1)
    return loss, [d_embed, d_kernel, to_block.sum(0), features.T @ d, np.array([d.sum()])]


def constant(probability: float, settings: Settings) -> Network:
    """A network that gives every text the same probability."""
    e, f = settings.embedding, settings.filters
    zeros = [np.zeros(shape, np.float32) for shape in ((256, e), (WIDTH * e, f), f, f)]
    return Network(*zeros, np.array([np.log(probability / (1 - probability))], np.float32))


class Spooled:
    """Texts in a file that is gone when this is: a list of which only what is asked for is in memory."""

    def __init__(self) -> None:
        self.file, self.places = tempfile.TemporaryFile(), []

    def append(self, text: bytes) -> None:
        self.places.append((self.file.seek(0, 2), len(text)))
        self.file.write(text)

    def __len__(self) -> int:
        return len(self.places)

    def __getitem__(self, i: int) -> bytes:
        at, size = self.places[i]
        self.file.seek(at)
        return self.file.read(size)


def fit(texts: Sequence[bytes] | Spooled, labels: Iterable[int], settings: Settings = Settings()) -> Network:
    """Network fitted to labelled texts by Adam; the same input gives the same network."""
    y = np.asarray(list(labels), np.float32)
    prior = (float(y.sum()) + 1) / (len(y) + 2)
    if not 0 < y.sum() < len(y):
        return constant(prior, settings)
    rng = np.random.default_rng(settings.seed)
    e, f = settings.embedding, settings.filters
    net = Network(
        (rng.normal(size=(256, e)) * 0.5).astype(np.float32), (rng.normal(size=(WIDTH * e, f)) * 0.2).astype(np.float32), np.zeros(f, np.float32),
        (rng.normal(size=f) * 0.2).astype(np.float32), np.array([np.log(prior / (1 - prior))], np.float32),
    )
    arrays = [net.embed, net.kernel, net.shift, net.weight, net.bias]
    first, square = [np.zeros_like(a) for a in arrays], [np.zeros_like(a) for a in arrays]
    step = 0
    for epoch in range(settings.epochs):
        order = rng.permutation(len(texts))
        rate = settings.rate * (1 - 0.9 * epoch / settings.epochs)
        for a in range(0, len(order), settings.batch):
            batch = order[a : a + settings.batch]
            _, grads = gradients(net, [texts[i] for i in batch], y[batch])
            step += 1
            for w, m, v, g in zip(arrays, first, square, grads):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def in_training(id_column: str = "doc_id", folds: int = 5) -> Column:
    """Rows whose labels may be learned: the CRC of the id's text is not a multiple of ``folds``."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % folds != 0


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Network:
    """Fit on the whole ``settings.texts`` labelled documents that come first by the hash of their id.

    ``labels`` has ``doc_id`` and ``quality``; rows with a null in either, the held-out fold and ids without a document
    are not used. Of several texts under one id the least in byte order is learned, of several labels the lower one, so
    the fit does not depend on the order or the partitions of the rows.
    """
    usable = labels.filter(in_training() & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    one_each = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    one_each = one_each.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = one_each.orderBy(F.xxhash64(F.col("doc_id")), "doc_id").limit(settings.texts)  # at most settings.texts rows
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body")
    rows = docs.select("doc_id", body).join(F.broadcast(chosen), "doc_id")
    texts, qualities = Spooled(), []
    for r in rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("body").alias("body")).orderBy("doc_id").toLocalIterator():
        texts.append(bytes(r.body))
        qualities.append(int(r.quality))
    return fit(texts, qualities, settings)


def score(docs: DataFrame, net: Network, column: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with the probability of quality 1, read from the whole text."""
    small_batches(docs.sparkSession)
    rows = docs.drop(column)
    schema = nullable(T.StructType([*rows.schema.fields, T.StructField(column, T.DoubleType())]))
    at = rows.columns.index(text)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b"" if t is None else t.encode() for t in batch.column(at).to_pylist()]
            p = pa.array(probabilities(net, texts), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, p], [*batch.schema.names, column])

    return rows.mapInArrow(scored, schema)
