"""Text quality by a convolutional network over bytes.

A document is cut into overlapping chunks that cover all of its bytes. Each byte has a learned
vector; learned filters run over each chunk, their largest responses in the document are kept, and a
logistic layer makes one probability of them. Training (numpy, on the driver) sees a bounded sample
of labelled documents; scoring runs in tasks, a megabyte of text at a time, so that memory does not
depend on the length of a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcount.llm.bytetext import raw, slices
from fieldcount.llm.labels import held_out, training_sample
from fieldcount.llm.workers import tidy

PAD = 256


@dataclass
class ByteConvNet:
    """embed: 257 x d; filters: (k d) x f; bias: f; out: f; out_bias: 1."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    k: int
    stride: int

    @classmethod
    def new(cls, k: int = 16, stride: int = 8, d: int = 4, f: int = 24, seed: int = 0) -> ByteConvNet:
        rng = np.random.default_rng(seed)
        embed = rng.normal(0, 0.5, (257, d)).astype(np.float32)
        embed[PAD] = 0
        return cls(
            embed,
            rng.normal(0, (2 / (k * d)) ** 0.5, (k * d, f)).astype(np.float32),
            np.zeros(f, np.float32),
            rng.normal(0, f**-0.5, f).astype(np.float32),
            np.zeros(1, np.float32),
            k,
            stride,
        )

    def chunks(self, buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all chunks (n x k) and where each row's chunks start.

        A row's last chunk ends at its last byte; a row shorter than a chunk is padded, and an
        empty row is one chunk of padding.
        """
        size = np.diff(bounds)
        count = np.maximum(0, -(-(size - self.k) // self.stride)) + 1
        first = np.concatenate([[0], np.cumsum(count)])
        within = np.arange(first[-1]) - np.repeat(first[:-1], count)
        last = np.repeat(np.maximum(size - self.k, 0), count)
        at = np.repeat(bounds[:-1], count) + np.minimum(within * self.stride, last)
        end = np.repeat(bounds[1:], count)
        index = at[:, None] + np.arange(self.k)
        short = np.repeat(size < self.k, count)
        if not len(buf):
            return np.full(index.shape, PAD, np.int16), first
        found = buf[np.minimum(index, len(buf) - 1)].astype(np.int16)
        if short.any():
            found[short] = np.where(index[short] < end[short][:, None], found[short], PAD)
        return found, first

    def pooled(self, found: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The largest response of each filter in each row, before the rectifier."""
        each = self.embed[found].reshape(len(found), -1) @ self.filters
        return np.maximum.reduceat(each, first[:-1], axis=0) + self.bias

    def scores(self, buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        logit = np.maximum(self.pooled(*self.chunks(buf, bounds)), 0) @ self.out + self.out_bias
        return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -30, 30)))

    def long_score(self, buf: np.ndarray, block: int = 1 << 18) -> float:
        """The score of one long text, block by block; blocks overlap like chunks."""
        step = block // self.stride * self.stride
        best = np.full(len(self.out), -np.inf, np.float32)
        for at in range(0, max(1, len(buf) - self.k + self.stride), step):
            part = buf[at : at + step + self.k]
            best = np.maximum(best, self.pooled(*self.chunks(part, np.array([0, len(part)])))[0])
        logit = float(np.maximum(best, 0) @ self.out + self.out_bias[0])
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def train(
    texts: list[str],
    labels: list[int],
    epochs: int = 8,
    batch_bytes: int = 1 << 17,
    least_steps: int = 400,
    seed: int = 0,
) -> ByteConvNet:
    """Adam on the cross entropy; gradients reach the chunks with the largest responses.

    A small sample is gone over more often, for about ``least_steps`` steps. With no rows, or rows of one label only, the network answers that label's share.
    """
    net = ByteConvNet.new(seed=seed)
    y_all = np.array(labels, np.float32)
    share = float(np.clip(y_all.mean() if len(y_all) else 0.5, 0.01, 0.99))
    net.out_bias[:] = np.log(share / (1 - share))
    if not len(y_all) or y_all.min() == y_all.max():
        net.out[:] = 0
        return net
    data = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    params = [net.embed, net.filters, net.bias, net.out, net.out_bias]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    rng, step, k, d = np.random.default_rng(seed + 1), 0, net.k, net.embed.shape[1]
    epochs = max(epochs, min(60, -(-least_steps * batch_bytes // max(1, sum(map(len, data))))))
    for epoch in range(epochs):
        order, rate = rng.permutation(len(data)), 0.01 * (1 - epoch / epochs) + 0.0005
        size = np.cumsum([len(data[i]) + 64 for i in order])
        for rows in np.split(order, np.flatnonzero(np.diff(size // batch_bytes)) + 1):
            part = [data[i] for i in rows]
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in part])])
            found, first = net.chunks(np.concatenate(part), bounds)
            each = net.embed[found].reshape(len(found), -1) @ net.filters
            top = np.stack([a + each[a:b].argmax(0) for a, b in zip(first[:-1], first[1:])])
            pre = np.take_along_axis(each, top, 0) + net.bias
            hidden = np.maximum(pre, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ net.out + net.out_bias, -30, 30)))
            wrong = (p - y_all[rows]) / len(rows)
            back = wrong[:, None] * net.out * (pre > 0)
            seen = found[top]
            vectors = net.embed[seen].reshape(*top.shape, k * d)
            g_filters = np.einsum("rfi,rf->if", vectors, back)
            g_vectors = (net.filters.T[None] * back[:, :, None]).reshape(-1, d)
            g_embed = np.zeros_like(net.embed)
            np.add.at(g_embed, seen.reshape(-1), g_vectors)
            g_embed[PAD] = 0
            step += 1
            for i, g in enumerate([g_embed, g_filters, back.sum(0), wrong @ hidden, wrong.sum(keepdims=True)]):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                params[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-6)
    return net


def score_quality(docs: DataFrame, net: ByteConvNet, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score (0 to 1) of each whole text in ``out``; null counts as empty.

    A column of the name ``out`` is replaced; all others are passed on as they are.
    """
    rest = [c for c in docs.columns if c not in (text_col, out)]
    model = docs.sparkSession.sparkContext.broadcast(net)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            scores = np.empty(len(texts))
            for a, b in slices(texts, 1 << 18):
                buf, bounds = raw(texts.slice(a, b - a))
                scores[a:b] = own.long_score(buf) if b - a == 1 and len(buf) > 1 << 18 else own.scores(buf, bounds)
            keep = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.record_batch([*keep, pa.array(scores)], names=[*rest, out])

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text")
    given = docs.select(*[F.col(f"`{c}`") for c in rest], text)
    kinds = ", ".join(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in rest)
    return given.mapInArrow(run, f"{kinds}{', ' if kinds else ''}`{out}` double")


def quality(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.3,
    most_rows: int = 4000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per document: id, held_out, score, predicted (score of ``threshold`` or more).

    Null and empty texts are scored like any other. Repeated rows are scored each. Without usable
    labels every score is 0.5. At most ``most_rows`` labelled rows are learnt from.
    """
    net = train(*training_sample(docs, labels, "quality", most_rows, id_col, text_col))
    given = docs.select(id_col, held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    scored = score_quality(given, net, "text")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
