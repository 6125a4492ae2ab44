"""Toxicity from bags of subwords.

A word is the mean of the learned vectors of its character n-grams (of UTF-8 bytes, with its ends
marked) and of the word itself, all hashed into buckets; a passage is the mean of its words; a linear
softmax over that mean makes a probability. Vectors and softmax are trained together. A misspelling
that was never seen shares most n-grams, and so its vector, with the word it comes from.

Passages overlap and cover a whole document, and a document scores like its worst passage, so that a
few words do not vanish in a long text. Means and the softmax's logit are linear, so for scoring the
vectors fold into one number a bucket; every distinct word of a slice of text is looked up once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcount.llm.bytetext import SPACED, Words, mix, slices, tokenize
from fieldcount.llm.labels import held_out, training_sample

BUCKETS = 1 << 17
SIZES = (3, 4, 5)
PASSAGE, STEP = 12, 6
#: Subwords met less often in training have no vector.
LEAST = 8


def subwords(words: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the chosen words' n-grams, and where each word's begin (one more at the end)."""
    begin, size = words.start[chosen], words.end[chosen] - words.start[chosen]
    ends = np.concatenate([[0], np.cumsum(size + 2)])
    text = np.empty(ends[-1], np.uint8)
    text[ends[:-1]], text[ends[1:] - 1] = ord("<"), ord(">")
    inner = np.repeat(begin - ends[:-1] - 1, size) + _inner(ends, size)
    text[_inner(ends, size)] = words.buf[inner]
    owner = np.repeat(np.arange(len(chosen)), size + 2)
    parts, owners = [mix(words.hash[chosen])], [np.arange(len(chosen))]
    wide = text.astype(np.uint64)
    for n in SIZES:
        if len(text) < n:
            continue
        value = np.full(len(text) - n + 1, n, np.uint64)
        for j in range(n):
            value = value * np.uint64(0x100000001B3) + wide[j : j + len(value)]
        ok = owner[: len(value)] == owner[n - 1 :]
        parts.append(mix(value[ok]))
        owners.append(owner[: len(value)][ok])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(chosen)))])
    return (np.concatenate(parts)[order] & np.uint64(BUCKETS - 1)).astype(np.int32), first


def _inner(ends: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of the words' own bytes between their end marks."""
    return np.arange(size.sum()) + np.repeat(2 * np.arange(len(size)) + 1, size)


def passages(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of the overlapping passages of each row's words, and each row's first passage.

    The last passage ends with the row; a row without words has one empty passage.
    """
    size = np.diff(first)
    count = np.maximum(0, -(-(size - PASSAGE) // STEP)) + 1
    start = np.concatenate([[0], np.cumsum(count)])
    within = np.arange(start[-1]) - np.repeat(start[:-1], count)
    begin = np.repeat(first[:-1], count) + np.minimum(within * STEP, np.repeat(np.maximum(size - PASSAGE, 0), count))
    return begin, np.minimum(begin + PASSAGE, np.repeat(first[1:], count)), start


def fresh(words: Words) -> np.ndarray:
    """Whether each word differs from the one before; a word said over and over counts once."""
    out = np.ones(len(words.hash), bool)
    out[1:] = words.hash[1:] != words.hash[:-1]
    out[words.first[:-1][words.first[:-1] < len(out)]] = True
    return out


def _means(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return (sums[end] - sums[begin]) / np.maximum(1, end - begin)


@dataclass
class SubwordBag:
    """vectors: BUCKETS x d; softmax: d x 2; bias: 2 (classes clean, toxic)."""

    vectors: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray

    def folded(self) -> tuple[np.ndarray, float]:
        """The difference of the two logits that each bucket makes, and that of the biases."""
        return self.vectors @ (self.softmax[:, 1] - self.softmax[:, 0]), float(self.bias[1] - self.bias[0])


def scores(texts: pa.Array, bucket_logits: np.ndarray, bias: float) -> np.ndarray:
    words = tokenize(texts, SPACED, lower=True)
    _, chosen, back = np.unique(words.hash, return_index=True, return_inverse=True)
    parts, first = subwords(words, chosen)
    each = _means(bucket_logits[parts], first[:-1], first[1:])[back] * fresh(words)
    begin, end, start = passages(words.first)
    worst = np.maximum.reduceat(_means(each, begin, end), start[:-1]) if len(texts) else np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(worst + bias, -30, 30)))


def train(texts: list[str], labels: list[int], d: int = 8, epochs: int = 14, batch: int = 128, seed: int = 0) -> SubwordBag:
    """Adam on the cross entropy of each document's currently worst passage.

    The first epochs take random passages of clean and whole toxic documents, until the vectors
    tell passages apart. With no rows, or rows of one label only, the softmax answers their share.
    """
    rng = np.random.default_rng(seed)
    share = float(np.clip(np.mean(labels), 0.01, 0.99)) if labels else 0.5
    model = SubwordBag(
        rng.normal(0, 0.05, (BUCKETS, d)).astype(np.float32),
        rng.normal(0, 1, (d, 2)).astype(np.float32),
        np.array([0, np.log(share / (1 - share))], np.float32),
    )
    if not labels or min(labels) == max(labels):
        model.softmax[:] = 0
        return model
    y = np.array(labels)
    words = tokenize(pa.array(texts, pa.large_string()), SPACED, lower=True)
    _, chosen, back, times = np.unique(words.hash, return_index=True, return_inverse=True, return_counts=True)
    parts, first = subwords(words, chosen)
    # a subword of one rare word would only learn that word's label by heart
    known = np.bincount(parts, np.repeat(np.minimum(times, LEAST), np.diff(first)), BUCKETS) >= LEAST
    model.vectors[~known] = 0
    begin, end, start = passages(words.first)
    new = fresh(words)
    params = [model.vectors, model.softmax, model.bias]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        logits, bias = model.folded()
        means = _means(_means(logits[parts], first[:-1], first[1:])[back] * new, begin, end)
        rate = 0.02 * (1 - epoch / epochs) + 0.001
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            if epoch < 4:
                a, b = words.first[:-1][rows], words.first[1:][rows]
            else:
                best = np.array([start[r] + means[start[r] : start[r + 1]].argmax() for r in rows])
                a, b = begin[best], end[best]
            size = b - a
            at = np.repeat(a - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            row = np.repeat(np.arange(len(rows)), size)[new[at]]
            at = back[at[new[at]]]
            n = first[at + 1] - first[at]
            take = np.repeat(first[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            bucket, owner = parts[take], np.repeat(row, n)
            weight = (np.repeat(1 / n, n) / size[owner]).astype(np.float32)
            x = np.stack([np.bincount(owner, weight * model.vectors[bucket, j], len(rows)) for j in range(d)], 1)
            logit = x @ model.softmax + model.bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            g_x = (p @ model.softmax.T).astype(np.float32)
            g_vectors = np.stack([np.bincount(bucket, weight * g_x[owner, j], BUCKETS) for j in range(d)], 1)
            g_vectors[~known] = 0
            t += 1
            for i, g in enumerate([g_vectors.astype(np.float32), (x.T @ p).astype(np.float32), p.sum(0)]):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                params[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-7)
    return model


def score_toxicity(docs: DataFrame, model: SubwordBag, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` without its text and with the score (0 to 1) of each whole text in ``out``.

    Null counts as empty; a column of the name ``out`` is replaced; all others are passed on.
    """
    rest = [c for c in docs.columns if c not in (text_col, out)]
    shared = docs.sparkSession.sparkContext.broadcast(model.folded())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            found = [scores(texts.slice(a, b - a), *shared.value) for a, b in slices(texts)]
            keep = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.record_batch([*keep, pa.array(np.concatenate([np.zeros(0), *found]))], names=[*rest, out])

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text")
    given = docs.select(*[F.col(f"`{c}`") for c in rest], text)
    kinds = ", ".join(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in rest)
    return given.mapInArrow(run, f"{kinds}{', ' if kinds else ''}`{out}` double")


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.5,
    most_rows: int = 4000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per document: id, held_out, score, predicted (score of ``threshold`` or more).

    Null and empty texts have one empty passage, whose score is that of the biases alone. Repeated
    rows are scored each. Without usable labels every score is 0.5. At most ``most_rows`` labelled
    rows are learnt from.
    """
    model = train(*training_sample(docs, labels, "toxic", most_rows, id_col, text_col))
    given = docs.select(id_col, held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    scored = score_toxicity(given, model, "text")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
