"""Language-model scores by masked pseudo-likelihood.

A window network predicts every word from the words on both its sides, itself left out, and a document's
score is the sum of the logarithms of these conditional probabilities.

Words are symbols: the most frequent ones of all documents each have one, the others share hashed ones,
whose probability is spread over their words by the words' counts. These counts stay a table, which is
joined to the distinct words of the documents. The network adds a learned vector for each place and
symbol of the window, bends the sum, and predicts first a class of symbols of like frequency and then
the symbol in its class, so the cost of a word does not depend on the number of symbols.

Training is spread like the data: each task goes over all of its documents and learns at every
``stride``-th word of each, and the tasks' networks are averaged by the words they learnt at. Each round
begins at another word, and there are as many rounds as the stride at least, so every word is learnt at. What is gathered grows with the number of tasks, what the driver gets
is one network.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcount.llm.bytetext import SPACED, Words, mix, signed, slices, tokenize
from fieldcount.llm.workers import keep_freed, tidy
from fieldcount.session import materialize

CLASSES, PER_CLASS = 64, 64
SYMBOLS = CLASSES * PER_CLASS
#: Symbols of words of their own; the rest are shared.
NAMED = 3072
SIDE = 2
HIDDEN = 24
#: Targets of a class up to which it is small.
FEW = 16
_PART = 1 << 14
_AT_ONCE = 1 << 14
#: Leading bits of hashes by which words are looked up.
LEAD = 16
_LESS = np.uint64(64 - LEAD)


@dataclass
class Vocabulary:
    """Hashes of the named words, sorted, with their symbols; and the counts of the shared symbols."""

    hashes: np.ndarray
    symbol: np.ndarray
    shared: np.ndarray

    @cached_property
    def places(self) -> tuple[np.ndarray, int]:
        """Where hashes of each leading bits begin, and how many share these at most."""
        lead = np.arange(1 << LEAD, dtype=np.uint64) << _LESS
        first = np.append(np.searchsorted(self.hashes, lead), len(self.hashes))
        return np.minimum(first[:-1], len(self.hashes) - 1), int(np.diff(first).max())

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        out = NAMED + (mix(hashes) % np.uint64(SYMBOLS - NAMED)).astype(np.int32)
        if not len(self.hashes):
            return out
        first, most = self.places
        at = first.take((hashes >> _LESS).astype(np.int64))
        for _ in range(most):
            found = np.flatnonzero(self.hashes.take(at) == hashes)
            out[found] = self.symbol.take(at.take(found))
            at = np.minimum(at + 1, len(self.hashes) - 1)
        return out


def vocabulary(texts: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """Counts the words of all documents (word, n); the named ones reach the driver."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        for batch in batches:
            parts = [
                np.unique(tokenize(batch["text"].slice(a, b - a), SPACED, lower=True).hash, return_counts=True)
                for a, b in slices(batch["text"])
            ]
            if not parts:
                continue
            hashes, counts = (np.concatenate(x) for x in zip(*parts))
            hashes, back = np.unique(hashes, return_inverse=True)
            sums = np.bincount(back, counts, len(hashes)).astype(np.int64)
            yield pa.record_batch([pa.array(signed(hashes)), pa.array(sums)], names=["word", "n"])

    counted = texts.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "word-counts")
    top = counted.orderBy(F.desc("n"), "word").limit(NAMED).collect()
    hashes = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    words = Vocabulary(hashes[order], order.astype(np.int32), np.zeros(SYMBOLS - NAMED, np.int64))
    given = texts.sparkSession.sparkContext.broadcast(words)

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(SYMBOLS, np.int64)
        for batch in batches:
            np.add.at(sums, given.value.symbols(batch["word"].to_numpy().view(np.uint64)), batch["n"].to_numpy())
        found = NAMED + np.flatnonzero(sums[NAMED:])
        yield pa.record_batch([pa.array(found, pa.int64()), pa.array(sums[found])], names=["symbol", "n"])

    shares = counted.mapInArrow(share, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n"))
    for row in shares.collect():
        words.shared[row["symbol"] - NAMED] = row["n"]
    return words, counted


class Dealt:
    """Targets in the order of their classes, first those of classes that have more than ``FEW`` of them.

    The product of a small class takes its call longer than its numbers, so all small classes have
    one product, each with ``FEW`` rows, of which those beyond its own are 0.
    """

    def __init__(self, target: np.ndarray):
        kind = target // PER_CLASS
        sizes = np.bincount(kind, minlength=CLASSES)
        place = np.arange(CLASSES) + CLASSES * (sizes <= FEW)
        self.order = np.argsort(place.astype(np.uint8).take(kind), kind="stable")
        self.kind = kind.take(self.order)
        self.member = target.take(self.order) - self.kind * PER_CLASS
        large = np.flatnonzero(sizes > FEW)
        ends = np.cumsum(sizes[large]).tolist()
        self.large = [(c, slice(a, b)) for c, a, b in zip(large.tolist(), [0, *ends], ends)]
        self.rest = slice(ends[-1] if ends else 0, len(target))
        self.small = np.flatnonzero((sizes > 0) & (sizes <= FEW))
        own = sizes[self.small][:, None]
        at = np.cumsum(own, 0) - own + np.arange(FEW)
        self._padding = np.arange(FEW) >= own
        self._own = np.flatnonzero(~self._padding)
        self._at = np.where(self._padding, 0, at).ravel()

    def pad(self, columns: np.ndarray) -> np.ndarray:
        """The small classes' columns as rows: by class, number in it."""
        out = columns[:, self.rest].T.take(self._at, 0).reshape(len(self.small), FEW, -1)
        out[self._padding] = 0
        return out

    def unpad(self, rows: np.ndarray) -> np.ndarray:
        return rows.reshape(-1, rows.shape[2]).take(self._own, 0).T


class WindowNet:
    """All parameters in one vector; the arrays are views of it.

    A bias of classes or symbols is the last row of their weights, as ``hidden`` has a last row of ones.
    """

    SHAPES = (
        (2 * SIDE, SYMBOLS + 1, HIDDEN),
        (HIDDEN,),
        (HIDDEN + 1, CLASSES),
        (CLASSES, HIDDEN + 1, PER_CLASS),
    )

    def __init__(self, flat: np.ndarray | None = None, seed: int = 0):
        size = sum(map(prod, self.SHAPES))
        fresh = flat is None
        # an array that was sent has a type of its own, with which numpy takes slow paths
        self.flat = np.zeros(size, np.float32) if fresh else flat.view(np.float32)
        self.parts, start = [], 0
        for shape in self.SHAPES:
            n = prod(shape)
            self.parts.append(self.flat[start : start + n].reshape(shape))
            start += n
        if fresh:
            rng = np.random.default_rng(seed)
            vectors, _, to_class, to_symbol = self.parts
            for part in (vectors, to_class[:-1], to_symbol[:, :-1]):
                part[...] = rng.normal(0, 0.1, part.shape)

    def hidden(self, around: np.ndarray) -> np.ndarray:
        """A column for each row of ``around``."""
        vectors, bias = self.parts[:2]
        total = vectors[0].take(around[:, 0], 0)
        for place in range(1, 2 * SIDE):
            total += vectors[place].take(around[:, place], 0)
        out = np.ones((HIDDEN + 1, len(around)), np.float32)
        np.add(total.T, bias[:, None], out=out[:-1])
        np.tanh(out[:-1], out=out[:-1])
        return out

    def in_class(self, hidden: np.ndarray, dealt: Dealt, out: np.ndarray) -> np.ndarray:
        """Logits of the members of each column's class."""
        to_symbol = self.parts[3]
        for c, own in dealt.large:
            np.matmul(to_symbol[c].T, hidden[:, own], out=out[:, own])
        if len(dealt.small):
            out[:, dealt.rest] = dealt.unpad(dealt.pad(hidden) @ to_symbol.take(dealt.small, 0))
        return out

    def log_probabilities(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of each target symbol given the symbols around it."""
        dealt = Dealt(target)
        hidden = self.hidden(around.take(dealt.order, 0))
        logits = self.parts[2].T @ hidden
        found = _log_softmax_at(logits, dealt.kind)
        found += _log_softmax_at(self.in_class(hidden, dealt, logits), dealt.member)
        out = np.empty_like(found)
        out[dealt.order] = found
        return out

    def learn(self, around: np.ndarray, target: np.ndarray, sums: np.ndarray, rate: float) -> None:
        """One step of Adagrad; ``sums`` holds the squared gradients so far.

        Of the vectors only those of the symbols around are touched; the others' gradients are 0.
        """
        vectors, _, to_class, to_symbol = self.parts
        squares, dealt, n = WindowNet(sums).parts, Dealt(target), len(target)
        around, rows = around.take(dealt.order, 0), np.arange(n)
        hidden = self.hidden(around)
        wrong = _softmax(to_class.T @ hidden)
        wrong[dealt.kind, rows] -= 1
        of_class = hidden @ wrong.T
        back = to_class[:-1] @ wrong
        wrong = _softmax(self.in_class(hidden, dealt, wrong))
        wrong[dealt.member, rows] -= 1
        of_symbol, more = np.zeros_like(to_symbol), np.empty_like(back)
        for c, own in dealt.large:
            np.matmul(hidden[:, own], wrong[:, own].T, out=of_symbol[c])
            np.matmul(to_symbol[c, :-1], wrong[:, own], out=more[:, own])
        if len(dealt.small):
            part = dealt.pad(wrong)
            of_symbol[dealt.small] = dealt.pad(hidden).transpose(0, 2, 1) @ part
            more[:, dealt.rest] = dealt.unpad(part @ to_symbol.take(dealt.small, 0)[:, :-1].transpose(0, 2, 1))
        back += more
        slope = np.square(hidden[:-1], out=more)
        back *= np.subtract(1, slope, out=slope)
        back /= n
        of_class /= n
        of_symbol /= n
        for part, square, grad in zip(self.parts[1:], squares[1:], (back.sum(1), of_class, of_symbol)):
            part -= _step(square, grad, rate)
        # the vectors of all places as one table of rows
        keys = (around + np.arange(2 * SIDE, dtype=around.dtype) * (SYMBOLS + 1)).T.ravel()
        seen = np.zeros(2 * SIDE * (SYMBOLS + 1), bool)
        seen[keys] = True
        symbols = np.flatnonzero(seen)
        number = np.empty(len(seen), np.int64)
        number[symbols] = np.arange(len(symbols))
        at, grad = number.take(keys), np.zeros((HIDDEN, len(symbols)), np.float32)
        for total, values in zip(grad, np.tile(back, 2 * SIDE)):
            np.add.at(total, at, values)
        table, square = _rows(vectors), _rows(squares[0])
        old, own = (x.take(symbols).view(np.float32).reshape(-1, HIDDEN) for x in (square, table))
        own -= _step(old, np.ascontiguousarray(grad.T), rate)
        table[symbols], square[symbols] = _rows(own), _rows(old)


def _rows(vectors: np.ndarray) -> np.ndarray:
    """A vector as one item, which moves faster than its numbers."""
    return vectors.reshape(-1).view(np.dtype((np.void, 4 * HIDDEN)))


def _step(square: np.ndarray, grad: np.ndarray, rate: float) -> np.ndarray:
    """What Adagrad takes off; ``square`` has the gradient's square added after."""
    root = grad * grad
    square += root
    np.add(square, np.float32(1e-8), out=root)
    np.sqrt(root, out=root)
    np.divide(grad, root, out=root)
    root *= np.float32(rate)
    return root


def _softmax(logits: np.ndarray) -> np.ndarray:
    """Of each column, in place."""
    logits -= logits.max(0)
    np.exp(logits, out=logits)
    logits *= 1 / logits.sum(0)
    return logits


def _log_softmax_at(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each column at one row; the logits are used up."""
    logits -= logits.max(0)
    chosen = logits[at, np.arange(len(at))]
    return chosen - np.log(np.exp(logits, out=logits).sum(0))


def windows(symbols: np.ndarray, first: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Symbols on both sides of the chosen words; beyond a document's ends there is a symbol of its own."""
    row = np.searchsorted(first, chosen, side="right") - 1
    begin, end = first[row], first[row + 1]
    out = np.empty((len(chosen), 2 * SIDE), np.int32)
    for column, offset in enumerate((*range(-SIDE, 0), *range(1, SIDE + 1))):
        at = chosen + offset
        inside = (at >= begin) & (at < end)
        out[:, column] = np.where(inside, symbols[np.clip(at, 0, len(symbols) - 1)], SYMBOLS)
    return out


def learnt_at(part: Words, stride: int, number: int) -> np.ndarray:
    """Words that a round learns at: each ``stride``-th of a document, from one that its first word decides.

    Any ``stride`` rounds on end have each word once, however the documents are dealt to tasks.
    """
    size = np.diff(part.first)
    begin = part.first[:-1]
    shift = np.zeros(len(size), np.int64)
    shift[size > 0] = (part.hash[begin[size > 0]] % np.uint64(stride)).astype(np.int64)
    within = np.arange(len(part.hash)) - np.repeat(begin - shift, size)
    return np.flatnonzero((within + number) % stride == 0)


def _trained(texts: DataFrame, words, net: WindowNet, stride: int, batch: int, rate: float, number: int) -> WindowNet:
    """The tasks' networks, averaged by the number of words that each learnt at."""
    start = texts.sparkSession.sparkContext.broadcast(net.flat)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        own, sums, seen = WindowNet(start.value.copy()), np.full(len(start.value), 1e-4, np.float32), 0
        rest: tuple[np.ndarray, np.ndarray] | None = None
        for given in batches:
            for a, b in slices(given["text"]):
                part = tokenize(given["text"].slice(a, b - a), SPACED, lower=True)
                if not len(part.hash):
                    continue
                symbols = words.value.symbols(part.hash)
                at = learnt_at(part, stride, number)
                more = windows(symbols, part.first, at), symbols[at]
                around, target = more if rest is None else tuple(np.concatenate(x) for x in zip(rest, more))
                full = len(target) // batch * batch
                for i in range(0, full, batch):
                    own.learn(around[i : i + batch], target[i : i + batch], sums, rate)
                rest, seen = (around[full:], target[full:]), seen + full
        if rest is not None and len(rest[1]):
            own.learn(*rest, sums, rate)
            seen += len(rest[1])
        for at in range(0, len(own.flat) if seen else 0, _PART):
            packed = pa.array([own.flat[at : at + _PART].tobytes()], pa.binary())
            yield pa.record_batch(
                [pa.array([at // _PART], pa.int32()), pa.array([seen], pa.int64()), packed], names=["part", "n", "values"]
            )

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        total: dict[int, int] = {}
        for given in batches:
            for part, n, values in zip(given["part"].to_pylist(), given["n"].to_pylist(), given["values"]):
                more = np.frombuffer(values.as_buffer(), np.float32).astype(np.float64) * n
                sums[part] = sums[part] + more if part in sums else more
                total[part] = total.get(part, 0) + n
        for part, values in sums.items():
            packed = pa.array([(values / total[part]).astype(np.float32).tobytes()], pa.binary())
            yield pa.record_batch(
                [pa.array([part], pa.int32()), pa.array([total[part]], pa.int64()), packed], names=["part", "n", "values"]
            )

    schema = "part int, n long, values binary"
    parts = -(-len(net.flat) // _PART)
    out = net.flat.copy()
    learnt = texts.select("text").mapInArrow(run, schema)
    for row in learnt.repartition(parts, "part").mapInArrow(average, schema).collect():
        values = np.frombuffer(row["values"], np.float32)
        out[row["part"] * _PART : row["part"] * _PART + len(values)] = values
    return WindowNet(out)


def pseudo_likelihood(
    docs: DataFrame,
    rounds: int = 2,
    stride: int = 2,
    batch: int = 2048,
    rate: float = 0.1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, log_likelihood, mean_log_likelihood.

    Words are runs of anything but ASCII white space, with A-Z in lower case; all of them are scored.
    Null, empty and blank texts have no words, a sum of 0 and no mean. Repeated rows are scored each
    (and learnt from each). Other columns are not looked at; an empty table gives no rows. Results
    vary a little with how the rows are dealt to tasks. ``rounds`` below ``stride`` are refused, as
    some words would not be learnt at.
    """
    if rounds < stride:
        raise ValueError(f"{rounds} rounds leave out words at a stride of {stride}")
    texts = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    context = docs.sparkSession.sparkContext
    known, counted = vocabulary(texts)
    words = context.broadcast(known)
    net = WindowNet()
    for number in range(rounds):
        net = _trained(texts, words, net, stride, batch, rate / (number + 1), number)
    model = context.broadcast(net.flat)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        own = WindowNet(model.value)
        share = np.zeros(SYMBOLS)
        share[NAMED:] = np.log(np.maximum(words.value.shared, 1))
        for given in batches:
            texts = given["text"]
            counts, sums = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            rare, times, ends = [], [], [0]
            for a, b in slices(texts):
                part = tokenize(texts.slice(a, b - a), SPACED, lower=True)
                symbols = words.value.symbols(part.hash)
                each = np.zeros(len(symbols) + 1)
                for at in range(0, len(symbols), _AT_ONCE):
                    chosen = np.arange(at, min(len(symbols), at + _AT_ONCE))
                    found = own.log_probabilities(windows(symbols, part.first, chosen), symbols[chosen])
                    each[chosen + 1] = found - share[symbols[chosen]]
                total = np.cumsum(each)
                counts[a:b] = np.diff(part.first)
                sums[a:b] = total[part.first[1:]] - total[part.first[:-1]]
                for begin, end in zip(part.first[:-1].tolist(), part.first[1:].tolist()):
                    hashes, n = np.unique(part.hash[begin:end][symbols[begin:end] >= NAMED], return_counts=True)
                    rare.append(signed(hashes))
                    times.append(n)
                    ends.append(ends[-1] + len(hashes))
            lists = [
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x) if x else [], pa.int64()))
                for x in (rare, times)
            ]
            columns = [given[id_col], pa.array(counts), pa.array(sums), *lists]
            yield pa.record_batch(columns, names=[id_col, "n_tokens", "log_likelihood", "rare", "times"])

    kind = texts.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, log_likelihood double, rare array<long>, times array<long>"
    scored = texts.mapInArrow(run, schema).withColumn("__row", F.monotonically_increasing_id())
    scored = materialize(scored, "scored")
    # a word that occurs once adds log 1
    weights = counted.filter("n > 1").select("word", F.log("n").alias("weight"))
    each = scored.select("__row", F.inline(F.arrays_zip("rare", "times"))).withColumnRenamed("rare", "word")
    more = each.join(weights, "word").groupBy("__row").agg(F.sum(F.col("times") * F.col("weight")).alias("__more"))
    scored = scored.join(more, "__row", "left").select(
        id_col, "n_tokens", (F.col("log_likelihood") + F.coalesce("__more", F.lit(0.0))).alias("log_likelihood")
    )
    return scored.withColumn(
        "mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    )
