"""Packing token sequences: best fit, then a local search by swaps.

Texts become ids in tasks; documents longer than a sequence are cut. The pieces, a few numbers each,
are dealt by hash into buckets of a bounded number of pieces. Each bucket is packed by best fit,
longest first, and then searched: documents move between bins that are not full, one for nothing,
one for one or two for one, whenever that raises the sum of the squared fills, until no such change is
left; bins that run empty go.

Bins that are still not full go on to the next round, emptiest first, where they meet those of other
buckets, until one bucket is left: pieces one by one, or a bin of many pieces as one unit. At most half
of a bucket's units go on, so all rounds together are twice the work of the first.
"""

from __future__ import annotations

import bisect
import gc
import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcount.llm.bytetext import SPACED, raw, slices, tokenize
from fieldcount.llm.workers import tidy
from fieldcount.session import materialize

END_ID = 1
BUCKET = 8192
#: Units of a bin that goes on, above which it goes on as one.
TOGETHER = 64
#: Letters that are composed already and have one small letter each: Latin-1 and Extended-A but U+0130.
LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
PIECES = "piece int, start long, length long, ids_crc32 long"


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places first, first + 1, ... of each run, one run after the other."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class _Runs:
    """Ids of many short texts, one after the other."""

    def __init__(self):
        self.flat, self.first = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def add(self, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, ids])

    def take(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts at ``places`` and how many each has."""
        size = self.first[places + 1] - self.first[places]
        return self.flat[_spread(self.first[places], size)], size


class WordIds:
    """Ids of texts. Words between ASCII spaces are encoded once and looked up from then on, by hash.

    The tokenizer drops white space and never joins characters across it, so a text's ids are its
    words' ids. New words of printable ASCII and Latin letters are lower-cased and split by the
    tokenizer's own pattern, and each different part is encoded once; other new words are encoded
    together, and offsets tell which ids are whose.
    """

    MOST_WORDS = 600_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        plan = json.loads(self.tokenizer.to_str())
        split = next(s for s in plan["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split")
        parts = split["pattern"]["Regex"].replace(r"\p{L}", "A-Za-z" + LATIN).replace(r"\p{N}", "0-9")
        self.parts = re.compile(parts + r"|\n")
        self.simple = re.compile(f"[!-~{LATIN}]+")
        # how the tokenizer writes the bytes of each letter
        latin = [chr(c) for c in range(0x180) if re.match(f"[{LATIN}]", chr(c))]
        self.letters = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in latin}
        # added tokens stand for themselves in a text: words with what they begin with go the long way
        self.special = {t["content"][:2] for t in plan["added_tokens"]}
        self.forget()

    def forget(self) -> None:
        """Words and parts seen so far; the tokenizer stays."""
        self.hash, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.words, self.part_ids, self.part = _Runs(), _Runs(), {"\n": 0}
        self.part_ids.add(np.zeros(1, np.int64), np.zeros(0, np.uint32))

    def _split(self, words: list[str]) -> None:
        """Learn words of printable ASCII and Latin letters, with line breaks between them."""
        parts = self.parts.findall("\n".join(words).lower())
        new = list(set(parts).difference(self.part))
        if new:
            encode = self.tokenizer.model.tokenize
            ids = [[t.id for t in encode(part.translate(self.letters))] for part in new]
            self.part.update(zip(new, range(len(self.part), len(self.part) + len(new))))
            flat = np.fromiter(chain.from_iterable(ids), np.uint32)
            self.part_ids.add(np.fromiter(map(len, ids), np.int64, len(ids)), flat)
        places = np.fromiter(map(self.part.__getitem__, parts), np.int64, len(parts))
        ids, size = self.part_ids.take(places)
        self.words.add(np.bincount(np.cumsum(places == 0), size, len(words)).astype(np.int64), ids)

    def _encode(self, words: list[str]) -> None:
        for at in range(0, len(words), 500):
            chosen = words[at : at + 500]
            found = self.tokenizer.encode(" ".join(chosen), add_special_tokens=False)
            begin = np.cumsum([0, *(len(word) + 1 for word in chosen)])
            edges = np.searchsorted(np.array([a for a, _ in found.offsets], np.int64), begin)
            self.words.add(np.diff(edges), np.array(found.ids, np.uint32))

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        matches = self.simple.fullmatch
        plain = [matches(word) is not None for word in words]
        joined = "\n".join(words)
        for special in self.special:
            if special in joined:
                plain = [good and special not in word for good, word in zip(plain, words)]
        simple = np.array(plain, bool)
        order = np.concatenate([np.flatnonzero(simple), np.flatnonzero(~simple)])
        known, few = len(self.words.first) - 1, int(simple.sum())
        chosen = [words[i] for i in order.tolist()]
        gc.disable()  # very many small lists come into being, none in a cycle
        try:
            if few:
                self._split(chosen[:few])
            self._encode(chosen[few:])
        finally:
            gc.enable()
        hashes = np.concatenate([self.hash, hashes[order]])
        places = np.concatenate([self.place, known + np.arange(len(order))])
        by_hash = np.argsort(hashes, kind="stable")
        self.hash, self.place = hashes[by_hash], places[by_hash]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's ids start (one more at the end)."""
        if len(self.hash) > self.MOST_WORDS:
            self.forget()
        # the tokenizer lower-cases ASCII letters wherever they stand, but for its added tokens
        plain = not any(special.encode() in raw(texts)[0].tobytes() for special in self.special)
        words = tokenize(texts, SPACED, lower=plain)
        hashes, at, back = np.unique(words.hash.view(np.uint64), return_index=True, return_inverse=True)
        if not len(hashes):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        near = np.minimum(np.searchsorted(self.hash, hashes), max(len(self.hash) - 1, 0))
        new = np.flatnonzero(self.hash[near] != hashes) if len(self.hash) else np.arange(len(hashes))
        if len(new):
            data = words.buf.data
            begin, end = words.start[at[new]].tolist(), words.end[at[new]].tolist()
            self.learn(hashes[new], [str(data[a:b], "utf-8") for a, b in zip(begin, end)])
        ids, size = self.words.take(self.place[np.searchsorted(self.hash, hashes)][back])
        ends = np.concatenate([[0], np.cumsum(size)])
        return ids, ends[words.first]


#: Tokenizers of a Python worker, by path.
_LOADED: dict[str, WordIds] = {}


def tokenized_pieces(
    docs: DataFrame, tokenizer_path: str, most: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece of at most ``most`` ids: doc_id, piece, start, length, ids_crc32.

    A document's ids are its text's and then ``END_ID``; a null text counts as empty.
    """

    key_type = docs.schema[id_col].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _LOADED.get(tokenizer_path) or _LOADED.setdefault(tokenizer_path, WordIds(tokenizer_path))
        try:
            for batch in batches:
                for a, b in slices(batch["text"]):
                    rows = []
                    ids, first = own.encode(batch["text"].slice(a, b - a))
                    for i in range(b - a):
                        doc = np.append(ids[first[i] : first[i + 1]], np.uint32(END_ID)).astype("<u4")
                        for n, at in enumerate(range(0, len(doc), most)):
                            piece = doc[at : at + most]
                            rows.append((a + i, n, at, len(piece), zlib.crc32(piece.tobytes())))
                    whose, *columns = [pa.array(c, t) for c, t in zip(zip(*rows), KINDS)]
                    yield pa.record_batch(
                        [batch["doc_id"].take(whose), *columns],
                        names=["doc_id", "piece", "start", "length", "ids_crc32"],
                    )
        finally:
            own.forget()  # the worker goes on to tasks that need its memory

    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return texts.mapInArrow(run, f"doc_id {key_type}, {PIECES}")


KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def best_fit(sizes: list[int], most: int) -> list[list[int]]:
    """Indices by bin: longest first, each into the bin with the least room that will do."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect.bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, b = room.pop(at)
            bins[b].append(i)
        else:
            left, b = most, len(bins)
            bins.append([i])
        if left > sizes[i]:
            bisect.insort(room, (left - sizes[i], b))
    return bins


class _Bin:
    """A bin's documents by size, and what may be taken out of it in one change: nothing, one or two."""

    def __init__(self, members: list[int], sizes: list[int]):
        self.members = sorted(members, key=lambda i: sizes[i])
        own = np.array([sizes[i] for i in self.members], np.int64)
        self.fill = int(own.sum())
        # different sizes will do: a bin has fewer than the root of twice its length of them
        at = np.flatnonzero(np.diff(own, prepend=-1)) if len(own) else np.zeros(0, np.int64)
        a, b = np.triu_indices(len(at))
        a, b = at[a], at[b]
        twice = a == b
        b = np.where(twice, a + 1, b)
        good = ~twice | (np.isin(a + 1, np.arange(len(own))) & (own[np.minimum(a + 1, len(own) - 1)] == own[a]))
        a, b = a[good], b[good]
        self.one, self.two = at, (a, b)
        self.ones, self.twos = own[at], own[a] + own[b]

    def picked(self, k: int) -> list[int]:
        """The documents of choice ``k``: none, then one of each size, then pairs."""
        if k == 0:
            return []
        if k <= len(self.one):
            return [self.members[self.one[k - 1]]]
        k -= len(self.one) + 1
        return [self.members[self.two[0][k]], self.members[self.two[1][k]]]


def swap_search(bins: list[list[int]], sizes: list[int], most: int) -> list[list[int]]:
    """Raise the sum of the squared fills by moves between bins that are not full.

    Every bin gives in turn, emptiest first: one of its documents moves into another bin's room, or
    takes the place of one or two shorter ones there, or two of its documents take the place of one.
    Of all changes with all fuller bins the one that raises the sum most is made, until there is none;
    bins give again until a whole sweep changes nothing. Ids only move to fuller bins, so the sum
    rises with every change and the search ends.
    """
    state = [_Bin(b, sizes) for b in bins]
    n_open = [b for b in range(len(state)) if 0 < state[b].fill < most]
    taken = {b: _choices(state[b]) for b in n_open}
    changed = True
    while changed:
        changed = False
        n_open = sorted((b for b in n_open if 0 < state[b].fill < most), key=lambda b: state[b].fill)
        table = _Table(n_open, taken, state, most)
        for low in n_open:
            while 0 < state[low].fill < most and (found := table.best(low, state[low])):
                give, high, take = found
                out, back = state[low].picked(give), state[high].picked(take)
                stay = [i for i in state[low].members if i not in out]
                others = [i for i in state[high].members if i not in back]
                state[low], state[high] = _Bin(stay + back, sizes), _Bin(others + out, sizes)
                for b in (low, high):
                    taken[b] = _choices(state[b])
                    table.replace(b, taken[b], state[b].fill)
                changed = True
    return [b.members for b in state if b.members]


def _choices(held: _Bin) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of what may be taken from a bin, and how many documents each choice has."""
    size = np.concatenate([[0], held.ones, held.twos])
    return size, np.repeat([0, 1, 2], [1, len(held.ones), len(held.twos)])


class _Table:
    """All that may be taken from all open bins, one row each."""

    def __init__(self, open_bins: list[int], taken: dict, state: list[_Bin], most: int):
        self.most = most
        parts = [taken[b] for b in open_bins]
        self.count = [len(p[0]) for p in parts]
        self.size = np.concatenate([p[0] for p in parts] or [np.zeros(0, np.int64)])
        self.number = np.concatenate([p[1] for p in parts] or [np.zeros(0, np.int64)])
        self.bin = np.repeat(np.array(open_bins, np.int64), self.count)
        self.choice = np.concatenate([np.arange(c) for c in self.count] or [np.zeros(0, np.int64)])
        self.fill = np.repeat(np.array([state[b].fill for b in open_bins], np.int64), self.count)

    def replace(self, b: int, taken: tuple[np.ndarray, np.ndarray], fill: int) -> None:
        keep = self.bin != b
        size, number = taken if 0 < fill < self.most else (np.zeros(0, np.int64),) * 2
        rows = [
            (self.size, size),
            (self.number, number),
            (self.bin, np.full(len(size), b)),
            (self.choice, np.arange(len(size))),
            (self.fill, np.full(len(size), fill)),
        ]
        self.size, self.number, self.bin, self.choice, self.fill = (
            np.concatenate([old[keep], new]) for old, new in rows
        )

    def best(self, low: int, held: _Bin) -> tuple[int, int, int] | None:
        """The change that raises the sum of squares most: (choice of low, other bin, its choice)."""
        top, found = 0, None
        for n, (given, most_taken) in enumerate(((held.ones, 2), (held.twos, 1)), start=1):
            if not len(given):
                continue
            order = np.argsort(given, kind="stable")
            ranked = given[order]
            rows = (self.bin != low) & (self.fill >= held.fill) & (self.number <= most_taken)
            rows &= (self.number > 0) | (n == 1)
            # the longest of ours that takes no more than this room
            room = self.size + self.most - self.fill
            at = np.searchsorted(ranked, room, side="right") - 1
            gain = np.where(at >= 0, ranked[at], 0) - self.size
            raised = np.where(rows & (gain > 0), gain * (self.fill - held.fill + gain), 0)
            row = int(raised.argmax()) if len(raised) else 0
            if len(raised) and raised[row] > top:
                top = raised[row]
                skipped = 1 if n == 1 else 1 + len(held.ones)
                found = skipped + int(order[at[row]]), int(self.bin[row]), int(self.choice[row])
        return found


def _round(units: DataFrame, buckets: int, level: int, most: int) -> DataFrame:
    """Pack each bucket; bins that go on have no sequence_id yet.

    A unit is a piece, or a bin of many units that goes on as one. Bins that are not full go on,
    emptiest first, as far as they are half of the bucket's units.
    """
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("unit").reset_index(drop=True)
        unit, names = pd.factorize(rows["unit"])
        sizes = np.bincount(unit, rows["length"], len(names)).astype(int).tolist()
        first = np.searchsorted(unit, np.arange(len(names) + 1)).tolist()
        length = rows["length"].tolist()
        bins = swap_search(best_fit(sizes, most), sizes, most)
        fill = [sum(sizes[i] for i in b) for b in bins]
        low = sorted((b for b in range(len(bins)) if fill[b] < most), key=lambda b: fill[b])
        counted = np.cumsum([1 if len(bins[b]) > TOGETHER else len(bins[b]) for b in low])
        on = set(low[: int((counted <= len(sizes) // 2).sum())]) if buckets > 1 else set()
        base = (level << 56) + (int(rows["bucket"].iloc[0]) << 24)
        sequence, offset, new_unit = [None] * len(rows), [0] * len(rows), rows["unit"].tolist()
        for b, members in enumerate(bins):
            at, places = 0, [r for i in sorted(members) for r in range(first[i], first[i + 1])]
            for r in places:
                if b not in on:
                    sequence[r], offset[r] = base + b, at
                    at += length[r]
                elif len(members) > TOGETHER:
                    new_unit[r] = -1 - base - b
        out = rows.drop(columns="bucket")
        return out.assign(unit=new_unit, sequence_id=pd.array(sequence, "Int64"), offset=offset)

    number = F.pmod(F.xxhash64("unit", F.lit(level)), F.lit(buckets)).cast("int")
    dealt = units.withColumn("bucket", number)
    kind = units.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("bucket").applyInPandas(
        pack, f"doc_id {kind}, {PIECES}, unit long, sequence_id long, offset long"
    )


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    most: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket: int = BUCKET,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are documents of one id. Repeated rows are packed each; rows with one id
    are told apart by nothing but their place. Ids keep their type; a null id stays null. Other columns
    are dropped. An empty table gives no rows.
    """
    pieces = materialize(tokenized_pieces(docs, tokenizer_path, most, id_col, text_col), "pieces")
    todo, n, level, done = pieces.withColumn("unit", F.monotonically_increasing_id()), pieces.count(), 0, None
    while done is None or n:
        buckets = max(1, -(-n // bucket))
        packed = materialize(_round(todo, buckets, level, most), f"packed{level}")
        settled = packed.filter(F.col("sequence_id").isNotNull()).drop("unit")
        done = settled if done is None else done.unionByName(settled)
        todo = packed.filter(F.col("sequence_id").isNull()).drop("sequence_id", "offset")
        n, level = 0 if buckets == 1 else todo.select("unit").distinct().count(), level + 1
    return done
