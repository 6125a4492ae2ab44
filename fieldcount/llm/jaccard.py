"""Near-duplicate documents: an n-gram Jaccard join with filters under several global orders.

A document's set holds the hashes of its distinct k-word shingles. Under any global order of shingles,
two sets that overlap by the threshold share one among their first few (their prefix). Three orders
are used: all take rare shingles first, by a count sketch of fixed size gathered from all documents,
and each breaks ties by a hash of its own. Documents that share a prefix shingle under the first
order are candidates; those that do not under the second and third, or whose sizes differ too much,
are dropped before any set is shipped; the rest is verified on the full sets.

Groups of any size cost no pairs within the group:

- Documents with equal sets are one node.
- Of the documents that share a prefix shingle, each is first compared with a few drawn ones only; a
  large group of near copies grows together in this. Verified links make components. Shingles whose
  documents are all in one component are finished.
- Where a shingle then still joins several components, the documents of different components are
  compared. Of the pairs that may link, each shingle gives only as many as join its components into as
  few families as they can: fewer than it has documents. Whatever links is of one family then. Parities
  say little of very large sets; their pairs are all verified instead.

Both happen inside tasks on bits: of a set's shingles, the parity in each of some hundred or thousand
cells. Two sets differ in as many shingles at least as their parities differ in cells, so pairs whose
parities differ in more than the threshold allows never become rows. A shingle that very many documents
have is dealt in blocks.

Links are then found and counted within each family, where all of them are: its different sets are dealt
into blocks by size and hash, every two blocks whose sizes allow a link meet in a task of their own, and
that compares all of their pairs and gives for each set a count, and the smallest document that links
join it with there. Pairs never become rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcount.llm.bytetext import SPACED, Words, grams, mix, signed, slices, tokenize
from fieldcount.llm.cells import SCHEMA, CellCounts, cell, gather, ranks
from fieldcount.llm.graph import components
from fieldcount.llm.sketch import Bloom, bloom
from fieldcount.llm.workers import small_batches, tidy
from fieldcount.session import materialize

#: Documents of a bucket that all others are compared with first.
DRAWN = 4
#: Documents of a bucket that meet in a task on average at most, of each of two blocks.
BUCKET = 1024
#: Longs of parities of a set, and of one of more than ``LONG_SET`` shingles.
PARITIES, MORE_PARITIES, LONG_SET = 8, 32, 384
#: Shingles of two sets together beyond which their parities say little.
WIDE = 4096
#: Sets, and shingles of them, that a block has on average at most.
BLOCK, BLOCK_SHINGLES = 256, 1 << 19

SALTS = (0x1B873593, 0x2545F491, 0x38495AB5)


def shingle_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each row; a row of fewer words is one shingle of them all."""
    values = grams(words.hash, k, salt=k)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= k:
            yield np.unique(values[a : b - k + 1])
        elif b > a:
            yield grams(words.hash[a:b], b - a, salt=b - a)
        else:
            yield np.zeros(0, np.uint64)


def prefix(shingles: np.ndarray, rank: np.ndarray, salt: int, percent: int) -> np.ndarray:
    """What a set must share one of with any set of that similarity, under the order of ``salt``."""
    n = len(shingles)
    if not n:
        return shingles
    few = n - (-(-percent * n // 100)) + 1
    order = mix(shingles ^ np.uint64(salt)) >> np.uint64(8) | rank[cell(shingles)].astype(np.uint64) << np.uint64(56)
    return shingles[np.argsort(order, kind="stable")[:few]]


def parities(shingles: np.ndarray) -> np.ndarray:
    """Whether the number of a set's shingles in each cell is odd, as bits."""
    longs = PARITIES if len(shingles) <= LONG_SET else MORE_PARITIES
    at = (mix(shingles ^ np.uint64(3)) & np.uint64(64 * longs - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=64 * longs) & 1).view(np.uint64)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def _counts(texts: DataFrame, k: int) -> np.ndarray:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = CellCounts()
        for batch in batches:
            for a, b in slices(batch["text"]):
                seen.add(grams(tokenize(batch["text"].slice(a, b - a), SPACED, lower=True).hash, k, salt=k))
        yield from seen.rows()

    return gather(texts.select("text").mapInArrow(run, SCHEMA))


def _profiles(texts: DataFrame, k: int, percent: int, rank) -> DataFrame:
    """Per document: size and signature of its set, and its prefix under the first order."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, one, two, first, odd = [], [], [], [], []
            for a, b in slices(batch["text"]):
                for s in shingle_sets(tokenize(batch["text"].slice(a, b - a), SPACED, lower=True), k):
                    size.append(len(s))
                    one.append(np.sum(mix(s ^ np.uint64(1)), dtype=np.uint64))
                    two.append(np.sum(mix(s ^ np.uint64(2)), dtype=np.uint64))
                    first.append(signed(prefix(s, rank.value, SALTS[0], percent)))
                    odd.append(parities(s).tobytes())
            columns = [batch["doc_id"], pa.array(size, pa.int64())]
            columns += [pa.array(signed(np.array(x, np.uint64))) for x in (one, two)]
            columns += [_lists(first, pa.int64()), pa.array(odd, pa.binary())]
            yield pa.record_batch(columns, names=["doc_id", "n", "one", "two", "prefix", "odd"])

    return texts.mapInArrow(run, f"doc_id {_kind(texts)}, n long, one long, two long, prefix array<long>, odd binary")


def _kind(texts: DataFrame) -> str:
    return texts.schema["doc_id"].dataType.simpleString()


def _those(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts of some documents; a filter of fixed size spares most others the shuffle."""
    wanted = texts.sparkSession.sparkContext.broadcast(bloom(ids.select(F.xxhash64("doc_id").alias("key")), "key"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(wanted.value.has(batch["key"].to_numpy()))).select(["doc_id", "text"])

    keyed = texts.select("doc_id", "text", F.xxhash64("doc_id").alias("key"))
    return keyed.mapInArrow(run, f"doc_id {_kind(texts)}, text string")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()


def _filters(texts: DataFrame, k: int, percent: int, rank) -> DataFrame:
    """Set sizes and prefixes under the other orders."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"]):
                sets = list(shingle_sets(tokenize(batch["text"].slice(a, b - a), SPACED, lower=True), k))
                # half of each hash will do here: a false match only passes the filter
                others = [
                    _lists([prefix(s, rank.value, salt, percent).astype(np.uint32).view(np.int32) for s in sets], pa.int32())
                    for salt in SALTS[1:]
                ]
                columns = [batch["doc_id"].slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), *others]
                yield pa.record_batch(columns, names=["doc_id", "n", "second", "third"])

    return texts.mapInArrow(run, f"doc_id {_kind(texts)}, n long, second array<int>, third array<int>")


def _similar(pairs: DataFrame, texts: DataFrame, k: int, percent: int, rank) -> DataFrame:
    """Those of the pairs (a, b) that are similar enough.

    The other orders' filters see small rows only; the texts of what passes follow.
    """
    filters = materialize(_filters(_those(texts, _ends(pairs)), k, percent, rank), "filters")

    def side(name: str) -> DataFrame:
        return filters.select(*[F.col(c).alias(name if c == "doc_id" else f"{name}_{c}") for c in filters.columns])

    left = (
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .filter(
            (100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))
            & F.arrays_overlap("a_second", "b_second")
            & F.arrays_overlap("a_third", "b_third")
        )
        .select("a", "b")
        .distinct()
    )
    left = materialize(left, "filtered")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sides = [shingle_sets(tokenize(part[c], SPACED, lower=True), k) for c in ("a_text", "b_text")]
                for x, y in zip(*sides):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    kind = _kind(texts)
    shipped = _those(texts, _ends(left))
    pairs_of_texts = left.join(shipped.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text")), "a").join(
        shipped.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text")), "b"
    )
    verified = pairs_of_texts.select("a", "b", "a_text", "b_text").mapInArrow(run, f"a {kind}, b {kind}")
    return materialize(verified, "similar")


def _with_any(profiles: DataFrame, known: Bloom) -> DataFrame:
    """A row for each prefix token that the filter may hold."""
    shared = profiles.sparkSession.sparkContext.broadcast(known)
    names = ["doc_id", "n", "one", "two"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch["prefix"].flatten().to_numpy()
            counts = np.diff(batch["prefix"].offsets.to_numpy())
            ok = np.flatnonzero(shared.value.has(tokens))
            row = pa.array(np.repeat(np.arange(len(counts)), counts)[ok])
            yield pa.record_batch([pa.array(tokens[ok]), *[batch[c].take(row) for c in names]], names=["token", *names])

    schema = f"token long, doc_id {_kind(profiles)}, n long, one long, two long"
    return profiles.select(*names, "prefix").mapInArrow(run, schema)


def _buckets(rows: DataFrame) -> DataFrame:
    """Tokens that several documents have, with the smallest of these."""
    ends = rows.groupBy("token").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    return ends.filter("least != most").select("token", "least")


def _still_apart(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Rows of the tokens whose documents the links do not join yet, with their components."""
    known = components(links).withColumnRenamed("node", "doc_id")
    placed = rows.join(known, "doc_id", "left").select(
        "token", "doc_id", "n", "one", F.coalesce("component", "doc_id").alias("component")
    )
    placed = materialize(placed, "placed")
    ends = placed.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y"))
    return materialize(placed.join(ends.filter("x != y").select("token"), "token", "left_semi"), "open-rows")


def _may_link(i: np.ndarray, j: np.ndarray, n: np.ndarray, words: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the pairs of rows are of like size and have parities that do not rule a link out."""
    ok = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
    few, more, first, is_long = words
    for at in range(0, len(i), 1 << 16):
        part = np.flatnonzero(ok[at : at + (1 << 16)]) + at
        for long in (False, True):
            # a set that is not long has no more than its few parities
            both = is_long[i[part]] & is_long[j[part]]
            some = part[both] if long else part[~both]
            own, place = (more, first) if long else (few, np.arange(len(n)))
            apart = np.bitwise_count(own[place[i[some]]] ^ own[place[j[some]]]).sum(1, dtype=np.int64)
            ok[some] = (100 + percent) * apart <= (100 - percent) * (n[i[some]] + n[j[some]])
    return ok


def _joined(tree: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the edges between the trees x and y join two; ``tree`` has the smallest of each after."""
    used = np.zeros(len(x), bool)
    for e, (u, v) in enumerate(zip(x.tolist(), y.tolist())):
        while tree[u] != u:
            u = tree[u]
        while tree[v] != v:
            v = tree[v]
        if u != v:
            used[e] = True
            tree[max(u, v)] = min(u, v)
    while (tree[tree] != tree).any():
        tree[:] = tree[tree]
    return used


def _pairs_of(given: pa.Table, percent: int, every: bool, joining: bool) -> pa.Table:
    """Pairs (a, b) of rows of whole groups that may link: all, or those with a group's first rows.

    For ``joining``, of all only so many as join whatever all of them join, and every pair of large sets
    that these do not join; ``wide`` tells the latter.
    """
    group, side, n = (given[c].to_numpy() for c in ("group", "side", "n"))
    ids, own = given["doc_id"].combine_chunks(), given["component"].combine_chunks().dictionary_encode().indices.to_numpy()
    odd = [np.frombuffer(x.as_buffer(), np.uint64) for x in given["odd"].combine_chunks()]
    is_long = np.array([len(x) > PARITIES for x in odd], bool)
    # cells are numbered from the left of a byte: a long set's parities fold to the few by the low bits of the cell
    few = np.stack([np.bitwise_xor.reduce(x.reshape(-1, PARITIES), 0) for x in odd])
    more = np.stack([x for x in odd if len(x) > PARITIES]) if is_long.any() else np.zeros((0, MORE_PARITIES), np.uint64)
    words = [few, more, np.cumsum(is_long) - 1, is_long]
    begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(begins, len(group)))
    end = np.repeat(begins + size, size)
    found = []
    if every:
        # components of one group are trees that its pairs join
        own = np.unique(np.stack([np.repeat(begins, size), own], 1), axis=0, return_inverse=True)[1].reshape(-1)
        tree = np.arange(len(group))
        i, step = np.arange(len(group)), 1
        while len(i := i[i + step < end[i]]):
            x, y = _chosen(i, i + step, tree[own], side, n, words, percent)
            if joining and len(x):
                used = n[x] + n[y] > WIDE
                used[~used] = _joined(tree, tree[own[x[~used]]], tree[own[y[~used]]])
                x, y = x[used], y[used]
            found.append((x, y))
            step += 1
    else:
        j = np.arange(len(group))
        for step in range(DRAWN):
            i = np.repeat(begins + step, size)
            later = j > i
            found.append(_chosen(i[later], j[later], own, side, n, words, percent))
    i, j = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))
    columns = [ids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(n[i] + n[j] > WIDE)]
    return pa.table(columns, names=["a", "b", "wide"])


def _chosen(i, j, own, side, n, words, percent) -> tuple[np.ndarray, np.ndarray]:
    ok = (own[i] != own[j]) & ((side[i] == 0) | (side[i] != side[j]))
    i, j = i[ok], j[ok]
    ok = _may_link(i, j, n, words, percent)
    return i[ok], j[ok]


def _candidates(rows: DataFrame, bits: DataFrame, percent: int, every: bool, joining: bool = False) -> DataFrame:
    """Distinct pairs (a, b) of documents that share a token and may link, of different components.

    All of them, or those with some drawn documents of each bucket (or block of it). For ``joining``,
    (a, b, wide): of all but those of large sets only so many as join whatever all of a bucket join,
    fewer than it has rows.
    """
    sizes = rows.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / BUCKET).alias("blocks")).filter("blocks > 1")
    dealt = rows.join(sizes, "token", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)).cast("long"))
    block = F.pmod(F.xxhash64("doc_id", "n"), F.col("blocks"))
    others = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1) if every else F.array(block)
    tasks = F.transform(
        others,
        lambda k: F.struct(
            F.least(block, k).alias("p"), F.greatest(block, k).alias("q"), F.signum(block - k).cast("int").alias("side")
        ),
    )
    dealt = dealt.join(bits, ["doc_id", "n", "one"]).select("token", "doc_id", "n", "component", "odd", F.inline(tasks))
    kind = rows.schema["doc_id"].dataType.simpleString()
    # a hash for the group: two groups that share one only give more candidates to verify
    dealt = dealt.select(F.xxhash64("token", "p", "q").alias("group"), "side", "doc_id", "n", "component", "odd")
    dealt = dealt.repartition("group").sortWithinPartitions("group", F.xxhash64("doc_id", F.lit(0)))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch["group"].to_numpy()
            last = int(np.searchsorted(group, group[-1]))
            if last or (rest and rest[-1]["group"][-1].as_py() != group[0]):
                whole = pa.Table.from_batches([*rest, batch.slice(0, last)])
                rest = []
                yield from _pairs_of(whole, percent, every, joining).to_batches()
            rest.append(batch.slice(last))
        if rest:
            yield from _pairs_of(pa.Table.from_batches(rest), percent, every, joining).to_batches()

    pairs = dealt.mapInArrow(run, f"a {kind}, b {kind}, wide boolean")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "wide")
    return (pairs if joining else pairs.drop("wide")).distinct()


def _overlaps(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """How many values each set of ``one`` has in common with each of ``two``."""
    sides = [np.concatenate(x) for x in (one, two)]
    common = np.intersect1d(*sides)
    out = np.zeros((len(one), len(two)), np.int64)
    placed = []
    for sets, values in zip((one, two), sides):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(common, values)
        ok = at < len(common)
        ok[ok] = common[at[ok]] == values[ok]
        order = np.argsort(at[ok], kind="stable")
        placed.append((row[ok][order], at[ok][order]))
    width = 1 << 12
    for begin in range(0, len(common), width):
        dense = []
        for sets, (row, at) in zip((one, two), placed):
            a, b = np.searchsorted(at, [begin, begin + width])
            has = np.zeros((len(sets), min(width, len(common) - begin)), np.float32)
            has[row[a:b], at[a:b] - begin] = 1
            dense.append(has)
        out += (dense[0] @ dense[1].T).astype(np.int64)
    return out


def _least_joined(near: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The smallest row that the links between the rows ``left`` and ``right`` join each of n rows with."""
    least, before = np.arange(n), None
    while before is None or (least != before).any():
        before = least.copy()
        least[left] = np.minimum(least[left], np.where(near, least[right][None], n).min(1))
        least[right] = np.minimum(least[right], np.where(near, least[left][:, None], n).min(0))
    return least


def _links_of(given: pa.Table, k: int, percent: int) -> pa.Table:
    """Per set of one or two blocks the number of its links to sets of the other, or of the same.

    Also its document, and the first of the task's documents that these links join it with.
    """
    names = ["n", "one", "two"]
    keys = np.stack([given[c].to_numpy() for c in names], 1)
    chosen = np.sort(np.unique(keys, axis=0, return_index=True)[1])
    given, keys = given.take(pa.array(chosen)), keys[chosen]
    order = pa.compute.sort_indices(given["doc_id"])
    given, keys = given.take(order), keys[order.to_numpy()]
    ids = given["doc_id"].combine_chunks().dictionary_encode().indices.to_numpy()
    text = given["text"].combine_chunks()
    sets = [s for a, b in slices(text) for s in shingle_sets(tokenize(text.slice(a, b - a), SPACED, lower=True), k)]
    side = given["side"].to_numpy()
    left = np.flatnonzero(side <= 0)
    right = np.flatnonzero(side >= 0)
    links, least = np.zeros(len(sets), np.int64), np.arange(len(sets))
    if len(left) and len(right):
        both = _overlaps([sets[i] for i in left], [sets[i] for i in right])
        n = keys[:, 0]
        near = 100 * both >= percent * (n[left][:, None] + n[right][None] - both)
        near &= ids[left][:, None] != ids[right][None]
        links[left] = near.sum(1)
        if (side != 0).any():
            links[right] = near.sum(0)
        least = _least_joined(near, left, right, len(sets))
    kept = links > 0
    columns = [*[pa.array(keys[kept, i]) for i in range(3)], pa.array(links[kept])]
    columns += [given["doc_id"].take(pa.array(np.flatnonzero(kept))), given["doc_id"].take(pa.array(least[kept]))]
    return pa.table(columns, names=[*names, "n_links", "a", "b"])


def _counted_links(members: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(n, one, two, n_links, a, b) of the different sets (n, one, two, rep, component, sure) that link.

    A set has a row from each task in which it has links; ``b`` is a document that links join its own
    document ``a`` with. Two sets alone in a component need no comparing if their link is ``sure``.

    Classes of sizes are a little wider than what the threshold allows, so sets that link are of the
    same class or of neighbouring ones.
    """
    names = ["n", "one", "two"]
    totals = members.groupBy("component").agg((F.min("sure") & (F.count(F.lit(1)) == 2)).alias("pair"))
    known = members.join(totals, "component")
    pairs = known.filter("pair").select(*names, F.lit(1).cast("long").alias("n_links"), F.col("rep").alias("a"), F.col("component").alias("b"))
    step = float(np.log(1.001 * 100 / percent))
    many = known.filter("NOT pair").withColumn("class", F.floor(F.log("n") / step))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("long")
    groups = materialize(many.groupBy("component", "class").agg(blocks.alias("blocks")), "size-blocks")

    def of(shift: int, name: str) -> DataFrame:
        return groups.select("component", (F.col("class") - shift).alias("class"), F.col("blocks").alias(name))

    def tasks(number, low, mine, theirs, side):
        every = F.when(number.isNotNull(), F.sequence(F.lit(0).cast("long"), number - 1))
        one = F.transform(every, lambda j: F.struct(low.alias("low"), mine(j).alias("p"), theirs(j).alias("q"), side(j).alias("side")))
        return F.coalesce(one, F.array())

    block, size = F.col("block"), F.col("class")
    own = tasks(
        F.col("blocks"), 2 * size, lambda j: F.least(block, j), lambda j: F.greatest(block, j),
        lambda j: F.signum(block - j).cast("int"),
    )
    above = tasks(F.col("above"), 2 * size + 1, lambda j: block, lambda j: j, lambda j: F.lit(-1))
    below = tasks(F.col("below"), 2 * size - 1, lambda j: j, lambda j: block, lambda j: F.lit(1))
    dealt = many.join(groups, ["component", "class"]).join(of(1, "above"), ["component", "class"], "left")
    dealt = dealt.join(of(-1, "below"), ["component", "class"], "left")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(*names), F.col("blocks")))
    dealt = materialize(
        dealt.select(*names, F.col("rep").alias("doc_id"), "component", F.concat(own, above, below).alias("tasks")), "dealt-sets"
    )

    @tidy
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"]):
                part = batch.slice(a, b - a)
                sets = list(shingle_sets(tokenize(part["text"], SPACED, lower=True), k))
                columns = [pa.array([len(s) for s in sets], pa.int64())]
                for salt in (1, 2):
                    each = [np.sum(mix(s ^ np.uint64(salt)), dtype=np.uint64) for s in sets]
                    columns.append(pa.array(signed(np.array(each, np.uint64))))
                yield pa.record_batch([part["doc_id"], part["text"], *columns], names=["doc_id", "text", *names])

    signed_texts = _those(texts, dealt.select("doc_id").distinct()).mapInArrow(
        sign, f"doc_id {_kind(texts)}, text string, n long, one long, two long"
    )
    rows = signed_texts.join(dealt, ["doc_id", *names]).select("*", F.inline("tasks")).drop("tasks")
    counted = rows.groupBy("component", "low", "p", "q").applyInArrow(
        lambda given: _links_of(given, k, percent),
        f"n long, one long, two long, n_links long, a {_kind(texts)}, b {_kind(texts)}",
    )
    return materialize(pairs.unionByName(counted), "counted-links")


def near_duplicates(
    docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, n_equal, n_links.

    Two documents link when their sets of k-word shingles have a Jaccard similarity of ``percent``
    or more; ``component_id`` is the smallest id reachable by links. Words are runs of anything but
    ASCII white space, with A-Z in lower case. A document of fewer words has one shingle of all its
    words; null, empty and blank texts have none, link with nothing and keep their own id.
    ``n_equal`` is the number of documents with the same set, ``n_links`` the number of different sets
    that this one links with. Rows that share an id are one document with several texts; rows
    without an id link with nothing. Other columns are not looked at.
    """
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, k, percent, id_col, text_col)


def _near_duplicates(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rank = docs.sparkSession.sparkContext.broadcast(ranks(_counts(texts, k)))
    profiles = materialize(_profiles(texts, k, percent, rank), "profiles")
    linkable = profiles.filter("n > 0 AND doc_id IS NOT NULL")
    equal = materialize(
        linkable.groupBy("n", "one", "two").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_equal")),
        "equal-sets",
    )
    tokens = _buckets(linkable.select(F.explode("prefix").alias("token"), "doc_id"))
    tokens = materialize(tokens.select("token"), "shared-tokens")
    # of documents with equal sets, one stands for all
    chosen = equal.select("n", "one", "two", F.col("rep").alias("doc_id"))
    shared = _with_any(linkable, bloom(tokens, "token")).join(chosen, ["n", "one", "two", "doc_id"], "left_semi")
    shared = materialize(shared.select("token", "doc_id", "n", "one"), "token-rows")
    rows = materialize(shared.join(_buckets(shared), "token").drop("least"), "bucket-rows")
    bits = linkable.join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
    bits = materialize(bits.groupBy("doc_id", "n", "one").agg(F.min("odd").alias("odd")), "parities")
    alone = rows.withColumn("component", F.col("doc_id"))
    first = materialize(_candidates(alone, bits, percent, every=False), "first-pairs")
    links = _similar(first, texts, k, percent, rank)
    pairs = materialize(_candidates(_still_apart(rows, links), bits, percent, every=True, joining=True), "bridges")
    wide = pairs.filter("wide").select("a", "b").join(first, ["a", "b"], "left_anti")
    links = links.unionByName(_similar(materialize(wide, "wide-pairs"), texts, k, percent, rank))
    bridges = pairs.filter("NOT wide").select("a", "b")
    families = components(links.unionByName(bridges)).select(F.col("node").alias("rep"), "component")
    unsure = bridges.select(F.explode(F.array("a", "b")).alias("rep"), F.lit(False).alias("sure")).distinct()
    members = equal.drop("n_equal").join(families, "rep").join(unsure, "rep", "left")
    members = materialize(members.withColumn("sure", F.coalesce("sure", F.lit(True))), "families")
    counted = _counted_links(members, texts, k, percent)
    found = components(links.unionByName(counted.select("a", "b"))).select(F.col("node").alias("rep"), "component")
    counts = counted.groupBy("n", "one", "two").agg(F.sum("n_links").alias("n_links"))
    groups = equal.join(found, "rep", "left").join(counts, ["n", "one", "two"], "left")
    return profiles.join(groups, ["n", "one", "two"], "left").select(
        F.col("doc_id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"),
        F.coalesce("n_equal", F.lit(1).cast("long")).alias("n_equal"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )
