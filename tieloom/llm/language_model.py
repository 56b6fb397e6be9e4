"""A hierarchical Pitman-Yor language model over words, sampled by Gibbs.

Tokens are lower-cased words and one end per text; two begins stand before a text. The restaurants: one for each
pair of last two words, whose parent is the one of the last word, whose parent is the root, whose base is uniform
over the V training tokens and one for all unknown words. What follows a word is learned for every word and pair.

The state is dealt by context. A block holds restaurants of last words with all those of pairs below them, so two levels of
a sweep stay inside a task. Words are dealt into shards for the root. A block sends each shard the tables of its words,
a shard answers with what the root knows of them, and only these numbers cross. Last words that are common in a sample of
the texts would make hot blocks: their pairs are spread over blocks by the word before, and their own restaurant is
held by the shards, beside the root, dish by dish. The sample places rows and decides nothing else.

1. Tokens of all texts are dealt to blocks once, as (last two words, word, text). There each distinct one becomes a cell with its
   count in training texts, and the tokens of a text become numbers of cells.
2. Sweeps. A block keeps what can change: cells that occur more than once and dishes with more than one customer, beside the
   number of others. Blocks, then shards, seat the customers of each dish anew, from the leaves to
   the root: the n-th customer of a dish with t tables opens a table with odds (strength + discount
   x tables of the restaurant) x parent's probability to n - 1 - discount x t. Tables are the
   customers of the parent. Restaurant totals and the parent's probabilities are those of the last sweep, as in distributed
   samplers. Beyond 64 customers of a dish, seats are drawn in blocks. Draws depend on block or shard and sweep
   only, so a lost one is drawn alike, and a later job repeats the earlier sweeps from the first state and the stored answers.
3. Scores: probabilities of the cells are averaged over the sweeps after burn-in, and summed per text.

Discounts are estimated from counts of counts, strengths are parameters. All counts cover all
training texts. Null texts are empty: one end token. Rows of equal id are scored together as one
result, rows with a null id likewise and are not learned from. Further columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieloom.llm.tables import in_small_batches
from tieloom.llm.words import Words, mix, slices
from tieloom.sources.bucketed import bucketed
from tieloom.staging import staged

END = np.uint64(0x0E9D0E9D0E9D0E9D)
BEGIN = np.uint64(0xBE61BE61BE61BE61)
HOT = 2048
GROUP_TOKENS = 1_500_000
SLICE_BYTES = 4 << 20
#: Texts by which common words are found, about, and how many of these are listed.
SAMPLE_TEXTS = 16_000
COMMON = 1 << 18
SWEEPS, BURN_IN = 3, 1
STRENGTH = 1.0


NO_WORDS = np.zeros(0, np.uint64)


def _pack(*arrays: np.ndarray, common: np.ndarray = NO_WORDS) -> bytes:
    """Arrays as bytes, each place of their numbers compressed by itself. Of hashes, the place in ``common`` for those that are there,
    and the others; of both the differences, as those of sorted ones have less to tell."""
    compressor = zstandard.ZstdCompressor(level=1)

    def planes(a: np.ndarray):
        by_byte = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
        return a.dtype.str, len(a), [compressor.compress(p.tobytes()) for p in by_byte] if len(a) else []

    def hashes(a: np.ndarray):
        at = np.searchsorted(common, a).clip(max=max(len(common) - 1, 0))
        known = common[at] == a if len(common) else np.zeros(len(a), bool)
        return [planes(x) for x in (np.packbits(known), np.diff(at[known].astype(np.int32), prepend=np.int32(0)), np.diff(a[~known], prepend=np.uint64(0)))]

    return pickle.dumps([hashes(a) if a.dtype == np.uint64 else planes(a) for a in arrays], 5)


def _unpack(blob: bytes, common: np.ndarray = NO_WORDS) -> list[np.ndarray]:
    decompressor = zstandard.ZstdDecompressor()

    def whole(kind: str, n: int, planes: list[bytes]) -> np.ndarray:
        by_byte = np.frombuffer(b"".join(map(decompressor.decompress, planes)), np.uint8).reshape(-1, n) if n else np.zeros((1, 0), np.uint8)
        return np.array(by_byte.T, order="C").view(kind).ravel() if n else np.zeros(0, kind)

    def hashes(known, at, others) -> np.ndarray:
        at, others = np.cumsum(whole(*at), dtype=np.int64), np.cumsum(whole(*others), dtype=np.uint64)
        out = np.empty(len(at) + len(others), np.uint64)
        known = np.unpackbits(whole(*known), count=len(out)).astype(bool)
        out[known], out[~known] = common[at], others
        return out

    return [hashes(*a) if isinstance(a, list) else whole(*a) for a in pickle.loads(blob)]


def _narrow(a: np.ndarray) -> np.ndarray:
    """The numbers, none below 0, in the fewest bytes that hold all; never in the type of hashes."""
    kind = np.min_scalar_type(int(a.max()) if len(a) else 0)
    return a.astype(np.int64 if kind == np.uint64 else kind)


def _pairs(size: int, last: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Sorted pairs of numbers below ``size`` as their differences."""
    return _narrow(np.diff(last.astype(np.int64) * size + before, prepend=0))


def _unpaired(size: int, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.divmod(np.cumsum(steps, dtype=np.int64), size)


def _starts(*keys: np.ndarray) -> np.ndarray:
    n = len(keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _sizes(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, values, n)[:n].astype(np.int64) if n else np.zeros(0, np.int64)


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each token of the texts, of the word before it and of the one before that, and its text's number."""
    words = Words(texts)
    docs = len(words.first) - 1
    counts = words.counts()
    token = np.full(len(words) + docs, END, np.uint64)
    token[np.arange(len(words)) + np.repeat(np.arange(docs), counts)] = words.hashes()
    begin = words.first[:-1] + np.arange(docs)
    last, before = np.full(len(token), BEGIN), np.full(len(token), BEGIN)
    last[1:], before[2:] = token[:-1], token[:-2]
    last[begin] = BEGIN
    before[begin] = BEGIN
    before[(begin + 1)[counts > 0]] = BEGIN
    return token, last, before, np.repeat(np.arange(docs), counts + 1)


def _group(token: np.ndarray, groups: int) -> np.ndarray:
    return ((mix(token) >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)


def _sorted_by(size: int, *keys: np.ndarray) -> np.ndarray:
    """Order by the keys, numbers below ``size``, the first first."""
    if float(size) ** len(keys) >= 2**63:
        return np.lexsort(keys[::-1])
    whole = keys[0].astype(np.int64)
    for k in keys[1:]:
        whole = whole * size + k
    return np.argsort(whole, kind="stable")


@dataclass
class Places:
    """Where cells are: number of ``groups``, and the last words whose pairs are spread over ``parts`` blocks. Words that are
    ``common``, sorted, are written as their number there; others as hashes."""

    groups: int
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    parts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    common: np.ndarray = field(default_factory=lambda: NO_WORDS)

    def hot_number(self, word: np.ndarray) -> np.ndarray:
        """1 and more for words that are spread, 0 for others."""
        if not len(self.hot):
            return np.zeros(len(word), np.int64)
        at = np.searchsorted(self.hot, word).clip(max=len(self.hot) - 1)
        return np.where(self.hot[at] == word, at + 1, 0)

    def block(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        parts = np.append(np.int64(1), self.parts)[self.hot_number(last)]
        return _group(last + (mix(before) % parts.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15), self.groups)


def places(docs: DataFrame, groups: int | None = None) -> Places:
    """The words that would fill a good part of a block by themselves, and the common ones, in a sample of the texts; a group per
    ``GROUP_TOKENS`` if not given."""
    size, texts = docs.agg(F.sum(F.octet_length("text")).cast("long"), F.count("*")).first()
    groups = groups or max(48, (size or 0) // 6 // GROUP_TOKENS)  # some six bytes a word

    def count(batches):
        for batch in gathered(batches, 0):
            word, n = np.unique(tokens_of(batch.column(0))[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["w", "n"])

    share = min(1.0, SAMPLE_TEXTS / max(texts, 1))
    chosen = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    counted = staged(chosen.mapInArrow(count, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n")), "sample")
    total = counted.agg(F.sum("n")).first()[0] or 0
    top = counted.orderBy(F.desc("n"), "w").limit(COMMON).toArrow()
    w, n = top["w"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(w)
    w, n = w[order], n[order]
    hot = n * 4 * groups > total
    return Places(groups, w[hot], -(-n[hot] * 4 * groups // max(total, 1)), np.unique(np.append(w, END)))


def gathered(batches, column: int):
    """Batches put together, or cut, to some ``SLICE_BYTES`` of text each, so that few are small."""
    kept, size = [], 0
    for batch in slices(batches, column, SLICE_BYTES):
        own = pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if kept and size + own > SLICE_BYTES:
            yield from pa.Table.from_batches(kept).combine_chunks().to_batches()
            kept, size = [], 0
        kept.append(batch)
        size += own
    if kept:
        yield from pa.Table.from_batches(kept).combine_chunks().to_batches()


def dealt_blocks(docs: DataFrame, place: Places) -> DataFrame:
    """``g, cells, ids, asks``, written in buckets: the cells of each block, and the tokens of its texts as numbers of cells."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def deal(batches):
        for batch in gathered(batches, 1):
            token, last, before, owner = tokens_of(batch.column(1))
            learned = ~batch.column(2).to_numpy(zero_copy_only=False)
            group = place.block(last, before)
            words, number = np.unique(np.concatenate([token, [BEGIN]]), return_inverse=True)
            begin, number = number[-1], number[:-1].astype(np.int32)
            one, two = np.full(len(token), begin, np.int32), np.full(len(token), begin, np.int32)
            one[1:], two[2:] = number[:-1], number[:-2]
            one[last == BEGIN] = begin
            two[before == BEGIN] = begin
            del last, before
            order = np.argsort(group.astype(np.uint16 if place.groups < 1 << 16 else np.int64), kind="stable")
            first = _starts(group[order])
            out = [], [], []
            ids = batch.column(0).to_pylist()
            for i, j in zip(first, np.append(first[1:], len(order)), strict=False):
                own = order[i:j]
                used, at = np.unique(np.concatenate([one[own], two[own], number[own]]), return_inverse=True)
                a, b, c = at.reshape(3, -1)
                by = _sorted_by(len(used), a, b, c)
                present, local = np.unique(owner[own][by], return_inverse=True)
                out[0].append(int(group[own[0]]))
                out[1].append([ids[k] for k in present])
                out[2].append(_pack(words[used], _pairs(len(used), a[by], b[by]), _narrow(c[by]), _narrow(local), learned[present], common=place.common))
            kind = pa.list_(batch.schema.field(0).type)
            del token, number, one, two, owner, group, order
            for i in range(0, len(out[0]), 16):  # an executor holds what comes back in buffers twice its size
                yield pa.RecordBatch.from_arrays([pa.array(o[i : i + 16], k) for o, k in zip(out, (pa.int32(), kind, pa.binary()), strict=True)], ["g", "ids", "blob"])

    def merge(table: pa.Table) -> pa.Table:
        parts = [_unpack(b, place.common) for b in table["blob"].to_pylist()]
        words = np.unique(np.concatenate([p[0] for p in parts]))
        keys = [], [], []
        for p in parts:
            at = np.searchsorted(words, p[0]).astype(np.int32)
            for column, k in zip(keys, (*_unpaired(len(at), p[1]), p[2]), strict=True):
                column.append(at[k])
        ids = pa.concat_arrays([c.flatten() for c in table["ids"].chunks])
        offset = np.cumsum([0, *[len(p[4]) for p in parts]])
        owner = np.concatenate([p[3].astype(np.int32) + np.int32(o) for p, o in zip(parts, offset[:-1], strict=True)])
        learned = np.concatenate([p[4] for p in parts])
        last, before, token = map(np.concatenate, keys)
        del parts, keys
        order = _sorted_by(len(words), last, before, token)
        last, before, token, owner = last[order], before[order], token[order], owner[order]
        first = _starts(last, before, token)
        n = np.add.reduceat(learned[owner].astype(np.int64), first)
        cells = _pack(words, _pairs(len(words), last[first], before[first]), _narrow(token[first]), _narrow(n), common=place.common)
        asks = _pack(_narrow(_sizes(first, len(owner))), _narrow(owner))
        lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.table({"g": pa.array([table["g"][0].as_py()], pa.int32()), "cells": pa.array([cells], pa.binary()), "ids": lists, "asks": pa.array([asks], pa.binary())})

    rows = docs.select("doc_id", "text", "held_out").mapInArrow(deal, f"g int, ids array<{key}>, blob binary")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bucketed(rows.repartition(tasks, "g").groupBy("g").applyInArrow(merge, f"g int, cells binary, ids array<{key}>, asks binary"), "g", "blocks", dealt=True)


@dataclass
class Totals:
    """What couples blocks and shards. Each state, the one before the first sweep included, has the ``customers`` and ``tables``
    of the root and then of each last word that is spread."""

    place: Places
    seed: int = 1
    strength: float = STRENGTH
    tokens: int = 0
    types: int = 0
    discount: tuple[float, float, float] = (0.5, 0.5, 0.5)
    customers: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)

    def backoff(self, level: int, tables, customers):
        return (self.strength + self.discount[level] * tables) / (self.strength + customers)

    def held(self, level: int, customers, tables, room):
        return (customers - self.discount[level] * tables) / (self.strength + room)

    def root(self, s: int, c0: np.ndarray, t0: np.ndarray) -> np.ndarray:
        """Probability at the root of words with these customers and tables, in state ``s``."""
        c, t = self.customers[s][0], self.tables[s][0]
        return self.held(2, c0, t0, c) + self.backoff(2, t, c) / (self.types + 1)


def seat(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after its customers have come one by one. ``weight`` is the strength
    of a new table: (strength + discount x tables) x the parent's probability."""
    tables = np.minimum(customers, 1).astype(np.int64)
    several = np.flatnonzero(customers > 1)
    several = several[np.argsort(-customers[several], kind="stable")]
    c, w, t = customers[several], weight[several], tables[several]
    rising = c[::-1]
    n = 1
    while True:
        active = len(c) - int(np.searchsorted(rising, n, side="right"))
        if not active:
            break
        block = 1 if n < 64 else n // 4
        now, k = t[:active], w[:active]
        if block == 1:
            now += rng.random(active) * (k + n - discount * now) < k
        else:
            come = np.minimum(block, c[:active] - n)
            now += rng.binomial(come, k / (k + n + come / 2 - discount * now))
        n += block
    tables[several] = t
    return tables


def counts_of_counts(*levels: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for n in levels for k in (1, 2)]


def _renumbered(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that occur, and their places in these."""
    return np.unique(at, return_inverse=True)


class Block:
    """Restaurants of pairs of words, and of the last words that are not spread.

    A dish is a word after a last word. Its entry is what the shards are told and asked of it: of a last word that is
    spread the dish itself, else the word. Entries are in order of their shards. ``rest`` has what cells and dishes that were
    left out, as they never change, add to the tables of pairs, the customers of dishes, those and the tables of last words, and
    to entries.
    """

    def __init__(self, g: int, totals: Totals, n, pair, dish, last, hot, entry, shard, rest):
        self.g, self.totals = g, totals
        self.n, self.pair, self.dish, self.last, self.hot, self.entry = (np.asarray(x).astype(np.int64) for x in (n, pair, dish, last, hot, entry))
        self.shard, self.rest = shard, [np.asarray(x).astype(np.int64) for x in rest]
        self._seated(np.minimum(self.n, 1))
        self.t1 = np.minimum(self.c1, 1)

    @classmethod
    def whole(cls, g: int, blob: bytes, totals: Totals) -> Block:
        words, pairs, token, n = _unpack(blob, totals.place.common)
        size = len(words)
        last, before = _unpaired(size, pairs)
        at2, at1 = _starts(last, before), _starts(last)
        dishes, dish = np.unique(last * size + token, return_inverse=True)
        lasts = last[at1]
        of = np.searchsorted(lasts, dishes // size)
        hot = totals.place.hot_number(words[lasts])[of]
        entries, entry = np.unique(hot * size + dishes % size, return_inverse=True)
        word = words[entries % size]
        shard = _group(word, totals.place.groups)
        order = np.argsort(shard, kind="stable")
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        rest = [np.zeros(k, np.int64) for k in (len(at2), len(dishes), len(lasts), len(lasts), len(entries))]
        block = cls(g, totals, n, np.repeat(np.arange(len(at2)), _sizes(at2, len(n))), dish, of, hot, back[entry], shard[order], rest)
        block.words, block.token, block.last_word, block.before = words, token, last, before
        block.entry_word, block.entry_hot = word[order], (entries // size)[order]
        block.many = block.n > 1
        block.active = (_sums(block.dish, block.many, len(dishes)) > 0) | (block.c1 > 1)
        block.asked = _sums(block.entry, block.active, len(entries)) > 0
        return block

    def thin(self) -> bytes:
        """What can change, packed: cells with several customers, dishes that have such or several cells, their entries."""
        cell, dish, entry = (np.flatnonzero(x) for x in (self.many, self.active, self.asked))
        pairs, pair = _renumbered(self.pair[cell])
        lasts, last = _renumbered(self.last[dish])
        out = ~self.active
        rest = (
            _sums(self.pair, self.n == 1, len(self.rest[0]))[pairs], _sums(self.dish, self.n == 1, len(self.c1))[dish],
            _sums(self.last[out], self.c1[out], len(self.rest[2]))[lasts], _sums(self.last[out], self.t1[out], len(self.rest[3]))[lasts],
            _sums(self.entry[out], np.where(self.hot > 0, self.c1, self.t1)[out], len(self.shard))[entry],
        )
        arrays = (self.n[cell], pair, np.searchsorted(dish, self.dish[cell]), last, self.hot[dish], np.searchsorted(entry, self.entry[dish]), self.shard[entry], *rest)
        return _pack(*map(_narrow, arrays))

    @classmethod
    def thinned(cls, g: int, blob: bytes, totals: Totals) -> Block:
        n, pair, dish, last, hot, entry, shard, *rest = _unpack(blob)
        return cls(g, totals, n, pair, dish, last, hot, entry, shard, rest)

    def _seated(self, t2: np.ndarray) -> None:
        self.t2 = t2
        self.c1 = self.rest[1] + _sums(self.dish, t2, len(self.rest[1]))

    def put(self, t2: np.ndarray, t1: np.ndarray) -> None:
        """Takes over the seats of the thinned block."""
        seats = np.minimum(self.n, 1)
        seats[self.many] = t2
        self._seated(seats)
        self.t1 = np.minimum(self.c1, 1)
        self.t1[self.active] = t1

    def told(self) -> np.ndarray:
        """Customers that each entry brings to its shard."""
        return self.rest[4] + _sums(self.entry, np.where(self.hot > 0, self.c1, self.t1), len(self.shard))

    def levels(self, s: int, heard: list[np.ndarray]):
        """Probability of each dish in its last word's restaurant, that of its word at the root, and that restaurant's tables."""
        t = self.totals
        c0, t0, c1, t1 = (a.astype(np.int64)[self.entry] for a in heard)
        p0 = t.root(s, c0, t0)
        spread = self.hot > 0
        customers, tables = (
            np.where(spread, whole[s][self.hot], (rest + _sums(self.last, own, len(rest)))[self.last])
            for whole, own, rest in ((t.customers, self.c1, self.rest[2]), (t.tables, self.t1, self.rest[3]))
        )
        c1, t1 = np.where(spread, c1, self.c1), np.where(spread, t1, self.t1)
        return t.held(1, c1, t1, customers) + t.backoff(1, tables, customers) * p0, p0, tables

    def tables2(self) -> np.ndarray:
        return (self.rest[0] + _sums(self.pair, self.t2, len(self.rest[0])))[self.pair]

    def sweep(self, s: int, heard: list[np.ndarray]) -> None:
        t, rng = self.totals, np.random.default_rng([self.totals.seed, 0, self.g, s])
        p1, p0, tables1 = self.levels(s, heard)
        self._seated(seat(self.n, (t.strength + t.discount[0] * self.tables2()) * p1[self.dish], t.discount[0], rng))
        self.t1 = seat(self.c1, (t.strength + t.discount[1] * tables1) * p0, t.discount[1], rng)

    def probability(self, s: int, heard: list[np.ndarray]) -> np.ndarray:
        """Probability of each cell of a whole block in state ``s``."""
        t, p1 = self.totals, self.levels(s, heard)[0][self.dish]
        room = _sums(self.pair, self.n, len(self.rest[0]))[self.pair]
        return t.held(0, self.n, self.t2, room) + t.backoff(0, self.tables2(), room) * p1


class Shard:
    """The root's dishes of some words, and the dishes of spread last words that are these words."""

    def __init__(self, g: int, told: list[tuple[int, list[np.ndarray]]], totals: Totals):
        """``told`` has what each block said first: words, numbers of spread last words, customers, counts, and if it will ask again."""
        self.g, self.totals = g, totals
        self.blocks = [b for b, _ in told]
        self.ends = np.cumsum([0, *[len(x[0]) for _, x in told]])
        word, hot, first, count, asked = (np.concatenate(c) for c in zip(*[x for _, x in told], strict=True))
        self.first, self.asked = first.astype(np.int64), asked.astype(bool)
        self.words, self.word = np.unique(word, return_inverse=True)
        self.count = _sums(self.word, count, len(self.words))
        self.spread = hot > 0
        size = len(self.words)
        dishes, self.dish = np.unique(hot[self.spread].astype(np.int64) * size + self.word[self.spread], return_inverse=True)
        self.hot, self.dish_word = dishes // size, dishes % size

    def take(self, s: int, customers: np.ndarray) -> None:
        """State ``s`` from the customers that the blocks bring in it."""
        t, rng = self.totals, np.random.default_rng([self.totals.seed, 1, self.g, s])
        self.c1 = _sums(self.dish, customers[self.spread], len(self.hot))
        if s:
            p0 = t.root(s - 1, self.c0, self.t0)[self.dish_word]
            self.t1 = seat(self.c1, (t.strength + t.discount[1] * t.tables[s - 1][self.hot]) * p0, t.discount[1], rng)
        else:
            self.t1 = np.minimum(self.c1, 1)
        plain = ~self.spread
        self.c0 = _sums(self.word[plain], customers[plain], len(self.words)) + _sums(self.dish_word, self.t1, len(self.words))
        if s:
            self.t0 = seat(self.c0, np.full(len(self.c0), (t.strength + t.discount[2] * t.tables[s - 1][0]) / (t.types + 1)), t.discount[2], rng)
        else:
            self.t0 = np.minimum(self.c0, 1)

    def answers(self) -> list[np.ndarray]:
        """For all entries, customers and tables of their words, then of spread dishes."""
        c1, t1 = np.zeros(len(self.word), np.int64), np.zeros(len(self.word), np.int64)
        c1[self.spread], t1[self.spread] = self.c1[self.dish], self.t1[self.dish]
        return [self.c0[self.word], self.t0[self.word], c1, t1]

    def packed(self, columns: list[np.ndarray], every: bool) -> list[tuple[int, bytes]]:
        """The columns cut for the blocks: of all their entries, or of those that they ask for."""
        out = []
        for b, i, j in zip(self.blocks, self.ends[:-1], self.ends[1:], strict=True):
            kept = slice(None) if every else self.asked[i:j]
            if every or kept.any():
                out.append((b, _pack(*[_narrow(c[i:j][kept]) for c in columns])))
        return out

    def totals_of_state(self) -> list[float]:
        size = len(self.totals.place.hot) + 1
        customers, tables = (np.bincount(self.hot, x, size) for x in (self.c1, self.t1))
        customers[0], tables[0] = self.c0.sum(), self.t0.sum()
        return [*customers.tolist(), *tables.tolist()]


def _replayed(rows: pa.Table, totals: Totals, upto: int):
    """A shard in each of its states, from all that the blocks told it, with the state's number."""
    by_state: dict[int, dict[int, list[np.ndarray]]] = {}
    for s, b, blob in zip(rows["s"].to_pylist(), rows["g"].to_pylist(), rows["blob"].to_pylist(), strict=True):
        by_state.setdefault(s, {})[b] = _unpack(blob, totals.place.common)
    blocks = sorted(by_state[0])
    shard = Shard(rows["shard"][0].as_py(), [(b, by_state[0][b]) for b in blocks], totals)
    customers = shard.first
    for s in range(upto + 1):
        if s and s in by_state:
            customers = customers.copy()
            customers[shard.asked] = np.concatenate([by_state[s][b][0] for b in blocks if b in by_state[s]]).astype(np.int64)
        shard.take(s, customers)
        yield s, shard


def _heard(rows: pa.Table) -> dict[int, list[np.ndarray]]:
    """What the shards answered, by state, in the order of the entries."""
    heard: dict[int, list] = {}
    for s, shard, x in sorted(zip(rows["s"].to_pylist(), rows["shard"].to_pylist(), rows["blob"].to_pylist(), strict=True)):
        heard.setdefault(s, []).append(_unpack(x))
    return {s: [np.concatenate(c) for c in zip(*parts, strict=True)] for s, parts in heard.items()}


_TOLD = "s int, shard int, g int, blob binary, sums array<double>"
_TALK = ("s", "shard", "g", "blob")
#: In place of a shard: rows that a block says to itself.
OWN = -1


def _rows(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.float64()))
    columns = zip(*rows, strict=True) if rows else [()] * 5
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["s", "shard", "g", "blob", "sums"])


def _by_shard(block: Block, columns: list[np.ndarray]):
    first = _starts(block.shard)
    for i, j in zip(first, np.append(first[1:], len(block.shard)), strict=False):
        yield int(block.shard[i]), _pack(*[c[i:j] if c.dtype == np.uint64 else _narrow(c[i:j]) for c in columns], common=block.totals.place.common)


def _introduced(block: Block) -> pa.Table:
    """A row for each shard with words of a whole block, and the thinned block."""
    counts = _sums(block.entry[block.dish], block.n, len(block.shard))
    columns = [block.entry_word, block.entry_hot, block.told(), counts, block.asked.astype(np.uint8)]
    children = _sums(block.dish, block.n > 0, len(block.c1))
    sums = [float(x) for x in counts_of_counts(block.n, children[block.hot == 0])]
    return _rows([(0, OWN, block.g, block.thin(), sums), *[(0, shard, block.g, blob, None) for shard, blob in _by_shard(block, columns)]])


def probabilities(g: int, cells: bytes, rows: pa.Table, totals: Totals, burn_in: int) -> tuple[Block, np.ndarray, np.ndarray]:
    """A whole block, the averaged probability of its cells, and their words' counts, from what was said to it."""
    block = Block.whole(g, cells, totals)
    own = {s: _unpack(x) for s, shard, x in zip(rows["s"].to_pylist(), rows["shard"].to_pylist(), rows["blob"].to_pylist(), strict=True) if shard == OWN}
    (count, *heard), = _heard(rows.filter(pc.not_equal(rows["shard"], OWN))).values()
    p, samples = 0, range(burn_in + 1, len(totals.tables))
    for i, s in enumerate(samples):
        block.put(*own[s])
        p = p + block.probability(s, heard[4 * i : 4 * i + 4])
    return block, p / len(samples), count.astype(np.int64)[block.entry][block.dish]


def _added(df: DataFrame, size: int) -> np.ndarray:
    out = np.zeros(size)
    for r in df.select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect():
        out[r["i"]] = r["x"]
    return out


def sampled(
    docs: DataFrame, place: Places, sweeps: int = SWEEPS, burn_in: int = BURN_IN, seed: int = 1, strength: float = STRENGTH
) -> tuple[DataFrame, DataFrame, DataFrame, Totals]:
    """The staged blocks of ``docs`` (``doc_id, text, held_out``), all that they told the shards, what ``probabilities`` takes, and the
    totals of all states."""
    blocks = dealt_blocks(docs, place)
    totals = Totals(place, seed, strength)
    size = len(place.hot) + 1

    def begin(batches):
        for batch in batches:
            for g, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from _introduced(Block.whole(g, blob, totals)).to_batches()

    def answer(state: int):
        def run(rows: pa.Table) -> pa.Table:
            samples = []
            for s, shard in _replayed(rows, totals, state):
                if state == sweeps and s > burn_in:
                    samples += shard.answers()
            sums = shard.totals_of_state()
            if state == 0:
                plain = ~shard.spread
                children = _sums(shard.word[plain], shard.first[plain], len(shard.words)) + _sums(shard.dish_word, shard.c1 > 0, len(shard.words))
                sums += [float(shard.count.sum()), float((shard.count > 0).sum()), *map(float, counts_of_counts(shard.c1, children))]
            last = state == sweeps
            said = shard.packed([shard.count[shard.word], *samples] if last else shard.answers(), last)
            return _rows([(state, shard.g, OWN, None, sums), *[(state, shard.g, b, blob, None) for b, blob in said]])

        return run

    def go_on(state: int):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            block, heard = Block.thinned(left["g"][0].as_py(), left["blob"][0].as_py(), totals), _heard(right)
            for s in range(state):
                block.sweep(s, heard.get(s, [np.zeros(0, np.int64)] * 4))
            own = [(state, OWN, block.g, _pack(_narrow(block.t2), _narrow(block.t1)), None)] if state > burn_in else []
            return _rows(own + [(state, shard, block.g, blob, None) for shard, blob in _by_shard(block, [block.told()])])

        return run

    first = staged(blocks.select("g", "cells").mapInArrow(begin, _TOLD), "told")
    told, heard, own = first.where(F.col("shard") != OWN), None, None
    for s in range(sweeps + 1):
        answers = staged(told.select(*_TALK).groupBy("shard").applyInArrow(answer(s), _TOLD), "heard")
        sums = _added(answers, 2 * size + 6)
        totals.customers.append(sums[:size])
        totals.tables.append(sums[size : 2 * size])
        if s == 0:
            totals.tokens, totals.types = int(sums[2 * size]), int(sums[2 * size + 1])
            inner = _added(first, 4)
            once_twice = [inner[:2], inner[2:] + sums[2 * size + 2 : 2 * size + 4], sums[2 * size + 4 :]]
            totals.discount = tuple(min(0.95, max(0.05, float(a / max(a + 2 * b, 1)))) for a, b in once_twice)
        answers = answers.where(F.col("g") != OWN).select(*_TALK)
        if s == sweeps:
            return blocks, told, answers if own is None else answers.unionByName(own), totals
        heard = answers if heard is None else heard.unionByName(answers)
        thin = first.where(F.col("shard") == OWN).select("g", "blob")
        more = staged(thin.groupBy("g").cogroup(heard.groupBy("g")).applyInArrow(go_on(s + 1), _TOLD), "told")
        told = told.unionByName(more.where(F.col("shard") != OWN))
        mine = more.where(F.col("shard") == OWN).select(*_TALK)
        own = mine if own is None else own.unionByName(mine)


def fit(docs: DataFrame, groups: int, sweeps: int = SWEEPS, seed: int = 1, strength: float = STRENGTH) -> tuple[DataFrame, Totals, np.ndarray, np.ndarray]:
    """The root of a model of ``docs`` (``text``): ``g, cells``, a row per shard, the totals of all states, and the hashes and counts
    of the commonest words."""
    docs = docs.select(F.lit(0).cast("long").alias("doc_id"), "text", F.lit(False).alias("held_out"))
    _, told, _, totals = sampled(docs, places(docs, groups), sweeps, min(BURN_IN, sweeps - 1), seed, strength)

    def roots(rows: pa.Table) -> pa.Table:
        states = []
        for _, shard in _replayed(rows, totals, sweeps):
            states += [shard.c0, shard.t0]
        top = np.argsort(-shard.count, kind="stable")[:HOT]
        pairs = [{"w": int(w), "n": int(c)} for w, c in zip(shard.words[top].view(np.int64), shard.count[top], strict=True)]
        return pa.table(
            {
                "g": pa.array([shard.g], pa.int32()), "cells": pa.array([_pack(shard.words, shard.count, *states, common=totals.place.common)], pa.binary()),
                "top": pa.array([pairs], pa.list_(pa.struct([("w", pa.int64()), ("n", pa.int64())]))),
            }
        )

    cells = staged(told.select(*_TALK).groupBy("shard").applyInArrow(roots, "g int, cells binary, top array<struct<w bigint, n bigint>>"), "roots")
    hot = cells.select(F.inline("top")).orderBy(F.desc("n"), "w").limit(HOT).collect()
    hot_w, hot_n = np.array([r["w"] for r in hot], np.int64).view(np.uint64), np.array([r["n"] for r in hot], np.int64)
    order = np.argsort(hot_w)
    return cells, totals, hot_w[order], hot_n[order]


def averaged(g: int, blob: bytes, totals: Totals, burn_in: int, ask_word: np.ndarray, ask_context: np.ndarray):
    """Averaged probability of words of a shard after words that no training text has, whichever these are, and their counts."""
    words, count, *states = _unpack(blob, totals.place.common)
    at = np.searchsorted(words, ask_word).clip(max=len(words) - 1)
    known = words[at] == ask_word
    every = [totals.root(s, np.where(known, states[2 * s][at], 0), np.where(known, states[2 * s + 1][at], 0)) for s in range(burn_in + 1, len(totals.tables))]
    return np.mean(every, axis=0), np.where(known, count[at], 0)


def unknown(totals: Totals, burn_in: int) -> float:
    """Averaged probability of an unknown word after words that no training text has."""
    return float(np.mean([totals.root(s, 0, 0) for s in range(burn_in + 1, len(totals.tables))]))


@in_small_batches
def score_texts(docs: DataFrame, held_out, sweeps: int = SWEEPS, burn_in: int = BURN_IN, seed: int = 1) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per id of ``docs``
    (``doc_id, text``). ``held_out`` is a Column of ``doc_id``: rows not learned from."""
    flag = F.coalesce(held_out, F.lit(True))
    docs = docs.select("doc_id", "text").withColumn("held_out", flag)
    blocks, _, said, totals = sampled(docs, places(docs), sweeps, burn_in, seed)
    base = np.log10(0.5 / (totals.tokens + 0.5 * (totals.types + 1)))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        _, p, counts = probabilities(left["g"][0].as_py(), left["cells"][0].as_py(), right, totals, burn_in)
        runs, owner = _unpack(left["asks"][0].as_py())
        ids = pa.concat_arrays([c.flatten() for c in left["ids"].chunks])
        per_cell = (counts > 0, np.log10(counts + 0.5) - np.log10(0.5) + base, np.log10(p))
        sums = [np.bincount(owner, minlength=len(ids)), *[np.bincount(owner, np.repeat(x, runs), len(ids)) for x in per_cell]]
        numbers = [pa.array(x.astype(t)) for x, t in zip(sums, (np.int64, np.int64, float, float), strict=True)]
        return pa.table([ids, *numbers], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    parts = blocks.groupBy("g").cogroup(said.groupBy("g")).applyInArrow(
        score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, n_known bigint, base_score double, score double"
    )
    return (
        parts.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
        .select("doc_id", flag.alias("held_out"), "n_tokens", "n_known", F.lit(int(totals.tokens)).cast("long").alias("train_tokens"), "base_score", "score")
    )
