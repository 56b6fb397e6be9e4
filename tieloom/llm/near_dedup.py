"""Near duplicates by one-permutation hashing.

1. Each text becomes the set of its 5-word shingle hashes. Texts of equal sets are one class
   (equal digests of the whole set), represented by the smallest id.
2. One hash per shingle deals the set into 384 bins; a bin keeps its least hash. An empty bin
   borrows from the first filled bin of its own random order of bins, so two sets borrow alike,
   and each bin of a small set is a random pick of its shingles. Six bins make a band, 64 bands
   make 64 bucket keys: a pair at the threshold is missed with probability (1 - 0.75 ** 6) ** 64,
   4 in a million, and a pair that shares a passage of a fifth of its shingles rarely meets.
3. Each bucket proposes a star: its least member with every other, so pairs grow with bucket
   size, not its square. Pairs whose sizes alone rule a link out are left out, as are pairs that
   an earlier round compared. The others are confirmed on whole sets, a large star in chunks.
4. What is left are buckets whose members are not all in one component: the centre has been
   compared with every member, the others not with each other. Such a bucket is cut into pieces, and
   pieces meet in pairs, each pair of pieces in a task of its own with the texts of both. Two documents are
   compared if they are in different components, if their sizes and what each shares with the centre leave
   room for a link (exact), and if two bits of each of 1,024 finer bins agree often enough: a pair at the
   threshold falls 4.5 standard deviations short with a probability of 3 in a million. Pairs are a matrix in the
   task, never rows, and are compared on whole sets where the first band that they share is. A task joins
   the components that it links and leaves as many links as it takes to join them.
5. Components of the confirmed links, by alternating stars. Their vertices are classes, numbered in
   the order of their representatives.

Null and empty texts have no shingles, are linked with nothing and stay. Rows with a null id
come back with themselves as component (null) and are kept. Repeated rows give repeated results. Rows of one
id with different texts are linked with each other: whatever is linked with one is reachable from all. Sets
are compared by 64-bit hashes of their shingles, and are equal if 128-bit digests of these are.
Further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieloom.llm.components import components
from tieloom.llm.positions import placed
from tieloom.llm.tables import in_small_batches
from tieloom.llm.words import Words, mix, sequence_hashes, slices
from tieloom.staging import staged

SHINGLE = 5
PERCENT = 75
BINS, ROWS = 384, 6
CHUNK = 64
#: Documents, and shingles of all of them, of a piece of a bucket.
PIECE, PIECE_SHINGLES = 512, 1 << 20
#: Sets below this size are compared whatever their bits: two hashes in one bin weigh too much in them.
SMALL = 32


class Bins:
    """Equal ranges of hash values. ``order`` is for each bin its own random order of all bins."""

    def __init__(self, count: int, seed: int):
        self.count = count
        self.order = np.random.default_rng(seed).permuted(np.tile(np.arange(count, dtype=np.int16), (count, 1)), axis=1)
        self.rank = np.argsort(self.order, axis=1).astype(np.int16)
        self.edges = np.array([(i << 64) // count for i in range(count)], np.uint64)


BANDED = Bins(BINS, 77)
#: Finer bins, to tell similarities apart by two bits of each.
FINE = Bins(1024, 78)
_BAND = mix(np.arange(1, BINS // ROWS + 1, dtype=np.uint64))
_FACTORS = mix(np.arange(101, 101 + ROWS, dtype=np.uint64)) | np.uint64(1)
_FINE_KEYS = mix(np.arange(5001, 5001 + FINE.count, dtype=np.uint64))
#: Most bins that may differ in their two bits: at the threshold 13/16 agree.
_MAY_DIFFER = FINE.count - int(FINE.count * (13 / 16 - 4.5 * (13 / 16 * 3 / 16 / FINE.count) ** 0.5))
_LONGS = FINE.count // 64


def shingle_set(h: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's word hashes."""
    if not len(h):
        return h
    return np.unique(sequence_hashes(h, min(SHINGLE, len(h))))


def signature(s: np.ndarray, bins: Bins = BANDED) -> np.ndarray:
    """Least hash per bin of a sorted set, empty bins filled by borrowing."""
    at = np.searchsorted(s, bins.edges)
    full = np.empty(bins.count, bool)
    full[:-1] = at[1:] > at[:-1]
    full[-1] = at[-1] < len(s)
    filled, empty = np.flatnonzero(full), np.flatnonzero(~full)
    source = np.arange(bins.count)
    if len(filled) < 64:
        source[empty] = filled[np.argmin(bins.rank[np.ix_(empty, filled)], axis=1)]
    else:
        turn = 0
        while len(empty):
            found = bins.order[empty, turn]
            known = full[found]
            source[empty[known]] = found[known]
            empty, turn = empty[~known], turn + 1
    return s[at[source]]


def bucket_keys(s: np.ndarray) -> np.ndarray:
    """Bucket keys of a sorted set, one per band."""
    return mix((signature(s).reshape(-1, ROWS) * _FACTORS).sum(axis=1) ^ _BAND)


def two_bits(s: np.ndarray) -> np.ndarray:
    """Two bits of each fine bin, packed: the first bits, then the second.

    They depend on the bin too, so that a hash that fills many bins agrees by chance in each anew.
    """
    bits = mix(signature(s, FINE) ^ _FINE_KEYS)
    return np.packbits(np.concatenate([bits & np.uint64(1), bits >> np.uint64(1) & np.uint64(1)]).astype(np.uint8)).view(np.int64)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted sets share."""
    return len(np.intersect1d(a, b, assume_unique=True))


def text_digest(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, set_id, text_id, keys`` of ``docs`` (``doc_id, text``)."""

    def run(batches):
        for batch in slices(batches, 1):
            words = Words(batch.column(1))
            h = words.hashes()
            n, ids, keys = [], [], []
            own = [None if t is None else text_digest(t.encode()) for t in batch.column(1).to_pylist()]
            for i, j in zip(words.first[:-1], words.first[1:], strict=True):
                s = shingle_set(h[i:j])
                n.append(len(s))
                ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(bucket_keys(s).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(own, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_id", "text_id", "keys"],
            )

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, n_shingles bigint, set_id binary, text_id binary, keys array<bigint>")


def packed_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text_id, text`` with texts compressed, for the tables that carry them through shuffles."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, 1):
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(text_digest, texts), pa.binary()), pa.array(map(pack.compress, texts), pa.binary())], ["doc_id", "text_id", "text"]
            )

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").mapInArrow(run, f"doc_id {key}, text_id binary, text binary")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``pairs`` (``rep, doc``) with ``both``, the shingles that the whole sets share, and
    ``linked``, whether that reaches the threshold.

    Pairs meet by centre. A star of many members is dealt out in chunks, each with a copy of the
    centre, which comes first in its chunk; a task holds one centre at a time.
    """
    stars = pairs.groupBy("rep").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    members = pairs.join(stars, "rep").select("rep", F.pmod(F.xxhash64("doc"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("side"), "doc").join(texts, "doc")
    centres = stars.select("rep", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("side"), F.col("rep").alias("doc")).join(texts, "doc")
    columns = ["rep", "chunk", "side", "doc", "text"]
    rows = members.select(columns).union(centres.select(columns)).repartition("rep", "chunk").sortWithinPartitions("rep", "chunk", "side", "doc")

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        current, centre = None, None
        for batch in slices(batches, 4, 1 << 20):
            out = ([], [], [], [])
            texts = pa.array([unpack.decompress(t).decode() for t in batch.column(4).to_pylist()], pa.large_string())
            words = Words(texts)
            h = words.hashes()
            for k, (rep, side, doc) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True)):
                s = shingle_set(h[words.first[k] : words.first[k + 1]])
                if side == 0:
                    current, centre = rep, s
                elif rep == current:
                    both = common(centre, s)
                    for column, value in zip(out, (rep, doc, both, 100 * both >= PERCENT * (len(centre) + len(s) - both)), strict=True):
                        column.append(value)
            kinds = (batch.schema.field(0).type, batch.schema.field(3).type, pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["rep", "doc", "both", "linked"])

    key = pairs.schema["rep"].dataType.simpleString()
    return rows.mapInArrow(run, f"rep {key}, doc {key}, both int, linked boolean")


def _set_of(packed: bytes) -> np.ndarray:
    """Shingles of a packed text."""
    return shingle_set(Words(pa.array([zstandard.ZstdDecompressor().decompress(packed).decode()], pa.large_string())).hashes())


def _bits(texts: DataFrame) -> DataFrame:
    """``doc, bits, keys, text`` of packed texts (``doc, text``); keys in the order of bands."""

    def run(batches):
        for batch in slices(batches, 1, 1 << 20):
            sets = [_set_of(t.as_py()) for t in batch.column(1)]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([two_bits(s) for s in sets], longs), pa.array([bucket_keys(s).view(np.int64) for s in sets], longs), batch.column(1)],
                ["doc", "bits", "keys", "text"],
            )

    return texts.mapInArrow(run, f"doc {texts.schema['doc'].dataType.simpleString()}, bits array<bigint>, keys array<bigint>, text binary")


def _open(members: DataFrame, comp: DataFrame | None) -> DataFrame:
    """Members (``key, doc, n``) of buckets of several components, with their bucket's centre."""
    if comp is None:
        members = members.withColumn("comp", F.col("doc"))
    else:
        members = members.join(comp, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    centres = (
        members.groupBy("key").agg(F.min(F.struct("doc", "n")).alias("centre"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        .where("lo < hi").select("key", F.col("centre.doc").alias("rep"), F.col("centre.n").alias("rep_n"))
    )
    return staged(members.join(centres, "key"), "open")


def _pairs_of_pieces(rows: list[tuple], key: int) -> np.ndarray:
    """Pairs (places in ``rows``) between the two pieces of a cell, or within its only one, that may be linked."""
    piece, doc, comp, n, both = (np.array([r[k] for r in rows], np.int64) for k in range(5))
    bits = np.array([r[5] for r in rows], np.int64).view(np.uint64).reshape(len(rows), 2, _LONGS)
    bands = np.array([r[6] for r in rows], np.int64)
    found = [np.zeros((0, 2), np.int64)]
    left = np.flatnonzero(piece == piece.min())
    right = np.flatnonzero(piece == piece.max())
    for start in range(0, len(left), 128):
        a, b = left[start : start + 128, None], right[None, :]
        smaller = np.minimum(n[a], n[b])
        through = np.minimum(both[a], both[b]) + np.minimum(n[a] - both[a], n[b] - both[b])
        room = np.where((both[a] >= 0) & (both[b] >= 0), np.minimum(smaller, through), smaller)
        wanted = (comp[a] != comp[b]) & (100 * room >= PERCENT * (n[a] + n[b] - room))
        if piece.min() == piece.max():
            wanted &= doc[a] < doc[b]
        i, j = np.nonzero(wanted)
        i, j = a[i, 0], b[0, j]
        for first in range(0, len(i), 1 << 14):
            x, y = i[first : first + (1 << 14)], j[first : first + (1 << 14)]
            apart = bits[x] ^ bits[y]
            differ = np.bitwise_count(apart[:, 0] | apart[:, 1]).sum(axis=1, dtype=np.int64)
            near = (np.minimum(n[x], n[y]) < SMALL) | (differ <= _MAY_DIFFER)
            x, y = x[near], y[near]
            shared = bands[x] == bands[y]
            own = shared.any(axis=1) & (bands[x, shared.argmax(axis=1)] == key) if len(x) else np.zeros(0, bool)
            found.append(np.stack([x[own], y[own]], axis=1))
    return np.concatenate(found)


def _links_of_pieces(rows: list[tuple], key: int) -> list[tuple[int, int]]:
    """Links between documents of a cell, enough to join all components that its links join.

    ``rows`` hold piece, document, component, size, what is shared with the centre (-1: not known), bits, bands
    and packed text.
    """
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while (up := parent.get(c, c)) != c:
            parent[c] = parent.get(up, up)
            c = up
        return c

    sets: dict[int, np.ndarray] = {}

    def set_at(k: int) -> np.ndarray:
        if k not in sets:
            sets[k] = _set_of(rows[k][7])
        return sets[k]

    out = []
    for x, y in _pairs_of_pieces(rows, key).tolist():
        a, b = root(rows[x][2]), root(rows[y][2])
        if a == b:
            continue
        both = common(set_at(x), set_at(y))
        if 100 * both >= PERCENT * (rows[x][3] + rows[y][3] - both):
            parent[max(a, b)] = min(a, b)
            out.append((rows[x][1], rows[y][1]))
    return out


def _open_links(left: DataFrame, compared: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (``a, b``) between members of open buckets; centres are done."""
    left = left.where("doc != rep")
    # without its centre a bucket may be of one component
    apart = (
        left.groupBy("key")
        .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.greatest(F.ceil(F.count("*") / PIECE), F.ceil(F.sum("n") / PIECE_SHINGLES)).cast("int").alias("pieces"))
        .where("lo < hi").drop("lo", "hi")
    )
    left = staged(left.join(apart, "key").join(compared.select("rep", "doc", "both"), ["rep", "doc"], "left"), "apart")
    known = _bits(texts.join(left.select("doc").distinct(), "doc", "left_semi"))
    piece = F.pmod(F.xxhash64("doc"), F.col("pieces")).cast("int")
    other = F.sequence(F.lit(0), F.col("pieces") - 1)
    cells = left.withColumn("piece", piece).select(
        "key", "piece", "doc", "comp", "n", F.coalesce("both", F.lit(-1)).alias("both"), F.explode(F.transform(other, lambda o: F.struct(F.least(o, "piece").alias("i"), F.greatest(o, "piece").alias("j")))).alias("cell")
    )
    columns = ["key", "cell.i", "cell.j", "piece", "doc", "comp", "n", "both", "bits", "keys", "text"]
    rows = cells.join(known, "doc").select(*columns).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "piece", "doc")

    def run(batches):
        current, held = None, []

        def made():
            if current is None or current[1] != current[2] and held[0][0] == held[-1][0]:
                return None  # a cell of two pieces of which one is empty
            links = _links_of_pieces(held, current[0])
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"]) if links else None

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    if row[:3] != current:
                        if (out := made()) is not None:
                            yield out
                        current, held = row[:3], []
                    held.append((*row[3:8], np.array(row[8], np.int64), np.array(row[9], np.int64), row[10]))
        if (out := made()) is not None:
            yield out

    return rows.mapInArrow(run, "a bigint, b bigint")


def _classes(signed: DataFrame) -> DataFrame:
    """``set_id, rep, text_id, cls``: classes of equal sets with the smallest id, one of its texts, and a number in
    the order of these ids."""
    least = signed.where("set_id IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_id").agg(F.min(F.struct("doc_id", "text_id")).alias("least"))
    named = least.select("set_id", F.col("least.doc_id").alias("rep"), F.col("least.text_id").alias("text_id"))
    return staged(placed(named, "rep", "set_id", name="class_order").withColumnRenamed("at", "cls"), "classes")


def _same_id(signed: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links (``a, b``) between the classes of ids that stand on several different texts."""
    found = signed.where("set_id IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi")).where("lo < hi").select("doc_id")
    several = staged(found, "several")
    if several.isEmpty():
        return None
    own = signed.join(several, "doc_id").join(classes.select("set_id", "cls"), "set_id").select("doc_id", "cls").distinct()
    return own.join(own.groupBy("doc_id").agg(F.min("cls").alias("first")), "doc_id").where("cls != first").select(F.col("first").alias("a"), F.col("cls").alias("b"))


@in_small_batches
def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (``doc_id, text``)."""
    docs = docs.select("doc_id", "text")
    signed = staged(signatures(docs), "signatures")
    classes = _classes(signed)
    # below, a document stands for its class and has the number of that
    spoken = signed.select("set_id", "n_shingles", "keys", "doc_id", "text_id").join(classes, ["set_id", "text_id"]).where(F.col("doc_id") == F.col("rep"))
    keyed = spoken.select(F.explode("keys").alias("key"), F.col("cls").alias("doc"), F.col("n_shingles").cast("int").alias("n"))
    shared = keyed.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("key")
    members = staged(keyed.join(shared, "key").distinct(), "buckets")
    met = classes.join(members.select(F.col("doc").alias("cls")).distinct(), "cls", "left_semi").select(F.col("rep").alias("doc_id"), "text_id", F.col("cls").alias("doc"))
    texts = packed_texts(docs).join(met, ["doc_id", "text_id"]).groupBy("doc_id", "text_id").agg(F.first("doc").alias("doc"), F.first("text").alias("text"))
    texts = staged(texts.select("doc", "text"), "texts")

    links, comp = _same_id(signed, classes), None
    found = _open(members, None)
    if not found.isEmpty():
        close = F.least("n", "rep_n") * 100 >= F.greatest("n", "rep_n") * PERCENT
        stars = staged(found.where("doc != rep").where(close).select("rep", "doc").distinct(), "pairs")
        compared = staged(confirmed(stars, texts), "compared")
        near = compared.where("linked").select(F.col("rep").alias("a"), F.col("doc").alias("b"))
        links = near if links is None else links.union(near)
        comp = components(links)
        left = _open(members, comp)
        if not left.isEmpty():
            more = staged(_open_links(left, compared, texts), "links")
            if not more.isEmpty():
                # components so far are stars, so their edges stand for their links
                comp = components(comp.select(F.col("comp").alias("a"), F.col("doc").alias("b")).union(more))
    elif links is not None:
        comp = components(links)

    named = classes.select("set_id", "rep", "cls")
    if comp is not None:
        first = classes.select(F.col("cls").alias("comp"), F.col("rep").alias("comp_rep"))
        named = named.join(comp.withColumnRenamed("doc", "cls").join(first, "comp"), "cls", "left").withColumn("rep", F.coalesce("comp_rep", "rep"))
    out = signed.select("doc_id", "n_shingles", "set_id").join(named.select("set_id", "rep"), "set_id", "left")
    component = F.when(F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("rep", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
