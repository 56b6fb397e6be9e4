"""Removal of passages that another document has, with prefix-partitioned suffix trees over words.

A suffix is the run of words from some word of a document on. Suffixes that share their first 13
words hang below one internal node of depth 13 or more of the corpus' suffix tree; a repeat is
such a node with leaves in two documents. Only that part of the tree is built:

1. Whole copies: texts of equal digest. Of each such group the document of the smallest id
   enters the tree; the others are repeats from end to end.
2. Suffixes without a partner are unique leaves above depth 13. They are left out by an exact
   necessary condition: equal windows of 13 words hold the same least hash of 7 words in a row
   (7 such runs lie in a window), so a window whose least hash occurs in one document only is
   unique. Least hashes change at every fourth word or so; they travel packed, per document bucket.
3. The other suffixes, cut at depth 13, are dealt by prefixes of variable length: a prefix that
   holds more than its share of all suffixes is extended by a word (up to the head's three words).
   Spark sorts each group by the head's words and the fingerprint of the whole window, outside
   memory if need be; neighbours in that order that agree to depth 13 are the leaves of one deep
   node. Suffixes of one bucket of documents that agree are one leaf, so a node has at most as many
   leaves as there are buckets, however many documents share the passage.
4. Each node tells the buckets of its leaves its smallest document id; there the texts are met
   again and words are marked.

The prefixes to extend are estimated on a bounded sample of documents; they decide only where a
suffix goes, never whether it counts.

Null texts have no words. Rows with a null id take no part and keep their words. Repeated rows of
one id are one document; each comes back. Further columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieloom.llm.tables import small
from tieloom.llm.words import Words, mix, sequence_hashes, slices
from tieloom.staging import staged

WINDOW = 13
RUN = 7
HEAD = 3
#: Text per document bucket.
BUCKET_BYTES = 4 << 20
#: Text per group of least hashes, of which it has some 16 bytes for every fourth word.
HASH_GROUP_BYTES = 16 << 20
SAMPLE_DOCS = 2000


def least_hashes(h: np.ndarray) -> np.ndarray:
    """For each window of 13 word hashes, the least hash of 7 words in a row, spread over 64 bits."""
    m = sequence_hashes(h, RUN)
    for reach in (1, 2, 3):  # minima over 2, 4 and 7 runs
        m = np.minimum(m[:-reach], m[reach:]) if len(m) > reach else m[:0]
    return mix(m)


def _window_owner(words: Words) -> np.ndarray:
    """For each window start of the concatenated words, its text; -1 if the window leaves the text."""
    n = max(0, len(words) - WINDOW + 1)
    owner = np.repeat(np.arange(len(words.first) - 1), words.counts())
    return np.where(owner[:n] == owner[WINDOW - 1 : WINDOW - 1 + n], owner[:n], -1) if n else np.zeros(0, np.int64)


def _bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _runs(*sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows."""
    n = len(sorted_keys[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    return np.flatnonzero(new)


def _least_hash_blobs(docs: DataFrame, buckets: int, groups: int) -> DataFrame:
    """``g, hashes, owners``: per batch and group the distinct (least hash, bucket) pairs, packed.

    The top bit of an owner says that two documents of the bucket have the hash.
    """

    def run(batches):
        for batch in slices(batches, 1, 8 << 20):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            words = Words(batch.column(1))
            owner = _window_owner(words)
            least = least_hashes(words.hashes(lower=False))
            keep = owner >= 0
            keep[1:] &= (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
            least, owner = least[keep], owner[keep]
            order = np.lexsort((owner, least))
            least, owner = least[order], owner[order]
            first = _runs(least, owner)
            least, bucket = least[first], _bucket(ids[owner[first]], buckets)
            order = np.lexsort((bucket, least))
            least, bucket = least[order], bucket[order]
            first = _runs(least, bucket)
            several = np.diff(np.append(first, len(least))) > 1
            least, bucket = least[first], bucket[first].astype(np.uint32) | (several.astype(np.uint32) << np.uint32(31))
            group = ((least >> np.uint64(40)) * np.uint64(groups) >> np.uint64(24)).astype(np.int64)
            cut = np.searchsorted(group, np.arange(groups + 1))
            full = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(full, pa.int32()),
                    pa.array([least[cut[g] : cut[g + 1]].tobytes() for g in full], pa.binary()),
                    pa.array([bucket[cut[g] : cut[g + 1]].tobytes() for g in full], pa.binary()),
                ],
                ["g", "hashes", "owners"],
            )

    return docs.mapInArrow(run, "g int, hashes binary, owners binary")


def _joined(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def _by_bucket(bucket: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """One row per bucket with its values packed."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = _runs(bucket)
    ends = np.append(first[1:], len(bucket))[: len(first)]
    packed = [pa.array([c[order][i:j].tobytes() for i, j in zip(first, ends, strict=True)], pa.binary()) for c in columns]
    return pa.table([pa.array(bucket[first].astype(np.int32), pa.int32()), *packed], names=["b", *[f"v{k}" for k in range(len(columns))]])


def _repeated_hashes(table: pa.Table) -> pa.Table:
    """Of one group, the least hashes that two documents have, for each bucket that has them."""
    least, owner = _joined(table["hashes"], np.uint64), _joined(table["owners"], np.uint32)
    order = np.argsort(least, kind="stable")
    least, owner = least[order], owner[order]
    first = _runs(least)
    sizes = np.diff(np.append(first, len(least)))
    several = np.logical_or.reduceat(owner >> np.uint32(31) > 0, first) if len(first) else np.zeros(0, bool)
    keep = np.repeat((sizes > 1) | several, sizes)
    return _by_bucket((owner[keep] & np.uint32(0x7FFFFFFF)).astype(np.int64), least[keep])


def _packed_docs(docs: DataFrame, buckets: int) -> DataFrame:
    """``b, ids, ends, z``: per batch and bucket the documents, texts joined and compressed."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches, 1, 8 << 20):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            table = _bucket(ids, buckets)
            out = [[], [], [], []]
            order = np.argsort(table, kind="stable")
            first = _runs(table[order])
            for i, j in zip(first, np.append(first[1:], len(order)), strict=False):
                own = order[i:j]
                parts = [texts[k] for k in own]
                out[0].append(int(table[own[0]]))
                out[1].append(ids[own].astype(np.int64).tobytes())
                out[2].append(np.cumsum([len(p) for p in parts], dtype=np.int64).tobytes())
                out[3].append(pack.compress(b"".join(parts)))
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], ["b", "ids", "ends", "z"])

    return docs.mapInArrow(run, "b int, ids binary, ends binary, z binary")


def _unpacked(table: pa.Table):
    """Documents of a bucket in turn: ids and texts of one packed row at a time."""
    unpack = zstandard.ZstdDecompressor()
    for ids, ends, z in zip(table["ids"].to_pylist(), table["ends"].to_pylist(), table["z"].to_pylist(), strict=True):
        data, ends = unpack.decompress(z), np.frombuffer(ends, np.int64).tolist()
        yield np.frombuffer(ids, np.int64), [data[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]


def long_prefixes(docs: DataFrame, share: float) -> frozenset[str]:
    """Prefixes of one and two words that start more than ``share`` of the suffixes of a sample."""

    def run(batches):
        for batch in slices(batches, 0):
            found = Counter()
            for text in batch.column(0).to_pylist():
                w = text.split()
                found.update(w)
                found.update(map(" ".join, zip(w, w[1:], strict=False)))
            common = found.most_common(20_000)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in common], pa.string()), pa.array([n for _, n in common], pa.int64()), pa.array([found.total() // 2] * len(common), pa.int64())], ["p", "n", "all"])

    chosen = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    counts = docs.join(F.broadcast(chosen), "doc_id", "left_semi").select("text").mapInArrow(run, "p string, n bigint, all bigint")
    counts = counts.groupBy("p").agg(F.sum("n").alias("n"), F.max("all").alias("all"))
    most = counts.agg(F.max("all")).first()[0] or 0
    return frozenset(r["p"] for r in counts.where(F.col("n") > share * most).orderBy(F.desc("n"), "p").limit(int(4 / share)).collect())


def _suffixes(docs: pa.Table, repeated: pa.Table, extend: frozenset[str]) -> pa.Table:
    """Suffixes of a bucket that may have a partner, one leaf per distinct window."""
    bucket = docs["b"][0].as_py() if docs.num_rows else 0
    known = np.sort(_joined(repeated["v0"], np.uint64))
    parts = []
    for ids, texts in _unpacked(docs) if len(known) else ():
        words = Words(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        h = words.hashes(lower=False)
        owner, least = _window_owner(words), least_hashes(h)
        at = np.searchsorted(known, least).clip(max=len(known) - 1)
        start = np.flatnonzero((known[at] == least) & (owner >= 0))
        if len(start):
            window = sequence_hashes(h, WINDOW)[start]
            raw = words.data.tobytes()
            heads = [b" ".join((raw[words.starts[p] : words.ends[p]], raw[words.starts[p + 1] : words.ends[p + 1]], raw[words.starts[p + 2] : words.ends[p + 2]])) for p in start]
            parts.append((window, ids[owner[start]], np.array(heads, object)))
    if not parts:
        return pa.table({"prefix": pa.array([], pa.string()), "head": pa.array([], pa.string()), "fp": pa.array([], pa.int64()), "b": pa.array([], pa.int32()), "lo": pa.array([], pa.int64()), "n": pa.array([], pa.int32())})
    window, ids, heads = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((ids, window))
    window, ids, heads = window[order], ids[order], heads[order]
    first = _runs(window)
    last = np.append(first[1:], len(window)) - 1
    several = np.where(ids[last] != ids[first], 2, 1)
    heads = [h.decode() for h in heads[first]]
    prefixes = []
    for h in heads:
        cut = h.find(" ")
        if h[:cut] in extend:
            cut = h.find(" ", cut + 1)
            if h[:cut] in extend:
                cut = len(h)
        prefixes.append(h[:cut])
    return pa.table(
        {
            "prefix": pa.array(prefixes, pa.string()), "head": pa.array(heads, pa.string()), "fp": pa.array(window[first].view(np.int64)),
            "b": pa.array(np.full(len(first), bucket, np.int32)), "lo": pa.array(ids[first]), "n": pa.array(several.astype(np.int32)),
        }
    )


def _deep_nodes(rows: DataFrame) -> DataFrame:
    """Leaves of nodes of depth 13 with leaves in two documents, as packed (fingerprint, least id)
    per bucket. ``rows`` come sorted by prefix, head and fingerprint."""

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            nodes, table_rows = _node_starts(table), table.num_rows
            last = int(nodes[-1]) if len(nodes) else 0
            yield from _node_answers(table.slice(0, last), nodes[:-1])
            rest = table.slice(last, table_rows - last)
        if rest is not None and rest.num_rows:
            yield from _node_answers(rest, _node_starts(rest))

    return rows.mapInArrow(run, "b int, v0 binary, v1 binary")


def _node_starts(table: pa.Table) -> np.ndarray:
    """Where a leaf shares fewer than 13 words with the one before it."""
    if table.num_rows == 0:
        return np.zeros(0, np.int64)
    fp, head = table["fp"].to_numpy(), table["head"].combine_chunks()
    new = np.ones(len(fp), bool)
    new[1:] = (fp[1:] != fp[:-1]) | pc.not_equal(head[1:], head[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _node_answers(table: pa.Table, nodes: np.ndarray):
    if not len(nodes):
        return
    lo, n = table["lo"].to_numpy(), table["n"].to_numpy()
    sizes = np.diff(np.append(nodes, len(lo)))
    least = np.repeat(np.minimum.reduceat(lo, nodes), sizes)
    docs = np.repeat(np.add.reduceat(n, nodes), sizes)
    tell = (docs > 1) & ((lo > least) | (n > 1))
    if tell.any():
        out = _by_bucket(table["b"].to_numpy()[tell].astype(np.int64), table["fp"].to_numpy()[tell], least[tell])
        yield from out.to_batches()


def _marked(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Documents of a bucket with the spans of words to remove and the words that stay."""
    fp, least = _joined(answers["v0"], np.int64).view(np.uint64), _joined(answers["v1"], np.int64)
    order = np.argsort(fp)
    fp, least = fp[order], least[order]
    out = ([], [], [], [])
    for ids, texts in _unpacked(docs):
        words = Words(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        n = len(words)
        cover = np.zeros(n + 1, np.int64)
        if len(fp) and n >= WINDOW:
            owner, window = _window_owner(words), sequence_hashes(words.hashes(lower=False), WINDOW)
            at = np.searchsorted(fp, window).clip(max=len(fp) - 1)
            start = np.flatnonzero((fp[at] == window) & (owner >= 0))
            start = start[least[at[start]] < ids[owner[start]]]
            np.add.at(cover, start, 1)
            np.add.at(cover, start + WINDOW, -1)
        gone = np.cumsum(cover[:-1]) > 0
        for k, doc_id in enumerate(ids.tolist()):
            i, j = words.first[k], words.first[k + 1]
            own = gone[i:j]
            tokens = texts[k].split()
            spans = []
            if own.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
                spans = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]
                tokens = [t for t, g in zip(tokens, own.tolist(), strict=True) if not g]
            out[0].append(doc_id)
            out[1].append(int(j - i))
            out[2].append(spans)
            out[3].append(b" ".join(tokens).decode())
    return _result(*out)


def _result(ids, n, spans, kept) -> pa.Table:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string())], names=["doc_id", "n_words", "removed", "kept_text"])


RESULT = "doc_id bigint, n_words bigint, removed array<struct<start bigint, end bigint>>, kept_text string"


def _whole(docs: DataFrame, gone: bool) -> DataFrame:
    """Result rows of documents that are repeats as a whole (of 13 words or more), or of none."""

    def run(batches):
        for batch in slices(batches, 1):
            rows = ([], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = (text or "").encode().split()
                drop = gone and len(w) >= WINDOW
                for column, value in zip(rows, (doc_id, len(w), [{"start": 0, "end": len(w)}] if drop else [], "" if drop else b" ".join(w).decode()), strict=True):
                    column.append(value)
            yield from _result(*rows).to_batches()

    return docs.mapInArrow(run, RESULT)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """For every row of ``docs`` (``doc_id, text``): ``doc_id, n_words, removed, kept_text``.

    ``removed`` holds the spans of words (end exclusive) that are covered by windows of 13 words
    whose sequence also starts in a document of smaller id; ``kept_text`` the other words, joined
    by single spaces.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    digests = staged(named.select("doc_id", F.unhex(F.md5("text")).alias("digest"), F.octet_length("text").cast("long").alias("bytes")), "digests")
    groups = digests.groupBy("digest").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("digest", "lo")
    copies = staged(digests.join(groups, "digest").where("doc_id > lo").select("doc_id").distinct(), "copies")
    single = named.join(small(copies), "doc_id", "left_anti")

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = digests.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(4 * partitions, total // BUCKET_BYTES)
    answers = (
        _least_hash_blobs(single, buckets, max(4 * partitions, total // HASH_GROUP_BYTES)).groupBy("g")
        .applyInArrow(_repeated_hashes, "b int, v0 binary")
    )
    extend = long_prefixes(named, 1 / (8 * partitions))

    def suffixes(left: pa.Table, right: pa.Table) -> pa.Table:
        return _suffixes(left, right, extend)

    leaves = (
        _packed_docs(single, buckets).groupBy("b").cogroup(answers.groupBy("b"))
        .applyInArrow(suffixes, "prefix string, head string, fp bigint, b int, lo bigint, n int")
    )
    nodes = _deep_nodes(leaves.repartition("prefix").sortWithinPartitions("prefix", "head", "fp"))
    marked = _packed_docs(single, buckets).groupBy("b").cogroup(nodes.groupBy("b")).applyInArrow(_marked, RESULT)
    copied = _whole(named.join(small(copies), "doc_id", "left_semi"), True)
    others = _whole(docs.where("doc_id IS NULL OR text IS NULL"), False)
    return marked.unionByName(copied).unionByName(others)
