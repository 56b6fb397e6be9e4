"""Benchmark decontamination: MinHash containment search, with DataFrame functions only.

Which test items lie, whole or nearly, inside which documents? The share of an item's shingles
that a document holds is the containment; a document may be a thousand times longer, so the
sketch is taken from the item: its least shingle hashes, each of which lies in a document with the
containment as probability, as many as make a miss at the threshold rarer than ``miss``. Where that
reaches the number of shingles that may be missing, plus one, no miss is possible; with the defaults
this holds for items of up to 59 shingles.

Items are partitioned by size, a class per power of two of their shingles, and the class is part of the
join key. The longer the items of a class, the smaller the share of their hashes that is in a sketch: no
hash of a class lies above the greatest of its sketches, so of a document only the shingles up to there are
probed in that class. Short documents are probed like others, as several rows of an id count together.
Candidates are verified by exact containment of all shingles, by their 64-bit hashes.

Texts are lower-cased; an item of fewer than five words is one shingle of its whole length. Null
and empty texts have no shingles and take part in no pair. Repeated rows of a document give one
result per id and item, as do repeated items of an id (their shingles are joined). Null ids take
no part. Further columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieloom.llm.tables import small
from tieloom.llm.words import WORD
from tieloom.staging import staged

SHINGLE = 5
LEAST = 0.75
MISS = 1e-9


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: a lambda's variable is not inlined."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shingles(words: Column, k: int) -> Column:
    """Hash of every k words in a row; with fewer words an empty array."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))
    return F.when(F.size(words) >= k, hashes).otherwise(F.array().cast("array<bigint>"))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"))


def text_shingles(text: Column, lengths: list[int]) -> Column:
    """Hashes of all word sequences of the given lengths."""
    return _let(_words(text), lambda w: F.concat(F.array().cast("array<bigint>"), *[_shingles(w, k) for k in lengths]))


def item_shingles(items: DataFrame) -> DataFrame:
    """``item_id, words, shingles``: distinct shingle hashes, all of ``words`` words each."""
    size = F.size(_words(F.col("text")))
    sized = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text", F.least(size, F.lit(SHINGLE)).alias("words"))
    # one expression per length, as the length of a shingle is part of its hash call
    kind = F.when(F.col("words") == 1, text_shingles(F.col("text"), [1]))
    for k in range(2, SHINGLE + 1):
        kind = kind.when(F.col("words") == k, text_shingles(F.col("text"), [k]))
    return (
        sized.where("words > 0").select("item_id", "words", F.explode(kind).alias("s"))
        .groupBy("item_id").agg(F.min("words").alias("words"), F.collect_set("s").alias("shingles"))
    )


def sketches(items: DataFrame, least: float = LEAST, miss: float = MISS) -> DataFrame:
    """``item_id, words, size_class, s, needs``: the sketch of each item, and the shared shingles that make a pair."""
    n = F.size("shingles")
    size_class = F.floor(F.log2(n)).cast("int")
    slots = math.ceil(math.log(miss) / math.log(1 - least))
    may_miss = F.floor(n - F.ceil(n * least)).cast("int")
    return items.withColumn("size_class", size_class).select(
        "item_id", "words", "size_class", F.explode(F.slice(F.sort_array("shingles"), 1, F.least(may_miss + 1, F.lit(slots)))).alias("s"), F.ceil(n * least).alias("needs")
    )


def classes_of(sketch: DataFrame) -> list[tuple[int, int]]:
    """Size classes with the greatest hash in a sketch of each; some 30 rows at most."""
    found = sketch.groupBy("size_class").agg(F.max("s").alias("upto")).collect()
    return sorted((r["size_class"], r["upto"]) for r in found)


def probes(shingles: DataFrame, classes: list[tuple[int, int]]) -> DataFrame:
    """Rows with a shingle ``s``, once for each ``size_class`` with a sketch that it can be in.

    Comparisons with the classes' bounds stay in generated code, unlike a filter over arrays.
    """
    within = F.array(*[F.when(F.col("s") <= F.lit(upto), F.lit(size_class)) for size_class, upto in classes])
    return shingles.select("*", F.explode(within.cast("array<int>")).alias("size_class")).where("size_class IS NOT NULL")


def contaminated(docs: DataFrame, items: DataFrame, least: float = LEAST, miss: float = MISS) -> DataFrame:
    """``doc_id, item_id, item_shingles, shared, containment`` of every pair that reaches ``least``."""
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    items = staged(item_shingles(items.select("item_id", "text")), "items")
    sketch = staged(sketches(items, least, miss), "sketches")
    lengths = sorted({r["words"] for r in items.select("words").distinct().collect()})  # at most five
    all_shingles = text_shingles(F.col("text"), lengths)
    probed = probes(docs.select("doc_id", all_shingles.alias("h")).select("doc_id", F.explode("h").alias("s")), classes_of(sketch))
    pairs = staged(
        probed.join(small(sketch.select("item_id", "size_class", "s")), ["size_class", "s"]).select("doc_id", "item_id").distinct(),
        "candidates",
    )
    # the candidates' documents, read again
    near = docs.join(small(staged(pairs.select("doc_id").distinct(), "candidate_ids")), "doc_id")
    held = near.select("doc_id", F.array_distinct(all_shingles).alias("h")).select("doc_id", F.explode("h").alias("s"))
    wanted = items.select("item_id", F.size("shingles").alias("item_shingles"), F.explode("shingles").alias("s"))
    shared = (
        held.join(small(staged(wanted, "wanted")), "s").groupBy("doc_id", "item_id")
        .agg(F.countDistinct("s").alias("shared"), F.max("item_shingles").cast("long").alias("item_shingles"))
    )
    return (
        shared.join(pairs, ["doc_id", "item_id"], "left_semi")
        .where(F.col("shared") >= F.lit(least) * F.col("item_shingles"))
        .select("doc_id", "item_id", "item_shingles", "shared", (F.col("shared") / F.col("item_shingles")).alias("containment"))
    )


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a test item; all columns stay.

    Documents with a null id cannot be named by a pair and stay.
    """
    found = staged(contaminated(docs, items, **options).select(F.col("doc_id").alias("__found")).distinct(), "contaminated")
    return docs.join(small(found), docs["doc_id"] == F.col("__found"), "left_anti")
