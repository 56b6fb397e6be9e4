"""What a language model learns of particular words, and that its restaurants are distributions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tieloom.llm import language_model as lm


def test_words_of_one_ending_are_told_apart(spark):
    """By their last two bytes, all that a class of endings sees, the words before are the same."""
    rows = [(i, ("burst cat", "frost dog")[i % 2]) for i in range(40)] + [(100, "burst cat"), (101, "burst dog"), (102, "x burst cat"), (103, "x burst dog")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    score = {r["doc_id"]: r["score"] for r in lm.score_texts(docs, F.col("doc_id") >= 100).collect()}
    assert score[100] > score[101] + 1 and score[102] > score[103] + 0.5


@pytest.mark.parametrize("spread", [False, True])
def test_a_last_word_is_followed_by_a_distribution(spark, spread):
    words = "cat dog owl fox".split()
    learned = [f"burst {w} frost burst {w}" for w in words[:3] for _ in range(5)] + ["owl burst cat burst dog"]
    rows = [(i, t, False) for i, t in enumerate(learned)] + [(100 + i, f"{before} burst {w}", True) for before in ("frost", "new", "owl") for i, w in enumerate([*words, "frost", "burst", "owl"])]
    rows += [(200, "frost burst", True), (201, "new burst", True), (202, "owl burst", True)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, held_out boolean")
    token, *_ = lm.tokens_of(pa.array(["burst frost new owl fox"]))
    burst, befores, fox = token[0], token[1:4], token[4]
    place = lm.Places(3, np.array([burst]), np.array([5])) if spread else lm.Places(3)
    blocks, _, said, totals = lm.sampled(docs, place, 2, 0)
    said, found = said.collect(), {}
    for row in blocks.collect():
        rows = [r for r in said if r["g"] == row["g"]]
        block, p, _ = lm.probabilities(row["g"], row["cells"], pa.table({c: pa.array([r[c] for r in rows]) for c in ("s", "shard", "blob")}), totals, 0)
        own = block.words[block.last_word] == burst
        for b, w, x in zip(block.words[block.before][own], block.words[block.token][own], p[own], strict=True):
            found.setdefault(int(b), {})[int(w)] = x
    assert totals.tokens == sum(len(t.split()) + 1 for t in learned) and totals.types == 6  # cat dog owl frost burst end
    for b in befores:
        assert len(found[int(b)]) == totals.types + 1 and int(fox) in found[int(b)]
        assert np.isclose(sum(found[int(b)].values()), 1)


def test_common_last_words_are_spread_and_lose_nothing(spark):
    texts = [f"the a{i % 7} the b{i % 11} the the c{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, t, False) for i, t in enumerate(texts)], "doc_id bigint, text string, held_out boolean")
    place = lm.places(docs, 4)
    the = lm.tokens_of(pa.array(["the"]))[0][0]
    assert the in place.hot and place.parts[list(place.hot).index(the)] > 1
    spread, whole = (lm.sampled(docs, p, 1, 0)[3] for p in (place, lm.Places(4)))
    assert (spread.tokens, spread.types, spread.discount) == (whole.tokens, whole.types, whole.discount)
    assert spread.customers[0][0] == whole.customers[0][0] and spread.tables[0][0] == whole.tables[0][0]
    assert len({int(g) for g in place.block(np.full(50, the), np.arange(50, dtype=np.uint64))}) > 1


def test_common_words_are_written_as_numbers(spark):
    words = [f"word{i}" for i in range(3000)]
    texts = [" ".join(words[(i * 7 + j * j * 11) % 3000] for j in range(400)) for i in range(30)] + [None, ""]
    docs = spark.createDataFrame([(i, t, i % 5 == 0) for i, t in enumerate(texts)], "doc_id bigint, text string, held_out boolean")
    place = lm.places(docs, 2)
    assert set(lm.tokens_of(pa.array(texts))[0]) <= set(place.common) and (np.diff(place.common) > 0).all()
    plain = lm.Places(2, place.hot, place.parts)
    few, many = (lm.sampled(docs, p, 2, 0) for p in (place, plain))
    assert few[3].tokens == many[3].tokens and few[3].discount == many[3].discount
    assert all((a == b).all() for a, b in zip(few[3].tables + few[3].customers, many[3].tables + many[3].customers, strict=True))
    few, many = (s[0].agg(F.sum(F.octet_length("cells"))).first()[0] for s in (few, many))
    assert few < 0.7 * many


def test_packed_arrays_come_back():
    rng = np.random.default_rng(1)
    common = np.unique(rng.integers(0, 2**64, 50, np.uint64))
    mixed = np.concatenate([common[::3], rng.integers(0, 2**64, 9, np.uint64), common[:2]])
    arrays = [mixed, np.sort(mixed), common, common[:0], rng.integers(0, 2**40, 7), np.arange(300, dtype=np.uint16), np.array([True, False]), np.zeros(0, np.uint8)]
    for known in (common, lm.NO_WORDS, common[:1]):
        for a, b in zip(arrays, lm._unpack(lm._pack(*arrays, common=known), known), strict=True):
            assert a.dtype == b.dtype and (a == b).all()
    steps = lm._pairs(2**40, np.array([0, 5, 5]), np.array([7, 0, 2**39]))
    assert steps.dtype == np.int64 and [x.tolist() for x in lm._unpaired(2**40, steps)] == [[0, 5, 5], [7, 0, 2**39]]
