"""Each operator against its plain version, and on rows made to be awkward."""

from __future__ import annotations

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.llm import brute
from tieloom.llm import chat_format, decontamination, language_model, license_scan, mixing, near_dedup, nearest, pii, queries, substring_dedup, toxicity
from tieloom.llm.components import components

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)
#: Columns of names that operators use inside.
CLASHING = ["n", "rep", "comp", "key", "size", "b", "g", "part", "id", "v", "terms", "held_out", "s", "h", "source_key", "slice"]


def made_docs(spark, texts, first=0):
    rows = [(first + i, t, "en", f"s{i % 4}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    return df.select("*", *[F.lit(7).alias(c) for c in CLASHING if c not in df.columns])


def corpus(seed=3, n=120):
    """Texts with copies, near copies, shared passages, empties, nulls and a very long one."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    fresh = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage = fresh(60)
    texts = []
    for i in range(n):
        kind = i % 8
        if kind == 1 and texts:
            texts.append(rng.choice(texts))
        elif kind == 2 and texts:
            w = (rng.choice([t for t in texts if t]) or "x").split()
            for _ in range(max(1, len(w) // 40)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append("\n".join([" ".join(w[: len(w) // 2]), " ".join(w[len(w) // 2 :])]))
        elif kind == 3:
            texts.append(" ".join(fresh(20) + passage + fresh(15)))
        else:
            texts.append(" ".join(fresh(rng.choice([3, 5, 14, 40, 200]))))
    texts[5], texts[6], texts[7], texts[8] = None, "", "  \t\n ", "Ünïcode É one TWO three"
    texts[9] = " ".join(fresh(20_000))
    return texts


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return clashing(made_docs(spark, texts)).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_near_duplicates(docs, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == brute.near_duplicates(list(enumerate(texts)))


def test_near_duplicates_of_test_table(spark, small_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op5_near_duplicates(spark, small_dir).collect()}
    assert got == brute.near_duplicates(rows)


def test_near_duplicates_in_a_chain_and_a_large_star(spark):
    """A bucket whose members link to each other, but not all to the least of them."""
    base = [f"w{i}" for i in range(200)]
    chain = [" ".join(base[8 * i : 8 * i + 120]) for i in range(9)]
    star = [" ".join(base[:50] + [f"x{i}"] + base[51:]) for i in range(150)]
    rows = list(enumerate(chain + star))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == brute.near_duplicates(rows)


def test_near_duplicates_of_a_dense_group_without_links(spark):
    """Texts between half and three quarters alike: buckets stay open, nothing is linked but two copies."""
    rng = random.Random(8)
    core = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(2_000):
        w = list(core)
        for at in rng.sample(range(120), 4):
            w[at] = f"x{i}_{at}"
        rows.append((i, " ".join(w)))
    rows += [(5_000, rows[1_000][1]), (5_001, rows[1_001][1] + " end")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    # brute force: how many shingles any two share, as a product of the matrix of those that several hold
    sets = [brute.shingles(t) for _, t in rows]
    held = collections.Counter(x for own in sets for x in own)
    number = {x: k for k, x in enumerate(x for x, n in held.items() if n > 1)}
    matrix = np.zeros((len(rows), len(number)), np.float32)
    for k, own in enumerate(sets):
        matrix[k, [number[x] for x in own if x in number]] = 1
    both, sizes = matrix @ matrix.T, np.array([len(own) for own in sets])
    close = np.argwhere(np.triu(100 * both >= 75 * (sizes[:, None] + sizes - both), 1))
    links = [(rows[a][0], rows[b][0]) for a, b in close]
    want = {i: i for i, _ in rows}
    for i, j in links:  # few, found by brute force
        low, high = sorted((want[i], want[j]))
        want = {k: low if v == high else v for k, v in want.items()}
    assert 2 <= len(links) < 200 and got == want


def test_pairs_of_pieces_equal_plain_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(1, 2**62, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 270, replace=False), rng.integers(1, 2**62, 30, dtype=np.uint64)])) for _ in range(40)]
    key = int(near_dedup.bucket_keys(sets[0]).view(np.int64)[0])
    rows = [(k % 2, k, k % 7, len(s), -1, near_dedup.two_bits(s), near_dedup.bucket_keys(s).view(np.int64)) for k, s in enumerate(sets)]
    for _, _, _, _, _, _, bands in rows:
        bands[0] = key
    rows.sort(key=lambda r: r[:2])
    found = [tuple(sorted((rows[x][1], rows[y][1]))) for x, y in near_dedup._pairs_of_pieces(rows, key)]
    want = set()
    for a in rows:
        for b in rows:
            differ = np.bitwise_count((x := a[5].view(np.uint64) ^ b[5].view(np.uint64))[:16] | x[16:]).sum()
            if a[0] == 0 and b[0] == 1 and a[2] != b[2] and 4 * min(a[3], b[3]) >= 3 * max(a[3], b[3]) and differ <= near_dedup._MAY_DIFFER:
                want.add((min(a[1], b[1]), max(a[1], b[1])))
    assert want and set(found) == want and len(found) == len(want)


def test_near_duplicates_of_an_id_with_two_texts(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(5, a), (5, b), (2, a + " more"), (7, b + " more"), (9, "alone and away"), (5, a), (5, None)]
    got = sorted((r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [(2, 2), (5, 2), (5, 2), (5, 2), (5, 5), (7, 2), (9, 9)]


def test_near_duplicates_edge_rows(spark, empty):
    assert near_dedup.near_duplicates(empty).collect() == []
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (3, "")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 2, True), (3, 3, True)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 99), (99, 98), (5, 5)]
    got = {r["doc"]: r["comp"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 99: 98, 100: 98}


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2))
    b = np.unique(np.concatenate([a[:2250], rng.integers(0, 2**63, 400, dtype=np.uint64) * np.uint64(2)]))
    same = np.mean(near_dedup.signature(a) == near_dedup.signature(b))
    assert abs(same - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.15
    assert len(set(near_dedup.signature(a[::1000]))) == 3


def test_two_bits_keep_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    count = lambda x, y: sum(int(a ^ b | c ^ d).bit_count() for a, b, c, d in zip(x[:16], y[:16], x[16:], y[16:], strict=True))
    for n in (4, 9, 30, 170, 2000):
        for _ in range(60):
            u = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
            m = -(-3 * n // 4)
            a, b = np.sort(u[: m + (n - m) // 2]), np.sort(np.concatenate([u[:m], u[m + (n - m) // 2 :]]))
            x, y = near_dedup.two_bits(a).view(np.uint64), near_dedup.two_bits(b).view(np.uint64)
            assert n < near_dedup.SMALL or count(x, y) <= near_dedup._MAY_DIFFER
            assert set(near_dedup.bucket_keys(a)) & set(near_dedup.bucket_keys(b))


def test_substrings(docs, texts):
    want = brute.without_repeats(list(enumerate(texts)))
    rows = substring_dedup.remove_repeats(docs).collect()
    got = {r["doc_id"]: (r["n_words"], sum(s["end"] - s["start"] for s in r["removed"]), hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in rows}
    assert got == want and len(rows) == len(want)
    assert sum(x[1] for x in want.values()) > 500


def test_substrings_of_test_table(spark, small_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op7_substrings(spark, small_dir).collect()}
    assert got == brute.without_repeats(rows)


def test_substrings_edge_rows(spark, empty):
    assert substring_dedup.remove_repeats(empty).collect() == []
    t = " ".join(f"w{i}" for i in range(30))
    rows = [(4, t), (4, t), (None, t), (2, t), (9, "short text"), (10, "short text")]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], len(r["kept_text"].split())) for r in got) == [(0, 30, 30), (2, 30, 30), (4, 30, 0), (4, 30, 0), (9, 2, 2), (10, 2, 2)]


def test_least_hashes_agree_where_windows_do():
    h = np.random.default_rng(2).integers(0, 2**63, 60, dtype=np.uint64)
    again = np.concatenate([h[:5][::-1], h[20:40], h[:7]])
    assert (substring_dedup.least_hashes(again)[5 : 5 + 8] == substring_dedup.least_hashes(h)[20:28]).all()
    assert len(substring_dedup.least_hashes(h[:12])) == 0 and len(substring_dedup.least_hashes(h[:13])) == 1


def test_language_model(docs, texts):
    held = lambda d: brute.remainder(d, 5) == 1
    want = brute.base_scores(list(enumerate(texts)), held)
    rows = language_model.score_texts(docs.drop("held_out"), queries._remainder(5) == 1).collect()
    assert len(rows) == len(want)
    for r in rows:
        n, known, total, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, held(r["doc_id"]))
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0


def test_language_model_is_a_distribution_and_beats_the_base(spark, small_dir):
    rows = [r for r in queries.op8_language_model(spark, small_dir).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows) + 0.05 * abs(sum(r["base_score"] for r in rows))
    docs = spark.createDataFrame([(t,) for t in ("a b c a b", "a a c", "c b")], "text string")
    cells, totals, hot, _ = language_model.fit(docs, 2)
    p = sum(
        language_model.averaged(r["g"], r["cells"], totals, 1, np.repeat(w, 1024), np.tile(np.arange(1024), len(w)))[0].reshape(len(w), 1024).sum(0)
        for r in cells.collect()
        for w in [hot[language_model._group(hot, 2) == r["g"]]]
    )
    assert np.allclose(p + language_model.unknown(totals, 1), 1)


def test_language_model_edge_rows(spark, empty):
    assert language_model.score_texts(empty, queries._remainder(5) == 1).collect() == []
    rows = [(1, "a b"), (1, "a b"), (None, None)]
    got = {r["doc_id"]: r for r in language_model.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string"), F.lit(False)).collect()}
    assert got[1]["n_tokens"] == 6 and got[None]["n_tokens"] == 1


def test_seating():
    rng = np.random.default_rng(0)
    c = np.array([1, 2, 50, 100_000, 7])
    t = language_model.seat(c, np.full(5, 1e-9), 0.5, rng)
    assert (t == 1).all()
    t = language_model.seat(c, np.full(5, 1e9), 0.5, rng)
    assert (t >= 0.999 * c).all() and (t <= c).all()
    mean = np.mean([language_model.seat(np.array([30]), np.array([2.0]), 0.0, rng)[0] for _ in range(3000)])
    assert abs(mean - sum(2 / (2 + n) for n in range(1, 30)) - 1) < 0.2


PII_TEXTS = [
    "mail a.b+c@ex-a.co.uk, then x@y.z@q.org; @none a@b no", "ip 10.0.0.255 and 1.2.3.4.5.6.7.8 not 300.1.1.1 v1.2.3",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 12345678901234567890123", "call +1 (212) 555-0100 or +49.30.1234567 or +1234 +12 3",
    None, "", "IBAN DE89 3704 0044 0532 0130 00 at the bank; DE89370400440532013001", "my ssn is 123-45-6789" + " x" * 30 + " order 123-45-6789", "é😀 a@b.cd " * 40, "1" * 5000, "a" * 5000 + "@" + "b" * 50,
]


def test_pii(spark, empty):
    docs = clashing(made_docs(spark, PII_TEXTS))
    got = {r["doc_id"]: r["spans"] for r in pii.find_spans(docs).collect()}
    for i, text in enumerate(PII_TEXTS):
        assert [(s["kind"], s["start"], s["end"]) for s in got[i] if s["kind"] in pii.BASE_KINDS] == brute.base_spans(text), text
    assert [s["kind"] for s in got[6]] == ["iban"] and [s["kind"] for s in got[7]] == ["ssn"]
    assert pii.find_spans(empty).collect() == []


def test_pii_in_digit_runs_of_any_length(spark):
    run = "1" * 5_000
    texts = [f"{run}.2.3.4", f"{'0' * 5_000}.2.3.255", f"1.2.{run}.4 and 000255.1.1.1", ".".join([run] * 6), f"+{run}", f"4{run}", "256.1.1.1"]
    rows = pii.find_spans(made_docs(spark, texts)).orderBy("doc_id").collect()
    assert [[tuple(s)[:3] for s in r["spans"] if s["kind"] in pii.BASE_KINDS] for r in rows] == [brute.base_spans(t) for t in texts]
    masked = [r["text"] for r in pii.redact(made_docs(spark, texts)).orderBy("doc_id").collect()]
    assert masked[0] == texts[0] and masked[1] == "[IP]" and masked[2] == f"1.2.{run}.4 and [IP]"


def test_pii_of_test_table(spark, small_dir):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    for r in queries.op9_pii(spark, small_dir).collect():
        want = brute.base_spans(rows[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(x[0] == k for x in want) for k in pii.BASE_KINDS]


def test_redaction(spark):
    docs = made_docs(spark, ["write a@b.cd now", None, "plain"])
    got = [(r["text"], r["n_chars"]) for r in pii.redact(docs, length_column="n_chars").orderBy("doc_id").collect()]
    assert got == [("write [EMAIL] now", 17), (None, None), ("plain", 5)]


def test_random_texts_keep_the_base_spans():
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice("a1.@+- 2(5é") for _ in range(rng.randint(0, 40)))
        assert [(s.kind, s.start, s.end) for s in pii.spans_of(text) if s.kind in pii.BASE_KINDS] == brute.base_spans(text), text


def test_mixing(docs, texts):
    got = mixing.mix(docs).collect()
    sizes = [(i, f"s{i % 4}" if i % 7 else None, len(brute.words(t))) for i, t in enumerate(texts)]
    per, target = brute.mixed(sizes)
    source = {i: s for i, s, _ in sizes}
    taken = {}
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == sizes[r["doc_id"]][2] and r["source_size"] == per[s] and math.isclose(r["target"], target[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in per) and len(got) == len(texts)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(5), slice_rows=3).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}


def test_mixing_edge_rows(spark, empty):
    assert mixing.mix(empty).collect() == []
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, None, "x"), (2, "", None)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert len(got) == 4 and sum(r["taken"] for r in got) == 6


def test_decontamination(spark, docs, texts):
    long = texts[9].split()
    items = [(1, " ".join(long[500:530])), (2, " ".join(long[900:910] + ["zz"] + long[911:930])), (3, "one two"), (4, None), (5, ""), (6, "no such words in any text"), (1, "é"), (None, "one two")]
    items_df = clashing(spark.createDataFrame(items, "item_id bigint, text string"))
    got = {(r["doc_id"], r["item_id"]): (r["item_shingles"], r["shared"]) for r in decontamination.contaminated(docs, items_df).collect()}
    plain = brute.contaminated(list(enumerate(texts)), [x for x in items[1:6]])
    assert {k: v for k, v in got.items() if k[1] != 1} == plain and (8, 3) in plain
    assert 9 in {d for d, i in got if i == 1}
    kept = decontamination.decontaminate(docs, items_df)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len({d for d, _ in got})


def test_items_are_partitioned_by_size(spark):
    """Items of 1 to 300 shingles, whole, three quarters and less of them in long and short documents, some over two rows of an id."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(5000)}"
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([2, 5, 6, 7, 9, 12, 20, 36, 60, 68, 69, 130, 304] * 3)]
    texts = []
    for k, (_, text) in enumerate(items):
        words = text.split()
        part = words[: max(1, int(len(words) * (1, 0.85, 0.7)[k % 3]))]
        texts.append(" ".join([word() for _ in range(400 * (k % 2))] + part + [word() for _ in range(5)]))
    long = items[12][1].split()
    docs = [*enumerate(texts), (900, " ".join(long[:150])), (900, " ".join(long[146:]))]
    items_df = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): (r["item_shingles"], r["shared"]) for r in decontamination.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), items_df).collect()}
    assert got.pop((900, 12)) == (300, 300)
    want = brute.contaminated(list(enumerate(texts)), items)
    assert got == want and len(want) > 20
    classes = decontamination.classes_of(decontamination.sketches(decontamination.item_shingles(items_df)))
    assert [c for c, _ in classes] == [0, 1, 2, 3, 4, 5, 6, 8]
    hashes = spark.range(4000).select(F.xxhash64("id").alias("s"))
    probed = {r["size_class"]: r["n"] for r in decontamination.probes(hashes, classes).groupBy("size_class").agg(F.count("*").alias("n")).collect()}
    assert probed[8] < 4000 / 5 < probed[0]


def test_decontamination_empty(spark, empty, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.contaminated(docs, none).collect() == [] and decontamination.decontaminate(docs, none).count() == docs.count()
    assert decontamination.contaminated(empty, spark.createDataFrame([(1, "a b")], "item_id bigint, text string")).collect() == []


def test_toxicity_of_test_table(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op6_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count() and all(0 <= r["score"] <= 1 for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert sum(p == y for p, y in held) >= 0.95 * len(held) and not any(p > y for p, y in held)
    assert all(r["held_out"] == (brute.remainder(r["doc_id"], 3) == 1) for r in rows)


def test_toxicity_edge_rows(spark, empty, docs):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.score_texts(empty, none, queries._remainder(3) == 1)[0].collect() == []
    scored, model = toxicity.score_texts(docs.drop("held_out"), none, queries._remainder(3) == 1)
    assert scored.count() == docs.count() and scored.where("score >= 0.7").count() == 0 and model.correlation.shape == (5, 5)
    odd = spark.createDataFrame([(0, 1), (0, 1), (1, None), (None, 1)], "doc_id bigint, toxic int")
    assert toxicity.score_texts(docs.drop("held_out"), odd, queries._remainder(3) == 1)[0].count() == docs.count()


def test_label_model_finds_accuracies_and_copies():
    rng = np.random.default_rng(4)
    y = rng.random(20_000) < 0.2
    votes = [rng.random(len(y)) < np.where(y, hit, miss) for hit, miss in ((0.8, 0.02), (0.6, 0.05), (0.7, 0.01), (0.3, 0.3))]
    votes.append(votes[0])
    pattern, count = np.unique(sum(v.astype(int) << j for j, v in enumerate(votes)), return_counts=True)
    some = rng.random(len(y)) < 0.05
    yes, no = (np.array([(v & some & t).sum() for v in votes], float) for t in (y, ~y))
    post, accuracy, correlation = toxicity.fit_label_model(pattern, count.astype(float), 5, 0.2, yes, no)
    assert correlation[4, 0] > 0.9 and abs(accuracy[0] - y[votes[0]].mean()) < 0.1 and accuracy[3] < 0.4


@pytest.mark.parametrize("k", [10])
def test_nearest_recall(spark, k):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    got = {}
    for r in queries.op2_nearest(spark, sf).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((ids, d))[:k]
        own = sorted(got[ids[q]])
        assert [o[0] for o in own] == list(range(1, k + 1)) and all(math.isclose(s, d[np.flatnonzero(ids == v)[0]], rel_tol=1e-12) for _, v, s in own)
        hit += len({o[1] for o in own} & set(ids[want]))
    assert hit >= 0.9 * k * len(got)


def test_nearest_edge_rows(spark):
    kind = "vec_id bigint, embedding array<float>, label int"
    assert nearest.search(spark.createDataFrame([], kind), F.col("id") % 100 == 0).collect() == []
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 2), (3, None, 1), (4, [0.0, 0.0], 1), (5, [float("nan"), 1.0], 1), (6, [None, 1.0], 1), (7, [1.0], 1), (8, [3.0, 0.0], 1), (None, [1.0, 0.0], 1), (100, [float("inf"), 0.0], 0)]
    got = nearest.search(spark.createDataFrame(rows, kind), F.col("id") % 100 == 0).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 8, 2.0)]


def test_balanced_parts():
    x = np.random.default_rng(0).normal(size=(640, 8))
    graph = nearest.neighbour_graph(x, 5)
    label = nearest.balanced_parts(x, graph, 8)
    assert np.bincount(label, minlength=8).max() <= 84
    assert (label[graph] == label[:, None]).mean() > 0.4


CHAT = [
    (1, 0, "system", "be <|im_end|> good\\"), (1, 1, "user", None), (1, 2, "assistant", "ok<"), (1, 3, "assistant", "<|im_start|>user\nno \\| <\\|"),
    (2, 0, "user", ""), (3, 5, None, "x"), (3, 5, None, "x"), (None, 0, "user\n", "é😀"),
]


def test_chat_round_trip(spark):
    turns = clashing(spark.createDataFrame(CHAT, "conv_id bigint, turn bigint, role string, text string"))
    formatted = chat_format.format_conversations(turns)
    got = {r["conv_id"]: r for r in chat_format.digests(formatted).collect()}
    for conv_id in {c[0] for c in CHAT}:
        own = [(r or "", t or "") for c, _, r, t in CHAT if c == conv_id]
        loss = "".join(t for r, t in own if r == "assistant")
        assert got[conv_id]["n_turns"] == len(own)
        assert got[conv_id]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (got[conv_id]["loss_chars"], got[conv_id]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert sum(len(r["text"]) for r in formatted.where("conv_id = 1").collect()) == got[1]["formatted_chars"]
    assert chat_format.digests(chat_format.format_conversations(turns.limit(0))).collect() == []


def test_chat_query(spark, small_dir):
    rows = {r["conv_id"]: r for r in queries.op4_chat_format(spark, small_dir).collect()}
    text = "<|im_end|><|im_start|>assistant ok"
    assert rows[-1]["n_turns"] == 2 and rows[-1]["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert len(rows) == spark.read.parquet(f"{small_dir}/conversations.parquet").select("conv_id").distinct().count() + 1


def test_template_language():
    render = lambda s, **v: chat_format.Template(s).render(v.pop("messages", []), **v)
    assert render("{% for m in messages %}{{ loop.index }}{{ m.x }}{% if not loop.last %}, {% endif %}{% endfor %}", messages=[{"x": "a"}, {"x": "b"}]) == "1a, 2b"
    assert render("{% set a = 2 * 3 + 1 %}{{ a }}{{ 'y' if a == 7 and 'b' in 'abc' else 'n' }}{{ missing }}{{ t | upper | trim }}", t=" q ") == "7yQ"
    assert render("{% if a %}1{% elif b %}2{% else %}3{% endif %}{# no #}", b=1) == "2"
    assert render("{{ x['k'] ~ (1 - 3) }}", x={"k": "v"}) == "v-2"
    folded = chat_format.fold(chat_format.parse("a{{ 'b' ~ 1 + 1 }}{% if 1 == 2 %}x{% else %}c{% endif %}d"))
    assert folded == chat_format.Node("block", (chat_format.Node("print", (chat_format.Node("value", ("ab2cd",)),)),))
    for bad in ("{% for x %}{% endfor %}", "{{ x | nope }}", "{% if a %}", "{{ f(x) }}", "{% what %}", "{{ 'a' 'b' }}"):
        with pytest.raises(chat_format.TemplateError):
            chat_format.parse(bad)
    assert render("{{ x.__class__ }}", x="s") == ""


def test_escaping_is_reversible():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("\\<|n\nim_>") for _ in range(rng.randint(0, 12)))
        assert "<|" not in chat_format.escape(text) and chat_format.unescape(chat_format.escape(text)) == text
        assert "\n" not in chat_format.escape_role(text) and chat_format.unescape(chat_format.escape_role(text)) == text


def test_licenses(spark, empty):
    mit = license_scan.TEMPLATES["MIT/permission"]
    texts = [
        "some words\nReleased under the MIT License.\nmore", "We were licensed to drive. The license was old.", None, "",
        "intro\n\n" + mit.replace("free of charge", "at no cost").replace(", to any", ",\nto any") + "\n\nend",
        "x " * 3000 + "This work is licensed under the GNU General Public License, version 2. " + "y " * 3000,
        "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.\n",
    ]
    got = {}
    for r in license_scan.scan(clashing(made_docs(spark, texts))).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert {k: sorted(r["template"] for r in v) for k, v in got.items()} == {0: ["MIT"], 4: ["MIT/permission"], 5: ["GPL-2.0"], 6: ["CC-BY-NC-4.0"], 7: ["Apache-2.0", "MIT"]}
    assert texts[0][got[0][0]["start"] : got[0][0]["end"]] == "Released under the MIT License." and got[0][0]["differences"] == []
    assert got[4][0]["license"] == "MIT" and got[4][0]["differences"] == ["free of charge -> at no cost"] and got[5][0]["differences"] == []
    assert license_scan.scan(empty).collect() == []


@pytest.mark.parametrize(
    ("text", "licenses"),
    [
        ("Licensed under CC BY 4.0.", ["CC-BY-4.0"]), ("Licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0"]), ("Licensed under CC BY-NC-ND 4.0.", ["CC-BY-NC-ND-4.0"]),
        ("Licensed under CC-BY-NC-SA-4.0.", ["CC-BY-NC-SA-4.0"]), ("Licensed under CC BY 3.0.", []), ("Licensed under the MIT License", ["MIT"]),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]),
        ("This work is licensed under the GNU Affero General Public License, version 3.", ["AGPL-3.0"]),
        ("This work is licensed under the GNU General Public License, version 2.0.", ["GPL-2.0"]),
        ("This work is licensed under the GNU Free General Public License, version 3.", []),
        ("Licensed under the Apache License, Version 1.1", ["Apache-1.1"]), ("Licensed under the Apache License, Version 1.0", []),
        ("Released under the BSD License.", ["BSD"]), ("Released under the BSD 3-Clause License.", ["BSD-3-Clause"]), ("Released under the ISC License.", ["ISC"]),
        ("Released under the Zope License.", []), ("This work is not licensed under the GNU General Public License, version 3.", []),
        ("It was never released under the MIT License.", []), ("It is not. Released under the MIT License.", ["MIT"]),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"]),
        (license_scan.TEMPLATES["MIT/text"], ["MIT"]), (license_scan._BSD_START + license_scan._BSD_TWO, ["BSD-2-Clause"]),
    ],
)
def test_names_and_versions_decide(text, licenses):
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    assert [f[0] for f in scanner.findings(text)] == licenses
    assert [f[0] for f in scanner.findings(f"lorem ipsum dolor. {text} sit amet consectetur")] == licenses


def test_the_order_by_bytes_saved_decides(monkeypatch):
    """The header holds the short notice too: the order tells which is the finding."""
    text = license_scan.wording(license_scan.TEMPLATES["Apache-2.0/header"])
    named = lambda: [f[-1] for f in license_scan.Scanner(license_scan.TEMPLATES).findings(text)]
    assert named() == ["Apache-2.0/header"]
    saved = license_scan.Scanner.saved
    monkeypatch.setattr(license_scan.Scanner, "saved", lambda self, block, k: 10_000 - saved(self, block, k))
    assert named()[0] == "Apache-2.0"
    monkeypatch.setattr(license_scan.Scanner, "saved", lambda self, block, k: 0)
    assert named() == []


def test_a_template_is_compiled_once_and_keeps_nothing(monkeypatch):
    parsed = []
    parse = chat_format.parse
    monkeypatch.setattr(chat_format, "parse", lambda source: parsed.append(source) or parse(source))
    template = chat_format.Template(chat_format.DEFAULT_TEMPLATE)
    talks = [[{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], [], [{"role": "assistant", "content": "c"}]]
    together = [template.render(t) for t in talks + talks]
    assert len(parsed) == 1 and together == 2 * [chat_format.Template(chat_format.DEFAULT_TEMPLATE).render(t) for t in talks]


NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "MIT": "Released under the MIT License.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.", "reserved": "All rights reserved.",
}


def test_licenses_of_test_table_against_a_plain_search(spark):
    sf = "/root/testdata/sf0.01"
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        for name, notice in NOTICES.items():
            at = (r["text"] or "").find(notice)
            while at >= 0:
                want.add((r["doc_id"], name, at))
                at = r["text"].find(notice, at + 1)
    got = [(r["doc_id"], r["license"], r["start"]) for r in queries.op1_licenses(spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {x[1] for x in want} == set(NOTICES)


def test_licenses_in_running_text():
    """Each template between words that do not compress, with no line break, as it is and with changed wording."""
    scanner, rng = license_scan.Scanner(license_scan.TEMPLATES), random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n))
    for name, marked in license_scan.TEMPLATES.items():
        notice = license_scan.wording(marked)
        before = prose(300) + ". "
        text = before + notice + " " + prose(300)
        (got,) = scanner.findings(text)
        assert (got[6], got[1], got[4], got[5]) == (name, len(before), 1.0, []) and text[got[1] : got[2]] == notice.rstrip(":"), name
        (again,) = scanner.findings(" ".join([before, notice.upper(), prose(200)]))
        assert again[6] == name
    changed = {"Apache-2.0/header": ("compliance", "accordance"), "MIT/permission": ("free of charge", "at no cost"), "MIT": ("Released", "Distributed")}
    for name, (old, new) in changed.items():
        (got,) = scanner.findings(f"{prose(200)} {license_scan.wording(license_scan.TEMPLATES[name]).replace(old, new)} {prose(200)}")
        assert got[6] == name and got[5] == [f"{old.lower()} -> {new.lower()}"], got
    saves_little = "shth the and thaning edst thingedan stble that worthless inghewh aerndtionre ththed ernt.\nAll rights reserved."
    assert [f[6] for f in scanner.findings(saves_little)] == ["reserved/alone"]
    close = "Zope-style: Released under the Zope License. Released under the MIT License. All rights reserved. Licensed under the Apache License, Version 2.0."
    assert [f[6] for f in scanner.findings(close)] == ["MIT", "reserved/alone", "Apache-2.0"]
    assert not list(scanner.findings(f"the works were released {prose(40)} under {prose(30)} the rules of all {prose(9)} license rights {prose(9)} were reserved"))


def test_nearest_groups_are_bounded_on_both_sides(spark, monkeypatch):
    """Each group gets a chunk of the queries, and small blocks and chunks give the neighbours of a plain search."""
    plain = nearest._ranked

    def watched(queries_, query_ids, x, ids, k):
        if max(len(query_ids), len(ids)) > 100:
            raise ValueError(f"{len(query_ids)} queries meet {len(ids)} vectors")
        return plain(queries_, query_ids, x, ids, k)

    monkeypatch.setattr(nearest, "_ranked", watched)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    rows = nearest.search(vectors, F.col("id") % 3 == 0, k=5, parts=2, probes=2, block_rows=50, query_chunk=20).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for q in range(0, 600, 3):
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(1)
        d[q] = np.inf
        assert got[q] == np.lexsort((np.arange(600), d))[:5].tolist()


def test_sketches_are_loss_free_up_to_59_shingles(spark):
    sizes = [1, 4, 20, 58, 59, 60, 200]
    items = spark.createDataFrame([(n, 5, list(range(n))) for n in sizes], "item_id bigint, words int, shingles array<bigint>")
    got = {r["item_id"]: (r["count"], n - r["needs"]) for r in decontamination.sketches(items).groupBy("item_id", "needs").count().collect() for n in [r["item_id"]]}
    assert [n for n in sizes if got[n][0] > got[n][1]] == [1, 4, 20, 58, 59] and got[60] == (15, 15)


def test_groups_of_least_hashes_grow_with_the_text(spark, docs, texts, monkeypatch):
    plain, groups = substring_dedup._least_hash_blobs, []

    def watched(single, buckets, n):
        groups.append(n)
        return plain(single, buckets, n)

    monkeypatch.setattr(substring_dedup, "_least_hash_blobs", watched)
    monkeypatch.setattr(substring_dedup, "HASH_GROUP_BYTES", 1 << 11, raising=False)
    got = {r["doc_id"]: (r["n_words"], sum(s["end"] - s["start"] for s in r["removed"])) for r in substring_dedup.remove_repeats(docs).collect()}
    assert groups[0] >= sum(len((t or "").encode()) for t in texts) // (1 << 11) > 4 * 4
    assert got == {d: x[:2] for d, x in brute.without_repeats(list(enumerate(texts))).items()}
