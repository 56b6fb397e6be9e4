"""The pipeline against its stages' own rules."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tieloom.llm import near_dedup, pii, tables, toxicity
from tieloom.staging import staged


def test_stages(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, small_dir), "stage")
        seen[name] = docs
        if name != "mixing":
            assert docs.columns == columns
    before, after = seen["toxicity"], seen["near duplicates"]
    want = brute.near_duplicates([(r["doc_id"], r["text"]) for r in before.collect()])
    assert {r["doc_id"] for r in after.collect()} == {d for d, (_, c) in want.items() if c == d}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()]
    found = brute.contaminated([(r["doc_id"], r["text"]) for r in after.collect()], items)
    clean = seen["decontamination"].collect()
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in after.collect()} - {d for d, _ in found}
    masked = {r["doc_id"]: r for r in seen["personal data"].collect()}
    assert all(masked[r["doc_id"]]["text"] == pii.masked(r["text"]) for r in clean)
    sizes = [(r["doc_id"], r["source"], len(brute.words(r["text"]))) for r in masked.values()]
    _, target = brute.mixed(sizes)
    source = {d: s for d, s, _ in sizes}
    mixed = seen["mixing"].collect()
    assert len(mixed) == len(sizes) and all(abs(r["target"] - target[source[r["doc_id"]]]) < 1e-6 for r in mixed)


def test_run_equals_the_stages(spark, small_dir):
    assert corpus_pipeline.run(spark, small_dir).columns == ["doc_id", "size", "source_size", "target", "taken"]


def masked_plainly(text):
    """The text with the base spans of the contract masked, overlapping ones as one; added kinds are left out."""
    out, done = [], 0
    for kind, start, end in sorted(brute.base_spans(text), key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join(out) + text[done:]


def test_personal_data_is_masked_whatever_stands_nearby(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect() if brute.base_spans(r["text"])]
    for word in pii.DOUBT:
        rows += [(-1, f"{word} +1 (212) 555-0100 {word}"), (-2, f"{word} 10.0.0.255"), (-3, f"4111 1111 1111 1111 {word}"), (-4, f"a@b.cd, {word}")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.mask_personal_data(spark, docs.withColumn("n_chars", F.length("text")), "").collect())
    original = dict(rows)
    plain = [(d, t) for d, t in got if d >= 0 and all(s.kind in pii.BASE_KINDS for s in pii.spans_of(original[d]))]
    assert len(plain) > 100 and all(t == masked_plainly(original[d]) for d, t in plain)
    assert {t for d, t in got if d < 0} == {masked_plainly(t) for d, t in rows if d < 0}
    texts = dict(got)
    assert "+1 (068) 555-2748" not in texts[2403] and "213.174.22.103" not in texts[3029]


def test_masking_of_long_digit_runs(spark):
    text = "1" * 5_000 + ".2.3.4 and 0" + "0" * 5_000 + "9.9.9.9"
    docs = spark.createDataFrame([(1, text, len(text))], "doc_id bigint, text string, n_chars bigint")
    row = corpus_pipeline.mask_personal_data(spark, docs, "").first()
    assert row["text"] == masked_plainly(text) and row["n_chars"] == len(row["text"])


def test_texts_go_to_workers_in_small_batches(spark):
    docs = spark.range(40, numPartitions=1).selectExpr("id AS doc_id", "repeat('word ', 100000) AS text")

    def bytes_of(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    def largest(docs):
        return staged(docs.mapInArrow(bytes_of, "n long"), "sizes").agg(F.max("n")).first()[0]

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    assert largest(docs) > 4 * tables.BATCH_BYTES
    assert tables.in_small_batches(largest)(docs) < tables.BATCH_BYTES + (1 << 20)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == before
    assert all(hasattr(f, "__wrapped__") for f in (near_dedup.near_duplicates, toxicity.score_texts))
