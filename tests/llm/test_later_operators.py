"""Language identification, conversation repair and the prefix trie."""

from __future__ import annotations

import random
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.llm import brute_conversations as brute
from tests.llm.test_operators import DOCS, clashing, made_docs
from tieloom.llm import conversation_repair, language_id, prefix_trie, queries

TURNS = T.StructType(
    [T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]
)

def damage():
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    return F.pmod(F.crc32(named.cast("binary")), F.lit(20))


def borrowed():
    return F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4))


def awkward_turns(seed=5):
    """Conversations with nulls, ties, repeated rows, odd roles, copies, a long one and negative ids."""
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    texts = ["Yes.", "No", "", None, " \t", "Well, well!", "x\ny?  ", "line", "É.", "a b c d."]
    rows = []
    for conv in [None, *range(-3, 90)]:
        for turn in range(rng.randint(1, 6)):
            rows.append((conv, rng.choice([turn, turn, turn, None, 2]), rng.choice(roles), rng.choice(texts)))
    rows += [(conv, t, r, x) for conv in range(100, 140) for t, (r, x) in enumerate([("user", "Same."), ("assistant", "Same again."), ("user", "And?"), ("assistant", f"{conv // 10}.")])]
    rows += [(200 + k, t, "user" if t % 2 == 0 else "assistant", f"turn {t if t < 150 else t + k}.") for k in range(3) for t in range(200)]
    rows += [(300, 0, "user", "w " * 200_000 + "."), (300, 0, "user", "w " * 200_000 + ".")] + [rows[7]] * 3
    rng.shuffle(rows)
    return rows


def turns_of(spark, rows):
    return spark.createDataFrame(rows, TURNS).repartition(5)


# --- repair ---------------------------------------------------------------------------------


def test_auction_gives_the_least_of_the_cheapest_edits():
    rng, names = random.Random(4), {"o": "tool", "s": "system", "u": "user", "a": "assistant"}
    for trial in range(1500):
        codes = "".join(rng.choice("osuaOSUA0123" if trial % 2 else "suauauaUA3") for _ in range(rng.randint(1, 9)))
        rows = [(0, names[conversation_repair._INITIAL[c]], "t") for c in codes]
        marks = ["blank" if c in conversation_repair.DOOMED else "truncated" if c in conversation_repair.TRUNCATED else "" for c in codes]
        end = [0, conversation_repair.FAR, conversation_repair.FAR, 0]
        price = conversation_repair.settle(codes, end, True)
        letters, cost, _ = conversation_repair.trace(codes, end, True, price, 0)
        assert (cost, letters) == brute.cheapest(rows, marks)[:2]
        assert price[0] == cost
        cut = rng.randint(1, len(codes))
        if cut < len(codes):
            table, behind = conversation_repair.distances(codes[:cut]), conversation_repair.settle(codes[cut:], end, True)[:4]
            assert [min(table[4 * s + e] + behind[e] for e in range(4)) for s in range(4)] == price[:4]


def test_prices_are_feasible_and_edits_tight():
    codes = "suUA0uaaus3a" * 30
    end = [0, conversation_repair.FAR, conversation_repair.FAR, 0]
    price = conversation_repair.settle(codes, end, True)
    for place, code in enumerate(codes):
        for state in range(4):
            ways = [c + price[4 * (place + step) + to] for _, c, step, to in conversation_repair._arcs(code, state)]
            assert price[4 * place + state] == min(ways)


@pytest.mark.parametrize("segment", [4096, 3])
def test_repair_against_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(conversation_repair, "SEGMENT", segment)
    rows = awkward_turns()
    turns = turns_of(spark, rows).withColumns({c: F.lit(7) for c in ("at", "ck", "seg", "first", "kind", "copy", "same", "cost")})
    got = {r["conv_id"]: tuple(r)[1:] for r in conversation_repair.damage_and_repair(turns, damage()).collect()}
    assert got == brute.repaired(rows)


def test_repair_of_rows_that_need_none_and_of_nothing(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello.")]
    found, lines = conversation_repair.repair(conversation_repair.damaged(turns_of(spark, rows), F.lit(9)))
    assert [(r["cost"], r["audit"]) for r in found.collect()] == [(0, "KKK")]
    assert [(r["role"], r["text"]) for r in lines.orderBy("at", "part").collect()] == [(r, x) for _, _, r, x in rows]
    assert conversation_repair.damage_and_repair(turns_of(spark, []), damage()).count() == 0
    gone = conversation_repair.damage_and_repair(turns_of(spark, rows), F.lit(0)).collect()
    assert [tuple(r) for r in gone] == [(1, 0, 0, 0, 0, 0, 0, "", brute.sha(""))]


def test_repair_query(spark, small_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{small_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r["conv_id"]: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, small_dir).collect()} == brute.repaired(rows)


# --- trie -----------------------------------------------------------------------------------


def test_search_tree_is_balanced():
    rows = [("", [k], [1], 1, k, (0, 0, 0)) for k in range(1023)]
    tree = prefix_trie.balanced(rows)

    def height(at):
        return 0 if at < 0 else 1 + max(height(tree.smaller[at]), height(tree.larger[at]))

    assert height(tree.follows[tree.top]) == 10
    assert [tree.symbol[at] for at in tree.listed() if tree.level[at] == 1][0] == 511


@pytest.mark.parametrize(("layer", "shard"), [(64, 65_536), (50, 40), (2, 7)])
def test_trie_against_brute_force(spark, monkeypatch, layer, shard):
    monkeypatch.setattr(prefix_trie, "LAYER", layer)
    monkeypatch.setattr(prefix_trie, "SHARD", shard)
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = awkward_turns()
    if layer == 2:
        rows = [r for r in rows if r[0] is None or r[0] < 200 or r[0] == 300 or r[1] < 9]
    turns = turns_of(spark, rows).withColumns({c: F.lit(7) for c in ("id", "words", "pos", "at", "root", "key", "level", "least", "members")})
    got = [tuple(r) for r in prefix_trie.prefix_trie(turns, borrowed()).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute.trie(rows)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert prefix_trie.prefix_trie(turns_of(spark, []), borrowed()).count() == 0
    assert prefix_trie.prefix_trie(turns_of(spark, [(None, 0, "user", "x")]), borrowed()).count() == 0
    lone = next(c for c in range(21, 99) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 2)
    rows = [(lone, 0, "user", "a b"), (lone, 1, "assistant", "c")]
    assert [tuple(r) for r in prefix_trie.prefix_trie(turns_of(spark, rows), borrowed()).collect()] == [(lone, 0, None, 1, 0, 1, 0, brute.sha(str(lone)))]


# --- languages ------------------------------------------------------------------------------


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = docs.select("doc_id", F.col("lang").alias("truth"), "text")
    found = queries.op11_language_id(spark, "/root/testdata/sf0.01").join(truth, "doc_id").where("held_out").toPandas()
    assert (found["lang_pred"] == found["truth"]).mean() > 0.98
    assert found["score"].between(0, 1).all()
    sure = found[found["accepted"]]
    assert len(sure) > 0.9 * len(found) and (sure["lang_pred"] == sure["truth"]).mean() > 0.99


def test_languages_use_the_text_alone(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    held_out = queries._remainder(4) == 2
    plain = language_id.predict_languages(docs, held_out).select("doc_id", "lang_pred", "score")
    hidden = docs.withColumn("lang", F.when(~held_out, F.col("lang"))).withColumns({"source": F.lit(None).cast("string"), "n": F.lit(1), "piece": F.lit("x"), "rank": F.lit(0)})
    assert sorted(plain.collect()) == sorted(language_id.predict_languages(hidden, held_out).select("doc_id", "lang_pred", "score").collect())


def test_languages_of_awkward_texts(spark):
    english, german = "the cat and the dog went over there with them ", "der hund und die katze gingen nicht zusammen weg "
    rows = [(i, (english if i % 2 else german) * 3, "en" if i % 2 else "de", "s", 0) for i in range(0, 40)]
    rows += [(None, english, None, None, None), (50, None, "en", None, None), (51, "", "en", None, None), (52, " 12 ½ _ \t!", "de", None, None)]
    rows += [(53, english * 20_000, None, None, None), (54, german.upper() + "###", None, None, None), (54, german.upper() + "###", None, None, None)]
    found = language_id.predict_languages(clashing(spark.createDataFrame(rows, DOCS)), F.col("doc_id") >= 50)
    by_id = {r["doc_id"]: r for r in found.collect()}
    assert found.count() == len(rows)
    assert by_id[None]["lang_pred"] == "en" and by_id[None]["held_out"] is False
    for k in (50, 51, 52):
        assert (by_id[k]["lang_pred"], by_id[k]["score"], by_id[k]["accepted"]) == ("und", 0.0, False)
    assert by_id[53]["lang_pred"] == "en" and by_id[54]["lang_pred"] == "de"
    assert language_id.predict_languages(made_docs(spark, []), F.col("doc_id") > 0).count() == 0
    unlearned = language_id.predict_languages(made_docs(spark, ["some words"]).withColumn("lang", F.lit(None).cast("string")), F.lit(False))
    assert [r["lang_pred"] for r in unlearned.collect()] == ["und"]


def test_sizes_are_those_of_the_compressor():
    """Brute force: each block coded anew with a fresh compressor."""
    import zstandard

    learned = [("en", b"the cat and the dog went over there " * 40), ("de", b"der hund und die katze gingen weg " * 40)]
    letters = language_id.normalised("The dog, and THE cat: went 12 times! " * 400)
    want = []
    for _, raw in learned:
        total = 0
        for i in range(0, len(letters), language_id.BLOCK):
            block = letters.encode()[i : i + language_id.BLOCK]
            level = language_id.SHORT_LEVEL if len(block) <= language_id.SHORT else language_id.LEVEL
            content = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            total += len(zstandard.ZstdCompressor(level=level, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False).compress(block))
        want.append(total)
    compressors = language_id.Compressors(learned)
    assert compressors.sizes(letters) == want
    assert compressors.decide("The dog, and THE cat: went 12 times! " * 400)[0] == "en"
