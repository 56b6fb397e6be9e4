"""Language identification by compression.

1. Every language gets a dictionary: hash-chosen windows of its training texts, one per text and
   at most ``PIECES`` of them, normalised and cut to ``DICTIONARY`` bytes. This is the bounded
   sample that the classifier is fitted on; equal windows count once.
2. A text is normalised (lower case, every run of other signs than letters a space), cut into
   blocks, and each block is compressed with each dictionary as zstandard raw content. Blocks keep
   the dictionary, not the text's own past, as the place where matches are found; all of the text is
   coded. Short blocks use the strongest level, which finds matches of three bytes.
3. The language of the least total size wins; ties go to the language of more training texts, then
   to the smaller code point. The margin is the share by which the runner-up is larger. Where it
   is below ``LEAST_MARGIN`` the text is marked as not ``accepted``; ``score`` grows with it.

Map-only but for the sample. A null text, an empty one and one without a letter is ``und`` with score
0 and not accepted, as is every text where nothing was learned. Null languages and null texts are not
learned from. Repeated rows give repeated results; columns of other names are not read. Rows with
a null id are scored like others. With a single learned language margins are 0.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieloom.llm.tables import small
from tieloom.llm.words import slices

UNKNOWN = "und"
#: Most windows per language, their length in code points, bytes of a dictionary.
PIECES, WINDOW, DICTIONARY = 400, 1_500, 65_536
BLOCK, SHORT = 4_096, 512
LEVEL, SHORT_LEVEL = 6, 19
LEAST_MARGIN = 0.004
#: Margin at which the score is one half.
HALF = 0.02

_OTHER = re.compile(r"[\W\d_]+")


def normalised(text: str) -> str:
    """Lower-case letters with single spaces between; empty if there is no letter."""
    out = _OTHER.sub(" ", text.lower()).strip()
    return out if any(map(str.isalpha, out)) else ""


def training_windows(docs: DataFrame, learn: Column) -> DataFrame:
    """``lang, n, piece``: windows of the texts that ``learn`` selects, ``n`` texts of a language.

    A text is chosen by its hash among all of its language, so copies stand or fall together and
    are merged in the tasks that read them.
    """
    known = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    drawn = known.join(small(counts), "lang").where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) * F.col("n") < F.lit(3 * PIECES * (1 << 30)))
    room = F.greatest(F.length("text") - WINDOW + 1, F.lit(1))
    start = F.pmod(F.xxhash64(F.lit("window"), "text"), room).cast("int") + 1
    pieces = drawn.select("lang", "n", F.substring("text", start, F.lit(WINDOW)).alias("piece")).distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("piece"), "piece")
    return pieces.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PIECES).drop("rank")


def dictionaries(docs: DataFrame, learn: Column) -> list[tuple[str, bytes]]:
    """Language and dictionary, most training texts first. Each group has ``PIECES`` windows at most."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pieces = sorted(p for p in map(normalised, pdf["piece"]) if p)
        raw = " ".join(pieces).encode()[-DICTIONARY:]
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "n": [pdf["n"].iloc[0]], "raw": [raw]})

    rows = training_windows(docs, learn).groupBy("lang").applyInPandas(build, "lang string, n long, raw binary").collect()
    return [(r["lang"], bytes(r["raw"])) for r in sorted(rows, key=lambda r: (-r["n"], r["lang"])) if len(r["raw"]) >= 8]


class Compressors:
    """Sizes of texts under each dictionary."""

    def __init__(self, learned: list[tuple[str, bytes]]):
        self.names = [name for name, _ in learned]
        self.long = [self._compressor(raw, LEVEL) for _, raw in learned]
        self.short = [self._compressor(raw, SHORT_LEVEL) for _, raw in learned]

    @staticmethod
    def _compressor(raw: bytes, level: int) -> zstandard.ZstdCompressor:
        content = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False)

    def sizes(self, letters: str) -> list[int]:
        data = letters.encode()
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return [
            sum(len((strong if len(b) <= SHORT else usual).compress(b)) for b in blocks)
            for usual, strong in zip(self.long, self.short, strict=True)
        ]

    def decide(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin."""
        letters = normalised(text) if text else ""
        if not letters or not self.names:
            return UNKNOWN, 0.0, 0.0
        sizes = self.sizes(letters)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.names[0], 0.0, 0.0
        second = min(s for k, s in enumerate(sizes) if k != best)
        margin = (second - sizes[best]) / second
        return self.names[best], margin / (margin + HALF), margin


def identify(docs: DataFrame, learned: list[tuple[str, bytes]], least_margin: float = LEAST_MARGIN) -> DataFrame:
    """``doc_id, lang_pred, score, margin, accepted`` for every row of ``docs`` (``doc_id, text``)."""
    shared = docs.sparkSession.sparkContext.broadcast(learned)
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        compressors = Compressors(shared.value)
        for batch in slices(batches, 1):
            found = [compressors.decide(t.as_py()) for t in batch.column(1)]
            names, scores, margins = zip(*found, strict=True) if found else ((), (), ())
            accepted = [n != UNKNOWN and m >= least_margin for n, _, m in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64()), pa.array(accepted, pa.bool_())],
                ["doc_id", "lang_pred", "score", "margin", "accepted"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, lang_pred string, score double, margin double, accepted boolean")


def predict_languages(docs: DataFrame, held_out: Column) -> DataFrame:
    """Learns from the rows that ``held_out`` does not mark, and predicts for all.

    ``held_out`` is an expression of ``doc_id``; null counts as not held out.
    """
    marked = F.coalesce(held_out, F.lit(False))
    found = identify(docs, dictionaries(docs, ~marked))
    return found.select("doc_id", marked.alias("held_out"), "lang_pred", "score", "margin", "accepted")
