"""Words of text columns as numpy arrays, for use inside tasks.

A word is a maximal run of bytes other than space and 0x09-0x0D; lower-casing touches A-Z only.
Work goes over the Arrow buffer of a batch in slices of bounded size, so one very long text
costs no more memory at a time than many short ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words as Spark's SQL splits them.
WORD = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLICE_BYTES = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits; a bijection."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """Word boundaries of a string array: byte ``starts`` and ``ends`` in ``data``, and for
    text i the words ``first[i]`` to ``first[i + 1]``. Null texts have no words."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        n = len(texts)
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        low, high = int(bounds[0]), int(bounds[-1])
        raw = np.frombuffer(data, np.uint8)[low:high] if data is not None and high > low else np.zeros(0, np.uint8)
        self.bounds = bounds - low
        inside = ~_SPACE[raw]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        finishes = inside.copy()
        finishes[:-1] &= ~inside[1:]
        edges = self.bounds[1:-1]
        edges = edges[(edges > 0) & (edges < len(raw))]
        begins[edges] = inside[edges]
        finishes[edges - 1] = inside[edges - 1]
        self.data = raw
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(finishes) + 1
        self.first = np.searchsorted(self.starts, self.bounds)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, lower: bool = True, last_bytes: int | None = None) -> np.ndarray:
        """64-bit hash of each word, or of its last bytes only."""
        starts = self.starts if last_bytes is None else np.maximum(self.starts, self.ends - last_bytes)
        out = np.empty(len(starts), np.uint64)
        lengths = self.ends - starts
        if not len(out):
            return out
        power = np.full(int(lengths.max()), _BASE, np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        total = np.cumsum(lengths)
        i = 0
        while i < len(out):
            before = int(total[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(total, before + _SLICE_BYTES)))
            own = lengths[i:j]
            at = np.cumsum(own) - own
            place = np.arange(int(own.sum())) - np.repeat(at, own)
            chars = self.data[np.repeat(starts[i:j], own) + place]
            values = _BYTE_VALUE[_LOWER[chars] if lower else chars] * power[place]
            out[i:j] = np.add.reduceat(values, at)
            i = j
        return mix(out)


def sequence_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values; empty if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _BASE + h[j : j + n]
    return mix(out)


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of about ``most`` bytes of the text column, a row at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        first = 0
        while first < batch.num_rows:
            before = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(first, last - first)
            first = last


def word_count(text: Column) -> Column:
    """Number of words; 0 for null. JVM-side."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
