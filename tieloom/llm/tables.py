"""Small helpers for joins and for texts that go to Python workers."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tables of more rows than this are joined by shuffle instead of broadcast.
BROADCAST_ROWS = 500_000


def small(df: DataFrame) -> DataFrame:
    """A written table of a few narrow columns, with a broadcast hint if it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


#: Bytes of texts that a task sends to its Python worker at a time.
BATCH_BYTES = 4 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_small_batches(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``operator``, a function of a table of texts, with what it writes planned in Arrow batches of ``BATCH_BYTES``.

    By default a batch has 10,000 rows or 64 MB, whatever the texts' lengths, and a task holds it several times:
    while it is filled, while it is sent, and in the worker, which cuts it into slices anyway.
    """

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **kwargs):
        conf = docs.sparkSession.conf
        before = conf.get(_BATCHES, None)
        conf.set(_BATCHES, BATCH_BYTES)
        try:
            return operator(docs, *args, **kwargs)
        finally:
            if before is None:
                conf.unset(_BATCHES)
            else:
                conf.set(_BATCHES, before)

    return run
