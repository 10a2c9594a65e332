"""How many tasks rows are dealt to."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of one task: several sorts and maps of one stage hold them at once.
ROWS = 100_000
FEW = 5_000


def dealt(rows: DataFrame, *keys: str, n: int | None = None, size: int = ROWS) -> DataFrame:
    """``rows`` dealt by ``keys`` to so many tasks that each gets about ``size`` rows, however well they compress.

    Windows and groupings whose keys include these follow without a shuffle. ``n`` is the number of
    rows, counted if it is not given; a stream, which can't be counted, is dealt by the session's setting.
    """
    if rows.isStreaming:
        return rows.repartition(*keys)
    n = rows.count() if n is None else n
    busy = min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // FEW))  # few rows are not worth a task
    return rows.repartition(max(1, busy, -(-n // size)), *keys)
