"""Joins that keep their balance when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: No more hot keys than this are ever looked for, so what is broadcast has this bound of rows.
MOST_HOT_KEYS = 1000
#: A key with fewer rows is never hot.
LEAST_HOT_ROWS = 200_000


def hot_keys(left: DataFrame, key: str, least_rows: int = LEAST_HOT_ROWS) -> list:
    """Keys of ``left`` that own at least ``least_rows`` rows and a thousandth of all rows: at most MOST_HOT_KEYS.

    Counted with map-side combining, and only if there are rows enough for one; NULL is never a key.
    """
    total = left.count()
    if total < least_rows:
        return []
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return [r[0] for r in counts.where(F.col("_n") >= max(least_rows, -(-total // MOST_HOT_KEYS))).select(key).collect()]


def lookup_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", least_rows: int = LEAST_HOT_ROWS) -> DataFrame:
    """``left`` joined to ``right`` (unique by ``key``; ``how`` is left or inner) without sending a hot key to one task.

    Rows of the few hot keys meet a broadcast of just those keys' rows (at most MOST_HOT_KEYS rows, as ``right`` is
    unique); all other rows take an ordinary shuffled join. An empty ``left`` gives an empty result, NULL keys match
    nothing. ``left`` is read up to four times: pass a checkpointed or cheaply scanned frame.
    """
    hot = hot_keys(left, key, least_rows)
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    cold = left.where(~is_hot | F.col(key).isNull()).join(right.where(~is_hot), key, how)
    warm = left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how)
    return cold.unionByName(warm)
