"""Latest row per business key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_by(
    df: DataFrame,
    key: str | Sequence[str],
    order: str = "load_timestamp",
    tiebreak: Sequence[str] = ("load_batch_id",),
) -> DataFrame:
    """Keep the newest row of each key; ``tiebreak`` columns (descending) settle equal times.

    Catalyst turns the rank filter into a window group limit that already runs before the
    shuffle, so at most one row per key and task is moved, however hot the key.
    """
    keys = [key] if isinstance(key, str) else list(key)
    newest = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in (order, *tiebreak)])
    return df.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")
