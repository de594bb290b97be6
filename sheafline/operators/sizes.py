"""Broadcasting behind a check of size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A side is broadcast up to this many bytes, as Spark estimates them.
BROADCAST_BYTES = 32 << 20


def estimated_bytes(table: DataFrame) -> int:
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(table: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Marked for broadcast if its estimated size is within the limit; else as it is, for Spark to shuffle."""
    return F.broadcast(table) if estimated_bytes(table) <= limit else table
