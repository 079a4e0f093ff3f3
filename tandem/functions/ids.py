"""Times and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def snowflake_seconds(post_id: Column) -> Column:
    """Seconds, with milliseconds, since the platform's own start, from an id that holds them above 22 bits."""
    return F.shiftright(post_id.cast("bigint"), 22) / F.lit(1000.0)
