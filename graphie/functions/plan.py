"""Hints on how a column is evaluated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def computed_once(col: Column) -> Column:
    """The same value, in a projection that filters are not pushed through.

    A filter on a computed column is rewritten to recompute the column below, as often as
    the condition mentions it. That is right for cheap columns, and doubles the work of a
    rewritten text. Anything that depends on the partition number stays in its place.
    """
    return F.when(F.spark_partition_id() >= 0, col)


def spread_key(key: str, own: str) -> Column:
    """A key for a left join in which rows without a key do not gather in one task.

    They get a key of their own that no word equals, dealt by the column ``own``.
    """
    return F.coalesce(F.col(key), F.concat(F.lit("\x00"), F.col(own)))
