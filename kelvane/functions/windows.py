"""Windows whose aggregates cover the whole partition, ordered or not."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql.window import WindowSpec


def whole(*partition, order=()) -> WindowSpec:
    """Every row sees its whole partition; an order doesn't make the frame a running one."""
    spec = Window.partitionBy(*partition)
    spec = spec.orderBy(*order) if order else spec
    return spec.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def ranked(*partition, order=()) -> WindowSpec:
    """For ranks, lag and lead."""
    return Window.partitionBy(*partition).orderBy(*order)
