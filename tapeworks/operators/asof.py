"""Lookups along time: as-of joins and interval joins, by equal keys and time buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.operators import windows


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_t: str,
    right_t: str,
    right_order: str,
    values: list[str],
    direction: str = "backward",
    inclusive: bool = True,
    width: int = windows.HOUR,
) -> DataFrame:
    """Each left row with ``values`` of the last right row at or before its time (backward), or the
    first at or after it (forward); strictly before or after if not ``inclusive``. Of right rows
    with one time the last by ``right_order`` counts backward, the first forward. No match: null.

    Both sides are tagged into one frame, sorted once per key and bucket of ``width``, and carried
    on, over the ends of buckets too. Forward is backward along negative time.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"direction must be 'backward' or 'forward', not {direction!r}")
    way = F.lit(1 if direction == "backward" else -1)
    names = left.columns
    row, found = left.select(F.struct(*names)).schema[0].dataType, right.select(F.struct(*values)).schema[0].dataType
    probe = left.select(*by, (F.col(left_t) * way).alias("__t"), F.lit(1 if inclusive else -1).alias("__side"), F.lit(0).cast("long").alias("__o"), F.struct(*names).alias("__row"), F.lit(None).cast(found).alias("__v"))
    points = right.select(*by, (F.col(right_t) * way).alias("__t"), F.lit(0).alias("__side"), (F.col(right_order).cast("long") * way).alias("__o"), F.lit(None).cast(row).alias("__row"), F.struct(*values).alias("__v"))
    both = windows.known(probe.unionByName(points), by, ["__t", "__side", "__o"], {"__f": F.col("__v")}, width)
    return both.where("__row IS NOT NULL").select("__row.*", *[F.col(f"__f.{v}").alias(v) for v in values])


def interval_join(points: DataFrame, spans: DataFrame, by: list[str], t: str, begin: str, end: str, width: int) -> DataFrame:
    """Points inside closed intervals of their key: intervals are exploded over time buckets of
    ``width``, so the join is by equality; each pair is found in its point's bucket alone. The
    result is as large as there are pairs; interval_sums() gives sums without them."""
    dealt = spans.withColumn("__b", F.explode(F.sequence(F.floor(F.col(begin) / width), F.floor(F.col(end) / width))))
    return points.withColumn("__b", F.floor(F.col(t) / width)).join(dealt, [*by, "__b"]).where(F.col(t).between(F.col(begin), F.col(end))).drop("__b")


def interval_sums(points: DataFrame, spans: DataFrame, by: list[str], t: str, order: str, begin: str, end: str, sums: dict, width: int = windows.HOUR) -> DataFrame:
    """Spans with sums over the points in their closed intervals, 0 without any: running sums
    before the begin are subtracted from those at the end, so no pairs are made."""
    running = windows.cumulative(points, by, [t, order], sums, width).select(*by, t, order, *sums)
    upto = asof_join(spans, running, by, end, t, order, list(sums), "backward", True, width)
    upto = upto.withColumnsRenamed({n: f"__upto_{n}" for n in sums})
    both = asof_join(upto, running, by, begin, t, order, list(sums), "backward", False, width)
    return both.withColumns({n: F.coalesce(f"__upto_{n}", F.lit(0)) - F.coalesce(n, F.lit(0)) for n in sums}).select(*spans.columns, *sums)
