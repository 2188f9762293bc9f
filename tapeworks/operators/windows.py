"""Event-time windows that never look past the current event, cut by key and time bucket.

A key may hold any share of all events, so nothing is partitioned by key alone: rows are windowed
within buckets of time, and what a bucket passes on (its last values, its sums, its number of rows)
goes on through the small table of buckets. Trailing windows see the bucket before as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000_000

_BUCKET = "__bucket"


def _cut(frame: DataFrame, t: str, width: int) -> DataFrame:
    return frame.withColumn(_BUCKET, F.floor(F.col(t) / F.lit(width)).cast("long"))


def _with_before(local: DataFrame, per_bucket: DataFrame, by: list[str], last: list[str], total: list[str]) -> DataFrame:
    """``local`` with the buckets' columns brought forward to the next: p_<name>."""
    w = Window.partitionBy(*by).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    before = [F.last(f"__{n}", ignorenulls=True).over(w).alias(f"__p_{n}") for n in last] + [F.sum(f"__{n}").over(w).alias(f"__p_{n}") for n in total]
    return local.join(per_bucket.select(*by, _BUCKET, *before), [*by, _BUCKET])


def known(frame: DataFrame, by: list[str], order: list[str], values: dict[str, Column], width: int = HOUR) -> DataFrame:
    """The last non-null value up to each row, by columns of ``order``, the first of which is time."""
    cut = _cut(frame, order[0], width).withColumns({f"__{n}": v for n, v in values.items()})
    w = Window.partitionBy(*by, _BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumns({n: F.last(f"__{n}", ignorenulls=True).over(w) for n in values}).drop(*[f"__{n}" for n in values])
    at = F.struct(*order)
    per = cut.groupBy(*by, _BUCKET).agg(*[F.max_by(f"__{n}", F.when(F.col(f"__{n}").isNotNull(), at)).alias(f"__{n}") for n in values])
    both = _with_before(local, per, by, list(values), [])
    return both.withColumns({n: F.coalesce(n, f"__p_{n}") for n in values}).drop(_BUCKET, *[f"__p_{n}" for n in values])


def previous(frame: DataFrame, by: list[str], order: list[str], columns: list[str], prefix: str = "p_", width: int = HOUR) -> DataFrame:
    """The columns of the row before, null in the first."""
    cut = _cut(frame, order[0], width)
    w = Window.partitionBy(*by, _BUCKET).orderBy(*order)
    row = F.struct(*columns)
    local = cut.withColumn("__last", F.lag(row).over(w))
    per = cut.groupBy(*by, _BUCKET).agg(F.max_by(row, F.struct(*order)).alias("__row"))
    both = _with_before(local, per, by, ["row"], []).withColumn("__last", F.coalesce("__last", "__p_row"))
    return both.select(*frame.columns, *[F.col(f"__last.{c}").alias(prefix + c) for c in columns])


def cumulative(frame: DataFrame, by: list[str], order: list[str], values: dict[str, Column], width: int = HOUR) -> DataFrame:
    """Sums of all rows up to each row; a null adds nothing."""
    cut = _cut(frame, order[0], width).withColumns({f"__{n}": F.coalesce(v, F.lit(0)) for n, v in values.items()})
    w = Window.partitionBy(*by, _BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumns({n: F.sum(f"__{n}").over(w) for n in values}).drop(*[f"__{n}" for n in values])
    per = cut.groupBy(*by, _BUCKET).agg(*[F.sum(f"__{n}").alias(f"__{n}") for n in values])
    both = _with_before(local, per, by, [], list(values))
    return both.withColumns({n: F.col(n) + F.coalesce(f"__p_{n}", F.lit(0)) for n in values}).drop(_BUCKET, *[f"__p_{n}" for n in values])


def highest_before(frame: DataFrame, by: list[str], order: list[str], values: dict[str, Column], width: int = HOUR) -> DataFrame:
    """The greatest non-null value of the rows before each row; null if there is none."""
    cut = _cut(frame, order[0], width).withColumns({f"__{n}": v for n, v in values.items()})
    w = Window.partitionBy(*by, _BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumns({n: F.max(f"__{n}").over(w) for n in values}).drop(*[f"__{n}" for n in values])
    per = cut.groupBy(*by, _BUCKET).agg(*[F.max(f"__{n}").alias(f"__{n}") for n in values])
    over = Window.partitionBy(*by).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    both = local.join(per.select(*by, _BUCKET, *[F.max(f"__{n}").over(over).alias(f"__p_{n}") for n in values]), [*by, _BUCKET])
    return both.withColumns({n: F.greatest(n, f"__p_{n}") for n in values}).drop(_BUCKET, *[f"__p_{n}" for n in values])


def numbered(frame: DataFrame, by: list[str], order: list[str], width: int = HOUR) -> DataFrame:
    """``k``, each row's number from 0 in its key, and ``n``, how many rows the key has."""
    n = frame.groupBy(*by).agg(F.count("*").alias("n"))
    counted = cumulative(frame, by, order, {"k": F.lit(1).cast("long")}, width)
    return counted.withColumn("k", F.col("k") - 1).join(n, by)


def trailing(frame: DataFrame, by: list[str], t: str, seq: str, span: int, values: dict[str, Column]) -> DataFrame:
    """Sums over events of the last ``span``, both ends in, up to the event itself; 0 if none.

    A RANGE frame takes in later events of the same time, which are subtracted. Every row goes to
    its bucket of ``span`` and, as something to look back on, to the next.
    """
    names = {n: f"__{n}" for n in values}
    cut = _cut(frame, t, span).withColumns({names[n]: v for n, v in values.items()})
    dealt = cut.withColumn("__next", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(_BUCKET, F.col(_BUCKET) + F.col("__next"))
    near = Window.partitionBy(*by, _BUCKET).orderBy(t).rangeBetween(-span, 0)
    later = Window.partitionBy(*by, _BUCKET, t).orderBy(seq).rowsBetween(1, Window.unboundedFollowing)
    zero = F.lit(0)
    own = dealt.withColumns({n: F.coalesce(F.sum(c).over(near), zero) - F.coalesce(F.sum(c).over(later), zero) for n, c in names.items()})
    return own.where("__next = 0").drop(_BUCKET, "__next", *names.values())
