"""Mixing sources to target weights by Poisson replication.

A source's rate is the mean number of times its documents appear: weight share times the
wanted total over the source's size. A document's count is the Poisson quantile, at that
rate, of a uniform number hashed from seed and doc_id: equal ids get equal counts, a rerun
or a lost executor the same ones. Documents are exploded by their counts and dealt out by a
hash of (seed, doc_id, copy), then sorted by it in each partition: a global shuffle.

Sources that have no weight of their own, and null sources, form one pool with the weight
``other`` (0: they go). Rates are as many as given weights, so they are part of the plan, and
a source with most of the rows is never grouped. Null texts count as one character less than
nothing else does: size 0. Sources of size 0 keep their rows at rate 0. Null doc_ids hash as
"null". Columns called like ``copy`` and ``shuffle_key`` are replaced. Empty tables stay empty.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm import _tables

#: The production mixture over the sources of ``documents``.
WEIGHTS = {"src0": 0.1} | {f"src{k}": 0.06 for k in range(1, 10)}
OTHER, SEED = 0.36, "mix-1"


def poisson_cdf(rate: float) -> list[float]:
    """P(count <= k) for k = 0, 1, ... up to where a hashed uniform can't reach."""
    out, total, k = [], 0.0, 0
    while rate > 0:
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        if total >= 1 - 2.0**-53 or (k > rate and out and total == out[-1]):
            break
        out.append(total)
        k += 1
    return out


def uniform(seed: str, doc_id: Column) -> Column:
    """52 bits of md5(seed:doc_id), in [0, 1)."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float], other: float, total: float | None, source: str, text: str, unit: str) -> dict[str | None, float]:
    """Mean repetition of each weighted source, and of the pool under None."""
    if unit not in ("chars", "rows"):
        raise ValueError(f"unit must be 'chars' or 'rows', not {unit!r}")
    if any(w < 0 for w in (*weights.values(), other)) or not any((*weights.values(), other)):
        raise ValueError("weights must not be negative, and not all 0")
    size = F.coalesce(F.length(text), F.lit(0)) if unit == "chars" else F.lit(1)
    pool = F.when(F.col(source).isin(*weights), F.col(source)) if weights else F.lit(None).cast("string")
    sizes = {r["pool"]: r["n"] for r in docs.groupBy(pool.alias("pool")).agg(F.sum(size.cast("long")).alias("n")).collect()}
    whole = float(sum(sizes.values())) if total is None else float(total)
    shares = {**weights, None: other}
    sum_w = sum(shares[k] for k in [*sorted(weights), None])
    return {k: shares[k] * whole / (sum_w * n) if (n := sizes.get(k, 0)) else 0.0 for k in shares}


@_tables.shielded()
def mix(
    docs: DataFrame,
    weights: dict[str, float],
    other: float = 0.0,
    total: float | None = None,
    seed: str = SEED,
    unit: str = "chars",
    source: str = "source",
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """The documents with ``copy`` (from 0) and ``shuffle_key``, in a globally shuffled order.

    ``total`` is the wanted size in characters or rows (None: that of the input)."""
    by_source = rates(docs, weights, other, total, source, text, unit)
    u = uniform(seed, F.col(doc_id))

    # a row per named source and one for the rest; a table, since a small source with a real weight
    # has as many steps as copies of each document
    # (an Arrow table, which the JVM reads: rows would start a second set of Python workers on each executor)
    found = [pa.array(list(by_source), pa.string()), pa.array([list(poisson_cdf(rate)) for rate in by_source.values()], pa.list_(pa.float64()))]
    steps = docs.sparkSession.createDataFrame(pa.table(found, names=["__pool", "__steps"]))
    named = [k for k in by_source if k is not None]
    pool = F.when(F.col(source).isin(named), F.col(source)) if named else F.lit(None).cast("string")
    counts = F.size(F.filter(F.coalesce("__steps", F.array().cast("array<double>")), lambda t: t <= u))
    names = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    counted = docs.join(F.broadcast(steps), pool.eqNullSafe(F.col("__pool")), "left").select(*names, counts.alias("__count")).where("__count > 0")
    copies = counted.select(*names, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__count").cast("long") - 1)).alias("copy"))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), "copy"))
    return copies.withColumn("shuffle_key", key).repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_tables.table(spark, sf_dir, "documents"), WEIGHTS, OTHER)


def _sql(weights: dict[str, float], other: float, seed: str) -> str:
    listed = ", ".join(f"('{k}', {w!r}::DOUBLE)" for k, w in weights.items())
    return f"""
WITH weights(name, w) AS (VALUES {listed}, ('*', {other!r}::DOUBLE)),
pooled AS (
  SELECT d.*, coalesce(w.name, '*') AS pool FROM documents d LEFT JOIN weights w ON d.source = w.name AND w.name <> '*'
),
sizes AS (SELECT pool, sum(coalesce(length(text), 0)) AS n FROM pooled GROUP BY pool),
rates AS (
  SELECT pool, w * (SELECT sum(n) FROM sizes)::DOUBLE / ({sum([*(weights[k] for k in sorted(weights)), other])!r}::DOUBLE * n::DOUBLE) AS rate
  FROM sizes JOIN weights ON pool = name WHERE n > 0
),
mass AS (
  SELECT pool, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p FROM rates, generate_series(0, 60) AS t(k) WHERE rate > 0
),
steps AS (SELECT pool, k, sum(p) OVER (PARTITION BY pool ORDER BY k) AS cdf FROM mass),
counted AS (
  SELECT d.*, (
    SELECT count(*) FROM steps s WHERE s.pool = d.pool
      AND s.cdf <= ('0x' || substr(md5('{seed}:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE
  ) AS n FROM pooled d
)
SELECT doc_id, text, lang, source, n_chars, copy, md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy) AS shuffle_key
FROM (SELECT *, unnest(range(n)) AS copy FROM counted WHERE n > 0)
"""


OP1_SQL = _sql(WEIGHTS, OTHER, SEED)
