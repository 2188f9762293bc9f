"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm import _tables

#: Parts into which the rows of one label are dealt when they look up that label's own label.
SALTS = 16


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the least node each node of an edge can reach.

    Every node takes the least label around it, then the label of its label, until nothing
    changes; each round is a stored table, so a lost executor costs one round at most, and the
    round before is deleted. Labels look themselves up once each, and what they find goes back
    to their rows by salted keys, so a large component isn't one task. No edges: no rows; nulls
    are ignored.
    """
    both = edges.where(f"{a} <> {b}").select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = _tables.stored(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "edges")
    last = labels = _tables.stored(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        step = _tables.stored(step, "labels")
        asked = step.select(F.col("new").alias("asked")).distinct()
        far = step.where("new <> node").join(asked, F.col("node") == F.col("asked")).select(F.col("asked").alias("new"), F.col("new").alias("far"))
        far = far.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = step.withColumn("salt", F.pmod(F.hash("node"), F.lit(SALTS)))
        after = _tables.stored(salted.join(far, ["new", "salt"], "left").select("node", "label", F.least("new", F.coalesce("far", "new")).alias("new")), "labels")
        _tables.discard(step, last)
        last = after
        if after.where("label <> new").limit(1).count() == 0:
            _tables.discard(both)
            _tables.rename(after, out := after.select("node", "label"))
            return out
        labels = after.select("node", F.col("new").alias("label"))
