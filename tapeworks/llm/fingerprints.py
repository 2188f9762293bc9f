"""Document fingerprints from closed syncmers, in DataFrame functions alone.

The units of a text are its words (runs without ASCII white space; a longer run counts as
pieces of 16 characters). Of every K consecutive units the S-unit inner runs are hashed; the
K-gram is a closed syncmer, and so chosen, when the least of these hashes stands at its first
or last place. The choice looks at the K units alone, so the same passage gives the same
anchors in every text. A fingerprint is the set of chosen hashes, kept as its ``SKETCH`` least
(bottom-k), as hex; likeness is the Jaccard estimate of two such sketches, exact where both
sets are whole. ``anchors`` gives the chosen K-grams with their places, for positional matching.

A text with under K units, or with no closed syncmer, has one hash of all its units; one
without units has none. Null texts count as empty. Two empty fingerprints are alike (1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.llm import _tables

K, S, SKETCH = 4, 2, 128
UNIT = "[^\\x20\\x09-\\x0D]{1,16}"
#: Documents of neighbouring ids that one window group holds on average.
BUCKET_ROWS = 256
#: Quantiles of ids between which rows are dealt.
SEGMENTS = 128


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _chosen(units: Column) -> Column:
    """Per place the hash of the closed syncmer that begins there, else null."""

    def runs(hashes: Column) -> Column:  # hash of the S units from each place on
        return F.transform(hashes, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + j) for j in range(1, S)]))

    def pick(g: Column) -> Column:
        def at(a: Column, i: Column) -> Column:
            inner = [F.get(g, i + j) for j in range(1, K - S)]
            last = F.get(g, i + (K - S))
            beyond = i + K > F.size(g)
            edge = F.least(a, last)
            return F.when(beyond | (F.least(*inner, edge) < edge), F.lit(None)).otherwise(F.xxhash64(a, *inner, last))

        return F.transform(g, at)

    return _let(F.transform(units, lambda u: F.xxhash64(u)), lambda h: _let(runs(h), pick))


def sketch(text: Column) -> Column:
    """The least hashes of the chosen K-grams, ascending."""

    def of(units: Column) -> Column:
        found = F.array_distinct(F.array_compact(_chosen(units)))
        whole = F.when(F.size(units) > 0, F.array(F.xxhash64(units))).otherwise(F.array().cast("array<bigint>"))
        return _let(found, lambda x: F.when(F.size(x) > 0, F.slice(F.sort_array(x), 1, SKETCH)).otherwise(whole))

    return _let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNIT), 0), of)


def anchors(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per closed syncmer of each text: all columns, ``place`` (unit) and ``anchor``."""
    names = [c for c in docs.columns if c not in ("place", "anchor")]
    units = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(UNIT), 0)
    found = docs.select(*names, F.posexplode(_let(units, _chosen)).alias("place", "anchor"))
    return found.where("anchor IS NOT NULL")


def as_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Of two sketches, 0 to 1."""
    whole = (F.size(a) < SKETCH) & (F.size(b) < SKETCH)
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, F.when(whole, F.lit(2 * SKETCH)).otherwise(F.lit(SKETCH)))
    return _let(union, lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)))


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns and ``fingerprint``, a string."""
    return docs.withColumn("fingerprint", as_text(sketch(F.col(text))))


@_tables.shielded()
def with_next(docs: DataFrame, carried: list[str], doc_id: str = "doc_id") -> DataFrame:
    """Each row with the ``carried`` columns of the next row by descending doc_id (after the
    last the first), as ``next_*``; equal ids go by the carried columns, null ids come last.

    Rows are dealt by ranges of ids into buckets, one shuffle: between ``SEGMENTS`` quantiles of the
    ids, and in equal widths inside each, so that an id far from the others stretches one segment
    alone. The first and last rows of the buckets, a few in each thousand, meet by the list of
    buckets that have rows.
    """
    shares = F.array(*[F.lit(k / SEGMENTS) for k in range(1, SEGMENTS)])
    facts = docs.agg(F.min(doc_id).alias("a"), F.max(doc_id).alias("b"), F.count("*").alias("n"), F.percentile_approx(doc_id, shares, 10 * SEGMENTS).alias("q")).first()
    starts = sorted({facts.a or 0, *(facts.q or [])})  # SEGMENTS at most
    per = max(1, -(-facts.n // (len(starts) * BUCKET_ROWS)))
    # no lambdas here: with them Spark would not see that all branches below share one shuffle
    last = (facts.b or 0) + 1
    bucket = F.lit(None).cast("long")
    for k, (low, high) in enumerate(zip(starts, [*starts[1:], last])):
        part = F.floor((F.col(doc_id) - low).cast("double") * per / F.lit(float(high - low)))
        here = F.lit(k * per) + F.least(part, F.lit(per - 1)).cast("long")
        bucket = F.when(F.col(doc_id) < high, here) if k == 0 else bucket.when(F.col(doc_id) < high, here)
    bucket = F.coalesce(bucket, F.lit(-1).cast("long"))
    rows = docs.withColumn("__bucket", bucket)
    by_id = Window.partitionBy("__bucket").orderBy(F.col(doc_id).desc_nulls_last(), *[F.col(c).desc() for c in carried if c in docs.columns])
    columns = {f"next_{c}": F.lead(c).over(by_id) for c in carried}
    seen = rows.withColumns(columns | {"__more": F.lead(F.lit(True)).over(by_id), "__less": F.lag(F.lit(True)).over(by_id)})
    names = [*docs.columns, *columns]
    inner = seen.where("__more IS NOT NULL").select(names)
    heads = seen.where("__less IS NULL").select(F.col("__bucket").alias("__to"), *[F.col(c).alias(f"next_{c}") for c in carried])
    tails = seen.where("__more IS NULL").select("__bucket", *docs.columns)

    # the bucket below each bucket, by groups of 1024 buckets and the list of groups
    have = docs.select(bucket.alias("b")).distinct().withColumn("g", F.floor(F.col("b") / 1024))
    groups = have.groupBy("g").agg(F.max("b").alias("top"))
    below = groups.withColumn("under", F.lag("top").over(Window.orderBy("g"))).crossJoin(F.broadcast(groups.agg(F.max("top").alias("last"))))  # one row
    down = Window.partitionBy("g").orderBy("b")
    steps = have.withColumn("prior", F.lag("b").over(down)).join(below, "g")
    steps = steps.select(F.col("b").alias("__bucket"), F.coalesce("prior", "under", "last").alias("__to"))
    edges = tails.join(steps, "__bucket").join(heads, "__to").select(names)
    return inner.unionByName(edges)


def compare_edited(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints, near_edited and near_next."""
    # an alias for the same name would keep Spark from using one shuffle for both branches
    key = F.col(doc_id) if doc_id == "doc_id" else F.col(doc_id).alias("doc_id")
    base = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = base.withColumn("own", sketch(F.col("text")))
    pairs = with_next(base, ["text", "own"])
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    rows = pairs.select("doc_id", n.cast("long").alias("n_chars"), "own", "next_own", edited.alias("edited"))
    rows = rows.select("*", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("edited")).alias("after"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("after")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("after")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(_tables.table(spark, sf_dir, "documents"))
