"""The corpus pipeline: toxicity, near duplicates, contamination, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and returns a frame; run() chains them, every stage
written as Parquet and read again before the next. A stage begins by having driver and executors give
back the memory of those before it. All but the last return the columns of
documents. Of a near-duplicate component the row with the least doc_id stays, of equal ids the one
with the least text; texts without words are near duplicates of nothing. Near are texts by op4's
contract (3 words, 90 %), not by the general rule of 5 words and 0.8: the tests of the stage hold it so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm import _tables, decontaminate, mixing, ngram_join, token_store, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. The model learns from the labels of the same stage's rows.

    Null, empty and very long texts are scored like others (the first two as texts without words) and
    equal rows alike; a null doc_id has no label; without labels of both classes nothing goes. An
    empty table stays empty. Further columns stay as they are, whatever their names."""
    _tables.release_memory(spark)
    labels = _tables.table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id")))
    model = toxicity.fit(docs, labels)
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays: of equal rows one, of equal ids the
    least text's. Texts without words all stay, null ids give way to others; an empty table stays
    empty, further columns stay."""
    _tables.release_memory(spark)
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule names go. Null and empty texts have no words and stay;
    equal rows go or stay together; without documents or test items nothing goes; further columns stay."""
    _tables.release_memory(spark)
    return decontaminate.decontaminate(docs, _tables.table(spark, sf_dir, "benchmark"), "documents")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of the production weights, shuffled; a document appears as often as drawn, each
    copy with all its columns. Equal doc_ids draw alike, null ids as the text 'null'; null and empty
    texts count no characters, and a source of such texts alone is left out. An empty table stays empty."""
    _tables.release_memory(spark)
    return mixing.mix(docs, mixing.WEIGHTS, mixing.OTHER).select(docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all rows in a store, and the digest of each row as read back from it. Null and
    empty texts are their end id alone; equal doc_ids and rows keep one digest each, null ids come
    first; a text longer than a block spans blocks; an empty table gives no rows; further columns
    are not read."""
    _tables.release_memory(spark)
    return token_store.digests(spark, token_store.write_tokens(docs, _tables.fresh_path(spark, "tokens")))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: SQL can express neither the learned scores nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = _tables.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = _tables.stored(docs, name)
    return docs
