"""The corpus pipeline: language ID, near-duplicate removal, mixing, and encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last
return the columns of documents. Near-duplicates are judged on five-word shingles at a Jaccard of 0.8.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlane.llm import bpe, langid, minhash, mixing
from siftlane.llm.common import read_table, stage
from siftlane.llm.queries import tokenizer


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised.

    Those go whose text is null or has no letter, or is below the model's limits of probability or of
    known n-grams. The model is fitted to docs; where no row has a label and letters, there is no
    model, and no row is recognised. Repeated rows are judged each, texts of any length whole. Extra
    columns stay, whatever their names; an empty table gives an empty one.
    """
    found = langid.predict(docs, langid.fit(docs), keep=tuple(docs.columns))
    return found.where(~F.col("rejected")).select(*(F.col(f"kept_{c}").alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates, and all that are in none.

    Each row is a document of its own, by a staged number, as doc_id may be null or repeated. First is
    the least doc_id, null last, and of equal ones the least number. Rows whose text is null or has no
    words are in no group. Texts of any length are compared whole. Extra columns stay, whatever their
    names; an empty table gives an empty one.
    """
    row = next(n for n in ("__row" + "_" * k for k in range(len(docs.columns) + 1)) if n not in docs.columns)
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows")
    found = minhash.near_duplicates(rows, key=row, shingle=5, percent=80, rows=5, bands=24).select(F.col("id").alias(row), F.col("component_id").alias("group"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", row)
    kept = rows.select(row, "doc_id").join(found, row).groupBy("group").agg(F.min_by(row, order).alias(row)).select(row)
    return rows.join(kept, row, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents read in one epoch for a budget of nine tenths of the tokens.

    Rows that share a doc_id stay if one of them is read; rows without words are never read. A null
    language or source counts as empty, so is a leaf of its own. Extra columns stay, whatever their
    names; an empty table gives an empty one.
    """
    read = mixing.mix(docs, share=0.9, epochs=1).select(F.col("id").alias("__read")).distinct()
    return docs.join(read, docs["doc_id"].eqNullSafe(read["__read"]), "left_semi")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, and digests of ids and decoded text.

    A null text has no ids; repeated rows and texts of any length are encoded each, and whole. Extra
    columns are left out. An empty table gives an empty result.
    """
    out = bpe.encode(docs, tokenizer(), keep=("doc_id", "lang", "source"))
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("mixing", mixing_weights), ("bpe", encoding)]
#: Neither the model of languages nor MinHash nor merging by rank can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage's rows are written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
