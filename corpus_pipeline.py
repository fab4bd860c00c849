"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written and read again as the next stage's ``docs``; all but the last return
the columns of ``documents``, whatever further columns these have.  Null
texts and texts without a letter go in the first stage; rows that repeat an
id stay until near copies are dropped; rows without an id are never dropped
as copies; an empty table gives an empty table; very long texts are read
whole in every stage.
"""

from __future__ import annotations

import gc
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tardy.llm import language_id, minhash_dedup, packing, secrets, toxicity
from tardy.llm.common import Scratch, ship


def _start(spark: SparkSession) -> None:
    """Ship the package and release what earlier stages left on the driver
    (plans, broadcasts), so that its memory does not add up over stages."""
    ship(spark)
    gc.collect()
    spark._jvm.System.gc()


def _renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows under column names that no operator uses, and those names by
    the documents' own; ``_back`` takes them back."""
    names = {c: f"_docs_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _back(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(n).alias(c) for c, n in names.items()])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay.  Rejected are texts without a
    letter and texts that the best language model codes in no fewer bits
    than their bytes have (they are no text of any learned language)."""
    _start(spark)
    trees = language_id.train(docs)
    rows, names = _renamed(docs)
    found = language_id.predict(rows, trees, names["doc_id"], names["text"], keep=rows.columns)
    known = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("bits_per_byte") < 8)
    return _back(found.filter(known), names)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    _start(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows, names = _renamed(docs)
    return _back(model.score(rows, rows.columns, names["text"]).filter("predicted = 0"), names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id (rows
    that repeat its id go too); documents without an id stay."""
    _start(spark)
    scratch = Scratch(spark, "kept")
    kept = minhash_dedup.near_duplicates(docs).filter("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
    repeated = scratch.table(docs.groupBy("doc_id").agg(F.count("*").alias("n"))
                             .filter("n > 1 and doc_id is not null").select("doc_id"))
    single = named.join(repeated, "doc_id", "left_anti")
    once = named.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return single.union(once.select(*docs.columns)).union(docs.filter("doc_id is null"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by its kind in brackets; all documents stay."""
    _start(spark)
    return secrets.redact_secrets(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece, with its ids.  The workers still
    hold what earlier stages took, so the working set is small here."""
    _start(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"),
                        slice_bytes=2 << 20, cache_entries=150_000)


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("minhash_dedup", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: no stage but the redaction can be said in SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return scratch.result(STAGES[-1][1](spark, docs, sf_dir))
