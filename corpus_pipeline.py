"""From raw documents to packed training sequences.

Each stage calls one corpus operator on all that its predecessor kept and acts on what it finds. Between
stages the documents are written to the shared folder and read again, so a lost executor costs one stage's
tasks at most. Extra columns of any name pass all stages but the last; empty tables pass as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import common, decontam, packing, secrets, simhash, toxicity
from lectern.llm.queries import TOKENIZER


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject; null and empty texts stay, and so do repeated rows.

    The model learns from the labels that aren't held out.
    """
    model, score = toxicity.train(docs, common.table(spark, sf_dir, "labels")), common.free_name(docs, "score")
    return toxicity.with_score(docs, model, out=score).filter(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are alike by their word shingles, the one with the smallest doc_id; of rows alike in all columns, one.

    Rows are told apart by all their columns, so rows that share an id and aren't alike all stay. A null doc_id comes last; null and
    empty texts are alike, so one of them stays.
    """
    key = [common.free_name(docs, f"row{i}") for i in range(2)]
    own = [F.col(c) for c in docs.columns]
    keyed = docs.withColumns({key[0]: F.xxhash64(*own), key[1]: F.xxhash64(F.lit(1), *own)})
    named = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", *[F.col(k).alias(f"k{i}") for i, k in enumerate(key)])
    found = simhash.similar_texts(keyed.select(named.alias("id"), "text"), id_col="id")
    light = found.select(F.col("doc_id.k0").alias(key[0]), F.col("doc_id.k1").alias(key[1]), (F.col("doc_id") > F.col("component_id")).alias("gone"))
    light = common.saved(light.groupBy(*key).agg(F.max("gone").alias("gone"), F.count("*").alias("n")).filter("gone or n > 1"), f"{common.scratch(spark)}/copies")
    gone = light.filter("gone").select(key)
    # So few keys are broadcast, some tens of MB, and no text moves; beyond, rows meet them by a shuffle.
    kept = keyed.join(F.broadcast(gone) if gone.count() <= FEW_KEYS else gone, key, "left_anti")
    again = light.filter("not gone").select(key)
    if not again.isEmpty():
        kept = kept.join(again, key, "left_anti").unionByName(kept.join(again, key, "left_semi").dropDuplicates(key))
    return kept.select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and empty texts stay, and so do repeated rows."""
    items = common.free_name(docs, "items")
    return decontam.with_items(docs, common.table(spark, sf_dir, "benchmark"), out=items).filter(F.size(items) == 0).drop(items)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret span replaced by a mark; n_chars follows the text, and is null where it or the text was."""
    hidden = secrets.redact(docs)
    return hidden.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of every document, with its sequence and place; a null or empty text is one token."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


#: Keys of dropped rows that are broadcast at most.
FEW_KEYS = 500_000

STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("secrets", hide_secrets),
    ("packing", pack),
]

#: SQL can't express the model, the fingerprints and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    where = common.scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir), f"{where}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
