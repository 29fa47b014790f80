"""A stored index from lemmas to sentences, for searches of many lemmas at once.

A posting list is cut into blocks of sentence ids, so no row grows with the corpus, and the blocks of a lemma are spread over salts, so
a function word that most sentences have is in as many buckets as there are salts. The table is bucketed by lemma and salt: a list of lemmas meets
it bucket by bucket, and the postings aren't moved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, SALTS = 256, 16
#: Sentence ids of one block.
SPAN = 1_000_000_000_000
#: A list of up to so many lemmas goes to every task, instead of being dealt out like the buckets.
FEW_LEMMAS = 100_000


def write(tokens: DataFrame, name: str, path: str, *, span: int = SPAN, buckets: int = BUCKETS, salts: int = SALTS) -> None:
    """A table of the postings of tokens (sentence_id, tokens): lemma, salt, block, n and sentence_ids in order. A sentence without tokens has none; null lemmas are left out."""
    lemmas = F.explode(F.array_distinct(F.transform("tokens", lambda t: t["lemma"])))
    pairs = tokens.select("sentence_id", lemmas.alias("lemma")).filter("lemma is not null").withColumn("block", F.floor(F.col("sentence_id") / span))
    listed = pairs.groupBy("lemma", "block").agg(F.array_sort(F.collect_set("sentence_id")).alias("sentence_ids"))
    rows = listed.select("lemma", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"), "block", F.size("sentence_ids").alias("n"), "sentence_ids")
    rows = rows.repartition(buckets, "lemma", "salt")  # as the buckets are, so that each is one file
    rows.write.mode("overwrite").bucketBy(buckets, "lemma", "salt").sortBy("lemma", "salt").option("path", path).saveAsTable(name)


def lookup(spark: SparkSession, name: str, lemmas: DataFrame, *, salts: int = SALTS) -> DataFrame:
    """lemma, block, n and sentence_ids of the distinct lemmas of a table (column lemma). Those that aren't in the index give no row."""
    asked = lemmas.select("lemma").filter("lemma is not null").distinct()
    few = asked.limit(FEW_LEMMAS + 1).count() <= FEW_LEMMAS
    asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    index = spark.table(name)
    return index.join(F.broadcast(asked) if few else asked.hint("merge"), ["lemma", "salt"]).select("lemma", "block", "n", "sentence_ids")


def sentences(spark: SparkSession, name: str, lemmas: DataFrame, *, salts: int = SALTS) -> DataFrame:
    """lemma and sentence_id of all sentences that have one of the lemmas."""
    return lookup(spark, name, lemmas, salts=salts).select("lemma", F.explode("sentence_ids").alias("sentence_id"))
