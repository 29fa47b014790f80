"""A corpus of whole texts in a partitioned Parquet folder, of which an update rewrites only the partitions of changed texts.

A text's rows are in one partition, by the hash of its id, so a text is replaced as a whole or not at all. New contents of touched
partitions are first written beside the store and then put in place by dynamic partition overwrite; an
update that is broken off can be run again, and one that changes nothing writes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = 256
PART = "part"


def _part(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(parts)).cast("int")


def _put(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)


def create(rows: DataFrame, path: str, *, key: str = "text_id", parts: int = PARTS) -> None:
    """A new store of the rows; those of a null key are left out."""
    _put(rows.filter(F.col(key).isNotNull()).withColumn(PART, _part(key, parts)).repartition(PART), path)


def _stored(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(PART)


def _digests(rows: DataFrame, key: str) -> DataFrame:
    """Each text's number of rows and the sum of their hashes, whatever their order."""
    columns = [F.col(c) for c in sorted(rows.columns) if c not in (PART, key)]
    shown = [F.to_json(F.struct(c), {"ignoreNullFields": "false"}) for c in columns]
    sums = [F.sum(F.xxhash64(*shown, F.lit(k)).cast("decimal(20,0)")).alias(f"h{k}") for k in (0, 1)]
    return rows.groupBy(key).agg(F.count("*").alias("n"), *sums)


def _touched(rows: DataFrame) -> list[int]:
    """The partitions of rows, of which there are never more than the store has."""
    return [r[0] for r in rows.select(PART).distinct().collect()]


def _replace(spark: SparkSession, path: str, kept: DataFrame, touched: list[int], where: str) -> None:
    """Put kept in place of the touched partitions. A partition that is left without rows goes, since an overwrite only sees those that have some."""
    kept.repartition(PART).write.mode("overwrite").partitionBy(PART).parquet(where)
    new = spark.read.schema(kept.schema).parquet(where)
    _put(new, path)
    for part in set(touched) - set(_touched(new)):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{PART}={part}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def upsert(spark: SparkSession, path: str, incoming: DataFrame, where: str, *, key: str = "text_id", parts: int = PARTS) -> int:
    """Add or replace whole texts; returns the number of partitions written. Texts that are stored as they come aren't touched. where: a new shared folder."""
    incoming = incoming.filter(F.col(key).isNotNull()).withColumn(PART, _part(key, parts))
    incoming.write.mode("overwrite").parquet(f"{where}/incoming")
    incoming = spark.read.schema(incoming.schema).parquet(f"{where}/incoming")
    stored = _stored(spark, path, incoming.schema)
    asked = _touched(incoming)
    known = stored.filter(F.col(PART).isin(asked)).join(incoming.select(key).distinct(), key, "left_semi")
    changed = _digests(incoming, key).join(_digests(known, key), [key, "n", "h0", "h1"], "left_anti").select(key)
    changed.write.mode("overwrite").parquet(f"{where}/changed")
    changed = spark.read.schema(changed.schema).parquet(f"{where}/changed")
    fresh = incoming.join(changed, key, "left_semi").select(incoming.columns)
    touched = _touched(fresh)
    if touched:
        rest = stored.filter(F.col(PART).isin(touched)).join(changed, key, "left_anti").select(incoming.columns)
        _replace(spark, path, rest.unionByName(fresh), touched, f"{where}/new")
    return len(touched)


def add_new(spark: SparkSession, path: str, incoming: DataFrame, where: str, *, key: str = "text_id", parts: int = PARTS) -> int:
    """Add the texts that the store doesn't have; those that it has stay as they are. Returns the number of partitions written."""
    incoming = incoming.withColumn(PART, _part(key, parts))
    stored = _stored(spark, path, incoming.schema)
    new = incoming.join(stored.select(PART, key).distinct(), [PART, key], "left_anti").drop(PART)
    return upsert(spark, path, new, where, key=key, parts=parts)


def remove(spark: SparkSession, path: str, ids: DataFrame, where: str, *, key: str = "text_id", parts: int = PARTS) -> int:
    """Remove the texts of the ids; ids that aren't stored are no error. Returns the number of partitions written."""
    ids = ids.select(key).filter(F.col(key).isNotNull()).distinct().withColumn(PART, _part(key, parts))
    stored = spark.read.parquet(path)
    found = stored.join(ids, [PART, key], "left_semi").select(key, PART).distinct()
    found.write.mode("overwrite").parquet(f"{where}/found")
    found = spark.read.schema(found.schema).parquet(f"{where}/found")
    touched = _touched(found)
    if touched:
        _replace(spark, path, stored.filter(F.col(PART).isin(touched)).join(found.select(key), key, "left_anti").select(stored.columns), touched, f"{where}/new")
    return len(touched)
