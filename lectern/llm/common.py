"""What the corpus operators share: input tables, the shared scratch folder and Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch, so that a Python worker never holds many long texts at once.
BATCH_ROWS = 4096
BATCH_BYTES = 16 << 20
SLICE_BYTES = 4 << 20
#: A key with more rows than this, and with more than a thousandth of all, is joined by broadcast; there are a thousand such keys at most.
HOT_ROWS, HOT_SHARE = 20_000, 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark from any store that it can reach."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, unless it already has tighter ones."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share. Only a session in one process may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(?:\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/lectern-{uuid.uuid4().hex}"


def saved(df: DataFrame, path: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it again, so that a lost executor costs no recomputation."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply fn to each Arrow batch of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, name: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about most bytes of text, one row at least each, for work that needs many bytes a byte of text."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column as Python strings, null as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def free_name(df: DataFrame, name: str) -> str:
    """The name, or one like it that is no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_split(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined with small (keys, the number n of their rows, further columns), without n. Hot keys are broadcast, so that no task reads all rows of one.

    small is a saved table; its n are summed up first.
    """
    limit = max(HOT_ROWS, (small.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE)
    hot = small.filter(F.col("n") > limit)
    if hot.isEmpty():
        return rows.join(small.drop("n"), keys, how)
    rest = rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(small.filter(F.col("n") <= limit).drop("n"), keys, how)
    return rows.join(F.broadcast(hot.drop("n")), keys).unionByName(rest)


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text (null: empty), so that further columns of any name can't clash."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
