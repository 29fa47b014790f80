"""Incremental import: a stream of cited files into a store of texts, each batch a transaction."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.functions.text import strip
from lectern.sources import store
from lectern.sources.files import SKIP, decode_with_fallback

FILES = "path string, modificationTime timestamp, length long, content binary"


#: The part of a path that is the text's id.
STEM = r"([^/]+)\.txt$"


def file_lines(files: DataFrame, name: str = STEM, head: str | None = None) -> DataFrame:
    """text_id (the part of the path that name's group matches), n (from 1) and line of the lines that aren't blank.

    With head, a file holds texts that begin with a line that matches it as a whole; its group is the text_id, n counts the lines after it, and lines before the first are left out.
    """
    text = F.regexp_replace(F.regexp_replace(decode_with_fallback(F.col("content")), "\r\n?", "\n"), "^﻿", "")
    rows = files.filter(~F.col("path").contains(SKIP))
    if head is None:
        rows = rows.select(F.regexp_extract("path", name, 1).alias("text_id"), F.posexplode(F.split(text, "\n")).alias("p", "line")).withColumn("n", F.col("p") + 1)
    else:
        texts = rows.select(F.explode(F.split(text, f"(?m)^(?={head}$)")).alias("t"))
        texts = texts.select(F.regexp_extract("t", f"^{head}(?=\n|$)", 1).alias("text_id"), F.posexplode(F.split("t", "\n")).alias("p", "line"))
        rows = texts.filter("text_id <> '' and p > 0").withColumn("n", F.col("p"))
    return rows.select("text_id", "n", strip(F.col("line")).alias("line")).filter("line <> ''")


def stream_new_texts(spark: SparkSession, folder: str, path: str, checkpoint: str, where: str, *, name: str = STEM, head: str | None = None, parts: int = store.PARTS, per_batch: int = 10_000) -> StreamingQuery:
    """Add the texts of new files to the store at path, take what is there, and end.

    The stream remembers its files; a text that the store already has is skipped, whatever its file. A batch is known by the checkpoint and its number: when it
    is done it is written to the log beside the store, so a batch that comes again after a failure is skipped if it was done, and
    otherwise run again, which adds what is missing, since a text is stored whole or not at all. where: a shared folder for what batches put aside.
    """
    log = f"{path.rstrip('/')}_log"

    def add(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        done = session.read.schema("checkpoint string, batch long").parquet(log).filter((F.col("checkpoint") == checkpoint) & (F.col("batch") == number))
        if done.isEmpty():
            written = store.add_new(session, path, file_lines(batch, name, head), f"{where}/{number}-{uuid.uuid4().hex}", parts=parts)
            session.createDataFrame([(checkpoint, number, written)], "checkpoint string, batch long, partitions int").write.mode("append").parquet(log)

    for empty in (path, log):
        made = spark._jvm.org.apache.hadoop.fs.Path(empty)
        made.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(made)
    stream = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch)
    return stream.load(folder).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
