"""Whitening of embeddings with weighted multiplicity covariance.

Entries become whole numbers, equal vectors are one row with their count, and all sums run over distinct vectors with
the counts (or one each) as weights. Sums of the entries are exact. The covariance is a weighted product of centred blocks in
the tasks; a task's block of dims x dims numbers is all that it sends on, and blocks are summed by Spark, row by row of
the matrix. Only the finished matrix, whose size depends on the dimensions alone, is decomposed on the driver. Every
distinct vector is whitened once and joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from lectern.llm import common

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Blocks of tasks are summed in so many groups first.
FAN = 64
#: An eigenvalue below this share of the largest, times the dimensions, is rounding.
RANK = np.finfo(float).eps
LONG = 1 << 63


def _encoded(rows: DataFrame) -> DataFrame:
    """id, dims and y: floor(SCALE * c) of every entry, little-endian, in the fewest of 2, 4 or 8 bytes that hold all of a vector's.

    Vectors that are null or empty or have entries that are null, not finite or not a long after scaling are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch["vector"]
            size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = np.asarray(pc.fill_null(pc.cast(vectors.flatten(), pa.float64()), np.nan))
            ends = np.cumsum(size)
            with np.errstate(over="ignore", invalid="ignore"):
                y = np.floor(flat * SCALE)
                bad = np.concatenate([[0], np.cumsum(~(np.abs(y) < LONG // 2))])
            good = np.flatnonzero((size > 0) & (bad[ends] == bad[ends - size]))
            out = []
            for i in good.tolist():
                own = y[ends[i] - size[i] : ends[i]]
                most = np.abs(own).max()
                out.append(own.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(good)), pa.array(size[good], pa.int32()), pa.array(out, pa.binary())], names=["id", "dims", "y"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, dims int, y binary")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a batch as whole numbers, a row each."""
    return np.asarray([np.frombuffer(b, f"<i{len(b) // dims}") for b in column.to_pylist()], np.int64).reshape(-1, dims)


def _weights(batch: pa.RecordBatch) -> np.ndarray:
    return batch["w"].to_numpy(zero_copy_only=False)


def _total(df: DataFrame, block: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum of the blocks of all batches: each task adds up its own, and Spark sums the tasks' rows of the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(shape)
        for batch in batches:
            if len(batch):
                acc += block(batch)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0]), pa.int32()), pa.array(list(acc), pa.list_(pa.float64()))], names=["i", "v"])

    @pandas_udf("array<double>")
    def added(v: pd.Series) -> list:
        return np.sum(np.stack(v.to_numpy()), axis=0)

    rows = df.mapInArrow(run, "i int, v array<double>").withColumn("part", F.spark_partition_id() % FAN)
    out = np.zeros(shape)
    for i, v in rows.groupBy("i", "part").agg(added("v").alias("v")).groupBy("i").agg(added("v").alias("v")).collect():
        out[i] = v
    return out


def _sums(df: DataFrame, dims: int) -> list[int]:
    """The exact weighted sum of every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(dims, object)
        for batch in batches:
            y, w = _matrix(batch["y"], dims), _weights(batch)
            if len(y):
                safe = float(np.abs(y).max()) * float(w.sum()) < LONG / 2
                acc = acc + (w @ y if safe else w.astype(object) @ y.astype(object)).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([str(int(s)) for s in acc])], names=["i", "s"])

    rows = df.mapInArrow(run, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    return [int(s) for _, s in sorted((r["i"], r["s"]) for r in rows)]


def _away(y: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n * y - s, exact; as Python's integers where a long might not hold it."""
    if n * (float(np.abs(y).max(initial=0)) + 1) + float(max(map(abs, s))) < LONG / 2:
        return n * y - np.asarray(s, np.int64)
    return n * y.astype(object) - np.asarray(s, object)


def _squares(away: np.ndarray) -> list[int | None]:
    """Row sums of squares; null where a long can't hold it."""
    if float(np.abs(away).max(initial=0)) ** 2 * away.shape[1] < LONG / 2:
        return (away * away).sum(1).tolist()
    return [int(v) if v < LONG else None for v in (away.astype(object) ** 2).sum(1)]


def whiten(embeddings: DataFrame, *, components: int = COMPONENTS, fit_weights: str = "counts", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for every remaining row and each of the first components.

    fit_weights: ``counts``, so that the fit is over all remaining rows, or ``one``, over distinct vectors. Left out are vectors that are null or empty, that have
    entries that are null, not finite or not a long after scaling, and, since one covariance takes one length, vectors of another length than most (of the longer
    ones, if two lengths are as frequent). Equal rows and ids are kept one by one. A component without variance has whitened
    null and no part in identity_error, which is null if there is none; without any variance explained is null. A deviation beyond a long is null. An empty table
    gives no rows. Further columns are left aside.
    """
    if fit_weights not in ("counts", "one"):
        raise ValueError(f"fit_weights is counts or one, not {fit_weights}")
    spark = embeddings.sparkSession
    common.small_batches(spark)
    where = common.scratch(spark)
    rows = _encoded(embeddings.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")))
    distinct = common.saved(rows.groupBy("dims", "y").agg(F.count("*").alias("count")), f"{where}/distinct")
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    most = distinct.groupBy("dims").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if most is None:
        return spark.createDataFrame([], schema)
    dims = most["dims"]
    weight = F.col("count") if fit_weights == "counts" else F.lit(1).cast("long")
    distinct = distinct.filter(F.col("dims") == dims).select("y", "count", weight.alias("w"))
    n = distinct.agg(F.sum("w")).first()[0]
    s = _sums(distinct, dims)

    def products(batch: pa.RecordBatch) -> np.ndarray:
        x = _away(_matrix(batch["y"], dims), n, s).astype(float) / n
        return (x * _weights(batch)[:, None]).T @ x

    covariance = _total(distinct, products, (dims, dims)) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    top = np.argsort(-values, kind="stable")[:components]
    values, vectors, trace = values[top], vectors[:, top], float(np.trace(covariance))
    sound = values > RANK * dims * max(values[0], 0)
    k = len(top)
    scaled = np.where(sound, vectors / np.sqrt(np.where(sound, values, 1)), np.nan)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = _away(_matrix(batch["y"], dims), n, s)
            z = pa.array((away.astype(float) / n @ scaled).ravel(), from_pandas=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * k, pa.int32()), z)
            yield pa.RecordBatch.from_arrays([batch["y"], batch["count"], batch["w"], pa.array(_squares(away), pa.int64()), lists], names=["y", "n", "w", "deviation", "z"])

    done = common.saved(distinct.mapInArrow(project, "y binary, n bigint, w bigint, deviation bigint, z array<double>").withColumn("key", F.unhex(F.sha2("y", 256))).drop("y"), f"{where}/whitened")
    parts = lambda batch: np.asarray(pc.fill_null(batch["z"].flatten(), 0.0)).reshape(-1, k)
    mean = _total(done, lambda b: (_weights(b) @ parts(b))[None], (1, k))[0] / n
    error = _total(done, lambda b: ((parts(b) - mean) * _weights(b)[:, None]).T @ (parts(b) - mean), (k, k)) / n - np.eye(k)
    error = float(np.abs(error[np.ix_(sound, sound)]).max()) if sound.any() else None

    keyed = rows.filter(F.col("dims") == dims).select("id", F.unhex(F.sha2("y", 256)).alias("key"))
    out = common.join_split(keyed, done.select("key", "n", "deviation", "z"), ["key"]).select("id", "deviation", F.posexplode("z").alias("p", "whitened"))
    explained = F.get(F.array(*[F.lit(float(v / trace) if trace > 0 else None).cast("double") for v in values]), F.col("p"))
    return out.select(F.col("id").alias("vec_id"), (F.col("p") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"))
