"""Neighbours, ranges, pages and as-of versions by windows."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.ranges import RANGE, in_ranges, number, scan


def sentence_context(rows: DataFrame, *, order: tuple[str, ...] = ("first_line", "sentence_id"), content: str = "content") -> DataFrame:
    """Previous and next content in the division; of the rows given, so filter before for neighbouring matches, after for true neighbours."""
    w = Window.partitionBy("division_id").orderBy(*order)
    return rows.withColumns({"prev_sentence": F.lag(content).over(w), "next_sentence": F.lead(content).over(w)})


def context_lines(lines: DataFrame, centres: DataFrame, k: int = 2) -> DataFrame:
    """Lines within k numbers of each centre (division_id, line_number): an equi-join on the numbers around it."""
    around = centres.select("division_id", F.col("line_number").alias("centre"), F.explode(F.sequence(F.col("line_number") - k, F.col("line_number") + k)).alias("line_number"))
    return lines.join(around, ["division_id", "line_number"])


def line_ranges(rows: DataFrame, by: list[str], number: str = "line_number") -> DataFrame:
    """Runs of numbers as "Line n" and "Lines a-b", joined; repeated numbers count once."""
    w = Window.partitionBy(*by).orderBy(number)
    islands = rows.select(*by, number).distinct().withColumn("island", F.col(number) - F.row_number().over(w))
    runs = islands.groupBy(*by, "island").agg(F.min(number).alias("a"), F.max(number).alias("b"))
    label = F.when(F.col("a") == F.col("b"), F.concat(F.lit("Line "), "a")).otherwise(F.concat(F.lit("Lines "), "a", F.lit("-"), "b"))
    return runs.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", label.alias("x")))), lambda y: y["x"]), ", ").alias("ranges"))


def line_continuity(lines: DataFrame, by: str = "division_id", number: str = "line_number") -> DataFrame:
    """Lines whose number isn't the one before plus one; the first is expected to be 1."""
    w = Window.partitionBy(by).orderBy(number)
    return lines.withColumn("expected", F.lag(number, 1, 0).over(w) + 1).filter(F.col("expected") != F.col(number))


def global_number(rows: DataFrame, order: list[str], where: str) -> DataFrame:
    """rows with place (from 1) in the given order, of any columns, and total.

    Rows are written to the shared folder once, in ranges of the order with about equally many rows; the only thing that one task sees is the counts of
    the ranges. Rows that are equal in the order stand together in any order, so let it end with a column that tells them apart.
    """
    ranged = in_ranges(rows, order, where)
    return number(ranged, [], order).withColumn("total", F.lit(ranged.count()).cast("long")).drop(RANGE)


def paginate(rows: DataFrame, order: list[str], where: str, size: int = 10) -> DataFrame:
    """page, total_results and total_pages in the given order; pages beyond the end have no rows."""
    out = global_number(rows, order, where)
    return out.withColumns({"page": F.floor((F.col("place") - 1) / size) + 1, "total_results": F.col("total"), "total_pages": F.ceil(F.col("total") / size)}).drop("total", "place")


def natural_order(level: Column, missing: str = "1") -> list[Column]:
    """Order by number where the level is one, then by text; a missing level counts as another."""
    level = F.coalesce(level, F.lit(missing))
    return [level.try_cast("int").asc_nulls_last(), level]


def latest(versions: DataFrame, key: str, version: str) -> DataFrame:
    """The current row of each key; the whole row rides with the maximum, so a hot key is combined before the shuffle."""
    rest = [c for c in versions.columns if c not in (key, version)]
    return versions.groupBy(key).agg(F.max(F.struct(version, *rest)).alias("r")).select(key, "r.*")


def as_of(requests: DataFrame, versions: DataFrame, key: str, at: str, version: str, value: str) -> DataFrame:
    """The version in force at each request: versions and requests in one window by key, the last version at or before."""
    kind = versions.select(F.col(key), F.col(version).alias("__t"), F.lit(0).alias("__kind"), F.struct(F.col(version).alias("v"), F.col(value).alias("x")).alias("__v"))
    asked = requests.select(F.col(key), F.col(at).alias("__t"), F.lit(1).alias("__kind"), F.lit(None).alias("__v"))
    w = Window.partitionBy(key).orderBy("__t", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    both = kind.unionByName(asked).withColumn("__last", F.last("__v", ignorenulls=True).over(w))
    return both.filter("__kind = 1").select(key, F.col("__t").alias(at), F.col("__last.v").alias(version), F.col("__last.x").alias(value))


def inherit(rows: DataFrame, by: list[str], order: list[str], columns: list[str], where: str) -> DataFrame:
    """Nulls of the columns take the last value before them in the group, which may be of any size: rows are scanned in ranges, written to the folder once.

    What comes before a group's first value stays null. Rows of a null key are a group.
    """
    ranged = in_ranges(rows, [*by, *order], where)
    carried = scan(ranged, by, order, {f"__last_{c}": ("last", F.col(c)) for c in columns})
    return carried.select(*[F.col(f"__last_{c}").alias(c) if c in columns else F.col(c) for c in rows.columns])


def batches(rows: DataFrame, by: str, order: str, size: int) -> Column:
    """Number of the batch of each row inside its group."""
    return F.floor((F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1) / size)


def scratch(spark) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. Only a session in one process may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(?:\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/lectern-{uuid.uuid4().hex}"
