"""Scans over ordered rows in two levels: inside ranges of the order, then over the states of the ranges.

A window by a key puts all rows of the key into one task. Here rows are first cut into ranges of (key, order), which are
about equally large whatever the keys are. Every range yields one state a key, the states of a key are scanned once
(there are at most as many as ranges), and each range starts from the state before it: a seed row that the
window sees first. So a key with any number of rows is spread over as many tasks as it fills ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE = "__range"

#: kind: (state of a range from value and order, the same over states and rows, rows that the frame ends before the current one)
_FOLDS = {
    "sum": (lambda v, o: F.sum(v), F.sum, 0),
    "xor": (lambda v, o: F.bit_xor(v), F.bit_xor, 0),
    "last": (lambda v, o: F.max_by(v, F.when(v.isNotNull(), o)), lambda v: F.last(v, ignorenulls=True), 0),
    "previous": (lambda v, o: F.max_by(v, o), lambda v: F.last(v, ignorenulls=True), -1),
}


def in_ranges(rows: DataFrame, order: list[str], where: str, parts: int | None = None) -> DataFrame:
    """rows, written to the folder once, with __range: the number of the range that a row is in, of ``parts`` ranges in the given order.

    Rows that are equal in all of ``order`` fall into one range, so let it end with a column that tells rows apart.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.repartitionByRange(parts, *order).withColumn(RANGE, F.spark_partition_id())
    cut.write.mode("overwrite").parquet(where)
    return rows.sparkSession.read.schema(cut.schema).parquet(where)


def scan(rows: DataFrame, by: list[str], order: list[str], folds: dict[str, tuple[str, Column]]) -> DataFrame:
    """rows of :func:`in_ranges` over by and order, with a column for each fold (kind, value): ``sum`` or ``xor`` of the values up to the row, its
    ``last`` value that isn't null, or the value of the ``previous`` row. Nulls sort first; a null key is a key like any other.

    An empty table gives no rows; rows that are equal in the order are taken in any order.
    """
    values = {name: F.struct(v.alias("x")) if kind == "previous" else v for name, (kind, v) in folds.items()}
    rows = rows.withColumns({f"__{name}": v for name, v in values.items()})
    place = F.struct(*order)
    states = rows.groupBy(*by, RANGE).agg(*[_FOLDS[kind][0](F.col(f"__{name}"), place).alias(f"__{name}") for name, (kind, _) in folds.items()])
    ahead = Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    seeds = states.select(*by, RANGE, *[_FOLDS[kind][1](F.col(f"__{name}")).over(ahead).alias(f"__{name}") for name, (kind, _) in folds.items()])
    both = rows.withColumn("__seed", F.lit(False)).unionByName(seeds.withColumn("__seed", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy(*by, RANGE).orderBy(F.col("__seed").desc(), *order)
    done = both.withColumns({name: _FOLDS[kind][1](F.col(f"__{name}")).over(w.rowsBetween(Window.unboundedPreceding, _FOLDS[kind][2])) for name, (kind, _) in folds.items()})
    done = done.withColumns({name: F.col(f"{name}.x") for name, (kind, _) in folds.items() if kind == "previous"})
    return done.filter(~F.col("__seed")).drop("__seed", *[f"__{name}" for name in folds])


def number(rows: DataFrame, by: list[str], order: list[str], name: str = "place") -> DataFrame:
    """rows of :func:`in_ranges` with their place in the group, from 1."""
    return scan(rows, by, order, {name: ("sum", F.lit(1).cast("long"))})
