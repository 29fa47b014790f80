"""Scans in ranges against one pass over the rows, with nulls at the ends of ranges, and how far one group spreads."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import context, ranges
from lectern.operators import divisions as D
from lectern.sources import files


def groups(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        out.setdefault(r[0], []).append(r)
    return out


def case(seed):
    rng = random.Random(seed)
    keys = [1] * 20 + [2, 2, 3, None]
    rows, at = [], 0
    for _ in range(600):
        at += 1
        rows.append((rng.choice(keys), at, rng.choice([None, None, None, None, "a", "b"]), rng.choice([None, 1, 1, 2])))
    rng.shuffle(rows)
    return rows


@pytest.fixture
def frame(spark):
    return lambda rows: spark.createDataFrame(rows, "k int, n int, v string, c int").repartition(5)


@pytest.mark.parametrize("seed", range(3))
def test_scans(spark, frame, seed):
    rows = case(seed)
    ranged = ranges.in_ranges(frame(rows), ["k", "n"], f"{context.scratch(spark)}/r", 37)
    assert ranged.select(ranges.RANGE).distinct().count() == 37
    got = ranges.scan(ranged, ["k"], ["n"], {"place": ("sum", F.lit(1).cast("long")), "x": ("xor", F.col("n")), "l": ("last", F.col("v")), "p": ("previous", F.col("v"))})
    got = {(r.k, r.n): (r.place, r.x, r.l, r.p) for r in got.collect()}
    want = {}
    for k, own in groups(rows).items():
        x, last, before = 0, None, None
        for i, (_, n, v, _) in enumerate(own, 1):
            x, last = x ^ n, v if v is not None else last
            want[k, n] = (i, x, last, before)
            before = v
    assert got == want


@pytest.mark.parametrize("seed", range(2))
def test_inherit_sections_and_changes(spark, frame, seed):
    rows = case(10 + seed)
    at = lambda: f"{context.scratch(spark)}/r"
    spark.conf.set("spark.sql.shuffle.partitions", "29")
    try:
        carried = {(r.k, r.n): r.v for r in context.inherit(frame(rows), ["k"], ["n"], ["v"], at()).collect()}
        marked = {(r.k, r.n): (r.section, r.header) for r in D.mark_sections(frame(rows), ["k"], "n", "v", F.col("v") == "a", at()).collect()}
        changed = {(r.k, r.n): r.division for r in D.by_change(frame(rows), ["k"], "n", "c", at()).collect()}
        whole = {(r.k, r.section): (r.header, r.body) for r in D.split_sections(frame(rows), "k", "n", "v", F.col("v") == "a", at()).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    sections = {}
    for k, own in groups(rows).items():
        last, section, division, before = None, 0, 0, "none"
        for _, n, v, c in own:
            last = v if v is not None else last
            section += v == "a"
            division += c != before
            before = c
            assert carried[k, n] == last and marked[k, n] == (section, "a" if section else None) and changed[k, n] == division
            sections.setdefault((k, section), []).extend([v] if v is not None and v != "a" else [])
    assert whole == {s: ("a" if s[1] else None, "\n".join(v)) for s, v in sections.items()}


def test_one_long_file_is_spread(spark):
    rows = spark.range(200_000).select(F.lit("file").alias("path"), F.col("id").alias("n"), F.when(F.col("id") % 50_000 == 7, F.col("id")).alias("v"))
    where = f"{context.scratch(spark)}/r"
    ranged = ranges.in_ranges(rows, ["path", "n"], where, 16)
    sizes = [r["count"] for r in ranged.groupBy(ranges.RANGE).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 200_000 / 8
    out = ranges.scan(ranged, ["path"], ["n"], {"l": ("last", F.col("v"))})
    assert out.groupBy("l").count().filter("l is not null").select("l", "count").orderBy("l").collect() == [(7, 50_000), (50_007, 50_000), (100_007, 50_000), (150_007, 49_993)]


def test_empty(spark, frame):
    assert context.inherit(frame([]), ["k"], ["n"], ["v"], f"{context.scratch(spark)}/r").collect() == []


def test_long_files_are_read_in_splits(spark, tmp_path):
    lines = [f"line {i} {'ä' * (i % 9)}" if i % 10 else "" for i in range(3000)]
    (tmp_path / "a.txt").write_bytes(("﻿" + "\r\n".join(lines)).encode())
    (tmp_path / "b.txt").write_bytes("caf\xe9\nx\n\ny".encode("latin-1"))
    (tmp_path / "pipeline_reports").mkdir()
    (tmp_path / "pipeline_reports" / "z.txt").write_text("no")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = sorted((r.path.rsplit("/", 1)[1], r.n, r.line) for r in files.read_long_files(spark, str(tmp_path), f"{context.scratch(spark)}/r").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [("a.txt", i, x) for i, x in enumerate(map(str.strip, lines), 1) if x] + [("b.txt", 1, "café"), ("b.txt", 2, "x"), ("b.txt", 4, "y")]


def test_places_in_any_order(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "b", "ä", "", None, "a\x00", "Z"]), rng.choice([None, 1, 2])) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, t string, n int").repartition(7)
    got = {r.id: (r.place, r.total) for r in context.global_number(df, ["t", "n", "id"], f"{context.scratch(spark)}/r").collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[2] is not None, r[2] or 0, r[0]))
    assert got == {r[0]: (k, 500) for k, r in enumerate(order, 1)}
    assert context.global_number(df.filter("false"), ["t", "id"], f"{context.scratch(spark)}/r").collect() == []
