"""Postings: what they hold, and that a list of lemmas doesn't move them."""

import uuid

import pytest
from pyspark.sql import functions as F

from lectern.operators import context, postings

TOKENS = "sentence_id long, tokens array<struct<text:string,lemma:string>>"


@pytest.mark.parametrize("few", [True, False])
def test_postings(spark, monkeypatch, few):
    name, where = f"postings_{uuid.uuid4().hex}", context.scratch(spark)
    rows = [(i, [(w.upper(), w) for w in ["the", "the", f"w{i % 7}"] + ["rare"] * (i == 41)] + [("X", None)]) for i in range(200)] + [(900, []), (901, None)]
    postings.write(spark.createDataFrame(rows, TOKENS), name, f"{where}/p", span=10, buckets=16, salts=4)
    monkeypatch.setattr(postings, "FEW_LEMMAS", 100 if few else 0)
    asked = spark.createDataFrame([("the",), ("rare",), ("rare",), ("w3",), ("none",), (None,)], "lemma string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = postings.sentences(spark, name, asked, salts=4)
        assert sorted(map(tuple, got.collect())) == sorted([("the", i) for i in range(200)] + [("rare", 41)] + [("w3", i) for i in range(200) if i % 7 == 3])
        plan = got._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        scan = next(line for line in plan.splitlines() if "Scan parquet" in line and "sentence_ids" in line)
        above = plan[: plan.index(scan)].splitlines()
        depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
        parents, at = [], depth(scan)
        for line in reversed(above):
            if depth(line) < at:
                parents.append(line)
                at = depth(line)
        assert not any("Exchange" in line for line in parents)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    table = spark.table(name)
    assert table.groupBy("lemma", "block").count().filter("count > 1").isEmpty() and table.agg(F.max("n")).first()[0] <= 10
    assert table.filter("lemma = 'the'").select("salt").distinct().count() == 4
    spark.sql(f"DROP TABLE {name}")
