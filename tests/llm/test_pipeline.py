"""The whole pipeline on the smallest given tables: each stage's decisions take effect on what the one before kept."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_pipeline(spark):
    import corpus_pipeline
    from lectern.llm import common, decontam, simhash, toxicity

    docs = common.table(spark, SF, "documents")
    model = toxicity.train(docs, common.table(spark, SF, "labels"))
    rejected = {r.doc_id for r in toxicity.score(docs, model).filter("predicted = 1").collect()}
    where, kept = common.scratch(spark), [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(common.saved(stage(spark, kept[-1], SF), f"{where}/{name}"))
        assert kept[-1].columns == docs.columns
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    assert ids[1] == ids[0] - rejected
    firsts = {r.component_id for r in simhash.similar_texts(kept[1]).collect()}
    assert ids[2] == firsts and len(ids[2]) < len(ids[1])
    leaked = {r.doc_id for r in decontam.leaks(kept[2], common.table(spark, SF, "benchmark")).collect()}
    assert ids[3] == ids[2] - leaked and ids[4] == ids[3]
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids[4]


@pytest.fixture
def small(spark, tmp_path):
    """Tables with nulls, empty and very long texts, repeated rows and ids, ties, and extra columns of names that stages use."""
    rng = random.Random(29)
    word = [f"w{i}" for i in range(400)]

    def text(n):
        return " ".join(rng.choice(word) for _ in range(n))

    item, a, b, c = "The quick benchmark question asks how many sheep of the shepherd were left at the end of the long day", text(120), text(120), text(90)
    near = a.split()
    near[60] = "other"
    rows = [(1, a), (9, a), (9, b), (9, b), (4, " ".join(near)), (5, f"{text(30)} {item} {text(30)}"), (6, f"{text(20)} password = hunter2hunter2 {text(20)}"), (7, None), (8, ""), (None, c), (None, c), (3, c), (2, text(40_000)), (11, f"{text(50)}. You are an idiot and a moron. {text(9)}")]
    docs = spark.createDataFrame([(i, t, "en", "src", None if t is None else len(t), k % 2, "x") for k, (i, t) in enumerate(sorted(rows, key=repr))], "doc_id long, text string, lang string, source string, n_chars long, score int, items string")
    docs = docs.withColumn("score", F.lit(0))  # so that repeated rows are alike in all columns
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labelled, kinds = [], []
    for i in range(100, 400):
        labelled.append((i, f"{text(20)} {rng.choice(['idiot', 'moron', 'loser']) if i % 3 == 0 else ''} {text(10)}"))
        kinds.append((i, 1, int(i % 3 == 0)))
    spark.createDataFrame(labelled, "doc_id long, text string").write.parquet(f"{tmp_path}/more")
    spark.createDataFrame(kinds, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/more"), str(tmp_path)


def test_stages_on_odd_rows(spark, small):
    import corpus_pipeline

    docs, more, sf = small
    taught = docs.unionByName(more, allowMissingColumns=True)
    stages = dict(corpus_pipeline.STAGES)
    count = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    everything = count(docs)
    kept = stages["toxicity"](spark, taught, sf)
    assert kept.columns == docs.columns
    left = count(kept.filter("doc_id is null or doc_id < 100"))
    assert everything - left == Counter([next(x for x in everything if x[0] == 11)])
    # Near copies: one of each group, rows and not ids; brute force by sets of shingles.
    got = stages["near_dedup"](spark, docs, sf)

    def shingles(t):
        w = (t or "").split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    order = sorted(everything, key=lambda x: (x[0] is None, x[0] or 0))
    firsts = []
    for x in order:
        s = shingles(x[1])
        if not any(len(s & o) >= 0.8 * len(s | o) for _, o in firsts):
            firsts.append((x, s))
    assert count(got) == Counter(x for x, _ in firsts) and got.columns == docs.columns
    got = stages["decontamination"](spark, docs, sf)
    assert count(got) == Counter({x: n for x, n in everything.items() if x[0] != 5}) and got.columns == docs.columns
    got = stages["secrets"](spark, docs, sf)
    hidden = {r.doc_id: r for r in got.filter("doc_id in (6, 7, 8)").collect()}
    assert "hunter2" not in hidden[6].text and "[SECRET]" in hidden[6].text and hidden[6].n_chars == len(hidden[6].text) and hidden[7].text is None and hidden[7].n_chars is None and hidden[8].text == ""
    assert got.count() == docs.count() and got.schema == docs.schema
    packed = stages["packing"](spark, docs, sf)
    assert packed.filter("piece = 0").count() == docs.count()


def test_stages_on_empty_tables(spark, small):
    import corpus_pipeline

    docs, _, sf = small
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
