"""The store of texts, of which updates leave all other partitions alone, and the import stream."""

import os

import pytest
from pyspark.errors import StreamingQueryException

from lectern.operators import context
from lectern.sources import store
from lectern.streaming import imports

PARTS = 8


def files_of(path):
    return {f"{d}/{f}" for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


@pytest.fixture
def made(spark, tmp_path):
    path = str(tmp_path / "store")
    frame = lambda rows: spark.createDataFrame(rows, "text_id string, n int, line string")
    store.create(frame([(f"t{t}", n, f"line {n}") for t in range(40) for n in range(3)] + [(None, 1, "x")]), path, parts=PARTS)
    return path, frame, lambda: {(r.text_id, r.n): r.line for r in store.read(spark, path).collect()}


def test_only_partitions_of_changed_texts_are_written(spark, made):
    path, frame, rows = made
    before, had = files_of(path), rows()
    assert len(had) == 120
    assert store.upsert(spark, path, frame([("t3", 0, "new"), ("t3", 1, None), (None, 1, "x")]), context.scratch(spark), parts=PARTS) == 1
    assert len({f.split("/part=")[1].split("/")[0] for f in before - files_of(path)}) == 1
    want = {k: v for k, v in had.items() if k[0] != "t3"} | {("t3", 0): "new", ("t3", 1): None}
    assert rows() == want
    after = files_of(path)
    assert store.upsert(spark, path, frame([("t3", 1, None), ("t3", 0, "new"), ("t5", 2, "line 2"), ("t5", 1, "line 1"), ("t5", 0, "line 0")]), context.scratch(spark), parts=PARTS) == 0
    assert files_of(path) == after and rows() == want
    assert store.upsert(spark, path, frame([("u", 1, "a"), ("u", 1, "a")]), context.scratch(spark), parts=PARTS) == 1
    assert store.read(spark, path).filter("text_id = 'u'").count() == 2
    assert store.upsert(spark, path, frame([("u", 1, "a")]), context.scratch(spark), parts=PARTS) == 1 and store.read(spark, path).filter("text_id = 'u'").count() == 1
    assert store.upsert(spark, path, frame([]), context.scratch(spark), parts=PARTS) == 0


def test_remove(spark, made):
    path, frame, rows = made
    before, had = files_of(path), rows()
    assert store.remove(spark, path, frame([("t1", 0, ""), ("none", 0, ""), (None, 0, "")]), context.scratch(spark), parts=PARTS) == 1
    assert rows() == {k: v for k, v in had.items() if k[0] != "t1"}
    assert len({f.split("/part=")[1].split("/")[0] for f in before - files_of(path)}) == 1
    assert store.remove(spark, path, frame([("t1", 0, "")]), context.scratch(spark), parts=PARTS) == 0
    assert store.remove(spark, path, frame([(k, 0, "") for k in {k for k, _ in had}]), context.scratch(spark), parts=PARTS) == len({f.split("/part=")[1].split("/")[0] for f in before})
    assert not files_of(path)


def test_add_new_leaves_what_is_there(spark, made):
    path, frame, rows = made
    had = rows()
    store.add_new(spark, path, frame([("t2", 0, "other"), ("v", 0, "new")]), context.scratch(spark), parts=PARTS)
    assert rows() == had | {("v", 0): "new"}


def test_stream(spark, tmp_path, monkeypatch):
    folder, path = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    log = lambda: sorted((r.batch, r.partitions > 0) for r in spark.read.parquet(f"{path}_log").collect())
    rows = lambda: sorted((r.text_id, r.n, r.line) for r in store.read(spark, path).collect())

    def run():
        imports.stream_new_texts(spark, str(folder), path, str(tmp_path / "checkpoint"), f"file://{tmp_path}/aside", parts=PARTS).awaitTermination(120)

    (folder / "a.txt").write_text("one\n\ntwo")
    (folder / "b.txt").write_bytes("caf\xe9".encode("latin-1"))
    run()
    want = [("a", 1, "one"), ("a", 3, "two"), ("b", 1, "café")]
    assert rows() == want and log() == [(0, True)]
    run()
    assert rows() == want and log() == [(0, True)]
    (folder / "c.txt").write_text("three")
    (folder / "more").mkdir()
    (folder / "more" / "a.txt").write_text("a text that is there")
    whole = store._put
    calls = []

    def broken(rows, to):
        whole(rows, to)
        calls.append(to)
        raise RuntimeError("lost after the store was written")

    monkeypatch.setattr(store, "_put", broken)
    with pytest.raises(StreamingQueryException):
        run()
    assert calls and log() == [(0, True)]
    monkeypatch.setattr(store, "_put", whole)
    run()
    want = sorted([*want, ("c", 1, "three")])
    assert rows() == want and [b for b, _ in log()] == [0, 1]
    before = files_of(path)
    run()
    assert rows() == want and files_of(path) == before


def test_a_file_of_many_texts(spark):
    content = "stray\n[1]  [001]\na\n\nb\n[2] [001]\n[22]  [001]\nc\n[3]  [001]".encode()
    made = spark.createDataFrame([("/x/y.txt", bytearray(content))], "path string, content binary")
    rows = imports.file_lines(made, head=r"\[(\d+)\]  \[001\]").collect()
    assert sorted((r.text_id, r.n, r.line) for r in rows) == [("1", 1, "a"), ("1", 3, "b"), ("1", 4, "[2] [001]"), ("22", 1, "c")]
