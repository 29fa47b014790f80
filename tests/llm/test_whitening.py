import math

import numpy as np
import pytest

from lectern.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component int"


def frame(spark, vectors, ids=None):
    return spark.createDataFrame([(i, v, 1, 2, 3) for i, v in zip(ids or range(len(vectors)), vectors, strict=True)], SCHEMA)


def plain(vectors):
    x = np.asarray([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(0)
    centred = (n * x - s).astype(float) / n
    values, vec = np.linalg.eigh(centred.T @ centred / n)
    top = np.argsort(-values)[:8]
    return n, ((n * x - s) ** 2).sum(1), centred @ vec[:, top] / np.sqrt(values[top]), values[top] / values.sum()


@pytest.mark.parametrize("dims", [3, 24])
def test_against_numpy(spark, dims):
    rng = np.random.default_rng(dims)
    vectors = (rng.normal(size=(300, dims)) @ rng.normal(size=(dims, dims))).astype(np.float32).tolist()
    vectors += [vectors[0]] * 200 + [[c + 1e-9 for c in vectors[1]]]
    n, dev, z, explained = plain(vectors)
    out = W.whiten(frame(spark, vectors)).collect()
    assert len(out) == len(vectors) * min(dims, 8)
    signs = {}
    for r in out:
        j, want = r["component"] - 1, z[r["vec_id"], r["component"] - 1]
        if abs(want) > 1e-3:
            assert signs.setdefault(j, np.sign(want * r["whitened"])) == np.sign(want * r["whitened"])
        assert abs(abs(r["whitened"]) - abs(want)) < 1e-6 and r["deviation"] == dev[r["vec_id"]] and r["n"] == n
        assert abs(r["explained"] / explained[j] - 1) < 1e-9 and 0 <= r["identity_error"] < 1e-9


def test_rows_left_out_and_flat_components(spark):
    rng = np.random.default_rng(1)
    good = [[float(v), 0.5, float(v) * 2] for v in rng.normal(size=50)]
    bad = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 0.0], [float("inf"), 0.0, 0.0], [1.0, 2.0], [3e38, 0.0, 0.0]]
    out = W.whiten(frame(spark, good + bad)).collect()
    assert {r["vec_id"] for r in out} == set(range(50)) and len(out) == 150 and {r["n"] for r in out} == {50}
    assert {r["component"] for r in out if r["whitened"] is None} == {3} and all(r["identity_error"] < 1e-8 for r in out)


def test_empty_single_and_equal(spark):
    assert W.whiten(frame(spark, [])).collect() == [] and W.whiten(frame(spark, [None, []])).collect() == []
    out = W.whiten(frame(spark, [[1.0, 2.0]] * 5, [7, 7, None, 1, 2])).collect()
    assert len(out) == 10 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in out} == {(5, 0, None, None, None)}


def test_weights_of_one_and_large_numbers(spark):
    vectors = [[0.0, 1.0], [2.0, 0.0], [5.0, 5.0]]
    once, often = (sorted((r["component"], abs(round(r["whitened"], 9))) for r in W.whiten(frame(spark, v), fit_weights="one").collect()) for v in (vectors, vectors + [vectors[0]] * 4))
    assert set(once) == set(often)
    large = [[1e15, 0.0], [-1e15, 1.0], [3.0, 2.0]]
    assert {r["deviation"] for r in W.whiten(frame(spark, large)).collect() if r["vec_id"] < 2} == {None}
    with pytest.raises(ValueError):
        W.whiten(frame(spark, vectors), fit_weights="other")
