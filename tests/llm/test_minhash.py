import random
import re

import numpy as np
import pytest

from lectern.llm import minhash as M


def plain(rows, percent=85):
    """Components by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    held = {}
    for i, s in enumerate(sets):
        for x in s:
            held.setdefault(x, []).append(i)
    pairs = {(a, b) for v in held.values() for k, a in enumerate(v) for b in v[k + 1 :]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            up[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def result(spark, rows, **k):
    df = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in rows], "doc_id long, text string, n int, node int, component_id string")
    out = M.near_duplicates(df, **k).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    return sorted((tuple(r)[:3] for r in out), key=str)


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def changed(rng, w, k):
    w = list(w)
    for i in rng.sample(range(len(w)), k):
        w[i] = f"v{rng.randrange(10**6)}"
    return w


def corpus(seed):
    rng = random.Random(seed)
    texts = []
    for n in (6, 12, 60, 100, 100, 200, 400):
        base = words(rng, n)
        texts += [" ".join(base)] * 3 + [" ".join(changed(rng, base, k)) for k in (1, 1, 1, 2, 3, 4) if k < n]
    base = words(rng, 100)  # versions that are like the base only
    texts += [" ".join(changed(rng, base, 1)) for _ in range(40)] + [" ".join(base)]
    shared = words(rng, 70)  # a common passage, too little for a link
    texts += [" ".join(shared + words(rng, 40)) for _ in range(40)]
    texts += [" ".join(words(rng, rng.randrange(1, 80))) for _ in range(100)] + ["", None, " \t\n", "a b", "A  b", "a b c d e", "ä ö\x0bü"]
    rng.shuffle(texts)
    return [(10 * i + rng.randrange(9) if rng.random() > 0.03 else None, t) for i, t in enumerate(texts)] + [(10, texts[0]), (20, "x"), (20, "y")]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = corpus(seed)
    assert result(spark, rows) == plain(rows)


@pytest.mark.parametrize("unit", [10_000, 5])
def test_in_blocks_without_a_centre(spark, monkeypatch, unit):
    """A chain whose ends are unlike, in one unit and in blocks of a few rows."""
    monkeypatch.setattr(M, "UNIT", unit)
    monkeypatch.setattr(M, "QUERIES", 4)
    monkeypatch.setattr(M, "TARGETS", 8)
    monkeypatch.setattr(M, "BIN", 50)
    rng, chain = random.Random(5), [words(random.Random(4), 60)]
    for _ in range(60):
        nxt = list(chain[-1])
        at = rng.randrange(60)
        nxt[at] = f"n{rng.randrange(10**6)}"
        chain.append(nxt)
    rows = [(i, " ".join(w)) for i, w in enumerate(chain)]
    rng.shuffle(rows)
    assert result(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert result(spark, []) == []


def test_a_large_group_is_joined(spark):
    rng = random.Random(8)
    base = words(rng, 120)
    rows = [(i, " ".join(changed(rng, base, 1))) for i in range(1, 400)] + [(1000, " ".join(base))]
    assert {c for _, _, c in result(spark, rows)} == {1}


def test_bounds_keep_pairs_at_the_threshold():
    least = M.least_matches()
    rng = np.random.default_rng(3)
    equal = (rng.random((20000, M.HASHES)) < 0.85).cumsum(1)[:, M.BATCH - 1 :: M.BATCH]
    assert (equal >= np.asarray(least)).all(1).mean() > 0.9998
    unlike = (rng.random((20000, M.HASHES)) < 0.6).cumsum(1)[:, M.BATCH - 1 :: M.BATCH]
    assert (unlike >= np.asarray(least)).all(1).mean() < 0.001
    assert (1 - 0.85**M.ROWS) ** M.BANDS < 1e-6


def test_a_very_long_text(spark):
    rng = random.Random(9)
    base = words(rng, 200_000)
    rows = [(1, " ".join(base)), (2, " ".join(changed(rng, base, 500))), (3, " ".join(words(rng, 10)))]
    assert [c for _, _, c in result(spark, rows)] == [1, 1, 3]


def test_a_bucket_without_a_link(spark):
    """Two texts that share bands and have unlike signatures, so that nothing is left for the short sets of their only bin."""
    rng = random.Random(1)
    base, other = words(rng, 200), words(rng, 200)
    texts = [" ".join(base), *(" ".join(base[:k] + other[k:]) for k in range(199, 100, -1))]
    minima = M._minima([M._set(t, M.WORDS) for t in texts])
    keys, x = M._band_keys(minima), np.roll(minima, -M.BANDS * M.ROWS, axis=1).astype("<u2")
    met = (keys == keys[0]).any(1) & (M._pass(x, np.zeros(100, np.int64), np.arange(100), M.least_matches()) < 0)
    rows = [(1, texts[0]), (2, texts[int(np.flatnonzero(met)[0])])]
    assert result(spark, rows) == plain(rows)
    none = np.zeros(0, np.int64)
    assert M._alike([], none, none, 85).tolist() == []


def test_short_sets_in_lots(monkeypatch):
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 40, n).astype("<u4")) for n in rng.integers(1, 60, 30)]
    q, t = np.repeat(np.arange(10), 20), np.tile(np.arange(10, 30), 10)
    plainly = [100 * len(set(sets[a]) & set(sets[b])) >= 50 * len(set(sets[a]) | set(sets[b])) for a, b in zip(q, t, strict=True)]
    for most in (1, 50, 1 << 20):
        monkeypatch.setattr(M, "SHORTS", most)
        assert M._alike(sets, q, t, 50).tolist() == plainly and any(plainly) and not all(plainly)
