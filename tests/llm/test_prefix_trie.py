import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from lectern.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """The trie by hand: every prefix as a tuple."""
    own = defaultdict(list)
    digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()
    for c, k, r, t in rows:
        if c is not None:
            r, t = r or "", t or ""
            own[c].append(((k is not None, k or 0), digest(r, t), r, t))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        head = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        seq = tuple(own.get(head, [])[:h] + turns[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].add(c)
        ends[seq].append(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()
    )


def result(spark, rows):
    return sorted(map(tuple, T.prefix_trie(spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({}).selectExpr("*", "1 AS depth", "2 AS a", "3 AS own", "4 AS __range")).collect()))


def case(seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-50, 420), 120) + [0, 100, 200]:
        for k in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([k, k, k, None]), rng.choice(["user", "assistant", "", None]), rng.choice(["a", "b", "ä😀", "", None, "long " * 20])))
    rows += rng.sample(rows, 20) + [(None, 1, "user", "x")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain(spark, seed):
    rows = case(seed)
    assert result(spark, rows) == plain(rows)


def test_long_chains_copies_and_hot_turns(spark):
    rows = [(7, k, "user", f"t{k % 11}") for k in range(700)] + [(c, k, "user", f"t{k % 11}") for c in (107, 131) for k in range(300)]
    rows += [(c, k, "user", "same") for c in range(1000, 1300) for k in range(7)]
    rows += [(c, k, "user", "same" if k < 6 else str(c % 40)) for c in range(2000, 2200) for k in range(8)]
    assert result(spark, rows) == plain(rows)


def test_empty_and_turnless(spark):
    assert result(spark, []) == []
    rows = [(c, 0, "user", "x") for c in (1, 2, 3, 4, 5, 6)]
    assert result(spark, rows) == plain(rows)
    assert (1, 0, None, 6) == result(spark, rows)[0][:4]


def test_sql(spark):
    rows = case(3)
    db = duckdb.connect()
    db.register("given", spark.createDataFrame(rows, SCHEMA).toArrow())
    db.sql("CREATE TABLE conversations AS SELECT * FROM given")
    assert sorted(db.execute(T.TRIE_SQL).fetchall()) == plain(rows)
