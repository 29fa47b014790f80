"""Each corpus operator against a brute-force version, and on nulls, empty texts, repeated rows, empty tables and clashing columns."""

import hashlib
import html
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import common, decontam, fingerprints, html_text, packing, secrets, simhash, substring, tokens, toxicity, warc
from lectern.llm.components import components

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [(None, None, 1), (7, "", 2), (8, " \n\t ", 3), (9, "one", 4), (9, "one", 4), (10, "a\x0bb  c d", 5), (11, "é漢字 <|endoftext|> x's", 6)]
EDGE_SCHEMA = "doc_id long, text string, row int"  # a column that operators use inside


def some_texts(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "tion", "onea", "ther", "es", "Über", "naïve", "x1", "and,", "end.\n"] + [f"w{i}" for i in range(60)]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 150))) for _ in range(n)]
    passage = " ".join(rng.choice(words) for _ in range(70))
    for i in range(0, n, 6):
        out[i] = out[i] + " " + passage + "  " + out[(i * 7) % n][:50]
    out[5] = out[4]
    out[9] = out[8] + " x"
    return out


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)


# Token counts and packing


def test_tokens_match_the_library(spark):
    texts = some_texts(1) + [t for _, t, _ in EDGE if t] + ["  two  spaces ", "a\r\n b", "x" * 5000, "שלום world"]
    texts.append(" ".join(texts) * 3)
    lib = Tokenizer.from_file(PATH)
    expected = {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    for chunk, overlap in ((32768, 256), (150, 12)):
        got = {r.doc_id: r for r in tokens.count_tokens(frame(spark, texts), PATH, chunk=chunk, overlap=overlap).collect()}
        assert {i: r.n_tokens for i, r in got.items()} == expected
        assert all(got[i].n_bytes == len(t.encode()) and got[i].over_limit == (expected[i] > 1024) for i, t in enumerate(texts))


def test_spliced_ids_are_the_library_s(spark):
    e = tokens.Encoder(PATH)
    text = " ".join(some_texts(2))
    for chunk, overlap in ((100, 3), (333, 10)):
        assert e.encode_spliced(text, chunk, overlap).tolist() == e.encode(text).tolist()
    assert e.encode_spliced("y" * 3000, 100, 3).tolist() == e.encode("y" * 3000).tolist()  # no stable place: widened to the end


def test_units_are_told_apart_by_their_bytes(spark):
    """Long words that differ in the order of their parts only."""
    a, b, c = ("".join(random.Random(k).choice("abcdefgh") for _ in range(4096)) for k in (1, 2, 3))
    texts = [f"x {a}{b}{c} y", f"x {a}{c}{b} y", f"x {a}{b}{c} z", "1 12 it's  \n\t x 12"]
    e = tokens.Encoder(PATH)
    assert e.fast is not None
    assert [x.tolist() for x in e.encode_many(texts)] == [e.encode(t).tolist() for t in texts]
    packed = packing.token_pieces(frame(spark, texts), PATH, size=1 << 30).collect()
    assert {r.doc_id: r.ids_crc32 for r in packed} == {i: zlib.crc32(np.append(e.encode(t), np.uint32(2)).astype("<u4").tobytes()) for i, t in enumerate(texts)}


def test_tokens_edges(spark):
    got = tokens.count_tokens(spark.createDataFrame(EDGE, EDGE_SCHEMA), PATH).collect()
    assert len(got) == len(EDGE) and {r.n_tokens for r in got if r.n_bytes == 0} == {0}
    assert tokens.count_tokens(spark.createDataFrame([], EDGE_SCHEMA), PATH).count() == 0


def test_packing(spark):
    texts = some_texts(3) + [" ".join(some_texts(4)), ""]
    lib = Tokenizer.from_file(PATH)
    ids = {i: lib.encode(t, add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    got = packing.pack(frame(spark, texts), PATH).collect()
    seen = {}
    for r in got:
        own = np.asarray(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert zlib.crc32(own.tobytes()) == r.ids_crc32 and len(own) == r.length
        assert r.length == 1024 or r.piece == 0
        seen.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for i, x in ids.items():
        pieces = sorted(seen[i])
        assert [p for p, _, _ in pieces] == list(range(len(pieces))) and sum(n for _, _, n in pieces) == len(x)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(bins) <= 1.1 * sum(map(len, ids.values())) / 1024 + 1


def test_best_two_fit_takes_two_for_one():
    bins, offsets = packing.best_two_fit(np.asarray([600, 380, 210, 205]), 1024)
    assert sorted(np.bincount(bins, [600, 380, 210, 205])) == [380, 1015]
    assert packing.best_two_fit(np.zeros(0, np.int64), 1024)[0].tolist() == []


def test_packing_edges(spark):
    got = packing.pack(spark.createDataFrame(EDGE, EDGE_SCHEMA), PATH)
    assert got.count() == len(EDGE) and got.agg(F.sum("length")).first()[0] < 1024 and got.select("sequence_id").distinct().count() == 1
    assert packing.pack(spark.createDataFrame([], EDGE_SCHEMA), PATH).count() == 0


# SimHash


def slow_fingerprint(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(values, radius):
    up = list(range(len(values)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def test_near_duplicates(spark):
    texts = some_texts(5) + ["", " ", "One two", "one TWO"]
    got = {r.doc_id: r for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    fps = [slow_fingerprint(t) for t in texts]
    assert [int(got[i].fingerprint, 16) for i in range(len(texts))] == fps
    assert [got[i].component_id for i in range(len(texts))] == slow_components(fps, 4)


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def crowds(seed, n=120):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(6)]
    values = set(base)
    for b in base:
        x = b
        for _ in range(n):
            x = (x if rng.random() < 0.5 else b) ^ sum(1 << k for k in set(rng.choices(range(64), k=rng.randint(1, 4))))
            values.add(x)
    return sorted(values, key=signed)


@pytest.mark.parametrize(("large", "share"), [(4096, 2048), (40, 2048), (40, 10)])
def test_links_of_chains_and_crowds(spark, monkeypatch, large, share):
    """Also where shards count as large from a few fingerprints on, and are split by further blocks or searched in shares."""
    monkeypatch.setattr(simhash, "LARGE", large)
    monkeypatch.setattr(simhash, "SHARD_QUERIES", share)
    values = crowds(6)
    links = simhash.link(spark.createDataFrame([(signed(v),) for v in values], "fp long"), common.scratch(spark))
    roots = {r.node: r.root for r in components(links, common.scratch(spark)).collect()}
    expected = slow_components(values, 4)
    assert [roots.get(signed(v), signed(v)) for v in values] == [signed(values[k]) for k in expected]


def test_forest_of_trees():
    """Every pair within the radius in one shard, none across shards, found by following edges; a node's child at a distance is at that distance."""
    values = crowds(22, 60)
    fps = np.asarray(values + values[:100], np.uint64)[:, None]
    shard = np.repeat([3, 7], [len(values), 100])
    forest = simhash.Forest(fps, shard)
    assert len(forest.child) == len(fps) - 2
    parent, d = forest.key // 65, forest.key % 65
    assert all(int(fps[a, 0] ^ fps[b, 0]).bit_count() == k for a, b, k in zip(parent.tolist(), forest.child.tolist(), d.tolist()))
    for radius in (0, 2, 4):
        found = sorted((a, b) for q, n, _ in forest.search(np.arange(len(fps)), radius) for a, b in zip(q.tolist(), n.tolist()))
        assert found == sorted((i, j) for i in range(len(fps)) for j in range(i) if shard[i] == shard[j] and int(fps[i, 0] ^ fps[j, 0]).bit_count() <= radius)
    visited = forest.visits
    list(forest.search(np.arange(len(fps)), 2))
    assert forest.visits - visited < len(values) ** 2 / 2  # fewer than all pairs


def test_spanning_links():
    rng = np.random.default_rng(23)
    for _ in range(20):
        n = 200
        a, b = rng.integers(0, n, (2, 150))
        d = rng.integers(0, 9, 150)
        keep = simhash.spanning(n, a, b, d)
        own = {frozenset(x) for x in zip(a[keep].tolist(), b[keep].tolist())}
        assert len(own) == len(keep)
        up = list(range(n))

        def root(i, up=up):
            while up[i] != i:
                i = up[i]
            return i

        for x, y in zip(a[keep].tolist(), b[keep].tolist()):
            assert root(x) != root(y)  # no cycle
            up[root(x)] = root(y)
        assert all(root(x) == root(y) for x, y in zip(a.tolist(), b.tolist()))


def shingle_sets(texts, words=5):
    out = []
    for t in texts:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        out.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    return out


def test_similar_texts(spark):
    """Against all pairs: what is alike to 0.85 or more is linked, what is alike to less than 0.8 isn't."""
    rng = random.Random(24)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(60):
        w = [rng.choice(words) for _ in range(rng.randint(60, 300))]
        texts.append(" ".join(w))
        for _ in range(rng.randint(0, 3)):
            x = list(w)
            for _ in range(rng.randint(1, max(1, len(w) // 40))):
                x[rng.randrange(len(x))] = "new"
            texts.append(" ".join(x))
    texts += ["", " ", "one two", "One TWO"]
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(frame(spark, texts), meeting=1 - 1e-9).collect()}
    sets = shingle_sets(texts)
    sure, may = list(range(len(texts))), list(range(len(texts)))

    def root(up, i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            union = sets[i] | sets[j]
            alike = len(sets[i] & sets[j]) / len(union) if union else 1.0
            for up, least in ((sure, 0.85), (may, 0.8)):
                if alike >= least:
                    a, b = root(up, i), root(up, j)
                    up[max(a, b)] = min(a, b)
    assert all(got[i] == got[root(sure, i)] for i in range(len(texts)))
    assert all(root(may, i) == root(may, got[i]) for i in range(len(texts)))
    assert sum(root(sure, i) != i for i in range(len(texts))) > 20
    assert simhash.similar_texts(frame(spark, ["x"]).limit(0)).count() == 0
    assert simhash.similar_texts(spark.createDataFrame(EDGE, EDGE_SCHEMA)).count() == len(EDGE)


def test_simhash_edges(spark):
    got = simhash.near_duplicates(spark.createDataFrame(EDGE, EDGE_SCHEMA)).collect()
    assert len(got) == len(EDGE)
    assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {7}
    assert simhash.near_duplicates(spark.createDataFrame([], EDGE_SCHEMA)).count() == 0


def test_components_of_a_long_chain(spark):
    n = 60
    links = spark.createDataFrame([(i, i + 1) for i in range(1, n)] + [(100, 102), (102, 101), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components(links, common.scratch(spark)).collect()}
    assert got == {i: 1 for i in range(1, n + 1)} | {100: 100, 101: 100, 102: 100}


# Substrings


def slow_removal(rows, window):
    first, out = {}, []
    for i, t in sorted(rows):
        words = WORDS.findall(t)
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if first.setdefault(tuple(words[k : k + window]), i) < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(words), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(words, gone) if not g).encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("window", "cells"), [(50, None), (50, 64), (7, None), (8, 64)])
def test_repeats(spark, window, cells):
    """With 64 cells nearly every window passes the sketch; the result is the same."""
    texts = some_texts(7) + ["again " * 200, "again " * 120, ""]
    got = substring.remove_repeats(frame(spark, texts), window=window, cells=cells and cells * substring.BLOCKS).collect()
    assert sorted(map(tuple, got)) == slow_removal(list(enumerate(texts)), window)


def test_repeats_within_a_document(spark):
    """A passage that a document, or several rows of one id, holds more than once goes at every place."""
    rng = random.Random(16)
    p = " ".join(f"p{k}" for k in range(8))
    rows = [(3, f"x {p} y"), (5, f"a {p} b a {p} b"), (13, f"y {p} z"), (15, f"c {p} d"), (15, f"c {p} d")]
    for k in range(20, 80, 3):
        p = " ".join(f"q{k}x{rng.randint(0, 2)}" for _ in range(rng.randint(5, 12)))
        rows += [(k + i, " ".join(f"{rng.choice('abc')} {p} {rng.choice('abc')}" for _ in range(rng.randint(1, 3)))) for i in range(3)]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), window=5).collect()
    assert sorted(map(tuple, got)) == sorted(slow_removal(rows, 5))


def test_repeats_of_one_hot_passage(spark, monkeypatch):
    """A passage in a third of all rows, with keys that count as hot from a few rows on, and a very long text."""
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(common, "HOT_SHARE", 50)
    rng = random.Random(20)
    p = " ".join(f"p{k}" for k in range(30))
    rows = [(k, f"{rng.choice('abcd')} {rng.choice('abcd')} " + (f"{p} " if k % 3 == 0 else "") + " ".join(rng.choice("uvwxyz") for _ in range(9))) for k in range(150)]
    rows.append((200, " ".join(str(k) for k in range(30_000)) + " " + p))
    rows.append((201, " ".join(str(k) for k in range(30_000)) + " " + p))
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), window=8).collect()
    assert sorted(map(tuple, got)) == slow_removal(rows, 8)


def test_sketch_never_counts_less(spark):
    texts = some_texts(21)
    cells = 1 << 12
    bits = substring.sketch(frame(spark, texts).select("text"), window=7, cells=cells)
    table = [np.unpackbits(np.frombuffer(bits[r * cells // 8 : (r + 1) * cells // 8], np.uint8)) for r in range(2)]
    names = [set(substring.Words([t], 7).name.tolist()) for t in texts]
    counters = [np.zeros(cells, np.int64), np.zeros(cells, np.int64)]
    for own in names:
        for row, c in enumerate(substring._cells(np.asarray(sorted(own), np.uint64), cells)):
            np.add.at(counters[row], c.astype(np.int64), 1)
    assert all(np.array_equal(t, c > 1) for t, c in zip(table, counters))


def test_repeats_edges(spark):
    rows = [*EDGE, (12, "v " * 60, 1), (None, "v " * 60, 1), (13, "v " * 60, 1), (13, "v " * 60, 1)]
    got = sorted(((r.doc_id or -1, r.n_words, r.n_removed) for r in substring.remove_repeats(spark.createDataFrame(rows, EDGE_SCHEMA)).collect()))
    assert len(got) == len(rows) and (13, 60, 60) in got and (12, 60, 0) in got and (-1, 60, 0) in got
    assert substring.remove_repeats(spark.createDataFrame([], EDGE_SCHEMA)).count() == 0
    kept = substring.remove_repeats(spark.createDataFrame([(1, "a  b\n" * 30)], "doc_id long, text string"), keep_text=True).first()
    assert kept.kept_text == " ".join(["a", "b"] * 30)


# Benchmark


def test_leaks(spark, monkeypatch):
    rng = random.Random(8)
    letters = "abcdefghij klmnop qrstu"
    items = ["".join(rng.choice(letters) for _ in range(rng.randint(150, 300))) for _ in range(20)]
    docs = [t * 3 for t in some_texts(9, 40)]
    planted = set()
    for i, item in enumerate(items):
        x = list(item)
        for _ in range(len(x) // 25 if i % 2 else 0):
            p = rng.randrange(len(x))
            rng.choice([lambda: x.__setitem__(p, "z"), lambda: x.pop(p), lambda: x.insert(p, "y")])()
        docs[2 * i] = docs[2 * i][:300] + "\n" + "".join(x).upper().replace(" ", "  ") + "! " + docs[2 * i][300:]
        planted.add((2 * i, i))
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(None, items[0]), (99, None), (98, "!?")], "item_id long, text string")
    for size, postings in ((decontam.BLOCK_BYTES, decontam.POSTINGS), (1000, 50)):
        monkeypatch.setattr(decontam, "POSTINGS", postings)
        got = decontam.leaks(frame(spark, docs), bench, block_bytes=size).collect()
        assert {(r.doc_id, r.item_id) for r in got} == planted
        assert all(r.edits == 0 for r in got if r.item_id % 2 == 0)
    for size in (decontam.BLOCK_BYTES, 500):
        held = decontam.with_items(frame(spark, docs), bench, block_bytes=size)
        assert {(r.doc_id, i) for r in held.collect() for i in r.leaked_items} == planted


def test_leaks_of_pieces(spark):
    """Every verbatim piece of the least length is found, wherever in its item it starts."""
    rng = random.Random(17)
    item = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300))
    least = decontam.PIECE + decontam.PIECE_STRIDE - 1
    pieces = [item[at : at + least] for at in range(len(item) - least + 1)]
    docs = frame(spark, [f"{t} {p} {t}" for t, p in zip(some_texts(18, len(pieces)), pieces)])
    bench = spark.createDataFrame([(1, item), (2, item[::-1])], "item_id long, text string")
    got = decontam.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, 1) for i in range(len(pieces))}
    assert all(r.edits == 0 and 1 <= r.fragments <= r.of_fragments for r in got)


def slow_align(p, t, low=-99, high=99, whole=False):
    """Edits of the best place of p in t, or of p and the whole of t, by paths on the diagonals from low to high."""
    far = 1 << 20
    on = lambda i, j: low <= j - i <= high
    row = [(j if whole else 0) if on(0, j) else far for j in range(len(t) + 1)]
    for i, c in enumerate(p):
        new = []
        for j in range(len(t) + 1):
            best = min(row[j] + 1, row[j - 1] + (c != t[j - 1]) if j else far, new[j - 1] + 1 if j else far)
            new.append(best if on(i + 1, j) else far)
        row = new
    return row[-1] if whole else min(row)


def test_alignment():
    rng = random.Random(10)
    for _ in range(150):
        p, t = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14))), bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 25)))
        edits = slow_align(p, t)
        found = decontam.align(p, t, len(p), -len(p), len(t))
        assert found is not None and found[2] == edits and slow_align(p, t[found[0] : found[1]], whole=True) == edits
        assert decontam.align(p, t, edits - 1, -len(p), len(t)) is None if edits else True
        low = rng.randint(-4, 20)
        high = low + rng.randint(0, 6)
        inside = slow_align(p, t, low=low, high=high)
        found = decontam.align(p, t, len(p), low, high)
        assert (found[2] if found else None) == (inside if inside <= len(p) else None)


def test_leaks_of_short_items(spark):
    """Items of 1 to 19 bytes, as they are, at whole words."""
    rng = random.Random(25)
    words = ["a", "is", "7", "what", "times", "eight", "x", "Was"]
    items = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(60)})
    items = [i for i in items if 0 < len(i) < 20][:30]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(80)] + ["whatis 7", "", "What,  IS 7!"]
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(frame(spark, texts), spark.createDataFrame([(f"i{k}", t) for k, t in enumerate(items)], "item_id string, text string"), block_bytes=200).collect()}
    plain = lambda t: f" {' '.join(re.findall(r'[a-z0-9]+', t.lower()))} "
    assert got == {(d, f"i{k}") for d, t in enumerate(texts) for k, i in enumerate(items) if plain(i) in plain(t)}


def test_leaks_in_a_very_long_text(spark):
    """Wherever it stands, also over the end of a segment."""
    rng = random.Random(26)
    item = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200))
    filler = "word " * (decontam.SEARCH_BYTES // 5 + 100)
    texts = [filler[:at] + f" {item} " + filler for at in (0, decontam.SEARCH_BYTES - 300, decontam.SEARCH_BYTES - 90, decontam.SEARCH_BYTES, decontam.SEARCH_BYTES + 50)]
    ix = decontam.Index(["1"], [item.encode()])
    for t in texts:
        found = ix.search([decontam.normal(t)])
        assert {f for _, _, f, *_ in found} == set(range(len(ix.fragments)))
        assert all(decontam.normal(t)[a:z] == ix.fragments[f] for _, _, f, a, z, _ in found)


def test_no_leak_is_lost_by_the_bands():
    """Texts with edited fragments against an alignment of all of the text."""
    rng = random.Random(27)
    letters = "abcdefgh "
    for _ in range(40):
        item = decontam.normal("".join(rng.choice(letters) for _ in range(rng.randint(25, 130))))
        ix = decontam.Index(["1"], [item])
        for _ in range(4):
            x = list(item.decode())
            for _ in range(rng.randint(0, len(item) // 10)):
                p = rng.randrange(len(x))
                rng.choice([lambda: x.__setitem__(p, "z"), lambda: x.pop(p), lambda: x.insert(p, "y")])()
            text = decontam.normal("".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) + "".join(x) + "".join(rng.choice(letters) for _ in range(60)))
            found = {f: e for _, _, f, _, _, e in ix.search([text])}
            for f, (fragment, most) in enumerate(zip(ix.fragments, ix.edits.tolist())):
                edits = slow_align(fragment, text, high=999)
                assert found.get(f) == (edits if edits <= most else None)


def test_leaks_edges(spark):
    bench = spark.createDataFrame([(1, "a long enough item of the benchmark, with some words")], "item_id long, text string")
    assert decontam.leaks(spark.createDataFrame(EDGE, EDGE_SCHEMA), bench).count() == 0
    assert decontam.leaks(spark.createDataFrame([], EDGE_SCHEMA), bench).count() == 0
    assert decontam.leaks(spark.createDataFrame(EDGE, EDGE_SCHEMA), bench.limit(0)).count() == 0
    assert decontam.with_items(spark.createDataFrame(EDGE, EDGE_SCHEMA), bench.limit(0)).count() == len(EDGE)


# Toxicity


def test_toxicity(spark):
    rng = random.Random(11)
    plain = [f"{a}{b}{c}" for a in ("th", "on", "er", "in") for b in ("an", "ed", "es", "ou") for c in ("", "re", "st", "ly")]
    bad = ["idiot", "moron", "loser"]
    rows = []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        toxic = i % 5 == 0
        for _ in range(2 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words) + ".", int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = docs.select("doc_id", "toxic").unionByName(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int"))
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    held = [(got[i].predicted, t) for i, _, t in rows if got[i].held_out]
    assert np.mean([p == t for p, t in held]) > 0.98
    assert all(s > 0.7 for s in model.score(["you are an i.d.i.o.t today", "what a l o s e r he is", "id1ot", "m-o_ron!"]))
    assert min(model.score(["such idioots", "a lozser"])) > 3 * model.score([""])[0]
    assert all(s < 0.3 for s in model.score(["", "thanre onedly", "then onest inoured"]))
    edge = toxicity.score(spark.createDataFrame(EDGE, EDGE_SCHEMA), model).collect()
    assert len(edge) == len(EDGE) and all(0 <= r.score <= 1 for r in edge) and [r.held_out for r in edge if r.doc_id is None] == [False]
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.with_score(docs, model).columns == [*docs.columns, "toxicity"]


def toxic_sample(rng, n):
    plain = [f"{a}{b}{c}" for a in ("th", "on", "er", "in") for b in ("an", "ed", "es", "ou") for c in ("", "re", "st", "ly")]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 40))]
        for _ in range(2 if i % 4 == 0 else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron", "loser"]))
        rows.append((i, " ".join(words) + rng.choice([".", "! ", "\n", ""]), int(i % 4 == 0)))
    return rows


def test_scores_against_a_plain_version(spark):
    """Every text sentence by sentence and word by word, without batches, bags of runs and the prefilter."""
    rows = toxic_sample(random.Random(41), 300)
    model = toxicity.fit([t for _, t, _ in rows], [y for _, _, y in rows])
    rng = random.Random(42)
    texts = [t for _, t, _ in rows[:80]] + [". ".join(rng.choice(rows)[1] for _ in range(4)) for _ in range(40)]
    texts += ["such idioots here", "a lozser. an i-d-i-o-t", "m0ron", "", " \n ", "夢" * 40]

    def plainly(text):
        best = float(model.decide(np.zeros((1, len(model.kernel.landmarks))))[0])
        for sentence in toxicity._SENTENCE.split(text.lower()):
            like = [model.kernel([w])[1][0] for w in sorted(toxicity.words_of(sentence))]
            near = [x for x in like if x[: model.kernel.telling].max() >= model.setting.least]
            if near:
                best = max(best, float(model.decide(np.max(near, axis=0)[None])[0]))
        return float(model.probability(np.asarray([best]))[0])

    got = {r.doc_id: r.score for r in toxicity.score(frame(spark, texts), model).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx([plainly(t) for t in texts], abs=1e-5)


def test_settings_are_chosen_inside_the_sample():
    rows = toxic_sample(random.Random(43), 240)
    texts, labels = [t for _, t, _ in rows], [y for _, _, y in rows]
    blind = toxicity.Setting(least=1.5)  # no word is near enough, so all toxic texts are missed
    assert toxicity.wrong_in_folds(texts, labels, blind) == (0, 1, 1)
    lost, missed, bent = toxicity.wrong_in_folds(texts, labels, toxicity.Setting())
    assert lost == 0 and missed < 0.1 and bent < 1
    assert toxicity.choose(texts, labels, [blind, toxicity.Setting()]) == toxicity.Setting()
    assert toxicity.choose([], [], [blind]) == blind
    assert toxicity._bent("An Idiot, idiots", {"idiot"}) == "An Iddiot, idiots" and toxicity._bent("a loser", {"loser"}, "x") == "a loxser"


def test_toxicity_of_sentences():
    """Two words that neither alone makes a text toxic do so in one sentence, not in two; and a third takes it back."""
    model = toxicity.Model(toxicity.Kernel(["idiot", "moron", "friend"], 3), np.eye(3), np.asarray([1.0, 1.0, -1.0, 0, 0, 0]), -1.5, (4.0, 0.0))
    together, apart, one, kind = model.score(["such an idiot and moron here", "such an idiot. And moron here", "such an idiot here", "such an idiot and moron, my friend"])
    assert together > 0.8 and apart < 0.2 and one == apart and kind < 0.2


def test_toxic_words_in_any_form():
    model = toxicity.Model(toxicity.Kernel(["idiot", "loser", "thing"], 2), np.eye(3), np.asarray([1.0, 1.0, 0.0, 0, 0, 0]), -0.5, (10.0, 0.0))
    texts = ["an idiot", "well...idiot", "an idiot—really", "you are,idiot", "clown/loser", "stop it:idiot now", "夢" * 70 + "idiot", "a" * 60 + "idiot", "夢" * 5000 + "loser" + "夢" * 30, "you l o s e r", "x " * 100_000 + "idiot"]
    assert all(s > 0.7 for s in model.score(texts))
    assert all(s < 0.3 for s in model.score(["", "a thing", "夢" * 500, "w" * 90, "... --- !!!"]))


def test_kernel_of_gapped_runs():
    """Likeness against a plain sum over all runs of three characters and their gaps."""

    def weights(word):
        w, out = f" {word} ", {}
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + toxicity.SPAN)):
                    out[w[i] + w[j] + w[k]] = out.get(w[i] + w[j] + w[k], 0) + toxicity.GAP ** (k - i - 2)
        return out

    def alike(a, b):
        x, y = weights(a), weights(b)
        return sum(x[u] * y.get(u, 0) for u in x) / np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))

    rng = random.Random(28)
    words = ["".join(rng.choice("abcé夢") for _ in range(rng.randint(1, 12))) for _ in range(60)]
    kernel = toxicity.Kernel(words[:9], 5)
    keep, like = kernel(words)
    assert keep.tolist() == list(range(60))
    for i, w in enumerate(words):
        assert like[i].tolist() == pytest.approx([alike(w, m) for m in words[:9]], abs=1e-5)
    # The prefilter for a least likeness loses no word.
    keep, _ = kernel(words, 0.5)
    assert set(keep.tolist()) == {i for i in range(60) if like[i, :5].max() >= 0.5}


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.predicted for r in toxicity.score(docs, model).collect()] == [0]


# Fingerprints


def test_fingerprints(spark):
    texts = some_texts(12) + ["", "a", "same. text here.", "same. text here."]
    got = {r.doc_id: r for r in fingerprints.compare_with_next(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        following, half = texts[(i + 1) % len(texts)], len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        sets = [set(fingerprints.paragraph_digests(x).tolist()) for x in (t, edited, following)]
        for value, other in ((got[i].near_edited, sets[1]), (got[i].near_next, sets[2])):
            union = sets[0] | other
            assert value == pytest.approx(len(sets[0] & other) / len(union) if union else 1.0)
        own = fingerprints.sketched([fingerprints.paragraph_digests(t)])
        assert got[i].fingerprint == fingerprints.to_text(own)[0] and fingerprints.from_text([got[i].fingerprint]).sizes() == [len(sets[0])]
        # What the columns say can be had from the returned strings alone.
        assert got[i].near_edited == fingerprints.compare_fingerprints([got[i].fingerprint], [got[i].edited_fingerprint])[0]
        assert got[i].near_next == fingerprints.compare_fingerprints([got[i].fingerprint], [got[(i + 1) % len(texts)].fingerprint])[0]
    assert got[len(texts) - 1].fingerprint == got[len(texts) - 2].fingerprint


def test_peeling():
    rng = np.random.default_rng(13)
    for n, common_n in ((0, 5), (3, 50), (40, 0), (300, 10), (5000, 3)):
        a, b, c = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (n, n // 2, common_n))
        ours, theirs = fingerprints.sketched([np.concatenate([a, c]), c]), fingerprints.sketched([np.concatenate([b, c]), np.concatenate([a, b, c])])
        more, less = fingerprints.differences(ours, theirs)
        assert (more.tolist(), less.tolist()) == ([n, 0], [n // 2, n + n // 2])
    ours, theirs = np.asarray([1, 2, 3], np.uint64), np.asarray([3, 4], np.uint64)
    s = fingerprints.Sketches.of([ours], [16])
    s.subtract(fingerprints.Sketches.of([theirs], [16]))
    _, digest, sign, whole = s.peel()
    assert whole.all() and sorted(zip(digest.tolist(), sign.tolist())) == [(1, 1), (2, 1), (4, -1)]
    large = fingerprints.Sketches.of([ours, theirs], [64, 16])
    folded = large.take(np.asarray([0]), np.asarray([16]))
    assert np.array_equal(folded.digest, fingerprints.Sketches.of([ours], [16]).digest) and large.sizes().tolist() == [3, 2]


def test_digests_of_repeated_short_lines():
    """Each copy of a line counts by itself, however short the lines are."""
    text = "\n".join(c for k in range(60) for c in "abcdefghijklmnopqrstuvwxyz!,")
    d = fingerprints.paragraph_digests(text)
    assert len(d) == len(set(d.tolist())) == 60 * 28
    assert fingerprints.sketched([d]).sizes() == [60 * 28]


def test_fingerprints_of_a_very_long_text(spark):
    """More paragraphs than a two-byte count holds."""
    long = "\n".join(f"line {i}" for i in range(120_000))
    got = {r.doc_id: r for r in fingerprints.compare_with_next(spark.createDataFrame([(1, long), (2, long + "\nmore"), (3, "x")], "doc_id long, text string"), parts=2).collect()}
    assert got[1].near_next == pytest.approx(120_000 / 120_001) and got[2].near_next == 0


def test_fingerprints_in_many_ranges(spark):
    rows = [(f"k{i:03d}", f"text {i}. And more.") for i in range(40)] + [("k007", "again"), (None, "none")]
    frame_ = spark.createDataFrame(rows, "doc_id string, text string")
    got = {(r.doc_id, r.edited_sha256) for parts in (1, 3, 17) for r in fingerprints.compare_with_next(frame_, parts=parts).collect()}
    order = sorted(rows, key=lambda r: (r[0] or "", r[1]))
    edited = {(i, hashlib.sha256((t[: len(t) - len(t) // 2] + order[(k + 1) % len(order)][1][: len(t) // 2]).encode()).hexdigest()) for k, (i, t) in enumerate(order)}
    assert got == edited


def test_fingerprints_edges(spark):
    assert fingerprints.compare_with_next(spark.createDataFrame(EDGE, EDGE_SCHEMA)).count() == len(EDGE)
    assert fingerprints.compare_with_next(spark.createDataFrame([], EDGE_SCHEMA)).count() == 0
    one = fingerprints.compare_with_next(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


# WARC


def test_warc(spark):
    big, other = "é" * 150_000, "<p>x</p>" * 200
    rows = [(1, "u1", big), (2, None, None), (3, "u 3\n", big), (4, "u", "short"), (5, "u", "short"), (6, "u", other), (7, "u", other), (8, "u", other), (None, "u", "n"), (8, "u", other)]
    got = sorted(map(tuple, warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()), key=repr)
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    last = {big: 3, other: 8}
    expected = [(i, len((t or "").encode()), sha(t or ""), "revisit" if i and i < last.get(t, 0) else "response", last[t] if i and i < last.get(t, 0) else None) for i, _, t in rows]
    assert got == sorted(expected, key=repr)
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_ids_and_digests(spark, tmp_path):
    """Ids that aren't numbers come back; a payload that was changed in its archive is an error."""
    rows = [("a/b c:1", "u", "x" * 2000), ("z>é", "u", "x" * 2000), (None, "u", "")]
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    assert got == {"a/b c:1": ("revisit", "z>é"), "z>é": ("response", None), None: ("response", None)}
    forged = warc.chunks(spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string")).withColumn("data", F.lit(b"abd"))
    with pytest.raises(Exception, match="digest"):
        warc.read(spark, warc.write(forged, common.scratch(spark))).collect()


def test_warc_chunks(spark):
    pages = spark.createDataFrame([(1, "u", "ab" * 100_000)], "page_id long, url string, html string")
    manifest = warc.write(warc.chunks(pages, chunk_bytes=1000), common.scratch(spark))
    rows = sorted(warc.read(spark, manifest).collect(), key=lambda r: r.chunk)
    data = b"".join(bytes(r.data) for r in rows)
    assert data == b"ab" * 100_000 and len(rows) > 2 and max(len(r.data) for r in rows) <= warc.CHUNK_BYTES
    so_far = b""
    for r in rows:
        so_far += bytes(r.data)
        assert r.digest_so_far == hashlib.sha1(so_far).hexdigest() and r.bytes_so_far == len(so_far) and r.last == (len(so_far) == len(data))


# HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies. Accept all of them.</p></div>
<article><h1>Head&nbsp;line</h1><p>First &amp; long   paragraph of the
text, with <b>bold</b> words and <a href="x">a link</a>.<p>Second paragraph, unclosed.<div class="ad">Buy this now, it is cheap.</div><ul><li>An item of the article's list.</li></ul></article>
<aside><p>Related reading for you, dear visitor.</p></aside><section id="comments"><p>Nice article, I liked it much.</p></section><form><label>Name</label><input></form><footer>&copy; us</footer></body></html>"""


def test_html():
    assert html_text.main_text(PAGE).split("\n") == ["Head line", "First & long paragraph of the text, with bold words and a link.", "Second paragraph, unclosed.", "An item of the article's list."]
    soup = PAGE.replace("<article>", '<div id="content">').replace("</article>", "</div>")
    assert "Second paragraph, unclosed." in html_text.main_text(soup) and "cookies" not in html_text.main_text(soup)
    for odd in ("", "<", "<p", "a < b", "<!-- x", "<script>", '<a title="x', "<p>" * 3000 + "deep", "&#xZZ; &bogus; &#0;"):
        assert isinstance(html_text.main_text(odd), str)


TEXT = "<p>A paragraph of the text, long enough to be taken for one.</p><p>And.</p><p>Another paragraph, which goes on for a while, and ends.</p>"


@pytest.mark.parametrize(
    "page",
    [
        f'<body class="home with-sidebar"><article>{TEXT}</article></body>',
        f'<html class="js no-cookies"><body><div class="layout has-sidebar"><main>{TEXT}</main><div class="sidebar"><p>Buy our things, they are very cheap now.</p></div></div></body></html>',
        f'<body><form id="aspnet"><div>{TEXT}</div></form><div class="footer">Foot</div></body>',
        f"<body><script src=/js/>var leak = 1;</script><article>{TEXT}</article></body>",
        f"<body><script src=/js/ /><article>{TEXT}</article></body>",
        f'<body><div id="content">{TEXT}</div><section id="comments"><article class="comment"><p>Nice article, I liked it much, thank you for all of it.</p></article></section></body>',
        f'<nav><ul><li><a href="a">One</a><li><a href="b">Two, and a longer one of several words</a><li>Three</ul></nav><div>{TEXT}</div>',
    ],
)
def test_html_layouts(page):
    assert html_text.main_text(page) == "A paragraph of the text, long enough to be taken for one.\nAnd.\nAnother paragraph, which goes on for a while, and ends."


def test_html_math():
    assert html_text.main_text("<p>It holds that <math><mi>x</mi><mo>=</mo><mn>1</mn></math> in this case, as we know.</p>") == "It holds that x=1 in this case, as we know."


def cut_cost(labels, gain, edges):
    return sum(max(g, 0) if not x else max(-g, 0) for g, x in zip(gain, labels)) + sum(c for a, b, c in edges if labels[a] != labels[b])


def test_html_labels_are_the_cheapest():
    """Of all labellings of small pages the cut's costs least, and on many it isn't the one by single blocks."""
    rng = random.Random(19)
    bits = ["<p>Of.</p>", "<p>A longer text, with a comma, and words of all kinds in it.</p>", '<p><a href="x">Read more</a></p>', "<li>Item</li>", "<h2>Head</h2>", '<div class="ad"><p>Buy it now, for it is cheap.</p></div>', "<div>", "</div>", "<ul>", "</ul>", "<p>Two words</p>", "<article>", "</article>", "<footer>End.</footer>"]
    changed = 0
    for _ in range(300):
        page = "".join(rng.choice(bits) for _ in range(rng.randint(3, 14)))
        blocks, gain, edges = html_text.graph(page)
        if len(blocks) > 10:
            continue
        found = html_text.min_cut(gain, edges)
        assert cut_cost(found, gain, edges) == min(cut_cost([m >> i & 1 for i in range(len(gain))], gain, edges) for m in range(1 << len(gain)))
        assert html_text.main_text(page) == "\n".join(b.text for b, x in zip(blocks, found) if x)
        changed += any(x != (g > 0) for x, g in zip(found, gain))
    assert changed > 20


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the given tables")
@pytest.mark.parametrize("box", ["article", "div"])
def test_html_keeps_what_stands_between_links(box):
    """Paragraphs between blocks of links, verse, lists and cells, in a marked article and in a page without marks."""
    lines = [f"This is a paragraph of twenty words, which stands between two blocks of links, and all of it is wanted {i}." for i in range(4)]
    body = "".join(f"<p>{x}</p><p><a href=x>Read also: another page of ours</a></p>" for x in lines)
    assert html_text.main_text(f"<html><body><{box}>{body}</{box}></body></html>") == "\n".join(lines)
    verse = ["A title", "roses are red", "violets are blue", "sugar is sweet"]
    assert html_text.main_text(f"<html><body><{box}><h1>{verse[0]}</h1>{''.join(f'<p>{v}</p>' for v in verse[1:])}</{box}></body></html>") == "\n".join(verse)
    nav, foot = "<nav><ul><li><a href=1>Home</a></li><li><a href=2>About us</a></li></ul></nav>", "<footer>© 2020 The owners</footer>"
    page = f"<html><body>{nav}<{box}><h2>Things</h2><p>{lines[0]}</p><ul><li>one</li><li>two</li></ul><table><tr><td>1</td><td>2</td></tr></table></{box}>{foot}</body></html>"
    assert html_text.main_text(page) == "\n".join(["Things", lines[0], "one", "two", "1", "2"])


def test_html_cuts_of_many_blocks():
    """Against all labellings of small graphs, and 100,000 alternating blocks in seconds."""
    import itertools
    import time

    rng = random.Random(11)
    for _ in range(150):
        n = rng.randint(1, 8)
        gain = [rng.randint(-9, 9) for _ in range(n)]
        edges = [(*rng.sample(range(n), 2), rng.randint(0, 6)) for _ in range(rng.randint(0, 12))] if n > 1 else []
        cost = lambda x: sum(-g if g < 0 and y else g if g > 0 and not y else 0 for g, y in zip(gain, x, strict=True)) + sum(c for a, b, c in edges if x[a] != x[b])  # noqa: B023, E731
        assert cost(html_text.min_cut(gain, edges)) == min(map(cost, itertools.product([False, True], repeat=n)))
    n, began = 100_000, time.time()
    html_text.min_cut([30, -30] * (n // 2), [(i, i + 1, 20) for i in range(n - 1)])
    assert time.time() - began < 30


def test_html_of_the_given_pages(spark):
    """Whole pages against the paragraphs of their article, found by plain splitting; the cut matters on some."""
    differ = 0
    pages = common.table(spark, "/root/testdata/sf0.01", "pages").select("html").collect()
    for r in pages:
        article = r.html.split("<article>")[1].split("</article>")[0]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x)))).strip() for x in re.split("</?(?:p|h1)>", article)]
        assert html_text.main_text(r.html) == "\n".join(x for x in parts if x)
        _, gain, edges = html_text.graph(r.html)
        differ += any(x != (g > 0) for x, g in zip(html_text.min_cut(gain, edges), gain))
    assert differ > 10


def test_html_of_a_very_long_page():
    page = "<nav><a href=x>Menu</a></nav><article>" + TEXT * 2000 + "</article>"
    assert html_text.main_text(page).count("\n") == 5999


def test_minimum_cut():
    rng = random.Random(14)
    for _ in range(60):
        n = rng.randint(1, 7)
        gain = [rng.randint(-20, 20) for _ in range(n)]
        edges = [(a, b, rng.randint(1, 15)) for a in range(n) for b in range(a) if rng.random() < 0.5]

        least = min(cut_cost([m >> i & 1 for i in range(n)], gain, edges) for m in range(1 << n))
        assert cut_cost(html_text.min_cut(gain, edges), gain, edges) == least


def test_html_edges(spark):
    rows = [(None, None, None, 1), (1, "u", "", 2), (2, "u", PAGE, 3), (2, "u", PAGE, 3)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got) and sum(r.n_chars > 0 for r in got) == 2
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# Secrets


def slow_base(text):
    found = []
    for rank, (kind, pattern, group, least) in enumerate((("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32))):
        for m in re.finditer(pattern, text, re.I if rank == 0 else 0):
            if len(m[group]) >= least:
                found.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [x for _, _, x in sorted(found)]


def entropy(window):
    n = len(window)
    return -sum(c / n * np.log2(c / n) for c in map(window.count, set(window)))


def test_scratch_needs_a_shared_folder(monkeypatch):
    class Session:
        conf, sparkContext = {}, type("C", (), {"master": "spark://host:7077", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.scratch(type("S", (), {"conf": type("D", (), {"get": staticmethod(lambda k, d=None: d)}), "sparkContext": Session.sparkContext}))


def test_secrets(spark):
    rng = random.Random(15)
    bits = ["token", "=", ": ", "PassWord", '"', "abc", "AKIA", "ABCDEFGH1234", "é漢", "api_key", "secret:", "0a1b2c3d" * 4, "0a1b2c3d", " ", "\n", "x=y", "Zq8", "deadbeef" * 5]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(200)] + ["token=secret:abcdefgh"]
    got = {r.doc_id: r for r in secrets.report(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        base = slow_base(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [x for x in got[i].spans.split(",") if x and not x.startswith("entropy")] == base
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex"))


def test_secret_entropy(spark):
    runs = ["Zq8Rt5Yw2Lm9Kp4Xv7Bn3Jh6", "aaaaaaaaaaaaaaaaaaaa1111", "abcdefghij0123456789abcd", "4f9A0c7E2d8B1a6C5e3f90", "a1a1a1a1a1a1a1a1a1a1a1a1", "ZqRtYwLmKpXvBnJhGfDsAzQx", "123e4567-e89b-12d3-a456-426614174000"]
    row = spark.createDataFrame([(r,) for r in runs], "t string").select("t", secrets.best_entropy(F.col("t")).alias("h")).collect()
    for r in row:
        assert r.h == pytest.approx(max(entropy(r.t[i : i + secrets.WINDOW]) for i in range(len(r.t) - secrets.WINDOW + 1)), abs=1e-9)
    got = [r.spans for r in secrets.report(spark.createDataFrame([(i, f"see {r} there") for i, r in enumerate(runs)], "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["entropy-base64:4:28", "", "", "entropy-hex:4:26", "", "", ""]


def test_secret_edges(spark):
    assert secrets.report(spark.createDataFrame(EDGE, EDGE_SCHEMA)).count() == len(EDGE)
    assert secrets.report(spark.createDataFrame([], EDGE_SCHEMA)).count() == 0
    named = spark.createDataFrame([(1, "password = abcdefgh1", 2, 3, 4)], "doc_id long, text string, __base int, __RUNS int, __spans int")
    assert secrets.redact(named).first().asDict() == {"doc_id": 1, "text": "[SECRET]", "__base": 2, "__RUNS": 3, "__spans": 4}
    long = secrets.report(spark.createDataFrame([(1, "word " * 400_000 + "secret=abcdefgh9")], "doc_id long, text string")).first()
    assert long.spans == "assign:2000000:2000016"
    rows = spark.createDataFrame([(1, "é password = abcdefgh1 and deadbeef" + "0a" * 16 + "!"), (2, None), (3, "clean")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in secrets.redact(rows).collect()} == {1: "é [SECRET] and [SECRET]!", 2: None, 3: "clean"}


def test_huge_texts_without_spaces_are_spliced(monkeypatch):
    """Lines only, scripts without spaces, contractions and special strings: the library's ids, and no call of more than a few chunks."""
    enc = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(12)
    special = [t for t in ("<|endoftext|>",) if enc.special.fullmatch(t)] or [""]
    line = lambda abc, n: "".join(rng.choice(abc) for _ in range(n))
    cjk = [chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(300)] + list("のはをがカタ")
    cases = [
        "\n".join(line("abcdefg", rng.randint(1, 90)) for _ in range(600)), "".join(line(cjk, rng.randint(1, 60)) + rng.choice("、。，\n") for _ in range(600)),
        "".join(rng.choice(["don't", "'s", "12", "x", "--", "\t", "é", "…", "'", *special]) for _ in range(9000)), "".join(rng.choice(["a", "1", "<|endof", "text|>", *special]) for _ in range(9000)),
    ]
    for text in cases:
        whole, sizes = enc.encode(text), []
        plain = enc.encode_offsets
        monkeypatch.setattr(enc, "encode_offsets", lambda t: (sizes.append(len(t)), plain(t))[1])
        assert np.array_equal(enc.encode_spliced(text, 1000, 64), whole)
        monkeypatch.setattr(enc, "encode_offsets", plain)
        assert len(text) > 15_000 and max(sizes) <= 2500
