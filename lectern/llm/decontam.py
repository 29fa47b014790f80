"""Benchmark decontamination by q-gram counts in diagonal bands and banded alignment.

Benchmark items are cut into overlapping fragments, long ones and, more densely, short ones. A place where a text holds a fragment with at most e
edits shares at least m + 1 - q - q * e of its m + 1 - q runs of q bytes, all on diagonals no further than e apart. So
shared runs are counted in overlapping bands of diagonals, only bands that reach that number are kept,
and each is verified by an alignment that stays in the band. Items too short for the lemma are found word by word, as they
are. Case, punctuation and white space don't count.
"""

from __future__ import annotations

import functools
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import common

Q = 10
FRAGMENT, STRIDE = 120, 60
#: Shorter fragments between them: a verbatim piece of an item holds one wherever it starts if it has PIECE + PIECE_STRIDE - 1 bytes.
PIECE, PIECE_STRIDE = 80, 8
#: Edits that a fragment may have, as a share of its length. Items of fewer bytes than LEAST have none.
EDITS, LEAST = 1 / 12, 2 * Q
#: Benchmark text of one index, which a worker builds from the shared folder and keeps; a larger benchmark is searched block by block.
BLOCK_BYTES = 1 << 19
#: Indexes that a worker keeps.
KEPT = 4
#: Bytes of normal text that are searched at once, and pairs of a place and a fragment's run that are held at once.
SEARCH_BYTES, POSTINGS = 1 << 20, 1 << 21

_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_SLOTS = 20
_FAR = 1 << 20


def normal(text: str) -> bytes:
    """Lower-case words with single spaces between them."""
    return b" ".join(text.lower().encode().translate(_PLAIN).split())


def _grams(buf: np.ndarray) -> np.ndarray:
    """A hash of the q bytes from each place."""
    n = len(buf) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    buf = np.ascontiguousarray(buf)
    head = np.ndarray((n,), "<u8", buf, strides=(1,))
    tail = np.ndarray((n,), "<u2", buf, 8, strides=(1,))
    h = head * np.uint64(0x9E3779B97F4A7C15) + tail * np.uint64(0xC2B2AE3D27D4EB4F)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


class Index:
    """Fragments of a block of the benchmark and where their q-grams are."""

    def __init__(self, items: list[str], texts: list[bytes]):
        self.of, self.fragments, short = [], [], defaultdict(list)
        for item, text in zip(items, texts, strict=True):
            if len(text) < LEAST:
                if text:
                    short[text].append(item)
                continue
            cuts = set()
            for size, stride in ((FRAGMENT, STRIDE), (PIECE, PIECE_STRIDE)):
                last = max(0, len(text) - size)
                cuts |= {(at, min(at + size, len(text))) for at in (*range(0, last + 1, stride), last)}
            for at, end in sorted(cuts):
                self.of.append(item)
                self.fragments.append(text[at:end])
        self.parts = Counter(self.of)
        #: Short items by length: their bytes, sorted, and the items.
        self.short: dict[int, tuple[np.ndarray, list[list[str]]]] = {}
        for n in sorted({len(t) for t in short}):
            own = sorted(t for t in short if len(t) == n)
            self.short[n] = np.asarray(own, f"S{n}"), [sorted(set(short[t])) for t in own]
        self.parts.update({i: 1 for _, own in self.short.values() for items_ in own for i in items_ if i not in self.parts})
        self.edits = np.asarray([int(len(f) * EDITS) for f in self.fragments], np.int64)
        self.need = np.asarray([max(1, len(f) + 1 - Q - Q * int(len(f) * EDITS)) for f in self.fragments], np.int64)
        self.width = int(self.edits.max(initial=0)) + 1
        code = [_grams(np.frombuffer(f, np.uint8)) for f in self.fragments]
        where = np.concatenate([np.arange(len(c), dtype=np.int32) for c in code] + [np.zeros(0, np.int32)])
        of = np.repeat(np.arange(len(code), dtype=np.int32), [len(c) for c in code])
        code = np.concatenate([*code, np.zeros(0, np.uint64)])
        order = np.argsort(code, kind="stable")
        self.codes, count = np.unique(code[order], return_counts=True)
        self.count, self.fragment, self.place = count, of[order], where[order]
        # Postings by gram and fragment, in order: those of some fragments are a run of each gram.
        self.posting = np.repeat(np.arange(len(count), dtype=np.int64) * max(1, len(self.fragments)), count) + self.fragment
        self.seen = np.zeros(1 << _SLOTS, bool)
        self.seen[(self.codes >> np.uint64(64 - _SLOTS)).astype(np.int64)] = True

    def search(self, texts: list[bytes]) -> list[tuple[int, str, int, int, int, int]]:
        """(text number, item, fragment number or -1, start, end, edits) of each verified place."""
        reach = FRAGMENT + 4 * self.width
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        part: list[tuple[int, int, bytes]] = []  # text number, where the segment starts in it, bytes
        size = 0

        def take() -> None:
            for s, f, a, z, e in self._search([x for _, _, x in part]):
                t, at = part[s][:2]
                if (t, f) not in found or e < found[t, f][2]:
                    found[t, f] = (a + at, z + at, e)
            part.clear()

        if self.fragments:
            for t, text in enumerate(texts):
                for at in range(0, max(1, len(text) - reach), SEARCH_BYTES):
                    # Segments of a long text overlap by more than any place can span.
                    segment = text[at : at + SEARCH_BYTES + reach]
                    if size + len(segment) > SEARCH_BYTES and part:
                        take()
                        size = 0
                    part.append((t, at, segment))
                    size += len(segment)
            take()
        out = [(t, self.of[f], f, *place) for (t, f), place in found.items()]
        return out + (self._search_short(texts) if self.short else [])

    def _search_short(self, texts: list[bytes]) -> list[tuple[int, str, int, int, int, int]]:
        """Whole words that are a short item."""
        out = []
        for t, text in enumerate(texts):
            if not text:
                continue
            buf = np.frombuffer(text, np.uint8)
            edge = np.concatenate([[True], buf == 32, [True]])  # whether a word may start at, or end before, this place
            starts = np.append(0, np.flatnonzero(buf == 32) + 1)
            for n, (own, items) in self.short.items():
                at = starts[starts + n <= len(buf)]
                at = at[edge[at + n + 1]]
                for i in range(0, len(at), 1 << 16):
                    words = np.ascontiguousarray(buf[at[i : i + (1 << 16), None] + np.arange(n)]).view(f"S{n}").ravel()
                    k = np.minimum(np.searchsorted(own, words), len(own) - 1)
                    for j in np.flatnonzero(own[k] == words).tolist():
                        out += [(t, item, -1, int(at[i + j]), int(at[i + j]) + n, 0) for item in items[int(k[j])]]
        return out

    def _search(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        buf = np.frombuffer(b"\n".join(texts), np.uint8)
        code = _grams(buf)
        at = np.flatnonzero(self.seen[code >> np.uint64(64 - _SLOTS)])
        code = code[at]
        k = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        known = self.codes[k] == code
        at, k = at[known], k[known]
        # A place needs several runs nearby: those that stand alone in twice a fragment's length are left out.
        least, reach = int(self.need.min()), FRAGMENT + self.width
        if len(at) < least:
            return []
        close = np.flatnonzero(at[least - 1 :] - at[: len(at) - least + 1] <= reach)
        change = np.zeros(len(at) + 1, np.int64)
        np.add.at(change, close, 1)
        np.add.at(change, close + least, -1)
        near = np.cumsum(change)[:-1] > 0
        at, k = at[near], k[near]
        heads = np.cumsum([0, *(len(t) + 1 for t in texts)])
        # Where many fragments share runs, they are taken in several lots; bands belong to one fragment, so lots are independent.
        lots = 1 + int(self.count[k].sum()) // POSTINGS
        cuts = np.linspace(0, len(self.fragments), lots + 1).astype(np.int64)
        out: dict[tuple[int, int], tuple[int, int, int, int, int]] = {}
        for f0, f1 in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            self._lot(texts, buf, heads, at, k, f0, f1, out)
        return list(out.values())

    def _lot(self, texts, buf, heads, at, k, f0: int, f1: int, out: dict) -> None:
        many = max(1, len(self.fragments))
        first = np.searchsorted(self.posting, k * many + f0)
        n = np.searchsorted(self.posting, k * many + f1) - first
        upto = np.cumsum(n)
        post = np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(first - upto + n, n)
        place, fragment = self.place[post].astype(np.int64), self.fragment[post].astype(np.int64)
        band = (np.repeat(at, n) - place + FRAGMENT) // self.width
        bands = (len(buf) + 2 * FRAGMENT) // self.width + 2
        # Band b has the diagonals from (b - 1) to (b + 1) widths, so every pair of near diagonals has a band in common.
        key = np.concatenate([fragment * bands + band, fragment * bands + band + 1])
        place = np.tile(place, 2)
        keys, which, counts = np.unique(key, return_inverse=True, return_counts=True)
        enough = (counts >= self.need[keys // bands])[which]
        # A run of the fragment counts once in a band, however often the text has it.
        key = np.unique(key[enough] * FRAGMENT + place[enough]) // FRAGMENT
        keys, counts = np.unique(key, return_counts=True)
        fragment, band = keys // bands, keys % bands
        good = counts >= self.need[fragment]
        for f, b in zip(fragment[good].tolist(), band[good].tolist(), strict=True):
            low, high = (b - 1) * self.width - FRAGMENT, (b + 1) * self.width - FRAGMENT
            m, e = len(self.fragments[f]), int(self.edits[f])
            # The band may reach over the end of a text into the next; each text is aligned on its own.
            t0, t1 = np.searchsorted(heads, [max(low - e, 0), min(high + m + e, len(buf) - 1)], "right") - 1
            for t in range(int(t0), int(t1) + 1):
                found = align(self.fragments[f], texts[t], e, low - e - int(heads[t]), high + e - int(heads[t]))
                if found and ((t, f) not in out or found[2] < out[t, f][4]):
                    out[t, f] = (t, f, *found)


def align(pattern: bytes, text: bytes, most: int, low: int, high: int) -> tuple[int, int, int] | None:
    """Start, end and edits of the best place of the pattern in the text, if it has at most so many edits.

    Only cells on the diagonals (place in the text less place in the pattern) from low to high are computed. Of places
    with equally few edits, the one that ends first counts.
    """
    low, high, n = max(low, -len(pattern)), min(high, len(text)), len(text)
    if low > high or n - max(low, 0) < len(pattern) - most:
        return None
    at = text.find(pattern, max(low, 0), min(high + len(pattern), n))
    if at >= 0:
        return at, at + len(pattern), 0
    p = np.frombuffer(pattern, np.uint8)
    # The text from where the band begins in it to where it ends; what lies beyond the text equals nothing.
    begin, end = low, high + len(p)
    t = np.full(end - begin, 256, np.int16)
    a, z = max(begin, 0), min(end, n)
    t[a - begin : z - begin] = np.frombuffer(text, np.uint8)[a:z]
    steps = np.arange(high - low + 1)
    column = low + steps  # of row 0
    row = np.where((column >= 0) & (column <= n), 0, _FAR)
    origin = column.copy()
    for i in range(len(p)):
        across = row + (t[i : i + len(steps)] != p[i])
        up, come_up = np.append(row[1:] + 1, _FAR), np.append(origin[1:], 0)
        take = across <= up
        new, come = np.where(take, across, up), np.where(take, origin, come_up)
        column += 1
        new[(column < 0) | (column > n)] = _FAR
        # Text bytes that are skipped: the least of new[j] + (k - j) over j up to k, and where it comes from.
        flat = new - steps
        best = np.minimum.accumulate(flat)
        source = np.maximum.accumulate(np.where(flat == best, steps, 0))
        row, origin = np.where((column < 0) | (column > n), _FAR, best + steps), come[source]
        if row.min() > most:
            return None
    k = int(row.argmin())
    return (int(origin[k]), int(column[k]), int(row[k])) if row[k] <= most else None


@functools.lru_cache(KEPT)
def _index(folder: str) -> Index:
    """The index of a block, built once in a worker from the shared folder."""
    fs, base = pafs.FileSystem.from_uri(folder)
    files = [f.path for f in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if f.path.endswith(".parquet")]
    rows = sorted((i, normal(t)) for f in files for i, t in zip(*pq.read_table(f, columns=["item", "text"], filesystem=fs, partitioning=None).to_pydict().values(), strict=True))
    return Index([i for i, _ in rows], [t for _, t in rows])


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[str]:
    """The benchmark in the shared folder, in blocks of about block_bytes; none of it comes to the driver but its size."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).filter("item is not null and text is not null")
    n = 1 + (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes
    where = f"{common.scratch(benchmark.sparkSession)}/benchmark"
    items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n))).repartition(n, "block").write.partitionBy("block").parquet(where)
    return [f"{where}/block={b}" for b in range(n)]


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, edits, fragments, of_fragments, start, end: each document and benchmark item of which it holds a fragment.

    Places are bytes of the normal form of the text; edits are those of the best fragment, start and end those of all that were
    found. Null and empty texts hold nothing; null items, null ids of items and items without a letter or digit can't be found;
    items of under LEAST bytes are found as they are, at whole words. Rows of equal ids give a row each per item; null ids are kept;
    further columns are left aside; empty tables give no rows. A very long text is searched in overlapping segments.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    rows = common.id_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id string, edits int, fragments int, of_fragments int, start int, end int"

    def searched(folder: str) -> DataFrame:
        def run(batch: pa.RecordBatch):
            ix, found = _index(folder), {}
            for t, item, _, a, z, e in ix.search([normal(t) for t in common.texts(batch)]):
                old = found.get((t, item))
                found[t, item] = (min(e, old[0]), old[1] + 1, min(a, old[2]), max(z, old[3])) if old else (e, 1, a, z)
            keys = sorted(found)
            cols = [pa.array([found[k][c] for k in keys], pa.int32()) for c in range(4)]
            of = pa.array([ix.parts[i] for _, i in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array([t for t, _ in keys], pa.int32())), pa.array([i for _, i in keys], pa.string()), cols[0], cols[1], of, cols[2], cols[3]], names=["doc_id", "item_id", "edits", "fragments", "of_fragments", "start", "end"])

        return common.map_batches(rows, run, schema)

    first, *rest = [searched(folder) for folder in _blocks(benchmark, item_col, item_text_col, block_bytes)]
    for more in rest:
        first = first.unionByName(more)
    return first.withColumn("item_id", F.col("item_id").cast(benchmark.schema[item_col].dataType))


def with_items(docs: DataFrame, benchmark: DataFrame, *, out: str = "leaked_items", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with the sorted ids of the benchmark items of which each text holds a fragment; nothing is shuffled.

    A worker searches for a few blocks of the benchmark at once; where there are more, docs are written to the shared folder in between.
    All rows, repeated ones too, and all columns stay, but for one named ``out``; null and empty texts have an empty array. Items are found as by :func:`leaks`.
    """
    spark = docs.sparkSession
    common.small_batches(spark)

    def holder(folder: str) -> Column:
        @F.pandas_udf("array<string>")
        def held(text: pd.Series) -> pd.Series:
            items = [set() for _ in text]
            for t, item, *_ in _index(folder).search([normal(x or "") for x in text]):
                items[t].add(item)
            return pd.Series([sorted(x) for x in items])

        return held(F.col(text_col))

    folders, kind, columns = _blocks(benchmark, item_col, item_text_col, block_bytes), benchmark.schema[item_col].dataType.simpleString(), docs.columns
    so_far = common.free_name(docs, "found")
    docs = docs.withColumn(so_far, F.array().cast("array<string>"))
    for i in range(0, len(folders), KEPT):
        if i:
            docs = common.saved(docs, f"{common.scratch(spark)}/searched")
        docs = docs.withColumn(so_far, F.concat(so_far, *[holder(folder) for folder in folders[i : i + KEPT]]))
    found = F.array_sort(F.array_distinct(F.col(so_far)).cast(f"array<{kind}>"))
    return docs.withColumn(out, found).select(*[c for c in columns if c.lower() != out.lower()], out)
