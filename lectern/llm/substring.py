"""Exact removal of word passages that an earlier document has, behind a count-min prefilter.

Every window of ``window`` words is named by the least hash among the shorter word runs inside it, so
equal windows have equal names wherever they stand and neighbouring windows mostly share theirs. Each
partition counts the names of its documents in a count-min sketch; the sketches are merged by adding their counters, and the
estimate of a name, the least of its counters, is never less than the number of documents that have it. A second pass takes only
windows whose name is estimated to be in two documents or more, and groups those exactly, by 128-bit digests of their words: runs of windows with one name as a
whole, and window by window where runs of one name differ. A sketch that is too small for the
corpus lets more windows through to the exact grouping; it never loses one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import common

WINDOW = 50
#: Counters of each of the two sketch rows: 256 for a document, within these bounds. Only whether a counter reaches two is kept after the merge: 128 MB a row at most.
CELLS_PER_ROW, LEAST_CELLS, MOST_CELLS = 256, 1 << 20, 1 << 30
BLOCKS = 64

_RNG = np.random.default_rng(11)
_MIX = _RNG.integers(1, 1 << 63, 4096, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of a batch of texts, and the name of each window."""

    def __init__(self, texts: list[str], window: int):
        self.lines = [b" ".join(t.encode().split()) for t in texts]
        buf = np.frombuffer(b"\n".join(self.lines), np.uint8)
        self.first = np.cumsum([0, *(len(x) + 1 for x in self.lines)])[:-1]  # where each line begins
        cut = (buf == 32) | (buf == 10)
        self.starts = np.concatenate([[0], np.flatnonzero(cut) + 1]) if len(buf) else np.zeros(0, np.int64)
        self.ends = np.append(self.starts[1:] - 1, len(buf)) if len(buf) else self.starts
        # An empty line has one empty word in this count; it's too short for a window, so it does no harm.
        self.doc = np.searchsorted(self.first, self.starts, "right") - 1
        self.word0 = np.searchsorted(self.starts, self.first)
        self.at, self.name = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        n, run = len(self.starts), (window + 1) // 2
        if n < window:
            return
        place = (np.arange(len(buf), dtype=np.int32) - np.repeat(self.starts.astype(np.int32), np.diff(np.append(self.starts, len(buf))))) % len(_MIX)
        value = (buf + np.uint64(1)) * _MIX[place]
        value[cut] = 0
        h = _stir(np.add.reduceat(np.append(value, np.uint64(0)), self.starts))  # an empty last line starts after the end
        power = np.cumprod(np.full(n, _STEP, np.uint64))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power)])
        least = _stir((total[run:] - total[:-run]) * np.cumprod(np.full(n - run + 1, _BACK, np.uint64)))
        wide, have = window - run + 1, 1  # the least of so many runs, by doubling
        while have < wide:
            step = min(have, wide - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        whole = self.doc[: n - window + 1] == self.doc[window - 1 :]
        self.at, self.name = np.flatnonzero(whole), least[whole]


def _cells(name: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(cells - 1)
    return name & mask, (name >> np.uint64(32) ^ name * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(17)) & mask


def sketch(docs: DataFrame, *, window: int, cells: int) -> bytes:
    """For each of two rows, one bit a counter: whether it is two or more.

    Partitions give the counters that they have, block by block; the counters of a block are added up by one task.
    What comes to the driver is cells / 4 bytes, whatever the input.
    """
    block = cells // BLOCKS

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [[], []]
        for batch in (x for b in batches for x in common.slices(b)):
            w = Words(common.texts(batch), window)
            changes = np.append(True, (w.name[1:] != w.name[:-1]) | (w.doc[w.at[1:]] != w.doc[w.at[:-1]]))[: len(w.name)]
            name, doc = w.name[changes], w.doc[w.at[changes]]
            order = np.lexsort((name, doc))
            name, doc = name[order], doc[order]
            name = name[np.append(True, (name[1:] != name[:-1]) | (doc[1:] != doc[:-1]))[: len(name)]]  # once a document
            for row, c in enumerate(_cells(name, cells)):
                found[row].append(c.astype(np.uint32))
        for row in range(2):
            c, n = np.unique(np.concatenate([*found[row], np.zeros(0, np.uint32)]), return_counts=True)
            at = np.searchsorted(c, np.arange(BLOCKS + 1, dtype=np.int64) * block)
            own = [(c[at[b] : at[b + 1]] - np.uint32(b * block), np.minimum(n[at[b] : at[b + 1]], 255).astype(np.uint8)) for b in range(BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.array([row] * BLOCKS, pa.int32()), pa.array(range(BLOCKS), pa.int32()), *(pa.array([x[i].tobytes() for x in own], pa.binary()) for i in range(2))], names=["row", "block", "at", "n"])

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(block, np.uint16)  # full ones stay full
        for batch in batches:
            for at, n in zip(batch["at"].to_pylist(), batch["n"].to_pylist(), strict=True):
                c = np.frombuffer(at, np.uint32)
                counters[c] = np.minimum(counters[c] + np.frombuffer(n, np.uint8).astype(np.uint16), 255)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([np.packbits(counters > 1).tobytes()], pa.binary())], names=["row", "block", "bits"])

    merged = docs.mapInArrow(part, "row int, block int, at binary, n binary").groupBy("row", "block").applyInArrow(merge, "row int, block int, bits binary")
    bits = {(r["row"], r["block"]): bytes(r["bits"]) for r in merged.collect()}
    return b"".join(bits.get((row, b), bytes(block // 8)) for row in range(2) for b in range(BLOCKS))


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, cells: int | None = None, keep_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and with keep_text the kept words joined by spaces.

    A word goes if a window over it also starts in a document of a smaller id. Null and empty texts have
    no words; rows with a null id keep all words and take none from others; rows of equal ids take
    nothing from each other; further columns are left aside; an empty table gives no rows. A very long text is worked on
    whole, in one task.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    where = common.scratch(spark)
    rows = common.id_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    if cells is None:
        cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << int(np.ceil(np.log2(CELLS_PER_ROW * max(rows.count(), 1))))))
    bits = spark.sparkContext.broadcast(sketch(rows.filter("doc_id is not null").select("text"), window=window, cells=cells))

    def judge(whole: pa.RecordBatch):
        for batch in common.slices(whole):
            yield judged_slice(batch)

    def judged_slice(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(common.texts(batch), window)
        table = np.frombuffer(bits.value, np.uint8)
        maybe = np.ones(len(w.name), bool)
        for row, c in enumerate(_cells(w.name, cells)):
            maybe &= (table[row * (cells // 8) + (c >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (c & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
        at, name = w.at[maybe], w.name[maybe]
        doc = w.doc[at]
        begins = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (name[1:] != name[:-1]) | (doc[1:] != doc[:-1]))[: len(at)])
        count = np.diff(np.append(begins, len(at)))
        at, name, doc = at[begins], name[begins], doc[begins]
        buf = memoryview(b"\n".join(w.lines))
        digests = [xxhash.xxh3_128_digest(buf[a:b]) for a, b in zip(w.starts[at].tolist(), w.ends[at + count + window - 2].tolist(), strict=True)]
        cut = np.searchsorted(doc, np.arange(len(w.lines) + 1))
        some = (np.diff(cut) > 0).tolist()
        runs = pa.StructArray.from_arrays([pa.array(name.view(np.int64)), pa.array(digests, pa.binary()), pa.array((at - w.word0[doc]).astype(np.int32)), pa.array(count.astype(np.int32))], names=["name", "digest", "at", "n"])
        return pa.RecordBatch.from_arrays(
            [
                batch["doc_id"], batch["row"], pa.array([x.count(b" ") + 1 if x else 0 for x in w.lines], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in w.lines]),
                pa.array([x.decode() if s or keep_text else None for x, s in zip(w.lines, some, strict=True)], pa.string()),
                pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), runs),
            ],
            names=["doc_id", "row", "n_words", "sha256", "line", "runs"],
        )

    judged = common.saved(
        common.map_batches(rows.select("doc_id", F.monotonically_increasing_id().alias("row"), "text"), judge, f"doc_id {kind}, row bigint, n_words bigint, sha256 string, line string, runs array<struct<name:bigint,digest:binary,at:int,n:int>>"),
        f"{where}/judged",
    )
    # Inside a repeated passage, the windows of one name make the same run in every document: runs are grouped whole.
    runs = judged.filter("doc_id is not null").select("doc_id", "row", F.explode("runs").alias("r")).select("doc_id", "row", "r.name", "r.digest", "r.at", F.col("r.n").alias("r_n"))
    first = common.saved(runs.groupBy("name", "digest").agg(F.min("doc_id").alias("earliest"), F.count("*").alias("n")), f"{where}/first")
    # Only a name with different runs, as at the edges of a passage, needs its windows one by one, and of each run every place in its earliest document.
    mixed = first.groupBy("name").agg(F.count("*").alias("n"), F.min("earliest").alias("least"), F.max("earliest").alias("most")).filter("n > 1 and least < most").select("name", "n", F.lit(True).alias("mixed"))
    known = common.join_split(first.withColumnRenamed("n", "runs"), common.saved(mixed, f"{where}/mixed"), ["name"], "left").withColumnRenamed("runs", "n")
    # A run that one document alone has, and that isn't mixed, decides nothing.
    known = common.saved(known.filter("n > 1 or mixed"), f"{where}/known")
    places = common.join_split(runs, known, ["name", "digest"]).filter("doc_id > earliest or mixed and doc_id = earliest").select("row", "at", F.col("r_n").alias("n"), F.expr("doc_id > earliest").alias("later"))
    places = common.saved(places, f"{where}/places")
    whole = places.filter("later").select("row", "at", "n")
    parts = places.filter("not later").groupBy("row").agg(F.collect_list(F.struct("at", "n")).alias("parts"))

    def windows(batch: pa.RecordBatch):
        doc, row, digest, at = [], [], [], []
        for i, (line, parts) in enumerate(zip(batch["line"].to_pylist(), batch["parts"].to_pylist(), strict=True)):
            raw = line.encode()
            buf, gaps = memoryview(raw), np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
            starts, ends = np.append(0, gaps + 1), np.append(gaps, len(raw))
            places = sorted({p["at"] + k for p in parts for k in range(p["n"])})
            digest += [xxhash.xxh3_128_digest(buf[a:b]) for a, b in zip(starts[places].tolist(), ends[np.asarray(places) + window - 1].tolist(), strict=True)]
            at += places
            doc += [i] * len(places)
        take = pa.array(doc, pa.int32())
        yield pa.RecordBatch.from_arrays([batch["doc_id"].take(take), batch["row"].take(take), pa.array(digest, pa.binary()), pa.array(at, pa.int32())], names=["doc_id", "row", "digest", "at"])

    lines = judged.filter(F.size("runs") > 0).select("doc_id", "row", "n_words", "sha256", "line")
    single = common.map_batches(lines.select("doc_id", "row", "line").join(parts, "row").select("doc_id", "row", "line", "parts"), windows, f"doc_id {kind}, row bigint, digest binary, at int")
    single = common.saved(single, f"{where}/windows")
    earliest = single.groupBy("digest").agg(F.min("doc_id").alias("earliest"), F.max("doc_id").alias("latest"), F.count("*").alias("n")).filter("earliest < latest").select("digest", "n", "earliest")
    alone = common.join_split(single, common.saved(earliest, f"{where}/earliest"), ["digest"]).filter("doc_id > earliest").select("row", "at", F.lit(1).alias("n"))
    covered = whole.unionByName(alone).groupBy("row").agg(F.collect_list(F.struct("at", "n")).alias("covered"))

    def strip(batch: pa.RecordBatch):
        n_removed, sha, kept_lines = [], [], []
        for line, starts in zip(batch["line"].to_pylist(), batch["covered"].to_pylist(), strict=True):
            words = line.split(" ") if line else []
            change = np.zeros(len(words) + 1, np.int64)
            at, n = (np.asarray([x[k] for x in starts], np.int64) for k in ("at", "n"))
            np.add.at(change, at, 1)
            np.add.at(change, at + n + window - 1, -1)
            gone = np.cumsum(change)[:-1] > 0
            kept = " ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
            n_removed.append(int(gone.sum()))
            sha.append(hashlib.sha256(kept.encode()).hexdigest())
            kept_lines.append(kept)
        columns = [batch["doc_id"], batch["n_words"], pa.array(n_removed, pa.int64()), pa.array(sha)]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(kept_lines)] if keep_text else columns, names=[*names, "kept_text"] if keep_text else names)

    text = ", kept_text string" if keep_text else ""
    marked = lines.join(covered, "row", "left")
    stripped = common.map_batches(marked.filter("covered is not null").select("doc_id", "n_words", "line", "covered"), strip, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string{text}")
    columns = ["doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha256").alias("kept_sha256"), *([F.col("line").alias("kept_text")] if keep_text else [])]
    return stripped.unionByName(marked.filter("covered is null").select(columns)).unionByName(judged.filter(F.size("runs") == 0).select(columns))
