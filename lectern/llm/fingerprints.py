"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph's digest goes into three cells, each with a count, an XOR of digests and an XOR of check
values. The sketches of two versions subtract cell by cell; peeling cells that hold one digest alone
recovers the digests that only one version has. A fingerprint is a sketch with so many cells that it peels
by itself, so a large sketch folds down to the size of a small one, and where their difference doesn't peel,
the small one's digests, peeled, fill a larger sketch and the two are subtracted again. Two fingerprints are thus
all that a comparison needs. Paragraphs are lines; lines of more than a few words are parted at sentence
ends and then by words, so that an edit changes the digests near it only.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import common

#: Cells of a third of the smallest sketch; all thirds are powers of two, so that sketches fold.
LEAST_THIRD = 16
#: Doublings after which a sketch that doesn't peel is an error: its digests would need the same three cells among millions.
MOST_TRIES = 12
UNIT_CHARS, UNIT_WORDS = 240, 12
#: Documents, and code points of them and their followers, whose sketches are made together.
PEELED, PEELED_CHARS = 256, 1 << 20

_CELL = np.dtype([("count", "<i4"), ("digest", "<u8"), ("check", "<u4")])


def paragraph_digests(text: str) -> np.ndarray:
    """Distinct 64-bit digests; the k-th copy of a paragraph has a digest of its own."""
    units = []
    for unit in text.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n").split("\n"):
        if len(unit) > UNIT_CHARS:
            words = unit.split(" ")
            units += [" ".join(words[i : i + UNIT_WORDS]) for i in range(0, len(words), UNIT_WORDS)]
        elif unit:
            units.append(unit)
    digest = xxhash.xxh3_64_intdigest
    if len(set(units)) == len(units):
        return np.unique(np.asarray([digest(u) for u in units], np.uint64))
    seen: Counter = Counter()
    out = []
    for u in units:
        out.append(digest(f"{u}\n{seen[u]}") if seen[u] else digest(u))
        seen[u] += 1
    return np.unique(np.asarray(out, np.uint64))


def _check(d: np.ndarray) -> np.ndarray:
    h = (d ^ (d >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(32)).astype(np.uint32)


class Sketches:
    """Sketches of many sets side by side: set k has three times third[k] cells from base[k]."""

    def __init__(self, third: np.ndarray):
        self.third = np.asarray(third, np.int64)
        self.base = np.concatenate([[0], np.cumsum(3 * self.third)])
        n = int(self.base[-1])
        self.count, self.digest, self.check = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint32)

    @classmethod
    def of(cls, sets: list[np.ndarray], third: np.ndarray) -> Sketches:
        out = cls(third)
        out.put(np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(sets)), [len(x) for x in sets]), 1)
        return out

    def put(self, d: np.ndarray, of: np.ndarray, sign) -> None:
        """Add digests to their sets, or take them out with sign -1: one cell in each third of the set's cells."""
        third, base, check = self.third[of], self.base[of], _check(d)
        for i, k in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)):
            at = base + third * i + ((d * np.uint64(k) >> np.uint64(33)) & (third.astype(np.uint64) - np.uint64(1))).astype(np.int64)
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.digest, at, d)
            np.bitwise_xor.at(self.check, at, check)

    def subtract(self, other: Sketches) -> None:
        self.count -= other.count
        self.digest ^= other.digest
        self.check ^= other.check

    def take(self, which: np.ndarray, third: np.ndarray) -> Sketches:
        """Some of the sketches, folded to thirds that are as large or smaller."""
        out = Sketches(third)
        width = 3 * self.third[which]
        of = np.repeat(np.arange(len(which)), width)
        at = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
        own = self.third[which][of]
        to = out.base[of] + (at // own) * out.third[of] + (at % own & (out.third[of] - 1))
        at += self.base[which][of]
        np.add.at(out.count, to, self.count[at])
        np.bitwise_xor.at(out.digest, to, self.digest[at])
        np.bitwise_xor.at(out.check, to, self.check[at])
        return out

    def sizes(self) -> np.ndarray:
        """How many digests each set has."""
        return np.add.reduceat(np.append(self.count, 0), self.base[:-1]) // 3 if len(self.third) else np.zeros(0, np.int64)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Set, digest and sign of what differs, and whether all of a set's difference came out. The sketches are used up."""
        found: list[list[np.ndarray]] = [[], [], []]
        width = np.diff(self.base)
        owner = np.repeat(np.arange(len(width)), width)
        at = np.flatnonzero(np.abs(self.count) == 1)
        while len(at):
            at = at[self.check[at] == _check(self.digest[at])]
            d, of, sign = self.digest[at], owner[at], self.count[at]
            order = np.lexsort((d, of))
            d, of, sign = d[order], of[order], sign[order]
            keep = np.append(True, (d[1:] != d[:-1]) | (of[1:] != of[:-1]))[: len(d)]
            d, of, sign = d[keep], of[keep], sign[keep]
            for x, y in zip(found, (of, d, sign), strict=True):
                x.append(y)
            self.put(d, of, -sign)
            at = np.flatnonzero(np.abs(self.count) == 1) if len(d) else d
        left = (self.count != 0) | (self.digest != 0)
        whole = np.bincount(owner[left], minlength=len(width)) == 0
        return (*(np.concatenate([*x, np.zeros(0, t)]) for x, t in zip(found, (np.int64, np.uint64, np.int64), strict=True)), whole)


def _third_for(n: np.ndarray) -> np.ndarray:
    """The least power of two that gives n digests half as many cells again."""
    return np.maximum(LEAST_THIRD, 1 << np.ceil(np.log2(np.maximum(n, 2) / 2)).astype(np.int64))


def sketched(sets: list[np.ndarray]) -> Sketches:
    """A sketch of each set that peels by itself; equal sets have equal sketches."""
    third = _third_for(np.asarray([len(x) for x in sets], np.int64))
    for _ in range(MOST_TRIES):
        s = Sketches.of(sets, third)
        *_, whole = s.take(np.arange(len(sets)), third).peel()
        if whole.all():
            return s
        third = np.where(whole, third, 2 * third)
    raise ValueError("digests share all their cells in every size")


def differences(ours: Sketches, theirs: Sketches) -> tuple[np.ndarray, np.ndarray]:
    """How many digests only ours and only theirs has, for each pair of sketches, by subtraction and peeling, in larger ones where that fails."""
    n = len(ours.third)
    more, less = np.zeros(n, np.int64), np.zeros(n, np.int64)
    third = np.minimum(ours.third, theirs.third)
    todo = np.arange(n)
    for tries in range(MOST_TRIES):
        if tries == 0:
            a, b = ours.take(todo, third), theirs.take(todo, third)
        else:
            a, b = (_refilled(s.take(todo, s.third[todo]), third[todo]) for s in (ours, theirs))
        a.subtract(b)
        of, _, sign, whole = a.peel()
        for out, part in ((more, sign > 0), (less, sign < 0)):
            out[todo[whole]] = np.bincount(of[part], minlength=len(todo))[whole]
        todo = todo[~whole]
        if not len(todo):
            return more, less
        # Room for all digests of both, then more.
        third[todo] = np.maximum(2 * third[todo], _third_for(ours.sizes()[todo] + theirs.sizes()[todo]))
    raise ValueError("digests share all their cells in every size")


def _refilled(s: Sketches, third: np.ndarray) -> Sketches:
    """Sketches of the same sets with other thirds: each set's digests are peeled out of its own sketch."""
    out = Sketches(third)
    of, d, _, _ = s.peel()
    out.put(d, of, 1)
    return out


def likeness(ours: Sketches, theirs: Sketches) -> list[float]:
    """Shared paragraphs over all paragraphs of each pair; 1 for two empty documents."""
    n = ours.sizes()
    more, less = differences(ours, theirs)
    return np.where(n + less > 0, (n - more) / np.maximum(n + less, 1), 1.0).tolist()


def to_text(s: Sketches) -> list[str]:
    """Each sketch as base64 of its cells."""
    out = np.empty(int(s.base[-1]), _CELL)
    out["count"], out["digest"], out["check"] = s.count, s.digest, s.check
    raw, size = out.tobytes(), _CELL.itemsize
    return [base64.b64encode(raw[a * size : b * size]).decode() for a, b in zip(s.base[:-1].tolist(), s.base[1:].tolist(), strict=True)]


def from_text(fingerprints: list[str]) -> Sketches:
    """The sketches of fingerprints."""
    raw = [base64.b64decode(x) for x in fingerprints]
    s = Sketches(np.asarray([len(x) // _CELL.itemsize // 3 for x in raw], np.int64))
    cells = np.frombuffer(b"".join(raw), _CELL)
    s.count, s.digest, s.check = cells["count"].astype(np.int64), cells["digest"].astype(np.uint64), cells["check"].astype(np.uint32)
    return s


def compare_fingerprints(ours: list[str], theirs: list[str]) -> list[float]:
    """Likeness of each pair of returned fingerprints, from the strings alone."""
    return likeness(from_text(ours), from_text(theirs))


def compare(texts: list[str], following: list[str]) -> list[tuple]:
    """n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each pair."""
    out = []
    size = np.cumsum([len(t) + len(f) for t, f in zip(texts, following, strict=True)])
    at = end = 0
    while end < len(texts):
        at, end = end, min(end + PEELED, max(end + 1, int(np.searchsorted(size, (size[end - 1] if end else 0) + PEELED_CHARS, "right"))))
        ours, after = texts[at:end], following[at:end]
        edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(ours, after, strict=True)]
        # A text's next is mostly the text after it in the list; each is sketched once.
        known = {id(t): t for t in [*ours, *after]}
        number = {k: i for i, k in enumerate(known)}
        s = sketched([paragraph_digests(t) for t in known.values()])
        first, second = (np.asarray([number[id(t)] for t in own], np.int64) for own in (ours, after))
        a, b, c = s.take(first, s.third[first]), sketched([paragraph_digests(t) for t in edited]), s.take(second, s.third[second])
        shas = [hashlib.sha256(t.encode()).hexdigest() for t in edited]
        out += zip(map(len, ours), shas, to_text(a), to_text(b), likeness(a, b), likeness(a, c), strict=True)
    return out


_OUT = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _bounds(rows: DataFrame, parts: int) -> list:
    """Ids that part the rows into about equal ranges, fewer than parts; they come from a shuffle of ids alone."""
    dealt = rows.filter("doc_id is not null").select("doc_id").repartitionByRange(parts, "doc_id")
    least = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("least")).collect()
    return sorted(r["least"] for r in least)[1:]


def _range_of(doc_id: Column, bounds: list, kind: str) -> Column:
    """How many bounds are up to the id, -1 for null: first among every so many of them, then among those between."""
    step = max(1, math.isqrt(len(bounds)))
    lists = [F.array(*[F.lit(b).cast(kind) for b in own]) if own else F.array().cast(f"array<{kind}>") for own in (bounds[step - 1 :: step], bounds)]
    upto = lambda c: F.size(F.filter(c, lambda b: b <= doc_id))
    coarse = upto(lists[0]) * step
    return F.when(doc_id.isNull(), -1).otherwise(coarse + upto(F.slice(lists[1], coarse + 1, F.lit(step))))


def compare_with_next(docs: DataFrame, *, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to that and to the next document.

    The next document is the next row by id, then by text; after the last comes the first. Null texts are
    empty; null ids come first; repeated rows are kept one by one; a single row is its own next; an empty table gives no rows.
    Further columns are left aside. The whole of every text is used, however long. Texts move once, to ranges of ids
    with fixed bounds; the last row of a range meets the first text of the next one apart.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    rows = common.id_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    parts = parts or common.shuffle_parts(spark)
    bounds = _bounds(rows, parts)

    ranged = rows.select(_range_of(F.col("doc_id"), bounds, kind).alias("range"), "doc_id", "text")
    dealt = ranged.repartitionByRange(parts, "range").sortWithinPartitions("range", "doc_id", "text")

    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def compared(pairs: list[tuple]) -> list[pa.Array]:
        return [pa.array(c, t) for c, t in zip(zip(*pairs, strict=True) if pairs else [()] * 6, types, strict=True)]

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every row that isn't the last of its range, with the row after it."""
        held = None
        for batch in (x for b in batches for x in common.slices(b)):
            ids, ranges, texts = batch["doc_id"], batch["range"].to_pylist(), common.texts(batch)
            if held is not None:
                ids, ranges, texts = pa.concat_arrays([held[0], ids]), [held[1], *ranges], [held[2], *texts]
            n = len(texts) - 1
            held = ids.slice(n), ranges[n], texts[n]
            same = [i for i in range(n) if ranges[i] == ranges[i + 1]]
            if same:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(same, pa.int32())), *compared(compare([texts[i] for i in same], [texts[i + 1] for i in same]))], names=["doc_id", *names])

    # One row a range. Its ends are found by ids alone; texts are read only of rows with such an id.
    both = F.struct("doc_id", "text")
    ids = ranged.groupBy("range").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).select(F.explode(F.array("a", "b")).alias("end")).distinct()
    ends = ranged.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("end")), "left_semi")  # two ids a range at most
    edges = common.saved(ends.groupBy("range").agg(F.min(both)["text"].alias("first_text"), F.max(both).alias("last")), f"{common.scratch(spark)}/edges")
    w = Window.orderBy("range")
    order = edges.select("range").select("range", F.coalesce(F.lead("range").over(w), F.first("range").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next"))
    following = edges.select(F.col("range").alias("next"), F.col("first_text").alias("following"))
    edges = edges.join(order, "range").join(following, "next").select("last.doc_id", F.col("last.text").alias("text"), "following")

    def finish(batch: pa.RecordBatch):
        for part in common.slices(batch):
            yield pa.RecordBatch.from_arrays([part["doc_id"], *compared(compare(common.texts(part), common.texts(part, "following")))], names=["doc_id", *names])

    schema = f"doc_id {kind}, {_OUT}"
    return dealt.mapInArrow(inner, schema).unionByName(common.map_batches(edges, finish, schema))
