"""MinHash near duplicates with sequential Bayesian verification.

A text is the set of its distinct word shingles; equal sets are one node. Nodes whose signatures agree in all rows of a band
are candidates. A candidate pair's signatures are compared batch by batch: with m of n hashes equal, the similarity has a Beta(m + 1, n - m + 1)
posterior, and a pair goes as soon as the chance of reaching the threshold is below the chosen miss probability. What survives is verified on the full sets.

A bucket's pairs are not all made. First every bucket compares its members with the most central one (the one that shares
most buckets), which joins a group of versions of one text at once. Components are formed, and only buckets that still
hold several components go on: there, members of different components are compared inside the tasks, by their signatures and then by sets of shortened hashes,
which lose no link. Of the links that stay, as many as join what is linked are verified on the full sets, and all of them, should one fail. So no link is
lost to the order of the comparisons, and the number of pairs that leave a task doesn't grow with the square of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import common
from lectern.llm.components import components
from lectern.llm.simhash import FEW_IDS, _shingle_hashes

WORDS = 5
#: Links have PERCENT * union <= 100 * intersection.
PERCENT = 85
#: At the threshold a pair meets in none of the bands with a chance of (1 - 0.85 ** 5) ** 26 = 2e-7.
BANDS, ROWS = 26, 5
#: Hashes of a signature, how many are compared at once, and the posterior chance of a link below which a pair goes.
HASHES, BATCH, MISS = 256, 32, 1e-6
#: Rows of a unit of buckets; a block's queries and targets in the buckets of a larger one.
UNIT, QUERIES, TARGETS = 8192, 1024, 4096
#: Rows of units that a task holds, about, and pairs that it compares at once.
BIN, PAIRS = 10_000, 1 << 17
#: Texts of so many bytes are hashed side by side, and so many short hashes compared at once.
HASHED_BYTES, SHORTS = 256 << 10, 4 << 20


def least_matches(percent: int = PERCENT, hashes: int = HASHES, batch: int = BATCH, miss: float = MISS) -> list[int]:
    """For each batch: the fewest equal hashes so far with which the similarity is still at least the threshold with a chance of miss or more.

    With a uniform prior, P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m).
    """
    t, out = percent / 100, []
    for n in range(batch, hashes + 1, batch):
        upto, m = 0.0, -1
        while upto < miss:
            m += 1
            upto += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(12)
    return rng.integers(0, 1 << 63, HASHES, np.int64).astype(np.uint64), rng.integers(0, 1 << 63, HASHES, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _minima(sets: list[np.ndarray]) -> np.ndarray:
    """The signatures of sets that aren't empty, a row each, 32 bits a hash."""
    flips, odd = _seeds()
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((HASHES, len(sets)), np.uint64)
    for k in range(HASHES):
        out[k] = np.minimum.reduceat((flat ^ flips[k]) * odd[k], starts)
    return np.ascontiguousarray((out >> np.uint64(32)).T)


def _band_keys(minima: np.ndarray) -> np.ndarray:
    """A long for each band: its number and its rows, mixed."""
    keys = np.empty((len(minima), BANDS), np.uint64)
    for j in range(BANDS):
        k = np.full(len(minima), j + 1, np.uint64)
        for r in range(ROWS):
            k = (k ^ minima[:, j * ROWS + r]) * np.uint64(0x9E3779B97F4A7C15)
            k ^= k >> np.uint64(29)
            k = k * np.uint64(0xBF58476D1CE4E5B9) ^ k >> np.uint64(32)
        keys[:, j] = k
    return keys.view(np.int64)


def _digest(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _set(text: str, words: int) -> np.ndarray:
    return np.unique(_shingle_hashes(text, words))


def _signed_rows(rows: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, d1 and d2 (digest of the set), and for sets that aren't empty bands and sig."""

    def run(batch: pa.RecordBatch):
        for part in common.slices(batch, most=HASHED_BYTES):
            sets = [_set(t, words) for t in common.texts(part)]
            full = [i for i, s in enumerate(sets) if len(s)]
            bands, sigs = [None] * len(sets), [None] * len(sets)
            if full:
                minima = _minima([sets[i] for i in full])
                # Hashes that made no band first, since those of a candidate's bands are biased.
                short = np.roll(minima, -BANDS * ROWS, axis=1).astype("<u2")
                for i, k, s in zip(full, _band_keys(minima), short, strict=True):
                    bands[i], sigs[i] = k, s.tobytes()
            d = [_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in d], pa.int64()), pa.array([x for _, x in d], pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                names=["doc_id", "n_shingles", "d1", "d2", "bands", "sig"],
            )

    return common.map_batches(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>, sig binary")


def _shingle_sets(rows: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node, shingles and short (their lower 32 bits, sorted) of the wanted nodes (node, d1, d2, least): only texts with such an id are read, and told apart by their digests."""
    ids = wanted.select("least").distinct()
    if ids.limit(FEW_IDS + 1).count() <= FEW_IDS:
        ids = F.broadcast(ids)

    def run(batch: pa.RecordBatch):
        for part in common.slices(batch):
            sets = [_set(t, words) for t in common.texts(part)]
            d = [_digest(s) for s in sets]
            short = [np.sort(s.astype("<u4")).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in d], pa.int64()), pa.array([x for _, x in d], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(short, pa.binary())], names=["d1", "d2", "shingles", "short"])

    read = common.map_batches(rows.join(ids, F.col("doc_id").eqNullSafe(F.col("least")), "left_semi"), run, "d1 bigint, d2 bigint, shingles array<bigint>, short binary")
    # An id may stand in several rows, so a wanted set may come more than once.
    return read.join(wanted.select("node", "d1", "d2"), ["d1", "d2"]).groupBy("node").agg(F.first("shingles").alias("shingles"), F.first("short").alias("short"))


def _pass(x: np.ndarray, a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Equal hashes of each pair of rows a and b of x; -1 for pairs that a posterior bound prunes."""
    out = np.full(len(a), -1, np.int64)
    alive, equal = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, m in enumerate(least):
        part = x[:, k * BATCH : (k + 1) * BATCH]
        equal = equal + (part[a[alive]] == part[b[alive]]).sum(1)
        keep = equal >= m
        alive, equal = alive[keep], equal[keep]
    out[alive] = equal
    return out


def _sigs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u2").reshape(-1, HASHES)


def _survivors(pairs: DataFrame, sigs: DataFrame, where: str, least: list[int]) -> DataFrame:
    """The pairs (a, b) that no bound prunes. Few nodes are a of very many pairs, so their signatures are joined by split."""
    counted = common.saved(pairs.groupBy("a").agg(F.count("*").alias("n")).join(sigs.withColumnsRenamed({"node": "a", "sig": "x"}), "a"), f"{where}/pivots")
    both = common.join_split(pairs, counted, ["a"]).join(sigs.withColumnsRenamed({"node": "b", "sig": "y"}), "b").select("a", "b", "x", "y")

    def run(batch: pa.RecordBatch):
        if len(batch):
            n = np.arange(len(batch))
            keep = _pass(_sigs(batch["x"].to_pylist() + batch["y"].to_pylist()), n, n + len(n), least) >= 0
            yield pa.RecordBatch.from_struct_array(pa.StructArray.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep)))

    return common.map_batches(both, run, "a bigint, b bigint")


def _verified(pairs: DataFrame, sets: DataFrame, where: str, percent: int) -> DataFrame:
    """The pairs (a, b) with PERCENT * union <= 100 * intersection, on full sets."""
    counted = common.saved(pairs.groupBy("a").agg(F.count("*").alias("n")).join(sets.withColumnsRenamed({"node": "a", "shingles": "x"}), "a"), f"{where}/sets")
    both = common.join_split(pairs, counted, ["a"]).join(sets.withColumnsRenamed({"node": "b", "shingles": "y"}), "b")

    def run(batch: pa.RecordBatch):
        keep = []
        for x, y in zip(batch["x"], batch["y"], strict=True):
            x, y = x.values.to_numpy(), y.values.to_numpy()
            shared = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) else 0
            keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
        if keep:
            yield pa.RecordBatch.from_struct_array(pa.StructArray.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep)))

    return common.map_batches(both.select("a", "b", "x", "y"), run, "a bigint, b bigint")


def _crossed(starts: np.ndarray, split: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of queries and targets that stand against each other, lot by lot: a block's queries are its rows up to split, its targets the others. A query's targets stay in one lot."""
    counts = np.repeat(ends - split, split - starts)
    queries = np.concatenate([np.arange(a, b) for a, b in zip(starts.tolist(), split.tolist(), strict=True)] or [np.zeros(0, np.int64)])
    firsts, upto, at = np.repeat(split, split - starts), np.cumsum(counts), 0
    while at < len(queries):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        n = counts[at:end]
        before = np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(queries[at:end], n), np.repeat(firsts[at:end], n) + np.arange(n.sum()) - before
        at = end


def _alike(sets: list[np.ndarray], q: np.ndarray, t: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of short sets are similar enough. Short hashes may fall together, which adds to what sets share, so no pair is lost. There may be no pairs, as where no signatures were alike."""
    keep = np.zeros(len(q), bool)
    sizes = np.asarray([len(sets[i]) for i in t], np.int64)
    lot = np.cumsum(sizes) // SHORTS
    edges = [0, *(np.flatnonzero((q[1:] != q[:-1]) | (lot[1:] != lot[:-1])) + 1).tolist(), len(q)] if len(q) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own, size = sets[q[a]], sizes[a:b]
        flat = np.concatenate([sets[i] for i in t[a:b]])
        shared = np.add.reduceat(own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat, np.cumsum(size) - size)
        keep[a:b] = 100 * shared >= percent * (len(own) + size - shared)
    return keep


def _in_blocks(members: DataFrame, buckets: DataFrame, known: DataFrame, where: str, least: list[int], percent: int, forest: bool) -> DataFrame:
    """Links (a, b) between members of one bucket that are in different components, by signatures and short sets: as many as join all that are linked, or all.

    members: key, node, comp of open buckets; buckets: key, n, main (its largest component) and others (how many are not in it); known: node, sig and short. Buckets that share
    nodes are one unit, so that a node is sent once a unit; of a unit with too many rows each bucket is on its own, in blocks of queries and targets.
    """
    rows = common.saved(common.join_split(members, buckets, ["key"]), f"{where}/rows")
    least_key = rows.groupBy("node").agg(F.min("key").alias("low"))
    units = rows.select("key", "node").join(least_key, "node").groupBy("key").agg(F.min("low").alias("unit"), F.count("*").alias("n"))
    large = units.groupBy("unit").agg(F.sum("n").alias("rows")).filter(F.col("rows") > UNIT).select("unit", F.lit(True).alias("large"))
    units = common.saved(units.join(large, "unit", "left").select("key", "n", "unit", F.coalesce("large", F.lit(False)).alias("large")), f"{where}/units")
    rows = common.join_split(rows, units, ["key"])
    small = rows.filter("not large").groupBy("unit", "node").agg(F.collect_list("key").alias("keys"), F.first("comp").alias("comp"))  # a node is in as many buckets as bands at most
    small = small.select("unit", F.lit(0).alias("share"), F.lit(0).alias("block"), F.lit(None).cast("boolean").alias("told"), "node", "comp", "keys")
    shares, blocks = F.ceil(F.col("others") / QUERIES).cast("int"), F.ceil(F.col("size") / TARGETS).cast("int")
    own = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")
    count = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    columns = [F.col("key").alias("unit"), "share", "block", "told", "node", "comp", F.array("key").alias("keys")]
    hot = rows.filter("large")
    asks = hot.filter("comp <> main").withColumns({"share": own(shares, 1), "told": F.lit(False)}).withColumn("block", count(blocks)).select(columns)
    told = hot.withColumns({"block": own(blocks, 2), "told": F.lit(True)}).withColumn("share", count(shares)).select(columns)
    sent = small.unionByName(asks).unionByName(told).join(known, "node")
    # A row of a hot bucket is sent more than once, so bins are by what is sent.
    times = F.when(F.col("large"), shares.cast("long") + F.when(F.col("comp") != F.col("main"), blocks).otherwise(0)).otherwise(1)
    bins = F.pmod(F.xxhash64("unit", "share", "block"), F.lit(1 + (rows.agg(F.sum(times)).first()[0] or 0) // BIN)).alias("bin")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["unit", "share", "block", "node"], ignore_index=True)
        x, sets = _sigs(pdf["sig"]), [np.frombuffer(b, "<u4") for b in pdf["short"]]
        nodes, comps = pdf["node"].to_numpy(), pdf["comp"].to_numpy()
        each = pd.DataFrame({"row": np.repeat(np.arange(len(pdf)), pdf["keys"].str.len()), "key": np.concatenate(pdf["keys"].to_list())})
        each = each.join(pdf[["unit", "share", "block", "told"]], on="row")
        hot = each["told"].notna()
        # In a small unit a component's rows ask those of the components before it in the bucket; in a block some rows ask and others are told.
        each["rank"] = np.where(hot, each["told"].fillna(False).astype(bool), comps[each["row"]])
        each = each.sort_values(["unit", "share", "block", "key", "rank", "row"], ignore_index=True)
        at, rank, row = each[["unit", "share", "block", "key"]].to_numpy(), each["rank"].to_numpy(), each["row"].to_numpy()
        new = np.append(True, (at[1:] != at[:-1]).any(1))
        turn = np.append(True, new[1:] | (rank[1:] != rank[:-1]))
        ends = np.append(np.flatnonzero(new)[1:], len(each))[np.cumsum(new) - 1]
        starts = np.flatnonzero(turn)
        split, ends = np.append(starts[1:], len(each)), ends[starts]
        some = split < ends
        roots: dict[int, int] = {}

        def root(c: int) -> int:
            while (up := roots.get(c, c)) != c:
                roots[c] = c = roots.get(up, up)
            return c

        out, seen = [], np.zeros(0, np.int64)
        for q, t in _crossed(starts[some], split[some], ends[some]):
            q, t = row[q], row[t]
            pair = np.unique(np.minimum(q, t) * len(pdf) + np.maximum(q, t))
            q, t = pair // len(pdf), pair % len(pdf)
            keep = comps[q] != comps[t]
            keep[keep] = _pass(x, q[keep], t[keep], least) >= 0
            keep[keep] = ~np.isin(pair[keep], seen)
            seen = np.append(seen, pair[keep])
            q, t = q[keep], t[keep]
            keep = _alike(sets, q, t, percent)
            for i, j in zip(q[keep].tolist(), t[keep].tolist(), strict=True):
                a, b = root(comps[i]), root(comps[j])
                if a != b or not forest:
                    roots[max(a, b)] = min(a, b)
                    out.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return sent.groupBy(bins).applyInPandas(compare, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles (size of the set), component_id (smallest doc_id that links reach) and kept (whether it is the row's own).

    Null, empty and wordless texts have no set and are linked with nothing; a text of fewer words than a shingle is one shingle; rows of equal ids or texts are kept
    one by one; a null id has its component's id, and no other row is named after it. Shingles are compared by their 64-bit
    hashes. Very long texts are hashed whole, in one task. Ties go to the smaller node. An empty table gives no rows. Links are missed with a chance of about miss for each
    batch, and of 2e-7 by the bands, for a pair at just the threshold.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    where = common.scratch(spark)
    least = least_matches(percent, miss=miss)
    texts = common.id_text(docs, id_col, text_col)
    rows = common.saved(_signed_rows(texts, words).withColumn("row", F.monotonically_increasing_id()), f"{where}/rows")
    full = rows.filter("n_shingles > 0")
    nodes = full.groupBy("d1", "d2").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    nodes = common.saved(nodes, f"{where}/nodes")
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    buckets = common.saved(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), f"{where}/buckets")
    members = common.saved(common.join_split(keyed, buckets.withColumn("size", F.col("n")), ["key"]), f"{where}/members")
    central = members.groupBy("node").agg(F.sum("size").alias("shared"))
    met = common.saved(nodes.join(central, "node").select("node", "d1", "d2", "least", "sig", "shared"), f"{where}/met")
    sets = common.saved(_shingle_sets(texts, met, words), f"{where}/sets")
    known = common.saved(met.select("node", "sig").join(sets.select("node", "short"), "node"), f"{where}/known")
    sets = sets.select("node", "shingles")
    members = common.saved(members.select("key", "node").join(met.select("node", "shared"), "node"), f"{where}/shared")
    links, roots = None, None

    for turn in ("central", "forest", "all"):
        at = f"{where}/{turn}"
        comps = members.withColumn("comp", F.col("node")) if roots is None else members.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
        comps = common.saved(comps, f"{at}/comps")
        sizes = comps.groupBy("key", "comp").agg(F.count("*").alias("n"))
        open_ = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("most"), F.count("*").alias("comps")).filter("comps > 1")
        open_ = common.saved(open_.select("key", "n", F.col("n").alias("size"), "main", (F.col("n") - F.col("most")).alias("others")), f"{at}/open")
        if open_.isEmpty():
            break
        if turn == "central":
            pivots = comps.groupBy("key").agg(F.max(F.struct("shared", "node"))["node"].alias("a"))
            pivots = common.saved(open_.select("key", "n").join(pivots, "key"), f"{at}/pivots")
            pairs = common.join_split(comps, pivots, ["key"]).filter("node <> a").select("a", F.col("node").alias("b")).distinct()
            pairs = _survivors(common.saved(pairs, f"{at}/pairs"), known.select("node", "sig"), at, least)
        else:
            pairs = _in_blocks(comps.select("key", "node", "comp"), open_, known, at, least, percent, turn == "forest")
        pairs = common.saved(pairs, f"{at}/survivors")
        found = common.saved(_verified(pairs, sets, at, percent), f"{at}/links")
        links = found if links is None else links.unionByName(found)
        roots = common.saved(components(links, f"{at}/joined"), f"{at}/roots")
        if turn == "forest" and found.count() == pairs.count():
            break

    named = nodes.select("node", "least", "n", "d1", "d2")
    group = common.saved(named.join(roots, "node", "left") if roots is not None else named.withColumn("root", F.lit(None).cast("long")), f"{where}/group")
    linked = group.filter("root is not null")
    ids = common.saved(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), f"{where}/ids")
    alone = group.filter("root is null").select("d1", "d2", "n", F.col("least").alias("component_id"))
    named = common.saved(common.join_split(linked.withColumnRenamed("n", "rows"), ids, ["root"]).select("d1", "d2", F.col("rows").alias("n"), "component_id").unionByName(alone), f"{where}/named")
    out = common.join_split(full.select("doc_id", "n_shingles", "d1", "d2"), named, ["d1", "d2"]).select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
