"""SimHash near duplicates, linked through BK-trees.

A BK-tree over the fingerprints of the whole corpus would have to pass through one machine. Two
fingerprints within r bits of each other agree in at least k of r + k equal blocks, so every choice of
k blocks makes a key, and each key's fingerprints make one shard of a hundred or so. Every shard has a BK-tree of its
own, with children keyed by their integer Hamming distance to the parent, and searches it with its own
fingerprints, following only the edges within the radius. Many trees of one task are built and searched side by side,
level by level. Equal fingerprints are one node. A shard that is too large is split by further blocks.

Near copies by word shingles (:func:`similar_texts`) differ in more bits than equal blocks can promise to catch. Their
fingerprints are four words wide, and shards are choices of random bits, as many as a stated recall takes.
"""

from __future__ import annotations

import itertools
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

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints of a shard on average.
SHARD = 128
#: A shard with more fingerprints is split by further blocks, at most so many times; then it is searched by several tasks, each with the whole tree and a share of the queries.
LARGE, SPLITS, SHARD_QUERIES = 4096, 2, 2048
#: Fingerprints that one task has the trees of, about, and pairs of a query and a node that it holds at once.
BIN, FRONTIER = 50_000, 1 << 19
#: Links that lead to one fingerprint from one task.
FAN = 64

#: Similar texts: words of a shingle, similarity, and the share of pairs of just that similarity that meet in a shard.
SIMILAR_WORDS, SIMILARITY, MEETING = 5, 0.8, 0.97
#: Words of a wide fingerprint, and the most bits of it that may differ for each word of 64.
WIDTH, WIDE_RADIUS = 4, 12
SIMILAR_SHARD = 32
#: So many ids at most are broadcast, to find the texts that are checked.
FEW_IDS = 200_000


def _shingle_hashes(text: str, words: int) -> np.ndarray:
    """The XXH64 of the word shingles of the text with A-Z lower-cased; of the whole sequence where it is shorter."""
    parts = text.encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    if len(parts) < words:
        return np.asarray([xxhash.xxh64_intdigest(b" ".join(parts), SEED)], np.uint64)
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate([[0], ends[: len(parts) - words]]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.asarray([digest(line[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64)


def _majority(h: np.ndarray) -> np.uint64:
    """Bits that are set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0]


def fingerprint(text: str, words: int = SHINGLE) -> int:
    """SimHash of the shingles of the text; 0 without words."""
    h = _shingle_hashes(text, words)
    return int(_majority(h)) if len(h) else 0


def wide_fingerprint(text: str, words: int = SIMILAR_WORDS) -> list[int]:
    """SimHashes of several mixes of the hashes of the distinct shingles, as signed longs; zeros without words."""
    h = np.unique(_shingle_hashes(text, words))
    out = np.zeros(WIDTH, np.uint64)
    for k in range(WIDTH if len(h) else 0):
        m = (h ^ (h >> np.uint64(29 + k))) * np.uint64((0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)[k])
        out[k] = _majority(m ^ (m >> np.uint64(32)))
    return out.view(np.int64).tolist()


def fingerprints(docs: DataFrame, *, words: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row; null texts are empty, with fp 0."""
    common.small_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch):
        fps = np.asarray([fingerprint(t, words) for t in common.texts(batch)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps)], names=["doc_id", "fp"])

    rows = common.id_text(docs, id_col, text_col)
    return common.map_batches(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint")


class Forest:
    """BK-trees of many shards side by side. Fingerprints are rows of one or more words; those of a shard stand together.

    A node is a fingerprint. ``key`` holds parent * (bits + 1) + distance of every edge, sorted, and ``child`` where it leads, so
    the edges of a node within a range of distances are one run. A child stands after its parent.
    """

    def __init__(self, fps: np.ndarray, shard: np.ndarray):
        self.fps, self.span, self.visits = fps, 64 * fps.shape[1] + 1, 0
        n = len(fps)
        first = np.append(True, shard[1:] != shard[:-1])[:n]
        self.root = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        left, at = np.flatnonzero(~first), self.root[~first]
        keys, children = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(left):  # one level of all trees
            key = at * self.span + self.distance(left, at)
            edge, one, which = np.unique(key, return_index=True, return_inverse=True)
            keys.append(edge)
            children.append(left[one])
            at = left[one][which]
            rest = left != at
            left, at = left[rest], at[rest]
        key, child = np.concatenate(keys), np.concatenate(children)
        order = np.argsort(key)
        self.key, self.child = key[order], child[order]

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.fps[a] ^ self.fps[b]).sum(1, dtype=np.int64)

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, node, distance) of the pairs of one shard within the radius, the node before the query; a bounded number is held at once."""
        todo = [(q, self.root[q]) for q in np.array_split(queries, max(1, -(-len(queries) // 16384)))]
        while todo:
            q, at = todo.pop()
            before = at < q  # what hangs under a node stands after it
            q, at = q[before], at[before]
            if not len(q):
                continue
            self.visits += len(q)
            d = self.distance(q, at)
            hit = d <= radius
            if hit.any():
                yield q[hit], at[hit], d[hit]
            low = np.searchsorted(self.key, at * self.span + np.maximum(d - radius, 0))
            n = np.searchsorted(self.key, at * self.span + np.minimum(d + radius, self.span - 1), "right") - low
            upto = np.cumsum(n)
            cuts = np.searchsorted(upto, np.arange(FRONTIER, int(upto[-1]) + FRONTIER, FRONTIER)) + 1
            for a, z in itertools.pairwise([0, *cuts[:-1].tolist(), len(q)]):
                m = n[a:z]
                edge = np.arange(int(m.sum())) + np.repeat(low[a:z] - np.cumsum(m) + m, m)
                todo.append((np.repeat(q[a:z], m), self.child[edge]))


def spanning(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Numbers of links that join what all links join, without a cycle, near ones first. label, where given, knows what is joined before and is brought up to date."""
    label = np.arange(n) if label is None else label
    left, kept = np.argsort(d, kind="stable"), []
    while True:
        x, y = label[a[left]], label[b[left]]
        apart = x != y
        left, x, y = left[apart], x[apart], y[apart]
        if not len(left):
            return np.concatenate([*kept, np.zeros(0, np.int64)])
        high, one = np.unique(np.maximum(x, y), return_index=True)
        kept.append(left[one])
        label[high] = np.minimum(x, y)[one]
        while not np.array_equal(label, up := label[label]):
            label[:] = up


class _Hubs:
    """Of each place the one among its neighbours that had most neighbours itself when the two met: the text that a group of versions was made from, as a rule."""

    def __init__(self, n: int):
        self.degree, self.hub = np.zeros(n, np.int64), np.full(n, -1, np.int64)

    def see(self, a: np.ndarray, b: np.ndarray) -> None:
        self.degree += np.bincount(a, minlength=len(self.degree)) + np.bincount(b, minlength=len(self.degree))
        x, y = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.lexsort((-y, self.degree[y], x))
        x, y = x[order], y[order]
        last = np.append(x[1:] != x[:-1], True)[: len(x)]
        x, y = x[last], y[last]
        better = (self.hub[x] < 0) | (self.degree[y] > self.degree[self.hub[x]])
        self.hub[x[better]] = y[better]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        a = np.flatnonzero(self.hub >= 0)
        return a, self.hub[a]


def _pairs(forest: Forest, queries: np.ndarray, radius: int, hubs: _Hubs | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links within the radius that join all that such links join, without a cycle, and how they part the places into components. hubs, where given, sees all links."""
    label, kept, held, size = np.arange(len(forest.fps)), [], [], 0

    def take() -> None:
        if held:
            a, b, d = (np.concatenate(x) for x in zip(*held, strict=True))
            if hubs is not None:
                hubs.see(a, b)
            one = spanning(len(label), a, b, d, label)
            kept.append((a[one], b[one]))
            held.clear()

    for found in forest.search(queries, radius):
        held.append(found)
        size += len(found[0])
        if size > FRONTIER:
            take()
            size = 0
    take()
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(a for a, _ in kept)]), np.concatenate([none, *(b for _, b in kept)]), label


def _links(fps: np.ndarray, shard: np.ndarray, queries: np.ndarray, radius: int, real: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places that join all that the links within the radius join: such that at most FAN of them share a place, or real links, and then each place's link to its hub too."""
    hubs = _Hubs(len(fps)) if real else None
    a, b, label = _pairs(Forest(fps, shard), queries, radius, hubs)
    if hubs is not None:
        x, y = hubs.links()
        return np.concatenate([a, x]), np.concatenate([b, y])
    # A component as a flat tree with few branches a node, so that no later join has a hot key.
    order = np.argsort(label, kind="stable")
    of = label[order]
    first = np.append(True, of[1:] != of[:-1])[: len(of)]
    start = np.maximum.accumulate(np.where(first, np.arange(len(of)), 0))
    place = np.arange(len(of)) - start
    up = start + (place - 1) // FAN
    return order[~first], order[up[~first]]


def blocks(n: int, radius: int) -> tuple[int, int, int]:
    """(k, r + k, bits): so many agreeing blocks, and so many bits of each, that a shard of n fingerprints has SHARD on average."""
    want = max(1, math.ceil(math.log2(max(n, 2) / SHARD)))
    for k in range(1, 6):
        if (64 // (radius + k)) * k >= want:
            break
    return k, radius + k, min(64 // (radius + k), -(-want // k))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _parted(places: list[int], n: int) -> list[int]:
    """Masks of n parts of some bits."""
    return [sum(1 << b for b in places[len(places) * i // n : len(places) * (i + 1) // n]) for i in range(n)]


def _dealt(fps: DataFrame, words: list[str], masks: list[dict[str, int]]) -> DataFrame:
    """The fingerprints once a table, with the table and what the table's masks leave of each word."""
    part = lambda m: F.xxhash64(*[F.col(w).bitwiseAND(F.lit(_signed(m[w]))) for w in words if m.get(w)]) if len(m) > 1 else F.col(words[0]).bitwiseAND(F.lit(_signed(m.get(words[0], 0))))
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("table"), part(m).alias("part")) for i, m in enumerate(masks)]))
    return fps.select(*words, keys.alias("key")).select(*words, "key.table", "key.part")


def _searched(dealt: DataFrame, words: list[str], radius: int, bins: int, real: bool = False) -> DataFrame:
    """Links of all shards but large ones: bins of shards, a forest for each."""
    out = [f"{x}_{w}" for x in "ab" for w in words]

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", *words])
        fps = pdf[words].to_numpy()
        a, b = _links(fps.view(np.uint64), pdf["part"].to_numpy(), np.arange(len(fps)), radius, real)
        return pd.DataFrame(np.hstack([fps[a], fps[b]]), columns=out)

    bin_ = F.pmod(F.xxhash64("part"), F.lit(bins)).alias("bin")
    return dealt.groupBy("table", bin_).applyInPandas(search, ", ".join(f"{c} bigint" for c in out))


def _in_shares(dealt: DataFrame, words: list[str], radius: int, real: bool = False) -> DataFrame:
    """Links of large shards (with their count): each share of the queries has the whole tree."""
    out = [f"{x}_{w}" for x in "ab" for w in words]
    shares = F.ceil(F.col("count") / SHARD_QUERIES).cast("int")
    rows = dealt.withColumn("shares", shares).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))

    def search(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(words)
        fps = pdf[words].to_numpy()
        mine = np.arange(int(key[2]), len(fps), int(pdf["shares"].iloc[0]))
        a, b = _links(fps.view(np.uint64), np.zeros(len(fps), np.int64), mine, radius, real)
        return pd.DataFrame(np.hstack([fps[a], fps[b]]), columns=out)

    return rows.groupBy("table", "part", "share").applyInPandas(search, ", ".join(f"{c} bigint" for c in out))


def _hot(dealt: DataFrame) -> tuple[DataFrame, bool]:
    hot = dealt.groupBy("table", "part").count().filter(F.col("count") > LARGE)
    few = hot.limit(10_001).count()
    return (F.broadcast(hot) if few <= 10_000 else hot), few > 0


def link(fps: DataFrame, where: str, *, radius: int = RADIUS) -> DataFrame:
    """(a, b) links that join all fingerprints (column fp, distinct) within the radius of each other."""
    n = fps.count()
    k, m, bits = blocks(n, radius)
    places = [list(range(64 * i // m, 64 * (i + 1) // m)) for i in range(m)]
    chosen = list(itertools.combinations(range(m), k))
    masks = [sum(1 << b for i in c for b in places[i][:bits]) for c in chosen]
    found, dealt = [], common.saved(_dealt(fps, ["fp"], [{"fp": x} for x in masks]), f"{where}/dealt0")
    bins = 1 + n // BIN
    for depth in range(SPLITS + 1):
        hot, some = _hot(dealt)
        if not some:
            found.append(_searched(dealt, ["fp"], radius, bins))
            break
        found.append(_searched(dealt.join(hot, ["table", "part"], "left_anti"), ["fp"], radius, bins))
        large = dealt.join(hot, ["table", "part"])
        if depth == SPLITS:
            found.append(_in_shares(large, ["fp"], radius))
            break
        # Pairs of one shard agree in its bits; of r + 1 parts of the others, they agree in one at least.
        finer = [[x | y for y in _parted([b for b in range(64) if not x >> b & 1], radius + 1)] for x in masks]
        keys = F.array(*[F.struct(F.lit(i * (radius + 1) + j).alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(y))).alias("part")) for i, own in enumerate(finer) for j, y in enumerate(own)])
        keys = F.explode(F.slice(keys, F.col("table") * (radius + 1) + 1, F.lit(radius + 1)))
        dealt = common.saved(large.select("fp", keys.alias("key")).select("fp", "key.table", "key.part"), f"{where}/dealt{depth + 1}")
        masks = [y for own in finer for y in own]
    all_ = found[0]
    for more in found[1:]:
        all_ = all_.unionByName(more)
    return common.saved(all_.select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b")).distinct(), f"{where}/near")


def near_duplicates(docs: DataFrame, *, radius: int = RADIUS, words: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links of at most radius bits reach.

    Null, empty and wordless texts have fingerprint 0 and are linked like any other; rows of equal ids
    or texts are kept one by one; a null id has its fingerprint's component, and no other row is named after it. Ties don't
    arise, since all links count alike. Very long texts are hashed whole, in one task. Empty tables give no rows.
    """
    where = common.scratch(docs.sparkSession)
    rows = common.saved(fingerprints(docs, words=words, id_col=id_col, text_col=text_col), f"{where}/fps")
    nodes = common.saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), f"{where}/nodes")
    named = _named(nodes, components(link(nodes.select("fp"), where, radius=radius), where), where)
    return common.join_split(rows, named, ["fp"]).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _named(nodes: DataFrame, roots: DataFrame, where: str) -> DataFrame:
    """fp, n and component_id: the least id of all nodes (fp, least, n) of one root."""
    group = common.saved(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left"), f"{where}/group")
    linked = group.filter("root is not null")
    least = common.saved(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), f"{where}/least")
    alone = group.filter("root is null").select("fp", "n", F.col("least").alias("component_id"))
    return common.saved(common.join_split(linked, least, ["root"]).select("fp", "n", "component_id").unionByName(alone), f"{where}/named")


def tables(n: int, similarity: float = SIMILARITY, meeting: float = MEETING) -> tuple[int, int]:
    """(number of tables, bits of each): random pairs of just the similarity agree in all bits of one table with a chance of meeting.

    Two sets of that similarity differ in a bit with the angle between them as a share of the half circle.
    """
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = max(1, math.ceil(math.log2(max(n, 2) / SIMILAR_SHARD)))
    return max(1, math.ceil(math.log(1 - meeting) / math.log(1 - (1 - differ) ** bits))), bits


def _verified(links: DataFrame, nodes: DataFrame, rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """The links (a, b) of fingerprints whose texts share enough of their distinct shingles. Only texts of linked fingerprints are read, one of each."""
    wanted = links.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(nodes.select("fp", "least"), "fp")
    ids = wanted.select("least").distinct()
    if ids.limit(FEW_IDS + 1).count() <= FEW_IDS:
        ids = F.broadcast(ids)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch):
        texts = common.texts(batch)
        fps = np.asarray([wide_fingerprint(t, words) for t in texts], np.int64).reshape(-1, WIDTH)
        shingles = [np.unique(_shingle_hashes(t, words)).view(np.int64) for t in texts]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(np.ascontiguousarray(fps[:, i])) for i in range(WIDTH)), pa.array(shingles, pa.list_(pa.int64()))], names=["doc_id", *columns, "shingles"])

    columns = [f"w{i}" for i in range(WIDTH)]
    read = common.map_batches(rows.join(ids, F.col("doc_id").eqNullSafe(F.col("least")), "left_semi"), run, f"doc_id {kind}, {', '.join(f'{c} bigint' for c in columns)}, shingles array<bigint>")
    shown = read.select(F.xxhash64(*columns).alias("fp"), "shingles").groupBy("fp").agg(F.first("shingles").alias("s"))
    pairs = links.join(shown.select(F.col("fp").alias("a"), F.col("s").alias("x")), "a").join(shown.select(F.col("fp").alias("b"), F.col("s").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return pairs.filter(both >= similarity * (F.size("x") + F.size("y") - both)).select("a", "b")


def similar_texts(docs: DataFrame, *, words: int = SIMILAR_WORDS, similarity: float = SIMILARITY, meeting: float = MEETING, radius: int = WIDE_RADIUS * WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and component_id of every row: the smallest id among texts that are alike by their word shingles.

    Texts are compared where their wide fingerprints differ in at most radius bits and meet in a table of random bits; the number of
    tables follows from the number of fingerprints and the recall ``meeting``. Of these pairs, as many as join all others, the nearest
    ones first, and each text's with the one among its neighbours that has most neighbours, are checked by their shingles and linked if their similarity is enough. Null, empty and wordless texts are alike; texts of fewer words
    than a shingle are one; rows of equal ids or texts are kept one by one; a null id has its text's component, and no
    other row is named after it. Very long texts are hashed whole. Empty tables give no rows. A large group of near copies is compared pair by pair, in shares.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    where = common.scratch(spark)
    rows = common.id_text(docs, id_col, text_col)
    columns = [f"w{i}" for i in range(WIDTH)]

    def run(batch: pa.RecordBatch):
        fps = np.asarray([wide_fingerprint(t, words) for t in common.texts(batch)], np.int64).reshape(-1, WIDTH)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(np.ascontiguousarray(fps[:, i])) for i in range(WIDTH))], names=["doc_id", *columns])

    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = common.saved(common.map_batches(rows, run, f"doc_id {kind}, {', '.join(f'{c} bigint' for c in columns)}").withColumn("fp", F.xxhash64(*columns)), f"{where}/fps")
    nodes = common.saved(rows.groupBy("fp", *columns).agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), f"{where}/nodes")
    n = nodes.count()
    many, bits = tables(n, similarity, meeting)
    rng = np.random.default_rng(5)
    masks = []
    for _ in range(many):
        mask = dict.fromkeys(columns, 0)
        for b in rng.choice(64 * WIDTH, bits, replace=False).tolist():
            mask[columns[b // 64]] |= 1 << b % 64
        masks.append(mask)
    dealt = _dealt(nodes.select(columns), columns, masks)
    hot, some = _hot(dealt)
    bins = 1 + n // BIN
    if some:
        found = _searched(dealt.join(hot, ["table", "part"], "left_anti"), columns, radius, bins, True).unionByName(_in_shares(dealt.join(hot, ["table", "part"]), columns, radius, True))
    else:
        found = _searched(dealt, columns, radius, bins, True)
    ends = [F.xxhash64(*[f"{x}_{c}" for c in columns]) for x in "ab"]
    links = common.saved(found.select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b")).distinct(), f"{where}/near")
    links = _verified(links, nodes, common.id_text(docs, id_col, text_col), words, similarity)
    named = _named(nodes.select("fp", "least", "n"), components(links, where), where)
    return common.join_split(rows.select("doc_id", "fp"), named, ["fp"]).select("doc_id", "component_id")
