"""The trie of conversation prefixes, with subtree totals by parallel tree contraction.

A prefix is named by the exclusive or of two 64-bit hashes of (place, digest of role and text) of each of its turns, which
is an associative sum, so prefixes of a conversation of any length are scanned in ranges. Equal names are held
against the turns' SHA-256 digests, parent by parent, and a clash is an error.

Totals of all subtrees come from contraction in rounds. In each round the leaves are raked (added to their parents), and of the
unary nodes an independent set is spliced out: their only child is hung on their parent and takes their weight along on
its edge. A node knows its only child as the exclusive or of all its children less those that went, so a round is one equi-join by
id and one grouping by id, and no node's children are ever collected. Chains halve, so the rounds are about the logarithm
of the depth. Then the rounds are undone from the last to the first: a raked node's total was known when it went, and a spliced one's is its
own weight and its child's total. Both the rounds and their undoing read only what was left at that time.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import common
from lectern.operators.ranges import RANGE, in_ranges, number, scan

#: A conversation takes fewer than so many turns from the first conversation of its hundred.
MOST_SHARED, GROUP = 6, 100
KEY = ["depth", "a", "b"]
#: A guard against a loop without end.
MAX_ROUNDS = 500


def shared_turns(conv: Column) -> Column:
    """How many first turns a conversation takes from the first one of its hundred."""
    return (F.crc32(conv.cast("string").cast("binary")) % MOST_SHARED).cast("long")


def rebuilt_turns(conversations: DataFrame, where: str) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): the rebuilt turns (conv_id, depth, digest, chars, last, __range), and conv_id with size, also where that is 0."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    role, said = text("role"), text("text")
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, said), 256))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.length(said).cast("long").alias("chars"))
    order = ["turn", "digest", "tie"]
    rows = in_ranges(rows.withColumn("tie", F.monotonically_increasing_id()), ["conv_id", *order], f"{where}/ordered")
    rows = common.saved(number(rows, ["conv_id"], order, "own").select("conv_id", "own", "digest", "chars", RANGE), f"{where}/numbered")
    first = F.transform(F.array_sort(F.collect_list(F.struct("own", "digest", "chars"))), lambda x: x.dropFields("own"))
    heads = rows.filter((F.col("conv_id") % GROUP == 0) & (F.col("own") < MOST_SHARED)).groupBy(F.col("conv_id").alias("head")).agg(first.alias("first"))
    convs = rows.groupBy("conv_id").agg(F.count("*").alias("n"), shared_turns(F.col("conv_id")).alias("h"))
    convs = convs.withColumn("head", F.col("conv_id") - F.col("conv_id") % GROUP).join(heads, "head", "left").withColumn("first", F.expr("slice(coalesce(first, array()), 1, int(h))"))
    convs = convs.withColumn("taken", F.size("first").cast("long")).withColumn("size", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = common.saved(convs.drop("head"), f"{where}/conversations")
    taken = convs.select("conv_id", "size", F.posexplode("first").alias("p", "x")).select("conv_id", (F.col("p") + 1).cast("long").alias("depth"), "x.digest", "x.chars", "size", F.lit(-1).alias(RANGE))
    own = common.join_split(rows.filter(F.col("own") > shared_turns(F.col("conv_id"))), convs.select("conv_id", "n", "h", "taken", "size"), ["conv_id"])
    own = own.select("conv_id", (F.col("own") - F.col("h") + F.col("taken")).alias("depth"), "digest", "chars", "size", RANGE)
    return taken.unionByName(own).withColumn("last", F.col("depth") == F.col("size")).drop("size"), convs.select("conv_id", "size")


def _alive(state: DataFrame) -> DataFrame:
    return state.filter("gone = 0").drop("gone", "uc", "ud")


def subtree_totals(tree: DataFrame, where: str, weights: list[str]) -> DataFrame:
    """c, d and the sums of the weights over the subtree of each node; tree: c, d, pc, pd (null at roots), the number kids of its children, the exclusive
    ors kx and ky of their c and d, and a long column for each weight. Rake and compress, then re-expand.
    """
    edges = [f"edge_{w}" for w in weights]
    state = common.saved(tree.withColumns({e: F.lit(0).cast("long") for e in edges} | {"gone": F.lit(0), "uc": F.lit(None).cast("long"), "ud": F.lit(None).cast("long")}), f"{where}/round0")
    bits = math.ceil(math.log2(2 + (state.agg(F.max("d")).first()[0] or 0)))
    names, rounds = state.columns, []
    filled = lambda df: df.select(*[F.col(n) if n in df.columns else F.lit(None).cast(kind).alias(n) for n, kind in kinds])
    kinds = [(f.name, f.dataType) for f in state.schema.fields] + [("np", state.schema["pc"].dataType), ("nd", state.schema["pd"].dataType)]
    while True:
        k = len(rounds)
        live = _alive(state)
        if live.isEmpty():
            break
        if k == MAX_ROUNDS:
            raise RuntimeError(f"no end after {k} rounds")
        coin = F.shiftright("d", k).bitwiseAND(1) == 1 if k < bits else F.xxhash64("c", "d", F.lit(k)).bitwiseAND(1) == 1
        unary = (F.col("kids") == 1) & F.col("pc").isNotNull() & coin
        child = live.filter((F.col("kids") > 0) & ~unary).select(F.col("c").alias("uc"), F.col("d").alias("ud"), *[F.col(e).alias(f"u_{e}") for e in edges])
        spliced = live.filter(unary).withColumns({"uc": F.col("kx"), "ud": F.col("ky")}).join(child, ["uc", "ud"])
        none, long = F.lit(None), lambda x: x.cast("long")
        row = lambda **v: F.struct(*[v.get(n, none).cast(t).alias(n) for n, t in kinds])
        gone = row(c=F.col("c"), d=F.col("d"), gone=F.lit(2), uc=F.col("uc"), ud=F.col("ud"), **{w: F.col(f"u_{e}") for w, e in zip(weights, edges, strict=True)})
        hung = row(c=F.col("uc"), d=F.col("ud"), np=F.col("pc"), nd=F.col("pd"), **{e: F.col(w) + F.col(e) for w, e in zip(weights, edges, strict=True)})
        over = row(c=F.col("pc"), d=F.col("pd"), kx=long(F.col("c").bitwiseXOR(F.col("uc"))), ky=long(F.col("d").bitwiseXOR(F.col("ud"))))
        splices = spliced.select(F.explode(F.array(gone, hung, over)).alias("x")).select("x.*")
        leaves = live.filter("kids = 0")
        raked = leaves.filter("pc is not null").select(F.col("pc").alias("c"), F.col("pd").alias("d"), F.lit(-1).cast("long").alias("kids"), F.col("c").alias("kx"), F.col("d").alias("ky"), *[(F.col(w) + F.col(e)).alias(w) for w, e in zip(weights, edges, strict=True)])
        changes = filled(live.filter("kids > 0").withColumn("gone", F.lit(0))).unionByName(filled(raked)).unionByName(splices)
        new = changes.groupBy("c", "d").agg(
            F.coalesce(F.max("np"), F.max("pc")).alias("pc"), F.coalesce(F.max("nd"), F.max("pd")).alias("pd"), F.sum("kids").alias("kids"), F.bit_xor("kx").alias("kx"), F.bit_xor("ky").alias("ky"),
            F.max("gone").alias("gone"), F.max("uc").alias("uc"), F.max("ud").alias("ud"), *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in (*weights, *edges)],
        ).select(names)
        ended = leaves.withColumns({"gone": F.lit(1), "uc": none.cast("long"), "ud": none.cast("long")}).select(names)
        state = common.saved(new.unionByName(ended), f"{where}/round{k + 1}")
        rounds.append(state)
    later: DataFrame | None = None
    for k, state in reversed(list(enumerate(rounds))):
        part = state.filter("gone = 1").select("c", "d", *weights)
        if later is not None:
            below = later.select(F.col("c").alias("uc"), F.col("d").alias("ud"), *[F.col(w).alias(f"u_{w}") for w in weights])
            undone = state.filter("gone = 2").join(below, ["uc", "ud"])
            part = part.unionByName(undone.select("c", "d", *[(F.col(w) + F.col(f"u_{w}")).alias(w) for w in weights]))
        part = common.saved(part, f"{where}/totals{k}")
        later = part if later is None else later.unionByName(part)
    return later if later is not None else tree.select("c", "d", *weights)


def _digests(ends: DataFrame, where: str) -> DataFrame:
    """The key and ends_sha256 of the nodes at which conversations end (key, conv_id): the ids of a node are joined range by range, and where a node has ids
    in several ranges their texts pass through one running digest, never held together."""
    ends = in_ranges(ends, [*KEY, "conv_id"], f"{where}/ends")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    parts = common.saved(ends.groupBy(*KEY, RANGE).agg(ids.alias("ids")), f"{where}/parts")
    long = parts.groupBy(*KEY).agg(F.count("*").alias("n")).filter("n > 1").drop("n")  # fewer than there are ranges, since each lies across an end of one

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, hashlib.sha256()
        out = lambda: pa.RecordBatch.from_pylist([dict(zip(KEY, key, strict=True)) | {"ends_sha256": digest.hexdigest()}], schema=pa.schema([*((c, pa.int64()) for c in KEY), ("ends_sha256", pa.string())]))
        for batch in batches:
            for *at, text in zip(*[batch[c].to_pylist() for c in (*KEY, "ids")], strict=True):
                if at != key:
                    if key is not None:
                        yield out()
                    key, digest = at, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
        if key is not None:
            yield out()

    short = parts.join(F.broadcast(long), KEY, "left_anti").select(*KEY, F.sha2("ids", 256).alias("ends_sha256"))
    several = parts.join(F.broadcast(long), KEY).repartition(*KEY).sortWithinPartitions(*KEY, RANGE).select(*KEY, "ids")
    return short.unionByName(several.mapInArrow(run, "depth bigint, a bigint, b bigint, ends_sha256 string"))


#: crc32 of the decimal conv_id, byte by byte and bit by bit.
_CRC = "xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT)), lambda a, y: list_reduce([CAST(0 AS UBIGINT), 0, 0, 0, 0, 0, 0, 0], lambda z, i: xor(z // 2, z % 2 * 3988292384), xor(a, y)), CAST(4294967295 AS UBIGINT)), 4294967295)"

#: For the smaller tables: a prefix's name is the digest of its turns' digests, and every subtree is summed over all its nodes.
TRIE_SQL = f"""WITH own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(r) || ':' || r || t)) AS own, sha256(length(r) || ':' || r || t) AS digest, CAST(length(t) AS BIGINT) AS chars
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (SELECT *, CAST({_CRC} % 6 AS BIGINT) AS h, conv_id - conv_id % 100 AS head FROM (SELECT DISTINCT conv_id FROM own)),
heads AS (SELECT c.conv_id, o.own AS depth, digest, chars FROM convs c JOIN own o ON o.conv_id = c.head AND o.own <= c.h),
sizes AS (SELECT c.conv_id, h, count(depth) AS taken FROM convs c LEFT JOIN heads USING (conv_id) GROUP BY c.conv_id, h),
turns AS (SELECT conv_id, depth, digest, chars FROM heads UNION ALL SELECT o.conv_id, own - h + taken, digest, chars FROM own o JOIN sizes USING (conv_id) WHERE own > h),
named AS (SELECT conv_id, depth, chars, sha256(string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS name FROM turns UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
members AS (SELECT *, min(conv_id) OVER (PARTITION BY depth, name) AS node, max(depth) OVER (PARTITION BY conv_id) AS size FROM named),
nodes AS (SELECT node AS conv_id, depth, count(*) AS n_convs, any_value(chars) AS chars, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = size), '')) AS ends_sha256 FROM members GROUP BY node, depth),
edges AS (SELECT n.conv_id, n.depth, m.node AS parent_conv_id FROM nodes n LEFT JOIN members m ON m.conv_id = n.conv_id AND m.depth = n.depth - 1),
kids AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM edges WHERE parent_conv_id IS NOT NULL GROUP BY ALL),
sums AS (SELECT m.node AS conv_id, m.depth, count_if(k.n_children IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved FROM nodes n LEFT JOIN kids k USING (conv_id, depth) JOIN members m ON m.conv_id = n.conv_id AND m.depth <= n.depth GROUP BY ALL)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, e.parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN edges e USING (conv_id, depth) LEFT JOIN kids k USING (conv_id, depth) JOIN sums s USING (conv_id, depth)"""


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    Null role or text is empty. Turns are ordered by turn, null first; of one turn's number, by the SHA-256 of role and text, so repeated rows stand
    together and count as turns of their own. Rows without conv_id belong to no conversation. Turns of any length are read once. An empty table has no root
    and gives no rows. Further columns are left aside. A sum beyond a long is an error.
    """
    spark = conversations.sparkSession
    common.small_batches(spark)
    where = common.scratch(spark)
    turns, convs = rebuilt_turns(conversations, where)
    lane = lambda i: F.xxhash64(F.lit(i), "depth", "digest")
    turns = turns.withColumns({"x": lane(1), "y": lane(2)})
    turns = scan(turns, ["conv_id"], ["depth"], {"a": ("xor", F.col("x")), "b": ("xor", F.col("y"))})
    turns = turns.withColumns({"pa": F.col("a").bitwiseXOR(F.col("x")), "pb": F.col("b").bitwiseXOR(F.col("y"))})
    turns = common.saved(turns.select("conv_id", *KEY, "pa", "pb", "digest", "chars", "last"), f"{where}/turns")
    same = F.when(F.min("digest") == F.max("digest"), F.max("chars")).otherwise(F.raise_error(F.lit("two prefixes have one name")).cast("long"))
    nodes = turns.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), same.alias("chars"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(*[zero.alias(c) for c in KEY], "conv_id", "n_convs", zero.alias("chars"), *[F.lit(None).cast("long").alias(c) for c in ("pa", "pb")])
    nodes = common.saved(nodes.unionByName(root), f"{where}/nodes")
    kids = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("kids"), F.bit_xor("conv_id").alias("kx"), F.bit_xor("depth").alias("ky"))
    nodes = nodes.join(kids, KEY, "left").withColumns({c: F.coalesce(c, zero) for c in ("kids", "kx", "ky")})
    nodes = common.saved(nodes, f"{where}/counted")
    parents = nodes.filter("kids > 0").select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("kids").alias("n"), F.col("conv_id").alias("parent_conv_id"))
    placed = common.join_split(nodes.filter("depth > 0"), common.saved(parents, f"{where}/parents"), ["depth", "pa", "pb"]).unionByName(nodes.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    placed = common.saved(placed.drop("pa", "pb"), f"{where}/placed")
    tree = placed.select(
        F.col("conv_id").alias("c"), F.col("depth").alias("d"), F.col("parent_conv_id").alias("pc"), F.when(F.col("parent_conv_id").isNotNull(), F.col("depth") - 1).alias("pd"), "kids", "kx", "ky",
        (F.col("kids") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"),
    )
    totals = subtree_totals(tree, where, ["n_leaves", "saved_tokens"]).select(F.col("c").alias("conv_id"), F.col("d").alias("depth"), "n_leaves", "saved_tokens")
    ends = turns.filter("last").select(*KEY, "conv_id").unionByName(convs.filter("size = 0").select(*[zero.alias(c) for c in KEY], "conv_id"))
    out = placed.join(_digests(ends, where), KEY, "left").join(totals, ["conv_id", "depth"])
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("kids").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
