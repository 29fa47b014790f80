"""Works: their level structures, names that are nearly alike, names from indexes, division keys and line numbers."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from lectern.functions import citations as C
from lectern.functions import text as T

#: Levels that stand in for the one above the line, in this order.
STAND_IN = ("page", "chapter", "section", "book", "volume")
EDITS, RATIO = 3, 0.2


def resolve_structures(works: DataFrame, names: DataFrame, structures: DataFrame) -> DataFrame:
    """works (author_id, work_id, …) with levels and missed: what of (author, name, structure) is unknown, null where all is known.

    names: author_id, work_id, work_name; structures: author_id, work_name, levels. Both are small tables of one row a work; names are compared in normal form.
    """
    own = names.select("author_id", "work_id", T.normalize_work_name(F.col("work_name")).alias("__name"))
    known = structures.select("author_id", T.normalize_work_name(F.col("work_name")).alias("__name"), "levels").dropDuplicates(["author_id", "__name"])
    authors = names.select("author_id").distinct().withColumn("__author", F.lit(True))
    rows = works.join(authors, "author_id", "left").join(own, ["author_id", "work_id"], "left").join(known, ["author_id", "__name"], "left")
    missed = F.when(F.col("__author").isNull(), "author").when(F.col("__name").isNull(), "work").when(F.col("levels").isNull(), "structure")
    default = F.array(*map(F.lit, C.DEFAULT_LEVELS))
    return rows.withColumns({"missed": missed, "levels": F.coalesce("levels", default)}).drop("__author", "__name")


@F.pandas_udf(StructType([StructField("plain", StringType()), StructField("letters", StringType())]))
def folded(name: pd.Series) -> pd.DataFrame:
    """Names in decomposed lower case, and their letters: without signs and white space."""
    plain = name.map(lambda t: unicodedata.normalize("NFKD", t.lower()), na_action="ignore")
    letters = plain.map(lambda t: "".join(c for c in t if not (c.isspace() or unicodedata.category(c)[0] == "P")), na_action="ignore")
    return pd.DataFrame({"plain": plain, "letters": letters})


#: A sign of the asked name: it may stand for a space or for nothing.
_GAP = -1


def _elements(name: str) -> list[int]:
    """The signs of an asked name that a part of an indexed one has to have: a gap for punctuation, unless a space is beside it, which it belongs to."""
    out: list[int] = []
    for c in name:
        x = _GAP if unicodedata.category(c)[0] == "P" else 32 if c.isspace() else ord(c)
        if x in (_GAP, 32) and out and out[-1] in (_GAP, 32):
            out[-1] = max(out[-1], x)
        else:
            out.append(x)
    return out


def _padded(rows: list[list[int]], pad: int) -> np.ndarray:
    out = np.full((len(rows), max(map(len, rows), default=0)), pad, np.int32)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def nearest_part(asked: list[str], names: list[str]) -> np.ndarray:
    """Of each pair, the fewest edits that make the asked name a part of the other: one row of the table of edits for all pairs at a time."""
    q, m = _padded([_elements(a) for a in asked], -3), _padded([[ord(c) for c in n] for n in names], -2)
    inside = np.arange(m.shape[1] + 1) <= np.asarray([[len(n)] for n in names])
    step = np.arange(m.shape[1] + 1, dtype=np.int32)
    row = np.zeros((len(q), m.shape[1] + 1), np.int32)
    for k in range(q.shape[1]):
        x = q[:, k : k + 1]
        skip = np.where(x == _GAP, row, row + 1)
        onto = row[:, :-1] + np.where(x == _GAP, np.where(m == 32, 0, 2), m != x)
        new = np.concatenate([skip[:, :1], np.minimum(skip[:, 1:], onto)], axis=1)
        new = np.minimum.accumulate(new - step, axis=1) + step  # a sign more in the name
        row = np.where(x == -3, row, new)
    return np.where(inside, row, np.iinfo(np.int32).max).min(1, initial=np.iinfo(np.int32).max)


#: Cells of the tables of edits of one lot of pairs.
_CELLS = 1 << 21


@F.pandas_udf(IntegerType())
def part_edits(asked: pd.Series, names: pd.Series) -> pd.Series:
    """The edits of :func:`nearest_part`, for lots of pairs of about as long names."""
    size = names.str.len().to_numpy()
    order, out, at = np.argsort(size, kind="stable"), np.empty(len(size), np.int64), 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * (size[order[end]] + 1) <= _CELLS:
            end += 1
        lot = order[at:end]
        out[lot] = nearest_part(asked.iloc[lot].tolist(), names.iloc[lot].tolist())
        at = end
    return pd.Series(out)


#: Longs of a name's bag of letters.
_WORDS = 4


def bag(letters: Column) -> Column:
    """Longs of bits for a name's letters with their counts: the k-th of a letter has a bit, so of an asked name no more bits may be missing in another than the asked name has edits."""

    def bits(own: Column) -> Column:
        return F.transform(own, lambda c, i: F.pmod(F.xxhash64(c, i - F.array_position(own, c)), F.lit(64 * _WORDS)).cast("int"))

    def word(own: Column, w: int) -> Column:
        one = lambda acc, x: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(64)).cast("int")))
        return F.aggregate(F.filter(own, lambda x: F.floor(x / 64) == w), F.lit(0).cast("long"), one)

    each = F.array_sort(F.filter(F.split(letters, ""), lambda c: c != ""))
    return T.once(T.once(each, bits), lambda own: F.array(*[word(own, w) for w in range(_WORDS)]))


def lacking(asked: Column, other: Column) -> Column:
    """How many bits of the asked name's bag the other doesn't have."""
    return sum((F.bit_count(F.get(asked, F.lit(w)).bitwiseAND(F.bitwise_not(F.get(other, F.lit(w))))) for w in range(_WORDS)), F.lit(0))


def match_names(asked: DataFrame, index: DataFrame, *, by: str, name: str, order: str | None = None, edits: int = EDITS, ratio: float = RATIO) -> DataFrame:
    """by, name, match: of each distinct asked name the equal one of the index; else, of those of which a part is the asked name but for so many edits and whose
    length is within the ratio of its, the one nearest in length, then the first in the index (column order; else by name).

    Punctuation of the asked name may stand for a space or nothing; case and the composition of letters don't count. Null and empty names match nothing.

    Cut into edits + 1 pieces, an asked name has one unchanged piece in a name that it is near to, so candidates meet by equal
    starts of pieces at possible places, of a length that is a power of two; names of fewer letters than pieces meet all of their author's of such a length.
    Of the names that meet in a frequent piece those go on that lack no more of the asked letters than there are edits, which a few bits of both tell. Both
    sides are dealt out by piece, so none passes through the driver.
    """
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = lambda rows, short, *more: rows.select(by, T.normalize_work_name(F.col(name)).alias(short), *more).filter(F.col(short) != "")
    a = own(asked, "q").distinct()
    i = own(index, "m", F.col(order or name).alias("at")).groupBy(by, "m").agg(F.min("at").alias("at"))
    exact = a.join(i.select(by, F.col("m").alias("q")), [by, "q"]).select(by, "q", F.col("q").alias("m"))
    left = a.join(exact.select(by, "q"), [by, "q"], "left_anti").withColumn("q_letters", folded("q")["letters"])
    i = i.withColumn("m_letters", folded("m")["letters"])
    n = edits + 1
    piece = F.floor(F.length("q_letters") / n)
    gram = F.when(piece >= 1, F.pow(F.lit(2), F.floor(F.log2(piece))).cast("int")).otherwise(0)
    starts = F.transform(F.sequence(F.lit(0), F.lit(edits)), lambda k: F.floor(F.length("q_letters") * k / n).cast("int"))
    left = left.select(by, "q", "q_letters", F.length("q_letters").alias("q_size"), gram.alias("gram"), bag(F.col("q_letters")).alias("q_bag"))
    lengths = left.select("gram").distinct()
    seeds = F.when(F.col("gram") > 0, F.transform(starts, lambda s: F.struct(s.alias("q_at"), F.substring(F.col("q_letters"), s + 1, F.col("gram")).alias("part")))).otherwise(F.array(F.struct(F.lit(0).alias("q_at"), F.lit("").alias("part"))))
    left = left.select("*", F.explode(seeds).alias("x")).select(*[c for c in left.columns if c != "q_letters"], "x.q_at", "x.part")
    i = i.select(by, "m", "m_letters", "at", F.length("m_letters").alias("m_size"), bag(F.col("m_letters")).alias("m_bag"))
    # Only pieces as long as some asked name has, which are a few powers of two.
    places = F.transform(F.when(F.col("gram") > 0, F.sequence(F.lit(0), F.greatest(F.length("m_letters") - F.col("gram"), F.lit(0)))).otherwise(F.array(F.lit(0))), lambda p: F.struct(p.alias("m_at"), F.substring(F.col("m_letters"), p + 1, F.col("gram")).alias("part")))
    i = i.crossJoin(F.broadcast(lengths)).select("*", F.explode(places).alias("x")).select(*[c for c in i.columns if c != "m_letters"], "gram", "x.m_at", "x.part")
    size = F.length("m") / F.length("q")
    fits = (F.col("gram") == 0) | ((F.col("m_at") >= F.col("q_at") - edits) & (F.col("m_size") - F.col("m_at") >= F.col("q_size") - F.col("q_at") - edits))
    keys = [by, "gram", "part"]
    pairs = left.repartition(parts, *keys).hint("merge").join(i.repartition(parts, *keys), keys).filter(fits & (lacking(F.col("q_bag"), F.col("m_bag")) <= edits) & size.between(1 - ratio, 1 + ratio)).select(by, "q", "m", "at")
    pairs = pairs.distinct().repartition(parts, by, "q")
    plain = lambda c: folded(c)["plain"]
    # Not to be moved below the distinct, where a pair comes once for every piece and place that it meets in.
    near = pairs.filter(part_edits.asNondeterministic()(plain("q"), plain("m")) <= edits).groupBy(by, "q").agg(F.min(F.struct(F.abs(1 - size).alias("off"), "at", "m"))["m"].alias("m"))
    return exact.unionByName(near).select(by, F.col("q").alias("name"), F.col("m").alias("match"))


def division_key(levels: Column, found: Column) -> Column:
    """(field, value) of the division of a citation: the level above the line, "1" without a value; else the first stand-in that has one; else the first level."""
    low = F.transform(levels, F.lower)
    at = F.array_position(low, "line").cast("int")
    by_field = F.map_from_entries(F.array_distinct(F.transform(F.map_entries(found), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))))
    above = C.level_column(F.try_element_at(low, at - 1), levels)
    direct = F.struct(above.alias("field"), F.coalesce(F.try_element_at(by_field, above), F.lit("1")).alias("value"))
    out = F.struct(C.level_column(F.get(low, F.lit(0)), levels).alias("field"), F.lit("1").alias("value"))
    for name in reversed(STAND_IN):
        value = F.try_element_at(by_field, F.lit(name))
        out = F.when(value.isNotNull(), F.struct(F.lit(name).alias("field"), value.alias("value"))).otherwise(out)
    return F.when(at > 1, direct).otherwise(out)


def number_lines(lines: DataFrame, *, by: str = "division_id", order: str = "n", cited: str = "cited") -> DataFrame:
    """lines with number: the cited one's digits, else the place in the division; lines with a cited one that is no number go."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return lines.withColumn("number", F.when(F.col(cited).isNull(), place).otherwise(T.leading_number(F.col(cited)))).filter("number is not null")


def key_of(*parts: Column | str) -> Column:
    """A long made of the parts' text, the same in every run and on every machine: the first 60 bits of their MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def _checked(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """rows, where no two keys are equal and none is one of the known ones; else an error."""
    taken = rows.select(key).unionByName(known.select(key).distinct()).groupBy(key).agg(F.count("*").alias("__n"))
    once = F.when(F.col("__n") == 1, F.col(key)).otherwise(F.raise_error(F.concat(F.lit(f"two rows have the {key} "), F.col(key))).cast("long"))
    return rows.join(taken, key).withColumn(key, once).drop("__n")


def create_dims(seen: DataFrame, authors: DataFrame, texts: DataFrame, *, make: Callable[..., Column] = key_of) -> tuple[DataFrame, DataFrame]:
    """The authors (author_id, author_code, author_name) and texts (text_id, author_id, author_code, work_code, title) of seen (author_code, work_code) that aren't
    in authors (author_id, author_code) and texts (text_id, author_code, work_code) yet, with placeholder names.

    Ids are made of the codes, so repeated runs give equal ids; two codes with one id, or an id that is taken, are an error. New texts of a known author get
    that author's id. Rows without a code are left out.
    """
    codes = seen.filter("author_code is not null").select("author_code").distinct()
    new = codes.join(authors.select("author_code"), "author_code", "left_anti").withColumn("author_id", make(F.lit("author"), "author_code"))
    new = _checked(new, authors, "author_id").withColumn("author_name", F.concat(F.lit("Author "), "author_code"))
    works = seen.filter("author_code is not null and work_code is not null").select("author_code", "work_code").distinct().join(texts.select("author_code", "work_code"), ["author_code", "work_code"], "left_anti")
    works = _checked(works.withColumn("text_id", make(F.lit("text"), "author_code", "work_code")), texts, "text_id")
    own = authors.select("author_code", "author_id").dropDuplicates(["author_code"]).unionByName(new.select("author_code", "author_id"))
    works = works.join(own, "author_code").withColumn("title", F.concat(F.lit("Work "), "work_code"))
    return new.select("author_id", "author_code", "author_name"), works.select("text_id", "author_id", "author_code", "work_code", "title")


def backfill_names(rows: DataFrame, names: DataFrame, keys: list[str], column: str, unknown: str) -> DataFrame:
    """rows with the names' value of column by key, unknown where there is none, and changed: whether it was another or null."""
    found = names.select(*keys, F.col(column).alias("__new"))
    joined = rows.join(found, keys, "left").withColumn("__new", F.coalesce("__new", F.lit(unknown)))
    return joined.withColumn("changed", ~F.col("__new").eqNullSafe(F.col(column))).withColumn(column, F.col("__new")).drop("__new")
