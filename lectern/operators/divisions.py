"""Sections, divisions and their citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import once
from lectern.operators.ranges import RANGE, in_ranges, scan


def ordered_text(order: str, text: str, gap: str) -> Column:
    """Aggregate: the texts of a group in order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), gap)


def mark_sections(rows: DataFrame, by: list[str], order: str, text: str, is_header: Column, where: str) -> DataFrame:
    """rows with section, header and is_header: each header opens a section, and what comes before the first is section 0, without a header.

    A file of any number of lines is scanned in ranges, so its lines stay spread; nothing of a section is put together here.
    """
    ranged = in_ranges(rows.withColumn("is_header", F.coalesce(is_header, F.lit(False))), [*by, order], where)
    head = F.when(F.col("is_header"), F.col(text))
    return scan(ranged, by, [order], {"section": ("sum", F.col("is_header").cast("long")), "header": ("last", head)}).drop(RANGE)


def split_sections(rows: DataFrame, by: str, order: str, text: str, is_header: Column, where: str) -> DataFrame:
    """by, section, header and body: the sections of :func:`mark_sections`, each with its lines in one text."""
    marked = mark_sections(rows.select(by, order, text, is_header.alias("__h")), [by], order, text, F.col("__h"), where)
    parts = marked.withColumn("body_part", F.when(~F.col("is_header"), F.col(text)))
    return parts.groupBy(by, "section").agg(F.max("header").alias("header"), ordered_text(order, "body_part", "\n").alias("body"))


def by_change(rows: DataFrame, by: list[str], order: str, value: str, where: str, name: str = "division") -> DataFrame:
    """rows with the number of their division: the first row of a group opens one, and so does each whose value isn't the one before; null is a value."""
    ranged = in_ranges(rows, [*by, order], where)
    seen = scan(ranged.withColumn("__value", F.struct(F.col(value).alias("v"))), by, [order], {"__before": ("previous", F.col("__value"))})
    opens = F.when(F.col("__before").eqNullSafe(F.col("__value")), 0).otherwise(1).cast("long")
    return scan(seen, by, [order], {name: ("sum", opens)}).drop(RANGE, "__value", "__before")


def build_divisions(lines: DataFrame) -> DataFrame:
    """One row a division: the last title with its number (title_number of the line), and the count of the lines that aren't titles."""
    body, last = ~F.col("is_title"), F.max(F.when(F.col("is_title"), F.struct("n", "content", "title_number")))
    return lines.groupBy("division_id").agg(F.bool_or("is_title").alias("has_title"), last["content"].alias("title_text"), last["title_number"].alias("title_number"), F.count_if(body).alias("n_lines"), F.min(F.when(body, F.col("n"))).alias("first_n"))


def division_citation(levels: Column, values: dict[str, Column]) -> Column:
    """"Level=value" in the order of the structure, without missing ones."""
    found = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])
    pairs = F.transform(levels, lambda k: F.concat(k, F.lit("="), F.try_element_at(found, k)))
    return F.array_join(F.array_compact(pairs), ",")


def sentence_citations(sentences: DataFrame, citations: str) -> DataFrame:
    """The first line's citation of each sentence that has lines, and the distinct further ones in order; citations: a column with those of its lines, in order."""
    listed = sentences.filter(F.size(citations) > 0).select("sentence_id", F.array_distinct(citations).alias("c"))
    return listed.select("sentence_id", F.get("c", F.lit(0)).alias("first_citation"), F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0))).alias("further"))


_HEADER = r"(?U)\[(\w*)\]\s*\[(\w*)\]\s*\[(\w*)\]\s*\[(\w*)\]"
#: Forms of the places in a tag; the first that the tag has counts.
_PLACES = (r"(?U)Volume (\w+), Chapter (\w+), Line (\w+)", r"(?U)Chapter (\w+), Line (\w+)", r"(?U)Line (\w+)")


def tag_places(payload: Column) -> Column:
    """"Volume v: Chapter c: Line a, Lines b-d, Chapter e: …, Volume w: …" of all places in a tag; empty where there is none.

    Volumes and chapters are in the order of their text, lines in that of their number (12a counts as 12), and a place that stands there twice counts once. A tag that names
    volumes is read by volume, chapter and line, else by chapter and line, else by line.
    """
    read = F.array().cast("array<struct<v:string,c:string,n:int>>")
    for depth, form in zip((1, 2, 3), reversed(_PLACES), strict=True):
        groups = [F.regexp_extract_all(payload, F.lit(form), F.lit(k + 1)) for k in range(depth)]
        part = lambda x, k, depth=depth: x[f"g{k + depth - 3}"] if k + depth >= 3 else F.lit(None).cast("string")
        found = F.transform(F.arrays_zip(*[g.alias(f"g{k}") for k, g in enumerate(groups)]), lambda x: F.struct(part(x, 0).alias("v"), part(x, 1).alias("c"), F.regexp_extract(part(x, 2), r"^(\d+)", 1).try_cast("int").alias("n")))  # noqa: B023
        read = F.when(payload.rlike(form), found).otherwise(read)
    return once(F.array_sort(F.array_distinct(F.filter(read, lambda x: x["n"].isNotNull()))), _runs)


def _runs(places: Column) -> Column:
    """Sorted places (v, c, n) as text: a run begins where the place before isn't the line before in the same chapter, and a heading where it isn't in the same volume or chapter."""
    before, after = lambda i: F.get(places, i - 1), lambda i: F.get(places, i + 1)
    follows = lambda x, y: F.coalesce(x["v"].eqNullSafe(y["v"]) & x["c"].eqNullSafe(y["c"]) & (x["n"] + 1 == y["n"]), F.lit(False))
    first = F.filter(places, lambda x, i: ~follows(before(i), x))
    last = F.transform(F.filter(places, lambda x, i: ~follows(x, after(i))), lambda x: x["n"])
    ends = once(last, lambda z: F.transform(first, lambda x, i: F.struct(x["v"].alias("v"), x["c"].alias("c"), x["n"].alias("a"), F.get(z, i).alias("b"))))

    def shown(runs: Column, x: Column, i: Column) -> Column:
        y = F.get(runs, i - 1)
        volume = (i > 0) & y["v"].eqNullSafe(x["v"])
        chapter = volume & y["c"].eqNullSafe(x["c"])
        line = F.when(x["a"] == x["b"], F.concat(F.lit("Line "), x["a"])).otherwise(F.concat(F.lit("Lines "), x["a"], F.lit("-"), x["b"]))
        return F.concat(F.when(volume | x["v"].isNull(), "").otherwise(F.concat(F.lit("Volume "), x["v"], F.lit(": "))), F.when(chapter | x["c"].isNull(), "").otherwise(F.concat(F.lit("Chapter "), x["c"], F.lit(": "))), line)

    return once(ends, lambda runs: F.array_join(F.transform(runs, lambda x, i: shown(runs, x, i)), ", "))


def replace_refs(rows: DataFrame, key: str, text: str, authors: DataFrame, works: DataFrame, tag: str = "tlg_ref") -> DataFrame:
    """key and text, with every tag that has a header [author] [work] [division] [subdivision] replaced by "Author, Work (division, subdivision), places: ".

    authors: author_id, author_name; works: author_id, work_id, work_name, one row a key; what they don't have is Unknown Author and Unknown Work. Tags of one text may cite
    different authors. Of a tag without a header the payload stays. A text without tags stays as it is; a null text is empty.
    """
    whole = rf"(?s)(.*?)(?:<{tag}>(.*?)</{tag}>|\z)"
    pieces = F.arrays_zip(F.regexp_extract_all(text, F.lit(whole), F.lit(1)).alias("gap"), F.regexp_extract_all(text, F.lit(whole), F.lit(2)).alias("ref"))
    parts = rows.select(key, F.posexplode_outer(pieces).alias("p", "x")).select(key, "p", F.coalesce("x.gap", F.lit("")).alias("gap"), F.coalesce("x.ref", F.lit("")).alias("ref"))
    field = lambda i: F.regexp_extract("ref", _HEADER, i)
    parts = parts.withColumns({"cited": F.col("ref").rlike(_HEADER), "author_id": field(1), "work_id": field(2), "division": field(3), "subdivision": field(4)})
    parts = parts.join(authors.select("author_id", "author_name"), "author_id", "left").join(works.select("author_id", "work_id", "work_name"), ["author_id", "work_id"], "left")
    inside = F.when((F.col("division") != "") | (F.col("subdivision") != ""), F.concat(F.lit(" ("), "division", F.lit(", "), "subdivision", F.lit(")"))).otherwise("")
    places = F.concat_ws("", F.lit(", "), tag_places(F.col("ref")))
    label = F.concat(F.coalesce("author_name", F.lit("Unknown Author")), F.lit(", "), F.coalesce("work_name", F.lit("Unknown Work")), inside, places)
    label = F.concat(F.regexp_replace(label, "^[, ]+|[, ]+$", ""), F.lit(": "))
    parts = parts.withColumn("t", F.concat("gap", F.when(F.col("cited"), label).otherwise(F.col("ref"))))
    return parts.groupBy(key).agg(ordered_text("p", "t", "").alias(text))
