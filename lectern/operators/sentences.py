"""Sentences from lines, and the lines that each sentence touches. Nothing crosses a division."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import once

_END = r"[^\s][.·]$"


def _pieces(lines: Column, *carry: str) -> Column:
    """The lines of a division with ``piece``: what each adds to the text of its division.

    A line is joined with a space, unless the one before ends with a hyphen, which goes, or the line
    starts with punctuation; after the end of a sentence there is always a space.
    """

    def piece(x: Column, i: Column) -> Column:
        before, after, content = F.get(lines, i - 1)["content"], F.get(lines, i + 1)["content"], x["content"]
        gap = F.when(before.isNull() | before.endswith("-"), "").when(_ends(before, _END), " ").when(content.rlike("^[.,;:·]"), "").otherwise(" ")
        own = F.when(content.endswith("-") & after.isNotNull(), F.left(content, F.length(content) - 1)).otherwise(content)
        return F.struct(x["line_number"].cast("int").alias("number"), x["line_id"].cast("long").alias("id"), F.concat(gap, own).alias("piece"), *[x[c].alias(c) for c in carry])

    return F.transform(lines, piece)


def _ends(c: Column, form: str) -> Column:
    """Whether the end of the text, of two signs and a line end at most, has the form; the rest isn't looked at."""
    return F.right(c, F.lit(4)).rlike(form)


def _field(name: str) -> Callable[[Column], Column]:
    """The field of an entry, for transform, which gives a second parameter the place, be it one with a default."""
    return lambda x: x[name]


def _with_period(part: Column) -> Column:
    return F.when(_ends(part, r"[.·]$"), part).otherwise(F.concat(part, F.lit(".")))


def _parts(pieces: Column) -> Column:
    """The sentences of a division's pieces, as they stand there."""
    return F.filter(F.split(F.array_join(F.transform(pieces, lambda x: x["piece"]), ""), r"\s(?<=[^\s][.·]\s)\s*"), lambda x: x != "")


def _texts(pieces: Column) -> Column:
    return F.transform(_parts(pieces), _with_period)


def by_division(lines: DataFrame, keep: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> DataFrame:
    """division_id, the columns of keep, and lines: the division's lines that aren't titles, in order, as (line_number, line_id, content, and the columns of carry)."""
    fields = dict.fromkeys(("line_number", "line_id", "content", *carry))
    listed = F.sort_array(F.collect_list(F.struct(*fields)))
    return lines.filter(~F.col("is_title")).groupBy("division_id").agg(listed.alias("lines"), *[F.any_value(c).alias(c) for c in keep])


def cited_sentences(lines: DataFrame, keep: tuple[str, ...] = (), *, append_period: bool = True, with_lines: bool = False, with_places: bool = True) -> DataFrame:
    """:func:`of_divisions` of single lines, which are put together by division; with with_lines there is also lines, the texts of the lines in the order of line_ids.

    keep: columns that are the same for all lines of a division.
    """
    carry = {"content": "lines"} if with_lines else {}
    return of_divisions(by_division(lines, keep), keep, append_period=append_period, carry=carry, with_places=with_places)


def of_divisions(divisions: DataFrame, keep: tuple[str, ...] = (), *, append_period: bool = True, carry: dict[str, str] | None = None, with_places: bool = True) -> DataFrame:
    """division_id, keep, k, content, starts, ends, line_ids and line_numbers: sentences end after a stop or middle dot that follows a sign and precedes a space, and have
    the lines that each touches. Nothing is shuffled.

    divisions: division_id and lines, as of :func:`by_division`. A division's lines are few, so their places travel as an array. carry: columns of the lines that sentences have
    as arrays in the order of line_ids, with their names there; without with_places there is nothing of the lines, and their places aren't worked out.
    """
    joined, placed, places = _placed(divisions, keep, carry or {}, with_places)
    # All of a division is worked out in the array that is exploded, so once a division; a column beside it would be worked out again for each sentence.
    rows = joined.select("division_id", *keep, F.posexplode(placed).alias("i", "x"))
    content = _with_period(F.col("x.part")) if append_period else F.col("x.part")
    return rows.select("division_id", *keep, (F.col("i") + 1).alias("k"), content.alias("content"), F.col("x.starts").cast("long").alias("starts"), F.col("x.ends").cast("long").alias("ends"), *[F.col(f"x.{c}").alias(c) for c in places])


def lists_of_divisions(divisions: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """division_id, keep, and sentences: (content, line_numbers) of the division's sentences in order, in one row."""
    joined, placed, _ = _placed(divisions, keep, {}, True)
    return joined.select("division_id", *keep, F.transform(placed, lambda x: F.struct(_with_period(x["part"]).alias("content"), x["line_numbers"].alias("line_numbers"))).alias("sentences"))


def _placed(divisions: DataFrame, keep: tuple[str, ...], carry: dict[str, str], with_places: bool) -> tuple[DataFrame, Column, list[str]]:
    """Divisions with the pieces of their lines, the array of their sentences that is made of these, and its fields beside starts, ends and part."""
    joined = divisions.select("division_id", *keep, _pieces(F.col("lines"), *carry).alias("p"))
    kinds = {f.name: f.dataType.simpleString() for f in joined.schema["p"].dataType.elementType.fields}
    none = F.array().cast(f"array<struct<s:int,e:int,id:bigint,number:int{''.join(f',{n}:{kinds[c]}' for c, n in carry.items())}>>")

    def lay(acc, x):
        e = acc["at"] + F.length(x["piece"])
        one = F.struct((acc["at"] + F.when(x["piece"].startswith(" "), 1).otherwise(0)).alias("s"), e.alias("e"), x["id"].alias("id"), x["number"].alias("number"), *[x[c].alias(n) for c, n in carry.items()])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    spans = F.aggregate("p", F.struct(F.lit(0).alias("at"), none.alias("out")), lay, lambda acc: acc["out"])

    def place(acc, x):
        e = acc["at"] + F.length(x)
        return F.struct((e + 1).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("starts"), e.alias("ends"), x.alias("part")))).alias("out"))

    def touching(x, t):
        """A sentence with what its lines have."""
        numbers = F.sort_array(F.array_distinct(F.transform(t, lambda y: y["number"])))
        return F.struct(x["starts"].alias("starts"), x["ends"].alias("ends"), x["part"].alias("part"), F.transform(t, lambda y: y["id"]).alias("line_ids"), numbers.alias("line_numbers"), *[F.transform(t, _field(n)).alias(n) for n in carry.values()])

    placed = F.aggregate(_parts(F.col("p")), F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<starts:int,ends:int,part:string>>").alias("out")), place, lambda acc: acc["out"])
    if not with_places:
        return joined, placed, []
    touched = once(spans, lambda s: F.transform(placed, lambda x: once(F.filter(s, lambda y: (y["s"] < x["ends"]) & (x["starts"] < y["e"])), lambda t: touching(x, t))))
    return joined, touched, ["line_ids", "line_numbers", *carry.values()]


def texts_of_divisions(divisions: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """division_id, keep, and sentences: the division's sentences in order, without their places.

    Explode an expression of them, not the column: Spark puts a filter on the size of a column that is exploded below the lines, where they are worked out again for every line.
    """
    joined = divisions.select("division_id", *keep, _pieces(F.col("lines")).alias("p"))
    return joined.select("division_id", *keep, _texts(F.col("p")).alias("sentences"))


def contents(divisions: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """division_id, keep, k and content of the divisions' sentences, without their places."""
    joined = divisions.select("division_id", *keep, _pieces(F.col("lines")).alias("p"))
    rows = joined.select("division_id", *keep, F.posexplode(_texts(F.col("p"))).alias("i", "content"))
    return rows.select("division_id", *keep, (F.col("i") + 1).alias("k"), "content")


def sentences_per_line(links: DataFrame) -> DataFrame:
    """Each line's sentences, in order."""
    return links.groupBy("line_id").agg(F.array_sort(F.collect_list("sentence_id")).alias("sentence_ids"))


def overlapping_neighbours(sentences: DataFrame) -> DataFrame:
    """sentence_id, prev_id and next_id: the nearest sentences before and after that share a line, of the sentences that have lines (sentence_id, division_id, line_ids).

    A line that two sentences share is also one of all between them, so only the sentence beside is looked at, in one window by division.
    """
    w = Window.partitionBy("division_id").orderBy("sentence_id")
    own = sentences.filter(F.size("line_ids") > 0).select("sentence_id", "division_id", F.get("line_ids", F.lit(0)).alias("a"), F.element_at("line_ids", -1).alias("b"))
    before, after = F.when(F.lag("b").over(w) == F.col("a"), F.lag("sentence_id").over(w)), F.when(F.lead("a").over(w) == F.col("b"), F.lead("sentence_id").over(w))
    return own.select("sentence_id", before.alias("prev_id"), after.alias("next_id"))


def sentence_line_numbers(links: DataFrame) -> DataFrame:
    """Each sentence's line numbers, sorted and without repetition, and the first."""
    return links.groupBy("sentence_id", "division_id").agg(F.array_sort(F.collect_set("line_number")).alias("line_numbers"), F.min("line_number").alias("first_line"))


def merge_hyphen_lines(lines: DataFrame) -> DataFrame:
    """Lines that end with a hyphen take in the next one, in chains, and keep the first line's number."""
    w = Window.partitionBy("division_id").orderBy("line_number")
    broken = F.lag("content").over(w).endswith("-")
    rows = lines.withColumn("__new", F.when(F.coalesce(broken, F.lit(False)), 0).otherwise(1)).withColumn("__island", F.sum("__new").over(w))
    piece = F.regexp_replace("content", "-$", "")
    last = F.max_by("content", "line_number")
    merged = rows.groupBy("division_id", "__island").agg(F.min("line_number").alias("line_number"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_number", piece.alias("x")))), lambda y: y["x"]), "").alias("t"), F.count("*").alias("n_lines"), last.alias("last"))
    return merged.select("division_id", "line_number", "n_lines", F.when(F.col("last").endswith("-"), F.concat("t", F.lit("-"))).otherwise(F.col("t")).alias("content"))
