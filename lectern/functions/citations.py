"""Column functions for citations: heads such as -Z/1/40/1, headers [a][b][c][d], dotted forms, titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import strip

#: Columns of a division, from the outermost level.
LEVELS = ("epistle", "fragment", "volume", "book", "chapter", "section", "page", "line")
#: Parts of a level name and the column they mean, in this order.
LEVEL_PARTS = (("vol", "volume"), ("pag", "page"), ("sec", "section"), ("cha", "chapter"), ("pla", "chapter"), ("lin", "line"), ("fra", "fragment"), ("boo", "book"))
DEFAULT_LEVELS = ("Chapter", "Line")
#: Dotted forms and the names of their groups, in this order.
DOTTED = (
    (r"\[(\w*)\]\s*\[(\w*)\]\s*\[(\w*)\]\s*\[(\w*)\]", ("author_id", "work_id", "division", "subdivision")),
    (r"\.t\.(\d+)", ("title_number",)),
    (r"\.(\d+)\.(\d+)", ("chapter", "line")),
    (r"(\d+)\.(\d+)\.t(\d+)", ("volume", "chapter", "title_number")),
    (r"(\d+)\.(\d+)\.(\d+)", ("volume", "chapter", "line")),
    (r"([a-zA-Z\d]+)?\.([a-zA-Z\d]+)?\.([a-zA-Z\d]+)?", ("volume", "chapter", "line")),
    (r"\.([a-zA-Z])\.([a-zA-Z\d]+)", ("volume", "line")),
    (r"(\d+)\.(\d+)\.(\d+)\.(\d+)", ("volume", "chapter", "subdivision", "line")),
)
_HEAD = r"^-Z/*([^\t{]*)"


def is_metadata(line: Column) -> Column:
    return line.startswith("[") & line.contains("]")


def metadata(line: Column) -> Column:
    """author, work, division and subdivision of a header; null where it has fewer than two."""
    parts = F.regexp_extract_all(line, F.lit(r"\[(\w+)\]"), F.lit(1))
    fields = [F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(("author", "work", "division", "subdivision"))]
    return F.when(is_metadata(line) & (F.size(parts) >= 2), F.struct(*fields))


def has_citation(line: Column) -> Column:
    return line.rlike("^-Z")


def citation_fields(line: Column) -> Column:
    """The fields between slashes, without empty ones."""
    return F.filter(F.transform(F.split(F.regexp_extract(line, _HEAD, 1), "/"), strip), lambda x: x != "")


def citation_rest(line: Column) -> Column:
    """What follows the head."""
    return F.when(has_citation(line), strip(F.regexp_replace(line, _HEAD, ""))).otherwise(strip(line))


def citation_levels(line: Column, levels: Column, strict: bool = False) -> Column:
    """Map from level name to value. Fewer fields than levels fill the last levels; with strict the first, and one field is none."""
    fields = F.filter(citation_fields(line), lambda x: ~x.rlike(r"^t\d*$"))
    n, m = F.size(fields), F.size(levels)
    used = F.least(n, m)
    first = F.when(F.lit(strict), F.lit(1)).otherwise(m - used + 1)
    found = F.map_from_arrays(F.slice(levels, first, used), F.slice(fields, F.lit(1), used))
    return F.when(has_citation(line) & (used > 0) & (~F.lit(strict) | (n >= 2)), found)


def title(line: Column) -> Column:
    """title_number of markers t, tN, t/N and XtN; a bare t is 1; null for other lines."""
    head = F.regexp_extract(line, _HEAD, 1)
    number = F.regexp_extract(head, r"(?:^|/|\d)t/?(\d*)\s*$", 1)
    return F.when(head.rlike(r"(?:^|/|\d)t/?\d*\s*$"), F.when(number == "", "1").otherwise(number))


def dotted(line: Column) -> Column:
    """form (number of the form), label "Name value, …: " of its groups that have a value, and rest of the line, of the first dotted form that stands at the start; null where none does."""
    out = F.lit(None).cast("struct<form:int,label:string,rest:string>")
    for i, (form, names) in reversed(list(enumerate(DOTTED))):
        pattern = f"^(?U:{form})"
        values = [F.concat(F.lit(f"{n.capitalize()} "), F.nullif(F.regexp_extract(line, pattern, k + 1), F.lit(""))) for k, n in enumerate(names)]
        found = F.struct(F.lit(i).alias("form"), F.concat(F.concat_ws(", ", *values), F.lit(": ")).alias("label"), strip(F.regexp_replace(line, pattern, "")).alias("rest"))
        out = F.when(line.rlike(pattern), found).otherwise(out)
    return out


def _by_part(low: Column) -> Column:
    """The column of the first part that a name has; null where it has none."""
    out = F.when(F.lit(False), F.lit(""))
    for part, column in LEVEL_PARTS:
        out = out.when(low.contains(part), F.lit(column))
    return out


def level_column(name: Column, structure: Column) -> Column:
    """The column for a level name: the name itself, or by a part of it; else by the levels of the structure: chapter beside a play, book beside a book, the column of the
    first level that has a part; else chapter."""
    low = F.lower(strip(name))
    levels = F.transform(structure, F.lower)
    first = F.get(F.array_compact(F.transform(levels, _by_part)), F.lit(0))
    beside = F.when(F.array_contains(levels, "play"), F.lit("chapter")).when(F.array_contains(levels, "book"), F.lit("book")).otherwise(first)
    return F.coalesce(F.when(low.isin(*LEVELS), low), _by_part(low), beside, F.lit("chapter"))


def cites(citations: Column, author_id: Column | str, work_id: Column | str) -> Column:
    """Whether a JSON array of citations (or a single one) has a citation whose source has both ids. Text that is no JSON, and a null, cite nothing; an id that is a number is compared as text."""
    read = F.from_json(citations, "array<struct<source:struct<author_id:string,work_id:string>>>")
    own = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.coalesce(F.exists(read, lambda c: F.coalesce((c["source"]["author_id"] == own(author_id)) & (c["source"]["work_id"] == own(work_id)), F.lit(False))), F.lit(False))


def format_raw(values: Column, size: int = 4) -> Column:
    """-Z/a/b/…, padded with empty levels on the left to ``size``."""
    padded = F.concat(F.array_repeat(F.lit(""), F.greatest(F.lit(0), F.lit(size) - F.size(values))), values)
    return F.concat(F.lit("-Z/"), F.array_join(padded, "/"))


def abbreviate_author(name: Column) -> Column:
    """First three letters and a stop, with a last word of at most four letters."""
    words = F.split(strip(name), r"\s+")
    last = F.element_at(words, -1)
    tail = F.when((F.size(words) > 1) & (F.length(last) <= 4), F.concat(F.lit(" "), last)).otherwise(F.lit(""))
    return F.concat(F.substring(F.get(words, F.lit(0)), 1, 3), F.lit("."), tail)


#: Words that give no initial.
SMALL_WORDS = ("de", "in", "et", "ad", "the", "a", "an")


def abbreviate_work(name: Column) -> Column:
    """Initials of the words that aren't small, in capitals; of small words alone the first three letters; and a stop."""
    words = F.filter(F.split(strip(name), r"\s+"), lambda w: (w != "") & ~F.lower(w).isin(*SMALL_WORDS))
    initials = F.array_join(F.transform(words, lambda w: F.upper(F.substring(w, 1, 1))), "")
    return F.concat(F.when(F.size(words) > 0, initials).otherwise(F.initcap(F.substring(F.split_part(strip(name), F.lit(" "), F.lit(1)), 1, 3))), F.lit("."))


def abbreviate_citation(author: Column, work: Column, numbers: Column, **levels: Column) -> Column:
    """"Aut. W.v.c.a-b": author and work abbreviated, then the levels that aren't null or empty, and the lines."""
    order = ("fragment", "volume", "book", "chapter", "page", "section")
    parts = [F.concat(F.lit("."), F.nullif(levels[n].cast("string"), F.lit(""))) for n in order if n in levels]
    first, last = F.array_min(numbers), F.array_max(numbers)
    line = F.when(F.size(numbers) > 1, F.concat(F.lit("."), first, F.lit("-"), last)).when(F.size(numbers) == 1, F.concat(F.lit("."), first))
    return strip(F.concat_ws("", F.coalesce(abbreviate_author(author), F.lit("")), F.lit(" "), F.coalesce(abbreviate_work(work), F.lit("")), *parts, line))


def format_levels(numbers: Column, **levels: Column) -> Column:
    """"Volume v, Book b, … , Line a-b" of the levels that aren't null or empty."""
    order = ("fragment", "volume", "book", "chapter", "page", "section")
    parts = [F.concat(F.lit(f"{n.capitalize()} "), F.nullif(levels[n].cast("string"), F.lit(""))) for n in order if n in levels]
    first, last = F.array_min(numbers), F.array_max(numbers)
    line = F.when(F.size(numbers) > 1, F.concat(F.lit("Line "), first, F.lit("-"), last)).when(F.size(numbers) == 1, F.concat(F.lit("Line "), first))
    return F.concat_ws(", ", *parts, line)
