"""Column functions that clean and normalise text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs that stand for an apostrophe, and the one that replaces them.
APOSTROPHES = "'’‘`´᾽"
APOSTROPHE = "ʼ"
#: Letters of trailing numeral marks.
NUMERALS = "κδʹμηοβϞστχ"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is worked out once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """White space of any kind as single spaces, none at the ends. A single space is no match, so most texts are only looked at."""
    return F.trim(F.regexp_replace(c, r"(?U)[^\S ]\s*| \s+", " "))


def clean_text(c: Column) -> Column:
    """Without braces, one apostrophe, words joined over line ends, single spaces."""
    c = F.regexp_replace(c, "[{}]", "")
    c = F.regexp_replace(c, f"[{APOSTROPHES}]", APOSTROPHE)
    return collapse(F.regexp_replace(c, "-\n", ""))


def normalize_line(content: Column, is_title: Column) -> Column:
    """Body lines lose braces and trailing numeral marks; all lines get single spaces."""
    body = F.regexp_replace(F.regexp_replace(content, "[{}]", ""), rf"(?U)\s+[{NUMERALS}]+$", "")
    return collapse(F.when(is_title, content).otherwise(body))


def clean_special_content(c: Column) -> Column:
    """Lines without letters go, heads such as 1.2.[t3]. go from lines, and the rest is joined by spaces."""
    lines = F.transform(F.split(c, "\n"), lambda x: strip(F.regexp_replace(x, r"^\s*\d+\.\d+\.(?:\[?t\d+\]?\.)?", "")))
    return F.array_join(F.filter(lines, lambda x: ~x.rlike(r"(?U)^[\d\W]*$")), " ")


def strip_ref_tags(c: Column, tag: str = "tlg_ref") -> Column:
    return F.regexp_replace(c, rf"(?s)<{tag}>.*?</{tag}>", "")


def rejoin_split_words(c: Column, tag: str = "tlg_ref") -> Column:
    """word-<ref>…</ref>rest becomes wordrest<ref>…</ref>."""
    return F.regexp_replace(c, rf"(?sU)(\w+)-\s*(<{tag}>.*?</{tag}>)\s*(\w+)", "$1$3$2")


def normalize_work_name(c: Column) -> Column:
    """Without a leading number, +$%, and what brackets and parentheses hold (a parenthesis may lack its end); lower case, single spaces."""
    c = F.regexp_replace(strip(c), r"^\d+\.?\s*", "")
    c = F.regexp_replace(c, r"[+$%]|\[[^\]]*\]|\([^)]*\)?", "")
    return F.lower(collapse(c))


def leading_number(c: Column) -> Column:
    """The number at the head of what stands before a tab: 12a is 12; null without one."""
    return F.regexp_extract(F.split_part(c, F.lit("\t"), F.lit(1)), r"^\s*(\d+)[a-z]?", 1).try_cast("int")


def repaired_line_number(number: Column, content: Column) -> Column:
    """The number in .N.(N). of the content where it differs from a number that isn't zero."""
    inside = F.regexp_extract(content, r"\.(\d+)\.\(\1\)\.", 1).try_cast("int")
    return F.when(inside.isNotNull() & (number != 0) & (inside != number), inside).otherwise(number)


def simple_sentences(c: Column) -> Column:
    """Parts between full stops, bars and middle dots, without empty ones."""
    return F.filter(F.transform(F.split(c, "[.|·]"), strip), lambda x: x != "")
