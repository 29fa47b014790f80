"""Checks of content and of the relations between tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import once

MOST_CHARS = 500_000
#: Character ranges of the scripts that are told apart, and the names of scripts that may be asked for.
SCRIPTS = {"greek": r"Ͱ-Ͽἀ-῿", "arabic": r"؀-ۿݐ-ݿ", "chinese": r"一-鿿", "latin": "\x00-\xff", "cyrillic": r"Ѐ-ӿ"}
KNOWN_SCRIPTS = ("greek", "arabic", "chinese", "english", "latin", "cyrillic", "mixed")


def content_warnings(c: Column, most: int = MOST_CHARS) -> Column:
    """Names of the warnings for a content; empty content has that one only."""
    kinds = sum((F.when(c.rlike(p), 1).otherwise(0) for p in (r"\p{L}", r"\p{Nd}", r"(?U)\s", r"[^\x00-\x7F]")), F.lit(0))
    more = F.array_compact(F.array(F.when(F.length(c) > most, "content_length"), F.when(kinds < 2, "limited_character_diversity")))
    return F.when(c.isNull() | ~c.rlike(r"(?U)\S"), F.array(F.lit("empty_content"))).otherwise(more)


def script_share(c: Column, script: str) -> Column:
    """Per cent of the characters that are of the script."""
    n = F.length(c)
    return F.when(n > 0, 100.0 * (n - F.length(F.regexp_replace(c, f"[{SCRIPTS[script]}]+", ""))) / n).otherwise(0.0)


def script_checks(c: Column, asked: Column) -> Column:
    """shares, by script, and warnings of a content, for which each share is worked out once."""
    shares = F.struct(*[script_share(c, s).alias(s) for s in SCRIPTS])
    return once(shares, lambda x: F.struct(x.alias("shares"), _warnings(x, asked).alias("warnings")))


def script_warnings(c: Column, asked: Column) -> Column:
    """Warnings of a content: a script's name that isn't known, and scripts that few characters are of, with their share."""
    return script_checks(c, asked)["warnings"]


def _warnings(shares: Column, asked: Column) -> Column:
    few = F.array_compact(F.array(*[F.when((shares[s] > 0) & (shares[s] < 10), F.concat(F.lit(f"{s}: "), F.format_string("%.2f%%", shares[s]))) for s in SCRIPTS]))
    mixed = F.when(F.size(few) > 0, F.concat(F.lit("mixed_script_distribution: "), F.array_join(few, ", ")))
    return F.array_compact(F.array(F.when(~asked.isin(*KNOWN_SCRIPTS), F.concat(F.lit("script_validation: "), asked)), mixed))


def completeness(texts: DataFrame, divisions: DataFrame, lines: DataFrame) -> DataFrame:
    """(type, work_id, message, details): texts without divisions, and texts with divisions, other than titles, that have no lines, which details lists.

    texts: text_id, reference; divisions: division_id, text_id, is_title, volume, chapter; lines: division_id.
    """
    bare = texts.join(divisions.select("text_id").distinct(), "text_id", "left_anti")
    none = F.lit(None).cast("string")
    one = bare.select(F.lit("text_without_divisions").alias("type"), F.col("reference").alias("work_id"), F.concat(F.lit("Text "), "text_id", F.lit(" contains no divisions")).alias("message"), none.alias("details"))
    empty = divisions.filter(~F.col("is_title")).join(lines.select("division_id").distinct(), "division_id", "left_anti")
    own = empty.groupBy("text_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("division_id", "volume", "chapter"))).alias("d")).join(texts, "text_id")
    shown = F.array_join(F.transform("d", lambda x: F.concat_ws(".", F.col("reference"), x["volume"].cast("string"), x["chapter"].cast("string"))), ",")
    more = own.select(F.lit("divisions_without_lines").alias("type"), F.col("reference").alias("work_id"), F.concat(F.lit("Text "), "text_id", F.lit(" has "), "n", F.lit(" divisions with no lines")).alias("message"), shown.alias("details"))
    return one.unionByName(more)


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Child rows whose key is null or has no parent."""
    return child.join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def missing_fields(*columns: str) -> Column:
    """Names of the columns that are null or empty."""
    return F.array_compact(F.array(*[F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(c)) for c in columns]))


def nearby_lines(empty: DataFrame, lines: DataFrame, levels: tuple[str, ...], most: int = 20) -> DataFrame:
    """For each empty division up to ``most`` lines of its text that share a level: an equi-join on (text, level, value)."""
    from pyspark.sql import Window

    def spread(df: DataFrame) -> DataFrame:
        pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.col(x).cast("string").alias("value")) for x in levels]))
        return df.withColumn("__p", pairs).withColumns({"level": F.col("__p.level"), "value": F.col("__p.value")}).filter("value is not null").drop("__p", *levels)

    # The first lines of a text's level value are the same for every empty division of it, so they are ranked before the join.
    ranked = spread(lines.select("text_id", "line_id", "line_number", *levels))
    first = F.row_number().over(Window.partitionBy("text_id", "level", "value").orderBy("line_number", "line_id"))
    ranked = ranked.withColumn("__r", first).filter(F.col("__r") <= most).drop("__r")
    found = spread(empty.select(F.col("division_id").alias("empty_id"), "text_id", *levels)).join(ranked, ["text_id", "level", "value"])
    found = found.select("empty_id", "line_id", "line_number").distinct()
    place = F.row_number().over(Window.partitionBy("empty_id").orderBy("line_number", "line_id"))
    return found.withColumn("place", place).filter(F.col("place") <= most)
