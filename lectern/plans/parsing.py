"""Parsing, cleaning, sentences and token annotation over the derived corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import citations as C
from lectern.functions import text as T
from lectern.operators import context, divisions, search, sentences
from lectern.plans import views as V
from lectern.plans.registry import query
from lectern.plans.views import with_tables


def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as a file has them: -Z/volume/chapter/line, a tab, and the content; every third line has its number only."""
    rows = V.lines(spark, sf_dir)
    head = F.when(F.col("n") % 3 == 0, F.concat(F.lit("-Z///"), "line_number")).otherwise(F.concat(F.lit("-Z/"), "volume", F.lit("/"), "chapter", F.lit("/"), "line_number"))
    return rows.withColumn("raw", F.concat(head, F.lit("\t "), "content"))


def levels() -> F.Column:
    return F.array(F.lit("Volume"), F.lit("Chapter"), F.lit("Line"))


@query(with_tables("lines") + "SELECT line_id, CASE WHEN n % 3 = 0 THEN NULL ELSE CAST(volume AS VARCHAR) END AS volume, CASE WHEN n % 3 = 0 THEN NULL ELSE CAST(chapter AS VARCHAR) END AS chapter, CAST(line_number AS VARCHAR) AS line, content AS rest FROM lines")
def parse_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.citation_levels(F.col("raw"), levels())
    rows = cited(spark, sf_dir).select("line_id", found.alias("m"), C.citation_rest(F.col("raw")).alias("rest"))
    return rows.select("line_id", *[F.try_element_at("m", F.lit(k)).alias(k.lower()) for k in ("Volume", "Chapter", "Line")], "rest")


@query(with_tables("lines") + "SELECT line_id, last_value(CASE WHEN n % 3 = 0 THEN NULL ELSE chapter END IGNORE NULLS) OVER (PARTITION BY text_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chapter FROM lines")
def inherit_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapter = F.try_element_at(C.citation_levels(F.col("raw"), levels()), F.lit("Chapter")).cast("int")
    rows = cited(spark, sf_dir).select("line_id", "text_id", "n", chapter.alias("chapter"))
    return context.inherit(rows, ["text_id"], ["n"], ["chapter"], f"{context.scratch(spark)}/lines").select("line_id", "chapter")


@query(with_tables("lines") + "SELECT line_id, CASE WHEN n % 5 = 0 THEN CAST(n AS VARCHAR) WHEN n % 5 = 1 THEN '1' END AS title_number FROM lines")
def parse_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.when(F.col("n") % 5 == 0, F.concat(F.lit("-Z/1/t/"), "n")).when(F.col("n") % 5 == 1, F.lit("-Z//t")).otherwise(F.concat(F.lit("-Z/1/"), "n"))
    return V.lines(spark, sf_dir).select("line_id", C.title(F.concat(head, F.lit("\t"), "content")).alias("title_number"))


@query(with_tables("lines") + "SELECT division_id, string_agg(content, ' ' ORDER BY line_number) AS title FROM lines GROUP BY division_id")
def join_title_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(F.col("line_number").cast("int"), "content")))
    return V.lines(spark, sf_dir).groupBy("division_id").agg(F.array_join(F.transform(parts, lambda x: x["content"]), " ").alias("title"))


@query(with_tables("lines") + "SELECT line_id, '-Z//' || volume || '/' || chapter || '/' || line_number AS raw FROM lines")
def format_raw_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.lines(spark, sf_dir).select("line_id", C.format_raw(F.array(*[F.col(c).cast("string") for c in ("volume", "chapter", "line_number")])).alias("raw"))


@query("SELECT doc_id, lower(trim(regexp_replace(regexp_replace(source || ' [x] ' || lang || ' (y)+', '\\[[^\\]]*\\]|\\([^)]*\\)|[+$%]', '', 'g'), '\\s+', ' ', 'g'))) AS name FROM documents")
def normalize_work_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("3. "), "source", F.lit(" [x] "), "lang", F.lit(" (y)+"))
    return V.documents(spark, sf_dir).select("doc_id", T.normalize_work_name(raw).alias("name"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(replace(text, '-' || chr(10), ''), '[{}]', '', 'g'), '\\s+', ' ', 'g')) AS clean FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.documents(spark, sf_dir).select("doc_id", T.clean_text(F.col("text")).alias("clean"))


@query(with_tables("lines") + "SELECT line_id, n AS number FROM lines")
def clean_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.lines(spark, sf_dir).select("line_id", T.leading_number(F.concat("n", F.lit("a\t"), "content")).alias("number"))


@query(with_tables("sentences") + "SELECT sentence_id, division_id, content, starts, ends FROM sentences")
def build_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.sentences(spark, sf_dir).select("sentence_id", "division_id", "content", "starts", "ends")


@query(with_tables("links") + "SELECT sentence_id, line_id FROM links")
def sentence_line_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.links(spark, sf_dir).select("sentence_id", "line_id")


@query(with_tables("lines") + "SELECT line_id, k AS k, s AS sentence FROM (SELECT line_id, unnest(p) AS s, generate_subscripts(p, 1) AS k FROM (SELECT line_id, list_filter(list_transform(regexp_split_to_array(content, '[.|·]'), lambda x: trim(x)), lambda x: x <> '') AS p FROM lines))")
def simple_sentencize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.lines(spark, sf_dir).select("line_id", F.posexplode(T.simple_sentences(F.col("content"))).alias("p", "sentence"))
    return rows.select("line_id", (F.col("p") + 1).alias("k"), "sentence")


@query(with_tables("lines") + """SELECT division_id, min(line_number) AS line_number, count(*) AS n_lines, string_agg(regexp_replace(c, 'e$', ''), '' ORDER BY line_number) || CASE WHEN max_by(c, line_number) LIKE '%e' THEN 'e' ELSE '' END AS content
FROM (SELECT *, sum(CASE WHEN coalesce(p LIKE '%e', false) THEN 0 ELSE 1 END) OVER (PARTITION BY division_id ORDER BY line_number) AS island FROM (SELECT division_id, line_number, rtrim(content, '.') AS c, lag(rtrim(content, '.')) OVER (PARTITION BY division_id ORDER BY line_number) AS p FROM lines)) GROUP BY division_id, island""")
def merge_hyphen_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that end in e stand for hyphenated ones."""
    rows = V.lines(spark, sf_dir).withColumn("content", F.regexp_replace(F.regexp_replace("content", r"\.+$", ""), "e$", "-"))
    merged = sentences.merge_hyphen_lines(rows.select("division_id", "line_number", "content"))
    return merged.withColumn("content", F.regexp_replace("content", "-$", "e"))


_ONE = "(SELECT sentence_id, unnest(string_split(category, ', ')) AS c FROM tokens)"


@query(with_tables("tokens") + f"SELECT x.sentence_id, coalesce(any_value(c), '') AS categories FROM sentences x LEFT JOIN (SELECT sentence_id, string_agg(DISTINCT c, '|' ORDER BY c) AS c FROM {_ONE} WHERE c <> '' GROUP BY sentence_id) USING (sentence_id) GROUP BY x.sentence_id")
def extract_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.tokens(spark, sf_dir).select("sentence_id", F.array_join(search.split_categories(F.col("tokens")), "|").alias("categories"))


@query(with_tables("tokens") + "SELECT x.sentence_id, coalesce(any_value(c), '') AS categories FROM sentences x LEFT JOIN (SELECT sentence_id, string_agg(category, '|' ORDER BY i) AS c FROM tokens WHERE category <> '' GROUP BY sentence_id) USING (sentence_id) GROUP BY x.sentence_id")
def token_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.tokens(spark, sf_dir).select("sentence_id", F.array_join(search.raw_categories(F.col("tokens")), "|").alias("categories"))


@query(with_tables("tokens") + "SELECT x.sentence_id, coalesce(any_value(c), '') AS categories FROM sentences x LEFT JOIN (SELECT sentence_id, string_agg(DISTINCT 'noun:' || lemma, '|' ORDER BY 'noun:' || lemma) AS c FROM tokens WHERE pos = 'NOUN' GROUP BY sentence_id) USING (sentence_id) GROUP BY x.sentence_id")
def pos_lemma_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.tokens(spark, sf_dir).select("sentence_id", F.array_join(search.pos_lemma_categories(F.col("tokens")), "|").alias("categories"))


@query(with_tables("lines") + "SELECT line_id, CAST(sum(CASE WHEN p IS NULL OR p <> chapter THEN 1 ELSE 0 END) OVER (PARTITION BY text_id ORDER BY n) AS BIGINT) AS division FROM (SELECT *, lag(chapter) OVER (PARTITION BY text_id ORDER BY n) AS p FROM lines)")
def divisions_by_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.lines(spark, sf_dir).select("line_id", "text_id", "n", "chapter")
    return divisions.by_change(rows, ["text_id"], "n", "chapter", f"{context.scratch(spark)}/lines").select("line_id", "division")
