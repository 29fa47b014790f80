"""Sections, divisions, reference tags, line repairs, citation rows and views over the derived corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import citations as C
from lectern.functions import text as T
from lectern.operators import divisions as D
from lectern.operators import context, search
from lectern.plans import views as V
from lectern.plans.registry import query
from lectern.plans.search import _CITED, _cited
from lectern.plans.views import with_tables
from lectern.sources import files


@query(with_tables("lines") + "SELECT line_id, CAST(text_id AS VARCHAR) AS author, CAST(chapter AS VARCHAR) AS work, CASE WHEN n % 2 = 0 THEN CAST(line_number AS VARCHAR) END AS division FROM lines")
def metadata_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.concat(F.lit("["), "text_id", F.lit("]  ["), "chapter", F.lit("]  ["), F.when(F.col("n") % 2 == 0, F.col("line_number").cast("string")).otherwise(""), F.lit("]  []"))
    return V.lines(spark, sf_dir).select("line_id", C.metadata(header).alias("m")).select("line_id", "m.author", "m.work", "m.division")


@query(with_tables("lines") + """, s AS (SELECT text_id, n, content, line_number = 1 AS h, sum(CASE WHEN line_number = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY text_id ORDER BY n) AS section FROM lines)
SELECT text_id, CAST(section AS BIGINT) AS section, max(CASE WHEN h THEN content END) AS header, coalesce(string_agg(CASE WHEN NOT h THEN content END, chr(10) ORDER BY n), '') AS body FROM s GROUP BY text_id, section""")
def split_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of a chapter stands for a header."""
    return D.split_sections(V.lines(spark, sf_dir), "text_id", "n", "content", F.col("line_number") == 1, f"{context.scratch(spark)}/lines")


@query(with_tables("lines") + """SELECT line_id, CAST(sum(CASE WHEN line_number = 1 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS section, last_value(CASE WHEN line_number = 1 THEN content END IGNORE NULLS) OVER w AS header, line_number = 1 AS is_header
FROM lines WINDOW w AS (PARTITION BY text_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def section_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their section and its header, for sections of any size."""
    rows = V.lines(spark, sf_dir).select("line_id", "text_id", "n", "content", "line_number")
    return D.mark_sections(rows, ["text_id"], "n", "content", F.col("line_number") == 1, f"{context.scratch(spark)}/lines").select("line_id", "section", "header", "is_header")


_BY = "CASE WHEN source IN ('src3', 'src5') THEN 'Unknown Author' ELSE 'Author ' || source END || ', ' || CASE WHEN lang = 'de' THEN 'Unknown Work' ELSE 'Work ' || lang || ' of ' || source END"


@query(with_tables("lines") + f"""SELECT line_id, CASE n % 6
  WHEN 0 THEN 'see ' || {_BY} || ', Volume ' || volume || ': Chapter ' || chapter || ': Lines ' || line_number || '-' || (line_number + 1) || ', Line ' || (line_number + 3) || ', Chapter ' || chapter || 'a: Line 1, Volume ' || volume || 'x: Chapter 1: Line 9: end'
  WHEN 1 THEN {_BY} || ' (a, ), Chapter ' || chapter || ': Line ' || line_number || ', Chapter x: Lines 1-3: '
  WHEN 2 THEN 'Unknown Author, Unknown Work (, b), Lines ' || line_number || '-' || (line_number + 2) || ': ' || line_number
  WHEN 3 THEN 'nothing known of it'
  WHEN 4 THEN {_BY} || ': and Author src8, Work en of src8 (c, d), Line 12: ' || chapter
  ELSE 'no tag' END AS content FROM lines JOIN documents ON doc_id = text_id""")
def replace_ref_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags by volume, by chapter and by line alone, in any order and with repetitions, with and without divisions; of known and unknown authors and works; without a header; two in one line, of two authors; and none."""
    docs = V.documents(spark, sf_dir).select(F.col("doc_id").alias("text_id"), "source", "lang")
    authors = docs.select(F.col("source").alias("author_id")).union(spark.createDataFrame([("src8",)], "author_id string")).distinct().filter("author_id not in ('src3', 'src5')")
    works = docs.select(F.col("source").alias("author_id"), F.col("lang").alias("work_id")).union(spark.createDataFrame([("src8", "en")], "author_id string, work_id string")).distinct().filter("work_id <> 'de'")
    tagged = """CASE n % 6
      WHEN 0 THEN concat('see <tlg_ref>[', source, '] [', lang, '] [] []Volume ', volume, 'x, Chapter 1, Line 9, Volume ', volume, ', Chapter ', chapter, ', Line ', line_number + 1, ', Volume ', volume, ', Chapter ', chapter, ', Line ', line_number, ', Volume ', volume, ', Chapter ', chapter, 'a, Line 1, Volume ', volume, ', Chapter ', chapter, ', Line ', line_number + 3, '</tlg_ref>end')
      WHEN 1 THEN concat('<tlg_ref>[', source, '] [', lang, '][a][]Chapter x, Line 3, Chapter ', chapter, ', Line ', line_number, ', Chapter x, Line 1, Chapter x, Line 2, Chapter x, Line 1</tlg_ref>')
      WHEN 2 THEN concat('<tlg_ref>[none] [', lang, '] [] [b] Line ', line_number + 2, ' Line ', line_number, 'a Line ', line_number + 1, '</tlg_ref>', line_number)
      WHEN 3 THEN 'nothing <tlg_ref>known</tlg_ref> of it'
      WHEN 4 THEN concat('<tlg_ref>[', source, ']\n[', lang, '] [] []</tlg_ref>and <tlg_ref>[src8][en][c][d]Line 12</tlg_ref>', chapter)
      ELSE 'no tag' END"""
    rows = V.lines(spark, sf_dir).join(docs, "text_id").select("line_id", F.expr(tagged).alias("content"))
    return D.replace_refs(rows, "line_id", "content", authors.withColumn("author_name", F.concat(F.lit("Author "), "author_id")), works.withColumn("work_name", F.concat(F.lit("Work "), "work_id", F.lit(" of "), "author_id")))


@query(with_tables("lines") + "SELECT line_id, 'wordpart<tlg_ref>' || line_number || '</tlg_ref> ' || content AS content FROM lines")
def rejoin_split_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("word-<tlg_ref>"), "line_number", F.lit("</tlg_ref>part "), "content")
    return V.lines(spark, sf_dir).select("line_id", T.rejoin_split_words(raw).alias("content"))


@query(with_tables("lines") + "SELECT line_id, CASE WHEN n % 3 = 0 AND line_number <> 7 THEN 7 ELSE line_number END AS number FROM lines")
def line_number_from_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.when(F.col("n") % 3 == 0, F.concat(F.lit(".7.(7). "), "content")).otherwise(F.lit("no number"))
    return V.lines(spark, sf_dir).select("line_id", T.repaired_line_number(F.col("line_number"), content).alias("number"))


@query(with_tables("lines") + "SELECT line_id, content AS normal FROM lines")
def normalize_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("{"), F.regexp_replace("content", " ", "  "), F.lit("}  κδ"))
    return V.lines(spark, sf_dir).select("line_id", T.normalize_line(raw, F.lit(False)).alias("normal"))


@query(with_tables("lines") + "SELECT division_id, string_agg(content, ' ' ORDER BY line_number) AS content FROM lines WHERE regexp_matches(content, '\\p{L}') GROUP BY division_id")
def clean_special_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = V.lines(spark, sf_dir).filter(F.col("content").rlike(r"\p{L}")).withColumn("raw", F.concat(F.lit("1.2.[t3]."), "content", F.lit("\n 12 \n")))
    return raw.groupBy("division_id").agg(D.ordered_text("line_number", "raw", "").alias("t")).select("division_id", T.clean_special_content(F.col("t")).alias("content"))


@query(with_tables("divisions") + "SELECT division_id, 'Volume=' || volume || ',Chapter=' || chapter AS citation FROM divisions")
def division_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = F.array(F.lit("Volume"), F.lit("Book"), F.lit("Chapter"))
    return V.divisions(spark, sf_dir).select("division_id", D.division_citation(levels, {"Chapter": F.col("chapter"), "Volume": F.col("volume")}).alias("citation"))


@query(with_tables("links") + """, c AS (SELECT sentence_id, chapter || '.' || (l.line_number + 1) // 2 AS c, min(l.line_id) AS place FROM links JOIN lines l USING (line_id) GROUP BY ALL),
g AS (SELECT sentence_id, list(c ORDER BY place) AS c FROM c GROUP BY sentence_id) SELECT sentence_id, c[1] AS first_citation, array_to_string(c[2:], ' ') AS further FROM g""")
def sentence_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.cited_sentences(spark, sf_dir, c=lambda number: F.concat("chapter", F.lit("."), F.floor((number + 1) / 2)))
    return D.sentence_citations(rows, "c").withColumn("further", F.array_join("further", " "))


@query(with_tables("links") + "SELECT sentence_id, string_agg('Volume ' || l.volume || ', Chapter ' || l.chapter || ', Line ' || l.line_number || ': ', '' ORDER BY l.line_number) AS refs FROM links JOIN lines l USING (line_id) GROUP BY sentence_id")
def merge_cited_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sentence with the formatted references of its lines."""
    rows = V.cited_sentences(spark, sf_dir, refs=lambda number: C.dotted(F.concat_ws(".", "volume", "chapter", number))["label"])
    return rows.filter(F.size("refs") > 0).select("sentence_id", F.array_join("refs", "").alias("refs"))


@query(with_tables("links") + "SELECT sentence_id, l.division_id, array_to_string(list_sort(list(DISTINCT l.line_number)), ',') AS line_numbers, min(l.line_number) AS first_line, string_agg(l.content, ' ' ORDER BY l.line_number) AS line_text FROM links JOIN lines l USING (line_id) GROUP BY sentence_id, l.division_id")
def citation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.cited_sentences(spark, sf_dir, with_lines=True).filter(F.size("lines") > 0)
    return rows.select("sentence_id", "division_id", F.array_join(F.col("line_numbers").cast("array<string>"), ",").alias("line_numbers"), "first_line", F.array_join("lines", " ").alias("line_text"))


@query(_CITED + "SELECT sentence_id, coalesce(author_name, 'Unknown') AS author, title AS work, CASE WHEN len(line_numbers) > 1 THEN list_min(line_numbers) || '-' || list_max(line_numbers) ELSE CAST(list_min(line_numbers) AS VARCHAR) END AS line FROM cited")
def citation_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("line_numbers")
    line = F.when(F.size(n) > 1, F.concat(F.array_min(n), F.lit("-"), F.array_max(n))).otherwise(F.array_min(n).cast("string"))
    rows = _cited(spark, sf_dir)
    source = F.struct(F.coalesce("author_name", F.lit("Unknown")).alias("author"), F.coalesce("title", F.lit("Unknown")).alias("work"))
    return rows.select("sentence_id", F.struct(source.alias("source"), line.alias("line")).alias("c")).select("sentence_id", "c.source.author", "c.source.work", "c.line")


@query(_CITED + "SELECT sentence_id, content, volume, chapter, title, author_name FROM cited WHERE author_name IS NOT NULL")
def full_sentence_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.sentences(spark, sf_dir).join(V.divisions(spark, sf_dir), "division_id").join(V.texts(spark, sf_dir).select("text_id", "author_id", "title"), "text_id")
    return rows.join(V.authors(spark, sf_dir), "author_id").select("sentence_id", "content", "volume", "chapter", "title", "author_name")


@query(with_tables("tokens") + "SELECT 'line' AS kind, CAST(line_id AS VARCHAR) AS id FROM lines WHERE regexp_matches(content, '[\\p{L}]{12,}') UNION ALL SELECT DISTINCT 'sentence', CAST(sentence_id AS VARCHAR) FROM tokens WHERE length(t) >= 12 UNION ALL SELECT DISTINCT 'lemma', lemma FROM tokens WHERE length(t) >= 12")
def category_any_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    rare = lambda c: search.has_category(c, "Rare")
    lines = V.lines(spark, sf_dir).filter(rare(V.tokens_of(F.col("content"), ("category",)))).select(F.lit("line").alias("kind"), F.col("line_id").cast("string").alias("id"))
    rows = V.tokens(spark, sf_dir).filter(rare(F.col("tokens")))
    found = rows.select(F.lit("sentence").alias("kind"), F.col("sentence_id").cast("string").alias("id"))
    lemmas = rows.select(F.explode("tokens").alias("t")).filter(F.array_contains(F.split("t.category", ", "), "Rare")).select(F.lit("lemma").alias("kind"), F.col("t.lemma").alias("id")).distinct()
    return lines.unionByName(found).unionByName(lemmas)


@query(with_tables("lines") + "SELECT DISTINCT text_id, content FROM lines WHERE list_contains(regexp_extract_all(lower(content), '[\\p{L}]+'), 'the')")
def search_lines_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern over the JSON of the tokens."""
    hit = F.to_json(V.tokens_of(F.col("content"))).ilike('%"lemma":"the"%')
    return V.lines(spark, sf_dir).filter(hit).select("text_id", "content").distinct()


@query("SELECT doc_id, text FROM documents")
def decode_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other document as Latin-1 bytes; both come back as they were."""
    raw = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode("text", "ISO-8859-1"))
    return V.documents(spark, sf_dir).select("doc_id", files.decode_with_fallback(raw).alias("text"))
