"""Aggregates, verification, and set operations over the derived corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import citations as C
from lectern.operators import context, lexicon, verify
from lectern.operators import divisions as D
from lectern.plans import views as V
from lectern.plans.registry import query
from lectern.plans.views import with_tables
from lectern.sources import files, store
from lectern.streaming import imports


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT source, count(*) AS n_texts, count(l.doc_id) AS processed, round(100.0 * count(l.doc_id) / count(*), 6) AS percent FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY source")
def processing_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents count as processed; the share is of the texts."""
    done = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("done", F.lit(1))
    rows = V.documents(spark, sf_dir).select("doc_id", "source").join(done, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n_texts"), F.count("done").alias("processed"))
    return rows.withColumn("percent", F.round(F.when(F.col("n_texts") > 0, F.lit(100.0) * F.col("processed") / F.col("n_texts")).otherwise(0.0), 6))


@query(with_tables("lines") + "SELECT division_id, count(*) AS n_lines FROM lines GROUP BY division_id")
def lines_per_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.lines(spark, sf_dir).groupBy("division_id").agg(F.count("*").alias("n_lines"))


@query(with_tables("divisions") + "SELECT text_id, count(*) AS n_divisions, bool_or(volume > 1) AS many_volumes, count_if(chapter > 1) AS later_chapters FROM divisions GROUP BY text_id")
def structure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.divisions(spark, sf_dir).groupBy("text_id").agg(F.count("*").alias("n_divisions"), F.bool_or(F.col("volume") > 1).alias("many_volumes"), F.count_if(F.col("chapter") > 1).alias("later_chapters"))


@query("SELECT d.doc_id AS text_id, count(l.doc_id) AS n, CASE WHEN count(l.doc_id) = 0 THEN 'none' WHEN count(l.doc_id) > 1000 THEN 'many' ELSE 'ok' END AS flag FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.doc_id")
def division_count_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("text_id")).agg(F.count("*").alias("n"))
    rows = V.documents(spark, sf_dir).select(F.col("doc_id").alias("text_id")).join(counts, "text_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.withColumn("flag", F.when(F.col("n") == 0, "none").when(F.col("n") > 1000, "many").otherwise("ok"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source HAVING count(*) > 1")
def duplicate_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.duplicates(V.documents(spark, sf_dir), "source")


_WARN = """SELECT doc_id, 'content' AS stage, CASE WHEN NOT regexp_matches(text, '\\S') THEN 'empty_content' WHEN length(text) > 500000 THEN 'content_length' END AS type FROM documents
UNION ALL SELECT doc_id, 'content', 'limited_character_diversity' FROM documents WHERE regexp_matches(text, '\\S') AND CAST(regexp_matches(text, '\\p{L}') AS INT) + CAST(regexp_matches(text, '\\p{Nd}') AS INT) + CAST(regexp_matches(text, '\\s') AS INT) + CAST(regexp_matches(text, '[^\\x00-\\x7F]') AS INT) < 2"""


@query(f"SELECT doc_id, type FROM ({_WARN}) WHERE type IS NOT NULL")
def validate_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.documents(spark, sf_dir).select("doc_id", F.explode(verify.content_warnings(F.col("text"))).alias("type"))


@query("SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN user_id END AS user_id FROM events WHERE event_id % 5 = 0 OR user_id IS NULL OR user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 1)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without a customer, and of customers of whom a third is missing."""
    events = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("user_id")).alias("user_id"))
    return verify.orphans(events, table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 1"), "user_id", "c_custkey").select("event_id", "user_id")


_NAMES = ("Book", "Volumen", "Bekker page", "sectio", "Chap", "Place", " LINE ", "Fragment", "Notebook", "Epistle", "Tome", "Verse")
_STRUCTURES = (("Book", "Line"), ("Play", "Book", "Line"), ("Tome", "Bekker page", "Line"), ("Tome", "Playbook", "Line"), ("Tome", "Verse"))
_PART_SQL = "CASE WHEN contains({0}, 'vol') THEN 'volume' WHEN contains({0}, 'pag') THEN 'page' WHEN contains({0}, 'sec') THEN 'section' WHEN contains({0}, 'cha') THEN 'chapter' WHEN contains({0}, 'pla') THEN 'chapter' WHEN contains({0}, 'lin') THEN 'line' WHEN contains({0}, 'fra') THEN 'fragment' WHEN contains({0}, 'boo') THEN 'book' END"


@query(f"""WITH e AS (SELECT event_id, lower(trim({list(_NAMES)}[event_id % {len(_NAMES)} + 1])) AS name, list_transform({[list(x) for x in _STRUCTURES]}[event_id % {len(_STRUCTURES)} + 1], lambda x: lower(x)) AS levels FROM events)
SELECT event_id, coalesce(CASE WHEN name IN ('epistle', 'fragment', 'volume', 'book', 'chapter', 'section', 'page', 'line') THEN name END, {_PART_SQL.format("name")}, CASE WHEN list_contains(levels, 'play') THEN 'chapter' WHEN list_contains(levels, 'book') THEN 'book' END,
  list_filter(list_transform(levels, lambda x: {_PART_SQL.format("x")}), lambda x: x IS NOT NULL)[1], 'chapter') AS field FROM e""")
def map_level_to_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of all kinds in structures of all kinds, by the number of the event."""
    pick = lambda values: F.element_at(F.array(*values), (F.col("event_id") % len(values) + 1).cast("int"))
    levels = pick([F.array(*map(F.lit, x)) for x in _STRUCTURES])
    return table(spark, sf_dir, "events").select("event_id", C.level_column(pick([F.lit(x) for x in _NAMES]), levels).alias("field"))


@query("SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def import_new_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.new_texts(V.documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "labels"), "doc_id")


def _kept(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str, str]:
    """The lines of all texts in a store, its folder, and a folder for what updates put aside."""
    where = context.scratch(spark)
    lines = V.lines(spark, sf_dir).select("text_id", F.col("n").cast("long").alias("n"), "content")
    store.create(lines, f"{where}/store", parts=32)
    return lines, f"{where}/store", where


@query(with_tables("lines") + """SELECT text_id, n, CASE WHEN text_id % 16 = 3 AND n % 2 = 0 THEN 'new ' || content ELSE content END AS content FROM lines WHERE text_id % 16 <> 3 OR n % 5 <> 4
UNION ALL SELECT -text_id, n, content FROM lines WHERE text_id % 50 = 7""")
def upsert_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts come with changed and fewer lines, as they are stored, and new."""
    lines, path, where = _kept(spark, sf_dir)
    changed = lines.filter("text_id % 16 = 3 and n % 5 <> 4").withColumn("content", F.when(F.col("n") % 2 == 0, F.concat(F.lit("new "), "content")).otherwise(F.col("content")))
    new = lines.filter("text_id % 50 = 7").withColumn("text_id", -F.col("text_id"))
    store.upsert(spark, path, changed.unionByName(new).unionByName(lines.filter("text_id % 16 = 4")), f"{where}/update", parts=32)
    return store.read(spark, path)


@query(with_tables("lines") + "SELECT text_id, n, content FROM lines WHERE text_id % 16 <> 3")
def remove_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts go, and ids that aren't there change nothing."""
    lines, path, where = _kept(spark, sf_dir)
    store.remove(spark, path, lines.filter("text_id % 16 = 3").select(F.explode(F.array("text_id", -F.col("text_id") - 1)).alias("text_id")), f"{where}/update", parts=32)
    return store.read(spark, path)


@query(with_tables("lines") + """, l AS (SELECT text_id, n, content, row_number() OVER (PARTITION BY text_id ORDER BY n) AS k FROM lines)
SELECT CAST(text_id AS VARCHAR) AS text_id, CAST(k AS INTEGER) AS n, CASE WHEN text_id % 3 = 1 THEN 'first ' ELSE '' END || content AS line FROM l""")
def stream_new_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two thirds of the texts are imported, then files of all texts are added, of which a third is there already and comes with other lines, and imported by the same stream."""
    where = context.scratch(spark)
    rows = V.lines(spark, sf_dir).groupBy("text_id").agg(D.ordered_text("n", "content", "\n").alias("t"))
    first = F.concat(F.lit("first "), F.regexp_replace("t", "\n", "\nfirst "))

    def put(texts: DataFrame, name: str) -> None:
        # Up to 500 texts a file; content has single spaces only, so no line of it is a header.
        texts.select(F.concat(F.lit("["), "text_id", F.lit("]  [001]\n"), "value").alias("value")).write.option("maxRecordsPerFile", 500).text(f"{where}/{name}")

    def take() -> None:
        query_ = imports.stream_new_texts(spark, f"{where}/files", f"{where}/store", f"{where}/checkpoint", f"{where}/aside", head=r"\[(\d+)\]  \[001\]", parts=16)
        query_.awaitTermination()

    put(rows.filter("text_id % 3 = 1").select("text_id", first.alias("value")).unionByName(rows.filter("text_id % 3 = 0").select("text_id", F.col("t").alias("value"))), "files/a")
    take()
    put(rows.select("text_id", F.col("t").alias("value")), "files/b")
    take()
    take()
    return store.read(spark, f"{where}/store").select("text_id", "n", "line")


@query(with_tables("divisions") + "SELECT division_id, row_number() OVER (PARTITION BY text_id ORDER BY CAST(chapter AS VARCHAR)) AS place FROM divisions")
def sort_divisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the level above the line as text, as the stored order is."""
    w = Window.partitionBy("text_id").orderBy(F.coalesce(F.col("chapter").cast("string"), F.lit("1")))
    return V.divisions(spark, sf_dir).select("division_id", F.row_number().over(w).alias("place"))


_LEVEL = "CASE chapter % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST(chapter AS VARCHAR) WHEN 2 THEN chapter || 'a' ELSE 'x' || chapter END"


@query(with_tables("divisions") + f"SELECT division_id, row_number() OVER (PARTITION BY text_id ORDER BY TRY_CAST(coalesce({_LEVEL}, '1') AS INTEGER) NULLS LAST, coalesce({_LEVEL}, '1'), division_id) AS place FROM divisions")
def sort_divisions_natural(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By number where the level is one, then by text; a missing level counts as 1."""
    level = F.expr(_LEVEL.replace("CAST(chapter AS VARCHAR)", "CAST(chapter AS STRING)"))
    w = Window.partitionBy("text_id").orderBy(*context.natural_order(level), "division_id")
    return V.divisions(spark, sf_dir).select("division_id", F.row_number().over(w).alias("place"))


@query(with_tables("lines") + "SELECT line_id, row_number() OVER (PARTITION BY text_id ORDER BY chapter, line_number NULLS LAST) AS place FROM lines")
def sort_division_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("text_id").orderBy("chapter", F.col("line_number").asc_nulls_last())
    return V.lines(spark, sf_dir).select("line_id", F.row_number().over(w).alias("place"))


@query("SELECT doc_id, source FROM documents WHERE n_chars > 1000 ORDER BY doc_id LIMIT 10")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.documents(spark, sf_dir).filter("n_chars > 1000").orderBy("doc_id").limit(10).select("doc_id", "source")


@query(with_tables("divisions", "lines") + """, e AS (SELECT * FROM divisions WHERE chapter % 4 = 0)
SELECT empty_id, line_id, place FROM (SELECT e.division_id AS empty_id, l.line_id, row_number() OVER (PARTITION BY e.division_id ORDER BY l.line_number, l.line_id) AS place FROM e JOIN lines l ON e.text_id = l.text_id AND (e.volume = l.volume OR e.chapter = l.chapter)) WHERE place <= 20""")
def nearby_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth chapter stands for an empty division."""
    return verify.nearby_lines(V.divisions(spark, sf_dir).filter("chapter % 4 = 0"), V.lines(spark, sf_dir), ("volume", "chapter")).select("empty_id", "line_id", "place")


@query("""SELECT kind, CAST(n AS BIGINT) AS n, CAST(size AS BIGINT) AS size FROM (SELECT 'current' AS kind, count(*) AS n, sum(length(text)) AS size FROM conversations c WHERE turn = (SELECT max(turn) FROM conversations x WHERE x.conv_id = c.conv_id) UNION ALL SELECT 'version', count(*), sum(length(text)) FROM conversations
UNION ALL SELECT 'backup', count(*), sum(length(text)) FROM conversations WHERE role = 'system' UNION ALL SELECT 'total', count(*) + count_if(role = 'system'), sum(length(text)) + sum(CASE WHEN role = 'system' THEN length(text) ELSE 0 END) FROM conversations)""")
def storage_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns stand for versions, and those of the system for backups."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("size"))
    return lexicon.storage_info(rows.select("conv_id", "turn", "size"), rows.filter("role = 'system'").select("size"), "conv_id", "turn")
