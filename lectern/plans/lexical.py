"""Lexical entries and versions over the derived corpus; conversations stand for versioned entries, event properties for responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import citations as C
from lectern.operators import context, lexicon, verify
from lectern.plans import views as V
from lectern.plans.registry import query
from lectern.plans.views import with_tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(with_tables("tokens") + "SELECT lemma, count(DISTINCT sentence_id) AS n_sentences, min(sentence_id) AS primary_sentence, count(DISTINCT division_id) AS n_divisions FROM tokens GROUP BY lemma")
def lexical_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.lemma_totals(V.division_lemmas(spark, sf_dir))


@query("SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.latest(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("SELECT conv_id, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS versions FROM conversations GROUP BY conv_id")
def version_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("v"))
    return rows.select("conv_id", F.array_join(F.col("v").cast("array<string>"), ",").alias("versions"))


@query("SELECT r.user_id, r.event_id, v.event_id AS version_id FROM (SELECT user_id, event_id FROM events WHERE event_type <> 'view') r ASOF LEFT JOIN (SELECT user_id, event_id FROM events WHERE event_type = 'view') v ON r.user_id = v.user_id AND r.event_id >= v.event_id")
def version_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views are versions; every other event asks for the one in force."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    versions = e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("version_id"), "event_type")
    return context.as_of(e.filter("event_type <> 'view'"), versions, "user_id", "event_id", "version_id", "event_type").select("user_id", "event_id", "version_id")


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'good' WHEN l.quality = 0 THEN 'bad' END, d.lang) AS lang FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def upsert_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "documents").select("doc_id", "lang")
    new = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").alias("lang"))
    return lexicon.upsert(old, new, "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "labels").filter("toxic = 1")
    return lexicon.create_missing(gone, table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query(with_tables("links", "tokens") + "SELECT lemma, s AS primary_sentence, min(line_id) AS line_id, any_value(l.division_id) AS division_id FROM (SELECT lemma, min(sentence_id) AS s FROM tokens GROUP BY lemma) JOIN links l ON s = sentence_id GROUP BY lemma, s")
def linked_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each lemma with the first line of its primary sentence."""
    pairs = lexicon.lemma_sentences(V.tokens(spark, sf_dir)).groupBy("lemma").agg(F.min("sentence_id").alias("primary_sentence"))
    first = V.links(spark, sf_dir).groupBy("sentence_id", "division_id").agg(F.min("line_id").alias("line_id"))
    return pairs.join(first, pairs.primary_sentence == first.sentence_id).select("lemma", "primary_sentence", "line_id", "division_id")


@query("""SELECT doc_id FROM documents WHERE doc_id % 6 <> 5 AND (source = 'src8' AND lang = 'en' OR doc_id % 6 = 1 AND source = 'src3' AND lang <> 'de')""")
def analyses_citing_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyses with citations of one source or of several, without a source, with the two ids in different citations, as a single object, and cut off in the middle."""
    made = """CASE doc_id % 6 WHEN 0 THEN concat('[', own, ']') WHEN 1 THEN concat('[{"note": "none"}, ', CASE WHEN source = 'src3' AND lang <> 'de' THEN '{"source": {"author_id": "src8", "work_id": "en", "page": 7}}' ELSE '{"source": {"author_id": "src8"}}' END, ', ', own, ']')
      WHEN 2 THEN own WHEN 3 THEN concat('[{"source": {"author_id": "src8", "work_id": "xx"}}, {"source": {"author_id": "xx", "work_id": "en"}}, ', own, ']') WHEN 4 THEN concat('[{"source": null}, {"source": {}}, ', own, ']') ELSE concat('[{"source": {"author_id": "src8", "work_id": "en"') END"""
    rows = table(spark, sf_dir, "documents").withColumn("own", F.to_json(F.struct(F.struct(F.col("source").alias("author_id"), F.col("lang").alias("work_id")).alias("source"), F.lit("n").alias("note"))))
    return rows.withColumn("citations", F.expr(made)).filter(C.cites(F.col("citations"), "src8", "en")).select("doc_id")


@query(with_tables("tokens") + "SELECT lemma, p AS primary_sentence, n FROM (SELECT lemma, min(sentence_id) AS p, count(DISTINCT sentence_id) AS n FROM tokens GROUP BY lemma) WHERE p IN (SELECT sentence_id FROM tokens WHERE list_contains(string_split(category, ', '), 'Rare'))")
def lexical_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose primary sentence has a rare word."""
    return lexicon.of_category(V.tokens(spark, sf_dir, ("lemma", "category")), "Rare")


@query("SELECT doc_id FROM documents WHERE doc_id % 9 = 0 OR source NOT IN (SELECT source FROM documents WHERE lang = 'fr' AND doc_id % 4 = 0 AND source < 'src3')")
def lexical_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 9 != 0, F.col("source")).alias("source"), "lang")
    known = table(spark, sf_dir, "documents").filter("lang = 'fr' and doc_id % 4 = 0 and source < 'src3'").select(F.col("source").alias("known"))
    return verify.orphans(docs, known, "source", "known").select("doc_id")
