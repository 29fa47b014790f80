"""Citation heads, titles, dotted forms and formatting on literal rows."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import citations as C
from lectern.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("x")).first()["x"]


def levels():
    return F.array(F.lit("Volume"), F.lit("Page"), F.lit("Line"))



@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ("-Z/1/40/1\t text", {"Volume": "1", "Page": "40", "Line": "1"}),
        ("-Z//672/1\ttext", {"Page": "672", "Line": "1"}),
        ("-Z///1\ttext", {"Line": "1"}),
        ("-Z//847a/11\ttext", {"Page": "847a", "Line": "11"}),
        ("-Z1/2/3/4\ttext", {"Volume": "1", "Page": "2", "Line": "3"}),
        ("no citation", None),
    ],
)
def test_levels(spark, line, expected):
    assert one(spark, C.citation_levels(F.col("line"), levels()), line=line) == expected


def test_strict_needs_two_fields(spark):
    assert one(spark, C.citation_levels(F.col("line"), levels(), strict=True), line="-Z///1\ttext") is None


@pytest.mark.parametrize(("line", "number"), [("-Z/1/t/1\t{T}", "1"), ("-Z///t\t{T}", "1"), ("-Z/t3\tx", "3"), ("-Z/1t2\tx", "2"), ("-Z/1/2\tx", None)])
def test_titles(spark, line, number):
    assert one(spark, C.title(F.col("line")), line=line) == number


def test_rest_and_metadata(spark):
    assert one(spark, C.citation_rest(F.col("line")), line="-Z/1/2/3\t  body text ") == "body text"
    m = one(spark, C.metadata(F.col("line")), line="[0057]  [002]  []  []")
    assert (m["author"], m["work"], m["division"]) == ("0057", "002", None)
    assert one(spark, C.metadata(F.col("line")), line="[0057] only") is None


@pytest.mark.parametrize(
    ("line", "label", "rest"),
    [
        ("128.32.5 text", "Volume 128, Chapter 32, Line 5: ", "text"), (".1.5 text", "Chapter 1, Line 5: ", "text"), (".t.1 x", "Title_number 1: ", "x"), (".a.123 text", "Chapter a, Line 123: ", "text"), ("1.2.t3 x", "Volume 1, Chapter 2, Title_number 3: ", "x"),
        ("12a.b.7c x", "Volume 12a, Chapter b, Line 7c: ", "x"), ("1.2.3.4 x", "Volume 1, Chapter 2, Line 3: ", ".4 x"), ("[1] [2] [] [d] x", "Author_id 1, Work_id 2, Subdivision d: ", "x"), ("..7", "Line 7: ", ""),
    ],
)
def test_dotted(spark, line, label, rest):
    d = one(spark, C.dotted(F.col("line")), line=line)
    assert (d["label"], d["rest"]) == (label, rest)
    assert one(spark, C.dotted(F.col("line")), line="no number") is None


def test_level_columns(spark):
    for name, structure, column in (
        ("Volume", ["Book"], "volume"), ("Bekker page", ["Book"], "page"), ("Play", ["Book"], "chapter"), (" line ", [], "line"), ("Stanza", ["Book", "Line"], "book"), ("Stanza", ["Play", "Book"], "chapter"),
        ("Tome", ["Tome", "Page"], "page"), ("Tome", ["Tome", "Playbook", "Line"], "chapter"), ("Tome", ["Notebook"], "book"), ("Tome", ["Tome"], "chapter"), ("Tome", [], "chapter"), ("Epistle", [], "epistle"),
    ):
        levels = F.array(*map(F.lit, structure)).cast("array<string>")
        assert one(spark, C.level_column(F.col("n"), levels), n=name) == column, (name, structure)


def test_cites(spark):
    one_source = '{"note": [1], "source": {"author_id": "0057", "work_id": "001", "x": {}}}'
    for text, found in (
        (f"[{one_source}]", True), (f'[{{"source": {{"author_id": "0057", "work_id": "002"}}}}, {{"source": {{"author_id": "1", "work_id": "001"}}}}]', False), (f'[{{"a": 1}}, {{"source": null}}, {one_source}]', True), (one_source, True),
        ("[", False), ("", False), (None, False), ("[]", False), ('{"source": {"author_id": "0057"}}', False), ('[{"source": {"author_id": "0057", "work_id": "001"}}, "x', False),
    ):
        got = spark.createDataFrame([(text,)], "c string").select(C.cites(F.col("c"), "0057", "001").alias("x")).first()["x"]
        assert got == found, text


def test_formats(spark):
    assert one(spark, C.format_raw(F.array(F.lit("1"), F.lit("2"))), a=1) == "-Z///1/2"
    assert one(spark, C.abbreviate_author(F.col("n")), n="Hippocrates Cous") == "Hip. Cous"
    assert one(spark, C.abbreviate_work(F.col("n")), n="De Natura Hominis") == "NH."
    for name, short in (("De Articulis", "A."), ("Aphorisms", "A."), ("de", "De."), ("the an", "The.")):
        assert one(spark, C.abbreviate_work(F.col("n")), n=name) == short
    short = C.abbreviate_citation(F.lit("Galenus Med."), F.lit("De Natura Hominis"), F.array(F.lit(3), F.lit(5)), volume=F.lit("2"), chapter=F.lit(None).cast("string"))
    assert one(spark, short, a=1) == "Gal. Med. NH..2.3-5"  # the stop of the work and the one before a level
    levels = C.format_levels(F.array(F.lit(3), F.lit(5)), volume=F.lit("2"), chapter=F.lit(""))
    assert one(spark, levels, a=1) == "Volume 2, Line 3-5"


def test_cleaning(spark):
    assert one(spark, T.clean_text(F.col("t")), t="{a}  b-\nc\n d’s") == "a bc dʼs"
    assert one(spark, T.normalize_line(F.col("t"), F.lit(False)), t="{word}  and   κδʹ") == "word and"
    assert one(spark, T.rejoin_split_words(F.col("t")), t="wor-<tlg_ref>x</tlg_ref>d more") == "word<tlg_ref>x</tlg_ref> more"
    assert one(spark, T.normalize_work_name(F.col("t")), t="3. De  Articulis [Sp.] (x)+") == "de articulis"
    assert one(spark, T.leading_number(F.col("t")), t="12a\trest") == 12
    assert one(spark, T.leading_number(F.col("t")), t="x") is None
    assert one(spark, T.repaired_line_number(F.lit(3), F.col("t")), t=".7.(7). text") == 7
    assert one(spark, T.clean_special_content(F.col("t")), t="1.2.[t3]. Head\n 12 \n\nbody λόγος") == "Head body λόγος"
    assert one(spark, T.simple_sentences(F.col("t")), t="a. b| c· ") == ["a", "b", "c"]
