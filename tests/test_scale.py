"""Plans of queries that are to grow no faster than their tables: what is worked out once, and what isn't shuffled."""

import random

from pyspark.sql import functions as F

from lectern.operators import lexicon, verify
from lectern.operators import sentences as S
from lectern.plans import registry
from lectern.plans import views as V

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def made(spark, folder, texts):
    """A folder with documents of the texts."""
    spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_cleaned_once_for_contents(spark, tmp_path):
    where = made(spark, tmp_path, ["One  a. Two\nb. Three", ""])
    rows = V.contents(spark, where)
    assert [r.content for r in rows.orderBy("sentence_id").collect()] == ["One a.", "Two b.", "Three."]
    assert plan(rows).count("regexp_replace(") == 1
    assert plan(V.tokens(spark, where)).count("regexp_replace(") == 1


def test_lemma_totals_without_pairs_of_lemma_and_division(spark):
    rows = [(1, [(11, ["a", "b", "a"]), (12, ["a"])]), (2, [(21, []), (22, ["b", None])]), (3, []), (4, None)]
    divisions = spark.createDataFrame(rows, "division_id long, sentences array<struct<sentence_id:long,lemmas:array<string>>>")
    totals = lexicon.lemma_totals(divisions)
    assert sorted(map(tuple, totals.collect()), key=repr) == sorted([("a", 2, 11, 1), ("b", 2, 11, 2), (None, 1, 22, 1)], key=repr)
    assert plan(totals).count("Aggregate [") == 1 and "distinct" not in plan(totals).replace("array_distinct", "")


def test_lexical_totals_group_by_lemma_alone(spark, tmp_path):
    rows = registry.QUERIES["lexical_totals"](spark, made(spark, tmp_path, ["\n".join(["The end. The"] * 12)]))
    assert sorted((r.lemma, r.n_sentences, r.n_divisions) for r in rows.collect()) == [("end", 12, 2), ("the", 14, 2)]
    assert plan(rows).count("Aggregate [") == 1 and "distinct" not in plan(rows).replace("array_distinct", "")


def test_category_of_the_primary_sentence_without_a_join(spark):
    token = lambda *words: [(w, c) for w, c in words]
    rows = [(1, token(("a", ""), ("b", "Long"))), (2, token(("c", "Long, Rare"), ("a", ""), ("c", ""))), (3, token(("c", ""), ("d", "Rare"))), (4, []), (5, None)]
    entries = lexicon.of_category(spark.createDataFrame(rows, "sentence_id long, tokens array<struct<lemma:string,category:string>>"), "Rare")
    assert sorted(map(tuple, entries.select("lemma", "primary_sentence", "n").collect())) == [("c", 2, 2), ("d", 3, 1)]
    assert "Join" not in plan(entries) and plan(entries).count("Generate") == 1


def test_rare_words_are_read_once(spark, tmp_path):
    """Lemmas, their analyses and their families come from one stored table, not from the documents again."""
    rows = registry.QUERIES["lemma_with_analyses"](spark, made(spark, tmp_path, ["Extraordinary extraordinarily. Extraordinary", "none"]))
    assert sorted((r.lemma, r.n_tokens, r.n_related) for r in rows.collect()) == [("extraordinarily", 1, 1), ("extraordinary", 2, 1)]
    assert "regexp" not in plan(rows)


def test_shares_of_scripts_once_each(spark, tmp_path):
    rows = registry.QUERIES["validate_script"](spark, made(spark, tmp_path, ["ab", "ab" * 40]))
    assert sorted((r.doc_id, round(r.latin, 2), r.few, r.n_warnings) for r in rows.collect()) == [(0, 40.0, "", 1), (1, 97.56, "arabic,chinese", 1)]
    assert plan(rows).count("regexp_replace(") == len(verify.SCRIPTS) + 1


def test_rows_of_sentences_are_not_shuffled(spark, tmp_path):
    where = made(spark, tmp_path, ["One a. Two\nb. Three\nc d\ne f. Four.", ""])
    got = {n: registry.QUERIES[n](spark, where) for n in ("first_row_per_sentence", "sentence_citations", "merge_cited_lines", "citation_rows")}
    assert sorted(tuple(r)[1] for r in got["first_row_per_sentence"].collect()) == [1, 1, 2, 4]
    assert [tuple(r)[1:] for r in got["sentence_citations"].orderBy("sentence_id").collect()] == [("1.1", ""), ("1.1", ""), ("1.1", "1.2"), ("1.2", "")]
    assert [r.refs for r in got["merge_cited_lines"].orderBy("sentence_id").collect()][1] == "Volume 1, Chapter 1, Line 1: Volume 1, Chapter 1, Line 2: "
    assert [r.line_text for r in got["citation_rows"].orderBy("sentence_id").collect()][2] == "b. Three c d e f. Four."
    for name, df in got.items():
        assert not any(x in plan(df) for x in ("Join", "Aggregate [", "Window")), name


def test_neighbours_share_a_line(spark):
    """Against all pairs of the sentences of a division, in one shuffle."""
    rng = random.Random(3)
    words = ["ab", "c", "de.", "f.", "g,", "h"]
    rows = [(d, d * 100 + n, n, " ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) + rng.choice(["", "-"]), False) for d in range(60) for n in range(1, rng.randint(2, 7))]
    rows += [(60, 6001, 1, "a. b-", False), (60, 6002, 2, "-", False), (60, 6003, 3, "c. d", False)]
    lines = spark.createDataFrame(rows, "division_id long, line_id long, line_number int, content string, is_title boolean")
    cited = S.cited_sentences(lines).withColumn("sentence_id", F.col("division_id") * 1000 + F.col("k"))
    have = {r.sentence_id: set(r.line_ids) for r in cited.collect() if r.line_ids}
    near = lambda i, step: next((j for j in sorted(have, key=lambda j: step * j) if step * j > step * i and have[i] & have[j]), None)
    got = S.overlapping_neighbours(cited)
    assert {r.sentence_id: (r.prev_id, r.next_id) for r in got.collect()} == {i: (near(i, -1), near(i, 1)) for i in have}
    assert plan(got).count("Window [") == 1


def test_postings_are_of_lemmas_alone(spark, tmp_path, monkeypatch):
    """search_lemmas hands the index tokens with nothing but lemmas, whose lines are cleaned once."""
    from lectern.operators import postings

    class Seen(Exception):
        pass

    def write(tokens, *args, **options):
        assert [f.name for f in tokens.schema["tokens"].dataType.elementType.fields] == ["lemma"] and plan(tokens).count("regexp_replace(") == 1
        raise Seen

    monkeypatch.setattr(postings, "write", write)
    try:
        registry.QUERIES["search_lemmas"](spark, made(spark, tmp_path, ["One a. Two"]))
        raise AssertionError("nothing was written")
    except Seen:
        pass
