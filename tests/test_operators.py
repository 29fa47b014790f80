"""Context, search, verification, lexicon and files on small tables."""

import re

from pyspark.sql import functions as F

from lectern.operators import context, lexicon, search, verify
from lectern.operators import works as W
from lectern.sources import files

TOKENS = "array<struct<text:string,lemma:string,pos:string,category:string>>"


def test_context_and_pages(spark):
    rows = spark.createDataFrame([(1, i, i, f"Test line {i}") for i in range(1, 26)], "division_id long, sentence_id long, first_line int, content string")
    c = {r.sentence_id: r for r in context.sentence_context(rows).collect()}
    assert c[1].prev_sentence is None and c[2].prev_sentence == "Test line 1" and c[25].next_sentence is None
    pages = context.paginate(rows, ["division_id", "sentence_id"], context.scratch(spark))
    sizes = {r.page: r["count"] for r in pages.groupBy("page").count().collect()}
    assert sizes == {1: 10, 2: 10, 3: 5}
    assert pages.select("total_results", "total_pages").distinct().collect() == [(25, 3)]


def test_ranges_continuity_asof(spark):
    rows = spark.createDataFrame([(1, n) for n in (1, 2, 2, 3, 5, 7, 8)], "d int, line_number int")
    assert context.line_ranges(rows, ["d"]).first()["ranges"] == "Lines 1-3, Line 5, Lines 7-8"
    assert [(r.line_number, r.expected) for r in context.line_continuity(rows.distinct(), "d").orderBy("line_number").collect()] == [(5, 4), (7, 6)]
    versions = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y")], "k string, v int, val string")
    asked = spark.createDataFrame([("a", 0), ("a", 1), ("a", 4), ("a", 9)], "k string, t int")
    assert [r.val for r in context.as_of(asked, versions, "k", "t", "v", "val").orderBy("t").collect()] == [None, "x", "x", "y"]
    assert context.latest(versions, "k", "v").first()["val"] == "y"


def test_search(spark):
    row = spark.createDataFrame([([("φλέψ", "φλέψ", "NOUN", "Body Part, Topography"), ("x", "x", "X", "Body Part"), ("x", "x", "X", "")], "φλέψ x 100%")], f"tokens {TOKENS}, content string")
    got = row.select(search.split_categories(F.col("tokens")).alias("a"), search.raw_categories(F.col("tokens")).alias("b"), search.pos_lemma_categories(F.col("tokens")).alias("c"), search.has_token(F.col("tokens"), category="topo", pos="NOUN").alias("d"), search.contains_text(F.col("content"), "0%").alias("e"), search.tokens_in_line(F.col("tokens"), F.col("content")).alias("f")).first()
    assert got.a == ["Body Part", "Topography"] and got.b == ["Body Part, Topography", "Body Part"] and got.c == ["noun:φλέψ"] and got.d and got.e
    assert [(h.i, h.start, h.end) for h in got.f] == [(0, 0, 4), (1, 5, 6)]
    stored = search.with_normal(row, "content")
    assert search.search_normalized(stored, "normal", "ΦΛΈ").count() == 1 and search.search_normalized(stored, "normal", "φλε").count() == 1 and search.search_normalized(stored, "normal", "φλα").count() == 0
    assert row.filter(search.has_lemma_normalized(F.col("tokens"), "ΦΛΕ\u0301Ψ")).count() == 1 and row.filter(search.has_lemma_normalized(F.col("tokens"), "φλεψ")).count() == 0
    assert row.filter(search.categories_all(search.split_categories(F.col("tokens")), ["Topography", "Body Part"])).count() == 1


def test_verify(spark):
    rows = spark.createDataFrame([(1, ""), (2, " \n"), (3, "abc"), (4, "abc 1"), (5, None)], "id int, t string")
    got = {r.id: r.w for r in rows.select("id", verify.content_warnings(F.col("t")).alias("w")).collect()}
    assert got == {1: ["empty_content"], 2: ["empty_content"], 3: ["limited_character_diversity"], 4: [], 5: ["empty_content"]}
    assert rows.filter("id = 4").select(verify.script_share(F.col("t"), "greek").alias("s")).first()["s"] == 0.0
    for text, asked, warned in (("abc", "latin", []), ("λόγος καὶ τὸ σῶμα x", "greek", []), ("x" * 19 + "λ", "runes", ["script_validation: runes", "mixed_script_distribution: greek: 5.00%"]), ("", "mixed", [])):
        assert spark.createDataFrame([(text, asked)], "t string, a string").select(verify.script_warnings(F.col("t"), F.col("a")).alias("w")).first()["w"] == warned
    texts = spark.createDataFrame([(1, "a.1"), (2, "a.2"), (3, "a.3")], "text_id long, reference string")
    divisions = spark.createDataFrame([(10, 1, False, "1", "2"), (11, 1, False, "1", "3"), (12, 1, True, "1", "4"), (20, 2, False, None, "1")], "division_id long, text_id long, is_title boolean, volume string, chapter string")
    found = verify.completeness(texts, divisions, spark.createDataFrame([(10,), (20,)], "division_id long")).collect()
    assert sorted((r.type, r.work_id, r.details) for r in found) == [("divisions_without_lines", "a.1", "a.1.1.3"), ("text_without_divisions", "a.3", None)]
    child = spark.createDataFrame([(1, 10), (2, None), (3, 11)], "id int, k int")
    assert sorted(r.id for r in verify.orphans(child, spark.createDataFrame([(10,)], "p int"), "k", "p").collect()) == [2, 3]


def test_lexicon(spark):
    contexts = spark.createDataFrame([(i, f"c{i}", f"s{i}", None, f"s{i + 1}", [("a",), ("a",)] + [("b",)] * (i == 3)) for i in range(25)], "sentence_id long, citation string, text string, prev string, next string, tokens array<struct<lemma:string>>")
    at = lambda: f"{context.scratch(spark)}/s"
    parts = {(r.lemma, r.part): r for r in lexicon.lemma_entries(contexts, at(), part_bytes=30).collect()}
    sizes, want = 0, {}
    for i in range(25):
        sizes += len(f"s{i}")
        want.setdefault(sizes // 30, []).append(i)
    assert {k[1]: [r.n, r.primary] for k, r in parts.items() if k[0] == "a"} == {p: [len(v), v[0]] for p, v in want.items()} and len(want) == 3
    assert [k for k in parts if k[0] == "b"] == [("b", 0)]
    assert parts["b", 0].contexts[3].next == "s4" and parts["b", 0].citations == [("c3", "s3")]
    plain = lexicon.lemma_entries(contexts.drop("prev", "next"), at(), part_bytes=30, context=())
    assert {(r.lemma, r.part): r.citations for r in plain.collect()} == {k: r.citations for k, r in parts.items()} and "contexts" not in plain.columns
    answer = spark.createDataFrame([('{"lemma": 1, "translation": true, "related_terms": "x", "citations_used": ["a", 2]}',)], "t string")
    got = answer.select(lexicon.coerced(lexicon.parse_response(F.col("t"))).alias("r")).first()["r"]
    assert (got.lemma, got.translation, got.related_terms, got.citations_used, got.long_description) == ("1", "true", ["x"], ["a", "2"], None)
    raw = spark.createDataFrame([('text {"lemma": "x", "n": 1} more',), ("nothing",)], "t string")
    got = raw.select(lexicon.parse_response(F.col("t")).alias("m"), lexicon.missing_keys(lexicon.parse_response(F.col("t")), ("lemma", "y")).alias("k")).collect()
    assert got[0].m == {"lemma": "x", "n": "1"} and got[0].k == ["y"] and got[1].m is None and got[1].k == ["lemma", "y"]
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, None)], "k int, v string")
    assert sorted(map(tuple, lexicon.upsert(old, new, "k").collect())) == [(1, "a"), (2, "c"), (3, None)]


def test_files(spark, tmp_path):
    (tmp_path / "TLG0057_x-002.txt").write_bytes("﻿[0057] [002]\r\n\r-Z/1/1\tλόγος\n".encode())
    (tmp_path / "0099_y-013.txt").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "pipeline_reports").mkdir()
    (tmp_path / "pipeline_reports" / "z.txt").write_text("no")
    rows = files.read_cited_lines(spark, str(tmp_path))
    author, work = files.file_ids(F.col("path"))
    got = sorted(map(tuple, rows.select(author, work, "n", "line").collect()))
    assert got == [("0057", "002", 1, "[0057] [002]"), ("0057", "002", 3, "-Z/1/1\tλόγος"), ("0099", "013", 1, "café")]
    tagged = spark.createDataFrame([("t1", "a b", None)], files.TAGGED)
    files.write_tagged_jsonl(tagged, str(tmp_path / "out"))
    assert files.read_tagged_jsonl(spark, str(tmp_path / "out")).select("text_id", "text").collect() == [("t1", "a b")]


def test_works(spark):
    works = spark.createDataFrame([("1", "1"), ("1", "2"), ("1", "3"), ("2", "1")], "author_id string, work_id string")
    names = spark.createDataFrame([("1", "1", "1. De  Articulis [Sp.]"), ("1", "2", "Other")], "author_id string, work_id string, work_name string")
    structures = spark.createDataFrame([("1", "de articulis", ["Section", "Line"])], "author_id string, work_name string, levels array<string>")
    got = {(r.author_id, r.work_id): (r.levels, r.missed) for r in W.resolve_structures(works, names, structures).collect()}
    assert got == {("1", "1"): (["Section", "Line"], None), ("1", "2"): (["Chapter", "Line"], "structure"), ("1", "3"): (["Chapter", "Line"], "work"), ("2", "1"): (["Chapter", "Line"], "author")}
    key = lambda levels, found: spark.createDataFrame([(levels, found)], "l array<string>, f map<string,string>").select(W.division_key(F.col("l"), F.col("f")).alias("k")).first()["k"]
    assert key(["Volume", "Chapter", "Line"], {"Chapter": "3", "Line": "1"}) == ("chapter", "3")
    assert key(["Volume", "Chapter", "Line"], {"Line": "1"}) == ("chapter", "1")
    assert key(["Book", "Page"], {"Book": "2", "Page": "7"}) == ("page", "7")
    assert key(["Epistle", "Verse"], {}) == ("epistle", "1")
    lines = spark.createDataFrame([(1, 1, "12a"), (1, 2, None), (1, 3, "x"), (1, 4, None)], "division_id int, n int, cited string")
    assert [(r.n, r.number) for r in W.number_lines(lines).orderBy("n").collect()] == [(1, 12), (2, 2), (4, 4)]
    rows = spark.createDataFrame([("1", "x"), ("2", None), ("3", "c")], "k string, v string")
    filled = W.backfill_names(rows, spark.createDataFrame([("1", "a"), ("3", "c")], "k string, v string"), ["k"], "v", "Unknown").collect()
    assert sorted((r.k, r.v, r.changed) for r in filled) == [("1", "a", True), ("2", "Unknown", True), ("3", "c", False)]


def test_names_nearly_alike(spark):
    """Against the edits of all parts of all names, with every reading of the signs."""
    import itertools
    import random
    import unicodedata

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 5)))
    index = [rng.choice([" ", "  "]).join(word() for _ in range(rng.randint(1, 4))) for _ in range(150)]
    asked = [rng.choice([" ", ".", ", ", ""]).join(x.split()) + rng.choice(["", "", "b", "acb", "?"]) for x in index[::3]]
    asked += [x[rng.randint(0, 3) :] for x in index] + [unicodedata.normalize("NFD", x) for x in index[:20]] + ["", None, "...", "12 [x] (y", "7. ABC", "abcabcabcabcab"]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    def norm(t):
        t = re.sub(r"[+$%]|\[[^\]]*\]|\([^)]*\)?", "", re.sub(r"^\d+\.?\s*", "", t.strip()))
        return " ".join(t.lower().split())

    fold = lambda t: unicodedata.normalize("NFKD", t)

    def near(q, m):
        """A sign beside a space is part of it; any other is a space or nothing."""
        q = re.sub(r"[.,?]*\s[.,?\s]*", " ", fold(q))
        q = re.sub(r"[.,?]+", "\0", q)
        for chosen in itertools.product(" \0", repeat=q.count("\0")):
            it = iter(chosen)
            v = "".join(next(it) if c == "\0" else c for c in q).replace("\0", "")
            if any(edits(v, fold(m)[s : s + n]) <= 3 for s in range(len(fold(m)) + 1) for n in range(max(0, len(v) - 3), len(v) + 4)):
                return True
        return False

    own = [norm(x) for x in index]
    expected = {}
    for q in {norm(a) for a in asked if a}:
        found = [(abs(1 - len(m) / len(q)), own.index(m), m) for m in set(own) if q and m and 0.8 <= len(m) / len(q) <= 1.2 and near(q, m)]
        if q in own:
            expected[q] = q
        elif found:
            expected[q] = min(found)[2]
    assert any(edits(q, m) > 3 for q, m in expected.items())
    asked = spark.createDataFrame([("k", n) for n in asked], "by string, name string")
    names = spark.createDataFrame([("k", n, at) for at, n in enumerate(index)], "by string, name string, at int")
    assert {r["name"]: r.match for r in W.match_names(asked, names, by="by", name="name", order="at").collect()} == expected
    assert W.match_names(asked, names.filter("false"), by="by", name="name").collect() == []


def test_a_part_of_a_longer_name(spark):
    """Whole names are six edits apart, and a part of one is the other."""
    one = lambda n: spark.createDataFrame([("k", n)], "by string, name string")
    for q, m in (("Galeni de usu partium corporis", "Claudii Galeni de usu partium corporis".replace("Claudii ", "Cl. ")), ("de articulis et ossibus membr", "de articulis et ossibus membrorum"), ("De usu.partium", "De Usu Partium")):
        assert [r.match for r in W.match_names(one(q), one(m), by="by", name="name").collect()] == [m.lower()]
    assert W.match_names(one("de articulis"), one("de articulis et ossibus"), by="by", name="name").collect() == []


def test_annotator(spark, tmp_path):
    """Each worker loads it once, batches don't follow Arrow's, spans below the threshold give nothing, and a bad text costs itself."""
    log = str(tmp_path / "log")

    def factory():
        import os

        with open(log, "a") as f:
            f.write(f"load {os.getpid()}\n")

        def annotator(texts):
            with open(log, "a") as f:
                f.write(f"batch {len(texts)}\n")
            if any("bad" in t for t in texts):
                raise KeyError("bad")
            return [{"text": t.split(), "lemma": t.upper().split(), "spans": [(0, 2, "A", 0.2), (1, 9, "B", 0.9), (0, 9, "C", 0.19)]} for t in texts]

        return annotator

    rows = [(i, f"a b c {i}") for i in range(100)] + [(200, None), (201, ""), (202, "bad one")]
    df = spark.createDataFrame(rows, "id int, content string").coalesce(1)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        good, bad = search.annotated_and_rejected(df, factory, str(tmp_path / "out"), batch_size=32)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    got = {r.id: r.tokens for r in good.collect()}
    assert [(t.text, t.lemma, t.pos, t.category) for t in got[5]] == [("a", "A", None, "A"), ("b", "B", None, "A, B"), ("c", "C", None, "B"), ("5", "5", None, "B")]
    assert len(got) == 102 and got[200] is None and got[201] == []
    assert [tuple(r) for r in bad.collect()] == [(202, "bad one", "KeyError: 'bad'")]
    said = open(log).read().split("\n")[:-1]
    loads = [x for x in said if x.startswith("load")]
    assert len(loads) == len(set(loads)) == 1
    assert [x for x in said if x.startswith("batch")] == ["batch 32"] * 3 + ["batch 6"] + ["batch 1"] * 6
    assert search.annotate(df.filter("false"), factory).collect() == []


def test_token_places(spark):
    rows = spark.createDataFrame([([("a",), ("bb",), ("a",)],)], "tokens array<struct<text:string>>")
    places = [rows.select(search.token_places(F.col("tokens"), F.lit(line)).alias("p")).first()["p"] for line in ("xa bb", "bb", "zz", "a a bb")]
    assert places == [(2, 1, 5), (1, 0, 2), None, (2, 0, 6)]


def test_reference_tags(spark):
    """Many places in one tag against a plain version, and tags that are no citation."""
    import random

    from lectern.operators import divisions as D

    def plain(places):
        out = []
        for v in sorted({p[0] for p in places}):
            chapters = []
            for c in sorted({p[1] for p in places if p[0] == v}):
                runs = []
                for n in sorted({p[2] for p in places if p[:2] == (v, c)}):
                    if runs and runs[-1][1] == n - 1:
                        runs[-1][1] = n
                    else:
                        runs.append([n, n])
                chapters.append(f"Chapter {c}: " + ", ".join(f"Line {a}" if a == b else f"Lines {a}-{b}" for a, b in runs))
            out.append(f"Volume {v}: " + ", ".join(chapters))
        return ", ".join(out)

    rng = random.Random(4)
    cases = [[(rng.choice(["1", "2", "10", "a"]), rng.choice("12b"), rng.randrange(1, 12)) for _ in range(rng.randint(1, 60))] for _ in range(40)]
    rows = [(i, "x <tlg_ref>[0057] [001] [] []" + ", ".join(f"Volume {v}, Chapter {c}, Line {n}" for v, c, n in p) + "</tlg_ref>y", f"x Galen, De usu, {plain(p)}: y") for i, p in enumerate(cases)]
    rows += [
        (100, "<tlg_ref>[0057][9][][]</tlg_ref>", "Galen, Unknown Work: "), (101, "<tlg_ref>1.2.3</tlg_ref> a <tlg_ref></tlg_ref>", "1.2.3 a "), (102, None, ""), (103, "", ""), (104, "<tlg_ref>open", "<tlg_ref>open"),
        (105, "<tlg_ref>[0057] [001] [x] [y]Line z, Line 7\n</tlg_ref><tlg_ref>[1] [1] [] []Chapter 2, Line 3</tlg_ref>", "Galen, De usu (x, y), Line 7: Unknown Author, Unknown Work, Chapter 2: Line 3: "),
    ]
    authors = spark.createDataFrame([("0057", "Galen")], "author_id string, author_name string")
    works = spark.createDataFrame([("0057", "001", "De usu")], "author_id string, work_id string, work_name string")
    got = D.replace_refs(spark.createDataFrame([r[:2] for r in rows], "id int, t string"), "id", "t", authors, works)
    assert {r.id: r.t for r in got.collect()} == {i: want for i, _, want in rows}


def test_dimensions_with_keys(spark):
    import pytest

    seen = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "a"), ("2", "a"), ("3", None), (None, "x")], "author_code string, work_code string")
    authors = spark.createDataFrame([("1", 77)], "author_code string, author_id long")
    texts = spark.createDataFrame([("1", "a", 5)], "author_code string, work_code string, text_id long")
    made = [sorted(map(tuple, x.collect())) for x in W.create_dims(seen, authors, texts)]
    assert made == [sorted(map(tuple, x.collect())) for x in W.create_dims(seen.repartition(3), authors, texts)]
    ids = {code: i for i, code, _ in made[0]}
    assert set(ids) == {"2", "3"} and [(a, c, w, t) for _, a, c, w, t in sorted(made[1], key=lambda r: r[2:])] == [(77, "1", "b", "Work b"), (ids["2"], "2", "a", "Work a")]
    with pytest.raises(Exception, match="two rows have the author_id 9"):
        W.create_dims(seen, authors, texts, make=lambda *x: F.lit(9).cast("long"))[0].collect()
    with pytest.raises(Exception, match="two rows have the text_id 5"):
        W.create_dims(seen.filter("work_code = 'b'"), authors, texts, make=lambda *x: F.lit(5).cast("long"))[1].collect()


def test_names_meet_without_a_broadcast_and_bags_bound_edits(spark):
    """Neither side of the candidates passes through the driver, however small it looks, and a bag lacks no more letters than there are edits."""
    rows = [("deltarho", "deltarho", 0), ("aab", "ab", 1), ("hot bolt", "cold plate", 5)]
    made = spark.createDataFrame(rows, "q string, m string, most int")
    got = {r.q: (r.n, r.most) for r in made.select("q", "most", W.lacking(W.bag(F.col("q")), W.bag(F.col("m"))).alias("n")).collect()}
    assert all(n <= most for n, most in got.values()) and got["aab"][0] == 1 and got["hot bolt"][0] > 3, got
    names = spark.createDataFrame([("k", "de articulis", 1), ("k", "de ossibus", 2)], "by string, name string, at int")
    plan = W.match_names(names.select("by", F.concat("name", F.lit("x")).alias("name")), names, by="by", name="name", order="at")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [by" not in plan.split("part_edits")[1].split("Union")[0] and "SortMergeJoin [by" in plan, plan


def test_written_texts_share_files(spark, tmp_path):
    """Files don't grow in number with the texts: many texts are in one, each under its header, and tagged lines have their text's id."""
    import glob

    from lectern.plans import corpus

    where = corpus._written(spark, "/root/testdata/sf0.001")
    found = glob.glob(f"{where.removeprefix('file://')}/**/*.txt", recursive=True)
    assert 0 < len(found) < 20
    tagged = spark.range(300).select(F.col("id").cast("string").alias("text_id"), F.lit("a").alias("text"), F.expr("cast(array() as array<struct<text:string,lemma:string>>)").alias("tokens")).coalesce(2)
    files.write_tagged_jsonl(tagged, str(tmp_path / "tagged"))
    assert len(glob.glob(f"{tmp_path}/tagged/**/*.json", recursive=True)) == 2
    assert files.read_tagged_jsonl(spark, str(tmp_path / "tagged")).select("text_id").distinct().count() == 300


def test_sentences_are_not_repeated_before_their_entries(spark, tmp_path):
    rows = spark.createDataFrame([(2, "c2", "a b", ["b", "a"]), (1, "c1", "a", ["a", None]), (3, "c3", None, [])], "sentence_id long, citation string, text string, l array<string>")
    rows = rows.withColumn("tokens", F.transform("l", lambda x: F.struct(x.alias("lemma")))).drop("l")
    made = lexicon.lemma_entries(rows, str(tmp_path / "e"), context=("text",))
    got = {r.lemma: (r.n, r.primary, [tuple(c) for c in r.citations], {k: v.text for k, v in r.contexts.items()}) for r in made.collect()}
    assert got == {"a": (2, 1, [("c1", "a"), ("c2", "a b")], {1: "a", 2: "a b"}), "b": (1, 2, [("c2", "a b")], {2: "a b"})}
    assert "explode" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_names_meet_counts_of_texts(spark):
    from lectern.plans import corpus

    plan = corpus.corpus_stats(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("Join LeftOuter")[1].split("\n")[1].strip().startswith(":- Aggregate"), plan


def test_one_category_and_only_the_fields_asked_for(spark):
    from lectern.operators import search
    from lectern.plans import views

    rows = spark.createDataFrame([("of extraordinary things",), ("Some things",), ("",)], "content string")
    made = rows.select("content", search.has_category(views.tokens_of(F.col("content"), ("category",)), "Rare").alias("rare"))
    assert {r.content: r.rare for r in made.collect()} == {"of extraordinary things": True, "Some things": False, "": False}
    assert "lower(" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_divisions_are_dealt_out_once_and_plain(spark, tmp_path):
    """The entries of sentences that stand by division are those of single sentences; what is shuffled by part has no tokens and no neighbours."""
    import random

    from lectern.plans import views as V

    rng = random.Random(6)
    texts = {d: [" ".join(rng.choice(["a", "Bé", "c", "dd"]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.choice([1, 2, 3, 30]))] for d in range(1, 25)}
    texts |= {30: [], 31: ["", "x", None, "y"]}
    rows = [(d * 100 + i, f"c{d}.{i}", t, own[i - 1] if i else None, own[i + 1] if i + 1 < len(own) else None) for d, own in texts.items() for i, t in enumerate(own)]
    sentences = spark.createDataFrame(rows, "sentence_id long, citation string, text string, prev string, next string").withColumn("tokens", V.tokens_of(F.col("text")))
    listed = [(d, [(d * 100 + i, f"c{d}.{i}", t) for i, t in enumerate(own)]) for d, own in texts.items()]
    divisions = spark.createDataFrame(listed, "division_id long, sentences array<struct<sentence_id:long,citation:string,text:string>>")
    sizes = spark.createDataFrame([(d, sum(len((t or "").encode()) for t in own)) for d, own in texts.items()], "division_id long, bytes long")
    for name in (("text", "prev", "next", "tokens"), ()):
        plain = lexicon.lemma_entries(sentences, str(tmp_path / f"a{len(name)}"), part_bytes=40, context=name)
        made = lexicon.division_entries(divisions, sizes, str(tmp_path / f"b{len(name)}"), tokens=V.tokens_of, part_bytes=40, context=name)
        assert made._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(part") == 1
        assert made.columns == plain.columns
        assert sorted(map(str, made.collect())) == sorted(map(str, plain.collect())) and made.select("part").distinct().count() > 5


def test_lexical_entries_move_texts_alone(spark, tmp_path):
    from lectern.plans import registry

    spark.createDataFrame([(1, "One a. Two\nb. Three", "en", "src1", 20)], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("lexical_contexts", "lexical_prompts"):
        made = registry.QUERIES[name](spark, str(tmp_path))
        plan = made._jdf.queryExecution().executedPlan().toString()
        above, below = plan.split("hashpartitioning(part")
        assert r"[\p{L}]+" in above and r"[\p{L}]+" not in below, name
        assert sorted(r.lemma for r in made.collect()) == ["a", "b", "one", "three", "two"]


def test_tagged_lines_of_queries_are_compressed(spark, tmp_path, monkeypatch):
    import glob

    from lectern.plans import corpus, registry

    spark.createDataFrame([(i, "One a. Two\nb. Three. Four", "en", "src1", 20) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars int").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus.context, "scratch", lambda spark: f"{tmp_path}/{len(glob.glob(f'{tmp_path}/*'))}")
    assert {tuple(r) for r in registry.QUERIES["write_tagged_jsonl"](spark, str(tmp_path)).collect()} == {(str(i), 4) for i in range(40)}
    rows = registry.QUERIES["read_tagged_jsonl"](spark, str(tmp_path)).collect()
    assert len(rows) == 160 and {(r.text, r.n_tokens, r.lemmas) for r in rows} == {("One a.", 2, "one a"), ("Two b.", 2, "two b"), ("Three.", 1, "three"), ("Four.", 1, "four")}
    found = glob.glob(f"{tmp_path}/*/tagged/part-*")
    assert len(found) == 2 and all(f.endswith(".json.gz") for f in found)
    files.write_tagged_jsonl(spark.read.schema(files.TAGGED).json(f"{tmp_path}/*/tagged").coalesce(1), str(tmp_path / "few"), compression="gzip", most=100)
    assert len(glob.glob(f"{tmp_path}/few/part-*")) == 4 and files.read_tagged_jsonl(spark, str(tmp_path / "few")).count() == 320
