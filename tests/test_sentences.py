"""Sentences against a plain state machine, and links against character positions."""

import random

from pyspark.sql import functions as F

from lectern.operators import sentences as S

SCHEMA = "division_id long, line_id long, line_number int, content string, is_title boolean"


def build(spark, divisions):
    rows = [(d, d * 100 + n, n, c, False) for d, lines in divisions.items() for n, c in enumerate(lines, 1)]
    lines = spark.createDataFrame(rows, SCHEMA)
    got = S.cited_sentences(lines, with_lines=True).withColumn("sentence_id", F.col("division_id") * 1000 + F.col("k"))
    links = got.select("sentence_id", "division_id", F.explode(F.arrays_zip("line_ids", "lines")).alias("x")).select("sentence_id", "division_id", F.col("x.line_ids").alias("line_id"), F.col("x.lines").alias("line"))
    return got, links.withColumn("line_number", F.col("line_id") % 100)


def texts(got):
    out = {}
    for r in sorted(got.collect(), key=lambda r: (r.division_id, r.k)):
        out.setdefault(r.division_id, []).append(r.content)
    return out


def machine(lines):
    """Line by line: join, then cut whatever is finished."""
    out, rest = [], ""
    for i, line in enumerate(lines):
        if not rest:
            rest = line
        elif lines[i - 1].endswith("-"):
            rest = rest[:-1] + line
        elif len(rest) > 1 and rest[-1] in ".·" and not rest[-2].isspace():
            rest = rest + " " + line
        elif line[0] in ".,;:·":
            rest += line
        else:
            rest += " " + line
    at = 0
    i = 1
    while i < len(rest):
        if rest[i] in ".·" and not rest[i - 1].isspace() and (i + 1 == len(rest) or rest[i + 1] == " "):
            out.append(rest[at : i + 1])
            at = i + 2
            i += 1
        i += 1
    if at < len(rest):
        out.append(rest[at:] if rest[-1] in ".·" else rest[at:] + ".")
    return out


def test_literal_rows(spark):
    got, links = build(spark, {
        1: ["First sentence· Second sentence."], 2: ["This sentence spans", "multiple lines and", "ends here."],
        3: ["This sen-", "tence has hyphenation."], 4: ["First sentence... Second sentence."], 5: ["no end"],
    })
    assert texts(got) == {1: ["First sentence·", "Second sentence."], 2: ["This sentence spans multiple lines and ends here."], 3: ["This sentence has hyphenation."], 4: ["First sentence...", "Second sentence."], 5: ["no end."]}
    numbers = {r.sentence_id: list(r.line_numbers) for r in S.sentence_line_numbers(links).collect()}
    assert numbers[2001] == [1, 2, 3] and numbers[3001] == [1, 2] and numbers[1001] == [1] == numbers[1002]


def test_random_divisions(spark):
    rng = random.Random(5)
    words = ["ab", "c", "de.", "f·", "g,", "h"]
    divisions = {d: [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "-"]) for _ in range(rng.randint(1, 6))] for d in range(1, 150)}
    got, links = build(spark, divisions)
    assert texts(got) == {d: machine(lines) for d, lines in divisions.items()}
    links = links.collect()
    touched = {r.line_id for r in links}
    assert all(r.line == divisions[r.division_id][r.line_number - 1] for r in links)
    # The lines of a sentence, by the places of its signs in the joined text.
    for d, lines in divisions.items():
        text, ends = "", []
        for i, line in enumerate(lines):
            if i and lines[i - 1].endswith("-"):
                text = text[:-1]
                ends[-1] -= 1
                text += line
            elif i and (len(text) > 1 and text[-1] in ".·" and not text[-2].isspace() or line[0] not in ".,;:·"):
                text += " " + line
            else:
                text += line
            ends.append(len(text))
        at, want = 0, []
        for sentence in machine(lines):
            size = len(sentence) if text[at : at + len(sentence)] == sentence else len(sentence) - 1
            want.append([i + 1 for i, e in enumerate(ends) if (ends[i - 1] if i else 0) < at + size and at < e and text[max(at, ends[i - 1] if i else 0) : min(at + size, e)].strip()])
            at += size + 1
        assert [sorted(r.line_number for r in links if r.sentence_id == d * 1000 + k) for k in range(1, len(want) + 1)] == want
    assert touched == {d * 100 + n for d, lines in divisions.items() for n in range(1, len(lines) + 1)}


def test_hyphen_chains(spark):
    lines = spark.createDataFrame([(1, 1, 1, "a-", False), (1, 2, 2, "b-", False), (1, 3, 3, "c", False), (1, 4, 4, "d", False)], SCHEMA)
    assert [(r.line_number, r.content) for r in S.merge_hyphen_lines(lines).orderBy("line_number").collect()] == [(1, "abc"), (4, "d")]


def test_places_are_worked_out_once_a_division(spark):
    """Nothing but field access stands between the exploded sentences and their lines: what an array is made of beside or after the explode is made again for every sentence."""
    lines = spark.createDataFrame([(1, 1, 11, "One a. Two", False), (1, 2, 12, "b. Three", False), (1, 3, 13, "c.", False)], "division_id long, line_number int, line_id long, content string, is_title boolean")
    rows = S.cited_sentences(lines, with_lines=True)
    got = [(r.k, r.content, r.line_ids, r.line_numbers, r.lines) for r in rows.orderBy("k").collect()]
    assert got == [(1, "One a.", [11], [1], ["One a. Two"]), (2, "Two b.", [11, 12], [1, 2], ["One a. Two", "b. Three"]), (3, "Three c.", [12, 13], [2, 3], ["b. Three", "c."])]
    links = rows.select("k", F.explode("line_ids").alias("line_id")).groupBy("k").agg(F.min("line_id"))
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 2, plan
    assert "line_ids" not in S.cited_sentences(lines, with_places=False).columns
