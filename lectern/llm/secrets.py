"""Secret scans with DataFrame functions alone.

Fixed kinds are found by pattern. Beyond those, long runs of token characters are candidates: a window
slides over each, the counts of its characters are kept up to date one character in and one out, and with
them the Shannon entropy. A run whose best window is above the limit of its character class is a span,
unless an allow-list pattern matches it or a fixed kind already covers it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import common

#: Kind, pattern, and the least length of the part that counts. Groups 1 and 2 are the whole match and that part.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 8),
    ("access", r"((AKIA[A-Z0-9]+))", 16),
    ("hex", r"(([0-9a-f]{32,}))", 32),
)
WINDOW = 20
#: Character class of a candidate, the class as a pattern, and the least entropy of its best window, in bits.
CLASSES = (("entropy-hex", "^[0-9a-fA-F]+$", 3.1), ("entropy-base64", "^[A-Za-z0-9+/_=-]+$", 3.85))
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(([A-Za-z0-9+/_=-]{20,}))"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Runs that look random and aren't secret.
ALLOW = (
    r"(?i)example|sample|placeholder|changeme|xxxx",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)0123456789|abcdefghij|qwertyuiop",
    r"^[^0-9]*$|^[^A-Za-z]*$",
)


def _matches(text: Column, pattern: str, least: int) -> Column:
    """(start, end, part) of each match, leftmost first, in code points from 0; those with a shorter part are left out.

    Each element is what stands before a match and the match; the last has the rest of the text, so that
    no position is tried twice.
    """
    whole = rf"(?s)(.*?)(?:{pattern}|\z)"
    pieces = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(whole), F.lit(i)).alias(n) for i, n in ((1, "gap"), (2, "hit"), (3, "part"))))
    none = F.array().cast("array<struct<start:int,end:int,part:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["part"].alias("part")))
        return F.struct(end.alias("at"), F.when(F.length(x["part"]) >= least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(none)


def best_entropy(run: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy of a window of the run, by counts that follow the window."""
    codes = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    size = len(ALPHABET) + 1
    term = lambda n: F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))

    def step(acc: Column, i: Column) -> Column:
        enters, leaves = F.get(codes, i), F.when(i >= window, F.get(codes, i - window)).otherwise(F.lit(-1))
        same = enters == leaves
        n_in, n_out = F.get(acc["n"], enters), F.when(leaves >= 0, F.get(acc["n"], leaves)).otherwise(F.lit(0))
        change = term(n_in + 1) - term(n_in) + F.when(leaves >= 0, term(n_out - 1) - term(n_out)).otherwise(F.lit(0.0))
        total = F.when(same, acc["total"]).otherwise(acc["total"] + change)
        n = F.transform(acc["n"], lambda c, k: c + F.when(k == enters, 1).otherwise(0) - F.when(k == leaves, 1).otherwise(0))
        h = F.when(i >= window - 1, F.lit(math.log2(window)) - total / window).otherwise(F.lit(0.0))
        return F.struct(n.alias("n"), total.alias("total"), F.greatest(acc["best"], h).alias("best"))

    start = F.struct(F.array_repeat(F.lit(0), size).alias("n"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))
    return F.aggregate(F.sequence(F.lit(0), F.length(run) - 1), start, step, lambda acc: acc["best"])


def scan(docs: DataFrame, *, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """docs with the array column ``out`` of (start, rank, end, kind), sorted; rank is below 3 for fixed kinds.

    Null and empty texts have none; no row is moved or dropped, and all columns stay, but for one named ``out``. Texts of any
    length are scanned whole, in one row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base, runs = common.free_name(docs, "__base"), common.free_name(docs, "__runs")

    def ranked(r: int, k: str):
        return lambda m: F.struct(m["start"].alias("start"), F.lit(r).alias("rank"), m["end"].alias("end"), F.lit(k).alias("kind"))

    parts = [F.transform(_matches(text, pattern, least), ranked(rank, kind)) for rank, (kind, pattern, least) in enumerate(KINDS)]
    docs = docs.withColumn(base, F.concat(*parts)).withColumn(runs, _matches(text, CANDIDATE, WINDOW))
    allowed = lambda s: F.coalesce(*[F.when(s.rlike(p), True) for p in ALLOW], F.lit(False))
    fresh = F.filter(F.col(runs), lambda m: ~allowed(m["part"]) & ~F.exists(F.col(base), lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    docs = docs.withColumn(runs, F.transform(fresh, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["part"].alias("part"), best_entropy(m["part"]).alias("h"))))
    none = F.lit(len(KINDS) + len(CLASSES))
    rank = lambda m: F.coalesce(*[F.when(m["part"].rlike(p), F.when(m["h"] >= limit, F.lit(len(KINDS) + i)).otherwise(none)) for i, (_, p, limit) in enumerate(CLASSES)], none)
    kinds = F.array(*[F.lit(k) for k, _, _ in CLASSES], F.lit("none"))
    added = F.transform(F.col(runs), lambda m: F.struct(m["start"].alias("start"), rank(m).alias("rank"), m["end"].alias("end"), F.get(kinds, rank(m) - len(KINDS)).alias("kind")))
    return docs.withColumn(out, F.array_sort(F.concat(F.col(base), F.filter(added, lambda s: s["rank"] < none)))).drop(base, runs)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the fixed kinds, base_sha256 over the fixed spans, and all spans as text.

    Rows are kept one by one, with null ids too; further columns are left aside; empty tables give no rows.
    """
    found = scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    base = F.filter("secrets", lambda s: s["rank"] < len(KINDS))
    of = lambda i: lambda s: s["rank"] == i
    counts = [F.size(F.filter("secrets", of(i))).cast("long").alias(f"n_{k}") for i, (k, _, _) in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))


def redact(docs: DataFrame, *, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of :func:`scan` in the text replaced by the mark; overlapping spans become one.

    Other texts stay as they are, null and empty ones too; all rows, repeated ones too, and all columns stay.
    """
    text, spans = F.col(text_col), common.free_name(docs, "__spans")

    def step(acc: Column, s: Column) -> Column:
        cut = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], cut).otherwise(acc["out"]).alias("out"))

    folded = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return scan(docs, text_col=text_col, out=spans).withColumn(text_col, F.when(F.size(spans) > 0, folded).otherwise(text)).drop(spans)


def _sql_matches(name: str, pattern: str) -> str:
    whole = rf"(?s)(.*?)(?:{pattern}|\z)".replace("'", "''")
    lists = ", ".join(f"regexp_extract_all(coalesce(text, ''), '{whole}', {i}) AS {n}" for i, n in ((1, "gaps"), (2, "hits"), (3, "parts")))
    return f"""{name}_l AS (SELECT doc_id, rid, {lists} FROM docs),
{name}_u AS (SELECT doc_id, rid, unnest(gaps) AS gap, unnest(hits) AS hit, unnest(parts) AS part, generate_subscripts(gaps, 1) AS i FROM {name}_l),
{name} AS (SELECT doc_id, rid, hit, part, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY rid ORDER BY i) AS BIGINT) AS e FROM {name}_u)"""


def report_sql() -> str:
    """DuckDB SQL for :func:`report` over ``documents``."""
    parts = [_sql_matches(k, p) for k, p, _ in KINDS] + [_sql_matches("runs", CANDIDATE.split(")", 1)[1])]
    base = " UNION ALL ".join(f"SELECT rid, {i} AS rank, '{k}' AS kind, e - length(hit) AS s, e FROM {k} WHERE length(part) >= {n}" for i, (k, _, n) in enumerate(KINDS))
    allow = " OR ".join("regexp_matches(part, '{}')".format(p.replace("'", "''")) for p in ALLOW)
    cases = " ".join(f"WHEN regexp_matches(part, '{p}') THEN CASE WHEN h >= {limit} THEN {len(KINDS) + i} END" for i, (_, p, limit) in enumerate(CLASSES))
    names = " ".join(f"WHEN {len(KINDS) + i} THEN '{k}'" for i, (k, _, _) in enumerate(CLASSES))
    counts = ", ".join(f"count(*) FILTER (WHERE rank = {i}) AS n_{k}" for i, (k, _, _) in enumerate(KINDS))
    return f"""WITH docs AS (SELECT doc_id, text, row_number() OVER () AS rid FROM documents),
{", ".join(parts)},
base AS ({base}),
fresh AS (SELECT rid, e - length(hit) AS s, e, part, list_max(list_transform(range(1, length(part) - {WINDOW - 2}), lambda i: list_aggregate(string_split(substr(part, i, {WINDOW}), ''), 'entropy'))) AS h
  FROM runs r WHERE length(part) >= {WINDOW} AND NOT ({allow}) AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = r.rid AND b.s < r.e AND r.e - length(r.hit) < b.e)),
added AS (SELECT rid, CASE {cases} END AS rank, s, e FROM fresh),
spans AS (SELECT rid, rank, kind, s, e FROM base UNION ALL SELECT rid, rank, CASE rank {names} END, s, e FROM added WHERE rank IS NOT NULL),
texts AS (SELECT *, concat_ws(':', kind, s, e) AS t FROM spans),
found AS (SELECT rid, {counts}, coalesce(string_agg(t, ',' ORDER BY s, rank) FILTER (WHERE rank < {len(KINDS)}), '') AS base_t, string_agg(t, ',' ORDER BY s, rank) AS all_t FROM texts GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k, _, _ in KINDS)}, sha256(coalesce(base_t, '')) AS base_sha256, coalesce(all_t, '') AS spans
FROM docs LEFT JOIN found USING (rid)"""
