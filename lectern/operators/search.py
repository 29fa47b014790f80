"""Searches over sentences, lines and texts; all are filters that a scan can take, or equi-joins."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lectern.functions.text import once


def contains_text(c: Column, query: str) -> Column:
    """Case-insensitive; % and _ of the query are literal."""
    return F.lower(c).contains(query.lower())


def has_lemma(tokens: Column, lemma: str) -> Column:
    return F.exists(tokens, lambda t: t["lemma"] == lemma)


def has_token(tokens: Column, *, category: str | None = None, pos: str | None = None) -> Column:
    """One token meets all that is asked."""

    def meets(t: Column) -> Column:
        c = F.lit(True)
        if category is not None:
            c = c & F.lower(t["category"]).contains(category.lower())
        if pos is not None:
            c = c & (t["pos"] == pos)
        return c

    return F.exists(tokens, meets)


def split_categories(tokens: Column) -> Column:
    """Distinct single categories, sorted."""
    single = F.flatten(F.transform(tokens, lambda t: F.split(t["category"], ", ")))
    return F.array_sort(F.array_distinct(F.filter(single, lambda x: x != "")))


def has_category(tokens: Column, category: str) -> Column:
    """One token has the category among its own; ends at the first."""
    return F.exists(tokens, lambda t: F.array_contains(F.split(t["category"], ", "), category))


def raw_categories(tokens: Column) -> Column:
    """The tokens' category strings as they are, without empty ones."""
    return F.filter(F.transform(tokens, lambda t: t["category"]), lambda x: x != "")


def pos_lemma_categories(tokens: Column) -> Column:
    """noun:lemma, verb:lemma and adj:lemma, distinct and sorted."""
    kept = F.filter(tokens, lambda t: t["pos"].isin("NOUN", "VERB", "ADJ"))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda t: F.concat(F.lower(t["pos"]), F.lit(":"), t["lemma"]))))


def categories_any(c: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(c, F.array(*map(F.lit, wanted)))


def categories_all(c: Column, wanted: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), c)) == 0


@F.pandas_udf(StringType())
def decomposed(text: pd.Series) -> pd.Series:
    """Canonically decomposed lower case; Spark has no function for it."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFD", t).lower())


def has_lemma_normalized(tokens: Column, lemma: str) -> Column:
    """One token has the lemma, up to case and canonical composition."""
    return F.exists(tokens, lambda t: equal_normalized(t["lemma"], lemma))


def with_normal(rows: DataFrame, column: str, out: str = "normal") -> DataFrame:
    """rows with the decomposed lower case of a text, to be stored with it, so that searches need no Python."""
    return rows.withColumn(out, decomposed(F.col(column)))


def search_normalized(rows: DataFrame, column: str, query: str) -> DataFrame:
    """Rows whose stored normal form (a column of :func:`with_normal`) has the query's."""
    return rows.filter(F.col(column).contains(unicodedata.normalize("NFD", query).lower()))


def equal_normalized(c: Column, value: str) -> Column:
    """Equal up to case and canonical composition, by collation."""
    return F.collate(c, "UNICODE_CI") == F.collate(F.lit(value), "UNICODE_CI")


def tokens_in_line(tokens: Column, line: Column) -> Column:
    """(i, start, end) of the tokens found left to right in the line, each from the end of the last hit."""
    none = F.array().cast("array<struct<i:int,start:int,end:int>>")

    def step(acc: Column, t: Column) -> Column:
        at = F.call_function("locate", t["text"], line, acc["at"])
        end = at - 1 + F.length(t["text"])
        hit = F.array(F.struct(acc["i"].alias("i"), (at - 1).alias("start"), end.alias("end")))
        return F.struct(F.when(at > 0, end + 1).otherwise(acc["at"]).alias("at"), (acc["i"] + 1).alias("i"), F.when(at > 0, F.concat(acc["hits"], hit)).otherwise(acc["hits"]).alias("hits"))

    start = F.struct(F.lit(1).alias("at"), F.lit(0).alias("i"), none.alias("hits"))
    return F.aggregate(tokens, start, step, lambda acc: acc["hits"])


TOKEN = "array<struct<text:string,lemma:string,pos:string,category:string>>"

#: What an annotator finds in a text: a list for each field of a token, and under ``spans`` (first token, token after the last, label, score).
Annotation = dict[str, list]
Annotator = Callable[[list[str]], list[Annotation]]
#: Annotators that this worker has loaded, by their pickled factories.
_LOADED: dict[bytes, Annotator] = {}


def _loaded(factory: bytes) -> Annotator:
    if factory not in _LOADED:
        _LOADED[factory] = cloudpickle.loads(factory)()
    return _LOADED[factory]


def _categories(found: Annotation, size: int, threshold: float) -> list[str]:
    """The labels of the spans over each token whose score is enough, in the order of the spans."""
    labels: list[list[str]] = [[] for _ in range(size)]
    for start, end, label, score in found.get("spans", ()):
        if score >= threshold:
            for i in range(max(start, 0), min(end, size)):
                labels[i].append(label)
    return [", ".join(x) for x in labels]


def _tried(annotator: Annotator, texts: list[str]) -> list[tuple[Annotation | None, str | None]]:
    """What is found in each text; if the batch fails, each on its own, and the error of those that fail again."""
    try:
        found = annotator(texts)
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} results for {len(texts)} texts")
        return [(x, None) for x in found]
    except Exception as e:  # noqa: BLE001 an annotator may fail in any way
        return _tried(annotator, texts[:1]) + [y for t in texts[1:] for y in _tried(annotator, [t])] if len(texts) > 1 else [(None, f"{type(e).__name__}: {e}")] * len(texts)


def annotate(rows: DataFrame, factory: Callable[[], Annotator], *, text: str = "content", out: str = "tokens", schema: str = TOKEN, batch_size: int = 1000, category_threshold: float = 0.2) -> DataFrame:
    """rows with the tokens that a batch annotator finds, and error: why a text has none, null where all went well.

    factory: a picklable function that loads the annotator; each Python worker calls it once. Texts are handed on in batches of batch_size, whatever the size of Arrow's;
    a batch that fails is tried text by text, so one bad text costs one row. A token's category is the labels of the spans over it with at least the
    threshold's score. A null text has null tokens and no error. Rows with their tokens come as they are ready, so a task holds one batch.
    """
    fields = [f.name for f in StructType.fromDDL(f"x {schema}")["x"].dataType.elementType.fields]
    made = StructType([*rows.schema.fields, StructField(out, StructType.fromDDL(f"x {schema}")["x"].dataType), StructField("error", StringType())])
    pickled, kind = cloudpickle.dumps(factory), pa.struct([(f, pa.string()) for f in fields])

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        texts = table.column(text).to_pylist()
        given = [t for t in texts if t is not None]
        results = iter(_tried(_loaded(pickled), given) if given else ())
        flat: dict[str, list] = {f: [] for f in fields}
        offsets, errors = [0], []
        missing = []
        for t in texts:
            found, error = next(results) if t is not None else (None, None)
            size = len(found[fields[0]]) if found else 0
            for f in fields if found else ():
                flat[f] += found[f] if f in found else _categories(found, size, category_threshold) if f == "category" else [None] * size
            missing.append(found is None)
            errors.append(error)
            offsets.append(offsets[-1] + size)
        values = pa.StructArray.from_arrays([pa.array(flat[f], pa.string()) for f in fields], fields=list(kind))
        tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=pa.array(missing, pa.bool_()))
        yield from table.append_column(out, tokens).append_column("error", pa.array(errors, pa.string())).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in batches:
            while len(batch):
                part = batch.slice(0, batch_size - n)
                batch, n = batch.slice(len(part)), n + len(part)
                waiting.append(part)
                if n == batch_size:
                    yield from done(pa.Table.from_batches(waiting))
                    waiting, n = [], 0
        if waiting:
            yield from done(pa.Table.from_batches(waiting))

    return rows.mapInArrow(run, made)


def annotated_and_rejected(rows: DataFrame, factory: Callable[[], Annotator], where: str, **options) -> tuple[DataFrame, DataFrame]:
    """Rows with tokens, and rows that the annotator failed on with the error. All are written to the folder once, so nothing is annotated twice."""
    found = annotate(rows, factory, **options)
    found.write.mode("overwrite").parquet(where)
    found = rows.sparkSession.read.schema(found.schema).parquet(where)
    return found.filter("error is null").drop("error"), found.filter("error is not null").drop(options.get("out", "tokens"))


def token_places(tokens: Column, line: Column) -> Column:
    """(n_hits, position_start, position_end) of a sentence's tokens in one of its lines, found left to right, each from the end of the last hit; null where none is found.

    position_start is where the first token found stands first in the line, position_end where the last one found ends last. One fold carries the
    number of hits and the first and last token found.
    """

    def step(acc: Column, t: Column) -> Column:
        def moved(at: Column) -> Column:
            hit = at > 0
            return F.struct(F.when(hit, at + F.length(t["text"])).otherwise(acc["at"]).alias("at"), (acc["n"] + hit.cast("int")).alias("n"), F.coalesce(acc["first"], F.when(hit, t["text"])).alias("first"), F.when(hit, t["text"]).otherwise(acc["last"]).alias("last"))

        return once(F.call_function("locate", t["text"], line, acc["at"]), moved)

    def found(acc: Column) -> Column:
        end = F.length(line) - F.call_function("locate", F.reverse(acc["last"]), F.reverse(line)) + 1
        return F.when(acc["n"] > 0, F.struct(acc["n"].alias("n_hits"), (F.call_function("locate", acc["first"], line) - 1).alias("position_start"), end.alias("position_end")))

    none = F.lit(None).cast("string")
    return F.aggregate(tokens, F.struct(F.lit(1).alias("at"), F.lit(0).alias("n"), none.alias("first"), none.alias("last")), step, found)
