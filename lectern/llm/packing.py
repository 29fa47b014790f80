"""Best-two-fit packing of documents into token sequences.

Tokenizing gives one light row per piece (length and digest, no ids), and pieces are dealt to shards
by hash. A shard packs on its own: each sequence is filled greedily with the largest piece that fits;
if a gap stays, the sequence's smallest piece is taken out again where two pieces not yet packed fill
the widened gap more tightly. A shard works on counts by length, so its time grows with the number of
sequences; all shards together leave at most one sequence each that is filled worse than the rest.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import common
from lectern.llm.tokens import encoder

SHARD_PIECES = 200_000
#: Longer texts are encoded in overlapping chunks of so many code points.
CHUNK_CHARS = 1 << 20


def token_pieces(docs: DataFrame, path: str, *, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row, piece, start, length and ids_crc32: each document's ids and end_id, cut into pieces of size where longer.

    The first piece of a cut document takes the remainder. Null and empty texts have end_id alone.
    Rows of one id are kept apart by ``row``. Further columns are left aside. Very long texts are encoded in chunks.
    """
    common.small_batches(docs.sparkSession)

    def cut(batch: pa.RecordBatch):
        out = defaultdict(list)
        for i, ids in enumerate(encoder(path).ids(common.texts(batch), CHUNK_CHARS)):
            ids = np.append(ids, np.uint32(end_id)).astype("<u4")
            at, n = 0, len(ids) % size or size
            while at < len(ids):
                piece = ids[at : at + n]
                for k, v in (("i", i), ("piece", -(-at // size)), ("start", at), ("length", len(piece)), ("crc", zlib.crc32(piece.tobytes()))):
                    out[k].append(v)
                at, n = at + n, size
        take = pa.array(out["i"], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"].take(take), batch["row"].take(take), pa.array(out["piece"], pa.int32()), *(pa.array(out[k], pa.int64()) for k in ("start", "length", "crc"))],
            names=["doc_id", "row", "piece", "start", "length", "ids_crc32"],
        )

    rows = common.id_text(docs, id_col, text_col).select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return common.map_batches(rows, cut, f"doc_id {kind}, row bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_two_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece."""
    order = np.argsort(lengths, kind="stable")
    ends = np.searchsorted(lengths[order], np.arange(size + 2))
    left = np.diff(ends)  # pieces of each length that aren't packed yet
    fits = [-1] * (size + 1)  # the largest length up to the index that is left; followed lazily

    def largest(most: int) -> int:
        path = []
        while most > 0 and not left[most]:
            path.append(most)
            most = fits[most] if fits[most] >= 0 else most - 1
        for p in path:
            fits[p] = most
        return most

    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    number = 0
    while (n := largest(size)) > 0:
        inside = [n]
        left[n] -= 1
        gap = size - n
        while gap and (n := largest(gap)):
            inside.append(n)
            left[n] -= 1
            gap -= n
        if gap and len(inside) > 1:
            # Lengths fall while a bin is filled, so the last is the smallest; two that are left may fill its place better.
            room, best = inside[-1] + gap, None
            a = largest(room - 1)
            while a * 2 > inside[-1]:
                left[a] -= 1
                b = largest(min(a, room - a))
                left[a] += 1
                if b and a + b > (sum(best) if best else inside[-1]):
                    best = (a, b)
                    if a + b == room:
                        break
                a = largest(a - 1)
            if best:
                left[inside.pop()] += 1
                fits = [-1] * (size + 1)
                for n in best:
                    left[n] -= 1
                inside += best
        at = 0
        for n in inside:
            ends[n] += 1
            i = order[ends[n] - 1]
            bins[i], offsets[i] = number, at
            at += n
        number += 1
    return bins, offsets


def pack(docs: DataFrame, path: str, *, size: int = 1024, end_id: int = 2, shard_pieces: int = SHARD_PIECES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of :func:`token_pieces` with sequence_id and offset: gapless from 0 in sequences of at most size tokens.

    Null and empty texts are one token; repeated rows are packed one by one; ties between pieces of one
    length go by id and piece; an empty table gives no rows. Full pieces are a sequence of their own.
    """
    spark = docs.sparkSession
    where = common.scratch(spark)
    pieces = common.saved(token_pieces(docs, path, size=size, end_id=end_id, id_col=id_col, text_col=text_col), f"{where}/pieces")
    shards = 1 + pieces.filter(F.col("length") < size).count() // shard_pieces

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "row", "piece"]).reset_index(drop=True)
        bins, offsets = best_two_fit(pdf["length"].to_numpy(), size)
        return pdf[["row", "piece"]].assign(sequence_id=bins * shards + int(key[0]), offset=offsets)

    part = pieces.filter(F.col("length") < size).select("doc_id", "row", "piece", "length", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).alias("shard"))
    packed = part.groupBy("shard").applyInPandas(fill, "row bigint, piece int, sequence_id bigint, offset bigint")
    rest = pieces.filter(F.col("length") < size).join(packed, ["row", "piece"])
    full = pieces.filter(F.col("length") >= size)
    own = -1 - F.monotonically_increasing_id()  # below zero, so unlike any number of a shard
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return full.withColumns({"sequence_id": own, "offset": F.lit(0).cast("long")}).select(columns).unionByName(rest.select(columns))
