"""Token counts by overlap resynchronisation.

Texts of up to ``chunk_chars`` code points are encoded whole. A huge text is encoded in overlapping
chunks with offsets; two neighbours are spliced at a token boundary that both have and that is proven
stable: a single space before a character that isn't white space always starts a new pre-token, and so does,
under the usual pattern, a letter, digit, sign or line end after one of another class, so
what follows it is encoded alike whatever stood before. Where an overlap holds no such place it is
widened until there is one or the text ends. Files of ``sentencepiece`` aren't spliced, since nothing is proven of them.

The same fact makes other texts cheap: between two such spaces a text is encoded independently, so the
distinct units of some MB of text are encoded once each and their ids gathered.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import common

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 256
#: Text whose distinct units are encoded together.
UNIT_CHARS = 8 << 20

#: Units whose bytes are compared at once.
_COMPARED = 1 << 16

#: White space by any of the definitions in use; a space before one of these isn't a stable boundary.
_BLANK = "\\s\u180e\u200b\ufeff"
_STABLE = re.compile(f" (?=[^{_BLANK}])")
#: Letters, digits, signs but for the apostrophe (which may begin a contraction) and white space but for the plain space (which belongs to what follows), all of classes that no Unicode version changed.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u0233\u0391-\u03a1\u03b1-\u03c9\u0410-\u044f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_DIGIT, _SIGN, _LINE = "0-9", r"!-&(-/:-@\[-`{-~\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f", r"\n\t\r"
#: Under the usual pattern no pre-token goes on where one of these classes follows another, so what follows such a place is encoded alike too.
_CHANGE = re.compile(f"(?<=[{_LETTER}])(?=[{_DIGIT}{_SIGN}'{_LINE}])|(?<=[{_DIGIT}])(?=[{_LETTER}{_SIGN}'{_LINE}])|(?<=[{_SIGN}])(?=[{_LETTER}{_DIGIT}{_LINE}])|(?<=[{_LINE}])(?=[{_LETTER}{_DIGIT}{_SIGN}'])")
#: Characters from here on may be classed by another Unicode version in another library; only the file's own library sees them.
_NEWER = "\u0590"
#: Texts on which both libraries must agree before the faster one is used: digits, contractions, white space, signs, pairs of all these.
_TRIALS = (
    "0 12 345 6789 1,234.50 3rd x86 ٣ ½ ² 1\u00a02", "I'm you're he's we'd they'll I've can't 'S 'Re '' 'x d'un rock'n'roll",
    "a  b   c\t\td \t e\n\nf \r\n g\u00a0h \u00a0i\x0b\x0cj\x1c k\u0085l ", "end  ", "  start", "\n", "…—“q” ¿qué? <b>&amp;</b> a_b-c #1 @x $5 €6 \u0301e",
    " \n\t'a1.,é\u00a0",
)
#: The usual pre-token pattern of byte-level BPE.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for bytes of text below _NEWER: white space, and what may begin U+0085 or U+00A0.
_BLANK_BYTE = np.isin(np.arange(256), [*range(9, 14), *range(28, 33), 0xC2])
_MIX = np.random.default_rng(7).integers(1, 1 << 63, 4096, dtype=np.uint64) | np.uint64(1)


def _same_bytes(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, others: np.ndarray) -> bool:
    """Whether each unit, of which one follows the other, has the bytes from the other place."""
    for i in range(0, len(starts), _COMPARED):
        own, n = starts[i : i + _COMPARED], lens[i : i + _COMPARED]
        begin, end = int(own[0]), int(own[-1] + n[-1])
        if not np.array_equal(buf[begin:end], buf[np.arange(begin, end) + np.repeat(others[i : i + _COMPARED] - own, n)]):
            return False
    return True


class Encoder:
    """A tokenizer file of ``tokenizers`` (.json) or ``sentencepiece`` (.model), without special tokens added."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.fast = None
        if path.endswith(".model"):
            import sentencepiece

            self.piece = sentencepiece.SentencePieceProcessor(model_file=path)
            self.tok, self.by_unit, self.longest = None, False, 0
            return
        from tokenizers import Tokenizer

        self.piece, self.tok = None, Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_unit = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec.get("normalizer") is None
            and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", []))
        )
        self.longest = max((len(t["content"]) for t in spec.get("added_tokens", [])), default=0)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec.get("added_tokens", [])) or "(?!)")
        self.fast = self._fast_units(spec) if self.by_unit and spec["model"].get("type", "BPE") == "BPE" else None

    def encode(self, text: str) -> np.ndarray:
        """Ids of the whole text in one call of the library."""
        if self.piece is not None:
            return np.asarray(self.piece.encode(text, num_threads=1), "<u4")
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u4")

    def encode_offsets(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and where each token starts, in code points."""
        if self.piece is not None:
            pieces = self.piece.encode(text, return_type="proto").pieces
            return np.asarray([p.id for p in pieces], "<u4"), np.asarray([p.begin for p in pieces], np.int64)
        e = self.tok.encode(text, add_special_tokens=False)
        return np.asarray(e.ids, "<u4"), np.asarray([o[0] for o in e.offsets], np.int64)

    def _fast_units(self, spec: dict):
        """The same merges as ranks, many times faster on unseen words; None where the file isn't of that kind or a trial differs."""
        import tiktoken

        keep = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
        shown = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in keep)}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in spec["model"]["merges"]]
        if sorted(vocab.values()) != list(range(len(vocab))) or [vocab.get(m) for m in merged] != list(range(256, len(vocab))):
            return None
        ranks = {bytes(shown[c] for c in t): i for t, i in vocab.items()}
        self.width = np.zeros(len(ranks), np.int64)
        for t, i in ranks.items():
            self.width[i] = len(t)
        fast = tiktoken.Encoding("units", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        trial = " ".join([*vocab][:: max(1, len(vocab) // 2000)])
        trials = [trial, *_TRIALS, "".join(c + d for c in _TRIALS[-1] for d in _TRIALS[-1])]
        return fast if all(fast.encode_ordinary(t) == self.tok.encode(t, add_special_tokens=False).ids for t in trials) else None

    def encode_many(self, batch: list[str]) -> list[np.ndarray]:
        """Ids of each text. Where units apply, each distinct unit of some MB of text is encoded once."""
        out: list = [None] * len(batch)
        part: list[int] = []
        size = 0
        for i, t in enumerate(batch):
            if not self.fast or not t or max(t) >= _NEWER or self.special.search(t):
                out[i] = self.encode(t)
                continue
            part.append(i)
            size += len(t)
            if size >= UNIT_CHARS:
                self._by_units(batch, part, out)
                part, size = [], 0
        if part:
            self._by_units(batch, part, out)
        return out

    def _by_units(self, batch: list[str], part: list[int], out: list) -> None:
        raw = [batch[i].encode() for i in part]
        buf = np.frombuffer(b"".join(raw), np.uint8)
        heads = np.cumsum([0, *map(len, raw)])
        after = np.append(buf[1:], 32)
        cut = (buf == 32) & ~_BLANK_BYTE[after]
        cut[heads[:-1]] = True
        starts = np.flatnonzero(cut)
        lens = np.diff(np.append(starts, len(buf)))
        place = (np.arange(len(buf), dtype=np.int32) - np.repeat(starts.astype(np.int32), lens)) % len(_MIX)
        _, first, which = np.unique(np.add.reduceat((buf + np.uint64(1)) * _MIX[place], starts), return_index=True, return_inverse=True)
        spaced = buf[starts[first]] == 32
        # Units of one hash are the same only if all their bytes are.
        if not np.array_equal(lens, lens[first][which]) or not _same_bytes(buf, starts, lens, starts[first][which]):
            for i in part:
                out[i] = self.encode(batch[i])
            return
        # Units that begin with a space can stand one after the other; text heads that don't go last, one by one.
        order = np.argsort(~spaced, kind="stable")
        first, which = first[order], np.argsort(order, kind="stable")[which]
        at, n = starts[first], lens[first]
        k = int(spaced.sum())
        upto = np.cumsum(n[:k])
        index = np.arange(int(n[:k].sum())) + np.repeat(at[:k] - upto + n[:k], n[:k])
        ids = np.asarray(self.fast.encode_ordinary(buf[index].tobytes().decode()), np.uint32)
        ends = np.searchsorted(np.cumsum(self.width[ids]), upto) + 1
        rest = [np.asarray(self.fast.encode_ordinary(buf[p : p + m].tobytes().decode()), np.uint32) for p, m in zip(at[k:].tolist(), n[k:].tolist(), strict=True)]
        sizes = np.concatenate([np.diff(ends, prepend=0), np.asarray([len(r) for r in rest], np.int64)])
        ids = np.concatenate([ids, *rest])
        begin = np.cumsum(sizes) - sizes
        sizes, begin = sizes[which], begin[which]
        upto = np.cumsum(sizes)
        flat = ids[np.arange(int(upto[-1])) + np.repeat(begin - upto + sizes, sizes)]
        ends = upto[np.searchsorted(starts, heads[1:]) - 1]
        for i, a, b in zip(part, np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
            out[i] = flat[a:b]

    def encode_spliced(self, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> np.ndarray:
        """Ids of a huge text from overlapping chunks; no call sees more than a chunk and its widened overlap."""
        done: list[np.ndarray] = []
        start, n = 0, len(text)
        while True:
            end, wide = start + chunk, overlap
            if end + wide >= n:
                done.append(self.encode_offsets(text[start:])[0])
                return np.concatenate(done)
            ids, at = self.encode_offsets(text[start : end + wide])
            while True:
                # The next chunk is encoded from its own start; both must have a boundary at a stable place.
                ids2, at2 = self.encode_offsets(text[end : end + wide])
                common_at = np.intersect1d(at + start, at2 + end)
                # The last token of either, and a special string, may be cut short by the end of what it was given.
                stable = [p for p in common_at.tolist() if end < p < end + wide - 1 - self.longest and self._stable(text, p)]
                if stable:
                    break
                wide *= 2
                if end + wide >= n:
                    done.append(self.encode_offsets(text[start:])[0])
                    return np.concatenate(done)
                ids, at = self.encode_offsets(text[start : end + wide])
            done.append(ids[at + start < stable[0]])
            start = stable[0]

    def _stable(self, text: str, p: int) -> bool:
        """Whether what follows the place is encoded alike whatever stands before it."""
        if _STABLE.match(text, p):
            return True
        return _CHANGE.match(text, p) is not None if self.by_unit else _STABLE.match(text, p - 1) is not None

    def ids(self, batch: list[str], chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[np.ndarray]:
        """Ids of every text: huge ones spliced, others at once."""
        short = iter(self.encode_many([t for t in batch if len(t) <= chunk or self.piece]))
        return [next(short) if len(t) <= chunk or self.piece else self.encode_spliced(t, chunk, overlap) for t in batch]


@functools.lru_cache(4)
def encoder(path: str) -> Encoder:
    """One per worker and file."""
    return Encoder(path)


def count_tokens(docs: DataFrame, path: str, *, limit: int = 1024, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row.

    Null and empty texts have 0 bytes and 0 tokens; null ids are kept, repeated rows counted one by
    one; further columns are left aside; an empty table gives no rows. Rows aren't shuffled. A text of more than ``chunk`` code
    points is encoded in overlapping chunks and never in one call, unless it has no stable place at all or the file is of ``sentencepiece``.
    """
    common.small_batches(docs.sparkSession)

    def count(batch: pa.RecordBatch):
        n = [len(x) for x in encoder(path).ids(common.texts(batch), chunk, overlap)]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = common.id_text(docs, id_col, text_col).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return common.map_batches(rows, count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
