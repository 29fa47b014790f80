"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

Two words are alike as far as they share gapped runs of three characters, each gap costing a factor, so
insults with inserted characters or foreign endings stay near to the plain ones. Landmarks are words of
the labelled sample: those that tell most, and frequent ones that don't. A sentence is described by its
best likeness to each landmark, made sharper by a power and turned by the inverse root of the landmarks'
own likenesses (Nyström); a linear machine is trained on sentences. A document scores as its worst sentence.
"""

from __future__ import annotations

import itertools
import pickle
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import common

#: Bounds of the labelled sample: rows of each label, and code points of one text (longer ones aren't in the sample).
SAMPLE_ROWS, SAMPLE_CHARS = 2000, 20_000
TELLING, PLAIN = 64, 16
GAP, SPAN = 0.6, 5
THRESHOLD = 0.7
#: Share of clean texts that a setting may reject to be chosen.
CLEAN_LOST = 0.01
#: Code points of text that are scored at once.
SCORED_CHARS = 1 << 21
#: Longer runs of letters are no words; their parts of these lengths are.
LONGEST, RUNS = 32, range(4, 10)
_PAIRS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
_SENTENCE = re.compile(r"[.!?]+\s+|\n+")
_SPELLED = re.compile(r"(?:(?<=\s)|^)((?:\w[\s._*-]){3,}\w)(?=\W|$)")
_LEET = str.maketrans("013457@$", "oieastas")
_SIGNS = re.compile(r"[\W_]+")
_EDGE = "\"'()[]{}<>.,;:!?|…«»“”"


def variants(part: str) -> set[str]:
    """The words that a lower-case run without white space may stand for.

    Itself without signs at its ends; where it has signs or digits, its pieces between them, itself with signs left out, and all with
    digits read as letters. Of one longer than any word, as in scripts without spaces, all runs of a word's length.
    """
    part = part.strip(_EDGE)
    if part.isalpha() and len(part) <= LONGEST:
        return {part}
    out = set()
    for p in {part, part.translate(_LEET)}:
        out.update(_SIGNS.split(p))
        out.add(_SIGNS.sub("", p))
    return _of_word_length(out)


def _of_word_length(words: set[str]) -> set[str]:
    out = {w for w in words if 0 < len(w) <= LONGEST}
    return out.union(*({w[i : i + n] for n in RUNS for i in range(len(w) - n + 1)} for w in words if len(w) > LONGEST))


def spelled(text: str) -> set[str]:
    """Words of which the letters stand one by one; a word of one letter may stand before."""
    found = {re.sub(r"[\s._*-]", "", m) for m in _SPELLED.findall(text)}
    return _of_word_length(found | {w[1:] for w in found})


def _alone(parts: list[str]) -> bool:
    """Whether enough letters stand alone for a word that is spelled out."""
    return sum(map((1).__eq__, map(len, parts))) > 3


def words_of(text: str) -> set[str]:
    """Distinct lower-case words of a text, and what they may stand for."""
    text = text.lower()
    parts = text.split()
    out = set().union(*map(variants, set(parts)))
    return out | spelled(text) if _alone(parts) else out


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word number, code and weight of every gapped run of three characters, ends marked by a blank."""
    text = "".join(f" {w} " for w in words)
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    owner, code, weight = [], [], []
    for a, b in _PAIRS:
        n = len(c) - b
        if n <= 0:
            continue
        same = of[:n] == of[b:]
        owner.append(of[:n][same])
        code.append(((c[:n] << np.uint64(42)) | (c[a : n + a] << np.uint64(21)) | c[b:])[same])
        weight.append(np.full(int(same.sum()), GAP ** (b - 2)))
    return np.concatenate([*owner, np.zeros(0, np.int64)]), np.concatenate([*code, np.zeros(0, np.uint64)]), np.concatenate([*weight, np.zeros(0)])


@dataclass(frozen=True)
class Setting:
    """What isn't learnt from examples but set; ``choose`` compares settings inside the sample.

    Likenesses count by two powers: a coarse one that lets bent words come near, and a fine one that knows a word from those around it.
    Words below ``least`` to every telling landmark can't change a score. ``bent_share`` is what an insult with an inserted character
    counts for, beside a document, when scores are calibrated; ``cost`` is that of an example inside the margin.
    """

    coarse: int = 3
    fine: int = 32
    least: float = 0.55
    bent_share: float = 0.2
    cost: float = 4.0


@dataclass
class Kernel:
    """Likeness of words to landmarks, the first of which tell of toxicity."""

    landmarks: list[str]
    telling: int

    def __post_init__(self):
        of, code, weight = _grams(self.landmarks)
        self.codes, which = np.unique(code, return_inverse=True)
        self.rows = np.zeros((len(self.codes), len(self.landmarks)), np.float32)
        np.add.at(self.rows, (which, of), weight)
        self.rows /= np.sqrt((self.rows**2).sum(0))
        self.seen = np.zeros(1 << 18, bool)
        self.seen[self._slot(code[of < self.telling])] = True

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)

    def _possible(self, words: list[str], least: float) -> np.ndarray:
        """Words that share enough runs with telling landmarks for a likeness of least."""
        found = []
        for at in range(0, len(words), 8192):
            part = words[at : at + 8192]
            c = np.frombuffer(f" {'  '.join(part)} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
            lens = np.fromiter(map(len, part), np.int64, len(part)) + 2
            of = np.repeat(np.arange(len(part)), lens)
            shared, square = np.zeros(len(part)), np.zeros(len(part))
            for a, b in _PAIRS:
                n = max(0, len(c) - b)
                hit = self.seen[self._slot((c[:n] << np.uint64(42)) | (c[a : n + a] << np.uint64(21)) | c[b:])] & (of[:n] == of[b:])
                shared += GAP ** (2 * b - 4) * np.bincount(of[:n][hit], minlength=len(part))
                square += GAP ** (2 * b - 4) * np.maximum(lens - b, 0)
            found.append(at + np.flatnonzero(shared >= least**2 * square))
        return np.concatenate([*found, np.zeros(0, np.int64)])

    def __call__(self, words: list[str], least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words with a likeness of least or more to a telling landmark, and their likenesses to all."""
        keep = self._possible(words, least) if least else np.arange(len(words))
        out = np.zeros((len(keep), len(self.landmarks)), np.float32)
        for i in range(0, len(keep), 4096):
            of, code, weight = _grams([words[k] for k in keep[i : i + 4096]])
            order = np.lexsort((code, of))
            of, code, weight = of[order], code[order], weight[order]
            first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (of[1:] != of[:-1]))[: len(of)])
            if not len(first):
                continue
            of, code, weight = of[first], code[first], np.add.reduceat(weight, first)
            norm = np.sqrt(np.bincount(of, weight**2))
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            known = self.codes[at] == code
            of, at, weight = of[known], at[known], (weight / norm[of])[known].astype(np.float32)
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)])
            if len(first):
                out[i + of[first]] = np.add.reduceat(self.rows[at] * weight[:, None], first)
        good = out[:, : self.telling].max(1, initial=0) >= least
        return keep[good], out[good]


@dataclass
class Model:
    kernel: Kernel
    root: np.ndarray
    weights: np.ndarray
    bias: float
    scale: tuple[float, float]
    setting: Setting = Setting()

    def decide(self, features: np.ndarray) -> np.ndarray:
        """Decision values of sentences described by their best likenesses."""
        return _described(features, self.root, self.setting) @ self.weights + self.bias

    def probability(self, f: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * f + b, -30, 30)))

    def score(self, texts: list[str]) -> np.ndarray:
        """A score for each whole text: that of its worst sentence. Some MB of text are worked on at once."""
        if not texts:
            return np.zeros(0)
        upto = np.cumsum([len(t) for t in texts])
        cuts = [0, *(np.flatnonzero(np.diff(upto // SCORED_CHARS)) + 1).tolist(), len(texts)]
        return np.concatenate([self._scored(texts[a:b]) for a, b in itertools.pairwise(cuts)])

    def _scored(self, texts: list[str]) -> np.ndarray:
        texts = [t.lower() for t in texts]
        parts = [t.split() for t in texts]
        bags = [set(p) for p in parts]
        # Each distinct run of the batch is read once.
        stands = {p: variants(p) for p in set().union(*bags)}
        apart = [spelled(t) if _alone(p) else set() for t, p in zip(texts, parts, strict=True)]
        words = list(set().union(*stands.values(), *apart))
        keep, like = self.kernel(words, self.setting.least) if words else (np.zeros(0, np.int64), np.zeros((0, len(self.kernel.landmarks)), np.float32))
        row = {words[i]: k for k, i in enumerate(keep.tolist())}
        near = {p: rows for p, own in stands.items() if (rows := [row[w] for w in own if w in row])}
        nothing = float(self.decide(np.zeros((1, len(self.kernel.landmarks))))[0])
        out = np.full(len(texts), nothing)
        owner, features = [], []

        def take() -> None:
            if owner:
                np.maximum.at(out, owner, self.decide(np.asarray(features)))
            owner.clear()
            features.clear()

        for i, (text, bag) in enumerate(zip(texts, bags, strict=True)):
            hits = bag & near.keys()
            sentences = {frozenset(hits)} if len(hits) == 1 else {frozenset(near.keys() & set(s.split())) for s in _SENTENCE.split(text)} if hits else set()
            # Signs at the ends of a sentence may have gone with its split; runs that are in no sentence as they stand count by themselves.
            seen = frozenset().union(*sentences)
            groups = [[k for p in own for k in near[p]] for own in sentences if own] + [near[p] for p in hits - seen] + [[row[w]] for w in apart[i] if w in row]
            for own in groups:
                owner.append(i)
                features.append(like[own].max(0))
            if len(owner) >= 4096:
                take()
        take()
        return self.probability(out)


def _described(likeness: np.ndarray, root: np.ndarray, setting: Setting) -> np.ndarray:
    """What the machine sees of sentences: Nyström features of the coarse power, and the fine one."""
    x = likeness.astype(np.float64)
    return np.hstack([(x**setting.coarse) @ root, x**setting.fine])


def _svm(x: np.ndarray, y: np.ndarray, group: np.ndarray, c: float, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss and groups of equal weight, by Newton steps: least squares over the examples inside the margin."""
    s = np.where(y, 1.0, -1.0)
    weight = (np.asarray([0.5, 0.25, 0.25]) / np.maximum(1, np.bincount(group, minlength=3)))[group]
    x1 = np.hstack([x, np.ones((len(x), 1))])
    small = 1 / c / len(x)

    def loss(w: np.ndarray) -> float:
        return small / 2 * float(w @ w) + float(weight @ np.maximum(0, 1 - s * (x1 @ w)) ** 2)

    w, at = np.zeros(x1.shape[1]), np.inf
    for _ in range(rounds):
        inside = s * (x1 @ w) < 1
        own = x1[inside] * (2 * weight[inside, None])
        best = np.linalg.solve(own.T @ x1[inside] + small * np.eye(len(w)), own.T @ s[inside])
        step = 1.0
        while (now := loss(w + step * (best - w))) > at and step > 1e-4:
            step /= 2
        if not now < at - 1e-12:
            break
        w, at = w + step * (best - w), now
    return w[:-1], float(w[-1])


def _with_stems(word: str) -> tuple[str, ...]:
    """A word and what it begins with: insults that come with many endings are telling by their stems."""
    return (word, *(word[:k] for k in (4, 5) if len(word) > k + 1))


def _first_of_copies(bags: list[set[str]]) -> list[int]:
    """Numbers of the examples that aren't near copies of an earlier one, by eight minimum hashes of their words."""
    seen: dict[tuple[int, int], int] = {}
    out = []
    for n, bag in enumerate(bags):
        h = np.asarray([xxhash.xxh3_64_intdigest(w) for w in bag] or [0], np.uint64)
        keys = [(i, int(((h ^ (h >> np.uint64(31))) * np.uint64(k | 1)).min())) for i, k in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))]
        if max(Counter(seen[k] for k in keys if k in seen).values(), default=0) < 4:
            out.append(n)
            for k in keys:
                seen.setdefault(k, n)
    return out


def fit(texts: list[str], labels: list[int], setting: Setting = Setting()) -> Model:
    """Train on labelled texts; deterministic. Near copies of one text are one example. Of words that tell as much, the first by the alphabet is a landmark."""
    bags = [words_of(t) for t in texts]
    kept = _first_of_copies(bags)
    texts, bags, y = [texts[i] for i in kept], [bags[i] for i in kept], np.asarray([labels[i] for i in kept], bool)
    toxic, clean, entire = Counter(), Counter(), Counter()
    for bag, label in zip(bags, y, strict=True):
        (toxic if label else clean).update(set().union(*map(_with_stems, bag)))
        entire.update(bag if label else ())
    n1, n0 = max(1, int(y.sum())), max(1, int((~y).sum()))
    # Words of a passage that is copied around always come after the same word; they count as often as they come after different ones.
    before: dict[str, set[str]] = {w: set() for w, k in toxic.items() if k >= 4}
    for t, label in zip(texts, y, strict=True):
        parts = [w.strip(_EDGE) for w in t.lower().split()] if label else []
        for a, b in zip(["", *parts], parts, strict=False):
            for x in _with_stems(b):
                if x in before:
                    before[x].add(a)
    toxic = Counter({w: min(toxic[w], len(x)) if x else toxic[w] for w, x in before.items()})
    # A word tells by how much surer it makes the label: the lower end of its odds, so that rare ones count for less.
    telling = {w: np.log((k + 0.5) / (n1 + 1)) - np.log((clean[w] + 0.5) / (n0 + 1)) - 1.64 / np.sqrt(k) for w, k in toxic.items() if k >= max(4, n1 / 100) and len(w) >= 3}
    ranked = sorted((w for w in telling if telling[w] > 1.5), key=lambda w: (-telling[w], w))
    chosen, covered = [], Counter()
    for w in ranked:  # few landmarks for each group of near words
        if len(chosen) >= TELLING:
            break
        if covered[w[:4]] < 4:
            covered[w[:4]] += 1
            chosen.append(w)
    plain = [w for w, _ in sorted(clean.items(), key=lambda x: (-x[1], x[0])) if len(w) >= 3 and w not in toxic or w in toxic and telling.get(w, 0) < 0.2 and len(w) >= 3][:PLAIN]
    if not chosen or not plain:
        chosen, plain = chosen or [""], plain or [""]
    kernel = Kernel([*chosen, *plain], len(chosen))
    gram = kernel(kernel.landmarks)[1].astype(np.float64) ** setting.coarse
    values, vectors = np.linalg.eigh(gram + 1e-3 * np.eye(len(gram)))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    words = list(set().union(*bags))
    keep, like = kernel(words, setting.least) if words else (np.zeros(0, np.int64), np.zeros((0, len(kernel.landmarks))))
    near = {words[i]: k for k, i in enumerate(keep.tolist())}
    del words, bags
    # Clean sentences without a near word are all alike; one stands for many.
    rows, ys = [np.zeros(len(kernel.landmarks), np.float32)], [False]
    for t, label in zip(texts, y, strict=True):
        for s in _SENTENCE.split(t):
            bag = words_of(s)
            hits = [near[w] for w in bag & near.keys()]
            # Of a toxic text only the sentences with a telling word are examples of toxic ones.
            if hits and (not label or any(telling.get(x, 0) > 1.5 for w in bag for x in _with_stems(w))):
                rows.append(like[hits].max(0))
                ys.append(bool(label))
    # A telling word by itself, and what it looks like with a sign too many or one that is doubled: examples of their own. Stems alone are none.
    full = [w for w in chosen if w in toxic and len(w) >= 4 and 2 * entire[w] >= toxic[w]]
    bent = [*full, *(w[:k] + c + w[k:] for w in full for k in range(1, len(w)) for c in ("x", w[k - 1]))]
    rows += list(kernel(bent)[1]) if bent else []
    ys += [True] * len(bent)
    x = _described(np.asarray(rows), root, setting)
    group = np.asarray([int(t) for t in ys[: len(ys) - len(bent)]] + [2] * len(bent))
    weights, bias = _svm(x, np.asarray(ys), group, setting.cost) if any(ys) else (np.zeros(x.shape[1]), -1.0)
    model = Model(kernel, root, weights, bias, (1.0, 0.0), setting)
    p = np.concatenate([model.score(texts[i : i + 1000]) for i in range(0, len(texts), 1000)] + [np.zeros(0)])
    f = np.concatenate([np.log(p / (1 - p)), model.decide(np.asarray(rows[len(rows) - len(bent) :])) if bent else np.zeros(0)])
    a, b = 1.0, 0.0
    target = np.where(np.concatenate([y, [True] * len(bent)]).astype(bool), (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    share = np.append(np.ones(len(y)), np.full(len(bent), setting.bent_share))
    for _ in range(200):  # logistic scale of the decision values
        p = 1 / (1 + np.exp(-np.clip(a * f + b, -30, 30)))
        g, h = share * (p - target), share * (p * (1 - p) + 1e-6)
        ga, gb = (g * f).sum() + 1e-3 * a, g.sum()
        haa, hab, hbb = (h * f * f).sum() + 1e-3, (h * f).sum(), h.sum()
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
        if abs(da) + abs(db) < 1e-9:
            break
    model.scale = (float(max(a, 1e-3)), float(b))
    return model


def _bent(text: str, words: set[str], sign: str = "") -> str:
    """A text with a sign put into the middle of each of these words, or the letter there doubled."""

    def bend(m: re.Match) -> str:
        w, k = m[0], len(m[0]) // 2
        return w[:k] + (sign or w[k - 1]) + w[k:] if w.lower() in words else w

    return re.sub(r"\w{2,}", bend, text)


def wrong_in_folds(texts: list[str], labels: list[int], setting: Setting, folds: int = 3, threshold: float = THRESHOLD) -> tuple[float, float, float]:
    """Shares of clean texts rejected, of toxic ones missed, and of those missed with their landmarks bent, by models that have learnt from the other folds.

    Near copies of an earlier text are left out, so that none is in two folds. A landmark is bent by doubling its middle letter, and by
    putting one in there, each in a text of its own.
    """
    kept = _first_of_copies([words_of(t) for t in texts])
    wrong = np.zeros(3, int)
    for fold in range(folds):
        known, asked = [i for n, i in enumerate(kept) if n % folds != fold], [i for n, i in enumerate(kept) if n % folds == fold]
        model = fit([texts[i] for i in known], [labels[i] for i in known], setting)
        insults = {w for w in model.kernel.landmarks[: model.kernel.telling] if len(w) >= 4}
        toxic = np.asarray([labels[i] for i in asked], bool)
        found = model.score([texts[i] for i in asked]) >= threshold
        changed = model.score([_bent(texts[i], insults, sign) for i in asked if labels[i] for sign in ("", "x")]) >= threshold
        wrong += [(found & ~toxic).sum(), (toxic & ~found).sum(), (~changed).sum()]
    n1 = sum(bool(labels[i]) for i in kept)
    return tuple((wrong / np.maximum(1, [len(kept) - n1, n1, 2 * n1])).tolist())


def choose(texts: list[str], labels: list[int], settings: list[Setting], folds: int = 3, rejected: float = CLEAN_LOST) -> Setting:
    """Of the settings that reject no more than this share of clean texts in the folds of the sample, the one that misses least, as it is and bent.

    Where all reject more, that which rejects least; of equal ones the first.
    """

    def rank(setting: Setting) -> tuple[float, float]:
        lost, missed, bent = wrong_in_folds(texts, labels, setting, folds)
        return max(0.0, lost - rejected), missed + 2 * bent

    return min(settings, key=rank)


def held_out(doc_id):
    """Whether a row's label is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most sample_rows rows of each label, drawn by a hash of the id from all labelled rows that aren't held out.

    Null texts, null ids and null labels are no examples; several labels of one id: toxic if one is.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), "toxic").filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out(F.col("doc_id")))
    known = known.withColumn("draw", F.xxhash64("doc_id", F.lit(3)))
    # Twice as many ids as rows, since some texts are too long; at most 4 * sample_rows ids are broadcast, and no text is shuffled but the sample's.
    drawn = [known.filter(F.col("toxic") == label).orderBy("draw", "doc_id").limit(2 * sample_rows) for label in (0, 1)]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.length("text").between(1, sample_chars))
    sample = rows.join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id").select("draw", "text", "toxic").repartition(1)

    def learn(batches):
        found = sorted((r for b in batches for r in zip(*(b[c].to_pylist() for c in ("draw", "text", "toxic")), strict=True)))
        kept = [r for label in (0, 1) for r in [r for r in found if r[2] == label][:sample_rows]]
        model = fit([r[1] for r in kept], [int(r[2]) for r in kept])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)])], names=["model"])

    # The bounded sample is learnt from in one task, away from the driver's memory; the model is some kB.
    learnt = sample.mapInArrow(learn, "model binary").first()
    return pickle.loads(learnt["model"]) if learnt else fit([], [])


def score(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row; the score comes from the whole text alone.

    Null and empty texts score as texts without any telling word; null ids aren't held out; repeated rows
    are scored one by one; further columns are left aside; an empty table gives no rows. A very long text is read whole, in one task.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # some hundred landmarks, whatever the corpus
    rows = common.id_text(docs, id_col, text_col).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")

    def run(batch: pa.RecordBatch):
        s = shared.value.score(common.texts(batch))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return common.map_batches(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def with_score(docs: DataFrame, model: Model, *, out: str = "toxicity", text_col: str = "text") -> DataFrame:
    """docs with the score of each whole text in a further column; nothing is shuffled.

    All rows, repeated ones too, and all columns stay, but for one named ``out``; null and empty texts score as texts without any telling word.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score([t or "" for t in text]))

    return docs.withColumn(out, scored(F.col(text_col)))
