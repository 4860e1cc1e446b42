"""Language identification by hierarchical discrimination.

The first step tells language families apart, the second closely related languages within one: a
linear support vector machine for each pair of classes votes (one-versus-one), among families and then among the
languages of the family that won. Features are hashed character n-grams of lengths 1 to 4 of the lower-cased
letters, as shares of their number, so texts of any length are judged whole and alike.

Models are fitted on the driver on a bounded sample of labelled rows; prediction is one narrow pass.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, release_memory

#: ISO 639 codes of languages by family. Languages that aren't here are a family each.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af",
    "romance": "fr es it pt ro ca gl",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk",
    "uralic": "fi et hu",
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

#: Labelled rows of each language that models are fitted on, at most.
SAMPLE_ROWS = 500
#: And of all languages together: what the driver holds doesn't grow with their number.
TOTAL_ROWS = 6000
#: Characters of a sampled text that one training example has, at most: the text is cut into examples.
EXAMPLE_CHARS = 400
#: Examples of one text, at most.
TEXT_EXAMPLES = 3
DIMENSIONS = 1 << 12
GRAMS = (1, 2, 3, 4)
EPOCHS = 12
PENALTY = 1e-5
UNKNOWN = "und"
#: Texts of fewer n-grams are too short to be told from texts of a language that wasn't learned.
LEAST_GRAMS = 200
#: Examples of a language from which its typical likeness is learned, at least.
LEAST_EXAMPLES = 20
#: A text is foreign below this part of the likeness of the language's median example: junk among the examples doesn't move it.
FOREIGN = 0.6

_NOT_LETTERS = re.compile(r"[^\W\d_]+")


def features(text: str) -> np.ndarray | None:
    """Hashed n-gram indices of a whole text, or None if it has no letter."""
    words = _NOT_LETTERS.findall(text.lower())
    if not words:
        return None
    c = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32)
    out, h = [], np.zeros(len(c), np.uint32)
    with np.errstate(over="ignore"):
        for n in range(1, max(GRAMS) + 1):
            h = (h[: len(c) - n + 1] * np.uint32(0x01000193)) ^ (c[n - 1 :] * np.uint32(0x9E3779B1))
            if n in GRAMS:
                x = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
                out.append((x >> np.uint32(16)) & np.uint32(DIMENSIONS - 1))
    return np.concatenate(out)


def vector(index: np.ndarray) -> np.ndarray:
    """Square roots of shares: a vector of length 1."""
    return np.sqrt(np.bincount(index, minlength=DIMENSIONS) / len(index)).astype(np.float32)


@dataclass
class Pairwise:
    """One linear machine for each pair of classes; the class with most votes wins, then the larger margin."""

    classes: list[str]
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, DIMENSIONS), np.float32))
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    @property
    def pairs(self) -> list[tuple[int, int]]:
        return list(itertools.combinations(range(len(self.classes)), 2))

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """The winner and its confidence from 0 to 1 (of the weakest of its duels)."""
        if len(self.classes) == 1:
            return self.classes[0], 1.0
        margins = self.weights @ x + self.offsets
        votes, total, least = np.zeros(len(self.classes)), np.zeros(len(self.classes)), np.full(len(self.classes), np.inf)
        for (a, b), m in zip(self.pairs, margins.tolist(), strict=True):
            votes[a if m > 0 else b] += 1
            for k, v in ((a, m), (b, -m)):
                total[k] += v
                least[k] = min(least[k], v)
        best = max(range(len(self.classes)), key=lambda k: (votes[k], total[k], -k))
        return self.classes[best], float(1 / (1 + np.exp(-4 * least[best])))


def fit_pair(x: np.ndarray, y: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """Hinge loss with a quadratic penalty, by stochastic subgradients over mini-batches; the classes weigh the same."""
    rng, n = np.random.default_rng(seed), len(y)
    w, b, mean_w, mean_b, t = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0, 0
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * n
    for epoch in range(EPOCHS):
        for at in np.array_split(rng.permutation(n), max(1, n // 32)):
            rate = 8.0 / (1 + 0.05 * epoch)
            wrong = at[y[at] * (x[at] @ w + b) < 1]
            g = (y[wrong] * weight[wrong]).astype(np.float32)
            w *= 1 - rate * PENALTY
            if len(wrong):
                w += (rate / len(at)) * (g @ x[wrong])
                b += 0.1 * float(g.sum()) / len(at)
            if epoch >= EPOCHS // 2:
                t += 1
                mean_w += (w - mean_w) / t
                mean_b += (b - mean_b) / t
    return mean_w, mean_b


def fit_pairwise(classes: list[str], x: np.ndarray, labels: np.ndarray) -> Pairwise:
    model, weights, offsets = Pairwise(classes), [], []
    for k, (a, b) in enumerate(model.pairs):
        at = np.flatnonzero((labels == classes[a]) | (labels == classes[b]))
        w, c = fit_pair(x if len(at) == len(x) else x[at], np.where(labels[at] == classes[a], 1.0, -1.0), k)
        weights.append(w)
        offsets.append(c)
    if weights:
        model.weights, model.offsets = np.stack(weights), np.array(offsets, np.float32)
    return model


@dataclass
class Hierarchy:
    families: Pairwise
    within: dict[str, Pairwise]
    #: Mean direction of each language's examples and the least cosine with it of a text of the language.
    typical: dict[str, tuple[np.ndarray, float]] = field(default_factory=dict)

    def foreign(self, lang: str, index: np.ndarray) -> bool:
        """Whether a text is less like the language than its texts are."""
        if lang not in self.typical or len(index) < LEAST_GRAMS:
            return False
        mean, least = self.typical[lang]
        return float(vector(index) @ mean) < least

    def predict(self, text: str | None, strict: bool = False) -> tuple[str, float]:
        """Language and score; ``und`` and 0 for null, for texts without a letter, and if nothing was learned; with
        ``strict`` also for foreign texts."""
        index = features(text) if text else None
        if index is None or not self.within:
            return UNKNOWN, 0.0
        x = vector(index)
        family, sure = self.families.predict(x)
        lang, more = self.within[family].predict(x)
        if strict and self.foreign(lang, index):
            return UNKNOWN, 0.0
        return lang, round(min(sure, more), 6)


def fit(samples: list[tuple[str, str]]) -> Hierarchy:
    """samples: (language, text). Texts are cut into examples at spaces."""
    x, langs, grams = np.zeros((TEXT_EXAMPLES * len(samples), DIMENSIONS), np.float32), [], []
    for lang, text in sorted(samples):
        for k in range(min(TEXT_EXAMPLES, max(1, len(text) // EXAMPLE_CHARS))):
            index = features(text[k * EXAMPLE_CHARS : (k + 1) * EXAMPLE_CHARS])
            if index is not None:
                x[len(langs)] = vector(index)
                langs.append(lang)
                grams.append(len(index))
    if not langs:
        return Hierarchy(Pairwise([]), {})
    x, y = x[: len(langs)], np.array(langs, dtype=object)
    fam = np.array([FAMILY.get(v, v) for v in langs], dtype=object)
    names = sorted(set(fam))
    within = {f: fit_pairwise(sorted(set(y[fam == f])), x[fam == f], y[fam == f]) for f in names}
    typical, long = {}, np.array(grams) >= LEAST_GRAMS
    for lang in sorted(set(langs)):
        own = x[(y == lang) & long]
        if len(own) >= LEAST_EXAMPLES:
            mean = own.mean(axis=0)
            mean /= np.linalg.norm(mean)
            typical[lang] = mean, FOREIGN * float(np.median(own @ mean))
    return Hierarchy(fit_pairwise(names, x, fam), within, typical)


def learn(docs: DataFrame, where=None, sample_rows: int = SAMPLE_ROWS) -> Hierarchy:
    """Fit on at most ``sample_rows`` distinct texts of each language of ``docs`` (text, lang) that meet ``where``, and TOTAL_ROWS in all.

    Rows with a null lang or text are not learned from. The sample is the distinct texts with the least hashes in each language:
    it doesn't depend on copies, or on how rows are dealt. Of a long text, a stretch of EXAMPLE_CHARS * TEXT_EXAMPLES characters
    is taken, anywhere in it by its hash, and cut into examples. These bounds are parameters of the model's training alone."""
    known = docs if where is None else docs.where(where)
    known = known.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("hash")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n")).collect()}
    if not counts:
        return fit([])
    sample_rows = max(1, min(sample_rows, TOTAL_ROWS // len(counts)))
    # Hashes are even: under this bound lie some more distinct texts than are wanted.
    low = F.lit(None).cast("long")
    for lang, n in counts.items():
        share = min(1.0, (1.3 * sample_rows + 30) / max(1, n))
        low = F.when(F.col("lang") == lang, F.lit(min(2**63 - 1, int(-(2**63) + share * 2**64)))).otherwise(low)
    cut = EXAMPLE_CHARS * TEXT_EXAMPLES
    part = F.substring(F.col("text"), 1 + F.pmod(F.xxhash64("text", F.lit(5)), F.greatest(F.lit(1), F.length("text") - cut)).cast("int"), F.lit(cut))
    some = known.where(F.col("hash") <= low).groupBy("lang", "hash").agg(F.min(part).alias("text"))
    first = Window.partitionBy("lang").orderBy("hash")
    rows = some.withColumn("k", F.row_number().over(first)).where(F.col("k") <= sample_rows).select("lang", "text").collect()
    return fit([(r.lang, r.text) for r in rows])


def identify(docs: DataFrame, model: Hierarchy, keep: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Predict the language of every whole text: columns ``keep`` (default: doc_id), lang_pred, score.

    docs: needs text and the kept columns; one that is named as a new one gives way to it. Null text, empty text
    and text without a letter: ``und`` with score 0. Repeated rows are judged one by one; an empty table gives
    no rows. With nothing learned all are ``und``. ``strict``: so are texts of at least LEAST_GRAMS n-grams that are like
    no learned language."""
    keep = [c for c in keep or ["doc_id"] if c not in ("lang_pred", "score")]
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = keep.index("text") if "text" in keep else len(keep)
    source = docs.select(*keep) if at < len(keep) else docs.select(*keep, F.col("text").cast("string").alias("_text_"))
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [held.value.predict(t.as_py(), strict) for t in b.column(at)]
            new = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *new], names=[*keep, "lang_pred", "score"])
        release_memory()

    return source.mapInArrow(run, schema)


def held_out() -> Column:
    """Rows whose crc32 of the id as text is divisible by 5 are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify_languages(docs: DataFrame) -> DataFrame:
    """Learn from the rows that aren't held out and predict all: doc_id, held_out, lang_pred, score."""
    model = learn(docs, ~held_out())
    return identify(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")
