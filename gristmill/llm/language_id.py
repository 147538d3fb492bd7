"""Language identification by hierarchical discrimination: family first, then the language."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.session import stage

UNDETERMINED = "und"
DIMENSIONS = 1 << 13
SAMPLE_PER_LANGUAGE = 300
SAMPLE_PARTS = 16
HELD_OUT_FOLD = 2
FOLDS = 4
MIN_SCORE = 0.3
ROUNDS = 200
CHUNK = 1 << 20

# Language codes by family. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "tk", "ky", "tt"),
    "indic": ("hi", "mr", "ne", "bn", "gu", "pa", "ur"),
    "semitic": ("ar", "he", "am", "mt"),
}
LETTER = re.compile(r"[^\W\d_]")

# ASCII letters in lower case, every other ASCII character a space, other bytes as they are.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
for _c in range(26):
    _FOLD[65 + _c] = _FOLD[97 + _c] = 97 + _c


def family_of(lang: str) -> str:
    for family, members in FAMILIES.items():
        if lang in members:
            return family
    return lang


def has_letter(text: str | None) -> bool:
    return text is not None and LETTER.search(text) is not None


def gram_counts(text: str) -> np.ndarray:
    """Hashed counts of the byte bigrams and trigrams of a whole text, in bounded memory."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8)
    counts = np.zeros(DIMENSIONS, dtype=np.float64)
    for start in range(0, max(len(data), 1), CHUNK):
        folded = _FOLD[data[max(start - 2, 0) : start + CHUNK]]
        blank = folded == 32
        folded = folded[~(blank & np.concatenate(([False], blank[:-1])))] if len(folded) else folded
        codes = np.concatenate(([32], folded, [32])).astype(np.uint32)
        two = codes[:-1] * np.uint32(256) + codes[1:]
        three = two[:-1] * np.uint32(256) + codes[2:]
        for grams, salt in ((two, 0x9E3779B1), (three, 0x85EBCA77)):
            slots = (grams * np.uint32(salt)) >> np.uint32(32 - DIMENSIONS.bit_length() + 1)
            counts += np.bincount(slots, minlength=DIMENSIONS)
    return counts


def features(text: str) -> np.ndarray:
    """Unit vector of damped counts."""
    damped = np.sqrt(gram_counts(text)).astype(np.float32)
    return damped / max(float(np.linalg.norm(damped)), 1e-9)


@dataclass(frozen=True)
class Separator:
    """A linear support vector machine between two classes, with a sigmoid for its margin."""

    first: str
    second: str
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def first_wins(self, vector: np.ndarray) -> float:
        margin = float(vector @ self.weights) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def fit_margin(products: np.ndarray, y: np.ndarray, strength: float = 1e-3) -> np.ndarray:
    """Coefficients of the rows in a squared-hinge SVM, by accelerated gradient steps.

    ``products`` are the rows' scalar products, so a step costs rows squared, whatever the
    number of features. Both classes weigh the same.
    """
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    step = 1.0 / (2.0 * float((share * np.diag(products)).sum()) + strength)
    w = np.zeros(len(y))
    ahead, momentum = w, 1.0
    for _ in range(ROUNDS):
        short = np.maximum(0.0, 1.0 - y * (products @ ahead))
        new = ahead - step * (strength * ahead - 2.0 * share * short * y)
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + (momentum - 1) / after * (new - w)
        w, momentum = new, after
    return w


def fit_sigmoid(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve with smoothed targets, by Newton steps."""
    good, poor = int((y > 0).sum()), int((y < 0).sum())
    wanted = np.where(y > 0, (good + 1) / (good + 2), 1 / (poor + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - wanted) * margins).sum() + 1e-3 * a, (p - wanted).sum() + 1e-3 * b])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * margins**2).sum(), (v * margins).sum()], [(v * margins).sum(), v.sum()]])
        change = np.linalg.solve(h + 1e-3 * np.eye(2), g)
        a, b = a - change[0], b - change[1]
        if np.abs(change).max() < 1e-6:
            break
    return max(float(a), 1e-3), float(b)


def fit_separator(first: str, second: str, x: np.ndarray, y: np.ndarray) -> Separator:
    """The margin of all rows; its sigmoid from margins of folds left out of the fit."""
    products = (x @ x.T).astype(np.float64) + 1.0
    row_weights = fit_margin(products, y)
    margins = products @ row_weights
    fold = np.arange(len(y)) % 3
    for k in range(3):
        inside = np.flatnonzero(fold != k)
        if len(set(y[inside])) == 2:
            fitted = fit_margin(products[np.ix_(inside, inside)], y[inside])
            margins[fold == k] = products[np.ix_(fold == k, inside)] @ fitted
    slope, offset = fit_sigmoid(margins, y)
    weights = x.T @ row_weights.astype(np.float32)
    return Separator(first, second, weights, float(row_weights.sum()), slope, offset)


def _vote(classes: list[str], separators: dict, vector: np.ndarray) -> tuple[str, float]:
    """One-versus-one: most duels won, then the highest mean probability."""
    if len(classes) == 1:
        return classes[0], 1.0
    wins, sums = dict.fromkeys(classes, 0), dict.fromkeys(classes, 0.0)
    for a, b in combinations(classes, 2):
        p = separators[a, b].first_wins(vector)
        wins[a if p >= 0.5 else b] += 1
        sums[a] += p
        sums[b] += 1 - p
    best = max(classes, key=lambda c: (wins[c], sums[c]))
    return best, sums[best] / (len(classes) - 1)


@dataclass(frozen=True)
class LanguageModel:
    """Families, the languages of each, and the separators of both levels."""

    families: dict[str, list[str]]
    between_families: dict[tuple[str, str], Separator] = field(default_factory=dict)
    between_languages: dict[tuple[str, str], Separator] = field(default_factory=dict)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of a whole text and the product of both levels' probabilities."""
        if not self.families or not has_letter(text):
            return UNDETERMINED, 0.0
        vector = features(text)
        family, sure = _vote(sorted(self.families), self.between_families, vector)
        lang, surer = _vote(self.families[family], self.between_languages, vector)
        return lang, sure * surer

    def column(self, text: Column) -> Column:
        """A struct of ``lang`` and ``score``, computed per Arrow batch in the tasks."""

        @F.pandas_udf("lang string, score double")
        def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                yield pd.DataFrame(map(self.predict, texts), columns=["lang", "score"])

        return predicted(text)


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: CRC-32 of the id as text, modulo 4, is 2."""
    fold = F.crc32(doc_id.cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == HELD_OUT_FOLD, F.lit(False))


def training_sample(docs: DataFrame, most: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """``(lang, text)``: up to ``most`` different texts of each label, chosen by hash.

    Held-out rows, rows without id, label or text are left out. The choice looks at hashes of
    whole texts: each label is dealt into parts by hash, and the least hashes of each part are
    taken, so that a label with most rows is not one task's work.
    """
    usable = docs.filter(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    ).filter(F.col("text").rlike(r"\p{L}"))
    hashed = usable.select("lang", "doc_id", F.xxhash64("text").alias("digest"))
    first = hashed.groupBy("lang", "digest").agg(F.min("doc_id").alias("doc_id"))
    part = F.pmod(F.col("digest"), F.lit(SAMPLE_PARTS))
    order = Window.partitionBy("lang", part).orderBy("digest")
    share = max(1, most // SAMPLE_PARTS)
    chosen = first.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= share)
    chosen = stage(chosen.select("lang", "doc_id", "digest"), "sample").alias("chosen")
    rows = docs.alias("doc")
    same = (F.col("doc.doc_id") == F.col("chosen.doc_id")) & (
        F.xxhash64(F.col("doc.text")) == F.col("chosen.digest")
    ) & (F.col("doc.lang") == F.col("chosen.lang"))
    # At most ``most`` rows per language are broadcast.
    taken = rows.join(F.broadcast(chosen), same).select("doc.lang", "doc.text", "chosen.digest")
    return taken.dropDuplicates(["lang", "digest"])


def _fit_pairs(vectors: DataFrame, classes: str, pairs: list[tuple[str, str]]) -> dict:
    """One task per pair trains on the sampled vectors of its two classes."""
    if not pairs:
        return {}
    spark = vectors.sparkSession
    duels = spark.createDataFrame([(a, b, c) for a, b in pairs for c in (a, b)], "a string, b string, c string")
    both = vectors.join(F.broadcast(duels), vectors[classes] == duels["c"]).select("a", "b", "c", "digest", "v")

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["digest", "c"])
        x = np.stack([np.frombuffer(v, dtype=np.float32) for v in rows["v"]])
        y = np.where(rows["c"] == key[0], 1.0, -1.0)
        s = fit_separator(key[0], key[1], x, y)
        return pd.DataFrame([(*key, s.weights.tobytes(), s.bias, s.slope, s.offset)], columns=list("abwiso"))

    fitted = both.groupBy("a", "b").applyInPandas(fit, "a string, b string, w binary, i double, s double, o double")
    return {
        (r["a"], r["b"]): Separator(
            r["a"], r["b"], np.frombuffer(bytes(r["w"]), dtype=np.float32), r["i"], r["s"], r["o"]
        )
        for r in fitted.collect()
    }


def train(docs: DataFrame, most: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Fit both levels on a sample of at most ``most`` texts per learned ``lang`` value.

    The bound is the only one: texts are read whole, and each pair of classes is trained in a
    task of its own. What reaches the driver are the weights, 32 KB for each pair. Without any
    usable row the model has no language and predicts ``und``.
    """

    def vectors_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame(
                {
                    "lang": rows["lang"],
                    "family": [family_of(x) for x in rows["lang"]],
                    "digest": rows["digest"],
                    "v": [features(t).tobytes() for t in rows["text"]],
                }
            )

    vectors = stage(
        training_sample(docs, most).mapInPandas(
            vectors_of, "lang string, family string, digest long, v binary"
        ),
        "vectors",
    )
    families: dict[str, list[str]] = {}
    for lang in sorted(r["lang"] for r in vectors.select("lang").distinct().collect()):
        families.setdefault(family_of(lang), []).append(lang)
    inside = [p for langs in families.values() for p in combinations(langs, 2)]
    return LanguageModel(
        families,
        _fit_pairs(vectors, "family", list(combinations(sorted(families), 2))),
        _fit_pairs(vectors, "lang", inside),
    )


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row, from its whole text alone.

    ``und`` with score 0 for a text that is null or has no letter. Repeated rows stay.
    """
    judged = docs.select("doc_id", model.column(F.col("text")).alias("judged"))
    return judged.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("judged.lang").alias("lang_pred"),
        F.col("judged.score").alias("score"),
    )


def keep_identified(
    docs: DataFrame, model: LanguageModel, languages: tuple[str, ...] | None = None, min_score: float = MIN_SCORE
) -> DataFrame:
    """``docs`` without rows that have no language, an unwanted one, or a doubtful one.

    Below ``min_score`` neither level is sure of its choice (the least possible score is 0.25).
    ``languages`` defaults to every learned one. All columns are kept as they are.
    """
    judged = model.column(F.col("text"))
    row = F.struct(*[F.col(f"`{name}`") for name in docs.columns])
    held = docs.select(row.alias("doc"), judged.alias("judged"))
    good = (F.col("judged.lang") != UNDETERMINED) & (F.col("judged.score") >= min_score)
    if languages is not None:
        good &= F.col("judged.lang").isin(*languages)
    return held.filter(good).select("doc.*")
