"""Language identification: family first, then one-versus-one linear SVMs inside the family."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civilake.llm.sampling import labelled_sample, unused

UNKNOWN = "und"
#: Features: hashed byte trigrams of the lower-cased text.
FEATURES = 1 << 12
#: Most distinct texts of one language that the SVMs are fitted on, and of all languages together (16 kB each on the driver).
ROWS_PER_LANGUAGE, ROWS_IN_ALL = 400, 16_000

# ISO 639-1 codes of closely related languages; a code in no family is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "semitic": ("am", "ar", "he", "mt"),
}


def family_of(lang: str) -> str:
    """The family of a language code."""
    return next((name for name, members in FAMILIES.items() if lang in members), lang)


def has_letter(text: Column) -> Column:
    """Whether a text has a letter of any script; false for null."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def features(texts: list[str | None]) -> np.ndarray:
    """One unit row per text: square roots of hashed trigram counts over the whole text."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for row, text in zip(out, texts, strict=True):
        data = np.frombuffer(f" {(text or '').lower()} ".encode("utf-8", "surrogatepass"), np.uint8)
        if len(data) < 3:
            continue
        code = data[:-2].astype(np.uint32) << 16
        code |= data[1:-1].astype(np.uint32) << 8
        code |= data[2:]
        code *= np.uint32(2654435761)
        code >>= np.uint32(20)
        row[:] = np.sqrt(np.bincount(code, minlength=FEATURES))
        row /= np.linalg.norm(row)
    return out


class Svm:
    """A two-class linear SVM (squared hinge, fitted by accelerated gradient steps) with a logistic link for its margin."""

    def __init__(self, x: np.ndarray, y: np.ndarray, reg: float = 1e-3, steps: int = 300):
        x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
        share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
        w = v = np.zeros(x.shape[1], np.float32)
        rate = 1.0 / (2 * float((share * (x * x).sum(1)).sum()) + reg)
        for step in range(steps):
            short = np.maximum(0, 1 - y * (x @ v))
            grad = reg * v - 2 * x.T @ (share * y * short)
            new = v - rate * grad
            v = new + step / (step + 3) * (new - w)
            w = new
        self.w, self.b = w[:-1], float(w[-1])
        self.slope = _logistic_slope(y * (x @ w), share)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w + self.b

    def positive(self, x: np.ndarray) -> np.ndarray:
        """Probability of the first class."""
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x), -30, 30)))


def _logistic_slope(signed: np.ndarray, share: np.ndarray) -> float:
    """The slope, among a few, under which the signed margins are likeliest."""
    slopes = np.geomspace(0.5, 16, 16)
    return float(max(slopes, key=lambda s: -(share * np.logaddexp(0, -s * signed)).sum() - 1e-3 * s))


class OneVersusOne:
    """Votes of an SVM for every pair of classes; one class needs no SVM."""

    def __init__(self, x: np.ndarray, labels: np.ndarray):
        self.classes = sorted(set(labels.tolist()))
        self.svms = {}
        for a, b in combinations(self.classes, 2):
            own = (labels == a) | (labels == b)
            self.svms[a, b] = Svm(x[own], np.where(labels[own] == a, 1.0, -1.0).astype(np.float32))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row the index of the winning class and the mean probability of its duels."""
        n = len(self.classes)
        if n == 1:
            return np.zeros(len(x), np.int64), np.ones(len(x))
        won = np.zeros((len(x), n))
        for (a, b), svm in self.svms.items():
            p = svm.positive(x)
            won[:, self.classes.index(a)] += p / (n - 1)
            won[:, self.classes.index(b)] += (1 - p) / (n - 1)
        best = won.argmax(1)
        return best, won[np.arange(len(x)), best]


class Hierarchy:
    """Family classifier over languages' families, and a language classifier in each family."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        labels = np.array(langs, dtype=object)
        families = np.array([family_of(lang) for lang in langs], dtype=object)
        self.family = OneVersusOne(x, families)
        self.members = {name: OneVersusOne(x[families == name], labels[families == name]) for name in self.family.classes}

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and probability (family's times language's) of each row."""
        which, sure = self.family.predict(x)
        out, score = np.empty(len(x), object), np.zeros(len(x))
        for i, name in enumerate(self.family.classes):
            own = np.flatnonzero(which == i)
            if len(own):
                best, p = self.members[name].predict(x[own])
                out[own] = [self.members[name].classes[k] for k in best]
                score[own] = sure[own] * p
        return out.tolist(), score


def feature_rows(sample: DataFrame) -> tuple[np.ndarray, list[str]]:
    """Features and label of each row of a bounded sample (``label, h, body``), in a fixed order; made on the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [r.tobytes() for r in features(part.column(2).to_pylist())]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(rows, pa.binary())], names=["label", "h", "x"])

    rows = sample.select("label", "h", "body").mapInArrow(run, "label string, h long, x binary").collect()
    rows.sort(key=lambda row: (row["label"], row["h"]))
    x = np.empty((len(rows), FEATURES), np.float32)
    for at, row in enumerate(rows):
        x[at] = np.frombuffer(row["x"], np.float32)
    return x, [row["label"] for row in rows]


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE) -> Hierarchy | None:
    """Fit on at most ``rows_per_language`` distinct texts of each language, the lowest by hash.

    Rows with a null language or no letter teach nothing; equal texts of a
    language count once, so repeated rows change nothing. Only the bounded sample
    reaches the driver. None if there is nothing to learn from, as in an empty table.
    """
    body = F.when(has_letter(F.col(text_col)), F.col(text_col))
    x, langs = feature_rows(labelled_sample(docs, F.col(lang_col), body, rows_per_language, ROWS_IN_ALL))
    return Hierarchy(x, langs) if langs else None


def predict(docs: DataFrame, model: Hierarchy | None, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score. Whole texts; null or letterless ones are ``und`` with score 0.

    All other columns of ``docs`` are kept; columns of these two names are
    replaced. Repeated rows get the same answer each; of tied languages the
    first by name wins; an empty table gives no rows.
    """
    names = [name for name in docs.columns if name not in (lang_name, score_name)]
    body = F.when(has_letter(F.col(text_col)), F.col(text_col)).alias(unused(docs, "__body"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights for each pair of classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            body_at = batch.num_columns - 1
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(body_at).to_pylist()
                known = [i for i, t in enumerate(texts) if t is not None and found is not None]
                langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if known:
                    some, scores[known] = found.predict(features([texts[i] for i in known]))
                    for i, lang in zip(known, some, strict=True):
                        langs[i] = lang
                yield pa.record_batch([*part.columns[:-1], pa.array(langs, pa.string()), pa.array(scores)], names=[*batch.schema.names[:-1], lang_name, score_name])

    schema = docs.select(*(F.col(f"`{n}`") for n in names)).withColumns({lang_name: F.lit(""), score_name: F.lit(0.0)}).schema
    return docs.select(*(F.col(f"`{n}`") for n in names), body).mapInArrow(run, schema)


def held_out(id_col: Column, mod: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(mod)) == rest, F.lit(False))


def accepted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without null and letterless texts, whose language nothing can tell; ``lang_col`` becomes the predicted language of each text.

    The labels of this very table teach. Where none does, nothing is
    predicted, ``lang_col`` stays as it is and all texts with a letter are kept.
    Other columns stay whatever their names, and so do repeated rows and null ids.
    """
    kept = docs.where(has_letter(F.col(text_col)))
    model = fit(docs, text_col, lang_col)
    if model is None:
        return kept
    lang = unused(docs, "__lang_pred")
    found = predict(kept, model, text_col, lang_name=lang, score_name=unused(docs, "__lang_score"))
    return found.select(*(F.col(lang).alias(n) if n == lang_col else F.col(f"`{n}`") for n in docs.columns))


def op9(docs: DataFrame) -> DataFrame:
    """The rows of query ``op9_language_id``."""
    out = held_out(F.col("doc_id"), 3, 1)
    model = fit(docs.where(~out))
    return predict(docs.select("doc_id", "text", out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
