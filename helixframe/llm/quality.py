"""Quality classifier: regularised quadratic discriminant over document statistics.

Each document becomes a vector of transformed statistics. Every class has a mean and a covariance
that is shrunk towards the pooled covariance and towards a multiple of the identity; the score is
the difference of the two Mahalanobis log densities, taken from cached Cholesky factors, passed
through a logistic curve.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import bounded_batches, bounded_labels

#: Bound of the labelled rows used for fitting.
FIT_ROWS = 20_000
FEATURES = (
    "log_chars", "log_words", "word_length", "upper", "digit", "symbol", "bar", "exclaim", "decorated",
    "stop_mark", "distinct_words", "repeat_next", "top_word", "line_repeat", "line_length", "packed", "short_words",
)

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of the text that are compressed at a time, for texts of any length.
_BLOCK = 1 << 15


def _packed(raw: bytes) -> float:
    """Compressed size by block over size, of the whole text."""
    size = sum(len(zlib.compress(raw[at : at + _BLOCK], 1)) for at in range(0, len(raw), _BLOCK))
    return size / max(1, len(raw))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text; null counts as empty, and empty gives finite values."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(1, len(raw))
    letters = count[_LETTER].sum()
    words = text.split()
    m = max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    often = Counter(words)
    known = letters + count[_DIGIT].sum() + count[_SPACE].sum()
    root = np.sqrt
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        np.log1p((n - count[_SPACE].sum()) / m),
        root(count[_UPPER].sum() / max(1, letters)),
        root(count[_DIGIT].sum() / n),
        root((n - known) / n),
        root(count[124] / m),
        root(count[33] / m),
        root((count[42] + count[36] + count[35] + count[126]) / m),
        root((count[46] + count[44]) / m),
        np.log1p(len(often)) / np.log1p(m),
        root(sum(map(eq, words, words[1:])) / m),
        root(max(often.values(), default=0) / (m + 5)),
        root(1 - len(set(lines)) / max(1, len(lines))),
        np.log1p(m / max(1, len(lines))),
        _packed(raw),
        root(sum(v for w, v in often.items() if len(w) < 4) / m),
    ]


@dataclass
class Discriminant:
    """Per class: log prior, mean, inverse Cholesky factor and half log determinant."""

    offset: list[float]
    mean: list[np.ndarray]
    factor: list[np.ndarray]
    temperature: float

    def score(self, x: np.ndarray) -> np.ndarray:
        density = []
        for log_prior, mean, factor in zip(self.offset, self.mean, self.factor):
            z = (x - mean) @ factor.T
            density.append(log_prior + np.log(np.diag(factor)).sum() - 0.5 * (z * z).sum(1))
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / self.temperature, -30, 30)))


def fit(texts: DataFrame, shrink: float = 0.2, ridge: float = 0.05, temperature: float = 4.0) -> Discriminant:
    """Fit on rows (text, label 0.0 or 1.0). Tasks sum up moments, which are added by class and place: a bounded number of rows.

    With no rows of a class its distribution falls back to the other's, so every score is 0.5.
    """
    d = len(FEATURES)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {0: np.zeros(1 + d + d * d), 1: np.zeros(1 + d + d * d)}
        for batch in batches:
            x = np.array([statistics(t) for t in batch["text"]]).reshape(-1, d)
            for c in total:
                here = x[(batch["label"] >= 0.5).to_numpy() == bool(c)]
                total[c] += np.r_[len(here), here.sum(0), (here.T @ here).ravel()]
        yield pd.DataFrame({"label": list(total), "sums": [v.tolist() for v in total.values()]})

    sums = {0: np.zeros(1 + d + d * d), 1: np.zeros(1 + d + d * d)}
    parts = bounded_batches(texts).select("text", "label").mapInPandas(moments, "label int, sums array<double>")
    parts = parts.select("label", F.posexplode("sums").alias("place", "v")).groupBy("label", "place").agg(F.sum("v").alias("v"))
    for row in parts.collect():
        sums[row["label"]][row["place"]] += row["v"]
    whole = sums[0] + sums[1]
    if not whole[0]:
        whole[0] = 1
    for c in (0, 1):
        if not sums[c][0]:
            sums[c] = whole

    def covariance(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = s[1 : 1 + d] / s[0]
        return mean, s[1 + d :].reshape(d, d) / s[0] - np.outer(mean, mean)

    _, pooled = covariance(whole)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-8))
    offset, means, factors = [], [], []
    for c in (0, 1):
        mean, cov = covariance(sums[c])
        cov = (1 - shrink) * cov + shrink * pooled
        cov = (1 - ridge) * cov + ridge * np.diag(scale**2)
        means.append(mean)
        factors.append(np.linalg.inv(np.linalg.cholesky(cov + 1e-9 * np.eye(d))))
        offset.append(float(np.log(max(1, sums[c][0]) / max(1, sums[0][0] + sums[1][0]))))
    return Discriminant(offset, means, factors, temperature)


def train(docs: DataFrame, labels: DataFrame, label: str, keep: Column, max_rows: int = FIT_ROWS) -> Discriminant:
    """Fit on the labelled rows of ``labels`` for which ``keep`` holds, at most about ``max_rows``
    chosen by a hash of the id, which also bounds what the join broadcasts."""
    known = bounded_labels(labels, label, keep, max_rows)
    return fit(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"))


def scored(text: Column, model: Discriminant) -> Column:
    """Score of a text column, 0 to 1, higher: quality 1 is likelier; null text counts as empty."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([statistics(t) for t in texts]).reshape(-1, len(FEATURES))
        return pd.Series(model.score(x))

    return score(text)


def classify(docs: DataFrame, model: Discriminant) -> DataFrame:
    """All columns of ``docs`` with ``quality_score`` and ``quality_pred`` (1 if the score is at
    least 0.5, else 0). Null and empty texts are scored like any other, repeated rows each, an
    empty table gives no rows; columns of these two names are replaced."""
    return bounded_batches(docs).withColumn("quality_score", scored(F.col("text"), model)).withColumn(
        "quality_pred", (F.col("quality_score") >= 0.5).cast("int")
    )


def keep_good(docs: DataFrame, model: Discriminant) -> DataFrame:
    """The rows scored at least 0.5, with the columns of ``docs`` as they are.

    Null texts count as empty, which are scored like any other; repeated rows are judged alike, and rows without doc_id as any
    other; an empty table gives no rows.
    """
    return bounded_batches(docs).where(scored(F.col("text"), model) >= 0.5)
