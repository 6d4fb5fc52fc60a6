"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

The features of a text are densities of a lexicon and of learned word beginnings, how near its words stand to a second
person, and rates of capitals, punctuation and obfuscated words. The lexicon is a short fixed list with words learned from
the labels: frequent in toxic training texts and rare in others.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import bounded_batches, bounded_labels, cut

#: Bound of the labelled rows used for fitting.
FIT_ROWS = 20_000
#: Letters of the word beginnings that are learned, for words in many endings.
BEGINNINGS = range(4, 8)
#: Chance that any word at all is learned though it does not depend on the label.
CHANCE = 0.05
#: Parts of the training rows; each is scored by trees of the others to calibrate.
FOLDS = 3
#: Share of the trees' own probability in a score, which orders texts within a step of the calibration.
WITHIN_STEP = 0.02
SEED_LEXICON = ("idiot", "moron", "stupid", "dumb", "loser", "trash", "scum", "pathetic", "worthless", "disgusting", "clown")
SECOND_PERSON = (
    "you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch",
    "tu", "te", "toi", "vous", "votre", "ton", "ta", "tú", "usted", "ustedes", "vosotros", "tus",
)
FEATURES = (
    "hits", "density", "kinds", "plain", "disguised", "second_person", "nearness", "near_hits", "capitals",
    "shouted", "exclaim", "question", "symbols", "obfuscated", "log_words", "begun", "begun_density",
)
#: Words between a lexicon word and a second person that still count as near.
NEAR = 8

_PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 or c in b"*@$" else 32 for c in range(256)
)
_LEET = bytes.maketrans(b"@013457$", b"aoieasts")
_ODD = re.compile(rb"[a-z\x80-\xff]+[*@$0-9]+[a-z\x80-\xff*@$0-9]*|[@$0-9]+[a-z\x80-\xff]+")


def _bare(word: bytes) -> bytes:
    return word.translate(_LEET, b"*")


def dense_features(
    text: str | None, lexicon: frozenset[bytes], masked: frozenset[bytes], beginnings: tuple[bytes, ...] = (), heads: frozenset[bytes] = frozenset()
) -> list[float]:
    """``masked``: the lexicon's words without each of their inner letters, for words hidden by stars; ``heads``: the first
    BEGINNINGS.start bytes of each of ``beginnings``."""
    raw = (text or "").encode("utf-8", "replace")
    low = raw.translate(_PLAIN)
    words = low.split()
    n = max(1, len(words))
    at = [k for k, w in enumerate(words) if w.strip(b"*@$") in lexicon]
    odd = _ODD.findall(low)
    hidden = [w for w in odd if w not in lexicon and (_bare(w) in lexicon or b"*" in w and _bare(w) in masked)]
    you = [k for k, w in enumerate(words) if w in _YOU]
    gap = NEAR * 4
    near = 0
    if at and you:
        y = np.array(you)
        for k in at:
            here = int(np.abs(y - k).min())
            gap = min(gap, here)
            near += here <= NEAR
    letters = len(raw) - raw.count(b" ") or 1
    tokens = raw.split()
    hits = len(at) + len(hidden)
    begun = sum(1 for w in words if w[: BEGINNINGS.start] in heads and w.startswith(beginnings)) if heads else 0
    return [
        np.log1p(hits),
        np.sqrt(hits / n),
        np.log1p(len({words[k] for k in at})),
        float(len(at) > 0),
        np.log1p(len(hidden)),
        np.sqrt(len(you) / n),
        1 / (1 + gap),
        np.log1p(near),
        sum(map(bytes.isupper, tokens)) / max(1, len(tokens)),
        sum(1 for t in tokens if len(t) > 3 and t.isupper()) / max(1, len(tokens)),
        raw.count(b"!") / n,
        raw.count(b"?") / n,
        (raw.count(b"*") + raw.count(b"@") + raw.count(b"$") + raw.count(b"#")) / letters,
        len(odd) / n,
        np.log1p(len(words)),
        np.log1p(begun),
        np.sqrt(begun / n),
    ]


_YOU = frozenset(w.encode() for w in SECOND_PERSON)


def _masks(lexicon: frozenset[bytes]) -> frozenset[bytes]:
    return frozenset(w[:k] + w[k + m :] for w in lexicon if len(w) > 4 for m in (1, 2) for k in range(1, len(w) - m))


def featured(text: Column, lexicon: frozenset[bytes], beginnings: tuple[bytes, ...]) -> Column:
    """array<double> of the features of a text column; null text counts as empty."""
    masked, heads = _masks(lexicon), frozenset(b[: BEGINNINGS.start] for b in beginnings)

    @F.pandas_udf("array<double>")
    def each(texts: pd.Series) -> pd.Series:
        return pd.Series([[float(v) for v in dense_features(t, lexicon, masked, beginnings, heads)] for t in texts])

    return each(text)


def learn_lexicon(texts: DataFrame) -> tuple[frozenset[bytes], tuple[bytes, ...]]:
    """Words and word beginnings of training rows (text, label).

    Words: the fixed list and those with at least 30 times the share of toxic texts that others have. Beginnings: those with at
    least 5 times that share. Both stand in at least a fiftieth of the toxic texts, each text counted once, where chance does
    not explain it (Chernoff's bound, over all words counted). There are at most 50 times as many as a toxic training text
    holds on average.
    """

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [set((t or "").encode("utf-8", "replace").translate(_PLAIN).decode("utf-8", "replace").split(" ")) - {""} for t in batch["text"]]
            found = [[*ws, *{w[:k] + "-" for w in ws for k in BEGINNINGS if len(w) >= k}] for ws in found]
            yield pd.DataFrame(
                {
                    "word": [w for ws in found for w in ws],
                    "label": np.repeat(batch["label"].to_numpy(), [len(ws) for ws in found]),
                }
            )

    texts = texts.groupBy(F.xxhash64("text").alias("h")).agg(F.max("label").alias("label"), F.max("text").alias("text"))
    size = texts.agg(F.sum("label").alias("toxic"), F.count("*").alias("n")).first()
    toxic, other = size["toxic"] or 0.0, (size["n"] or 0) - (size["toxic"] or 0.0)
    learned, begun = [], []
    if toxic and other:
        counts = texts.select("text", "label").mapInPandas(words, "word string, label double")
        counts = cut(counts.groupBy("word").agg(F.sum("label").alias("hit"), F.count("*").alias("n")))
        base, hit = toxic / (toxic + other), F.col("hit") / F.col("n")
        gain = hit * F.log(hit / base) + F.when(hit < 1, (1 - hit) * F.log((1 - hit) / (1 - base))).otherwise(0.0)
        sure = F.col("n") * gain >= math.log(max(1, counts.count()) / CHANCE)
        share = (F.col("hit") + 0.5) / (toxic + 1) / ((F.col("n") - F.col("hit") + 0.5) / (other + 1))
        often = counts.where((F.col("hit") >= max(3, 0.02 * toxic)) & sure & (F.length("word") > 2))
        whole = ~F.col("word").endswith("-")
        strong = [r["word"] for r in often.where(share >= F.when(whole, 30).otherwise(5)).select("word").collect()]
        learned = [w for w in strong if not w.endswith("-")]
        begun = [w[:-1] for w in strong if w.endswith("-")]
    return frozenset(w.encode() for w in (*SEED_LEXICON, *learned)), tuple(sorted(w.encode() for w in begun))


@dataclass
class ToxicityModel:
    lexicon: frozenset[bytes]
    beginnings: tuple[bytes, ...]
    trees: object | None
    calibration: object | None
    #: The score of every text when the training rows hold one class only.
    constant: float = 0.0

    def add_score(self, docs: DataFrame, name: str, threshold: float | None = None) -> DataFrame:
        """``docs`` with its columns and the calibrated score under ``name``."""
        if self.trees is None:
            return docs.withColumn(name, F.lit(self.constant))
        own = [f"__{x}_{name}" for x in ("features", "raw", "margin", "probability", "prediction")]
        trees, calibration = self.trees, self.calibration
        trees.setFeaturesCol(own[0]).setRawPredictionCol(own[1]).setProbabilityCol(own[3]).setPredictionCol(own[4])
        calibration.setFeaturesCol(own[2]).setPredictionCol(name)
        out = bounded_batches(docs).withColumn(own[0], array_to_vector(featured(F.col("text"), self.lexicon, self.beginnings)))
        out = trees.transform(out).withColumn(own[2], vector_to_array(own[3])[1])
        out = calibration.transform(out.drop(name))
        score = F.col(name) * (1 - WITHIN_STEP) + F.col(own[2]) * WITHIN_STEP
        return out.withColumn(name, F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))).drop(*own)


def _margin(trees: object, rows: DataFrame) -> DataFrame:
    return trees.transform(rows).select("label", vector_to_array("probability")[1].alias("margin"))


def fit(texts: DataFrame, trees: int = 20, depth: int = 4, parts: int = 6) -> ToxicityModel:
    """Fit on rows (doc_id, text, label 0.0 or 1.0).

    The calibration sees every row once, scored by trees that were fitted without its fold; folds go by a hash of the text, so
    that copies stand in one. Where a fold leaves one class only, the trees of all rows score it.
    """
    texts = cut(bounded_batches(texts).select("doc_id", "text", "label"))
    lexicon, beginnings = learn_lexicon(texts)
    fold = F.pmod(F.xxhash64("text", F.lit(7)), F.lit(FOLDS))
    rows = cut(texts.select(fold.alias("fold"), "label", array_to_vector(featured(F.col("text"), lexicon, beginnings)).alias("features")).coalesce(parts))
    seen = {(r["fold"], r["label"]): r["count"] for r in rows.groupBy("fold", "label").count().collect()}
    total = {c: sum(n for (_, label), n in seen.items() if label == c) for c in (0.0, 1.0)}
    if not all(total.values()):
        return ToxicityModel(lexicon, beginnings, None, None, float(bool(total[1.0])))
    grower = GBTClassifier(
        featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=11, minInstancesPerNode=2, cacheNodeIds=False
    )
    model = grower.fit(rows)
    scored = []
    for k in range(FOLDS):
        both = all(total[c] > seen.get((k, c), 0) for c in (0.0, 1.0))
        grown = grower.fit(rows.where(F.col("fold") != k)) if both else model
        scored.append(_margin(grown, rows.where(F.col("fold") == k)))
    calibration = IsotonicRegression(featuresCol="margin", labelCol="label").fit(cut(reduce(DataFrame.unionByName, scored)))
    return ToxicityModel(lexicon, beginnings, model, calibration)


def train(docs: DataFrame, labels: DataFrame, label: str, keep: Column, max_rows: int = FIT_ROWS) -> ToxicityModel:
    """Fit on the labelled rows of ``labels`` for which ``keep`` holds, at most about ``max_rows``."""
    known = bounded_labels(labels, label, keep, max_rows)
    return fit(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"))


def classify(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """All columns of ``docs`` with ``toxic_score`` (0 to 1, higher: toxic is likelier) and
    ``toxic_pred`` (1 if the score is at least 0.5, else 0). Null and empty texts are scored like
    any other, repeated rows each, an empty table gives no rows; columns of these two names are
    replaced."""
    return model.add_score(docs, "toxic_score").withColumn("toxic_pred", (F.col("toxic_score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows scored under 0.5, with the columns of ``docs`` as they are.

    Null and empty texts are scored like a text without words; repeated rows are judged alike, and rows without doc_id as any
    other; an empty table gives no rows.
    """
    return model.add_score(docs, "__toxic_score").where(F.col("__toxic_score") < 0.5).select(*docs.columns)
