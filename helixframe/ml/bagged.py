"""A forest whose draws of rows can be told again, so that every tree can be asked about the rows that it has not seen."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from math import exp, factorial

import numpy as np
from pyspark.ml import classification as K
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shares of a Poisson draw with mean 1 that are at most 0, 1, 2, ...
POISSON = [sum(exp(-1) / factorial(j) for j in range(k + 1)) for k in range(16)]


def drawn(key: str, draw: int, seed: int = 42) -> Column:
    """How often a row is drawn: a Poisson number with mean 1 from a hash of its key, the same wherever it is asked for."""
    share = F.xxhash64(F.col(key), F.lit(seed), F.lit(draw)).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    return reduce(lambda a, b: a + b, [(share >= p).cast("int") for p in POISSON])


@dataclass
class BaggedForest:
    """``trees`` trees for classes in draws of ``group`` trees, each draw with its own Poisson weights of the rows.

    The trees of a draw share its rows and differ by the features that their splits may choose from. With ``group`` 1 every tree has
    weights of its own; larger groups are fitted together, level by level, in one pass over the rows for all their trees.
    """

    trees: int = 500
    group: int = 50
    depth: int = 20
    seed: int = 42
    key: str = "id"
    features: str = "features"
    classes: int = 0
    models: list[K.RandomForestClassificationModel] = field(default_factory=list)

    def fit(self, rows: DataFrame) -> BaggedForest:
        """Fit on (key, label, features); labels are whole numbers from 0 on."""
        self.classes = int(rows.agg(F.max("label")).first()[0]) + 1
        self.models = []
        for draw, at in enumerate(range(0, self.trees, self.group)):
            forest = K.RandomForestClassifier(
                numTrees=min(self.group, self.trees - at), maxDepth=self.depth, bootstrap=False, featureSubsetStrategy="sqrt", weightCol="__weight", featuresCol=self.features,
                seed=self.seed + draw,
            )
            self.models.append(forest.fit(rows.withColumn("__weight", drawn(self.key, draw, self.seed).cast("double")).where("__weight > 0")))
        return self

    def _votes(self, rows: DataFrame, unseen: bool) -> DataFrame:
        """key, label (if there is one), votes: class shares added up over the trees, or over those whose draw left the row out; trees."""
        out = None
        kept = [self.key, *(["label"] if "label" in rows.columns else [])]
        for draw, model in enumerate(self.models):
            some = rows.where(drawn(self.key, draw, self.seed) == 0) if unseen else rows
            shares = vector_to_array("rawPrediction")
            one = model.transform(some).select(*kept, F.lit(model.getNumTrees).alias("n"), *[F.coalesce(F.get(shares, F.lit(c)), F.lit(0.0)).alias(f"v{c}") for c in range(self.classes)])
            out = one if out is None else out.unionByName(one)
        votes = F.array(*[F.sum(f"v{c}") for c in range(self.classes)])
        return out.groupBy(*kept).agg(votes.alias("votes"), F.sum("n").alias("trees"))

    def predict(self, rows: DataFrame) -> DataFrame:
        """key, prediction (the lowest class on ties), probability."""
        return self._told(self._votes(rows.drop("label"), False))

    def unseen(self, rows: DataFrame) -> DataFrame:
        """key, label, prediction, probability of the fitted rows, each by the trees that have not seen it; rows that all have seen are missing."""
        return self._told(self._votes(rows, True))

    def _told(self, votes: DataFrame) -> DataFrame:
        best = (F.array_position("votes", F.array_max("votes")) - 1).cast("double")
        kept = [c for c in votes.columns if c not in ("votes", "trees")]
        return votes.select(*kept, best.alias("prediction"), F.transform("votes", lambda v: v / F.col("trees")).alias("probability"))

    def out_of_bag_score(self, rows: DataFrame) -> DataFrame:
        """One row: the share of right answers of ``unseen``, and how many of the rows it could ask about."""
        told = self.unseen(rows).agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("oob_score"), F.count("*").alias("asked"))
        return told.crossJoin(rows.agg(F.count("*").alias("rows")))

    def importances(self) -> np.ndarray:
        """The mean of the draws' importances, by their trees."""
        return np.average([m.featureImportances.toArray() for m in self.models], axis=0, weights=[m.getNumTrees for m in self.models])
