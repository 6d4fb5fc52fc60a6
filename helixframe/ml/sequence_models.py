"""The four models on sequences, their ensemble and their factory. Input columns: seq_idx, sequence, label."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as K
from pyspark.ml.feature import StandardScaler, StringIndexer, StringIndexerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.ml.bagged import BaggedForest
from helixframe.ml.training import split
from helixframe.operators import features, metrics
from helixframe.storage import spread, stored


@dataclass
class SequenceModel:
    """A classifier on the features of sequences; the vocabulary is fitted once and kept for prediction."""

    name: str
    sizes: tuple[int, ...] = (3, 4, 5, 6)
    many: int = 100
    trees: int = 100
    depth: int = 10
    scores: bool = False
    proteins: bool = False
    balanced: bool = False
    boosted: bool = False
    words: dict[int, list[str]] = field(default_factory=dict)
    labels: StringIndexerModel | None = None
    model: PipelineModel | None = None

    def table(self, seqs: DataFrame) -> DataFrame:
        """seq_idx, raw: the model's features."""
        if self.proteins:
            t = features.drug_target_features(seqs)
            return t.select("seq_idx", array_to_vector(F.concat("shares", F.array("hydrophobicity", "net_charge", "secondary", "binding"))).alias("raw"))
        t = features.feature_table(seqs, self.words, self.many)
        if not self.scores:
            return t.select("seq_idx", array_to_vector("features").alias("raw"))
        s = features.pathogen_scores(seqs)
        four = F.array(*[F.col(c).cast("double") for c in ("virulence", "resistance", "phylogenetic", "host")])
        return t.join(s, "seq_idx").select("seq_idx", array_to_vector(F.concat("features", four)).alias("raw"))

    def names(self) -> list[str]:
        from helixframe.constants import AMINO

        if self.proteins:
            return [f"{x}_freq" for x in AMINO] + ["hydrophobicity", "net_charge", "secondary", "binding"]
        return features.feature_names(self.words, self.many) + (["virulence", "resistance", "phylogenetic", "host"] if self.scores else [])

    def fit(self, seqs: DataFrame) -> SequenceModel:
        if not self.proteins:
            self.words = features.vocabulary(seqs, self.sizes, self.many)
        self.labels = StringIndexer(inputCol="label", outputCol="target", stringOrderType="alphabetAsc").fit(seqs)
        rows = spread(self.table(seqs).join(self.labels.transform(seqs).select("seq_idx", F.col("target").alias("label")), "seq_idx"), "seq_idx")
        classes = len(self.labels.labels)
        if self.balanced:
            per = rows.groupBy("label").agg(F.count("*").alias("__c"))
            total = rows.count()
            rows = rows.join(F.broadcast(per), "label").withColumn("weight", F.lit(total) / (classes * F.col("__c")))
        forest = K.RandomForestClassifier(numTrees=self.trees, maxDepth=self.depth, seed=42)
        if self.boosted:
            tree = K.GBTClassifier(maxIter=self.trees, maxDepth=self.depth, stepSize=0.05, seed=42)
            forest = tree if classes == 2 else K.OneVsRest(classifier=tree)
        elif self.balanced:
            forest = forest.setWeightCol("weight")
        self.model = Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True), forest]).fit(rows)
        return self

    def predict(self, seqs: DataFrame) -> DataFrame:
        """seq_idx, prediction (a label), probability (an array in the order of the labels)."""
        out = self.model.transform(self.table(seqs))
        names = F.array(*map(F.lit, self.labels.labels))
        p = vector_to_array("probability") if "probability" in out.columns else F.lit(None).cast("array<double>")
        return out.select("seq_idx", names[F.col("prediction").cast("int")].alias("prediction"), p.alias("probability"))


def model(name: str, trees: int | None = None, depth: int | None = None) -> SequenceModel:
    """A model by name; another name raises an error. Trees are limited to Spark's depth of 30."""
    made = {
        "gene_classifier": SequenceModel("gene_classifier", trees=100, depth=20),
        "pathogen_detector": SequenceModel("pathogen_detector", sizes=(4, 5, 6), many=50, trees=200, depth=15, scores=True, balanced=True),
        "drug_target_predictor": SequenceModel("drug_target_predictor", proteins=True, boosted=True, trees=150, depth=8),
        "biomarker_discoverer": SequenceModel("biomarker_discoverer", sizes=(4, 5, 6, 7), many=200, trees=500, depth=20),
    }
    if name not in made:
        raise ValueError(f"unknown model {name}")
    out = made[name]
    out.trees, out.depth = trees or out.trees, depth or out.depth
    return out


def discover_biomarkers(seqs: DataFrame, top: int = 50, trees: int = 500, depth: int = 20, group: int = 50) -> tuple[DataFrame, DataFrame]:
    """Scores of training rows, of rows that trees have not seen (out of bag) and of validation rows, and the most important features."""
    fit, held = split(seqs, "seq_idx")
    table = model("biomarker_discoverer")
    table.words = features.vocabulary(fit, table.sizes, table.many)
    labels = StringIndexer(inputCol="label", outputCol="target", stringOrderType="alphabetAsc", handleInvalid="skip").fit(fit)
    marked = lambda part: table.table(part).join(labels.transform(part).select("seq_idx", F.col("target").alias("label")), "seq_idx")
    rows = spread(marked(fit), "seq_idx")
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(rows)
    rows, other = scaler.transform(rows), scaler.transform(stored(marked(held)))
    forest = BaggedForest(trees, group, depth, key="seq_idx").fit(rows)
    score = lambda told, part: metrics.weighted_scores(told.select("label", "prediction")).select(F.lit(part).alias("part"), "accuracy")
    asked = lambda some: forest.predict(some).join(some.select("seq_idx", "label"), "seq_idx")
    scores = score(asked(rows), "train").unionByName(score(forest.unseen(rows), "out_of_bag")).unionByName(score(asked(other), "validation"))
    ranked = [(n, float(v)) for n, v in zip(table.names(), forest.importances())]
    best = seqs.sparkSession.createDataFrame(ranked, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(top)
    return scores, best


class Ensemble:
    """Any of the models, each fitted on its own labelled sequences; predictions by model."""

    def __init__(self, trees: int | None = None, depth: int | None = None) -> None:
        self.fitted: dict[str, SequenceModel] = {}
        self.trees, self.depth = trees, depth

    def fit(self, labelled: dict[str, DataFrame]) -> Ensemble:
        for name, seqs in labelled.items():
            self.fitted[name] = model(name, self.trees, self.depth).fit(seqs)
        return self

    def predict(self, seqs: DataFrame) -> DataFrame:
        """model, seq_idx, prediction, probability."""
        out = None
        for name, one in self.fitted.items():
            rows = one.predict(seqs).select(F.lit(name).alias("model"), "*")
            out = rows if out is None else out.unionByName(rows)
        return out

    def save(self, folder: str) -> None:
        for name, one in self.fitted.items():
            one.model.write().overwrite().save(f"{folder}/{name}")
