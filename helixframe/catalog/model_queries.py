"""Queries and SQL of model selection, training, evaluation and neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.catalog.base import load, query, r6, seqs
from helixframe.catalog.registry import datasets
from helixframe.catalog.oracles import _PRED
from helixframe.ml import budget, explain, search
from helixframe.ml import models as M
from helixframe.ml import sequence_models as Q
from helixframe.ml import training as T
from helixframe.ml.bagged import BaggedForest
from helixframe.operators import neighbours

ORACLES: dict[str, str] = {}


def predicted(spark, d):
    """labels with a deterministic score, prediction and probabilities."""
    score = F.round(F.expr("cast(conv(substr(md5(cast(doc_id as string)), 1, 4), 16, 10) as double)") / 65536, 2)
    rows = load(spark, d, "labels").select("doc_id", F.col("quality").alias("label"), score.alias("score"))
    return rows.withColumn("prediction", (F.col("score") >= 0.4).cast("int")).withColumn("probability", F.array(1 - F.col("score"), F.col("score")))


@query
def task_types(spark, d):
    kinds = F.array(*map(F.lit, ("dna", "protein", "rna", "general")))
    c = load(spark, d, "customer")
    return c.select("c_custkey", T.task_type(kinds[(F.col("c_custkey") % 4).cast("int")], F.col("c_custkey") % 3 > 0, F.col("c_nationkey")).alias("task"))


ORACLES["task_types"] = """select c_custkey, case when c_custkey % 3 = 0 then 'clustering' when c_custkey % 4 = 0 then 'dna_classification' when c_custkey % 4 = 1 then 'protein_classification' when c_custkey % 4 = 2 then 'rna_classification'
when c_nationkey > 1 then 'general_classification' else 'general_regression' end as task from customer"""


_DATASETS = """g as (select l_returnflag, l_quantity, count(*) as n, count(distinct l_suppkey) as features, count(distinct l_linenumber * (l_quantity % 3)) as classes from lineitem group by all),
sets as (select concat_ws('-', l_returnflag, l_quantity::int) as name, n * l_quantity::int as n, features, classes, case when l_quantity % 3 = 0 then 'protein_classification' else 'general' end as task from g)"""
_NAMES = ["random_forest", "xgboost", "gradient_boosting", "svm", "logistic_regression", "knn", "naive_bayes"]
_HOLDS = {"few_rows": "n < 1000", "many_rows": "n > 10000", "wide": "features > 100", "many_classes": "classes > 10", "biological": "contains(task, 'protein')"}
ORACLES["model_ranking"] = f"with {_DATASETS}, s as (" + " union all ".join(
    f"select name, {i} as place, '{m}' as model, 100{''.join(f' + case when {h} then {M.RANKING[t].get(m, 0)} else 0 end' for t, h in _HOLDS.items())} as score from sets" for i, m in enumerate(_NAMES)
) + ") select name, model, score, row_number() over (partition by name order by score desc, place)::int as rank from s"


@query
def algorithm_suggestions(spark, d):
    """For datasets of each return flag and quantity, as each of the three tasks."""
    sets = datasets(spark, d).select("name", (F.col("rows") / 50).alias("megabytes"), (F.col("features") * 20).alias("features"), F.explode(F.array(*map(F.lit, ("classification", "regression", "clustering")))).alias("task"))
    return T.suggestions(sets)


_ALGO = ", ".join(f"({i}, '{a}', '{t}', '{c}', '{x}')" for i, (a, t, c, x) in enumerate(T.ALGORITHMS))
ORACLES["algorithm_suggestions"] = f"""with a(place, algorithm, task, category, complexity) as (values {_ALGO}), {_DATASETS}, c as (select name, n / 50.0::double as megabytes, features * 20 as features from sets),
s as (select a.*, name, case when megabytes < 10 and complexity <> 'high' then 2 when megabytes > 100 and algorithm in ('logistic_regression', 'linear_regression') then 2 else 0 end
+ case when features > 1000 and category in ('linear', 'kernel') then 1 else 0 end + case when complexity <> 'high' then 1 else 0 end as score from a, c),
r as (select *, row_number() over (partition by task, name order by score desc, place)::int as k from s) select name, task, algorithm, score, k as rank from r where k <= 5"""


@query
def prediction_confidence(spark, d):
    c = T.confidence(predicted(spark, d))
    return c.select(*[r6(F.col(x), x) for x in c.columns])


ORACLES["prediction_confidence"] = f"with {_PRED}, x as (select greatest(score, 1 - score) as p from p) select round(avg(p), 6) as mean, round(stddev_pop(p), 6) as std, round(min(p), 6) as min, round(max(p), 6) as max from x"


@query
def residual_stats(spark, d):
    x = load(spark, d, "lineitem").select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1000).alias("prediction"))
    r = T.residuals(x)
    return r.select(*[F.round(c, 3).alias(c) for c in r.columns])


ORACLES["residual_stats"] = "with x as (select l_extendedprice - l_quantity * 1000 as e, l_quantity * 1000 as p from lineitem) select " + ", ".join(
    f"round({f}({c}), 3)::double as {n}_{k}" for n, c in (("residual", "e"), ("prediction", "p")) for k, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))
) + " from x"


@query
def model_consensus(spark, d):
    """Four models whose predictions are drawn from the digest of an id."""
    p = predicted(spark, d)
    rows = p.select(F.concat(F.lit("m"), F.col("doc_id") % 4).alias("model"), F.when(F.col("doc_id") % 4 == 3, 1).otherwise(F.col("prediction")).alias("prediction"), "probability")
    return T.consensus(rows).select("model", "most_common", "votes", r6(F.col("confidence"), "confidence"), "significance")


ORACLES["model_consensus"] = f"""with {_PRED}, x as (select 'm' || doc_id % 4 as model, case when doc_id % 4 = 3 then 1 else prediction end as prediction, greatest(score, 1 - score) as c from p),
n as (select model, prediction, count(*) as n from x group by all), s as (select model, avg(c) as c from x group by model)
select model, (array_agg(prediction order by n desc, prediction))[1] as most_common, max(n) as votes, round(any_value(c), 6) as confidence, case when count(*) > 1 then 'BIOLOGICALLY_DIVERSE' else 'HOMOGENEOUS_PATTERN' end as significance
from n join s using (model) group by model"""


@query
def quality_labels(spark, d):
    p = load(spark, d, "part").select("p_partkey", (F.col("p_size") / 50).alias("a"))
    return p.select("p_partkey", T.quality_label(F.col("a")).alias("quality"))


ORACLES["quality_labels"] = "select p_partkey, case when p_size / 50.0::double > 0.9 then 'EXCELLENT' when p_size / 50.0::double > 0.8 then 'GOOD' when p_size / 50.0::double > 0.7 then 'FAIR' else 'POOR' end as quality from part"


@query
def class_distributions(spark, d):
    p = predicted(spark, d)
    kinds = lambda c: p.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("field"), "value", "n")
    return kinds("label").unionByName(kinds("prediction"))


ORACLES["class_distributions"] = f"with {_PRED} select 'label' as field, label as value, count(*) as n from p group by all union all select 'prediction', prediction, count(*) from p group by all"


@query
def knn_impute(spark, d):
    p = load(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice")).alias("p_retailprice"))
    return neighbours.impute_nearest(p, "p_partkey", "p_retailprice", ["p_size"]).select("p_partkey", F.round("p_retailprice", 4).alias("p_retailprice"))


ORACLES["knn_impute"] = """with p as (select p_partkey, p_size, case when p_partkey % 7 <> 0 then p_retailprice end as v from part),
n as (select a.p_partkey, b.v, row_number() over (partition by a.p_partkey order by abs(a.p_size - b.p_size), b.p_partkey) as k from p as a, p as b where a.v is null and b.v is not null),
m as (select p_partkey, avg(v) as m from n where k <= 5 group by all) select p_partkey, round(coalesce(v, m), 4) as p_retailprice from p left join m using (p_partkey)"""


@query
def pruned_neighbours(spark, d):
    """The five nearest vectors of every fiftieth one, through the cells that can hold them."""
    e = load(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    return neighbours.nearest_pruned(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), asked, 5)[0].select("q", "id", r6(F.col("d"), "d"))


ORACLES["pruned_neighbours"] = """with g as (select a.vec_id as q, b.vec_id as id, sqrt(list_sum(list_transform(list_zip(a.embedding::double[], b.embedding::double[]), lambda x: power(x[1] - x[2], 2)))) as d
from embeddings as a join embeddings as b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id), r as (select *, row_number() over (partition by q order by d, id) as k from g) select q, id, round(d, 6) as d from r where k <= 5"""


@query
def dbscan(spark, d):
    p = load(spark, d, "part").select("p_partkey", (F.col("p_size") / 50).alias("x"), (F.col("p_retailprice") / 2000).alias("y"))
    return neighbours.dbscan(p, "p_partkey", ["x", "y"], 0.021, 4)


ORACLES["dbscan"] = """with recursive p as (select p_partkey as id, p_size / 50.0::double as x, p_retailprice / 2000 as y from part),
near as (select a.id, b.id as o from p as a, p as b where abs(a.x - b.x) <= 0.021 and sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= 0.021),
core as (select id from near group by id having count(*) >= 4), e as (select id, o from near where id in (from core) and o in (from core)),
reach(id, r) as (select id, id from core union select e.o, reach.r from reach join e on e.id = reach.id where reach.r < e.o),
lab as (select id, min(r) as label from reach group by id), bord as (select near.id, min(label) as label from near join lab on lab.id = near.o where near.id not in (from core) group by near.id)
select p.id as p_partkey, coalesce(lab.label, bord.label) as cluster from p left join lab on lab.id = p.id left join bord on bord.id = p.id"""


# Trained models: rows only; their tests hold them against plain computations.
def labelled(spark, d):
    lab = load(spark, d, "labels").select(F.col("doc_id").alias("seq_idx"), F.col("quality").cast("string").alias("label"))
    marked = F.when(F.col("label") == "1", F.concat(F.repeat(F.lit("GC"), 20), F.col("sequence"))).otherwise(F.col("sequence"))
    return seqs(spark, d).join(lab, "seq_idx").withColumn("sequence", marked)


@query
def model_comparison(spark, d):
    rows = M.embedded(load(spark, d, "embeddings"))
    return T.compare(rows, ["decision_tree", "logistic_regression", "naive_bayes"], classes=10)


@query
def nonlinear_models(spark, d):
    """Nearest neighbours, a kernel machine and a network on the vectors' labels."""
    rows = M.embedded(load(spark, d, "embeddings"))
    return T.compare(rows, ["knn", "svm_rbf", "mlp"], classes=10)


@query
def out_of_bag(spark, d):
    """The labels of all vectors by the trees that have not seen them, of a forest of 500."""
    rows = M.embedded(load(spark, d, "embeddings"))
    return BaggedForest(depth=10, features="raw").fit(rows).unseen(rows)


@query
def cross_validation(spark, d):
    return T.cross_validated(M.embedded(load(spark, d, "embeddings")), "naive_bayes", classes=10, folds=3)


@query
def ridge_search(spark, d):
    """Penalties of a line through retail prices by size, over three folds, all from one scan."""
    from pyspark.ml.functions import array_to_vector

    p = load(spark, d, "part").select((F.col("p_partkey") % 3).cast("int").alias("k"), F.col("p_retailprice").alias("label"), array_to_vector(F.array(F.col("p_size").cast("double"))).alias("raw"))
    out = search.ridge_search(p, [0.0, 1.0, 100.0, 10_000.0], F.col("k"))
    return out.select("alpha", "fold", r6(F.col("score"), "score"), r6(F.col("mean"), "mean"), "rank")


ORACLES["ridge_search"] = """with p as (select p_partkey % 3 as fold, p_size::double as x, p_retailprice::double as y from part), f as (select unnest(range(3)) as fold), a as (select unnest([0, 1, 100, 10000])::double as alpha),
fit as (select f.fold, count(*) as n, avg(x) as mx, avg(y) as my, covar_pop(x, y) * count(*) as sxy, var_pop(x) * count(*) as sxx from f join p on p.fold <> f.fold group by all),
w as (select fold, alpha, sxy / (sxx + alpha) as w, my - sxy / (sxx + alpha) * mx as b from fit, a),
s as (select alpha, p.fold, 1 - sum(power(y - b - w * x, 2)) / (var_pop(y) * count(*)) as score from p join w on w.fold = p.fold group by all),
m as (select alpha, avg(score) as mean from s group by all), r as (select *, row_number() over (order by mean desc, alpha)::int as rank from m)
select alpha, fold::int as fold, round(score, 6) as score, round(mean, 6) as mean, rank from s join r using (alpha)"""


@query
def naive_bayes_search(spark, d):
    rows = M.embedded(load(spark, d, "embeddings"))
    return search.naive_bayes_search(rows, [1e-9, 1e-3, 0.1, 1.0], search.hashed_fold("id", 3))


@query
def random_search(spark, d):
    """Six of the combinations of a tree's parameters, drawn with a seed."""
    rows = M.embedded(load(spark, d, "embeddings"))
    return M.tuned(rows, M.classifier("decision_tree"), {"maxDepth": [2, 4, 8], "minInstancesPerNode": [1, 2, 4], "maxBins": [16, 32]}, many=6)[1]


@query
def budgeted_models(spark, d):
    """Three models within five minutes, with what became of each."""
    rows = M.embedded(load(spark, d, "embeddings"))
    return budget.best_model(rows, ["naive_bayes", "decision_tree", "logistic_regression"], 300, 10)[1].drop("run", "seconds")


@query
def regression_models(spark, d):
    p = load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("label"), F.col("p_size").cast("double").alias("s"))
    from pyspark.ml.functions import array_to_vector

    rows = p.select("id", "label", array_to_vector(F.array("s", F.col("id").cast("double"))).alias("raw"))
    return T.union_all([T.train_regression(rows, n)[1].select(F.lit(n).alias("model"), "*") for n in ("linear", "ridge", "decision_tree")])


@query
def feature_importance(spark, d):
    rows = M.embedded(load(spark, d, "embeddings"))
    model, _ = T.train(rows, "decision_tree", 10)
    n = len(load(spark, d, "embeddings").select("embedding").first()[0])
    return T.importances(spark, model, [f"e{i}" for i in range(n)])


@query
def linear_shap(spark, d):
    """Contributions of each feature to a linear model's predictions."""
    from pyspark.ml.functions import array_to_vector

    p = load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("label"), array_to_vector(F.array(F.col("p_size").cast("double"), F.col("p_partkey").cast("double"))).alias("raw"))
    model = M.regressor("linear").setFeaturesCol("raw").fit(p)
    means = load(spark, d, "part").agg(F.avg("p_size").alias("a"), F.avg("p_partkey").alias("b")).first()
    return M.linear_contributions(model, p, [means["a"], means["b"]])


@query
def tree_shap(spark, d):
    """Each vector's parts of the margin of boosted trees that tell odd labels from even ones."""
    rows = M.embedded(load(spark, d, "embeddings")).select("id", (F.col("label") % 2).alias("label"), "raw")
    return explain.tree_contributions(M.classifier("gradient_boosting").setFeaturesCol("raw").fit(rows), rows, "raw")


@query
def tree_shap_summary(spark, d):
    """The ten features that move a forest's votes most, over all vectors and labels."""
    rows = M.embedded(load(spark, d, "embeddings"))
    model = M.classifier("random_forest").setFeaturesCol("raw").fit(rows)
    return explain.tree_mean_sizes(model, rows, [f"e{i}" for i in range(model.numFeatures)], "raw", 10)


@query
def one_click(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.month("o_orderdate").alias("month"), "o_orderpriority")
    return T.one_click(o, "o_orderstatus", "o_orderkey")[1]


@query
def gene_classifier(spark, d):
    s = labelled(spark, d)
    return Q.model("gene_classifier").fit(s).predict(s)


@query
def pathogen_detector(spark, d):
    s = labelled(spark, d)
    return Q.model("pathogen_detector").fit(s).predict(s)


@query
def drug_target_predictor(spark, d):
    s = labelled(spark, d)
    return Q.model("drug_target_predictor").fit(s).predict(s)


@query
def biomarker_discoverer(spark, d):
    return Q.discover_biomarkers(labelled(spark, d))[1]


@query
def ensemble(spark, d):
    s = labelled(spark, d)
    return T.consensus(Q.Ensemble().fit({"gene_classifier": s, "drug_target_predictor": s}).predict(s))
