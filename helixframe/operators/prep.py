"""Cleaning, scaling and encoding of tabular data."""

from __future__ import annotations

from itertools import combinations, combinations_with_replacement
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import sequence as S
from helixframe.operators import information, ordered, profile


def impute(df: DataFrame, columns: list[str], how: str) -> DataFrame:
    """Fill nulls by mean, exact median or mode (the lowest value on ties)."""
    if how == "median":
        found = profile.quantiles(profile.counted(df, columns), (0.5,))
        stats = found.agg(*[F.max(F.when(F.col("column") == c, F.col("q50"))).alias(f"__{c}") for c in columns])
    else:
        of = {"mean": lambda c: F.avg(c), "mode": lambda c: F.mode(c, True)}[how]
        stats = df.agg(*[of(c).alias(f"__{c}") for c in columns])
    out = df.crossJoin(F.broadcast(stats))
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"__{c}")))
    return out.select(*df.columns)


def forward_fill(df: DataFrame, column: str, order: str, *by: str) -> DataFrame:
    """The last known value in ``order``, within each key of ``by``."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def drop_sparse(df: DataFrame, share: float = 0.5) -> DataFrame:
    return df.na.drop(thresh=-int(-share * len(df.columns) // 1))


def scale(df: DataFrame, columns: list[str], how: str) -> DataFrame:
    """standard (population deviation), minmax or robust (exact quartiles); a constant column becomes 0."""
    if how == "robust":
        of = lambda c, q: F.max(F.when(F.col("column") == c, F.col(q)))
        q = profile.quantiles(profile.counted(df, columns), (0.25, 0.5, 0.75))
        stats = q.agg(*[x for c in columns for x in (of(c, "q50").alias(f"__a_{c}"), (of(c, "q75") - of(c, "q25")).alias(f"__b_{c}"))])
    else:
        two = {"standard": lambda c: (F.avg(c), F.stddev_pop(c)), "minmax": lambda c: (F.min(c), F.max(c) - F.min(c))}[how]
        stats = df.agg(*[x.alias(f"__{n}_{c}") for c in columns for n, x in zip("ab", two(c))])
    out = df.crossJoin(F.broadcast(stats))
    for c in columns:
        by = F.when(F.col(f"__b_{c}") == 0, 1.0).otherwise(F.col(f"__b_{c}"))
        out = out.withColumn(c, (F.col(c) - F.col(f"__a_{c}")) / by)
    return out.select(*df.columns)


def polynomial(df: DataFrame, columns: list[str]) -> DataFrame:
    """Squares and products of two columns, as poly_a_b."""
    return df.withColumns({f"poly_{a}_{b}": F.col(a) * F.col(b) for a, b in combinations_with_replacement(columns, 2)})


def interactions(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in combinations(columns, 2)})


def log_transform(df: DataFrame, columns: list[str]) -> DataFrame:
    """log_c for each column whose least value is positive, null otherwise."""
    least = df.agg(*[F.min(c).alias(f"__{c}") for c in columns])
    out = df.crossJoin(F.broadcast(least))
    return out.withColumns({f"log_{c}": F.when(F.col(f"__{c}") > 0, F.ln(F.when(F.col(c) > 0, F.col(c)))) for c in columns}).drop(*[f"__{c}" for c in columns])


def remove_outliers_iqr(df: DataFrame, columns: list[str], factor: float = 1.5) -> DataFrame:
    """Column after column, with fences from the rows that are left; nulls go."""
    for c in columns:
        fence = profile.iqr_bounds(df, [c], factor).select(F.col("low").alias("__lo"), F.col("high").alias("__hi"))
        df = df.crossJoin(F.broadcast(fence)).where(F.col(c).between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")
    return df


def remove_outliers_z(df: DataFrame, columns: list[str], most: float = 3.0) -> DataFrame:
    """Column after column, values under ``most`` sample deviations from the mean; a constant column keeps no row."""
    for c in columns:
        stats = df.agg(F.avg(c).alias("__m"), F.stddev_samp(c).alias("__s"))
        z = F.abs(F.col(c) - F.col("__m")) / F.when(F.col("__s") != 0, F.col("__s"))
        df = df.crossJoin(F.broadcast(stats)).where(z < most).drop("__m", "__s")
    return df


def anova_f(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """F statistic of each column between the label's classes, from sums by class."""
    sums = [F.count("*").alias("n"), *[x for c in columns for x in (F.sum(c).alias(f"s_{c}"), F.sum(F.col(c) * F.col(c)).alias(f"q_{c}"))]]
    per = df.groupBy(label).agg(*sums)
    cells = per.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col("n"), F.col(f"s_{c}").alias("s"), F.col(f"q_{c}").alias("q")) for c in columns])).alias("x"))
    one = cells.select("x.*").groupBy("feature").agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b")
    )
    between = (F.col("b") - F.col("s") * F.col("s") / F.col("n")) / (F.col("k") - 1)
    within = (F.col("q") - F.col("b")) / (F.col("n") - F.col("k"))
    return one.select("feature", (between / within).alias("f_score"))


def label_encode(df: DataFrame, column: str) -> DataFrame:
    """The sorted distinct values numbered from 0 in ``code``. Values are numbered within ranges, and the ranges by their
    counts, so no task orders all values; the join is Spark's choice."""
    kinds = df.select(column).where(F.col(column).isNotNull()).distinct()
    kinds = kinds.repartitionByRange(column).sortWithinPartitions(column).withColumn("__part", F.spark_partition_id())
    kinds = kinds.withColumn("__at", F.monotonically_increasing_id() - F.shiftleft(F.col("__part").cast("long"), 33))
    counts = kinds.groupBy("__part").agg((F.max("__at") + 1).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    codes = kinds.join(F.broadcast(counts.select("__part", before.alias("__before"))), "__part")
    codes = codes.select(column, (F.col("__at") + F.col("__before")).alias("code"))
    return df.join(codes, column, "left")


def _placed(df: DataFrame, key: str, strata: Column) -> DataFrame:
    """``df`` with __k, the place of a row in its stratum in order of the key's md5 and the key, from 1, and __n, the stratum's rows.

    All rows are placed by sorted ranges, so a stratum may hold most of them; nulls are a stratum.
    """
    rows = df.withColumns({"__s": strata.cast("string"), "__h": F.md5(F.col(key).cast("string"))})
    rows = ordered.running(rows, ["__s", "__h", key], name="__at")
    per = rows.groupBy(F.col("__s").alias("__t")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    rows = rows.join(per, F.col("__s").eqNullSafe(F.col("__t"))).withColumn("__k", F.col("__at") - F.col("__first") + 1)
    return rows.drop("__s", "__t", "__h", "__at", "__first")


def stratified_split(df: DataFrame, key: str, label: str, test: float = 0.2) -> DataFrame:
    """Rows with ``part``: in each class the first ceil(test * n) in order of the key's md5 are test."""
    rows = _placed(df, key, F.col(label))
    return rows.withColumn("part", F.when(F.col("__k") <= F.ceil(F.col("__n") * test), "test").otherwise("train")).drop("__k", "__n")


def integer_encode(df: DataFrame, column: str, width: int, alphabet: str = "ACGT") -> DataFrame:
    """1-based codes of the letters, 0 for padding and unknown letters."""
    letters = F.slice(F.coalesce(S.letters(F.col(column)), F.array().cast("array<string>")), 1, width)
    codes = F.transform(letters, lambda x: F.instr(F.lit(alphabet), x))
    return df.withColumn("codes", F.slice(F.concat(codes, F.array_repeat(F.lit(0), width)), 1, width))


def one_hot(df: DataFrame, column: str, width: int, alphabet: str = "ACGT") -> DataFrame:
    """Flat 0/1 array, place times alphabet."""
    base = integer_encode(df, column, width, alphabet)
    hot = F.flatten(F.transform("codes", lambda c: F.transform(F.sequence(F.lit(1), F.lit(len(alphabet))), lambda k: (k == c).cast("int"))))
    return base.withColumn("one_hot", hot).drop("codes")


def drop_missing(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Rows without nulls, in the columns of ``subset`` if given."""
    return df.na.drop(subset=subset)


def impute_constant(df: DataFrame, columns: list[str], number: float = 0.0, text: str = "missing") -> DataFrame:
    """Numbers become ``number``, texts ``text``."""
    return df.na.fill(number, subset=columns).na.fill(text, subset=columns)


def auto_clean(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """Rows with a target and at least half of the features; medians and modes filled in; texts encoded by order."""
    kinds = dict(df.dtypes)
    least = -(-len(columns) // 2)
    some = df.where(F.col(target).isNotNull()).na.drop(thresh=least, subset=columns)
    numbers = [c for c in columns if kinds[c] != "string"]
    texts = [c for c in columns if kinds[c] == "string"]
    some = impute(some, numbers, "median") if numbers else some
    some = impute(some, texts, "mode") if texts else some
    for c in [*texts, *([target] if kinds[target] == "string" else [])]:
        some = label_encode(some, c).drop(c).withColumnRenamed("code", c)
    return some.select(*df.columns)


def polynomial_degree(df: DataFrame, columns: list[str], degree: int = 2) -> DataFrame:
    """All products of one to ``degree`` of the columns, as poly_a_b_..."""
    out = {}
    for k in range(1, degree + 1):
        for names in combinations_with_replacement(columns, k):
            value = F.col(names[0]).cast("double")
            for c in names[1:]:
                value = value * F.col(c).cast("double")
            out["poly_" + "_".join(names)] = value
    return df.withColumns(out)


def mutual_information(df: DataFrame, columns: list[str], label: str, bins: int = 10) -> DataFrame:
    """feature, score in nats between each column, in equal-width bins, and the label."""
    stats = df.agg(*[x for i, c in enumerate(columns) for x in (F.min(c).cast("double").alias(f"lo{i}"), F.max(c).cast("double").alias(f"hi{i}"))])
    rows = df.select(label, *columns).crossJoin(F.broadcast(stats))

    def bin_of(i: int, c: str):
        width = (F.col(f"hi{i}") - F.col(f"lo{i}")) / bins
        return F.when(width == 0, 0).otherwise(F.least(F.floor((F.col(c) - F.col(f"lo{i}")) / F.when(width != 0, width)), F.lit(bins - 1))).cast("int")

    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), bin_of(i, c).alias("x")) for i, c in enumerate(columns)])).alias("c")
    n = rows.select(F.col(label).alias("y"), cells).where("c.x is not null").groupBy("c.feature", "c.x", "y").agg(F.count("*").alias("n"))
    over = lambda *by: F.sum("n").over(Window.partitionBy("feature", *by))
    n = n.withColumns({"t": over(), "a": over("x"), "b": over("y")})
    return n.groupBy("feature").agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))).alias("score"))


def select_best(df: DataFrame, columns: list[str], label: str, k: int, how: str = "f_score", key: str | None = None) -> DataFrame:
    """``df`` with the k best of ``columns`` by F score, by mutual information in bins (``bins``) or by nearest neighbours
    (``neighbours``, over ``key``), and all other columns."""
    found = {
        "f_score": lambda: anova_f(df, columns, label).withColumnRenamed("f_score", "score"), "bins": lambda: mutual_information(df, columns, label),
        "neighbours": lambda: information.mutual_information(df, key, columns, label).withColumnRenamed("information", "score"),
    }
    if how not in found or how == "neighbours" and key is None:
        raise ValueError(f"no way to select by {how}" if how not in found else "neighbours need a key")
    scores = found[how]()
    best = [r["feature"] for r in scores.orderBy(F.desc("score"), "feature").limit(k).collect()]
    return df.select(*[c for c in df.columns if c not in columns or c in best])


#: Rows under which a table is small.
SMALL = 20


def three_way_split(df: DataFrame, key: str, label: str, test: float = 0.2, validation: float = 0.1) -> DataFrame:
    """Rows with ``part``: in each class, in order of the key's md5, test first, then the share of the rest that makes ``validation``, then train.

    With a class of one row classes are not kept apart at all; where a class has less than two rows after the test part, validation rows are
    drawn from all. Tables of under SMALL rows have a test part of two rows and a validation part of one, within a tenth to a fifth and a
    twentieth to a tenth of the rows.
    """
    total, least = df.groupBy(label).count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.min("count")).first()
    if 0 < total < SMALL:
        test, validation = min(0.2, max(0.1, 2 / total)), min(0.1, max(0.05, 1 / total))
    apart = (least or 0) >= 2
    strata = F.col(label) if apart else F.lit("all")
    share = validation / (1 - test)
    rows = _placed(df, key, strata)
    tested = F.col("__k") <= F.ceil(F.col("__n") * test)
    more = F.ceil((F.col("__n") - F.ceil(F.col("__n") * test)) * share)
    if apart and least - ceil(least * test) < 2:
        first, rest = rows.where(tested).drop("__k", "__n"), _placed(rows.where(~tested).drop("__k", "__n"), key, F.lit("all"))
        chosen = F.when(F.col("__k") <= F.ceil(F.col("__n") * share), "validation").otherwise("train")
        return first.withColumn("part", F.lit("test")).unionByName(rest.withColumn("part", chosen).drop("__k", "__n"))
    part = F.when(tested, "test").when(F.col("__k") <= F.ceil(F.col("__n") * test) + more, "validation").otherwise("train")
    return rows.withColumn("part", part).drop("__k", "__n")


#: Steps by the names that a pipeline's configuration uses.
STEPS = {
    "handle_missing_values": impute, "feature_scaling": scale, "outlier_removal": remove_outliers_iqr, "log_transform": log_transform,
    "interaction_features": interactions, "polynomial_features": polynomial_degree, "drop_missing": drop_missing,
}


def run_steps(df: DataFrame, steps: list[tuple[str, dict]]) -> DataFrame:
    """The named steps in order; an unknown name raises an error."""
    for name, options in steps:
        if name not in STEPS:
            raise ValueError(f"unknown step {name}")
        df = df.transform(STEPS[name], **options)
    return df


def run_batch(tables: dict[str, DataFrame], steps: list[tuple[str, dict]]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """The steps over several tables: what they give by name, and the errors of the tables that they do not fit."""
    done, failed = {}, {}
    for name, df in tables.items():
        try:
            done[name] = run_steps(df, steps)
        except Exception as e:  # what a table lacks is its result
            failed[name] = str(e).splitlines()[0]
    return done, failed
