"""Nearest neighbours of a stated set of queries, filling by neighbours, and density clusters on a grid."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.storage import stored

#: Rows of a block that a task compares with all queries of a block at once.
BLOCK = 4096
#: Numbers of a difference of blocks that are held at once, and pivots of the pruned search.
CELLS, PIVOTS = 1 << 20, 256


def nearest(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(q, id, d): the k rows (id, vector) nearest to each query (q, qv) by Euclidean distance, ids on ties, itself left out.

    Missing components (null or NaN) are left out of a distance, which is scaled up for them. Rows and
    queries are dealt in blocks; each pair of blocks gives k rows a query, so pairs are never shuffled.
    """
    counts = rows.agg(F.count("*").alias("n")).crossJoin(queries.agg(F.count("*").alias("m"))).first()
    row_blocks, query_blocks = (max(1, -(-counts[c] // BLOCK)) for c in ("n", "m"))
    deal = lambda key, blocks: F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    vector = lambda c: F.col(c).cast("array<double>").alias("v")
    left = rows.select(deal("id", row_blocks).alias("i"), every(query_blocks).alias("j"), F.col("id").cast("long").alias("key"), vector("vector"), F.lit(0).alias("asks"))
    right = queries.select(every(row_blocks).alias("i"), deal("q", query_blocks).alias("j"), F.col("q").cast("long").alias("key"), vector("qv"), F.lit(1).alias("asks"))

    found = left.unionByName(right).groupBy("i", "j").applyInPandas(lambda g: _best(g, k), "q long, id long, d double")
    return _first(found, k)


def _first(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))
    return found.withColumn("__k", rank).where(F.col("__k") <= k).drop("__k")


def _best(group: pd.DataFrame, k: int) -> pd.DataFrame:
    """q, id, d: the k best rows (key, v, asks 0) of a block for each of its queries (asks 1), by so many queries at once as CELLS allow."""
    sides = [group[group["asks"] == a] for a in (0, 1)]
    if sides[0].empty or sides[1].empty:
        return pd.DataFrame({"q": [], "id": [], "d": []}).astype({"q": "int64", "id": "int64", "d": "float64"})
    keys, x = zip(*[(s["key"].to_numpy(np.int64), np.array(s["v"].tolist(), np.float64).reshape(len(s), -1)) for s in sides])
    if all(np.isfinite(v).all() for v in x):
        return _best_complete(keys, x, k)
    out = []
    step = max(1, CELLS // max(1, x[0].size))
    for at in range(0, len(x[1]), step):
        part, qk = x[1][at : at + step], keys[1][at : at + step]
        gap = part[:, None, :] - x[0][None, :, :]
        both = ~np.isnan(gap)
        seen = both.sum(2)
        d = np.sqrt(np.where(both, gap * gap, 0).sum(2) * gap.shape[2] / np.maximum(seen, 1))
        d[(seen == 0) | (qk[:, None] == keys[0][None, :])] = np.inf
        order = np.lexsort((np.broadcast_to(keys[0], d.shape), d), axis=1)[:, :k]
        q = np.repeat(qk, order.shape[1])
        best = pd.DataFrame({"q": q, "id": keys[0][order].ravel(), "d": np.take_along_axis(d, order, 1).ravel()})
        out.append(best[np.isfinite(best["d"])])
    return pd.concat(out)


def _best_complete(keys: tuple[np.ndarray, np.ndarray], x: tuple[np.ndarray, np.ndarray], k: int) -> pd.DataFrame:
    """``_best`` of rows and queries with all components. A product of matrices gives all distances but for rounding; the rows that
    may be among the k best by it, with a bound of its rounding, are compared exactly."""
    out, width = [], max(1, x[0].shape[1])
    squares = [np.einsum("ij,ij->i", v, v) for v in x]
    most = squares[0].max()
    step, many = max(1, CELLS // len(x[0])), min(k, len(x[0]))
    for at in range(0, len(x[1]), step):
        part, qk, own = x[1][at : at + step], keys[1][at : at + step], squares[1][at : at + step]
        about = own[:, None] + squares[0][None, :]
        about -= 2 * (part @ x[0].T)
        about[qk[:, None] == keys[0][None, :]] = np.inf
        bound = np.partition(about, many - 1, 1)[:, many - 1] + 16 * (width + 4) * np.finfo(float).eps * (own + most)
        # With a bound that is no number, as squares pass the largest one, every row is compared.
        near = ~(about > bound[:, None]) & (qk[:, None] != keys[0][None, :])
        i, j = np.nonzero(near)
        d = np.empty(len(i))
        for to in range(0, len(i), piece := max(1, CELLS // width)):
            gap = part[i[to : to + piece]] - x[0][j[to : to + piece]]
            d[to : to + piece] = np.sqrt((gap * gap).sum(1))
        order = np.lexsort((keys[0][j], d, i))
        i, j, d = i[order], j[order], d[order]
        first = np.searchsorted(i, i)
        kept = (np.arange(len(i)) - first < k) & np.isfinite(d)
        out.append(pd.DataFrame({"q": qk[i[kept]], "id": keys[0][j[kept]], "d": d[kept]}))
    return pd.concat(out)


def nearest_pruned(rows: DataFrame, queries: DataFrame, k: int, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """What ``nearest`` gives, and a row with the pairs ``compared`` and ``all`` pairs.

    Every row goes to the nearest of at most ``pivots`` rows drawn by a hash of the id; a cell knows its rows' least and largest distance to
    its pivot. A query first looks through the nearest cells that hold k rows. Its k-th distance then bounds, by the
    triangle inequality, which other cells can hold a nearer row; only those are looked through. Rows and queries must have all components, of
    one length; where some are missing all pairs are compared. An empty table gives no rows.
    """
    complete = lambda df, v: df.where(F.col(v).isNull() | F.exists(F.col(v), lambda c: c.isNull() | F.isnan(c.cast("double")))).isEmpty()
    drawn = [np.array(r["vector"], float) for r in rows.orderBy(F.xxhash64("id"), "id").limit(pivots).select("vector").collect() if r["vector"] is not None]
    if not drawn or not (complete(rows, "vector") and complete(queries, "qv")):
        found = nearest(rows, queries, k)
        return found, rows.agg(F.count("*").alias("n")).crossJoin(queries.agg(F.count("*").alias("m"))).select((F.col("n") * F.col("m")).alias("compared"), (F.col("n") * F.col("m")).alias("all"))
    centre = np.stack(drawn)

    def distances(v: pd.Series) -> np.ndarray:
        x = np.stack(v.tolist()).astype(float)
        return np.concatenate([np.sqrt(((x[at : at + 64, None] - centre[None]) ** 2).sum(2)) for at in range(0, len(x), 64)])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                d = distances(batch["v"])
                yield batch.assign(cell=d.argmin(1), r=d.min(1))

    own = rows.select(F.col("id").cast("long").alias("key"), F.col("vector").cast("array<double>").alias("v"))
    placed = stored(own.mapInPandas(place, "key long, v array<double>, cell long, r double"))
    cells = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).collect()}
    used = np.array(sorted(cells))
    n, low, high = (np.array([cells[c][name] for c in used]) for name in ("n", "low", "high"))

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The cells that a query looks through: at first those nearest that hold k rows besides itself, then those that may hold nearer ones."""
        for batch in batches:
            if not len(batch):
                continue
            d = distances(batch["v"])[:, used]
            order = np.argsort(d, 1)
            many = np.cumsum(n[order], 1)
            first = np.zeros(d.shape, bool)
            np.put_along_axis(first, order, np.c_[np.zeros(len(d), int), many[:, :-1]] < k + 1, 1)
            if "bound" in batch:
                # A little slack, so that rounding hides no row at the bound itself.
                bound = batch["bound"].to_numpy()[:, None] * (1 + 1e-9) + 1e-12
                first = ~first & (d - high <= bound) & (low - d <= bound)
            yield pd.DataFrame({"key": batch["key"], "v": batch["v"], "cell": [used[f] for f in first]})

    asked = stored(queries.select(F.col("q").cast("long").alias("key"), F.col("qv").cast("array<double>").alias("v")))
    parts = max(1, -(-asked.count() // BLOCK))
    of = F.create_map(*[F.lit(int(x)) for c in used for x in (c, -(-cells[c]["n"] // BLOCK))])
    deal = lambda of_: F.pmod(F.xxhash64("key"), of_).cast("int")
    left = placed.select("cell", deal(of[F.col("cell").cast("int")]).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("j"), "key", "v", F.lit(0).alias("asks"))

    def look(given: DataFrame) -> tuple[DataFrame, DataFrame]:
        seen = stored(given.mapInPandas(visits, "key long, v array<double>, cell array<long>").select("key", "v", F.explode("cell").alias("cell")))
        blocks = F.explode(F.sequence(F.lit(0), of[F.col("cell").cast("int")] - 1))
        right = seen.select("cell", blocks.alias("i"), deal(F.lit(parts)).alias("j"), "key", "v", F.lit(1).alias("asks"))
        found = left.join(right.select("cell", "j").distinct(), ["cell", "j"], "left_semi").unionByName(right)
        return stored(found.groupBy("cell", "i", "j").applyInPandas(lambda g: _best(g, k), "q long, id long, d double")), seen

    near, seen = look(asked)
    bound = _first(near, k).groupBy("q").agg(F.when(F.count("*") >= k, F.max("d")).otherwise(F.lit(float("inf"))).alias("bound"))
    more, also = look(asked.join(bound.withColumnRenamed("q", "key"), "key", "left").fillna(float("inf"), ["bound"]))
    size = F.create_map(*[F.lit(int(x)) for c in used for x in (c, cells[c]["n"])])
    compared = seen.unionByName(also).agg(F.coalesce(F.sum(size[F.col("cell").cast("int")]), F.lit(0)).alias("compared"))
    total = asked.agg((F.count("*") * int(n.sum())).alias("all"))
    return _first(near.unionByName(more), k), compared.crossJoin(total)


def impute_nearest(df: DataFrame, key: str, column: str, features: list[str], k: int = 5) -> DataFrame:
    """Missing values of ``column`` become the mean of the k nearest rows that have one, by the other features; lower keys on ties.

    Rows of equal features are at equal distances: of those with a value only the k lowest keys can be among the nearest, and those
    without one get the same mean. So the search runs over different features alone, through cells where all components are there.
    """
    numbers = [F.nanvl(F.col(c).cast("double"), F.lit(None)) + F.lit(0.0) for c in features]
    rows = df.select(F.col(key).cast("long").alias("id"), F.array(*numbers).alias("vector"), F.col(column).cast("double").alias("value"))
    first = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    known = stored(rows.where(F.col("value").isNotNull()).withColumn("__k", first).where(F.col("__k") <= k).drop("__k"))
    asked = stored(rows.where(F.col("value").isNull()).groupBy("vector").agg(F.min("id").alias("q")))
    found = nearest_pruned(known.select("id", "vector"), asked.select("q", F.col("vector").alias("qv")), k)[0]
    mean = found.join(known.select("id", "value"), "id").groupBy("q").agg(F.avg("value").alias("__mean"))
    mean = asked.join(mean, "q").select(F.col("vector").alias("__vector"), "__mean")
    missing = df.where(F.col(column).isNull()).withColumn("__v", F.array(*numbers))
    filled = missing.join(mean, F.col("__v").eqNullSafe(F.col("__vector")), "left").withColumn(column, F.col("__mean"))
    return df.where(F.col(column).isNotNull()).withColumn(column, F.col(column).cast("double")).select(*df.columns).unionByName(filled.select(*df.columns))


def min_labels(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node reachable over undirected edges; labels halve their distance each round."""
    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    both = stored(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = label.join(near, "node").select("node", F.least("label", "near").alias("label"))
        new = stored(low.alias("x").join(low.alias("y"), F.col("x.label") == F.col("y.node")).select("x.node", F.least("x.label", "y.label").alias("label")))
        if new.join(label.withColumnRenamed("label", "old"), "node").where("label <> old").isEmpty():
            return new
        label = new


#: Products of the rows of two parts of cells up to which their rows are compared; halvings of a cell's side before they all are.
COMPARED, HALVINGS = 4096, 40


def dbscan(df: DataFrame, key: str, columns: list[str], eps: float, least: int) -> DataFrame:
    """key, cluster: the smallest key of the cluster's core rows, null for noise; a border row takes its smallest cluster.

    Rows lie in cells of a grid so small that all rows of a cell are within ``eps`` of each other. A cell of ``least`` rows is
    core as a whole, and the core rows of a cell are of one cluster, so no pairs within a cell are looked at. Only rows of
    smaller cells are compared with the cells around them, and two cells are linked if any two of their core rows are near. Rows with
    null or NaN values are noise; the key must be unique. For a few columns, as a cell has (2 sqrt(columns) + 1)^columns around it.
    """
    dims = range(len(columns))
    x, y = [f"x{i}" for i in dims], [f"y{i}" for i in dims]
    side = eps / len(columns) ** 0.5 * (1 - 1e-9)
    rows = df.select(F.col(key).alias("id"), *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(f"x{i}") for i, c in enumerate(columns)]).na.drop()
    rows = stored(rows.withColumn("cell", F.array(*[F.floor(F.col(c) / side).cast("long") for c in x])))
    gap = lambda a, b: F.sqrt(reduce(lambda p, q: p + q, [(F.col(i) - F.col(j)) * (F.col(i) - F.col(j)) for i, j in zip(a, b)]))

    cells = stored(rows.groupBy("cell").agg(F.count("*").alias("n")))
    reach = range(-int(len(columns) ** 0.5) - 1, int(len(columns) ** 0.5) + 2)
    steps = [s for s in product(reach, repeat=len(columns)) if sum(max(abs(v) - 1, 0) ** 2 for v in s) * side * side <= eps * eps]
    around = cells.select(F.col("cell").alias("a"), F.explode(F.array(*[F.array(*[(F.col("cell")[i] + s[i]) for i in dims]) for s in steps])).alias("b"))
    around = stored(around.join(cells.select(F.col("cell").alias("b")), "b"))

    small = rows.join(cells.where(F.col("n") < least).select("cell"), "cell")
    other = lambda df, *more: df.select(F.col("cell").alias("b"), *[F.col(c).alias(d) for c, d in zip(x, y)], *more)
    seen = small.withColumnRenamed("cell", "a").join(around, "a").join(other(rows), "b").where(gap(x, y) <= eps)
    core = rows.join(cells.where(F.col("n") >= least).select("cell"), "cell", "left_semi").select("id").unionByName(
        seen.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("id")
    )
    core = stored(rows.join(core, "id"))
    first = stored(core.groupBy("cell").agg(F.min("id").alias("first")))
    pairs = around.where("a < b").join(first.select(F.col("cell").alias("a")), "a").join(first.select(F.col("cell").alias("b")), "b").select("a", "b")
    near = _near_cells(core.select("cell", *x).distinct(), pairs, eps, side, x)
    name = lambda c: first.select(F.col("cell").alias(c), F.col("first").alias(f"first_{c}"))
    edges = near.join(name("a"), "a").join(name("b"), "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    label = min_labels(edges.unionByName(first.select(F.col("first").alias("a"), F.col("first").alias("b"))))
    label = stored(first.join(label.withColumnRenamed("node", "first"), "first").select("cell", "label"))
    found = core.select("id", "cell").join(label, "cell").select("id", "label")
    rest = small.join(core.select("id"), "id", "left_anti").withColumnRenamed("cell", "a").join(around, "a")
    border = rest.join(label.withColumnRenamed("cell", "b"), "b").join(other(core), "b").where(gap(x, y) <= eps).groupBy("id").agg(F.min("label").alias("label"))
    found = found.unionByName(border)
    return df.select(F.col(key)).join(found.select(F.col("id").alias(key), F.col("label").alias("cluster")), key, "left")


def _near_cells(points: DataFrame, pairs: DataFrame, eps: float, side: float, x: list[str]) -> DataFrame:
    """The pairs (a, b) of cells that hold points (cell, x...; distinct) within ``eps`` of each other.

    Cells are halved again and again. Of two parts the boxes around their points tell that all of their points are near or that none
    are; what they leave open is compared if it is small, and else halved once more.
    """
    todo, out = pairs.select("a", "b", F.col("a").alias("pa"), F.col("b").alias("pb")), None
    for level in range(1, HALVINGS + 1):
        part = F.array(*[F.floor(F.col(c) / (side / 2**level)).cast("long") for c in x])
        placed = points.withColumn("part", part)
        boxes = placed.groupBy("cell", "part").agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c in x for k, f in (("lo", F.min), ("hi", F.max))])
        boxes = boxes.withColumn("whole", F.array(*[F.floor(F.col("part")[i] / 2).cast("long") for i in range(len(x))]) if level > 1 else F.col("cell"))
        pick = lambda s: boxes.select(F.col("cell").alias(s), F.col("whole").alias(f"p{s}"), F.col("part").alias(f"q{s}"), F.col("n").alias(f"n{s}"), *[F.col(f"{k}_{c}").alias(f"{k}_{c}{s}") for c in x for k in ("lo", "hi")])  # noqa: B023, E731
        met = todo.join(pick("a"), ["a", "pa"]).join(pick("b"), ["b", "pb"])
        square = lambda gaps: F.sqrt(reduce(lambda p, q: p + q, [g * g for g in gaps]))
        apart = square([F.greatest(F.col(f"lo_{c}a") - F.col(f"hi_{c}b"), F.col(f"lo_{c}b") - F.col(f"hi_{c}a"), F.lit(0.0)) for c in x])
        wide = square([F.greatest(F.abs(F.col(f"hi_{c}a") - F.col(f"lo_{c}b")), F.abs(F.col(f"hi_{c}b") - F.col(f"lo_{c}a"))) for c in x])
        met = stored(met.select("a", "b", "qa", "qb", (F.col("na") * F.col("nb")).alias("n"), (wide <= eps).alias("sure"), apart.alias("apart")).where(F.col("apart") <= eps))
        few = F.lit(True) if level == HALVINGS else F.col("n") <= COMPARED
        rows = lambda s, names: placed.select(F.col("cell").alias(s), F.col("part").alias(f"q{s}"), *[F.col(c).alias(n) for c, n in zip(x, names)])  # noqa: B023, E731
        ours, theirs = [f"{c}_a" for c in x], [f"{c}_b" for c in x]
        sure = met.where("sure").select("a", "b").distinct()
        open_ = met.join(sure, ["a", "b"], "left_anti")
        compared = open_.where(few).join(rows("a", ours), ["a", "qa"]).join(rows("b", theirs), ["b", "qb"]).where(square([F.col(i) - F.col(j) for i, j in zip(ours, theirs)]) <= eps)
        found = stored(sure.unionByName(compared.select("a", "b").distinct()))
        out = found if out is None else out.unionByName(found)
        todo = stored(open_.where(~few).join(found, ["a", "b"], "left_anti").select("a", "b", F.col("qa").alias("pa"), F.col("qb").alias("pb")))
        if todo.isEmpty():
            break
    return out.distinct()
