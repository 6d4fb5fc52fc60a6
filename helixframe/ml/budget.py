"""Model candidates under a time budget: each runs in a job group of its own, which is cancelled at the deadline."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from queue import Empty, Queue

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "run string, name string, status string, score double, seconds double, error string"


@dataclass
class Outcome:
    """What became of a candidate: ``done``, ``failed``, ``cancelled`` (it had begun) or ``not started``."""

    run: str
    name: str
    status: str = "not started"
    score: float | None = None
    seconds: float = 0.0
    error: str | None = None


def race(spark: SparkSession, candidates: dict[str, Callable[[], float]], seconds: float, parallel: int = 2, record: str | None = None) -> DataFrame:
    """run, name, status, score, seconds, error, rank of every candidate, a function that fits and gives its score (higher is better).

    ``parallel`` candidates run at once, in the order given, for ``seconds`` together. At the deadline the jobs of those
    that still run are cancelled, until none of their threads is left, and the rest are not started. Finished ones are ranked by
    score, then by name; a failure is told and stops no other. ``record`` names a Parquet table to which the outcomes are added.
    """
    sc, run = spark.sparkContext, uuid.uuid4().hex
    outcomes = {name: Outcome(run, name) for name in candidates}
    waiting: Queue = Queue()
    for name in candidates:
        waiting.put(name)
    end, groups = time.monotonic() + seconds, {}

    def work() -> None:
        while time.monotonic() < end:
            try:
                name = waiting.get_nowait()
            except Empty:
                return
            out, began = outcomes[name], time.monotonic()
            groups[name] = group = f"{run}-{name}"
            sc.setJobGroup(group, f"candidate {name}", True)
            out.status = "cancelled"
            try:
                score = float(candidates[name]())
                if time.monotonic() < end:
                    out.status, out.score = "done", score
            except Exception as e:
                if time.monotonic() < end:
                    out.status, out.error = "failed", f"{type(e).__name__}: {str(e)[:200]}"
            out.seconds = time.monotonic() - began

    threads = [InheritableThread(target=work, daemon=True) for _ in range(parallel)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(max(0.0, end - time.monotonic()))
    while any(t.is_alive() for t in threads):  # a candidate may be between two jobs
        for group in groups.values():
            sc.cancelJobGroup(group)
        time.sleep(0.1)
    rows = spark.createDataFrame([tuple(asdict(o).values()) for o in outcomes.values()], SCHEMA)
    if record:
        rows.write.mode("append").parquet(record)
    rank = F.row_number().over(Window.partitionBy(F.col("status") == "done").orderBy(F.desc("score"), "name"))
    return rows.withColumn("rank", F.when(F.col("status") == "done", rank))


def best_model(rows: DataFrame, names: list[str], seconds: float, classes: int = 2, parallel: int = 2, record: str | None = None) -> tuple[object, DataFrame]:
    """The fitted pipeline with the highest held-out accuracy within the budget (None if none is done), and all outcomes."""
    from helixframe.ml import training

    fitted: dict = {}

    def candidate(name: str) -> Callable[[], float]:
        def fit() -> float:
            model, scores = training.train(rows, name, classes)
            fitted[name] = model
            return scores.first()["accuracy"]

        return fit

    told = race(rows.sparkSession, {n: candidate(n) for n in names}, seconds, parallel, record)
    first = told.where("rank = 1").first()
    return fitted[first["name"]] if first else None, told
