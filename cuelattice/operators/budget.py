"""Grouping of intervals under a length budget, and calibration of weights."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def grouped(segments: DataFrame, gap_ms: int, most_ms: int) -> DataFrame:
    """(job_id, part, place, start_ms, end_ms, n): neighbouring segments joined while no gap is longer than gap_ms and the whole not longer than most_ms.

    A long gap resets the state, so windows cut jobs into parts there, and the greedy budget is a fold over one part's few segments."""
    w = W.partitionBy("job_id").orderBy("start_ms", "end_ms")
    new = F.coalesce(F.col("start_ms") - F.lag("end_ms").over(w) > gap_ms, F.lit(False)).cast("int")
    parts = segments.select("job_id", "start_ms", "end_ms", new.alias("new_")).withColumn("part", F.sum("new_").over(w.rowsBetween(W.unboundedPreceding, 0)))
    listed = parts.groupBy("job_id", "part").agg(F.sort_array(F.collect_list(F.struct("start_ms", "end_ms"))).alias("s"))
    group = lambda s, e, n: F.struct(s.alias("start_ms"), e.alias("end_ms"), n.alias("n"))

    def add(a, x):
        last = F.element_at(a, -1)
        fits = (F.size(a) > 0) & (x["end_ms"] - last["start_ms"] <= most_ms)
        longer = F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(group(last["start_ms"], F.greatest(last["end_ms"], x["end_ms"]), last["n"] + 1)))
        return F.when(fits, longer).otherwise(F.concat(a, F.array(group(x["start_ms"], x["end_ms"], F.lit(1)))))

    none = F.array().cast("array<struct<start_ms:bigint,end_ms:bigint,n:int>>")
    out = listed.select("job_id", "part", F.posexplode(F.aggregate("s", none, lambda a, x: F.when(F.size(a) == 0, F.array(group(x["start_ms"], x["end_ms"], F.lit(1)))).otherwise(add(a, x)))).alias("place", "g"))
    return out.select("job_id", "part", "place", "g.start_ms", "g.end_ms", "g.n")


def _newton_sums(w: np.ndarray, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows, gradient and Hessian of a task's examples (features, label) at weights w, the last of which is the bias. A row with a null feature counts in the rows only, one with a null label in the Hessian, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + k + k * k)
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]] + [np.ones(batch.num_rows)])
            y = batch.column(k - 1).to_numpy(zero_copy_only=False)
            whole = ~np.isnan(x).any(axis=1)
            x, y = x[whole], y[whole]
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            total += np.concatenate([[batch.num_rows], np.where(np.isnan(y), 0.0, p - y) @ x, ((p * (1 - p))[:, None] * x).T.dot(x).ravel()])
        if total[0]:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["s"])

    return run


def calibrated(examples: DataFrame, features: list[str], label: str, prior: list[float], bias: float, pull: float = 1.0, steps: int = 12, pull_each: float = 0.0) -> DataFrame:
    """(feature, weight) of a logistic model, L2-pulled towards prior weights by pull and by pull_each a row; the bias is free. Newton's method: each step is one pass over all
    examples, of which each task sums up gradient and Hessian, so only (features + 1) squared numbers a task reach the driver."""
    spark, k = examples.sparkSession, len(features) + 1
    names = [*features, None]
    start = w = np.array([*prior, bias], float)
    data = examples.select(*[F.col(n).cast("double") for n in [*features, label]]).cache()
    for _ in range(steps):
        rows = [r.s for r in data.mapInArrow(_newton_sums(w, k), "s array<double>").collect()]
        got = np.array([math.fsum(v) for v in zip(*rows, strict=True)]) if rows else np.zeros(1 + k + k * k)
        ridge = np.array([pull + pull_each * got[0]] * len(features) + [0.0])
        hessian = got[1 + k :].reshape(k, k) + np.diag(ridge + 1e-9)
        step = np.linalg.solve(hessian, got[1 : 1 + k] + ridge * (w - start))
        w = w - np.clip(step, -2, 2)
        if abs(step).max() < 1e-9:
            break
    data.unpersist()
    return spark.createDataFrame([(n or "bias", round(float(c), 6)) for n, c in zip(names, w, strict=True)], "feature string, weight double")
