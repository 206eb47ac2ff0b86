"""Bootstrap of mixture weights: every replicate's counts beside each class, all replicates fitted in the same passes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixtide.functions.arrays import lists, matrix, sum_rows
from mixtide.plans.em import DIRECT, step_tasks
from mixtide.session import use_checkpoints

#: Classes are dealt to so many buckets by their content; the buckets' totals, and each replicate's share of them, pass through the driver.
BUCKETS = 1024
#: Classes of a bucket that are drawn together, from its first one on.
TOGETHER = 1024


def _draw(totals: dict[int, int], shares: np.ndarray, seed: int):
    """Rows sorted by bucket -> ll, draws: each bucket's share of a replicate is split over its rows, TOGETHER at a time."""
    place = {bucket: k for k, bucket in enumerate(sorted(totals))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket, rng, left, drawn = None, None, None, 0, None

        def part(rows: pa.Table) -> pa.RecordBatch:
            nonlocal left, drawn
            n = rows["n"].to_numpy().astype(np.int64)
            mine = rng.binomial(drawn, n.sum() / left)
            left, drawn = left - n.sum(), drawn - mine
            draws = rng.multinomial(mine, n / n.sum())
            return pa.RecordBatch.from_arrays([rows["ll"].combine_chunks(), lists(draws.T, pa.int64())], names=["ll", "draws"])

        for batch in batches:
            marks = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), len(marks)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if marks[a] != bucket:
                    if held is not None and held.num_rows:
                        yield part(held)
                    bucket, held = int(marks[a]), None
                    rng, left, drawn = np.random.default_rng([seed, bucket]), totals[bucket], shares[:, place[bucket]]
                piece = pa.Table.from_batches([batch.slice(a, b - a)])
                held = piece if held is None else pa.concat_tables([held, piece])
                while held.num_rows >= TOGETHER:
                    yield part(held.slice(0, TOGETHER))
                    held = held.slice(TOGETHER)
        if held is not None and held.num_rows:
            yield part(held)

    return run


def resample(classes: DataFrame, replicates: int, seed: int = 7) -> DataFrame:
    """(n, ll) classes -> ll, draws: each replicate's count of the class; a replicate's counts are multinomial and sum to N (BS1).

    A replicate is split over the buckets' totals, then inside each bucket over its classes in the order of their content, by
    conditional binomials: no task sees all classes, and draws depend on the classes and the seed, not on partitions. Classes
    of equal ll are added up first; counts of 0 take no part.
    """
    if replicates < 1:
        raise ValueError("replicates must be positive")
    own = classes.filter("n > 0").groupBy("ll").agg(F.sum("n").cast("long").alias("n")).withColumn("key", F.xxhash64("ll"))
    rows = own.withColumn("bucket", F.pmod("key", F.lit(BUCKETS)).cast("int"))
    use_checkpoints(classes.sparkSession)
    ranged = rows.repartition("bucket").sortWithinPartitions("bucket", "key", "ll").checkpoint()
    totals = {r["bucket"]: r["n"] for r in ranged.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # BUCKETS rows at most
    p = np.array([totals[b] for b in sorted(totals)], float)
    shares = np.random.default_rng([seed, BUCKETS]).multinomial(int(p.sum()), p / p.sum(), size=replicates) if totals else np.zeros((replicates, 0))
    return ranged.mapInArrow(_draw(totals, shares, seed), "ll array<double>, draws array<long>")


def _sums(weights: np.ndarray, active: np.ndarray):
    """A row per active replicate and partition: its expected counts of the origins, and its log-likelihood."""
    with np.errstate(divide="ignore"):
        logs = np.log(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(active), logs.shape[1] + 1))
        for batch in batches:
            ll, draws = matrix(batch.column("ll"), logs.shape[1], "ll"), matrix(batch.column("draws"), len(logs), "draws")
            for k, b in enumerate(active):
                some = draws[:, b] > 0
                x = ll[some] + logs[b]
                top = x.max(axis=1, keepdims=True, initial=-np.inf)
                p = np.exp(x - top)
                size = p.sum(axis=1)
                total[k, :-1] += (draws[some, b] / size) @ p
                total[k, -1] += draws[some, b] @ (top[:, 0] + np.log(size))
        yield pa.RecordBatch.from_arrays([pa.array(active, pa.int32()), lists(total)], names=["row", "vec"])

    return run


def _hard(n_origins: int):
    """A row per replicate and partition: the counts of the classes whose first likeliest origin it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                draws = matrix(batch.column("draws"), None, "draws")
                best = np.argmax(matrix(batch.column("ll"), n_origins, "ll"), axis=1)
                total = np.zeros((draws.shape[1], n_origins)) if total is None else total
                np.add.at(total.T, best, draws)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), lists(total)], names=["row", "vec"])

    return run


def bootstrap(
    classes: DataFrame,
    start: np.ndarray,
    replicates: int = 50,
    seed: int = 7,
    max_iter: int = 500,
    tol: float = 1e-8,
    estimator: str = "em",
) -> DataFrame:
    """(n, ll) classes -> replicate, origin, w, converged: refits of multinomial draws (BS1).

    em: from the point estimate start, until the likelihood moves by at most tol * (1 + its size) and no weight by more than tol;
    a replicate that does not get there in max_iter steps has null weights. hard: each class's draws go to its first
    likeliest origin; start gives the number of origins alone. Executors add up the replicates' sums, where they are not few.
    """
    if estimator not in ("em", "hard"):
        raise ValueError("the estimator must be em or hard")
    spark, k = classes.sparkSession, len(start)
    whole = resample(classes, replicates, seed).cache()
    tasks = step_tasks(whole, whole.count() * replicates * k)  # the count draws in all partitions, into the cache
    drawn, direct = whole.coalesce(tasks), tasks * replicates * (k + 1) <= DIRECT
    done = np.zeros(replicates, bool)
    if estimator == "hard":
        found = sum_rows(drawn.mapInArrow(_hard(k), "row int, vec array<double>"), direct)
        done[list(found)] = True
        w = np.array([found[b] / found[b].sum() if done[b] else np.zeros(k) for b in range(replicates)])
    else:
        # a weight of exactly 0 would stay 0 in every refit
        w = np.tile((np.asarray(start, float) + 1e-9) / (np.sum(start) + k * 1e-9), (replicates, 1))
        value = np.full(replicates, np.nan)
        for _ in range(max_iter + 1):
            active = np.flatnonzero(~done)
            found = sum_rows(drawn.mapInArrow(_sums(w, active), "row int, vec array<double>"), direct)
            if not any(found[b][:-1].sum() for b in found):
                break  # no rows
            for b in active:
                new, at = found[b][:-1] / found[b][:-1].sum(), found[b][-1]
                move, gain = np.abs(new - w[b]).max(), abs(at - value[b])
                done[b] = gain <= tol * (1 + abs(at)) and move <= max(tol, np.finfo(float).eps)
                w[b], value[b] = (w[b] if done[b] else new), at
            if done.all():
                break
    whole.unpersist()
    rows = [(b, o, float(w[b, o]) if done[b] else None, bool(done[b])) for b in range(replicates) for o in range(k)]
    return spark.createDataFrame(rows, "replicate int, origin int, w double, converged boolean")


def grouped(replicates: DataFrame, groups: list[list[int]]) -> DataFrame:
    """Replicates' weights summed by group, as (replicate, origin, w, converged) with the group's place as origin.

    Groups must be non-empty and share out the origins.
    """
    place = [(o, g) for g, members in enumerate(groups) for o in members]
    n = replicates.agg(F.max("origin").alias("n")).first()["n"]
    if not groups or not all(groups) or sorted(o for o, _ in place) != list(range((-1 if n is None else n) + 1)):
        raise ValueError("groups must be non-empty and share out the origins")
    of = replicates.sparkSession.createDataFrame(place, "origin int, g int")
    met = replicates.join(F.broadcast(of), "origin").groupBy("replicate", F.col("g").alias("origin"), "converged")
    return met.agg(F.sum("w").alias("w")).select("replicate", "origin", "w", "converged")


def estimands(replicates: DataFrame, kinds: DataFrame, features: DataFrame, active: list[int]) -> DataFrame:
    """(replicate, origin, w, converged) -> replicate, estimand, w, converged: what intervals are reported for (BS4).

    Totals of each kind (origin, kind), weights of the origins that have each feature (origin, feature, bit), and the weights
    of the active origins, which the caller takes from the point estimate.
    """
    key = ["replicate", "converged"]
    of_kind = replicates.join(F.broadcast(kinds), "origin").groupBy(*key, F.concat(F.lit("kind:"), F.col("kind").cast("string")).alias("estimand")).agg(F.sum("w").alias("w"))
    having = features.filter("bit = 1").select("origin", "feature")
    of_feature = replicates.join(F.broadcast(having), "origin").groupBy(*key, F.concat(F.lit("feature:"), F.col("feature").cast("string")).alias("estimand")).agg(F.sum("w").alias("w"))
    own = replicates.filter(F.col("origin").isin(active)).select(*key, F.concat(F.lit("origin:"), F.col("origin").cast("string")).alias("estimand"), "w")
    return of_kind.unionByName(of_feature).unionByName(own).select("replicate", "estimand", "w", "converged")


def intervals(replicates: DataFrame, level: float = 0.95, by: str = "origin") -> DataFrame:
    """(origin, w), or (estimand, w) by estimand -> low, median, high by linear interpolation, and how many replicates count (BS2)."""
    if not 0 < level < 1:
        raise ValueError("level must lie between 0 and 1")
    tail = (1 - level) / 2
    cut = [F.percentile("w", p).alias(name) for name, p in (("low", tail), ("median", 0.5), ("high", 1 - tail))]
    return replicates.filter("converged").groupBy(by).agg(*cut, F.count("*").alias("replicates"))
