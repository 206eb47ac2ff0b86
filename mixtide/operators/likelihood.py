"""Emission matrices and log-likelihoods of classes against every origin."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixtide.functions.arrays import lists, matrix
from mixtide.functions.math import bind, expit, logit
from mixtide.operators.classes import join_classes
from mixtide.session import use_checkpoints


def emissions(profiles: DataFrame, rates: DataFrame) -> DataFrame:
    """(origin, probe, bit), (probe, alpha, beta) -> origin, probe, q (PRJ1). rates has a row per probe and is broadcast.

    Bits other than 0 and 1 (FLT2), rates outside 0 .. 1 and probes without rates are errors.
    """
    known = F.col("alpha").between(0, 1) & F.col("beta").between(0, 1)
    q = F.when(F.col("bit") == 1, F.col("alpha")).when(F.col("bit") == 0, F.col("beta")).otherwise(F.raise_error(F.lit("bits must be 0 or 1")).cast("double"))
    checked = F.when(F.coalesce(known, F.lit(False)), q).otherwise(F.raise_error(F.lit("every probe needs rates between 0 and 1")).cast("double"))
    return profiles.join(F.broadcast(rates), "probe", "left").select("origin", "probe", checked.alias("q"))


def emission_matrix(profiles: list[list[int]], alpha: list[float] | float, beta: list[float] | float) -> list[list[float]]:
    """The K x J matrix q of binary profiles: alpha where a bit is 1, beta where it is 0; one rate, or one per probe (PRJ1)."""
    check_profiles(profiles)
    n = len(profiles[0])
    rates = [[float(x)] * n if isinstance(x, int | float) else [float(y) for y in x] for x in (alpha, beta)]
    if any(len(r) != n for r in rates):
        raise ValueError("alpha and beta must have one rate per probe")
    q = [[rates[1 - bit][j] for j, bit in enumerate(row)] for row in profiles]
    check_q(q)
    return q


def check_profiles(profiles: list[list[int]], n_probes: int | None = None) -> None:
    """Profiles are a non-empty matrix of bits (FLT2), of n_probes columns where given."""
    if not profiles or not profiles[0] or any(len(row) != (n_probes or len(profiles[0])) for row in profiles):
        raise ValueError("profiles must be a matrix of origins by probes")
    if any(bit not in (0, 1) for row in profiles for bit in row):
        raise ValueError("profiles must hold 0 and 1")


def calibrate(traces: DataFrame) -> DataFrame:
    """Share of positive calls of each known (origin, probe) (PRJ2)."""
    return traces.filter("call in (0, 1)").groupBy("origin", "probe").agg((F.sum("call") / F.count("*")).alias("q"))


def _scores(q: list[list[float]], columns: list[str], block: int = 1024):
    """Adds ll to batches: one matrix product per block of classes, with the logarithms of q and 1 - q."""
    p = np.asarray(q, dtype=float).T
    with np.errstate(divide="ignore"):
        yes, no = np.log(p), np.log1p(-p)
    never, always = np.isneginf(yes), np.isneginf(no)
    yes, no = np.where(never, 0.0, yes), np.where(always, 0.0, no)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, block):
                part = batch.slice(k, block)
                seen, hit = (matrix(part.column(c), len(p), c) for c in ("observed", "positive"))
                if (hit < 0).any() or (hit > seen).any() or (seen != np.floor(seen)).any() or (hit != np.floor(hit)).any():
                    raise ValueError("counts must be whole, with 0 <= positive <= observed")
                ll = hit @ yes + (seen - hit) @ no
                if never.any() or always.any():
                    ll[(hit > 0).astype(float) @ never + (seen > hit).astype(float) @ always > 0] = -np.inf
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), lists(ll)], names=[*columns, "ll"])

    return run


def check_q(q: list[list[float]]) -> None:
    """q is a K x J matrix of probabilities (PRJ1)."""
    if not q or not q[0] or any(len(row) != len(q[0]) for row in q):
        raise ValueError("q must be a matrix of origins by probes")
    if not all(0 <= p <= 1 for row in q for p in row):
        raise ValueError("q must hold probabilities")


def score(classes: DataFrame, q: list[list[float]]) -> DataFrame:
    """classes (observed, positive) with ll, the array over origins of sum(positive * ln q + negative * ln(1 - q)) (LL2, JN2).

    A count of 0 adds 0 also where the logarithm is -Infinity. q is K x J, which the model fixes; a column ll is replaced.
    Counts of another length than J, null ones and those outside 0 <= positive <= observed are errors.
    """
    check_q(q)
    plain = classes.drop("ll")
    schema = ", ".join([*(f"`{c}` {t}" for c, t in plain.dtypes), "ll array<double>"])
    return plain.mapInArrow(_scores(q, plain.columns), schema)


def score_traces(classes: DataFrame, q: list[list[float]]) -> DataFrame:
    """Classes (mask, trace) of one call per probe, with ll (LL1): seen once where the mask is 1, positive where the trace is."""
    return score(classes.withColumns({"observed": F.col("mask"), "positive": F.col("trace")}), q).drop("observed", "positive")


def score_observations(observations: DataFrame, q: list[list[float]], *key: str) -> DataFrame:
    """One row per observation with its class's ll: distinct classes are scored once and joined back (LL3, JN3).

    key: observed and positive, or mask and trace. The observations of one class may be a large share of all: see join_classes.
    """
    scorer = score_traces if key == ("mask", "trace") else score
    use_checkpoints(observations.sparkSession)
    classes = observations.groupBy(*key).agg(F.count("*").alias("n")).checkpoint()
    return join_classes(observations, scorer(classes, q), *key)


def mismatches(profiles: list[list[int]]) -> Column:
    """Array over origins of the observed calls that differ from a binary profile; missing is a wildcard (FLT6, FLT7)."""
    check_profiles(profiles)

    def one(row: list[int]) -> Column:
        return sum((F.col("observed")[j] - F.col("positive")[j] if bit else F.col("positive")[j] for j, bit in enumerate(row)), F.lit(0))

    return F.array(*[one(row) for row in profiles])


def best_compatible(classes: DataFrame, profiles: list[list[int]], most: int | None = None) -> DataFrame:
    """ll 0 for origins of fewest mismatches (or at most `most`), else -Infinity."""
    with_m = classes.withColumn("__m", mismatches(profiles))
    if most is not None:
        kept = F.array_min("__m") <= most
        with_m = with_m.withColumn("__m", F.when(kept, F.col("__m")).otherwise(F.raise_error(F.lit("a class has no compatible origin")).cast("array<int>")))
    limit = F.array_min("__m") if most is None else F.lit(most)
    return with_m.withColumn("ll", F.transform("__m", lambda m: F.when(m <= limit, F.lit(0.0)).otherwise(F.lit("-Infinity").cast("double")))).drop("__m")


def ratio_compatible(ll: Column, threshold: float) -> Column:
    """Origins whose likelihood is at least threshold times the best one's; 0 keeps all finite ones (FLT8)."""
    finite = lambda x: x > F.lit("-Infinity").cast("double")
    if threshold == 0:
        return F.transform(ll, finite)
    return bind(F.array_max(ll), lambda top: F.transform(ll, lambda x: finite(x) & (x - top >= F.ln(F.lit(threshold)))))


def condition_on_gate(ll: Column, visibility: list[float]) -> Column:
    """ll - ln v (YD5)."""
    return F.zip_with(ll, F.array(*[F.ln(F.lit(v)) for v in visibility]), lambda x, v: x - v)


def perturb(emissions: DataFrame, shift: float, scale: float, noise: Column, low: float = 1e-6) -> DataFrame:
    """(origin, probe, q): q moved by shift + scale * noise in logits, kept in [low, 1 - low] (PRJ3)."""
    moved = expit(logit(F.col("q")) + F.lit(shift) + F.lit(scale) * noise)
    return emissions.withColumn("q", F.greatest(F.lit(low), F.least(F.lit(1 - low), moved)))


def overlaps(emissions: DataFrame) -> DataFrame:
    """(origin, probe, q) -> a, b, hellinger of every two origins' product distributions (MT16); origins are few."""
    one, two = emissions.select("probe", F.col("origin").alias("a"), F.col("q").alias("p")), emissions.select("probe", F.col("origin").alias("b"), F.col("q").alias("r"))
    alike = F.product(F.sqrt(F.col("p") * F.col("r")) + F.sqrt((1 - F.col("p")) * (1 - F.col("r"))))
    return one.join(two, "probe").filter("a < b").groupBy("a", "b").agg(F.sqrt(F.greatest(F.lit(0.0), 1 - alike)).alias("hellinger"))


def tolerant_groups(rows: list[list[float]], atol: float, rtol: float = 0.0) -> list[list[int]]:
    """Origins in order, each to the first group whose first member is within atol + rtol * |member| everywhere (AGG14)."""
    groups: list[list[int]] = []
    for k, row in enumerate(rows):
        for g in groups:
            if all(abs(x - y) <= atol + rtol * abs(y) for x, y in zip(row, rows[g[0]], strict=True)):
                g.append(k)
                break
        else:
            groups.append([k])
    return groups


def shrink_contrast(rates: DataFrame, probe: int, share: float) -> DataFrame:
    """(probe, alpha, beta) with one probe's rates moved towards their mean; share of the contrast stays (PRJ4)."""
    mean, half = (F.col("alpha") + F.col("beta")) / 2, (F.col("alpha") - F.col("beta")) / 2 * share
    here = F.col("probe") == probe
    return rates.withColumns({"alpha": F.when(here, mean + half).otherwise(F.col("alpha")), "beta": F.when(here, mean - half).otherwise(F.col("beta"))})


def missing_as_zero(traces: DataFrame) -> DataFrame:
    """Missing calls read as negative ones (PRJ7), a mistake that comparisons measure."""
    return traces.withColumn("call", F.when(F.coalesce("call", F.lit(-1)) == -1, 0).otherwise(F.col("call")))


def _evidence(yes: np.ndarray, no: np.ndarray, cells: int = 1 << 22):
    """Molecules with their calls in order of cycle -> a row per (molecule, cycle) with the posteriors after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("calls").value_lengths().to_numpy(zero_copy_only=False)
            k = 0
            while k < batch.num_rows:  # so many molecules that their cells times origins stay bounded
                stop = k + max(1, int(np.searchsorted(np.cumsum(sizes[k:]) * yes.shape[1], cells, side="right")))
                part = batch.slice(k, stop - k)
                calls, size = part.column("calls").flatten(), sizes[k:stop]
                cycle, probe, call = (calls.field(c).to_numpy(zero_copy_only=False) for c in ("cycle", "probe", "call"))
                owner = np.repeat(np.arange(len(size)), size)
                ll = np.where((call == 1)[:, None], yes[probe], np.where((call == 0)[:, None], no[probe], 0.0))
                new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (cycle[1:] != cycle[:-1])])
                first = np.flatnonzero(new)
                each, of = np.add.reduceat(ll, first, axis=0), owner[first]
                upto = np.concatenate([np.cumsum(x, axis=0) for x in np.split(each, np.flatnonzero(np.diff(of)) + 1)])
                p = np.exp(upto - upto.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([part.column("molecule").take(pa.array(of)), pa.array(cycle[first]), lists(p)], names=["molecule", "cycle", "posterior"])
                k = stop

    return run


def cumulative_posteriors(cells: DataFrame, q: list[list[float]], low: float = 1e-12) -> DataFrame:
    """(molecule, cycle, probe, call) -> molecule, cycle, posterior: an array over origins after each cycle, from a flat prior (MT20).

    Several calls of one cycle count together; missing calls and those of probes outside q add nothing. A molecule's calls
    meet in one shuffle, their scores run on in one pass; q is kept inside [low, 1 - low].
    """
    check_q(q)
    p = np.asarray(q, dtype=float).T
    yes, no = np.log(np.clip(p, low, 1 - low)), np.log(np.clip(1 - p, low, 1 - low))
    known = F.col("probe").between(0, len(p) - 1) & F.coalesce(F.col("call").isin(0, 1), F.lit(False))
    call = F.when(known, F.col("call")).otherwise(-1).cast("int").alias("call")
    rows = cells.select("molecule", F.col("cycle").cast("long").alias("cycle"), F.when(known, F.col("probe")).otherwise(0).cast("int").alias("probe"), call)
    by_molecule = rows.groupBy("molecule").agg(F.array_sort(F.collect_list(F.struct("cycle", "probe", "call"))).alias("calls"))
    kind = dict(cells.dtypes)["molecule"]
    return by_molecule.mapInArrow(_evidence(yes, no), f"molecule {kind}, cycle bigint, posterior array<double>")
