"""Reductions of traces to classes: every later step works on distinct classes with counts.

Long traces are (molecule, probe, call) with call 1, 0 or -1; null and -1 are missing. All reductions are hash
aggregations with partial sums; nothing is numbered over molecules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: A class of over 1 / HEAVY of all molecules is joined by broadcast: there are fewer than HEAVY of them.
HEAVY = 1000
#: Rows that meet in a task, on average, where those of a molecule do.
TOGETHER = 500_000


def meet(rows: DataFrame) -> DataFrame:
    """rows dealt by molecule over so many tasks that each gets about TOGETHER of them, one for each core at least.

    What a join or a grouping by molecule then holds in a task does not grow with the rows, and neither moves them again.
    The rows are counted first.
    """
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / TOGETHER))
    return rows.repartition(tasks, "molecule")


def invalid_calls(traces: DataFrame) -> DataFrame:
    """Rows outside the domain of calls (FLT1)."""
    return traces.filter(F.col("call").isNotNull() & ~F.col("call").isin(-1, 0, 1))


def probe_counts(traces: DataFrame, n_probes: int, *more: Column) -> DataFrame:
    """(molecule, probe, call) -> molecule, observed, positive: counts per logical probe (AGG3, first half), with more aggregates.

    Calls other than -1, 0, 1 and null (FLT1) and probes outside 0 .. n_probes - 1 or null (FLT3) are errors.
    """
    seen = lambda j: F.sum(F.when((F.col("probe") == j) & F.col("call").isin(0, 1), 1).otherwise(0)).cast("int")
    hit = lambda j: F.sum(F.when((F.col("probe") == j) & (F.col("call") == 1), 1).otherwise(0)).cast("int")
    call = F.when(F.coalesce(F.col("call"), F.lit(-1)).isin(-1, 0, 1), F.col("call")).otherwise(F.raise_error(F.lit("calls must be -1, 0 or 1")).cast("int"))
    probe = F.when(F.col("probe").between(0, n_probes - 1), F.col("probe")).otherwise(F.raise_error(F.lit("a probe is outside the schedule")).cast("int"))
    checked = traces.withColumns({"call": call, "probe": probe})
    return checked.groupBy("molecule").agg(F.array(*[seen(j) for j in range(n_probes)]).alias("observed"), F.array(*[hit(j) for j in range(n_probes)]).alias("positive"), *more)


def whole_count(n: Column) -> Column:
    """n, where it is a whole number of at least 0; anything else is an error (FLT4)."""
    good = F.coalesce((n >= 0) & (n == F.floor(n)), F.lit(False))
    return F.when(good, n).otherwise(F.raise_error(F.lit("counts must be finite non-negative integers")).cast("long"))


def count_classes(counts: DataFrame, weight: Column | None = None) -> DataFrame:
    """Distinct (observed, positive) with n (AGG3, second half). Rows of weight 0 are dropped first (FLT5)."""
    weighed = counts.withColumn("__n", whole_count(weight) if weight is not None else F.lit(1))
    return weighed.filter("__n > 0").groupBy("observed", "positive").agg(F.sum("__n").cast("long").alias("n"))


def check_counts(classes: DataFrame, n_probes: int) -> DataFrame:
    """classes (observed, positive, n) as they are; the wrong ones are errors (FLT4).

    Arrays must have n_probes whole entries without nulls, 0 <= positive <= observed; n must be whole and at least 0.
    """
    entries = F.arrays_zip(F.col("observed").alias("o"), F.col("positive").alias("p"))
    fine = F.forall(entries, lambda x: F.coalesce((x["p"] >= 0) & (x["p"] <= x["o"]) & (x["p"] == F.floor(x["p"])) & (x["o"] == F.floor(x["o"])), F.lit(False)))
    sized = (F.size("observed") == n_probes) & (F.size("positive") == n_probes)
    good = F.coalesce(sized & fine, F.lit(False))
    said = F.raise_error(F.lit(f"counts must be {n_probes} whole numbers with 0 <= positive <= observed"))
    return classes.withColumns({"n": whole_count(F.col("n")), "observed": F.when(good, F.col("observed")).otherwise(said.cast(classes.schema["observed"].dataType))})


def trace_classes(traces: DataFrame, n_cycles: int) -> DataFrame:
    """(molecule, probe, call) with one row per cycle -> distinct (mask, trace) with n (AGG1)."""
    at = lambda j, what: F.max(F.when(F.col("probe") == j, what))
    mask = F.array(*[F.coalesce(at(j, F.col("call").isin(0, 1).cast("int")), F.lit(0)) for j in range(n_cycles)])
    trace = F.array(*[F.coalesce(at(j, (F.col("call") == 1).cast("int")), F.lit(0)) for j in range(n_cycles)])
    return traces.groupBy("molecule").agg(mask.alias("mask"), trace.alias("trace")).groupBy("mask", "trace").agg(F.count("*").alias("n"))


def drop_invariant_probes(classes: DataFrame, q: list[list[float]]) -> tuple[DataFrame, list[int], Column]:
    """Keep the probes whose probability differs between origins; regroup; the third value is the exact offset to add up (AGG4).

    The returned Column is an aggregate over classes: sum of n * (positive * ln p + negative * ln(1 - p)); the kept classes
    have their share of it as log_offset.
    """
    keep = [j for j in range(len(q[0])) if len({row[j] for row in q}) > 1]
    gone = [j for j in range(len(q[0])) if j not in keep]
    term = F.lit(0.0)
    for j in gone:
        p, pos, obs = q[0][j], F.col("positive")[j], F.col("observed")[j]
        yes = F.when(pos > 0, pos * F.lit(math.log(p))).otherwise(0.0) if p > 0 else F.when(pos > 0, F.raise_error(F.lit("positive calls of probability 0"))).otherwise(0.0)
        no = F.when(obs > pos, (obs - pos) * F.lit(math.log1p(-p))).otherwise(0.0) if p < 1 else F.when(obs > pos, F.raise_error(F.lit("negative calls of probability 1"))).otherwise(0.0)
        term = term + yes + no
    pick = lambda c: F.array(*[F.col(c)[j] for j in keep]) if keep else F.array().cast("array<int>")
    kept = classes.select(pick("observed").alias("observed"), pick("positive").alias("positive"), "n", (F.col("n") * term).alias("part"))
    kept = kept.groupBy("observed", "positive").agg(F.sum("n").alias("n"), F.sum("part").alias("log_offset"))
    return kept, keep, F.sum(F.col("n") * term)


def join_classes(molecules: DataFrame, classes: DataFrame, *key: str) -> DataFrame:
    """Each molecule with its class's columns; classes have a row per key and n, the molecules of the class.

    The few classes that hold over 1 / HEAVY of all molecules, such as that without any call, are broadcast, so that no task
    gets all the rows of one; the others meet in a shuffle. Keys must not be null.
    """
    total = classes.agg(F.sum("n").alias("n")).first()["n"] or 0
    heavy = F.col("n") * HEAVY > F.lit(total)
    few = F.broadcast(classes.filter(heavy).drop("n"))
    light = molecules.join(F.broadcast(classes.filter(heavy).select(*key)), list(key), "left_anti")
    return molecules.join(few, list(key)).unionByName(light.join(classes.filter(~heavy).drop("n"), list(key)))


def missing_fraction(classes: DataFrame, n_cycles: int) -> DataFrame:
    """Missing cells over all cells (AGG10)."""
    seen = F.aggregate("observed", F.lit(0), lambda s, x: s + x)
    return classes.agg((1 - F.sum(seen * F.col("n")) / (F.sum("n") * n_cycles)).alias("missing_fraction"))


def scale_audit(classes: DataFrame, n_origins: int) -> DataFrame:
    """Class statistics of a representation (AGG11) and class-size quantiles (AGG12)."""
    n = F.col("n")
    quantiles = [F.expr(f"percentile(n, {p})").alias(f"q{str(p)[2:]}") for p in (0.5, 0.9, 0.95, 0.99, 0.999)]
    return classes.agg(F.count("*").alias("classes"), F.sum((n == 1).cast("long")).alias("singletons"), F.sum((n > 1).cast("long")).alias("repeated"), F.sum(F.when(n > 1, n).otherwise(0)).alias("in_repeated"), F.sum(n - 1).alias("duplicates"), F.max(n).alias("largest"), (F.sum(n) / F.count("*")).alias("compression"), (F.count("*") * n_origins).alias("dense_entries"), *quantiles)


def expand(classes: DataFrame) -> DataFrame:
    """One row per molecule again (AGG9)."""
    return classes.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))


def observable_groups(emissions: DataFrame, probes: list[int]) -> DataFrame:
    """Origins with equal probabilities over the observed probes, groups in the order of their first member (AGG13, AGG16)."""
    key = F.array(*[F.col("q")[j] for j in probes]) if probes else F.array().cast("array<double>")
    grouped = emissions.groupBy(key.alias("row")).agg(F.sort_array(F.collect_list("origin")).alias("members"))
    return grouped.select((F.row_number().over(Window.orderBy(F.col("members")[0])) - 1).alias("group_id"), "members")
