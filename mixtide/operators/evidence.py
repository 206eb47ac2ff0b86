"""How evidence for a molecule's origin builds up, and an example that shows what one probe adds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixtide.functions.math import softmax
from mixtide.operators.likelihood import check_profiles, score


def twins(profiles: list[list[int]], probe: int) -> list[int]:
    """For each origin the only other one whose profile is the same without the probe; -1 where there is none or more."""
    check_profiles(profiles)
    groups: dict[tuple[int, ...], list[int]] = {}
    for k, row in enumerate(profiles):
        groups.setdefault((*row[:probe], *row[probe + 1 :]), []).append(k)
    others = [[t for t in groups[(*row[:probe], *row[probe + 1 :])] if t != k] for k, row in enumerate(profiles)]
    return [x[0] if len(x) == 1 else -1 for x in others]


def pick_example(
    rows: DataFrame,
    q: list[list[float]],
    twin: list[int],
    probe: int,
    least: float = 0.9,
    uneven: float = 0.05,
    digits: int = 12,
) -> DataFrame:
    """(molecule, observed, positive, truth) -> the molecule that a probe alone tells from its twin: molecule, truth, twin, score (MT21).

    With the whole panel the true origin's posterior is a >= least; with the probe blind (1/2 for all) origin and twin together
    have p >= least, shared evenly up to uneven. The largest a * p * (1 - 2 * unevenness) wins, rounded to so many
    digits, of equals the smallest molecule; no row if there is none. Priors are flat. One partial maximum per task.
    """
    blind = [[0.5 if j == probe else p for j, p in enumerate(row)] for row in q]
    plain = rows.withColumn("twin", F.get(F.array(*[F.lit(t) for t in twin]), F.col("truth"))).filter("twin >= 0")
    seen = score(plain, q).withColumn("full", softmax(F.col("ll")))
    dark = score(seen, blind).withColumn("dark", softmax(F.col("ll")))
    mine, other = F.get("dark", F.col("truth")), F.get("dark", F.col("twin"))
    cut = dark.select("molecule", "truth", "twin", F.get("full", F.col("truth")).alias("a"), (mine + other).alias("p"), F.try_divide(mine, mine + other).alias("share"))
    off = F.abs(F.col("share") - 0.5)
    good = cut.filter((F.col("a") >= least) & (F.col("p") >= least) & (off <= uneven))
    value = F.round(F.col("a") * F.col("p") * (1 - 2 * off), digits)
    best = good.agg(F.min(F.struct((-value).alias("back"), "molecule", "truth", "twin")).alias("best")).filter("best is not null")
    return best.select("best.molecule", "best.truth", "best.twin", (-F.col("best.back")).alias("score"))
