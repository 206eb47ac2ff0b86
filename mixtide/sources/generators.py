"""Panels, rates and draws, as columns of keyed uniforms: the same rows whatever the partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Names and rates of the panel.
ISOFORMS = ["0N3R", "0N4R", "1N3R", "1N4R", "2N3R", "2N4R"]
PTMS = ["pT181", "pS202_pT205", "pT205", "pS214", "pT217", "pT231", "pS396"]
PROBES = ["pan_tau_A", "pan_tau_B", "anti_0N", "anti_2N", "anti_4R", *[f"anti_{p}" for p in PTMS]]
ALPHA = [0.97] * 2 + [0.91] * 3 + [0.84] * 7
BETA = [0.002] * 2 + [0.010] * 3 + [0.015] * 7


def panel(spark: SparkSession, repeats: int = 1) -> DataFrame:
    """origin, candidate_id, isoform, profile of the 6 x 2**7 candidates; a profile repeats its 12 bits (GEN1)."""
    if repeats < 1:
        raise ValueError("repeats must be positive")
    names, isoforms = F.array(*[F.lit(p) for p in PTMS]), F.array(*[F.lit(i) for i in ISOFORMS])
    one = spark.range(len(ISOFORMS) << len(PTMS)).select(F.col("id").cast("int").alias("origin"), F.element_at(isoforms, F.floor(F.col("id") / 128).cast("int") + 1).alias("isoform"), (F.col("id") % 128).alias("state"))
    bits = F.array(*[F.shiftright("state", len(PTMS) - 1 - b).bitwiseAND(F.lit(1)).cast("int") for b in range(len(PTMS))])
    head = F.array(F.lit(1), F.lit(1), *[F.col("isoform").contains(x).cast("int") for x in ("0N", "2N", "4R")])
    one = one.withColumn("bits", bits).withColumn("profile", F.flatten(F.array_repeat(F.concat(head, "bits"), repeats)))
    active = F.array_join(F.filter(F.zip_with(names, "bits", lambda n, b: F.when(b == 1, n)), lambda x: x.isNotNull()), "+")
    return one.select("origin", F.concat("isoform", F.lit("|"), F.when(active == "", "unmodified").otherwise(active)).alias("candidate_id"), "isoform", "profile")


def probe_rates(spark: SparkSession, repeats: int = 1) -> DataFrame:
    """probe, probe_id, alpha, beta of the panel's probes, in pass order (GEN2)."""
    rows = [(r * len(PROBES) + j, f"{name}:r{r + 1}", ALPHA[j], BETA[j]) for r in range(repeats) for j, name in enumerate(PROBES)]
    return spark.createDataFrame(rows, "probe int, probe_id string, alpha double, beta double")


def panel_q(spark: SparkSession, repeats: int = 1) -> list[list[float]]:
    """The panel's probabilities, origins by probes."""
    rows = panel(spark, repeats).select("origin", "profile").orderBy("origin").collect()  # 768 rows
    return [[(ALPHA if bit else BETA)[j % len(PROBES)] for j, bit in enumerate(r["profile"])] for r in rows]


def designed_profiles(n_origins: int = 8, n_probes: int = 8) -> list[list[int]]:
    """A small panel: bits of Gray-coded origin numbers and of their products with odd steps."""
    return [[((k ^ (k >> 1)) * (2 * j + 1) + k * j) >> (j % 3) & 1 for j in range(n_probes)] for k in range(n_origins)]


def designed_q(profiles: list[list[int]], alpha: float = 0.84, beta: float = 0.07) -> list[list[float]]:
    return [[alpha if bit else beta for bit in row] for row in profiles]


def bit_patterns(spark: SparkSession, n_bits: int) -> DataFrame:
    """All 2**n_bits patterns, most significant bit first (GEN15)."""
    return spark.range(1 << n_bits).select("id", F.array(*[F.shiftright("id", n_bits - 1 - b).bitwiseAND(F.lit(1)).cast("int") for b in range(n_bits)]).alias("bits"))


def inverse_cdf(rows: DataFrame, u, weights: DataFrame) -> DataFrame:
    """Draw an origin per row: (origin, w) gives half-open ranges, the last one ends at 1 (GEN6, JN9); weights is small."""
    upto = Window.orderBy("origin").rowsBetween(Window.unboundedPreceding, 0)
    cut = weights.withColumn("high", F.sum("w").over(upto) / F.sum("w").over(Window.partitionBy())).withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("origin")), F.lit(0.0)))
    cut = cut.withColumn("high", F.when(F.lead("origin").over(Window.orderBy("origin")).isNull(), 1.0).otherwise(F.col("high"))).select("origin", "low", "high")
    return rows.withColumn("__u", u).join(F.broadcast(cut), (F.col("__u") >= F.col("low")) & (F.col("__u") < F.col("high"))).drop("__u", "low", "high")
