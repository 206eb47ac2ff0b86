"""Tab-separated traces, schedules, emission matrices and abundances, read with explicit schemas and written by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixtide.functions.math import cpm


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Header and names must agree with the schema (SRC7)."""
    return spark.read.option("sep", "\t").option("header", True).option("enforceSchema", False).schema(schema).csv(path)


def read_traces(spark: SparkSession, path: str, n_cycles: int) -> DataFrame:
    """molecule, calls (SRC1)."""
    names = [f"c{c + 1:02d}" for c in range(n_cycles)]
    return read_tsv(spark, path, ", ".join(["molecule string", *(f"{c} int" for c in names)])).select("molecule", F.array(*names).alias("calls"))


def to_long(traces: DataFrame, schedule: DataFrame | None = None) -> DataFrame:
    """(molecule, calls) -> molecule, cycle, probe, call; a schedule (cycle, probe) maps cycles to probes (SRC3)."""
    cells = traces.select("molecule", F.posexplode("calls").alias("cycle", "call"))
    return cells.withColumn("probe", F.col("cycle")) if schedule is None else cells.join(F.broadcast(schedule), "cycle")


def read_q(spark: SparkSession, path: str, probes: list[str]) -> DataFrame:
    """candidate_id, q: a column of names and one of probabilities per probe (SRC2)."""
    names = ", ".join(["candidate_id string", *(f"`{p}` double" for p in probes)])
    return read_tsv(spark, path, names).select("candidate_id", F.array(*[F.col(f"`{p}`") for p in probes]).alias("q"))


def read_schedule(spark: SparkSession, path: str, probes: list[str]) -> DataFrame:
    """cycle, probe: the file names probes, which become places in probes; an unknown name is an error (SRC3)."""
    place = F.array_position(F.array(*[F.lit(p) for p in probes]), F.col("probe")) - 1
    checked = F.when(place >= 0, place).otherwise(F.raise_error(F.concat(F.lit("unknown probe "), F.coalesce("probe", F.lit("null")))).cast("long"))
    return read_tsv(spark, path, "cycle int, probe string").select("cycle", checked.cast("int").alias("probe"))


def read_truth(spark: SparkSession, path: str, candidates: DataFrame) -> DataFrame:
    """(origin, candidate_id) with truth as a fraction; candidates that the file does not name have 0 (SRC4)."""
    cells = read_tsv(spark, path, "candidate_id string, cpm double").select("candidate_id", (F.col("cpm") / 1e6).alias("truth"))
    return candidates.join(cells, "candidate_id", "left").withColumn("truth", F.coalesce("truth", F.lit(0.0)))


def _one_file(rows: DataFrame, path: str, *order) -> None:
    """A row per candidate, at most a few thousand, in one sorted file."""
    rows.coalesce(1).sortWithinPartitions(*order).write.option("sep", "\t").option("header", True).csv(path)


def write_abundances(weights: DataFrame, path: str, sample: str, flowcell: str = "", lane: str = "", sample_group: str = "") -> None:
    """(origin, candidate_id, w) -> counts per million, heaviest first, then by origin (SNK1)."""
    rows = weights.orderBy(F.col("w").desc(), "origin").select(*[F.lit(v).alias(k) for k, v in (("flowcell", flowcell), ("lane", lane), ("sample", sample), ("sample_group", sample_group))], "candidate_id", cpm(F.col("w")).alias("estimated_cpm"), "w", "origin")
    ranked = rows.coalesce(1).sortWithinPartitions(F.col("w").desc(), "origin").drop("w", "origin")
    ranked.write.option("sep", "\t").option("header", True).csv(path)


def write_comparison(rows: DataFrame, path: str) -> None:
    """(origin, candidate_id, truth, hard, binary, weighted) -> fractions to 12 significant digits and counts per million (SNK2)."""
    names = ("truth", "hard", "binary", "weighted")
    digits = lambda c: F.format_string("%.11e", F.col(c)).cast("double").alias(c)
    _one_file(rows.select("origin", "candidate_id", *[digits(c) for c in names], *[cpm(F.col(c)).alias(f"{c}_cpm") for c in names]), path, "origin")


def write_panel(panel: DataFrame, probe_ids: list[str], path: str) -> None:
    """(origin, candidate_id, profile) -> candidate_index, candidate_id and a column of bits per physical probe (SNK3)."""
    _one_file(panel.select(F.col("origin").alias("candidate_index"), "candidate_id", *[F.col("profile")[j].alias(p) for j, p in enumerate(probe_ids)]), path, "candidate_index")


def write_traces(traces: DataFrame, path: str, n_cycles: int) -> None:
    """(molecule, cycle, call) -> molecule and a column c01 .. per cycle, -1 where there is no call, in gzip files by molecule (SNK5).

    Files are ranges of molecules in order; read_traces reads them back.
    """
    call = lambda c: F.coalesce(F.max(F.when(F.col("cycle") == c, F.col("call"))), F.lit(-1))
    wide = traces.groupBy("molecule").agg(*[call(c).cast("int").alias(f"c{c + 1:02d}") for c in range(n_cycles)])
    ranged = wide.repartitionByRange("molecule").sortWithinPartitions("molecule")
    ranged.write.option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)


def write_cohort(weights: DataFrame, path: str) -> None:
    """(flowcell, lane, sample, sample_group, candidate_id, origin, w) -> a cohort's long table, a folder per sample (SNK7).

    Counts per million, the heaviest candidates first, then by origin. Only the folders of the samples given are written
    anew: a rerun of one sample replaces it and leaves the others as they are.
    """
    rows = weights.select("flowcell", "lane", "sample", "sample_group", "candidate_id", cpm(F.col("w")).alias("estimated_cpm"), "w", "origin")
    ranked = rows.repartition("sample").sortWithinPartitions("sample", F.col("w").desc(), "origin").drop("w", "origin")
    writer = ranked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sample")
    writer.option("sep", "\t").option("header", True).csv(path)


def read_cohort(spark: SparkSession, path: str) -> DataFrame:
    """The rows of write_cohort."""
    schema = "flowcell string, lane string, sample_group string, candidate_id string, estimated_cpm bigint, sample string"
    return spark.read.option("sep", "\t").option("header", True).schema(schema).csv(path)
