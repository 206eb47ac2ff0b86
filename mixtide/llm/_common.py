"""Shared pieces of the training-data operators: intermediate tables, size-checked broadcasts, vector sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from types import TracebackType

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words everywhere in this package, as a Java and RE2 class.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which an id list may be broadcast (8 bytes each); beyond it the join shuffles.
BROADCAST_IDS = 1_000_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where unset, a new temporary one, in local mode only."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-mixtide-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that this package has written and no longer reads."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _write(df: DataFrame, path: str, into: SparkSession | None = None) -> DataFrame:
    spark = df.sparkSession
    if spark.conf.get(_CLEANUP, "false") != "true":
        spark.conf.set(_CLEANUP, "true")  # a written table replaces the shuffle files that led to it; set once, never switched back
    df.write.parquet(path)
    return (into or spark).read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors. The table stays: for results."""
    return _write(df, new_path(df.sparkSession, name))


class Tables:
    """Intermediate tables of one call: written to the shared folder, read back, and removed when the block ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def session(self, settings: dict[str, str]) -> SparkSession:
        """A session beside the caller's, with settings of its own, to write and read in: the caller's stay as they are."""
        other = self.spark.newSession()
        for key, value in {"spark.sql.shuffle.partitions": self.spark.conf.get("spark.sql.shuffle.partitions"), **settings}.items():
            other.conf.set(key, value)
        return other

    def write(self, df: DataFrame, name: str, into: SparkSession | None = None) -> DataFrame:
        """The written table, read in the session into (of df where none is given)."""
        self.paths.append(new_path(self.spark, name))
        return _write(df, self.paths[-1], into)

    def remove(self) -> None:
        for path in self.paths:
            remove(self.spark, path)
        self.paths = []

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, kind: type | None, error: BaseException | None, trace: TracebackType | None) -> None:
        self.remove()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of df, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def small_enough(ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """Hint a broadcast for ids (a written, narrow table) if a count shows that it is within limit."""
    return F.broadcast(ids) if ids.count() <= limit else ids


VECTOR_SCHEMA = "key string, chunk int, salt int, vec binary"
CHUNK = 8192


def _dtype(key: str):
    return np.float32 if key.startswith("short") else np.float64


def vector_rows(vectors: dict[str, np.ndarray], salt: int) -> Iterator[pa.RecordBatch]:
    """Cut vectors into rows of CHUNK numbers (4 bytes each under keys that start with short); all-zero chunks need no row."""
    for key, v in vectors.items():
        v = np.ascontiguousarray(v, dtype=_dtype(key)).ravel()
        rows = [(k // CHUNK, v[k : k + CHUNK].tobytes()) for k in range(0, len(v), CHUNK) if v[k : k + CHUNK].any()]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * len(rows)), pa.array([c for c, _ in rows], pa.int32()), pa.array([salt] * len(rows), pa.int32()), pa.array([b for _, b in rows], pa.binary())],
                names=["key", "chunk", "salt", "vec"],
            )


def _sum_group(table: pa.Table, fanout: int) -> pa.Table:
    """The sum of a group's vectors in order of salt, so that it rounds alike in every run."""
    table = table.sort_by("salt")
    head, total = table.slice(0, 1), None
    kind = _dtype(head["key"][0].as_py())
    for x in table.column("vec"):
        v = np.frombuffer(x.as_py(), dtype=kind).astype(np.float64)
        total = v if total is None else total + v
    total = total.astype(kind)
    return pa.table({"key": head["key"].cast(pa.string()), "chunk": head["chunk"].cast(pa.int32()), "salt": pa.array([head["salt"][0].as_py() % fanout], pa.int32()), "vec": pa.array([total.tobytes()], pa.binary())})


def sum_vectors(rows: DataFrame, sizes: dict[str, int] | None = None, fanout: int = 32) -> dict[str, np.ndarray]:
    """Sum rows of VECTOR_SCHEMA by (key, chunk) in two levels; the sums go to the driver: callers bound the vectors' size."""
    first = rows.groupBy("key", "chunk", (F.col("salt") % fanout).alias("part")).applyInArrow(lambda t: _sum_group(t, fanout), VECTOR_SCHEMA)
    second = first.groupBy("key", "chunk").applyInArrow(lambda t: _sum_group(t, 1), VECTOR_SCHEMA)
    found: dict[str, dict[int, np.ndarray]] = {}
    for r in second.select("key", "chunk", "vec").collect():  # inside one execution: an iterator would outlive its shuffle files
        found.setdefault(r["key"], {})[r["chunk"]] = np.frombuffer(bytes(r["vec"]), dtype=_dtype(r["key"]))
    out = {}
    for key, chunks in found.items():
        size = (sizes or {}).get(key) or max(c * CHUNK + len(v) for c, v in chunks.items())
        out[key] = np.zeros(size)
        for c, v in chunks.items():
            out[key][c * CHUNK : c * CHUNK + len(v)] = v
    return out
