"""Exact dedup against a persistent digest index (operator 11).

The index is a table of text digests, bucketed and sorted by digest, in a folder of its own. A batch of new rows is
reduced to one row per digest before it moves, meets the index in a sort-merge anti-join that leaves the index
where it is, and what is left is appended to the buckets. Texts themselves never move: only their digests do.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixtide.llm._common import Tables, documents, materialize, new_path, remove

ENTRIES = "digest binary, keep_id bigint, batch bigint"
BUCKETS = 64
#: A bucket of the query's index holds about so many entries (some 50 bytes each).
BUCKET_ROWS = 1_000_000
#: A group of over 1 / HEAVY of all rows is hot; so there are fewer than HEAVY of them, and their list may be broadcast.
HEAVY = 1000


def digest_of(text: Column) -> Column:
    """SHA-256 of a whole text in UTF-8; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, digest, row (a number of the row, to be written before it is used twice)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("row"))


class DigestIndex:
    """Digests of the texts that were kept so far, in a folder that outlives the session: digest, keep_id, batch.

    The folder holds generations of the table, entries-N, and for each that is complete a one-row table ready-N.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        """Open the index in the folder path, or start one of so many buckets there (an index keeps its own number)."""
        self.spark, self.path = spark, path.rstrip("/")
        ready = self._ready()
        self.generation = max(ready, default=0)
        if not ready:
            self._finish(0, int(buckets))
        self.buckets = spark.read.schema("buckets int").parquet(f"{self.path}/ready-{self.generation}").first()["buckets"]
        self.table = self._attach(self.generation)

    def _ready(self) -> list[int]:
        """The complete generations."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        store = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in store.listStatus(folder)] if store.exists(folder) else []
        return [int(x.removeprefix("ready-")) for x in names if x.startswith("ready-") and store.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{x}/_SUCCESS"))]

    def _finish(self, generation: int, buckets: int) -> None:
        self.spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{self.path}/ready-{generation}")

    def _attach(self, generation: int) -> str:
        """Name a generation's files, so that Spark knows how they are bucketed and sorted; the name lives in the session alone."""
        name, place = f"digest_index_{uuid.uuid4().hex}", f"{self.path}/entries-{generation}"
        quoted = place.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE {name} ({ENTRIES}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{quoted}'"
        )
        return name

    def entries(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def add(self, rows: DataFrame, batch: int) -> None:
        """Append the digests of rows (doc_id, digest) that the index lacks, each with the largest doc_id that has it.

        Rows are reduced to one per digest first. A batch that is added again, say after a lost driver, adds nothing.
        """
        with Tables(self.spark) as tables:
            # written, as the optimizer would move the anti-join in front of the reduction, where a hot digest has all its rows
            first = tables.write(rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id")), "first")
            new = first.join(self.entries().hint("merge"), "digest", "left_anti")
            new.select("digest", "keep_id", F.lit(int(batch)).cast("long").alias("batch")).write.insertInto(self.table)

    def resolve(self, rows: DataFrame) -> DataFrame:
        """(doc_id, digest, row, batch), all batches of which were added -> the same with keep_id, group_size, kept.

        group_size counts the equal texts among rows. Of the rows with an entry's digest one is kept: that of the entry's
        batch with the largest doc_id (of equal rows, that of the largest row); none if an earlier batch holds the digest.
        """
        top = F.max(F.struct((-F.col("batch")).alias("back"), "doc_id", "row")).alias("top")
        groups = rows.groupBy("digest").agg(F.count("*").alias("group_size"), top)
        met = groups.join(self.entries().hint("merge").select("digest", "keep_id", F.col("batch").alias("__batch")), "digest")
        with Tables(self.spark) as tables:
            known = tables.write(met.select("digest", "group_size", "keep_id", "__batch", "top"), "groups")
            hot = known.filter(F.col("group_size") * HEAVY > rows.count())
            light = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(known, "digest")
            both = rows.join(F.broadcast(hot), "digest").unionByName(light)
            kept = (F.col("__batch") == -F.col("top.back")) & (F.col("row") == F.col("top.row"))
            return materialize(both.select(*rows.columns, "keep_id", "group_size", kept.alias("kept")), "resolved")

    def keep_new(self, docs: DataFrame, batch: int) -> DataFrame:
        """Add a batch of documents and return those that stay, with all their columns.

        Null text counts as empty, null doc_ids are smaller than all others, of repeated rows one stays, an empty table stays
        empty, columns of any name pass through.
        """
        names = [f"c{k}" for k in range(len(docs.columns))]
        plain = docs.toDF(*names)
        at = {c: F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text")}
        with Tables(self.spark) as tables:
            held = tables.write(plain.withColumn("row", F.monotonically_increasing_id()), "batch")
            digest = digest_of(at["text"]).alias("digest")
            rows = held.select(at["doc_id"].cast("long").alias("doc_id"), digest, "row", F.lit(int(batch)).cast("long").alias("batch"))
            rows = tables.write(rows, "digests")
            self.add(rows, batch)
            kept = self.resolve(rows).filter("kept").select("row")
            return materialize(held.join(kept, "row").drop("row"), "kept").toDF(*docs.columns)

    def compact(self) -> None:
        """Merge each bucket's files, one per batch, into one; the same rows stay. Until the new generation is complete the old one counts."""
        new, old = self.generation + 1, (self.table, f"{self.path}/entries-{self.generation}", f"{self.path}/ready-{self.generation}")
        remove(self.spark, f"{self.path}/entries-{new}")
        table = self._attach(new)
        self.entries().repartition(self.buckets, "digest").write.insertInto(table)
        self._finish(new, self.buckets)
        self.table, self.generation = table, new
        self.spark.sql(f"DROP TABLE {old[0]}")
        for path in old[1:]:
            remove(self.spark, path)


def exact_dedup(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) -> doc_id, digest, keep_id, group_size, kept; one row per input row.

    Documents enter a new index in two batches, those of the upper half of the doc_ids first, so that of equal texts the
    largest doc_id stays. Null text counts as empty; null doc_ids are smaller than all others; of repeated rows one is
    kept; an empty table gives no rows; other columns are ignored. Without a path the index is removed at the end.
    """
    spark = docs.sparkSession
    with Tables(spark) as tables:
        rows = tables.write(digests(docs), "digests")
        found = rows.agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
        middle = None if found["high"] is None else (found["low"] + found["high"]) // 2
        upper = F.coalesce(F.col("doc_id") > F.lit(middle), F.lit(False))
        rows = rows.withColumn("batch", F.when(upper, 1).otherwise(2).cast("long"))
        index = DigestIndex(spark, path or new_path(spark, "digest-index"), max(8, -(-found["n"] // BUCKET_ROWS)))
        for batch in (1, 2):
            index.add(rows.filter(F.col("batch") == batch), batch)
        out = index.resolve(rows)
        if path is None:
            spark.sql(f"DROP TABLE {index.table}")
            remove(spark, index.path)
        return out.select("doc_id", "digest", "keep_id", "group_size", "kept")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its text that stays; nulls and ties as in exact_dedup."""
    found = exact_dedup(documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP11_SQL = """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept,
    sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))
"""
