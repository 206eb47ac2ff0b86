"""Streams give what the same rows give as a table, batch by batch."""

import datetime

import numpy as np

from mixtide.operators import classes as C
from mixtide.plans import em as E
from mixtide.streaming.classes import windowed_counts
from mixtide.streaming.refit import fits, refit_stream

Q = [[0.9, 0.2], [0.3, 0.6]]
SCHEMA = "observed array<int>, positive array<int>"


def rows(seed, n):
    rng = np.random.default_rng(seed)
    return [([1, 1], [int(a), int(b)]) for a, b in rng.integers(0, 2, (n, 2))]


def test_refits_follow_the_batches(spark, tmp_path):
    source, folder, every = f"{tmp_path}/in", f"{tmp_path}/out", []
    for number, n in enumerate((30, 0, 50)):
        new = rows(number, n)
        every += new
        spark.createDataFrame(new, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        refit_stream(spark.readStream.schema(SCHEMA).parquet(source), Q, folder).awaitTermination()
        last = fits(spark, folder).orderBy("batch", "origin").collect()[-2:]
        whole = E.fit_em(C.count_classes(spark.createDataFrame(every, SCHEMA)), Q)
        assert np.allclose([r["weight"] for r in last], whole.weights) and last[0]["n"] == len(every)
    refit_stream(spark.readStream.schema(SCHEMA).parquet(source), Q, folder).awaitTermination()  # nothing new
    assert fits(spark, folder).agg({"n": "max"}).first()[0] == 80


def test_a_batch_that_is_run_again_counts_once(spark, tmp_path):
    source, folder = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame(rows(7, 40), SCHEMA).coalesce(1).write.parquet(source)
    read = lambda: spark.readStream.schema(SCHEMA).parquet(source)
    refit_stream(read(), Q, folder).awaitTermination()
    first = sorted(map(tuple, fits(spark, folder).collect()))
    (tmp_path / "out" / "checkpoint" / "commits" / "0").unlink()  # the driver was lost before it committed
    (tmp_path / "out" / "checkpoint" / "commits" / ".0.crc").unlink(missing_ok=True)
    refit_stream(read(), Q, folder).awaitTermination()
    assert sorted(map(tuple, fits(spark, folder).collect())) == first


def test_windowed_counts_of_a_stream(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    events = [(start + datetime.timedelta(hours=7 * k), "ab"[k % 2], None if k % 5 == 0 else float(20 * k % 101)) for k in range(40)]
    schema = "ts timestamp, event_type string, value double"
    spark.createDataFrame(events, schema).repartition(3).write.parquet(f"{tmp_path}/events")
    stream = windowed_counts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events"), late="400 days")
    query = stream.writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    whole = windowed_counts(spark.read.schema(schema).parquet(f"{tmp_path}/events"))
    assert sorted(map(tuple, spark.table("windowed").collect())) == sorted(map(tuple, whole.collect()))
