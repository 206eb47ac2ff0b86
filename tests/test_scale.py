"""What a task holds, and how often the tables are read, where the tables grow."""

from mixtide import assignment_queries as AQ
from mixtide import model_queries as MQ
from mixtide import queries as core
from mixtide.functions.arrays import sum_rows
from mixtide.operators import classes as C
from mixtide.plans import bootstrap as B
from mixtide.plans import em as E

SF = "/root/testdata/sf0.001"


def scans(rows, column):
    """How often the plan reads the table that has a column."""
    return sum("Relation [" in line and column in line for line in rows._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_tasks_grow_with_the_lines(spark, monkeypatch):
    lines = core.table(spark, SF, "lineitem").count()
    monkeypatch.setattr(C, "TOGETHER", lines // 20)
    counts = C.probe_counts(core.order_traces(spark, SF), 8)
    sizes = counts.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) >= 20 and max(sizes) < 3 * sum(sizes) / len(sizes)
    monkeypatch.setattr(C, "TOGETHER", 10 * lines)
    again = C.probe_counts(core.order_traces(spark, SF), 8)
    assert again.exceptAll(counts).isEmpty() and counts.exceptAll(again).isEmpty()


def test_yields_read_the_lines_once(spark):
    assert scans(MQ.agg21(spark, SF), "l_orderkey") == 1


def test_assignments_read_the_orders_once(spark):
    for query in (AQ.flt13, AQ.mt7, AQ.mt10):
        assert scans(query(spark, SF), "o_orderkey") == 1


def test_outlier_report_reads_no_table_again(spark):
    assert scans(AQ.mt15(spark, SF), "l_orderkey") == 0


def test_bootstrap_reads_no_table_again(spark, monkeypatch):
    seen = []
    whole = B.bootstrap

    def bootstrap(classes, *rest, **more):
        seen.append(scans(classes, "l_orderkey"))
        return whole(classes, *rest, **more)

    monkeypatch.setattr(B, "bootstrap", bootstrap)
    for query in (AQ.bs1, AQ.bs4):
        query(spark, SF)
    assert seen == [0, 0]


def test_steps_over_few_classes_take_few_tasks(spark, monkeypatch):
    rows = spark.createDataFrame([(3, [0.0, -1.0]), (5, [-2.0, 0.0])] * 20, "n long, ll array<double>").repartition(16)
    assert E.step_tasks(rows, 80) == 1
    one = E.fit(rows).weights
    monkeypatch.setattr(E, "STEP", 10)
    assert E.step_tasks(rows, 80) == 8 and E.step_tasks(rows, 1000) == 16
    assert abs(E.fit(rows).weights - one).max() < 1e-9


def test_sums_meet_on_the_driver_or_on_executors(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.0]), (0, [3.0, 4.0])], "row int, vec array<double>")
    for direct in (True, False):
        assert {k: v.tolist() for k, v in sum_rows(rows, direct).items()} == {0: [4.0, 6.0], 1: [0.5, 0.0]}
