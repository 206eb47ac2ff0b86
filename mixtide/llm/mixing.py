"""Mixing sources to target weights along a time-varying curriculum (operator 2).

Each source has a target of words and a schedule, a piecewise-linear density over training time 0..1. A source's
documents stand in an order by hash, once per epoch, on a line of cumulative words; the integral of its schedule
maps time to words demanded, and its inverse maps each copy's first word to its training position. Documents are
range-sorted by position. The copy on which a source's target falls is taken up to that word.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mixtide.llm._common import WORD, Tables, columns_of, documents, materialize, small_enough

WEIGHTS = (5.0, 2.0, 1.0)
MOST_TIMES = 3
#: Rows of a plan (about 100 bytes each) up to which it is broadcast; beyond it the texts are shuffled to it.
BROADCAST_PLAN = 500_000
#: Density over time for the 1st, 2nd, 3rd source and so on, repeating: (time, density) knots.
SCHEDULES = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)))


def order_key(doc_id: Column) -> Column:
    """A fixed pseudo-random place of a document in its source, 0 to 2**52 - 1."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix|"), doc_id.cast("string"))), 1, 13), 16, 10).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """(source, source_size) -> source, rank, source_size, target: one row per source, code-point order, null last.

    The level x solves sum(min(most * size, x * weight)) = total. With sources by most * size / weight, those
    before the first whose own level would be above x are full.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("weight", w)
    by_level = Window.orderBy(F.col("level"), F.col("rank"))
    past = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = ranked.withColumn("cap", F.col("source_size") * most).withColumn("level", F.col("cap") / F.col("weight"))
    total = F.sum("source_size").over(Window.partitionBy())
    rest = rest.withColumns({"full": F.coalesce(F.sum("cap").over(past), F.lit(0)), "open_weight": F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(past), F.lit(0.0)), "total": total})
    rest = rest.withColumn("x", (F.col("total") - F.col("full")) / F.col("open_weight"))
    first = F.min(F.when(F.col("level") > F.col("x"), F.struct("level", "rank", "x"))).over(Window.partitionBy())["x"]
    rest = rest.withColumn("fill", first)
    full = F.col("fill").isNull() | (F.col("level") <= F.col("fill"))
    return rest.select("source", "rank", "source_size", F.when(full, F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("fill")).alias("target"))


def position(share: Column, rank: Column, schedules=SCHEDULES) -> Column:
    """Training time at which a share (0..1) of a source's words has been demanded: the integral's inverse."""

    def inverse(knots) -> Column:
        area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))
        out, done = None, 0.0
        for (t0, d0), (t1, d1) in zip(knots, knots[1:], strict=False):
            own, slope = (t1 - t0) * (d0 + d1) / 2 / area, (d1 - d0) / (t1 - t0) / area
            left = F.greatest(share - F.lit(done), F.lit(0.0))
            if slope:
                here = F.lit(t0) + (F.sqrt(F.greatest(F.lit((d0 / area) ** 2) + F.lit(2 * slope) * left, F.lit(0.0))) - F.lit(d0 / area)) / F.lit(slope)
            else:
                here = F.lit(t0) + left / F.lit(d0 / area)
            out = F.least(here, F.lit(t1)) if out is None else F.when(share <= F.lit(done), out).otherwise(F.least(here, F.lit(t1)))
            done += own
        return out

    cases = [inverse(k) for k in schedules]
    out = cases[0]
    for k, c in enumerate(cases[1:], 1):
        out = F.when(rank % len(cases) == k, c).otherwise(out)
    return out


def assign(docs: DataFrame, schedules=SCHEDULES, weights=WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """(doc_id, text, source) -> one row per input row: row_hash, doc_id, source, size, source_size, target, copies,
    last_words, taken, positions.

    A document is taken copies times; its last copy counts only last_words words (size, but on the copy where the
    target falls). positions: training times of its copies, in order. Null or wordless text has size 0 and is
    never taken. A null doc_id is hashed as the text null; repeated rows share a hash and are taken one after the other. Columns besides
    these three are ignored. A source whose words are all taken MOST_TIMES times has reached its limit. An empty table
    gives no rows.
    """
    with Tables(docs.sparkSession) as tables:
        return materialize(_assign(docs, F.xxhash64("text", F.lit(7)), schedules, weights, most, tables), "assigned")


def _assign(docs: DataFrame, row_hash: Column, schedules, weights, most: int, tables: Tables) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = order_key(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), key.alias("key"), row_hash.alias("row_hash"))
    sizes = tables.write(sizes, "sizes")
    by_source = tables.write(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    # prefix sums in two passes: totals of (source, run of hashes), then inside each run; the runs of a source and the rows of a run
    # both grow with the square root of the rows
    runs = math.isqrt(sizes.count()) + 1
    width = (1 << 52) // runs + 1
    cut = sizes.withColumn("run", F.floor(F.col("key") / F.lit(width)).cast("long"))
    totals = cut.groupBy("source", "run").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("s"), F.col("run").alias("r"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "run").orderBy("key", "doc_id", "row_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(totals, F.col("source").eqNullSafe(F.col("s")) & (F.col("run") == F.col("r")))
    known = by_source.select(F.col("source").alias("own"), "rank", "source_size", "target")
    placed = placed.join(known, F.col("source").eqNullSafe(F.col("own"))).withColumn("start", F.col("offset") + F.col("within"))
    aim = F.round("target").cast("long")
    left = F.greatest(aim - F.col("start"), F.lit(0))  # words demanded from this document's first copy on
    whole = F.when(F.col("size") > 0, F.ceil(left / F.col("source_size")).cast("int")).otherwise(F.lit(0))
    placed = placed.withColumn("copies", whole)
    last = F.least(F.col("size"), left - (F.col("copies") - 1) * F.col("source_size"))
    placed = placed.withColumn("last_words", F.when(F.col("copies") > 0, last).otherwise(F.lit(0)).cast("long"))
    taken = F.when(F.col("copies") > 0, (F.col("copies") - 1) * F.col("size") + F.col("last_words")).otherwise(F.lit(0)).cast("long")
    times = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda e: position((F.col("start") + e * F.col("source_size")) / F.col("target"), F.col("rank"), schedules))).otherwise(F.array().cast("array<double>"))
    return placed.select("row_hash", "doc_id", "source", "size", "source_size", "target", "copies", "last_words", taken.alias("taken"), times.alias("positions"))


def whole_row_hash(docs: DataFrame) -> Column:
    """A hash of all columns that have one (maps have none)."""
    plain = [c for c, (_, t) in zip(columns_of(docs), docs.dtypes, strict=True) if "map<" not in t and t not in ("variant", "void")]
    return F.xxhash64(*plain, F.lit(7))


def mix(docs: DataFrame, schedules=SCHEDULES, weights=WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """The training order: docs' rows, each as often as it is taken, range-sorted by position. Columns stay as they are.

    The one copy per source on which its target falls is cut behind its last word taken. Null doc_ids, sources and
    texts, repeated rows and ties are handled as in assign: a row without words is never taken, rows equal in all columns are
    taken one after the other, rows that share a doc_id and a text keep their own source and other columns. An empty table
    stays empty.
    """
    own = whole_row_hash(docs)
    with Tables(docs.sparkSession) as tables:
        every = tables.write(_assign(docs, own, schedules, weights, most, tables), "assigned")
        plan = every.filter("copies > 0")
        copies = plan.select(F.col("doc_id").alias("__id"), F.col("row_hash").alias("__row"), "size", "last_words", F.posexplode("positions").alias("epoch", "__position"), "copies")
        words = F.when(F.col("epoch") == F.col("copies") - 1, F.col("last_words")).otherwise(F.col("size"))
        copies = materialize(copies.select("__id", "__row", "__position", words.alias("__words"), (words == F.col("size")).alias("__whole")), "plan")
        repeated = not every.groupBy("doc_id", "row_hash").count().filter("count > 1").isEmpty()
    one = docs.withColumn("__hash", own)
    if repeated:  # equal rows have one plan row each: the copies of all of them are made from one
        one = one.dropDuplicates(["doc_id", "__hash"])
    met = one.join(small_enough(copies, BROADCAST_PLAN), F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__row")))
    cut = F.regexp_extract(F.col("text"), r"^[\x20\x09-\x0D]*", 0)
    text = F.when(F.col("__whole"), F.col("text")).otherwise(F.concat(cut, F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0)), 1, F.col("__words").cast("int")), "")))
    met = met.withColumn("text", text)
    if "n_chars" in docs.columns:
        met = met.withColumn("n_chars", F.when(F.col("__whole"), F.col("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return met.repartitionByRange(F.col("__position"), F.col("doc_id")).sortWithinPartitions("__position", "doc_id").select(*columns_of(docs))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, range-sorted by the position of the first copy; nulls and ties as in assign."""
    plan = assign(documents(spark, sf_dir))
    first = plan.withColumn("position", F.try_element_at("positions", F.lit(1)))
    out = first.select("doc_id", "size", "source_size", "target", "taken", "position")
    return out.repartitionByRange(F.col("position").asc_nulls_last(), F.col("doc_id")).sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


OP2_SQL = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
    cast('0x' || substr(md5('mix|' || doc_id), 1, 13) as bigint) as key from documents
), s as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as rnk from d group by source
), w as (
  select *, [5.0::double, 2.0::double, 1.0::double][cast(rnk % 3 + 1 as int)] as weight, 3 * source_size as cap from s
), l as (select *, cap::double / weight as lvl from w
), o as (
  select *, (sum(source_size) over ())::bigint as total,
    coalesce((sum(cap) over (order by lvl, rnk rows between unbounded preceding and 1 preceding))::bigint, 0) as full_cap,
    sum(weight) over () - coalesce(sum(weight) over (order by lvl, rnk rows between unbounded preceding and 1 preceding), 0) as open_weight from l
), x as (select *, (total - full_cap)::double / open_weight as x from o
), f as (select *, (select arg_min(x, struct_pack(a := lvl, b := rnk)) from x where lvl > x) as fill from x
), t as (
  select source, rnk, source_size, case when fill is null or lvl <= fill then cap::double else weight * fill end as target from f
), p as (
  select d.doc_id, d.size, t.source_size, t.target, t.rnk,
    coalesce((sum(d.size) over (partition by d.source order by d.key, d.doc_id rows between unbounded preceding and 1 preceding))::bigint, 0) as start
  from d join t on d.source is not distinct from t.source
), c as (
  select *, case when size > 0 then cast(ceil(greatest(cast(round(target) as bigint) - start, 0)::double / source_size) as bigint) else 0 end as copies from p
), q as (
  select *, case when copies > 0 then (copies - 1) * size + least(size, greatest(cast(round(target) as bigint) - start, 0) - (copies - 1) * source_size) else 0 end as taken,
    case when copies > 0 then start::double / target end as share from c
)
select doc_id, size, source_size, target, cast(taken as bigint) as taken,
  case when copies = 0 then null when rnk % 3 = 0 then least(0.0::double + (sqrt(greatest(0.25::double + 2.0::double * greatest(share, 0.0::double), 0.0::double)) - 0.5::double) / 1.0::double, 1.0::double)
    when rnk % 3 = 1 then least(greatest(share, 0.0::double), 1.0::double)
    else case when share <= 0.625::double then least(1.5::double - sqrt(greatest(2.25::double - 2.0::double * greatest(share, 0.0::double), 0.0::double)), 0.5::double)
      else least(0.5::double + (sqrt(greatest(1.0::double - 2.0::double * greatest(share - 0.625::double, 0.0::double), 0.0::double)) - 1.0::double) / -1.0::double, 1.0::double) end end as position
from q
"""
