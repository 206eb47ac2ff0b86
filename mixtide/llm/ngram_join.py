"""N-gram Jaccard self-join over a count-vector R-tree (operator 3).

A document is the set of its word shingles. Shingle hashes fall into groups of the hash space, so a set is a point
whose coordinates count its members in each group. Equal sets are one point. The tree over the points:

1. root: intervals of set size. A point is in its own interval, and in the next if a partner may be there;
2. slabs, ranges of coordinates: two linked sets of sizes m and n differ in at most D = (1-t)/(1+t) * (m+n) members. An
   interval has more than D slabs, so some slabs of a linked pair agree in all their counts, and the fullest of
   those is among the D + 1 fullest slabs of both sets. A point enters its D + 1 fullest slabs; a cell holds the points
   that agree in a slab, so its region has no extent in the slab's coordinates. No linked pair misses a cell;
3. pages of about PAGE points of like size inside a cell, and above them levels of FAN nodes each, with the
   coordinate-wise maxima of the points below (folded to FOLD coordinates) as bounding boxes.

The overlap of two sets is at most the sum of coordinate minima of their count vectors. Pairs of nodes descend
level by level while the summed minima of their boxes allow a link, then pairs of points do; survivors are
verified on the sets. Cells with the same points are one cell, and a pair of points that meets in several cells survives
in the least of them alone: a page knows the cells of its points.

Components need no pair inside a component already known: first each cell's points meet its smallest one, then those of
other components meet its point of most links, its middle, and only points that are still in different components descend.
Boxes do not separate texts of one template, whose own words are scattered. So a large cell is first cut again, at the
members that its middle lacks: two linked points with many of those share some (see _cut). No group is gathered in one
task, no row is dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mixtide.llm._common import Tables, documents, materialize, small_enough
from mixtide.llm._text import distinct_by_document, mix, shingles, words
from mixtide.llm.components import components

FOLD = 256
PAGE = 256
FAN = 64
#: Set size beyond which pages hold fewer points: a point may be in so many cells as a share of its size, and its page lists them.
WIDE = 1024
#: Slabs beyond the D + 1 that must be there, as a share of D: the emptiest slabs are never entered.
SPARE = 0.35
#: Points of a cell beyond which it may be cut at the members that its middle lacks.
LARGE = 1024
#: What a pair of a light point costs, as a row of its own, in pairs of points that meet inside pages.
LIGHT_COST = 100
#: Copies of a middle, so that the points of a large cell meet it in several tasks.
SALTS = 32
#: Points that a task remembers to enter equal sets once; a point that it has forgotten is entered again, which changes nothing.
REMEMBERED = 1_000_000
#: A count that stands for itself or more; a coordinate where both points have it bounds nothing.
FULL = 65535
_ROW = "doc_id long, n_shingles long, row_hash long, point long, set_id binary"
_PAGE = "leaf long, node long, least long, box binary, points array<long>, labels array<long>, sizes array<long>, homes array<array<long>>, counts binary"
_CELL = "leaf long, point long, n long, hub long, hub_n long"


def edges(top: int, percent: int) -> np.ndarray:
    """First sizes of the intervals up to top and one more: each at least doubles, and reaches past any partner of smaller intervals."""
    out = [1]
    while len(out) < 2 or out[-2] <= top:
        out.append(max(2 * out[-1], out[-1] * 100 // percent + 1))
    return np.array(out)


def _slabs(size: np.ndarray, percent: int, ahead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sets of these sizes in their own (ahead 0) or the next interval (1): interval, slabs in all, slabs to enter (0: none)."""
    first = edges(2 * int(size.max(initial=1)) + 2, percent)
    interval = np.searchsorted(first, size, side="right") - 1 + ahead
    largest = first[np.clip(interval + 1, 0, len(first) - 1)] - 1
    partner = size * 100 // percent  # the largest size that can link
    inside = size > 0
    if ahead:
        inside &= partner >= first[np.clip(interval, 0, len(first) - 1)]
    most = (100 - percent) * 2 * largest // (100 + percent)
    total = np.where(inside, most + 1 + np.ceil(SPARE * most).astype(np.int64), 0)
    enter = (100 - percent) * (size + np.minimum(largest, partner)) // (100 + percent) + 1
    return interval, total, np.where(inside, np.minimum(enter, total), 0)


def leaves(h: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of consecutive sets -> (leaf, number of the set): the cells that each set enters."""
    size = np.diff(bounds)
    number = np.repeat(np.arange(len(size)), size)
    mixed = mix(h ^ np.uint64(0xA24BAED4963EE407))
    out = []
    for ahead in (0, 1):
        interval, total, enter = _slabs(size, percent, ahead)
        base = np.concatenate([[0], np.cumsum(total)])
        own = total[number] > 0
        part = ((h[own] >> np.uint64(32)) * total[number[own]].astype(np.uint64)) >> np.uint64(32)
        place = base[number[own]] + part.astype(np.int64)
        full = np.bincount(place, minlength=base[-1])
        digest = np.zeros(base[-1], dtype=np.uint64)
        if len(place):
            starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            digest[place[starts]] = np.add.reduceat(mixed[own], starts)
        owner = np.repeat(np.arange(len(size)), total)
        slab = (np.arange(base[-1]) - base[owner]).astype(np.uint64)
        digest = mix(digest + interval[owner].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + slab * np.uint64(0x165667B19E3779F9))
        # the order is one of contents alone, so it is the same in both sets of a pair
        order = np.lexsort((digest, -full, owner))
        order = order[np.arange(len(order)) - base[owner[order]] < enter[owner[order]]]
        out.append((digest[order], owner[order]))
    return np.concatenate([x[0] for x in out]).view(np.int64), np.concatenate([x[1] for x in out])


def _keys(h: np.ndarray, bounds: np.ndarray, seed: int) -> list[bytes | None]:
    return [hashlib.blake2b(h[a:b].tobytes(), digest_size=16, salt=seed.to_bytes(8, "little")).digest() if b > a else None for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _point(keys: list[bytes | None]) -> np.ndarray:
    """A set's number: the first 8 bytes of its digest."""
    return np.frombuffer(b"".join((k or bytes(16))[:8] for k in keys), dtype=np.int64)


def _sets_of(batch: pa.RecordBatch, n: int):
    """Blocks of a batch: slice of its rows, sorted distinct shingle hashes, bounds."""
    for w in words(batch.column("text")):
        h, bounds = distinct_by_document(*shingles(w, n), w.n_docs)
        yield batch.slice(w.first, w.n_docs), h, bounds


def _rows(n: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, h, bounds in _sets_of(batch, n):
                keys = _keys(h, bounds, seed)
                empty = np.diff(bounds) == 0
                columns = [part.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), part.column("row_hash"), pa.array(_point(keys), pa.int64(), mask=empty), pa.array(keys, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _ROW.split(", ")])

    return run


def _entries(n: int, percent: int, seed: int):
    """(leaf, point, n): the cells that each point enters, once a task for equal sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, h, bounds in _sets_of(batch, n):
                point, size = _point(_keys(h, bounds, seed)), np.diff(bounds)
                fresh = np.zeros(len(size), dtype=bool)
                for k in np.flatnonzero(size):
                    fresh[k] = int(point[k]) not in seen
                    if len(seen) < REMEMBERED:
                        seen.add(int(point[k]))
                leaf, owner = leaves(h[np.repeat(fresh, size)], np.concatenate([[0], np.cumsum(size[fresh])]), percent)
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(point[fresh][owner]), pa.array(size[fresh][owner].astype(np.int32))], names=["leaf", "point", "n"])

    return run


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries in order of (leaf, point) those of leaves with two points or more, with the leaf's first point as hub.

    Only the last row seen, its leaf's first one, and whether it is out already pass from batch to batch.
    """
    held, hub, out = None, None, False
    for batch in batches:
        leaf, point, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("leaf", "point", "n"))
        if held is not None:
            leaf, point, n = (np.concatenate([[x], column]) for x, column in zip(held, (leaf, point, n), strict=True))
        if not len(leaf):
            continue
        new = np.ones(len(leaf), dtype=bool)
        new[1:] = (leaf[1:] != leaf[:-1]) | (point[1:] != point[:-1])
        leaf, point, n = leaf[new], point[new], n[new]
        start = np.ones(len(leaf), dtype=bool)
        start[1:] = leaf[1:] != leaf[:-1]
        run = np.cumsum(start) - 1
        first = np.flatnonzero(start)
        several = np.diff(np.concatenate([first, [len(leaf)]])) > 1
        hubs, hub_n = point[first].copy(), n[first].copy()
        if held is not None:
            hubs[0], hub_n[0] = hub
            several[0] |= out
        emit = several[run]
        if held is not None:
            emit[0] &= not out
        yield pa.RecordBatch.from_arrays([pa.array(x[emit].astype(np.int64)) for x in (leaf, point, n, hubs[run], hub_n[run])], names=[f.split()[0] for f in _CELL.split(", ")])
        held, hub, out = (leaf[-1], point[-1], n[-1]), (hubs[-1], hub_n[-1]), bool(several[-1])


def _vectors(n: int, seed: int):
    """(point, counts, members): count vectors and sets, once a task for equal sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, h, bounds in _sets_of(batch, n):
                point, docs = _point(_keys(h, bounds, seed)), len(bounds) - 1
                place = np.repeat(np.arange(docs), np.diff(bounds)) * FOLD + (h & np.uint64(FOLD - 1)).astype(np.int64)
                counts = np.minimum(np.bincount(place, minlength=docs * FOLD), FULL).astype("<u2").reshape(docs, FOLD)
                fresh = []
                for k in np.flatnonzero(np.diff(bounds)):
                    if int(point[k]) not in seen:
                        fresh.append(k)
                        if len(seen) < REMEMBERED:
                            seen.add(int(point[k]))
                members = h.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(point[fresh], pa.int64()), pa.array([counts[k].tobytes() for k in fresh], pa.binary()), pa.array([members[bounds[k] : bounds[k + 1]] for k in fresh], pa.list_(pa.int64()))],
                    names=["point", "counts", "members"],
                )

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    """Count vectors of a binary column, one in a row."""
    return np.frombuffer(b"".join(x.as_py() for x in column), dtype="<u2").reshape(-1, FOLD)


def minima(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Summed coordinate minima of count vectors along the last axis; a coordinate where both are FULL bounds nothing."""
    low = np.minimum(a, b)
    out = low.sum(axis=-1, dtype=np.int64)
    return np.where((low == FULL).any(axis=-1), np.iinfo(np.int32).max, out)


def _passing(percent: int):
    """Of pairs of points or of boxes those that the bound allows to link; na and nb are sizes, or the least sizes inside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            keep = minima(_matrix(batch.column("ca")), _matrix(batch.column("cb"))) * (100 + percent) >= size * percent
            yield batch.select([c for c in batch.schema.names if c not in ("ca", "cb")]).filter(pa.array(keep))

    return run


def _verified(pairs: DataFrame, vectors: DataFrame, percent: int, tables: Tables) -> DataFrame:
    """Of (a, b, na, nb) those that link: sizes, then the bound, then the sets of what is left."""
    # overlap * (100 + p) >= p * (na + nb) is overlap / union >= p / 100
    alike = pairs.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    side = lambda x, c: vectors.select(F.col("point").alias(x), F.col(c).alias(f"{c[0]}{x}"))
    met = alike.join(side("a", "counts"), "a").join(side("b", "counts"), "b")
    left = tables.write(met.mapInArrow(_passing(percent), "a long, b long, na long, nb long"), "passing")
    both = left.join(side("a", "members"), "a").join(side("b", "members"), "b")
    return both.filter(F.size(F.array_intersect("ma", "mb")) * (100 + percent) >= (F.col("na") + F.col("nb")) * percent).select("a", "b")


def _lesser(homes: pa.ListArray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells below leaf that each point of a page is in, one after the other, and the points' bounds in them."""
    flat = homes.flatten().to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(homes.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    keep = flat < leaf
    return flat[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]


def _meet(percent: int):
    """Pairs of points of two pages, in different components, that the bound allows to link and that no lesser cell has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(np.zeros(0, np.int64),) * 4]
            for k in range(batch.num_rows):
                one, two = ({c: batch.column(c + x)[k].values.to_numpy(zero_copy_only=False) for c in ("points", "labels", "sizes")} | {"counts": np.frombuffer(batch.column("counts" + x)[k].as_py(), dtype="<u2").reshape(-1, FOLD)} for x in ("", "2"))
                same = batch.column("node")[k].as_py() == batch.column("node2")[k].as_py()
                (lesser, at), (lesser2, at2) = (_lesser(batch.column("homes" + x)[k].values, batch.column("leaf")[k].as_py()) for x in ("", "2"))
                owner2 = np.repeat(np.arange(len(at2) - 1), np.diff(at2))
                for i, p in enumerate(one["points"]):
                    m, n = one["sizes"][i], two["sizes"]
                    open_ = (two["labels"] != one["labels"][i]) & (np.minimum(m, n) * 100 >= np.maximum(m, n) * percent)
                    if same:
                        open_ &= two["points"] > p
                    j = np.flatnonzero(open_)
                    if len(j):
                        j = j[minima(one["counts"][i], two["counts"][j]) * (100 + percent) >= (m + n[j]) * percent]
                    if len(j) and at[i] < at[i + 1]:
                        elsewhere = np.zeros(len(n), dtype=bool)
                        elsewhere[owner2[np.isin(lesser2, lesser[at[i] : at[i + 1]])]] = True
                        j = j[~elsewhere[j]]
                    if len(j):
                        q, nq, swap = two["points"][j], n[j], two["points"][j] < p
                        found.append((np.where(swap, q, p), np.where(swap, p, q), np.where(swap, nq, m), np.where(swap, m, nq)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[c] for f in found]).astype(np.int64)) for c in range(4)], names=["a", "b", "na", "nb"])

    return run


def _page(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Points of a page -> its least size, bounding box and columns."""
    for batch in batches:
        out: list[tuple] = []
        for k in range(batch.num_rows):
            p = batch.column("p")[k].values
            counts = _matrix(p.field("counts"))
            out.append((min(p.field("n").to_pylist()), counts.max(axis=0).tobytes(), p.field("point"), p.field("label"), p.field("n"), p.field("homes"), counts.tobytes()))
        kinds = (pa.int64(), pa.binary(), *(pa.list_(pa.int64()),) * 3, pa.list_(pa.list_(pa.int64())), pa.binary())
        cells = [pa.array([x[c].to_pylist() if c in (2, 3, 4, 5) else x[c] for x in out], t) for c, t in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("leaf"), batch.column("node"), *cells], names=[f.split()[0] for f in _PAGE.split(", ")])


def _parent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Boxes of the nodes below -> the box around them."""
    for batch in batches:
        boxes = [_matrix(x.values).max(axis=0).tobytes() for x in batch.column("boxes")]
        yield pa.RecordBatch.from_arrays([batch.column("leaf"), batch.column("node"), batch.column("least"), pa.array(boxes, pa.binary())], names=["leaf", "node", "least", "box"])


def _descend(above: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes (leaf, up, up2) -> pairs of the nodes below them (leaf, node, node2) that their boxes allow."""
    one = nodes.select("leaf", F.floor(F.col("node") / FAN).alias("up"), "node", F.col("least").alias("na"), F.col("box").alias("ca"))
    two = nodes.select("leaf", F.floor(F.col("node") / FAN).alias("up2"), F.col("node").alias("node2"), F.col("least").alias("nb"), F.col("box").alias("cb"))
    met = above.join(one, ["leaf", "up"]).join(two, ["leaf", "up2"]).filter("node <= node2")
    passed = met.select("leaf", "node", "node2", "na", "nb", "ca", "cb").mapInArrow(_passing(percent), "leaf long, node long, node2 long, na long, nb long")
    return passed.select("leaf", "node", "node2")


def _search(cells: DataFrame, vectors: DataFrame, percent: int, tables: Tables) -> DataFrame:
    """(leaf, point, n, label) -> pairs (a, b, na, nb) of points of a cell and different components that the tree does not rule out, each once."""
    spark = cells.sparkSession
    quiet = tables.session({"spark.sql.execution.arrow.maxRecordsPerBatch": "32"})  # a row may hold two pages
    # a point's place comes from how many smaller ones its cell has, counted by size, and a hash among those of its size
    alike = cells.groupBy("leaf", "n").agg(F.count("*").alias("alike"))
    smaller = Window.partitionBy("leaf").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    page = F.greatest(F.lit(1), F.least(F.lit(PAGE), F.floor(PAGE * WIDE / F.max("n").over(Window.partitionBy("leaf")))))
    alike = alike.withColumns({"smaller": F.coalesce(F.sum("alike").over(smaller), F.lit(0)), "page": page})
    placed = cells.join(alike, ["leaf", "n"]).withColumn("node", F.floor((F.col("smaller") + F.pmod(F.xxhash64("point"), F.col("alike"))) / F.col("page")))
    homes = cells.groupBy("point").agg(F.collect_set("leaf").alias("homes"))
    known = placed.join(vectors.select("point", "counts"), "point").join(homes, "point")
    points = known.groupBy("leaf", "node").agg(F.collect_list(F.struct("point", "label", "n", "homes", "counts")).alias("p"))
    pages = tables.write(tables.write(points, "grouped", quiet).mapInArrow(_page, _PAGE), "pages")
    levels = [pages.select("leaf", "node", "least", "box")]
    while (levels[-1].agg(F.max("node")).first()[0] or 0) >= FAN:
        up = levels[-1].groupBy("leaf", F.floor(F.col("node") / FAN).alias("node")).agg(F.min("least").alias("least"), F.collect_list("box").alias("boxes"))
        levels.append(tables.write(up.mapInArrow(_parent, "leaf long, node long, least long, box binary"), "level"))
    pairs = levels[-1].select("leaf", F.lit(0).cast("long").alias("up"), F.lit(0).cast("long").alias("up2")).distinct()
    for nodes in reversed(levels):
        pairs = tables.write(_descend(pairs, nodes, percent), "nodes").select("leaf", F.col("node").alias("up"), F.col("node2").alias("up2"))
    pairs = pairs.select("leaf", F.col("up").alias("node"), F.col("up2").alias("node2"))
    inner = ("points", "labels", "sizes", "homes", "counts")
    one, two = pages.select("leaf", "node", *inner), pages.select("leaf", F.col("node").alias("node2"), *[F.col(c).alias(f"{c}2") for c in inner])
    met = pairs.join(one, ["leaf", "node"]).join(two, ["leaf", "node2"]).mapInArrow(_meet(percent), "a long, b long, na long, nb long")
    return tables.write(met, "met", spark)


def _unlike(cells: DataFrame) -> DataFrame:
    """(leaf, point, label) -> leaf, size of the cells with different components; of cells with the same points one."""
    marks = [F.bit_xor(F.xxhash64("point")).alias("x"), F.bit_xor(F.xxhash64("point", F.lit(1))).alias("y")]
    several = cells.groupBy("leaf").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"), *marks)
    return several.filter("low < high").groupBy("size", "x", "y").agg(F.min("leaf").alias("leaf")).select("leaf", "size")


def _lacking(points: DataFrame, vectors: DataFrame, percent: int) -> DataFrame:
    """(middle, point, n, ...) with beyond, the point's members that its middle lacks, in order, and most.

    most is the largest symmetric difference that a point of n members can have from one that it links to.
    """
    salt = F.pmod(F.xxhash64("point"), F.lit(SALTS)).cast("int").alias("salt")
    copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    middles = points.select("middle").distinct().join(vectors.select(F.col("point").alias("middle"), F.col("members").alias("base")), "middle")
    met = points.join(vectors.select("point", "members"), "point").select("*", salt).join(middles.select("*", copies), ["middle", "salt"])
    partner = F.floor(F.col("n") * 100 / percent)
    most = F.floor((100 - percent) * (F.col("n") + partner) / (100 + percent)).alias("most")
    return met.select(*points.columns, F.array_sort(F.array_except("members", "base")).alias("beyond"), most)


def _cut(cells: DataFrame, vectors: DataFrame, percent: int, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Large cells (leaf, point, n, label, middle, size) -> smaller cells (leaf, point, n, label), and pairs (a, b, na, nb).

    Let r be how many members of a point its middle lacks, and d the most that it may differ by from a partner. Two linked
    points share at least (r + r' - d) / 2 of those, so more than (2 r - d) / 4 where both are heavy: 2 r > d. The first
    members in order, all but that many, then meet in one at least, and name the cells below. Pairs with a light point are
    made one by one. A middle whose cells would not get cheaper so, counted in pairs, keeps them as they are.
    """
    points = tables.write(cells.select("middle", "point", "n", "label").distinct(), "points")
    r, most = F.size("beyond"), F.col("most")
    light = (2 * r <= most).alias("light")
    own = F.when(2 * r > most, F.slice("beyond", 1, (r - F.floor((2 * r - most) / 4)).cast("int")))
    named = tables.write(_lacking(points, vectors, percent).select("middle", "point", "n", "label", light, own.alias("own")), "named")
    below = named.select("middle", "point", "n", "label", F.explode("own").alias("member"))
    below = tables.write(below.select("middle", F.xxhash64("middle", "member").alias("leaf"), "point", "n", "label"), "below")
    of_cells = lambda rows: rows.groupBy("middle", "leaf").agg(F.count("*").cast("double").alias("size")).groupBy("middle")
    before = of_cells(cells).agg(F.sum(F.col("size") * F.col("size")).alias("before"))
    after = of_cells(below).agg(F.sum(F.when(F.col("size") > 1, F.col("size") * F.col("size")).otherwise(0.0)).alias("after"))
    lights = named.groupBy("middle").agg((F.count("*") * F.count_if("light") * LIGHT_COST).alias("lights"))
    costs = before.join(after, "middle", "left").join(lights, "middle", "left")
    cheaper = tables.write(costs.filter(F.coalesce("after", F.lit(0.0)) + F.col("lights") < F.col("before")).select("middle"), "cheaper")

    inside = below.join(small_enough(cheaper), "middle", "left_semi").select("leaf", "point", "n", "label")
    kept = cells.join(small_enough(cheaper), "middle", "left_anti").select("leaf", "point", "n", "label")
    cut = tables.write(kept.unionByName(inside.join(_unlike(inside), "leaf", "left_semi")), "cut")
    salted = named.join(small_enough(cheaper), "middle", "left_semi").select("middle", "point", "n", "label", "light", F.pmod(F.xxhash64("point"), F.lit(SALTS)).cast("int").alias("salt"))
    copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    one = salted.filter("light").select("middle", F.col("point").alias("p"), F.col("n").alias("np"), F.col("label").alias("lp"), copies)
    met = one.join(salted, ["middle", "salt"]).filter("lp <> label and (not light or p < point)")
    first = F.col("p") < F.col("point")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y)).cast("long")
    pairs = met.select(pick("p", "point").alias("a"), pick("point", "p").alias("b"), pick("np", "n").alias("na"), pick("n", "np").alias("nb"))
    return cut, tables.write(pairs.distinct(), "pairs")


def _merged(label: DataFrame, links: DataFrame, tables: Tables) -> DataFrame:
    """(id, label) of components, with further links (a, b)."""
    if links.isEmpty():
        return label
    return components(label.select(F.col("id").alias("a"), F.col("label").alias("b")).unionByName(links), tables)


def _components(docs: DataFrame, n: int, percent: int, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n_shingles, row_hash, point, set_id), and (point, root, component_id) of points with copies or links."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text", F.lit(7)).alias("row_hash"))
    seed = 0
    while True:  # ends at the first seed: 64 bits of different sets' digests must not be equal
        rows = tables.write(named.mapInArrow(_rows(n, seed), _ROW), "rows")
        owner = rows.filter("doc_id is not null and point is not null").groupBy("point").agg(F.min("doc_id").alias("own"), F.count("*").alias("copies"), F.min("set_id").alias("low"), F.max("set_id").alias("high"))
        owner = tables.write(owner, "owner")
        if owner.filter("low <> high").isEmpty():
            break
        seed += 1
    known = named.filter("doc_id is not null").select("doc_id", "text")
    entries = known.mapInArrow(_entries(n, percent, seed), "leaf long, point long, n int")
    cells = tables.write(entries.repartition("leaf").sortWithinPartitions("leaf", "point").mapInArrow(_cells, _CELL), "cells")

    ids = tables.write(cells.select("point").distinct().join(owner.select("point", "own"), "point").select(F.col("own").alias("doc_id")).distinct(), "ids")
    texts = known.join(small_enough(ids), "doc_id", "left_semi")
    vectors = tables.write(texts.mapInArrow(_vectors(n, seed), "point long, counts binary, members array<long>").dropDuplicates(["point"]), "vectors")

    star = cells.filter("hub <> point").select(F.col("hub").alias("a"), F.col("point").alias("b"), F.col("hub_n").alias("na"), F.col("n").alias("nb")).distinct()
    links = tables.write(_verified(star, vectors, percent, tables), "links")
    label = components(links, tables)

    # cells with different components left meet their point of most links, which stands in the middle of a group of near copies
    degree = links.select(F.explode(F.array("a", "b")).alias("point")).groupBy("point").agg(F.count("*").alias("degree"))
    named = cells.join(label.withColumnRenamed("id", "point"), "point", "left").join(degree, "point", "left").withColumns({"label": F.coalesce("label", "point"), "degree": F.coalesce("degree", F.lit(0))})
    best = named.groupBy("leaf").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max(F.struct("degree", "point", "n", "label")).alias("best"))
    second = tables.write(named.join(best.filter("low < high").select("leaf", "best"), "leaf").select("leaf", "point", "n", "label", "hub", "best"), "second")
    untried = second.filter("label <> best.label and point <> hub and best.point <> hub")
    star = untried.select(F.col("best.point").alias("a"), F.col("point").alias("b"), F.col("best.n").alias("na"), F.col("n").alias("nb")).distinct()
    label = _merged(label, tables.write(_verified(star, vectors, percent, tables), "links"), tables)

    # all pairs with those two points have been tried; of cells with the same other points one is searched
    rest = second.filter("point <> hub and point <> best.point").select("leaf", "point", "n", F.col("best.point").alias("middle"))
    rest = rest.join(label.withColumnRenamed("id", "point"), "point", "left").withColumn("label", F.coalesce("label", "point"))
    open_ = tables.write(rest.join(_unlike(rest), "leaf"), "open")
    large = open_.filter(F.col("size") > LARGE)
    cells, pairs = open_.select("leaf", "point", "n", "label"), None
    if not large.isEmpty():
        cut, pairs = _cut(large, vectors, percent, tables)
        cells = open_.filter(F.col("size") <= LARGE).select("leaf", "point", "n", "label").unionByName(cut)
    found = _search(cells, vectors, percent, tables)
    found = found if pairs is None else found.unionByName(pairs).distinct()
    label = _merged(label, tables.write(_verified(found, vectors, percent, tables), "links"), tables)

    base = owner.select("point", "own", "copies").join(label.withColumnRenamed("id", "point"), "point", "left").filter("copies > 1 or label is not null")
    base = base.select("point", "own", F.coalesce("label", "point").alias("root"))
    least = base.groupBy("root").agg(F.min("own").alias("component_id"))
    return rows, tables.write(base.join(least, "root").select("point", "root", "component_id"), "roots")


def ngram_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text, ...) -> one row per input row: doc_id, n_shingles, component_id.

    Rows link when 100 * intersection >= percent * union of their sets of distinct n-word shingles; component_id
    is the smallest doc_id reachable. Null or wordless text: n_shingles 0, linked with nothing, its component is its
    doc_id. Null doc_id: it links with nothing and its component_id is null. Rows that share a doc_id are still rows of
    their own: each has the component of its text. Repeated rows give equal rows. An empty table gives no rows. Other
    columns are ignored. percent is 51 to 99.
    """
    with Tables(docs.sparkSession) as tables:
        rows, roots = _components(docs, n, percent, tables)
        out = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("point")).alias("point"))
        out = out.join(small_enough(roots.select("point", "component_id")), "point", "left")
        return materialize(out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")), "components")


def keep_one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows of near-duplicate groups but one each: that of the smallest doc_id, then text hash.

    Rows without words or doc_id stay. Of rows with the same doc_id and text, one stays if they have words. Rows that
    share a doc_id but not a text are judged apart. All columns of docs stay as they are; an empty table stays empty.
    """
    row = F.struct("doc_id", "row_hash")
    with Tables(docs.sparkSession) as tables:
        rows, roots = _components(docs, n, percent, tables)
        named = rows.filter("doc_id is not null").select("doc_id", "row_hash", "point").join(small_enough(roots.select("point", "root")), "point").select("root", "doc_id", "row_hash")
        counted = tables.write(named.groupBy("root", "doc_id", "row_hash").agg(F.count("*").alias("times")), "members")
        first = counted.groupBy("root").agg(F.min(row).alias("first"))
        judged = counted.join(first, "root").select(F.col("doc_id").alias("__id"), F.col("row_hash").alias("__row"), (row == F.col("first")).alias("__first"), "times")
        judged = materialize(judged.filter("not __first or times > 1").select("__id", "__row", "__first"), "gone")
    hashed = docs.withColumn("__hash", F.xxhash64("text", F.lit(7)))
    gone = small_enough(judged)
    met = hashed.join(gone, (F.col("doc_id").cast("long") == F.col("__id")) & (F.col("__hash") == F.col("__row")), "left")
    repeated = judged.filter("__first")
    if repeated.isEmpty():
        return met.filter("__id is null").select(*docs.columns)
    again = met.filter("__first").dropDuplicates(["__id", "__row"])
    return met.filter("__id is null").select(*docs.columns).unionByName(again.select(*docs.columns))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents by four-word shingles at 85 percent; nulls and repeats as in ngram_components."""
    return ngram_components(documents(spark, sf_dir), n=4, percent=85)


OP3_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents
), s as (
  select doc_id, list_distinct(case when len(ws) = 0 then cast([] as varchar[]) when len(ws) < 4 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) end) as sh from w
), d as (select doc_id, cast(len(sh) as bigint) as n from s
), e as (select doc_id, unnest(sh) as sh from s
), common as (
  select x.doc_id as a, y.doc_id as b, count(*) as k from e x join e y on x.sh = y.sh and x.doc_id < y.doc_id group by 1, 2
), links as (
  select a, b from common join d p on p.doc_id = a join d q on q.doc_id = b where 100 * k >= 85 * (p.n + q.n - k)
), both_ways as (select a, b from links union all select b, a from links
), reach as (
  select doc_id, doc_id as other from d union select r.doc_id, x.b from reach r join both_ways x on r.other = x.a
)
select d.doc_id, d.n as n_shingles, min(r.other) as component_id from d join reach r using (doc_id) group by 1, 2
"""
