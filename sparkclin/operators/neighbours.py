"""Exact k-nearest-neighbour join, and nearest-neighbour imputation (D18) built on it.

Points are dealt to the leaves of a k-d tree whose depth follows the row count, so a leaf holds about ``LEAF_ROWS``
points at every size. The tree is nested: its upper ``TOP_DEPTH`` levels are fitted on a hashed sample of all points,
the levels below on a sample of each upper leaf, one task a leaf. It is a table of cuts (12 bytes a leaf, at
most 2^``MAX_DEPTH`` leaves) and only steers which points meet: results are exact whatever the sample.

A query is first measured against its own leaf, which bounds its k-th distance; then it is sent to the other leaves that
reach into that ball, found by walking the cuts. A task holds the points of one leaf and at most about ``CHUNK``
queries, measures them part by part of the leaf, and lets only the ``k`` best of a query leave. Of equal points only the
``k + 1`` with the smallest ids are kept: no other can be among the nearest, and copies can't pile up in a leaf.

Points and queries belong to a ``space``; only those of one space meet. Spaces may differ in dimension.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkclin.functions.exprs import q
from sparkclin.session import stored

LEAF_ROWS = 1024
TOP_DEPTH = 10
MAX_DEPTH = 20
SAMPLE = 64       # sampled points a leaf
CHUNK = 4096      # queries that meet a leaf in one task
PART = 64         # points of a leaf that a query meets at once
BLOCK_CELLS = 1 << 20  # distances held at once


# ------------------------------------------------------------------ the tree, as arrays in heap order
def fit_tree(points: np.ndarray, depth: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(dimension, cut) of each inner node. A node is cut at the median of its widest dimension if both sides keep
    ``least`` points; otherwise its cut is infinite and everything goes left."""
    dims, cuts = np.zeros((1 << depth) - 1, np.int16), np.full((1 << depth) - 1, np.inf)
    held = {0: np.arange(len(points))}
    for node in range(len(dims)):
        rows = held.pop(node, None)
        if rows is None or len(rows) < 2 * least:
            continue
        part = points[rows]
        for dim in np.argsort(part.min(axis=0) - part.max(axis=0), kind="stable"):
            x = part[:, dim]
            cut = np.sort(x)[len(x) // 2]
            if (x < cut).sum() < least:  # many ties at the median: cut above them
                above = x[x > cut]
                if not len(above):
                    continue
                cut = above.min()
            left = x < cut
            if min(left.sum(), (~left).sum()) >= least:
                dims[node], cuts[node] = dim, cut
                held[2 * node + 1], held[2 * node + 2] = rows[left], rows[~left]
                break
    return dims, cuts


def leaf_of(tree: tuple[np.ndarray, np.ndarray], points: np.ndarray) -> np.ndarray:
    dims, cuts = tree
    node, row = np.zeros(len(points), np.int64), np.arange(len(points))
    for _ in range((len(dims) + 1).bit_length() - 1):
        node = 2 * node + 1 + (points[row, dims[node]] >= cuts[node])
    return node - len(dims)


def leaves_within(tree: tuple[np.ndarray, np.ndarray], points: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of all leaves whose region is within the row's ``bound``."""
    dims, cuts = tree
    bound = bound * bound
    row, node = np.arange(len(points)), np.zeros(len(points), np.int64)
    gap, off = np.zeros(len(points)), np.zeros(points.shape)
    for _ in range((len(dims) + 1).bit_length() - 1):
        dim, cut = dims[node], cuts[node]
        x, at = points[row, dim], np.arange(len(row))
        right = x >= cut
        step = (x - cut) ** 2
        far_gap = gap - off[at, dim] + step
        far = np.flatnonzero(~(far_gap > bound[row]) & np.isfinite(cut))  # beyond an infinite cut there is nothing
        far_off = off[far]
        far_off[np.arange(len(far)), dim[far]] = step[far]
        node = np.concatenate([2 * node + 1 + right, 2 * node[far] + 2 - right[far]])
        row, gap, off = np.concatenate([row, row[far]]), np.concatenate([gap, far_gap[far]]), np.concatenate([off, far_off])
    return row, node - len(dims)


def nearest_of(queries: np.ndarray, points: np.ndarray, same: tuple[np.ndarray, np.ndarray], k: int, bound: np.ndarray):
    """(query, point, distance) of each query's ``k`` nearest points up to its bound; ties to the earlier point.

    ``same`` holds a code of the id of each query and point: a query doesn't meet its own id.
    """
    out = []
    size = max(1, BLOCK_CELLS // max(1, len(points)))
    for lo in range(0, len(queries), size):
        part = queries[lo:lo + size]
        d = np.zeros((len(part), len(points)))
        for j in range(points.shape[1]):  # dimension by dimension, in order: the sum is that of any row-wise engine
            diff = part[:, j, None] - points[None, :, j]
            d += diff * diff
        np.sqrt(d, out=d)
        d[same[0][lo:lo + size, None] == same[1][None, :]] = np.inf
        kth = np.partition(d, k - 1, axis=1)[:, k - 1] if len(points) > k else np.full(len(part), np.inf)
        a, b = np.nonzero((d <= np.minimum(kth, bound[lo:lo + size])[:, None]) & np.isfinite(d))
        dist = d[a, b]
        order = np.lexsort((b, dist, a))
        a, b, dist = a[order], b[order], dist[order]
        keep = np.arange(len(a)) - np.searchsorted(a, a) < k
        out.append((a[keep] + lo, b[keep], dist[keep]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)


def nearest_in_leaf(queries: np.ndarray, points: np.ndarray, same: tuple[np.ndarray, np.ndarray], k: int, bound: np.ndarray):
    """``nearest_of`` over a leaf's own small tree: a query meets its part of the leaf, then parts within its k-th distance."""
    depth = max(0, math.ceil(math.log2(max(1, len(points)) / PART)))
    if not depth or not len(queries):
        return nearest_of(queries, points, same, k, bound)
    tree = fit_tree(points, depth, max(8, k + 2))

    def by_part(part: np.ndarray) -> dict[int, np.ndarray]:
        order = np.argsort(part, kind="stable")
        return {part[rows[0]]: rows for rows in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(rows)}

    held, out = by_part(leaf_of(tree, points)), []

    def meet(row: np.ndarray, part: np.ndarray, reach: np.ndarray) -> None:
        for p, at in by_part(part).items():
            if p in held:
                mine, its = row[at], held[p]
                a, b, d = nearest_of(queries[mine], points[its], (same[0][mine], same[1][its]), k, reach[mine])
                out.append((mine[a], its[b], d))

    home = leaf_of(tree, queries)
    meet(np.arange(len(queries)), home, bound)
    a, d = (np.concatenate([x[i] for x in out]) if out else np.zeros(0) for i in (0, 2))
    a = a.astype(np.int64)
    far = np.zeros(len(queries))
    np.maximum.at(far, a, d)
    full = np.bincount(a, minlength=len(queries)) == k
    reach = np.where(full, np.minimum(bound, far * (1 + 1e-9) + 1e-150), bound)
    row, part = leaves_within(tree, queries, reach)
    other = part != home[row]
    meet(row[other], part[other], reach)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    a, b, d = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((b, d, a))
    a, b, d = a[order], b[order], d[order]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[keep], b[keep], d[keep]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


# ------------------------------------------------------------------ Spark steps
def _fit_spaces(points: DataFrame, least: int, leaf_rows: int, top_depth: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The tree of every space, fitted in tasks on samples of bounded expected size; the driver gets only cuts."""
    sizes = {r.space: r["count"] for r in points.groupBy("space").count().collect()}  # one row a space
    depth = {s: min(MAX_DEPTH, max(0, math.ceil(math.log2(n / leaf_rows)))) for s, n in sizes.items()}
    spark = points.sparkSession

    def sample(upto: dict[int, int]) -> DataFrame:
        share = spark.createDataFrame([(s, min(1.0, (SAMPLE << upto[s]) / sizes[s])) for s in sizes], "space int, share double")
        place = F.pmod(F.xxhash64("id", "vec"), F.lit(1 << 30)) / float(1 << 30)
        return points.join(F.broadcast(share), "space").where(place < F.col("share")).select("space", "vec")

    def fit(depths: dict[int, int]):
        def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            dims, cuts = fit_tree(_matrix(table.column("vec")), depths[key[0].as_py()], least)
            row = {"space": [key[0].as_py()], "top": [key[1].as_py()], "dims": [dims.tolist()], "cuts": [cuts.tolist()]}
            return pa.table(row, schema=pa.schema([("space", pa.int32()), ("top", pa.int64()), ("dims", pa.list_(pa.int16())),
                                                   ("cuts", pa.list_(pa.float64()))]))
        return run

    schema = "space int, top long, dims array<short>, cuts array<double>"
    upper = {s: min(d, top_depth) for s, d in depth.items()}
    rows = sample(upper).withColumn("top", F.lit(0).cast("long")).groupBy("space", "top").applyInArrow(fit(upper), schema).collect()
    trees = {s: (np.zeros((1 << d) - 1, np.int16), np.full((1 << d) - 1, np.inf)) for s, d in upper.items()}
    trees |= {r.space: (np.array(r.dims, np.int16), np.array(r.cuts)) for r in rows}
    deeper = {s: d - top_depth for s, d in depth.items() if d > top_depth}
    if not deeper:
        return trees
    below = sample(depth).where(F.col("space").isin(list(deeper)))
    below = _dealt(below, {s: trees[s] for s in deeper}, "top").groupBy("space", "top").applyInArrow(fit(deeper), schema)
    nested = {}
    for s, more in deeper.items():
        dims, cuts = np.zeros((1 << depth[s]) - 1, np.int16), np.full((1 << depth[s]) - 1, np.inf)
        dims[:len(trees[s][0])], cuts[:len(trees[s][1])] = trees[s]
        nested[s] = (dims, cuts)
    for r in below.collect():  # one row an upper leaf: 2^(depth - TOP_DEPTH) cuts each
        dims, cuts = nested[r.space]
        first, at = (1 << top_depth) - 1 + r.top, 0
        for level in range(deeper[r.space]):  # a level of the subtree is a run of the whole tree's level
            n, to = 1 << level, (first + 1 << level) - 1
            dims[to:to + n], cuts[to:to + n] = r.dims[at:at + n], r.cuts[at:at + n]
            at += n
    return trees | nested


def _dealt(rows: DataFrame, trees: dict[int, tuple[np.ndarray, np.ndarray]], name: str = "leaf") -> DataFrame:
    """``rows`` with the leaf of each row's vector in its space's tree."""
    known = rows.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            space = b.column("space").to_numpy()
            leaf = np.zeros(len(space), np.int64)
            for s in set(space.tolist()) & set(known.value):
                mine = np.flatnonzero(space == s)
                leaf[mine] = leaf_of(known.value[s], _matrix(b.column("vec").take(pa.array(mine))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], names=[*b.schema.names, name])

    return rows.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in rows.dtypes) + f", {name} long")


def _sent(rows: DataFrame, trees: dict[int, tuple[np.ndarray, np.ndarray]], kind: str) -> DataFrame:
    """Each bounded query once for every leaf but its own that may hold a nearer point."""
    known = rows.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                space, home, bound = (b.column(c).to_numpy() for c in ("space", "leaf", "bound"))
                for s in set(space.tolist()) & set(known.value):
                    mine = np.flatnonzero(space == s)
                    row, leaf = leaves_within(known.value[s], _matrix(b.column("vec").take(pa.array(mine))), bound[mine])
                    other = leaf != home[mine][row]
                    row, leaf = pa.array(mine[row[other]]), leaf[other]
                    yield pa.RecordBatch.from_arrays([*(b.column(c).take(row) for c in ("space", "id", "vec", "bound")),
                                                      pa.array(leaf)], names=["space", "id", "vec", "bound", "leaf"])

    return rows.select("space", "id", "vec", "bound", "leaf").mapInArrow(
        run, f"space int, id {kind}, vec array<double>, bound double, leaf long")


def _met(queries: DataFrame, points: DataFrame, k: int, kind: str, point_kind: str) -> DataFrame:
    """``queries`` (space, id, vec, bound, leaf) with the arrays of ids and distances of the nearest points of the leaf.
    A leaf that many queries come to is dealt to several tasks, each with the leaf's points."""
    chunks = queries.groupBy("space", "leaf").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    keys = ["space", "leaf", "chunk"]
    asked = queries.join(chunks, ["space", "leaf"]).withColumn("chunk", F.pmod(F.xxhash64("id", "vec"), F.col("chunks")).cast("int"))
    held = points.join(chunks, ["space", "leaf"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))

    def task(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.sort_by("id")
        n = left.num_rows
        if n and right.num_rows:
            ids = right.column("id").combine_chunks()
            codes = pc.unique(ids)
            of_query = pc.fill_null(pc.index_in(left.column("id").combine_chunks().cast(ids.type), codes), -1).to_numpy()
            a, b, d = nearest_in_leaf(_matrix(left.column("vec")), _matrix(right.column("vec")),
                                      (of_query, pc.index_in(ids, codes).to_numpy()), k, left.column("bound").to_numpy())
        else:
            ids, a, b, d = pa.array([], right.schema.field("id").type), *[np.zeros(0, np.int64)] * 2, np.zeros(0)
        edge = pa.array(np.searchsorted(a, np.arange(n + 1)), pa.int32())
        found = pa.ListArray.from_arrays(edge, ids.take(pa.array(b)))
        return pa.table([*(left.column(c) for c in ("space", "id", "vec", "leaf")), found, pa.ListArray.from_arrays(edge, pa.array(d))],
                        names=["space", "id", "vec", "leaf", "near", "dist"])

    return asked.select(*keys, "id", "vec", "bound").groupBy(*keys).cogroup(held.select(*keys, "id", "vec").groupBy(*keys)).applyInArrow(
        task, f"space int, id {kind}, vec array<double>, leaf long, near array<{point_kind}>, dist array<double>")


def nearest(queries: DataFrame, points: DataFrame, k: int, leaf_rows: int = LEAF_ROWS, top_depth: int = TOP_DEPTH) -> DataFrame:
    """(space, id, rank, neighbour, distance): the ``k`` points of a query's space nearest by Euclidean distance.

    Both tables hold space int, id and vec array<double> without nulls, of one length within a space. A query does
    not meet points of its own id; ties go to the smaller id; fewer than ``k`` points give fewer rows.
    """
    kind, point_kind = dict(queries.dtypes)["id"], dict(points.dtypes)["id"]
    copy = F.row_number().over(Window.partitionBy("space", "vec").orderBy("id"))
    points = stored(points.select("space", "id", "vec").withColumn("copy", copy).where(F.col("copy") <= k + 1).drop("copy"), "points")
    trees = _fit_spaces(points, max(8, k + 2), leaf_rows, top_depth)
    held = stored(_dealt(points, trees), "leaves")
    asked = _dealt(queries.select("space", "id", "vec"), trees).withColumn("bound", F.lit(float("inf")))
    home = stored(_met(stored(asked, "asked"), held, k, kind, point_kind), "home")
    # A hair above the k-th distance: the cuts' sum of squares may round otherwise than the distance itself.
    bound = F.when(F.size("dist") == k, F.element_at("dist", -1) * (1 + 1e-9) + 1e-150).otherwise(float("inf"))
    others = _met(stored(_sent(home.withColumn("bound", bound), trees, kind), "sent"), held, k, kind, point_kind)
    pair = F.explode(F.arrays_zip("near", "dist")).alias("pair")
    found = home.select("space", "id", pair).unionAll(others.select("space", "id", pair))
    found = found.select("space", "id", F.col("pair.near").alias("neighbour"), F.col("pair.dist").alias("distance"))
    rank = F.row_number().over(Window.partitionBy("space", "id").orderBy("distance", "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


# ------------------------------------------------------------------ D18
def _bits(mask: int, n: int) -> list[int]:
    return [i for i in range(n) if mask >> i & 1]


def impute_knn(df: DataFrame, cols: list[str], id_col: str, k: int = 5, leaf_rows: int = LEAF_ROWS,
               top_depth: int = TOP_DEPTH) -> DataFrame:
    """Each null among ``cols`` becomes the mean of that field over the ``k`` nearest rows that have it.

    The distance of two rows is Euclidean over the fields that both have, times the root of (fields / shared fields); rows without a shared field are no neighbours; ties go to the smaller id. Such a distance is no metric over all rows,
    but it is one between rows of two null patterns: every pair of patterns that can lend a field is a space of
    the exact join, with the shared fields as its dimensions, and the lists of a row's spaces are merged by scaled
    distance. A donor is copied once for each pattern it lends to. A cell without any neighbour gets the field's mean; a
    field without values stays null. ``id_col`` identifies rows; rows with a null id lend nothing and get means. All other
    columns pass unchanged, ``cols`` become doubles; no row is dropped.
    """
    n = len(cols)
    if n > 62:
        raise ValueError("at most 62 columns at a time")
    values = F.array(*[F.col(q(c)).cast("double") for c in cols])
    mask = F.aggregate(F.transform("vals", lambda x, i: F.when(x.isNotNull() & ~F.isnan(x), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(0)),
                       F.lit(0).cast("long"), lambda s, x: s + x)
    rows = df.where(F.col(q(id_col)).isNotNull()).select(F.col(q(id_col)).alias("id"), values.alias("vals")).withColumn("mask", mask)
    rows = stored(rows, "patterns")
    masks = sorted(r["mask"] for r in rows.select("mask").distinct().collect())  # one row a null pattern
    spaces = [(need, has) for need in masks if need != (1 << n) - 1 for has in masks if has & ~need and has & need]
    spark = df.sparkSession
    means = df.agg(*[F.avg(F.nanvl(F.col(q(c)).cast("double"), F.lit(None).cast("double"))).alias(f"__m{i}") for i, c in enumerate(cols)])
    if spaces:
        table = spark.createDataFrame([(s, need, has, _bits(need & has, n), _bits(has & ~need, n)) for s, (need, has) in enumerate(spaces)],
                                      "space int, need long, has long, shared array<int>, lends array<int>")
        vec = F.transform("shared", lambda i: F.get("vals", i))
        asked = rows.join(F.broadcast(table), F.col("mask") == F.col("need")).select("space", "id", vec.alias("vec"))
        lent = rows.join(F.broadcast(table), F.col("mask") == F.col("has")).select("space", "id", vec.alias("vec"))
        found = nearest(asked, lent, k, leaf_rows, top_depth)
        scaled = found.join(F.broadcast(table), "space").select(
            "id", "neighbour", (F.col("distance") * F.sqrt(F.lit(float(n)) / F.size("shared"))).alias("scaled"),
            F.explode("lends").alias("field"))
        rank = F.row_number().over(Window.partitionBy("id", "field").orderBy("scaled", "neighbour"))
        best = scaled.withColumn("rank", rank).where(F.col("rank") <= k)
        donors = rows.select(F.col("id").alias("neighbour"), "vals")
        cells = best.join(donors, "neighbour").groupBy("id", "field").agg(F.avg(F.get("vals", F.col("field"))).alias("value"))
        filled = cells.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("__near"))  # a row a field
        out = df.join(filled.withColumnRenamed("id", "__id"), F.col(q(id_col)) == F.col("__id"), "left")
    else:
        out = df.withColumn("__near", F.lit(None).cast("map<int,double>"))
    out = out.crossJoin(F.broadcast(means))  # one row

    def cell(i: int, c: str) -> Column:
        own = F.nanvl(F.col(q(c)).cast("double"), F.lit(None).cast("double"))
        return F.coalesce(own, F.element_at("__near", F.lit(i)), F.col(f"__m{i}")).alias(c)

    number = {c: i for i, c in enumerate(cols)}
    return out.select(*[cell(number[c], c) if c in number else F.col(q(c)) for c in df.columns])
