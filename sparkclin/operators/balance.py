"""Oversampling of minority classes (SMOTE, ADASYN, borderline SMOTE) over an exact k-NN join.

The join is ``neighbours.nearest``: exact, over the nested leaves of a k-d tree whose depth follows the row count.

Which rows are repeated, their neighbour and their place between the two follow from a hash of (id, copy, seed),
so a result is the same on every cluster and in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkclin.functions.exprs import cumulative_sums, md5_bucket, q
from sparkclin.operators.neighbours import nearest

def _vectors(df: DataFrame, id_col: str, cols: list[str]) -> DataFrame:
    v = df.select(F.col(q(id_col)).alias("id"), F.array(*[F.col(q(c)).cast("double") for c in cols]).alias("vec"))
    return v.where(F.col("id").isNotNull() & F.forall("vec", lambda x: x.isNotNull()))


def knn(queries: DataFrame, points: DataFrame, id_col: str, cols: list[str], k: int) -> DataFrame:
    """(id, rank, neighbour, distance): the ``k`` nearest other points of each query by Euclidean distance.

    Ties go to the smaller id. Rows with a null id or feature take no part; fewer than k points give fewer rows.
    """
    qs, ps = (_vectors(x, id_col, cols).withColumn("space", F.lit(0)) for x in (queries, points))
    return nearest(qs, ps, k).select("id", "rank", "neighbour", "distance")


def _key(*parts: Column) -> Column:
    return F.concat_ws("|", *[p.cast("string") for p in parts])


def _hash_rank(df: DataFrame, seed: int) -> DataFrame:
    """``df`` plus ``rank`` (from 1) in the order of (hash of id and seed, id), by distributed prefix sums."""
    h = df.withColumn("__h", md5_bucket(_key(F.col("id"), F.lit(seed)), 1 << 32))
    cum = cumulative_sums(h.groupBy("__h").agg(F.count(F.lit(1)).alias("__c")), "__h", ["__c"])
    within = F.row_number().over(Window.partitionBy("__h").orderBy("id"))
    return (h.join(cum.select("__h", (F.col("cum___c") - F.col("__c")).alias("__before")), "__h")
            .withColumn("rank", F.col("__before") + within).drop("__h", "__before"))


def _class_sizes(df: DataFrame, target: str) -> tuple[list, dict]:
    sizes = {r[0]: r[1] for r in df.where(F.col(q(target)).isNotNull()).groupBy(q(target)).count().collect()}  # one row a class
    return sorted(sizes, key=lambda c: (-sizes[c], str(c))), sizes


def _interpolated(bases: DataFrame, near: DataFrame, points: DataFrame, cols: list[str], seed: int) -> DataFrame:
    """New rows of ``bases`` (id, vec, copies): each between its base and one of the base's neighbours."""
    lists = (near.join(points.select(F.col("id").alias("neighbour"), F.col("vec").alias("n_vec")), "neighbour")
             .groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "n_vec"))).alias("near")))  # k rows an id
    made = (bases.where("copies > 0").join(lists, "id")
            .select("id", "vec", "near", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")))
    pick = md5_bucket(_key(F.col("id"), F.col("copy"), F.lit(seed), F.lit("n")), 1 << 32) % F.size("near")
    gap = md5_bucket(_key(F.col("id"), F.col("copy"), F.lit(seed), F.lit("g")), 1 << 32) / float(1 << 32)
    made = made.withColumn("other", F.element_at("near", (pick + 1).cast("int"))["n_vec"]).withColumn("gap", gap)
    new = F.zip_with("vec", "other", lambda a, b: a + F.col("gap") * (b - a))
    return made.select("id", "copy", new.alias("v")).select("id", "copy", *[F.col("v")[i].alias(c) for i, c in enumerate(cols)])


def _spread(rows: DataFrame, need: int, m: int, seed: int) -> DataFrame:
    """``rows`` plus ``copies``: ``need`` copies dealt evenly over ``m`` rows, the rest to the first by hash rank."""
    return _hash_rank(rows, seed).withColumn("copies", F.lit(need // m) + (F.col("rank") <= need % m).cast("int"))


def balance(df: DataFrame, target: str, cols: list[str], id_col: str, method: str = "smote", k: int = 5,
            m_neighbours: int = 10, seed: int = 42) -> DataFrame:
    """D20 ``smote``, D21 ``adasyn``, D22 ``borderline``: original rows plus synthetic ones of every smaller class.

    Columns: id (the base row's, for a synthetic row), copy (0: an original), ``cols`` as doubles, target. Every
    class grows to the largest one's size; ADASYN deals its copies by the share of other classes among a row's
    ``k`` nearest of all rows (rounded, so totals differ by rounding), borderline SMOTE uses only rows whose
    ``m_neighbours`` nearest are mostly, but not all, of other classes. A class without a usable base row or
    neighbour stays as it is. Rows with a null feature, id or target are left out.
    """
    usable = df.where(F.col(q(target)).isNotNull()).dropna(subset=[id_col, *cols])
    out = usable.select(F.col(q(id_col)).alias("id"), F.lit(0).alias("copy"), *[F.col(q(c)).cast("double").alias(c) for c in cols],
                        F.col(q(target)).alias(target))
    kind = dict(out.dtypes)[target]
    classes, sizes = _class_sizes(out, target)
    for c in classes[1:]:
        need, m = sizes[classes[0]] - sizes[c], sizes[c]
        own = usable.where(F.col(q(target)) == F.lit(c))
        points = _vectors(own, id_col, cols)
        if need <= 0 or m < 2:
            continue
        near = knn(own, own, id_col, cols, min(k, m - 1))
        bases = points
        if method != "smote":
            around = knn(own, usable, id_col, cols, k if method == "adasyn" else m_neighbours)
            label = usable.select(F.col(q(id_col)).alias("neighbour"), (F.col(q(target)) != F.lit(c)).cast("int").alias("other"))
            share = around.join(label, "neighbour").groupBy("id").agg(F.sum("other").alias("others"), F.count(F.lit(1)).alias("n_near"))
            bases = points.join(share, "id")
        if method == "smote":
            bases = _spread(bases, need, m, seed)
        elif method == "adasyn":
            total = bases.agg(F.sum("others")).first()[0]
            if not total:
                continue
            bases = bases.withColumn("copies", F.rint(F.col("others") * F.lit(need) / F.lit(total)).cast("int"))
        elif method == "borderline":
            bases = bases.where("2 * others >= n_near AND others < n_near").checkpoint(eager=True)
            danger = bases.count()
            if not danger:
                continue
            bases = _spread(bases, need, danger, seed)
        else:
            raise ValueError(f"unknown method {method}")
        new = _interpolated(bases, near, points, cols, seed)
        out = out.unionByName(new.withColumn(target, F.lit(c).cast(kind)))
    return out
