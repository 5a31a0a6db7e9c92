"""Shared column expressions and plan fragments used across operator groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in exclude]


def q(c: str) -> str:
    """Back-quote a column name for SQL expression strings."""
    return "`" + c.replace("`", "``") + "`"


def safe_div(num: Column, den: Column, default: float | None = 0.0) -> Column:
    """num/den, ``default`` when the denominator is zero or NULL."""
    r = F.try_divide(num.cast("double"), den.cast("double"))
    return r if default is None else F.coalesce(r, F.lit(float(default)))


def with_constants(df: DataFrame, consts: DataFrame) -> DataFrame:
    """Attach a one-row frame of fitted constants to every row.

    The right side is an aggregate without grouping keys, so it is exactly
    one row whatever the data size: a safe broadcast.
    """
    return df.crossJoin(F.broadcast(consts))


def rows_from_struct_array(one_row: DataFrame, structs: list[Column], name: str = "__s") -> DataFrame:
    """Turn a one-row frame of per-column statistics into one row per struct."""
    return one_row.select(F.explode(F.array(*structs)).alias(name)).select(f"{name}.*")


def stack_columns(df: DataFrame, ids: list[str], cols: list[str], var: str = "feature",
                  val: str = "value") -> DataFrame:
    """Wide → long (``unpivot``) with values cast to double."""
    casted = df.select(*ids, *[F.col(q(c)).cast("double").alias(c) for c in cols])
    return casted.unpivot(ids, cols, var, val)


def ordinal(col: Column, levels: list[str]) -> Column:
    """Position of ``col`` in ``levels`` (0-based), NULL when absent."""
    expr = None
    for i, lv in enumerate(levels):
        expr = (F.when(col == lv, F.lit(i)) if expr is None else expr.when(col == lv, F.lit(i)))
    return expr


def md5_bucket(col: Column, modulus: int) -> Column:
    """Stable bucket from the first 32 bits of md5: same value on every engine and partitioning."""
    return F.conv(F.substring(F.md5(col.cast("string")), 1, 8), 16, 10).cast("bigint") % F.lit(modulus)


def _bucket(edges: str, value: str, n_edges: int) -> Column:
    """How many of the sorted ``edges`` lie below ``value``: a binary search in one row."""
    steps = max(1, n_edges.bit_length())
    return F.expr(
        f"aggregate(sequence(1, {steps}), named_struct('lo', 0, 'hi', size({edges})), (s, _) -> "
        f"CASE WHEN s.lo >= s.hi THEN s WHEN element_at({edges}, cast((s.lo + s.hi) / 2 as int) + 1) < {value} "
        f"THEN named_struct('lo', cast((s.lo + s.hi) / 2 as int) + 1, 'hi', s.hi) "
        f"ELSE named_struct('lo', s.lo, 'hi', cast((s.lo + s.hi) / 2 as int)) END, s -> s.lo)")


def cumulative_sums(df: DataFrame, order_col: str, sum_cols: list[str], group_cols: list[str] | None = None,
                    descending: bool = False, n_buckets: int | None = None, prefix: str = "cum_",
                    with_next: bool = False) -> DataFrame:
    """Running totals of ``sum_cols`` in ``order_col`` order (ties included), per group.

    A plain window without ``partitionBy`` would pull every row into one
    task. Instead each group's rows are range-bucketed by that group's own
    approximate quantile edges (so a narrow feature spreads as well as a wide
    one), each bucket's totals are prefix-summed over the small (group ×
    bucket) table, and the final window runs per (group, bucket) plus that
    offset. Equal order values always land in one bucket, so RANGE-frame tie
    semantics are exact. ``df`` should already be reduced to distinct (group,
    order) rows; edges, totals and window share its last exchange.
    ``with_next`` adds ``next_value``: the following distinct order value in
    the group (within a bucket by ``lead``, across buckets from the next
    bucket's minimum).
    """
    group_cols = list(group_cols or [])
    if n_buckets is None:
        n_buckets = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = F.col(q(order_col)).cast("double")
    base = df.withColumn("__o", -key if descending else key)
    probs = ", ".join(str(i / n_buckets) for i in range(1, n_buckets))
    edges = base.groupBy(*group_cols).agg(F.array_distinct(F.coalesce(
        F.expr(f"percentile_approx(__o, array({probs}), {max(1000, 20 * n_buckets)})"),
        F.array().cast("array<double>"))).alias("__edges"))
    b = base.crossJoin(F.broadcast(edges)) if not group_cols else _same_group(base, edges, group_cols)
    b = b.withColumn("__b", _bucket("__edges", "__o", n_buckets)).drop("__edges")
    tot = b.groupBy(*group_cols, "__b").agg(*[F.sum(q(c)).alias(f"__t_{c}") for c in sum_cols],
                                            F.min("__o").alias("__bmin"))
    wb = Window.partitionBy(*group_cols).orderBy("__b")
    before = wb.rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*group_cols, "__b", F.lead("__bmin").over(wb).alias("__nb"),
                     *[F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__off_{c}") for c in sum_cols])
    j = _same_group(b, off, group_cols + ["__b"])
    w = Window.partitionBy(*group_cols, "__b").orderBy("__o")
    wr = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    extra = []
    if with_next:
        ln = F.coalesce(F.lead("__o").over(w), F.col("__nb"))
        extra.append((-ln if descending else ln).alias("next_value"))
    return j.select(*df.columns, *[(F.sum(q(c)).over(wr) + F.col(f"__off_{c}")).alias(prefix + c)
                                   for c in sum_cols], *extra)


def _same_group(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Equi-join in which a null key meets a null key; the right side's keys are dropped."""
    renamed = right.select(*[F.col(q(k)).alias(f"__k{i}") for i, k in enumerate(keys)],
                           *[F.col(q(c)) for c in right.columns if c not in keys])
    cond = None
    for i, k in enumerate(keys):
        c = left[k].eqNullSafe(renamed[f"__k{i}"])
        cond = c if cond is None else cond & c
    return left.join(renamed, cond, "inner").drop(*[f"__k{i}" for i in range(len(keys))])


SKETCH = 10_000  # accuracy of the quantile sketch that brackets an order statistic


def _pick(ranked: DataFrame, probs: list[float], g: list[str]) -> DataFrame:
    """Interpolated quantiles of rows (g..., __v, __c, __cum, __n) with the running count up to each value."""
    aggs = []
    for i, p in enumerate(probs):
        h = (F.col("__n") - 1) * F.lit(float(p))
        aggs += [F.min(F.when(F.col("__cum") > F.floor(h), F.struct("__cum", "__v"))).getField("__v").alias(f"__lo{i}"),
                 F.min(F.when(F.col("__cum") > F.ceil(h), F.struct("__cum", "__v"))).getField("__v").alias(f"__hi{i}"),
                 F.first(h - F.floor(h)).alias(f"__fr{i}")]
    a = ranked.groupBy(*g).agg(*aggs)
    missed = F.raise_error(F.lit("an order statistic lies outside its bracket")).cast("double")
    lo = [F.coalesce(F.col(f"__lo{i}"), missed) for i in range(len(probs))]
    hi = [F.coalesce(F.col(f"__hi{i}"), missed) for i in range(len(probs))]
    return a.select(*g, F.array(*[lo[i] + F.col(f"__fr{i}") * (hi[i] - lo[i]) for i in range(len(probs))]).alias("__q"))


def _edges(probs: list[float]) -> list[float]:
    """Probabilities just below and above each wanted one, wider apart than the sketch's error."""
    return sorted({round(x, 9) for p in probs for x in (max(0.0, p - 3 / SKETCH), min(1.0, p + 3 / SKETCH))})


def _sketch(c: str, edges: list[float]) -> Column:
    return F.expr(f"percentile_approx({c}, array({', '.join(map(str, edges))}), {SKETCH})")


def quantiles_long(long: DataFrame, probs: list[float], group_cols: list[str], value: str = "value",
                   weight: str | None = None, sketch: DataFrame | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles (``percentile`` / numpy default) per group, by bracketing.

    Spark's exact ``percentile`` merges every distinct value of a group into one task's hash map. Here one aggregate
    sketches each group (``percentile_approx``) just below and above every probability, wider than the sketch's error, so the
    wanted order statistics surely lie in these brackets. A second aggregate counts rows between the brackets
    without their values, and keeps (value, count) inside them only: at most 6 / ``SKETCH`` of the rows a probability
    (of a group up to ``SKETCH`` rows, where rounding to whole rows matters, every value). That narrow table is shuffled
    and ranked. ``sketch`` (group..., __n, __e) may come from elsewhere. With ``weight`` (rows already reduced to distinct values) ranks come from the bucketed prefix sums.
    Returns (group..., __q array<double>).
    """
    g = list(group_cols)
    v = F.col(value).cast("double")
    if weight:
        vc = long.where(v.isNotNull()).groupBy(*g, v.alias("__v")).agg(F.sum(weight).cast("long").alias("__c"))
        vc = vc.where(F.col("__c") > 0)
        n = vc.groupBy(*g).agg(F.sum("__c").alias("__n"))
        cum = cumulative_sums(vc, "__v", ["__c"], g).withColumnRenamed("cum___c", "__cum")
        return _pick(_same_group(cum, n, g) if g else cum.crossJoin(F.broadcast(n)), probs, g)
    base = long.where(v.isNotNull()).select(*g, v.alias("__v"))
    edges = _edges(probs)
    # Slots of the sorted edges: 2i is strictly between edges i - 1 and i, 2i + 1 is edge i itself.
    kept = [2 * i for i in range(1, len(edges)) if any(p - 3 / SKETCH <= (edges[i - 1] + edges[i]) / 2 <= p + 3 / SKETCH for p in probs)]
    if sketch is None:
        sketch = base.groupBy(*g).agg(F.count(F.lit(1)).alias("__n"), _sketch("__v", edges).alias("__e"))
    sketch = sketch.select(*g, "__n", *[F.get("__e", F.lit(i)).alias(f"__e{i}") for i in range(len(edges))])
    j = _same_group(base, sketch, g) if g else base.crossJoin(F.broadcast(sketch))
    slot, inside = F.lit(0), F.col("__n") <= SKETCH
    for i in range(len(edges)):
        e = F.col(f"__e{i}")
        slot = slot + (F.col("__v") > e).cast("int") + (F.col("__v") >= e).cast("int")
        inside = inside | (F.col("__v") == e)
    inside = inside | F.col("__s").isin(kept)
    counts = (j.withColumn("__s", slot).select(*g, "__n", "__s", F.when(inside, F.col("__v")).alias("__v"))
              .groupBy(*g, "__n", "__s", "__v").agg(F.count(F.lit(1)).alias("__c")))
    order = Window.partitionBy(*(g or [F.lit(0)])).orderBy("__s", "__v").rowsBetween(Window.unboundedPreceding, 0)
    return _pick(counts.withColumn("__cum", F.sum("__c").over(order)), probs, g)


def column_quantiles(df: DataFrame, cols: list[str], probs: list[float], approx: bool = False,
                     prefix: str = "__q_") -> DataFrame:
    """One row with ``{prefix}{i}`` = array of the requested quantiles of ``cols[i]``.

    Exact by the distributed ``quantiles_long``, whatever the input's size;
    ``approx`` asks for ``percentile_approx`` (bounded memory, one pass).
    """
    if approx:
        arr = "array(" + ", ".join(str(p) for p in probs) + ")"
        return df.agg(*[F.expr(f"percentile_approx({q(c)}, {arr}, 10000)").cast("array<double>").alias(f"{prefix}{i}")
                        for i, c in enumerate(cols)])
    numbers = df.select(*[F.col(q(c)).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    one = numbers.agg(*[F.struct(F.lit(c).alias("feature"), F.count(f"c{i}").alias("__n"), _sketch(f"c{i}", _edges(probs)).alias("__e"))
                        .alias(f"s{i}") for i, c in enumerate(cols)])  # sketched before columns become rows
    sketch = rows_from_struct_array(one, [F.col(f"s{i}") for i in range(len(cols))])
    ql = quantiles_long(stack_columns(df.select(*cols), [], cols), probs, ["feature"], sketch=sketch)
    one = ql.groupBy().pivot("feature", cols).agg(F.first("__q"))
    return one.select(*[F.col(q(c)).alias(f"{prefix}{i}") for i, c in enumerate(cols)])
