"""Ordered work per key, cut in time: a key with very many rows spreads over many tasks.

Keys of more than ``hot_rows`` rows are cut at approximate quantiles of their own time into as many chunks as there are
shuffle partitions; all others are one chunk. Windows then run per (key, chunk). What a chunk needs from before it comes
in one of two ways: rows of a frame as a halo (``with_halo``: copies of the last rows of earlier chunks), state of
unbounded length as one carried value a chunk (at most one row per chunk, so a window over them by key is small).

Rows of one time stay in one chunk, a null time is in the first, and a null key is a key like any other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkclin.functions.exprs import _bucket, q
from sparkclin.session import stored

HOT_ROWS = 100_000
CHUNK, HOT, REAL = "__chunk", "__hot", "__real"  # chunk number; number of a cut key (null: not cut); not a halo row


def as_number(df: DataFrame, c: str) -> Column:
    """A column's place in time as a double: microseconds of a timestamp, else the number itself."""
    kind = dict(df.dtypes)[c]
    if kind.startswith("timestamp") or kind == "date":
        return F.unix_micros(F.col(q(c)).cast("timestamp")).cast("double")
    return F.col(q(c)).cast("double")


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which a null key meets a null key; the right side's keys are dropped."""
    other = right.select(*[F.col(q(k)).alias(f"__k{i}") for i, k in enumerate(keys)],
                         *[F.col(q(c)).alias(c) for c in right.columns if c not in keys])
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(q(k)).eqNullSafe(F.col(f"__k{i}"))
    return left.join(other, cond, how).drop(*[f"__k{i}" for i in range(len(keys))])


def cut(df: DataFrame, key: list[str], time: str, hot_rows: int = HOT_ROWS, parts: int | None = None) -> DataFrame:
    """``df`` plus ``__chunk`` (0, 1, ... in time order) and ``__hot``."""
    parts = parts or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    times = df.select(*[F.col(q(k)) for k in key], as_number(df, time).alias("__at"))
    hot = times.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_rows).drop("__n")
    hot = stored(hot.withColumn(HOT, F.monotonically_increasing_id()), "hot-keys")  # at most rows / hot_rows keys
    if hot.isEmpty():
        return df.withColumn(CHUNK, F.lit(0)).withColumn(HOT, F.lit(None).cast("long"))
    probs = ", ".join(str(i / parts) for i in range(1, parts))
    edges = join_same(times, hot, key, "inner").groupBy(HOT).agg(
        F.expr(f"array_distinct(percentile_approx(__at, array({probs}), {max(1000, 20 * parts)}))").alias("__edges"))
    known = stored(hot.join(edges, HOT, "left"), "hot-edges")
    x = join_same(df.withColumn("__at", as_number(df, time)), known, key)
    at = F.coalesce(_bucket("__edges", "__at", parts), F.lit(0))
    return x.withColumn(CHUNK, F.when(F.col(HOT).isNotNull(), at).otherwise(0).cast("int")).drop("__at", "__edges")


def is_cut(x: DataFrame) -> bool:
    """Whether ``cut`` found a key to cut: without one its columns are constants."""
    return not x.select(HOT).where(F.col(HOT).isNotNull()).isEmpty()


def with_halo(x: DataFrame, order: list[str], rows: int) -> DataFrame:
    """``x`` plus ``__real``, with copies (``__real`` false) of the last ``rows`` rows before each chunk.

    A chunk with fewer rows than that hands on rows of those before it; every chunk has a row, so ``rows`` chunks back
    are enough.
    """
    real = x.withColumn(REAL, F.lit(True))
    if not is_cut(x):
        return real
    part = x.where(F.col(HOT).isNotNull())
    by_key = Window.partitionBy(HOT).orderBy(CHUNK)  # over one row a chunk
    sizes = stored(part.groupBy(HOT, CHUNK).agg(F.count(F.lit(1)).alias("__n"))
                   .select(HOT, CHUNK, F.row_number().over(by_key).alias("__d"), F.sum("__n").over(by_key).alias("__end"),
                           (F.sum("__n").over(by_key) - F.col("__n")).alias("__before")), "chunk-sizes")
    back = Window.partitionBy(HOT, CHUNK).orderBy(*[F.col(q(c)).desc_nulls_last() for c in order])
    tails = part.withColumn("__r", F.row_number().over(back)).where(F.col("__r") <= rows)
    tails = tails.join(sizes.select(HOT, CHUNK, "__d", "__end"), [HOT, CHUNK]).drop(CHUNK)
    tails = tails.withColumn("__d", F.explode(F.sequence(F.col("__d") + 1, F.col("__d") + rows)))
    to = sizes.select(HOT, F.col(CHUNK).alias(CHUNK), "__d", "__before")
    halo = tails.join(to, [HOT, "__d"]).where(F.col("__before") - F.col("__end") + F.col("__r") <= rows)
    return real.unionByName(halo.select(*x.columns).withColumn(REAL, F.lit(False)))


def carried(values: DataFrame, state: str) -> DataFrame:
    """(``__hot``, ``__chunk``, ``__carry``): the last non-null ``state`` of earlier chunks, of one row a chunk."""
    before = Window.partitionBy(HOT).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return values.select(HOT, CHUNK, F.last(state, ignorenulls=True).over(before).alias("__carry"))


# ------------------------------------------------------------------ chains of firings
def _next(t: np.ndarray, wait: int) -> np.ndarray:
    """Of sorted times: the first row at least ``wait`` after each."""
    return np.maximum(np.searchsorted(t, t + wait), np.arange(1, len(t) + 1))


def _marks(t: np.ndarray, wait: int, start: int) -> np.ndarray:
    out = np.zeros(len(t), dtype=bool)
    after = _next(t, wait)
    while start < len(t):
        out[start] = True
        start = after[start]
    return out


def _exits(t: np.ndarray, wait: int) -> tuple[np.ndarray, np.ndarray]:
    """(entry, exit) of each row at which a chain can enter: a chain from before reaches a row less than ``wait`` after the
    first, or the first beyond. The exit is the chain's last row here."""
    after = _next(t, wait)
    last = np.where(after < len(t), after, np.arange(len(t)))
    while True:  # pointer doubling
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    entries = np.unique(t[:np.searchsorted(t, t[0] + wait) + 1], return_index=True)[1]
    return t[entries], t[last[entries]]


def fire_with_cooldown(df: DataFrame, key: list[str], ts: str, id_col: str, cooldown_s: Column, hot_rows: int = HOT_ROWS,
                       parts: int | None = None) -> DataFrame:
    """``df`` plus ``fires``: per key in (ts, id) order, true when ``cooldown_s`` has passed since the last firing.

    ``cooldown_s`` must be one value within a key. A row without a time never fires. Firings form a chain: each one's
    successor is the first row at least a cooldown later. Within a chunk the chain is followed in place. Across the chunks
    of a cut key, every row at which a chain can enter a chunk is a node that points to where its chain enters a later
    chunk; the nodes reached from the key's first row are found by pointer doubling, log2(chunks) joins of the
    nodes. A chunk is entered at most once, and is then marked on its own.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    x = df.select("*", micros.alias("__t"), F.col(id_col).alias("__id"), F.round(cooldown_s.cast("double") * 1e6).cast("long").alias("__cd"))
    x = cut(x, key, "__t", hot_rows, parts)
    entry = F.lit(np.iinfo(np.int64).min).cast("long")
    if is_cut(x):
        x = join_same(x, _entries(x.where(F.col(HOT).isNotNull() & F.col("__t").isNotNull())), [HOT, CHUNK])
        entry = F.when(F.col(HOT).isNull(), entry).otherwise(F.col("__entry"))
    x = x.withColumn("__entry", entry)
    names = df.columns

    def mark(table: pa.Table) -> pa.Table:
        table = table.sort_by([("__t", "ascending"), ("__id", "ascending")])
        t = table.column("__t").drop_null().to_numpy()
        fires = np.zeros(table.num_rows, dtype=bool)
        start = table.column("__entry")[0].as_py()
        if len(t) and start is not None:
            fires[:len(t)] = _marks(t, table.column("__cd")[0].as_py(), int(np.searchsorted(t, start)))
        return table.select(names).append_column("fires", pa.array(fires))

    schema = ", ".join([f"{q(f.name)} {f.dataType.simpleString()}" for f in df.schema.fields] + ["fires boolean"])
    return x.groupBy(*[F.col(q(k)) for k in key], CHUNK).applyInArrow(mark, schema)


def _entries(x: DataFrame) -> DataFrame:
    """(``__hot``, ``__chunk``, ``__entry``): the time at which the chain of a cut key enters a chunk."""
    def local(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        t = np.sort(table.column("__t").to_numpy())
        wait = table.column("__cd")[0].as_py()
        at, out = _exits(t, wait)
        n = len(at)
        return pa.table({HOT: [key[0].as_py()] * n, CHUNK: pa.array([key[1].as_py()] * n, pa.int32()), "__entry": at, "__due": out + wait,
                         "__last": [int(t[-1])] * n})

    nodes = stored(x.select(HOT, CHUNK, "__t", "__cd").groupBy(HOT, CHUNK).applyInArrow(
        local, f"{HOT} long, {CHUNK} int, __entry long, __due long, __last long"), "chain-nodes")
    ends = nodes.groupBy(HOT, CHUNK).agg(F.first("__last").alias("last"))
    ends = ends.groupBy(HOT).agg(F.array_sort(F.collect_list(F.struct(CHUNK, "last"))).alias("__ends"))  # a row a chunk
    later = F.get(F.filter("__ends", lambda e: (e[CHUNK] > F.col(CHUNK)) & (e["last"] >= F.col("__due"))), F.lit(0))[CHUNK]
    sent = nodes.join(ends, HOT).withColumn("__to", later).where(F.col("__to").isNotNull())

    def arrive(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        entries = np.sort(right.column("__entry").to_numpy())
        at = entries[np.searchsorted(entries, left.column("__due").to_numpy())] if left.num_rows else entries[:0]
        return pa.table({HOT: left.column(HOT), "c1": left.column(CHUNK), "e1": left.column("__entry"), "c2": left.column("__to"),
                         "e2": pa.array(at)})

    schema = f"{HOT} long, c1 int, e1 long, c2 int, e2 long"
    jump = stored(sent.select(HOT, CHUNK, "__entry", "__due", "__to").groupBy(HOT, "__to").cogroup(
        nodes.select(*[F.col(c).alias(c) for c in (HOT, CHUNK, "__entry")]).groupBy(HOT, CHUNK)).applyInArrow(arrive, schema), "jumps")
    first = nodes.groupBy(HOT).agg(F.min(F.struct(CHUNK, "__entry")).alias("s")).select(HOT, f"s.{CHUNK}", "s.__entry")
    reached = stored(first, "reached")
    while True:  # all nodes at most 2^i - 1 steps from the first; each round doubles the steps
        step = jump.withColumnsRenamed({"c1": CHUNK, "e1": "__entry"})
        more = stored(reached.join(step, [HOT, CHUNK, "__entry"]).select(HOT, F.col("c2").alias(CHUNK), F.col("e2").alias("__entry")),
                      "reached")
        if more.isEmpty():
            return reached
        reached = reached.unionAll(more)
        second = jump.select(HOT, F.col("c1").alias("c2"), F.col("e1").alias("e2"), F.col("c2").alias("c3"), F.col("e2").alias("e3"))
        jump = stored(jump.join(second, [HOT, "c2", "e2"]).select(HOT, "c1", "e1", F.col("c3").alias("c2"), F.col("e3").alias("e2")), "jumps")
