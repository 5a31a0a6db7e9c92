"""Source divergence audit: how far the word use of a language's sources differs, pair by pair and term by term.

A language keeps the V terms of at least ``min_docs`` of its documents. A group (language, source) with ``count``
occurrences of a term among N of all kept terms prices it at 1 + floor(10^9 (count + 5) / (N + 5 V)); the language as a
whole likewise. Part ``pair`` sums the price differences of two groups over all kept terms; part ``term`` lists the
terms that a group prices highest above its language.

Texts are counted in Arrow batches, so what is shuffled is one row per (group, term) of a batch. Groups hold
their counts as arrays sorted by term id, cut into segments of about ``segment_terms`` terms by a hash of the term, and
each unordered pair of groups is a task per segment that co-groups the two arrays: a galloping intersection prices
terms that both have, the rest of each array is priced against the other's absent price, and terms that neither has are
priced at once by their number. Only arrays are sent to pairs, never rows by pairs; a segment bounds what a task holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkclin.llm.stored import stored
from sparkclin.llm.words import Words, slices, text_buffers

MIN_DOCS = 30
SEGMENT_TERMS = 1 << 16
TOP_TERMS = 50
SCALE = 10 ** 9
SMOOTH = 5

_OUTSIDE = np.zeros(256, dtype=bool)  # bytes that end a term; every byte of a wider character is inside
_OUTSIDE[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

COUNTS = "lang string, source string, term string, n long, docs long"


def _count_slice(groups: np.ndarray, data: np.ndarray, offsets: np.ndarray):
    """(group, term bytes' index, occurrences, documents) and the terms of some texts."""
    words = Words(_LOWER[data], offsets, separators=_OUTSIDE)
    distinct, first, term = np.unique(words.hashes, return_index=True, return_inverse=True)
    width = max(1, len(distinct))
    held, times = np.unique(words.text_of_word() * width + term, return_counts=True)
    cells, back = np.unique(groups[held // width] * width + held % width, return_inverse=True)
    raw = words.data.tobytes()
    terms = [raw[s:e] for s, e in zip(words.starts[first].tolist(), words.ends[first].tolist())]
    return (cells // width, cells % width, np.bincount(back, times, len(cells)).astype(np.int64),
            np.bincount(back, minlength=len(cells)), pa.array(terms, pa.binary()).cast(pa.string()))


def count_terms(docs: DataFrame) -> DataFrame:
    """Rows (lang, source, term, n, docs) of COUNTS; a group's rows are partial counts still to be summed."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()),
                        ("docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            number = {p: i for i, p in enumerate(dict.fromkeys(pairs))}
            names = list(number)
            of_row = np.array([number[p] for p in pairs], np.int64)
            data, offsets = text_buffers(b.column(2))
            for lo, hi in slices(offsets):
                group, term, n, docs_, terms = _count_slice(of_row[lo:hi], data[offsets[lo]:offsets[hi]],
                                                            offsets[lo:hi + 1] - offsets[lo])
                lang, source = (pa.array([x[k] for x in names], pa.string()).take(pa.array(group)) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([lang, source, terms.take(pa.array(term)), pa.array(n), pa.array(docs_)],
                                                 schema=schema)

    return docs.mapInArrow(run, COUNTS)


def price(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10^9 (count + 5) / total), exactly: the quotient is built three digits at a time."""
    rest = np.asarray(counts, np.int64) + SMOOTH
    if total >= (1 << 63) // 1000:
        return np.array([1 + SCALE * int(c) // total for c in rest], np.int64)
    out = rest // total
    rest = rest % total
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def gallop(short: np.ndarray, long: np.ndarray, block: int = 256) -> np.ndarray:
    """First place in ``long`` not below each of ``short`` (both sorted).

    From the last place found, the step doubles until it passes a block's last id; the block is then sought in between.
    """
    out, low = np.empty(len(short), np.int64), 0
    for k in range(0, len(short), block):
        part, step = short[k:k + block], 1
        while low + step < len(long) and long[low + step] < part[-1]:
            step *= 2
        out[k:k + block] = low + np.searchsorted(long[low:low + step + 1], part)
        low = int(out[min(k + block, len(short)) - 1])
    return out


def merge_prices(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], total_a: int,
                 total_b: int) -> tuple[int, int]:
    """(sum of price differences over terms in either array, number of such terms)."""
    if len(a[0]) > len(b[0]):
        a, b, total_a, total_b = b, a, total_b, total_a
    (ids_a, n_a), (ids_b, n_b) = a, b
    price_a, price_b = price(n_a, total_a), price(n_b, total_b)
    absent_a, absent_b = (int(price(np.zeros(1, np.int64), t)[0]) for t in (total_a, total_b))
    at = gallop(ids_a, ids_b)
    both = np.zeros(len(ids_a), dtype=bool)
    inside = at < len(ids_b)
    both[inside] = ids_b[at[inside]] == ids_a[inside]
    alone_b = np.ones(len(ids_b), dtype=bool)
    alone_b[at[both]] = False
    value = (np.abs(price_a[both] - price_b[at[both]]).sum() + np.abs(price_a[~both] - absent_b).sum()
             + np.abs(price_b[alone_b] - absent_a).sum())
    return int(value), len(ids_a) + int(alone_b.sum())


PARTS = "lang string, a string, b string, value long, terms long"


def _pair_task(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
    def arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        if t.num_rows == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(t.column(c).combine_chunks().values.to_numpy() for c in ("ids", "counts"))

    has = left if left.num_rows else right
    value, terms = merge_prices(arrays(left), arrays(right), has["total_a"][0].as_py(), has["total_b"][0].as_py())
    lang, a, b, _ = (k.as_py() for k in key)
    return pa.table({"lang": [lang], "a": [a], "b": [b], "value": pa.array([value], pa.int64()),
                     "terms": pa.array([terms], pa.int64())})


def _price(count: str, total: str):
    """The price as a column; decimals hold the product exactly."""
    return F.expr(f"cast(1 + (cast({SCALE} as decimal(10, 0)) * cast({count} + {SMOOTH} as decimal(20, 0))) div {total} "
                  "as bigint)")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, segment_terms: int = SEGMENT_TERMS, top: int = TOP_TERMS,
          text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows lang, source, part ('pair' or 'term'), item, value, rank (1 first; value descending, item ascending).

    Null text, language and source are read as ''. Every occurring group has a ``pair`` row for each other source of its
    language, also when neither has a term (then all terms are absent from both; 0 if the language keeps none), and at
    most ``top`` ``term`` rows. Repeated rows count as documents of their own; an empty table gives no rows; other columns
    are not read.
    """
    read = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n)
                         for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counts = stored(count_terms(read).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"),
                                                                            F.sum("docs").alias("docs")), "term-counts")
    vocabulary = stored(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
                        .where(F.col("docs") >= min_docs).drop("docs").withColumn("id", F.monotonically_increasing_id()),
                        "vocabulary")
    segments = max(1, -(-vocabulary.count() // segment_terms))
    kept = stored(counts.drop("docs").join(vocabulary, ["lang", "term"]), "kept-counts")
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("n"))
    langs = langs.select("lang", "v", F.expr(f"n + {SMOOTH} * v").alias("lang_total"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = stored(
        read.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), "lang_total",
                F.expr(f"coalesce(n, 0) + {SMOOTH} * coalesce(v, 0)").alias("total")), "groups")

    one, two = (groups.select("lang", "v", F.col("source").alias(s), F.col("total").alias(f"total_{s}")) for s in "ab")
    pairs = one.join(two.drop("v"), "lang").where("a < b")
    arrays = stored(
        kept.groupBy("lang", "source", F.pmod(F.xxhash64("term"), F.lit(segments)).alias("segment"))
        .agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("sorted"))
        .select("lang", "source", "segment", F.col("sorted.id").alias("ids"), F.col("sorted.n").alias("counts")), "arrays")
    columns = [F.col(c).alias(c) for c in ("lang", "a", "b", "segment", "ids", "counts", "total_a", "total_b")]
    sides = [arrays.withColumnRenamed("source", s).join(pairs.drop("v"), ["lang", s]).select(*columns)
             .groupBy("lang", "a", "b", "segment") for s in "ab"]
    parts = sides[0].cogroup(sides[1]).applyInArrow(_pair_task, PARTS)
    parts = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    absent = (F.expr("v - coalesce(terms, 0)") * F.abs(_price("0", "total_a") - _price("0", "total_b")))
    valued = pairs.join(parts, ["lang", "a", "b"], "left").select(
        "lang", "a", "b", F.when(F.col("v") > 0, F.coalesce("value", F.lit(0)) + absent).otherwise(0).alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                             F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("way")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair_rows = (valued.select("lang", both, "value").select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
                 .withColumn("rank", F.row_number().over(order)))
    term_rows = (kept.join(groups, ["lang", "source"])
                 .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                         (_price("n", "total") - _price("lang_n", "lang_total")).alias("value"))
                 .where("value > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
    return pair_rows.unionAll(term_rows)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
voc AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
langs AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(n) AS n FROM voc GROUP BY lang),
c AS (SELECT w.lang, w.source, w.term, CAST(count(*) AS HUGEINT) AS n FROM w JOIN voc USING (lang, term) GROUP BY ALL),
g AS (SELECT x.lang, x.source, coalesce(any_value(l.v), 0) AS v, coalesce(sum(c.n), 0) + 5 * coalesce(any_value(l.v), 0) AS total
      FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN langs l USING (lang)
      LEFT JOIN c ON c.lang = x.lang AND c.source = x.source GROUP BY x.lang, x.source),
p AS (SELECT g.lang, g.source, voc.term, coalesce(c.n, 0) AS n,
             1 + (1000000000 * (coalesce(c.n, 0) + 5)) // g.total AS p, 1 + (1000000000 * (voc.n + 5)) // (l.n + 5 * l.v) AS q
      FROM g JOIN voc USING (lang) JOIN langs l USING (lang)
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = voc.term),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(pa.p - pb.p)), 0) AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN p pa ON pa.lang = a.lang AND pa.source = a.source
         LEFT JOIN p pb ON pb.lang = b.lang AND pb.source = b.source AND pb.term = pa.term
         GROUP BY a.lang, a.source, b.source),
rows_ AS (SELECT lang, source, 'pair' AS part, item, value FROM pair
          UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
                  CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
           FROM rows_)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
