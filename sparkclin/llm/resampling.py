"""Importance resampling towards a target distribution, by hashed word features.

Features are runs of 1 to ``longest`` consecutive words, hashed into ``buckets`` buckets. Two passes over the texts: the
first counts buckets (an array a task, so at most ``buckets`` rows a task are shuffled), the second scores each
document with the array of gains, which is of fixed size and goes with the task. Scores get Gumbel noise from
a hash of the id, so the highest scores are a sample without replacement, the same on every run.

The cutoff among N scores is found by weighted median-of-medians selection, without a global sort: each round every
partition gives the median of its remaining keys and their number; the median of these medians, weighted by the
numbers, is the pivot. At least a quarter of the remaining keys lie on either side, so whichever side
can't hold the cutoff is discarded for certain. What remains is written anew whenever it is an eighth of what is read,
so all rounds together read the scores a bounded number of times. Only winners are sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkclin.llm.stored import stored
from sparkclin.llm.words import Words, slices, text_buffers

BUCKETS = 10_000
LONGEST = 2
MIN_WORDS = 20
PERCENT = 25
SEED = 7

_OUTSIDE = np.zeros(256, dtype=bool)  # bytes that end a word; every byte of a wider character is inside
_OUTSIDE[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)
WHOLE_WORD = 48  # bytes from which a word goes to zlib by itself


def extend_crc(crc: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of (what ``crc`` stands for, then data[start:end]) for each span, a byte of all spans at a time."""
    state = ~crc
    size = ends - starts
    todo = np.flatnonzero(size < WHOLE_WORD)
    at = 0
    while len(todo := todo[size[todo] > at]):
        s = state[todo]
        state[todo] = _CRC[(s ^ data[starts[todo] + at]) & np.uint32(0xFF)] ^ (s >> np.uint32(8))
        at += 1
    out = ~state
    for k in np.flatnonzero(size >= WHOLE_WORD).tolist():
        out[k] = zlib.crc32(data[starts[k]:ends[k]].tobytes(), int(crc[k]))
    return out


def features(data: np.ndarray, offsets: np.ndarray, longest: int = LONGEST, buckets: int = BUCKETS):
    """(words of each text, [(text, bucket) arrays of runs of 1, 2, ... words]) of a byte buffer of texts."""
    words = Words(_LOWER[data], offsets, hashed=False, separators=_OUTSIDE)
    text = words.text_of_word()
    crc = extend_crc(np.zeros(len(text), np.uint32), words.data, words.starts, words.ends)
    runs = [(text, crc % np.uint32(buckets))]
    space = np.frombuffer(b" ", np.uint8)
    for n in range(1, longest):  # a run of n + 1 words continues the run of n words that begins with it
        whole = text[n:] == text[:-n] if len(text) > n else np.zeros(0, dtype=bool)
        first = np.flatnonzero(whole)
        nothing = np.zeros(len(first), np.int64)
        longer = np.zeros(len(text), np.uint32)
        longer[first] = extend_crc(extend_crc(crc[first], space, nothing, nothing + 1), words.data,
                                   words.starts[first + n], words.ends[first + n])
        crc = longer
        runs.append((text[first], crc[first] % np.uint32(buckets)))
    return np.diff(words.first), runs


def _texts(batches: Iterator[pa.RecordBatch], column: int):
    """(batch, first row, one past the last row, bytes, offsets) of parts of a few megabytes."""
    for b in batches:
        data, offsets = text_buffers(b.column(column))
        for lo, hi in slices(offsets):
            yield b, lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, text_col: str = "text") -> np.ndarray:
    """Number of features in each bucket over all rows; ``buckets`` rows at most reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, _, _, data, offsets in _texts(batches, 0):
            for _, bucket in features(data, offsets, longest, buckets)[1]:
                total += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held])], names=["bucket", "n"])

    rows = (texts.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket, in doubles."""
    s_all, t_all = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all)))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, longest: int = LONGEST, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Rows doc_id, n_words, n_features, weight (floored mean of the gains of all features, 0 without any)."""
    fields = ("doc_id", "n_words", "n_features", "weight")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, lo, hi, data, offsets in _texts(batches, 1):
            n_words, runs = features(data, offsets, longest, len(gains))
            n, total = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
            for text, bucket in runs:
                n += np.bincount(text, minlength=hi - lo)
                before = np.concatenate([[0], np.cumsum(gains[bucket])])
                edge = np.searchsorted(text, np.arange(hi - lo + 1))
                total += before[edge[1:]] - before[edge[:-1]]
            weight = np.floor_divide(total, np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *map(pa.array, (n_words, n, weight))],
                                             names=list(fields))

    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return picked.mapInArrow(run, ", ".join(f"{f} long" for f in fields))


# ------------------------------------------------------------------ selection
# A key is (score, id): the higher score first, then the smaller id. Ids enter with all bits turned, so a key is larger if
# it comes earlier; a null id comes after all others of its score.
_LAST = np.iinfo(np.int64).min


def kth_largest(score: np.ndarray, tie: np.ndarray, k: int) -> tuple[int, int]:
    """The k-th largest (from 0) of pairs, by partition alone."""
    s = np.partition(score, len(score) - 1 - k)[len(score) - 1 - k]
    ties = tie[score == s]
    k -= int((score > s).sum())
    return int(s), int(np.partition(ties, len(ties) - 1 - k)[len(ties) - 1 - k])


_MEDIANS = "above_n long, above_s long, above_t long, equal_n long, below_n long, below_s long, below_t long"


def _medians(pivot: tuple[int, int] | None):
    """Of a partition's keys above and below the pivot: number and median; of those equal to it: the number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not parts:
            return
        score, tie = (np.concatenate(x) for x in zip(*parts))
        if pivot is None:
            above, equal = np.ones(len(score), dtype=bool), np.zeros(len(score), dtype=bool)
        else:
            above = (score > pivot[0]) | (score == pivot[0]) & (tie > pivot[1])
            equal = (score == pivot[0]) & (tie == pivot[1])
        row = []
        for held in (above, ~above & ~equal):
            n = int(held.sum())
            row += [n, *(kth_largest(score[held], tie[held], n // 2) if n else (0, 0))]
        row.insert(3, int(equal.sum()))
        names = [c.strip("` ").split()[0] for c in _MEDIANS.split(",")]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], names=names)
    return run


def weighted_median(keys: list[tuple[int, int]], weights: list[int]) -> tuple[int, int]:
    """The largest key such that keys not below it hold at least half the weight."""
    half, total = sum(weights), 0
    for key, weight in sorted(zip(keys, weights), reverse=True):
        total += weight
        if 2 * total >= half:
            return key
    raise ValueError("no keys")


def _between(low: tuple[int, int] | None, high: tuple[int, int] | None):
    """Rows strictly between two keys; the comparison of scores alone reaches the scan as a filter."""
    out = F.lit(True)
    if high is not None:
        out &= (F.col("score") <= high[0]) & ((F.col("score") < high[0]) | (F.col("tie") < high[1]))
    if low is not None:
        out &= (F.col("score") >= low[0]) & ((F.col("score") > low[0]) | (F.col("tie") > low[1]))
    return out


def cutoff(keys: DataFrame, k: int) -> tuple[int, int]:
    """The k-th largest (from 1) of all rows (score, tie) of a stored table, exactly.

    A round is one job: the pivot's partition-wise counts come with the medians of either side, of which the next
    round needs one. A partition holds a split of narrow rows; a row a partition reaches the driver.
    """
    low = high = pivot = None
    table, held = keys, None
    while True:
        left = table.where(_between(low, high)).select("score", "tie")
        rows = left.mapInArrow(_medians(pivot), _MEDIANS).collect()
        above, equal, below = (sum(r[c] for r in rows) for c in ("above_n", "equal_n", "below_n"))
        remaining = above + equal + below
        if held is None:
            held = remaining
        if pivot is not None and above < k <= above + equal:
            return pivot
        if above >= k:
            side, low, remaining = "above", pivot if pivot is not None else low, above
        else:
            side, high, remaining, k = "below", pivot, below, k - above - equal
        medians = [((r[f"{side}_s"], r[f"{side}_t"]), r[f"{side}_n"]) for r in rows if r[f"{side}_n"]]
        pivot = weighted_median(*map(list, zip(*medians)))
        if 8 * remaining <= held:
            table, held = stored(table.where(_between(low, high)).select("score", "tie"), "selection"), remaining


def draw(scored: DataFrame, k: int) -> DataFrame:
    """``scored`` (a stored table with score, doc_id, number) with ``rank`` 1..k of the k highest scores among rows with
    ``drawable``, null for all others; equal scores by id, a null id last, and rows of one key by their number."""
    tie = F.coalesce(F.bitwise_not("doc_id"), F.lit(_LAST))
    if k == 0:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    score, last = cutoff(scored.where("drawable").select("score", tie.alias("tie")), k)
    wins = F.col("drawable") & ((F.col("score") > score) | (F.col("score") == score) & (tie >= last))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("number")]
    winners = stored(scored.where(wins).orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "winners")
    # A sorted table's partitions are ranges in order: a row's rank is its place plus the sizes of those before it.
    part = F.shiftright("__at", 33)
    sizes = dict(winners.groupBy(part.alias("p")).count().collect())
    before, starts = 0, []
    for p in sorted(sizes):
        starts.append((p, before))
        before += sizes[p]
    offsets = scored.sparkSession.createDataFrame(starts, "p long, before long")
    ranked = (winners.join(F.broadcast(offsets), part == F.col("p"))
              .withColumn("rank", F.col("before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1)
              .withColumn("rank", F.when(F.col("rank") <= k, F.col("rank"))))
    rest = scored.where(~wins).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*rest.columns).unionAll(rest)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED,
             longest: int = LONGEST, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text",
             target_col: str = "text") -> DataFrame:
    """Rows doc_id, n_features, weight, score, rank: every document, drawn ones with their rank.

    Of the N documents with at least ``min_words`` words, floor(percent * N / 100) are drawn. A null or empty text has no
    features and weight 0. A null id is hashed as the empty string and comes last among equal scores; repeated rows are
    documents of their own, in an order that is fixed by where the input holds them; other columns are not read; an
    empty table gives no rows, an empty target gives each bucket the gain against no features.
    """
    gains = bucket_gains(bucket_counts(docs, longest, buckets, text_col), bucket_counts(target, longest, buckets, target_col))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256),
                           1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = stored(weigh(docs, gains, longest, id_col, text_col)
                    .select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"),
                            (F.col("n_words") >= min_words).alias("drawable"),
                            F.monotonically_increasing_id().alias("number")), "scored")
    n = scored.where("drawable").count()
    return draw(scored, percent * n // 100).select("doc_id", "n_features", "weight", "score", "rank")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
