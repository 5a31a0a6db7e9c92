"""Exact substring dedup by level-wise doubling.

A window of ``window`` words is repeated only if its half-length windows are. So the shortest level is counted
first; only windows repeated there are extended to twice the length, those repeated there again, until the
full length is reached or no candidate survives. At the shortest level a window need not be counted at every
place: each full window holds one ``anchor``, the short window with the least hash in it, and equal full windows
hold equal anchors. Counting anchors alone (about two in seventeen places for 5 of 20 words) loses nothing.

Per surviving anchor the next level is counted for the two double-length windows next to it; a full window lives
on if the double window inside it survived. At the full length every surviving window's first start (smallest
doc_id, then start) is found by a map-side combined minimum. What is removed from a document is what its
surviving windows cover, less those that are first.

Copies of an earlier document lose all that windows cover, which needs no search: groups of equal texts are found
by a 128-bit hash first, and only the first of a group takes part in the levels.

Texts are shuffled once by doc_id; the passes over them share that exchange. All else that moves is hashes.
Groups of equal windows are only ever reduced by count and minimum, so a passage in a third of all documents
costs one row per map task and key. Windows are known by 64-bit hashes at the lower levels and by two
independent ones (128 bits) at the full length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkclin.llm.words import Words, grams, mix64, slices, text_buffers

WINDOW = 20
SHORTEST = 5


def _levels(window: int, shortest: int) -> list[int]:
    out, n = [], shortest
    while n < window:
        out.append(n)
        n *= 2
    return [*out, window]


class _Slice:
    """Words, short windows and anchors of the texts of a slice of a batch, all at once.

    Positions are word numbers within the slice. ``starts`` are the places where a full window begins (it never
    crosses a text's end); ``anchor`` is the place of each one's least short window, the leftmost on ties.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, shortest: int):
        self.words = w = Words(data, offsets)
        self.window, self.shortest = window, shortest
        self.row = w.text_of_word()
        left = w.first[1:][self.row] - np.arange(len(self.row))
        self.starts = np.flatnonzero(left >= window)
        self.short = grams(w.hashes, shortest)
        self.anchor = _leftmost_least(self.short, window - shortest + 1)[self.starts] if len(self.starts) else self.starts

    def lists(self, places: np.ndarray, *values: np.ndarray) -> list[pa.Array]:
        """List columns, one list per text, of values at ascending places."""
        n = len(self.words.first) - 1
        offsets = np.concatenate([[0], np.cumsum(np.bincount(self.row[places], minlength=n))]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(v).view(np.int64)))
                for v in values]

    def inner(self, length: int) -> np.ndarray:
        """Place of the window of ``length`` words that stands for each full window: it begins at the anchor, or
        ends with the full window where it would reach beyond."""
        return np.minimum(self.anchor, self.starts + self.window - length)

    def survivors(self, keys: pa.Array, length: int) -> np.ndarray:
        """Which full windows hold a surviving window of ``length`` words. A surviving hash is on the list of
        every document that holds it, so the lists of a slice can be read as one set."""
        alive = np.unique(keys.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
        level = self.short if length == self.shortest else grams(self.words.hashes, length)
        return _within(level[self.inner(length)], alive) if len(self.starts) else np.zeros(0, dtype=bool)


def _leftmost_least(x: np.ndarray, span: int) -> np.ndarray:
    """For each i the place of the least of x[i : i + span], by doubling; the last span - 1 places have none."""
    at, width = np.arange(len(x)), 1
    while 2 * width <= span:
        a, b = at[:-width], at[width:]
        at = np.where(x[a] <= x[b], a, b)
        width *= 2
    if width < span:
        a, b = at[:-(span - width)], at[span - width:]
        at = np.where(x[a] <= x[b], a, b)
    return at


def _within(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(x), dtype=bool)
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x


def _slices(batch: pa.RecordBatch, window: int, shortest: int):
    """(doc ids, slice, list columns) of parts of a batch (doc_id, text, lists...)."""
    data, offsets = text_buffers(batch.column(1))
    for lo, hi in slices(offsets, 2 << 20):
        part = batch.slice(lo, hi - lo)
        yield part.column(0), _Slice(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo],
                                     window, shortest), part.columns[2:]


def repeated_word_counts(docs: DataFrame, window: int = WINDOW, shortest: int = SHORTEST,
                         id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 and ``kept`` (its kept words joined by a space).

    A word is removed if a window that covers it has the word sequence of a window that starts earlier (smaller
    doc_id, or same document and earlier start), judged on the input. Null and empty texts have no words. Rows
    with the same doc_id count as one document, and equal windows in two of them as one window. Rows with a null
    doc_id are kept whole and make no other row lose a word. Other columns are not read; an empty table gives no
    rows. ``kept`` is null unless ``with_text``.
    """
    if shortest < 1 or window < shortest:
        raise ValueError("shortest must lie between 1 and window")
    levels = _levels(window, shortest)
    given = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    # Every pass joins these rows by doc_id and asks for ids that are not null, so that all passes need the same
    # exchange of the texts: it is made once and reused.
    texts = given.where("doc_id IS NOT NULL")

    # Copies of an earlier document lose every word that a window covers; only the first of them is looked into.
    hashed = given.where("doc_id IS NOT NULL").select(
        "doc_id", F.xxhash64("text").alias("t1"), F.xxhash64("text", F.lit(1)).alias("t2"))
    originals = hashed.groupBy("t1", "t2").agg(F.min("doc_id").alias("original"))
    copies = (hashed.join(originals, ["t1", "t2"]).where(F.col("doc_id") > F.col("original"))
              .groupBy("doc_id").agg(F.lit(True).alias("copy")))

    # Shortest level: anchors of each document, counted over the corpus.
    def emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, x, _ in _slices(b, window, shortest):
                places = np.unique(x.anchor)
                yield _batch(["doc_id", "keys"], [ids, *x.lists(places, x.short[places])])

    firsts_only = texts.join(copies.hint("shuffle_hash"), "doc_id", "left_anti")
    keys = _surviving(firsts_only.mapInArrow(emit_anchors, "doc_id long, keys array<long>"))

    for shorter, length in zip(levels, levels[1:-1]):
        def emit_longer(batches: Iterator[pa.RecordBatch], shorter=shorter, length=length):
            for b in batches:
                for ids, x, (held,) in _slices(b, window, shortest):
                    places = np.unique(x.inner(length)[x.survivors(held, shorter)])
                    yield _batch(["doc_id", "keys"], [ids, *x.lists(places, grams(x.words.hashes, length)[places])])

        keys = _surviving(_with_keys(texts, keys, "inner").mapInArrow(emit_longer, "doc_id long, keys array<long>"))

    last = levels[-2] if len(levels) > 1 else levels[0]

    # Full length: the first document of every surviving window.
    def emit_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, x, (held,) in _slices(b, window, shortest):
                places = x.starts[x.survivors(held, last)]
                one, two = grams(x.words.hashes, window)[places], grams(x.words.hashes, window, 1)[places]
                places, one, two = (v[_first_in_text(x.row[places], one)] for v in (places, one, two))
                yield _batch(["doc_id", "h1", "h2"], [ids, *x.lists(places, one, two)])

    firsts = (_with_keys(texts, keys, "inner").mapInArrow(emit_windows, "doc_id long, h1 array<long>, h2 array<long>")
              .select("doc_id", F.explode(F.arrays_zip("h1", "h2")).alias("w"))
              .groupBy("w.h1", "w.h2").agg(F.min("doc_id").alias("doc_id"))
              .groupBy("doc_id").agg(F.collect_list("h1").alias("firsts")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, x, (held, first, copy) in _slices(b, window, shortest):
                w, places = x.words, x.starts[x.survivors(held, last)]
                one, rows = grams(w.hashes, window)[places], x.row[places]
                own = np.repeat(np.arange(len(first)), first.value_lengths().fill_null(0).to_numpy())
                mine = _tag(own, first.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
                stays = _first_in_text(rows, one, mask=True) & _within(_tag(rows, one), np.unique(mine))
                edge = np.zeros(len(w.starts) + 1, dtype=np.int64)
                copied = copy.fill_null(False).to_numpy(zero_copy_only=False)
                places, stays = places[~copied[rows]], stays[~copied[rows]]
                gone = np.concatenate([places[~stays], x.starts[copied[x.row[x.starts]]]])
                np.add.at(edge, gone, 1)
                np.add.at(edge, gone + window, -1)
                kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                n = np.diff(w.first)
                upto = np.searchsorted(kept, w.first)
                texts_out = _joined(w, kept, upto)
                yield _batch(["doc_id", "n_words", "n_removed", "kept_sha256", "kept"], [
                    ids, pa.array(n), pa.array(n - np.diff(upto)),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts_out]),
                    pa.array([t.decode("utf-8", "replace") for t in texts_out] if with_text else [None] * len(n),
                             pa.string())])

    none = F.lit(None)
    whole = given.where("doc_id IS NULL").select(
        "doc_id", "text", none.cast("array<long>").alias("keys"), none.cast("array<long>").alias("firsts"),
        none.cast("boolean").alias("copy"))
    judged = (_with_keys(texts, keys).join(firsts.hint("shuffle_hash"), "doc_id", "left")
              .join(copies.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "keys", "firsts", "copy"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    return judged.mapInArrow(cut, schema).unionByName(whole.mapInArrow(cut, schema))


def _batch(names: list[str], columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=names)


def _tag(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One hash for (text of the slice, window)."""
    return mix64(hashes ^ mix64(rows.astype(np.uint64) + np.uint64(1)))


def _first_in_text(rows: np.ndarray, hashes: np.ndarray, mask: bool = False) -> np.ndarray:
    """Ascending indexes (or a mask) of windows that no equal window precedes in the same text."""
    index = np.sort(np.unique(_tag(rows, hashes), return_index=True)[1])
    if not mask:
        return index
    out = np.zeros(len(rows), dtype=bool)
    out[index] = True
    return out


def _joined(w: Words, kept: np.ndarray, upto: np.ndarray) -> list[bytes]:
    """The kept words of each text joined by one space."""
    starts, size = w.starts[kept], w.ends[kept] - w.starts[kept] + 1  # with the space after
    to = np.concatenate([[0], np.cumsum(size)])
    out = np.full(to[-1], 0x20, dtype=np.uint8)
    source = np.repeat(starts - to[:-1], size) + np.arange(to[-1])
    space = np.zeros(to[-1], dtype=bool)
    space[to[1:] - 1] = True
    out[~space] = w.data[source[~space]]
    raw = out.tobytes()
    return [raw[to[a]:max(to[a], to[b] - 1)] for a, b in zip(upto[:-1], upto[1:])]


def _surviving(lists: DataFrame) -> DataFrame:
    """(doc_id, keys): of each document's keys those that occur twice or more in the corpus, by partial counts."""
    rows = lists.select("doc_id", F.explode("keys").alias("key"))
    twice = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return rows.join(twice, "key", "left_semi").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def _with_keys(texts: DataFrame, keys: DataFrame, how: str = "left") -> DataFrame:
    """Texts in their one partitioning, each with its document's surviving keys (null: none)."""
    return texts.join(keys.hint("shuffle_hash"), "doc_id", how).select("doc_id", "text", "keys")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")
