"""N-gram Jaccard join: MinHash banding, then verification on full n-gram sets.

Band and row counts follow from the threshold and a target recall. Documents with equal n-gram multisets are one
class, so copies never meet as pairs. Class representatives are shuffled on band hashes; every bucket links its
members to its least, and connected components of these links are the groups inside which candidates lie.

A group's full n-gram sets are then compared in cells: its members are dealt into chunks, and each pair of chunks
is one task's work, two bounded chunks of sets. Inside a cell intersections are products of incidence matrices;
a pair counts if its Jaccard similarity reaches the threshold: bands only choose the groups. A cell returns per member its
number of links and a spanning forest of them, so no pair is ever written and no link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkclin.llm.components import connected_components
from sparkclin.llm.words import Words, _stream, grams, mix64, slices, text_buffers

N = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.9999
MAX_HASHES = 192
CHUNK_SETS = 256          # members of a chunk
CHUNK_GRAMS = 400_000     # n-grams of a chunk: keeps a cell of long texts bounded
BROADCAST_ROWS = 200_000  # ids broadcast at most (a count decides)


def choose_bands(threshold: float = THRESHOLD, target: float = TARGET_RECALL,
                 max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective banding that finds a pair at the threshold with the target probability."""
    best = None
    for rows in range(1, max_hashes + 1):
        hit = threshold ** rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - target) / math.log(1 - hit))
        if bands * rows > max_hashes:
            break
        best = bands, rows
    if best is None:
        raise ValueError("max_hashes is too small for this recall")
    return best


def shingles(words: Words, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every n-gram in text order; a text of 1 to n - 1 words has one: all its words."""
    size = np.diff(words.first)
    row = words.text_of_word()
    left = words.first[1:][row] - np.arange(len(row))
    at = np.flatnonzero(left >= n)
    rows, hashes = row[at], grams(words.hashes, n)[at]
    for k in range(1, n):
        few = np.flatnonzero(size == k)
        if len(few):
            rows = np.concatenate([rows, few])
            hashes = np.concatenate([hashes, mix64(grams(words.hashes, k)[words.first[few]] + np.uint64(k))])
            order = np.argsort(rows, kind="stable")
            rows, hashes = rows[order], hashes[order]
    return rows, hashes


def _signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, h1, h2, n_grams, bands) of every text with at least one word."""
    seeds = _stream(71, 2 * bands * rows)
    xor, mul = seeds[0::2], seeds[1::2] | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_buffers(b.column(1))
            for lo, hi in slices(offsets, 1 << 20):
                text, h = shingles(Words(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]), n)
                if not len(h):
                    continue
                present, at, count = np.unique(text, return_index=True, return_counts=True)
                keys = np.empty((len(present), bands), dtype=np.uint64)
                for band in range(bands):
                    key = np.full(len(present), np.uint64(band + 1))
                    for r in range(band * rows, (band + 1) * rows):
                        key = mix64(key ^ np.minimum.reduceat((h ^ xor[r]) * mul[r], at))
                    keys[:, band] = key
                one = np.add.reduceat(mix64(h), at)
                two = np.add.reduceat(mix64(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
                flat = pa.array(keys.reshape(-1).view(np.int64))
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(lo, hi - lo).take(pa.array(present)), pa.array(one.view(np.int64)),
                    pa.array(two.view(np.int64)), pa.array(count),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(present) + 1, dtype=np.int32) * bands), flat)],
                    names=["doc_id", "h1", "h2", "n_grams", "bands"])

    return docs.mapInArrow(run, "doc_id long, h1 long, h2 long, n_grams long, bands array<long>")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, grams): the sorted distinct n-gram hashes of each text; other columns pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_buffers(b.column(1))
            for lo, hi in slices(offsets, 1 << 20):
                text, h = shingles(Words(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]), n)
                order = np.lexsort((h, text))
                text, h = text[order], h[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
                text, h = text[new], h[new]
                ends = np.searchsorted(text, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))],
                    names=["doc_id", "grams"])

    return docs.mapInArrow(run, "doc_id long, grams array<long>")


def _intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets ``left`` with sets ``right``, through shared n-grams in column tiles."""
    item = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(item, return_inverse=True, return_counts=True)
    shared = count[column] > 1  # an n-gram of one set alone meets nothing but itself
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    tile = 4096
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, tile):
        a, z = np.searchsorted(column, [lo, lo + tile])
        m = np.zeros((len(sets), min(tile, int(column[-1]) + 1 - lo)), dtype=np.float32)
        m[owner[a:z], column[a:z] - lo] = 1
        out += m[left] @ m[right].T
    return out


def _compare(threshold: float):
    def cell(table: pa.Table) -> pa.Table:
        rep = table.column("rep").to_numpy()
        copies = table.column("copies").to_numpy()
        side = table.column("chunk").to_numpy()
        flat = table.column("grams").combine_chunks()
        sets = [s.values.to_numpy() for s in flat]
        lo = int(table.column("lo")[0].as_py())
        one_chunk = lo == int(table.column("hi")[0].as_py())
        order = np.argsort(rep, kind="stable")
        left = order if one_chunk else order[side[order] == lo]
        right = order if one_chunk else order[side[order] != lo]
        links = np.zeros(len(rep), dtype=np.int64)
        root = np.arange(len(rep))
        if len(left) and len(right):
            both = _intersections(sets, left, right)
            size = np.array([len(s) for s in sets], dtype=np.float64)
            near = both / (size[left][:, None] + size[right][None, :] - both) >= threshold
            if one_chunk:
                near &= ~np.eye(len(left), dtype=bool)
            np.add.at(links, left, near @ copies[right])
            if not one_chunk:
                np.add.at(links, right, near.T @ copies[left])
            _join(root, left, right, near)
        return pa.table({"rep": pa.array(rep), "root": pa.array(rep[root]), "links": pa.array(links)})

    return cell


def _join(root: np.ndarray, left: np.ndarray, right: np.ndarray, near: np.ndarray) -> None:
    """Union-find over the links of a cell; ``root`` ends as one member of each member's component."""
    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in np.flatnonzero(near.any(axis=1)):
        a = find(int(left[i]))
        for j in right[near[i]].tolist():
            b = find(j)
            if a != b:
                root[b] = a
    for i in range(len(root)):
        root[i] = find(i)


def near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links, n_copies) of every row.

    A link joins two documents whose sets of ``n``-word grams have Jaccard similarity ``threshold`` or more;
    ``n_links`` counts a document's links, ``n_copies`` those of them to equal n-gram multisets, and ``class_id``
    is the least doc_id of the connected component. A text of 1 to n - 1 words has one gram, all its words; empty
    and null texts have no links and are their own class. Rows without a doc_id count as copies of equal texts
    only. Repeated rows are each counted. Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bands, rows = choose_bands(threshold, target_recall)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    signed = _signatures(texts, n, bands, rows).checkpoint(eager=True)
    classes = (signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"),
                                              F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"))
               .checkpoint(eager=True))
    reps = classes.where("rep IS NOT NULL")

    # Buckets of two or more link their members to the least one.
    keyed = reps.select("rep", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("least")).where("n > 1")
    edges = (keyed.join(buckets.select("key", "least"), "key").where("rep <> least")
             .select(F.col("rep").alias("u"), F.col("least").alias("v")).distinct())
    groups = connected_components(edges).withColumnRenamed("node", "rep")

    # Members, dealt into chunks; each pair of chunks of a group is a cell.
    members = groups.join(reps, "rep").select("rep", "root", "copies", "n_grams")
    sizes = members.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_grams").alias("total"))
    dealt = (members.join(sizes, "root")
             .withColumn("k", F.greatest(F.ceil(F.col("n") / CHUNK_SETS), F.ceil(F.col("total") / CHUNK_GRAMS)).cast("int"))
             .select("rep", "root", "copies", "k",
                     F.pmod(F.xxhash64("rep"), F.col("k")).cast("int").alias("chunk"))
             .checkpoint(eager=True))
    wanted = dealt.select(F.col("rep").alias("doc_id"))
    if dealt.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    sets = _sets(texts.join(wanted, "doc_id", "left_semi"), n).dropDuplicates(["doc_id"])
    cells = (dealt.join(sets.withColumnRenamed("doc_id", "rep"), "rep")
             .select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
             .select("rep", "root", "copies", "chunk", "grams", F.least("chunk", "other").alias("lo"),
                     F.greatest("chunk", "other").alias("hi")))
    checked = (cells.groupBy("root", "lo", "hi")
               .applyInArrow(_compare(threshold), "rep long, root long, links long").checkpoint(eager=True))
    links = checked.groupBy("rep").agg(F.sum("links").alias("links"))
    found = connected_components(checked.select(F.col("rep").alias("u"), F.col("root").alias("v")))

    verdict = (classes.select("h1", "h2", "rep", "copies")
               .join(links, "rep", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
               .select("h1", "h2", F.coalesce("root", "rep").alias("class_id"),
                       (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                       (F.col("copies") - 1).alias("n_copies")))
    with_words = signed.select("doc_id", "h1", "h2").join(verdict, ["h1", "h2"]).select(
        "doc_id", "class_id", "n_links", "n_copies")
    empty = (texts.where(~F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False)))
             .select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"),
                     F.lit(0).cast("long").alias("n_copies")))
    return with_words.unionByName(empty)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
