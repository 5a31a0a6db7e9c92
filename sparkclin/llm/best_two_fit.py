"""Best-fit packing with best-two-fit.

Documents become pieces of at most ``capacity`` ids; only a longer document is cut. A bin is filled greedily, the largest
piece that fits first. If a gap is left, the bin's smallest piece is replaced by the two unpacked pieces that fill the
gap it leaves most tightly, where two exist that hold more ids than it.

Texts are tokenised once, in a map over the input; what is stored and shuffled is one narrow row a piece. Pieces are
dealt at random, by their number, into blocks of about ``block_pieces``, and each block is packed in one task: no task
grows with the input, and no key of the input decides where a piece goes. Each block's bins with room left go
on to a next round, where the pieces of all of them are packed together, until one block is left or a round closes less
than a tenth of what it was given.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkclin.llm.stored import stored
from sparkclin.llm.words import Words, slices, text_buffers

CAPACITY = 4096
BLOCK_PIECES = 4096
OPEN = 64  # a bin with at least capacity / OPEN free ids goes on to the next round

PIECES = "number long, doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, `offset` long, `open` boolean"
RESULT = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


class WordBpe:
    """Ids of the word-end BPE, each distinct white-space-separated chunk encoded once.

    Its normaliser works character by character (or within a run of combining marks) and its split drops white space, so
    a text can be cut there. Chunks not yet known are encoded a batch at a time; ``most`` bounds the chunks held.
    """

    def __init__(self, path: str, most: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[int, int] = {}
        self.begin, self.pool = np.zeros(1, np.int64), np.zeros(0, "<u4")  # a chunk's ids are pool[begin[k]:begin[k + 1]]

    def _learn(self, keys: list[int], chunks: list[str]) -> np.ndarray:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        first = len(self.begin) - 1
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])
        self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(ids), "<u4", int(sizes.sum()))])
        self.slot.update(zip(keys, range(first, first + len(keys))))
        return np.arange(first, first + len(keys))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each text of a byte buffer (UTF-8 texts one after another)."""
        if len(self.slot) > self.most:
            self._clear()
        words = Words(data, offsets)
        distinct, at, back = np.unique(words.hashes, return_index=True, return_inverse=True)
        slots = np.fromiter(map(self.slot.get, distinct.tolist(), repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(slots < 0)
        if len(new):
            raw = data.tobytes()
            spans = zip(words.starts[at[new]].tolist(), words.ends[at[new]].tolist())
            slots[new] = self._learn(distinct[new].tolist(), [raw[s:e].decode("utf-8", "replace") for s, e in spans])
        begin, count = self.begin[slots], np.diff(self.begin)[slots]
        begin, count = begin[back], count[back]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.pool[np.repeat(begin - total[:-1], count) + np.arange(total[-1])]
        upto = total[words.first]
        return [ids[s:e] for s, e in zip(upto[:-1].tolist(), upto[1:].tolist())]


_LOADED: dict[str, WordBpe] = {}


def _load(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


class _Sizes:
    """Unpacked pieces by size: how many of each, and the largest size up to any bound."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.left = np.bincount(sizes, minlength=capacity + 1)
        held = np.where(self.left > 0, np.arange(capacity + 1), 0)
        self.upto = np.maximum.accumulate(held)

    def largest(self, bound: int) -> int:
        return int(self.upto[bound])

    def take(self, size: int) -> None:
        self.left[size] -= 1
        if self.left[size] == 0:
            end = np.searchsorted(self.upto, size, "right")
            self.upto[size:end] = self.upto[size - 1]

    def give(self, size: int) -> None:
        self.left[size] += 1
        if self.left[size] == 1:
            end = np.searchsorted(self.upto, self.upto[size], "right")
            self.upto[size:end] = size

    def best_two(self, room: int) -> tuple[int, int]:
        """Two unpacked sizes with the largest sum up to ``room``; (0, 0) if no two fit."""
        a = np.flatnonzero(self.left[1:room]) + 1
        if not len(a):
            return 0, 0
        b = self.upto[np.minimum(room - a, a)]  # the pair's smaller size, so each pair is seen once
        alone = (b == a) & (self.left[a] < 2)
        b = np.where(alone, self.upto[a - 1], b)
        both = np.where(b > 0, a + b, 0)
        k = int(both.argmax())
        return (int(a[k]), int(b[k])) if both[k] else (0, 0)


def best_two_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each piece. Pieces of one size are used in their order, so the result is fixed."""
    unpacked = _Sizes(sizes, capacity)
    order = np.argsort(sizes, kind="stable")
    next_of = np.searchsorted(sizes[order], np.arange(capacity + 2))
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    n = 0
    while unpacked.largest(capacity):
        held, gap = [], capacity
        while size := unpacked.largest(gap):
            unpacked.take(size)
            held.append(size)
            gap -= size
        if gap and len(held) > 1:
            a, b = unpacked.best_two(gap + held[-1])
            if a + b > held[-1]:
                unpacked.give(held[-1])
                unpacked.take(a)
                unpacked.take(b)
                held[-1:] = [a, b]
        at = 0
        for size in held:
            item = order[next_of[size]]
            next_of[size] += 1
            bins[item], offsets[item] = n, at
            at += size
        n += 1
    return bins, offsets


def cut(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id",
        text_col: str = "text") -> DataFrame:
    """Rows of PIECES: every document's ids with the closing one, cut only where they exceed ``capacity``."""
    schema = pa.schema([("number", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                        ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _load(tokenizer_path)
        number = TaskContext.get().partitionId() << 40
        end = np.array([end_id], dtype="<u4")
        for b in batches:
            doc_ids = b.column(0).to_pylist()
            data, offsets = text_buffers(b.column(1))
            for lo, hi in slices(offsets, 2 << 20):
                rows = []
                encoded = bpe.encode(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                for doc_id, tokens in zip(doc_ids[lo:hi], encoded):
                    ids = np.concatenate([tokens, end]).astype("<u4", copy=False)
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start:start + capacity]
                        rows.append((number, doc_id, piece, start, len(part), zlib.crc32(part.tobytes())))
                        number += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return picked.mapInArrow(run, PIECES)


def _pack_block(round_: int, capacity: int):
    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("number")
        sizes = table.column("length").to_numpy()
        bins, offsets = best_two_fit(sizes, capacity)
        filled = np.bincount(bins, sizes)
        ids = (round_ << 58) + (key[0].as_py() << 24) + bins
        return (table.drop_columns(["block"]).append_column("sequence_id", pa.array(ids))
                .append_column("offset", pa.array(offsets))
                .append_column("open", pa.array(filled[bins] <= capacity - capacity // OPEN)))
    return pack


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY,
         block_pieces: int = BLOCK_PIECES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document's ids, each with its place in a sequence of at most ``capacity`` ids.

    Rows: doc_id, piece (from 0), start (ids of its document before it), length, ids_crc32 (of the ids as unsigned
    little-endian 32-bit numbers), sequence_id, offset (gapless from 0 in each sequence). A null or empty text is one
    piece of the closing id. Repeated rows are packed each for itself; a null id stays null; ties in size follow the
    order of the input's splits; other columns are not read; an empty table gives no rows.
    """
    given = stored(cut(docs, tokenizer_path, end_id, capacity, id_col, text_col), "pieces")
    n, done, round_ = given.count(), [], 0
    while True:
        blocks = max(1, -(-n // block_pieces))
        block = F.pmod(F.xxhash64("number"), F.lit(blocks)).alias("block")
        packed = stored(given.select("*", block).groupBy("block").applyInArrow(_pack_block(round_, capacity), PACKED),
                        "packed")
        n_open = packed.where("`open`").count() if blocks > 1 else 0
        if n_open == 0 or 10 * n_open > 9 * n:
            done.append(packed)
            break
        done.append(packed.where("NOT `open`"))
        given, n, round_ = packed.where("`open`").select(*given.columns), n_open, round_ + 1
    return reduce(DataFrame.unionAll, done).select(*RESULT)


def op12_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
