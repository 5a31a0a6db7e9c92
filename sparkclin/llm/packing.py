"""Sequence packing with Karmarkar-Karp multiway differencing.

Each document's token stream is cut into full sequences, which stand alone, and a tail of fewer tokens, cut
into pieces of at most ``max_piece``. Tails are gathered into blocks of ``block_windows`` sequences' worth of
tokens (a piece may be cut to fill one), and each block is partitioned into windows: every partial partition
starts as one piece, and the two with the largest spread are merged again and again, the fullest windows of one
with the emptiest of the other, until one partition of near-equal windows is left. If a window exceeds the capacity, the window count
rises and the block is partitioned anew.

Tokenising, cutting and packing happen in one pass over each input partition: nothing is shuffled, a block is
bounded, and a lost task is redone from its own split alone. Sequence ids combine the partition number with a
counter, so they are unique without coordination. A task's last block may hold less than a block's worth and
so pads at most one window's share.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkclin.llm.bpe import load
from sparkclin.llm.words import slices, text_buffers

CAPACITY = 2048
MAX_PIECE = 512
BLOCK_WINDOWS = 128
SLACK = 12  # ids a window that a full block leaves free, so that near-equal windows fit at once

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "`offset` long")


def karmarkar_karp(sizes: np.ndarray, windows: int) -> tuple[np.ndarray, int]:
    """(window number of each item, largest window sum) of a partition of ``sizes`` into ``windows``.

    A partial partition is its non-empty windows in descending order of their sums; the others are empty. Each
    window is known by one of its items, and ``joined`` points from a window that was added to another. Equal
    spreads are merged in the order they arose, so the result is deterministic.
    """
    n = len(sizes)
    joined = np.arange(n)
    one = 1 if windows > 1 else 0
    heap = [(-int(s) * one, i, sizes[i:i + 1], joined[i:i + 1].copy()) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    age = n
    while len(heap) > 1:
        _, _, a, wa = heapq.heappop(heap)
        _, _, b, wb = heapq.heappop(heap)
        both = max(0, len(a) + len(b) - windows)
        alone_a, alone_b = len(a) - both, len(b) - both
        # Opposing order: the emptiest windows of b go onto the rest of a, the smallest of them first.
        if both:
            joined[wb[alone_b:][::-1]] = wa[alone_a:]
            a = np.concatenate([a[:alone_a], a[alone_a:] + b[alone_b:][::-1], b[:alone_b]])
        else:
            a = np.concatenate([a, b])
        wa = np.concatenate([wa, wb[:alone_b]])
        order = np.argsort(-a, kind="stable")
        a, wa = a[order], wa[order]
        spread = int(a[0]) - (int(a[-1]) if len(a) == windows else 0)
        heapq.heappush(heap, (-spread, age, a, wa))
        age += 1
    _, _, sums, roots = heap[0]
    while True:
        up = joined[joined]
        if np.array_equal(up, joined):
            break
        joined = up
    number = np.empty(n, dtype=np.int64)
    number[roots] = np.arange(len(roots))
    return number[joined], int(sums[0])


def pack_block(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Window of each item; the window count rises from the least possible until no window exceeds capacity."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window, largest = karmarkar_karp(sizes, windows)
        if largest <= capacity:
            return window
        windows += 1


def _tail_cuts(start: int, length: int, max_piece: int) -> list[tuple[int, int]]:
    """Near-equal pieces of a tail, none longer than ``max_piece``."""
    n = -(-length // max_piece)
    at, out = start, []
    for i in range(n):
        size = length // n + (i < length % n)
        out.append((at, size))
        at += size
    return out


class _Packer:
    """Pieces of one partition in, packed rows out."""

    def __init__(self, partition: int, capacity: int, max_piece: int, block_windows: int):
        self.next_id = partition << 40
        self.capacity, self.max_piece = capacity, max_piece
        self.block_tokens = block_windows * (capacity - SLACK)
        self.tails: list[tuple] = []
        self.tail_tokens = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        n = len(ids)
        full = n - n % self.capacity
        for start in range(0, full, self.capacity):
            self.rows.append((doc_id, start, self.capacity, self._crc(ids, start, self.capacity), n, self.next_id, 0))
            self.next_id += 1
        for start, size in _tail_cuts(full, n - full, self.max_piece):
            while size:
                take = min(size, self.block_tokens - self.tail_tokens)
                self.tails.append((doc_id, start, take, self._crc(ids, start, take), n))
                self.tail_tokens += take
                start, size = start + take, size - take
                if self.tail_tokens == self.block_tokens:
                    self.flush()

    @staticmethod
    def _crc(ids: np.ndarray, start: int, size: int) -> int:
        return zlib.crc32(ids[start:start + size].astype("<u4", copy=False).tobytes())

    def flush(self) -> None:
        if self.tails:
            window = pack_block(np.array([t[2] for t in self.tails]), self.capacity)
            filled = [0] * (int(window.max()) + 1)
            for t, w in zip(self.tails, window.tolist()):
                self.rows.append((*t, self.next_id + w, filled[w]))
                filled[w] += t[2]
            self.next_id += len(filled)
        self.tails, self.tail_tokens = [], 0

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [[] for _ in schema]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY,
         max_piece: int = MAX_PIECE, block_windows: int = BLOCK_WINDOWS, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Pieces of every document's ids, each with its place in a sequence of at most ``capacity`` ids.

    Rows: doc_id, start (ids of its document before it), length, ids_crc32 (of the ids as unsigned little-endian
    32-bit numbers), doc_tokens (with the closing ``end_id``), sequence_id, offset (gapless from 0 in each
    sequence). A null or empty text is one piece of the closing id. Repeated rows are packed each for itself;
    a null id stays null; other columns are not read; an empty table gives no rows.
    """
    fields = [pa.field(n, pa.int64()) for n in
              ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path)
        packer = _Packer(TaskContext.get().partitionId(), capacity, max_piece, block_windows)
        end = np.array([end_id], dtype="<u4")
        for b in batches:
            ids = b.column(0).to_pylist()
            data, offsets = text_buffers(b.column(1))
            for lo, hi in slices(offsets, 2 << 20):
                part = data[offsets[lo]:offsets[hi]]
                for doc_id, tokens in zip(ids[lo:hi], bpe.encode(part, offsets[lo:hi + 1] - offsets[lo])):
                    packer.add(doc_id, np.concatenate([tokens, end]))
                if len(packer.rows) >= 20_000:
                    yield packer.batch(schema)
        packer.flush()
        yield packer.batch(schema)

    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return picked.mapInArrow(run, SCHEMA)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
