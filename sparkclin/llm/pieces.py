"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a single-pass Viterbi.

Pieces and scores come from a SentencePiece model file. The automaton reads a text once; at each position its
output links name every piece that ends there, and each relaxes the best score of that position. A character
no piece covers becomes its bytes (``<0x..>`` pieces) or the unknown piece, ten below the lowest score.

No piece of such a vocabulary holds a word-start mark after another character, so a text falls into
independent chunks, each beginning at a run of marks. A chunk's ids are kept, so a repeated chunk costs one lookup.

Scores are taken as the model gives them and added up (the unigram reading): the best path maximises their
sum. A vocabulary trained by pair merging segments differently under its own merge procedure; the round trip is
exact either way.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkclin.llm.bpe import ChunkEncoder, space_neighbours
from sparkclin.llm.words import slices, text_buffers

MARK = "▁"
UNKNOWN_PENALTY = 10.0
_CHUNKS = re.compile(MARK + "*[^" + MARK + "]*")

# Piece types of the model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Automaton:
    """Aho-Corasick over pieces. Per state: goto, failure link, the piece that ends here, and the output link to
    the next shorter suffix that is a piece."""

    def __init__(self, pieces: dict[str, tuple[int, float]]):
        self.goto: list[dict[str, int]] = [{}]
        self.piece: list[tuple[int, int, float] | None] = [None]  # (length, id, score)
        for text, (i, score) in pieces.items():
            state = 0
            for c in text:
                nxt = self.goto[state].get(c)
                if nxt is None:
                    nxt = self.goto[state][c] = len(self.goto)
                    self.goto.append({})
                    self.piece.append(None)
                state = nxt
            self.piece[state] = (len(text), i, score)
        self.fail = [0] * len(self.goto)
        self.output = [0] * len(self.goto)
        queue = deque(self.goto[0].values())
        while queue:
            state = queue.popleft()
            for c, nxt in self.goto[state].items():
                f = self.fail[state]
                while f and c not in self.goto[f]:
                    f = self.fail[f]
                f = self.goto[f].get(c, 0)
                self.fail[nxt] = f
                self.output[nxt] = f if self.piece[f] is not None else self.output[f]
                queue.append(nxt)

    def step(self, state: int, c: str) -> int:
        goto = self.goto
        while state and c not in goto[state]:
            state = self.fail[state]
        return goto[state].get(c, 0)


class PieceModel(ChunkEncoder):
    """Vocabulary, automaton and chunk cache of one model file."""

    def __init__(self, path: str, most: int = 1_500_000):
        super().__init__(most)
        from sentencepiece import sentencepiece_model_pb2 as pb
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.pieces = [p.piece for p in model.pieces]
        self.add_mark = model.normalizer_spec.add_dummy_prefix
        self.byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        normal = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.floor = min((s for _, s in normal.values()), default=0.0) - UNKNOWN_PENALTY
        self.automaton = Automaton(normal)
        self.independent = not any(re.search("[^" + MARK + "]" + MARK, p) for p in normal)
        byte_of = {i: bytes([b]) for b, i in self.byte_ids.items()}
        self.written = [byte_of.get(i, p.replace(MARK, " ").encode()) for i, p in enumerate(self.pieces)]

    def viterbi(self, text: str) -> list[int]:
        """Ids on the best path: one pass over ``text``. Equal scores: the longer last piece."""
        n = len(text)
        best = [0.0] + [-np.inf] * n
        back: list[tuple[int, int]] = [(0, 0)] * (n + 1)  # (length, id) of the last piece
        a = self.automaton
        state, piece, output = 0, a.piece, a.output
        for k, c in enumerate(text, 1):
            state = a.step(state, c)
            s = state if piece[state] is not None else output[state]
            top, last = -np.inf, (1, -1)
            while s:
                length, i, score = piece[s]
                v = best[k - length] + score
                if v > top:
                    top, last = v, (length, i)
                s = output[s]
            if not self._covers(c):
                v = best[k - 1] + self.floor
                if v > top:
                    top, last = v, (1, -1)
            best[k], back[k] = top, last
        ids: list[int] = []
        k = n
        while k:
            length, i = back[k]
            if i >= 0:
                ids.append(i)
            else:
                ids.extend(self._spelled(text[k - 1])[::-1])
            k -= length
        return ids[::-1]

    def _covers(self, c: str) -> bool:
        s = self.automaton.goto[0].get(c, 0)
        return bool(s) and self.automaton.piece[s] is not None

    def _spelled(self, c: str) -> list[int]:
        raw = c.encode("utf-8", "replace")
        if all(b in self.byte_ids for b in raw):
            return [self.byte_ids[b] for b in raw]
        return [self.unknown]

    def chunk_ids(self, chunk: str, head: bool) -> list[int]:
        return self.viterbi(chunk if head and not self.add_mark else MARK + chunk)

    def whole_ids(self, text: str) -> list[int]:
        if not text:
            return []
        marked = (MARK if self.add_mark else "") + text.replace(" ", MARK)
        if not self.independent:
            return self.viterbi(marked)
        return [i for chunk in _CHUNKS.findall(marked) for i in self.viterbi(chunk)]

    def unsafe(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A space is first, last or next to another space, or pieces span words."""
        out = np.full(len(offsets) - 1, not self.independent)
        k, edge, _, _, p1, n1, _ = space_neighbours(data, offsets)
        out[k[edge | (p1 == 0x20) | (n1 == 0x20)]] = True
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``; bytes that are not UTF-8 become replacement characters."""
        text = b"".join(map(self.written.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.add_mark and text.startswith(" ") else text


_LOADED: dict[str, PieceModel] = {}


def load(path: str) -> PieceModel:
    """The worker process's model; tasks that a worker runs one after another share its chunk cache."""
    if path not in _LOADED:
        _LOADED[path] = PieceModel(path)
    return _LOADED[path]


def _map_texts(docs: DataFrame, model_path: str, id_col: str, text_col: str, each, ddl: str,
               types: list) -> DataFrame:
    names = [c.split(" ")[0] for c in ddl.split(", ")]
    schema = pa.schema([pa.field(n, t) for n, t in zip(names, types)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for b in batches:
            doc_ids = b.column(0).to_pylist()
            data, offsets = text_buffers(b.column(1))
            for lo, hi in slices(offsets, 2 << 20):  # bounded scratch and output batches
                own = offsets[lo:hi + 1] - offsets[lo]
                part = data[offsets[lo]:offsets[hi]]
                encoded, raw = model.encode(part, own), part.tobytes()
                rows = [(d, *each(model, ids, raw[own[i]:own[i + 1]]))
                        for i, (d, ids) in enumerate(zip(doc_ids[lo:hi], encoded))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], schema=schema)

    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return picked.mapInArrow(run, ddl)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text; null and empty texts have no ids. One scan, no shuffle;
    repeated rows are encoded alike, an empty table gives none, other columns are not read."""
    return _map_texts(docs, model_path, id_col, text_col, lambda m, ids, t: (ids.astype(np.int32),),
                      "doc_id long, ids array<int>", [pa.int64(), pa.list_(pa.int32())])


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for b in batches:
            texts = [model.decode(np.array(x or [], dtype=np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: n_ids, n_byte_ids, ids_crc32 (unsigned little-endian 32-bit ids), decoded_sha256 and whether
    decoding gives the text back. Ids do not leave the task."""
    def each(model: PieceModel, ids: np.ndarray, raw: bytes):
        back = model.decode(ids).encode("utf-8", "replace")
        return (len(ids), int(np.isin(ids, list(model.byte_ids.values())).sum()),
                zlib.crc32(ids.astype("<u4", copy=False).tobytes()), hashlib.sha256(back).hexdigest(), back == raw)

    return _map_texts(docs, model_path, id_col, text_col, each,
                      "doc_id long, n_ids long, n_byte_ids long, ids_crc32 long, decoded_sha256 string, "
                      "round_trip boolean", [pa.int64()] * 4 + [pa.string(), pa.bool_()])


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
