"""Byte-level BPE ids of Arrow text, each distinct space-separated chunk encoded once.

The tokenizer's own split never joins a non-space character with the single space that follows it: such a space
begins the next token. So a text can be cut there, and its ids are the chunks' ids in a row. Chunks are found and
hashed over the whole batch at once; only chunks not yet in the cache are encoded. Texts in which a space meets
other white space (or a character that may be white space) are encoded whole.

The vocabulary file is that of the ``tokenizers`` library. Its merges are in id order, which makes ids usable as
merge ranks, so the byte-pair work itself can be done by ``tiktoken`` on the same vocabulary; tests hold the ids
against the ``tokenizers`` library.
"""

from __future__ import annotations

import json
from itertools import repeat

import numpy as np
import tiktoken

from sparkclin.llm.words import Words

# Fixed value: the split pattern of this family of byte-level tokenizers.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_SPACE = np.zeros(256, dtype=bool)
_SPACE[0x20] = True
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
_LEAD3 = np.zeros(256, dtype=bool)  # lead bytes of three-byte characters, among them the wider white space
_LEAD3[[0xE1, 0xE2, 0xE3]] = True
_FIRST = np.uint64(0x5851F42D4C957F2D)


def _byte_alphabet() -> dict[str, int]:
    """Byte of each printable stand-in: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    for i, b in enumerate(x for x in range(256) if x not in plain):
        out[chr(0x100 + i)] = b
    return out


def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    alphabet = _byte_alphabet()
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = ["".join(m) for m in merges]
    if any(model["vocab"][m] != 256 + i for i, m in enumerate(made)):
        raise ValueError(f"{path}: merges are not in id order")
    ranks = {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items()
             if i < 256 + len(merges)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class ChunkEncoder:
    """Ids of texts from the ids of their chunks; subclasses say what a chunk's ids are."""

    def __init__(self, most: int):
        self.most = most  # chunks held before the cache is emptied: bounds memory, not what is encoded
        self._clear()

    def chunk_ids(self, chunk: str, head: bool) -> list[int]:
        """Ids of a chunk after a space, or (``head``) at a text's start."""
        raise NotImplementedError

    def whole_ids(self, text: str) -> list[int]:
        raise NotImplementedError

    def unsafe(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts that can't be cut at their spaces."""
        raise NotImplementedError

    def _clear(self) -> None:
        self.slot: dict[int, int] = {}
        self.pool, self.used = np.zeros(1 << 16, dtype="<u4"), 0
        self.begin = np.zeros(1 << 14, dtype=np.int64)

    def _add(self, key: int, ids: list[int]) -> int:
        k, n = len(self.slot), len(ids)
        while self.used + n > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        if k + 2 > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
        self.pool[self.used:self.used + n] = ids
        self.used += n
        self.begin[k + 1] = self.used
        self.slot[key] = k
        return k

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each text of a byte buffer (UTF-8 texts one after another)."""
        if len(self.slot) > self.most:
            self._clear()
        words = Words(data, offsets, separators=_SPACE)
        rows = len(offsets) - 1
        whole = self.unsafe(data, offsets)
        keys = words.hashes
        heads = words.first[:-1][np.diff(words.first) > 0]
        keys[heads] ^= _FIRST
        row = words.text_of_word()
        used = ~whole[row]
        distinct, at, back = np.unique(keys[used], return_index=True, return_inverse=True)
        slots = np.fromiter(map(self.slot.get, distinct.tolist(), repeat(-1)), np.int64, len(distinct))
        index = np.flatnonzero(used)[at]
        raw = data.tobytes()
        head = np.zeros(len(keys), dtype=bool)
        head[heads] = True
        for j in np.flatnonzero(slots < 0).tolist():
            w = index[j]
            text = raw[words.starts[w]:words.ends[w]].decode("utf-8", "replace")
            slots[j] = self._add(int(distinct[j]), self.chunk_ids(text, bool(head[w])))
        of_word = slots[back]
        begin, count = self.begin[of_word], self.begin[of_word + 1] - self.begin[of_word]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.pool[np.repeat(begin - total[:-1], count) + np.arange(total[-1])]
        upto = total[np.concatenate([[0], np.cumsum(used)])[words.first]]
        out = [ids[upto[i]:upto[i + 1]] for i in range(rows)]
        for i in np.flatnonzero(whole).tolist():
            text = raw[offsets[i]:offsets[i + 1]].decode("utf-8", "replace")
            out[i] = np.array(self.whole_ids(text), dtype="<u4")
        return out


def space_neighbours(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text of each space, whether it is the text's first or last byte, three bytes before, two after)."""
    s = np.flatnonzero(data == 0x20)
    pad = np.concatenate([[0, 0, 0], data, [0, 0]]).astype(np.uint8)
    k = np.searchsorted(offsets, s, "right") - 1
    edge = (s == offsets[k]) | (s == offsets[k + 1] - 1)
    return k, edge, pad[s], pad[s + 1], pad[s + 2], pad[s + 4], pad[s + 5]


class ByteBpe(ChunkEncoder):
    def __init__(self, path: str, most: int = 1_500_000):
        super().__init__(most)
        self.encoding = _encoding(path)

    def chunk_ids(self, chunk: str, head: bool) -> list[int]:
        return self.encoding.encode_ordinary(chunk if head else " " + chunk)

    def whole_ids(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def unsafe(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A space is first, last or next to what may be white space."""
        out = np.zeros(len(offsets) - 1, dtype=bool)
        k, edge, p3, p2, p1, n1, n2 = space_neighbours(data, offsets)
        two = lambda a, b: (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        out[k[edge | _WHITE[p1] | _WHITE[n1] | two(p2, p1) | two(n1, n2) | _LEAD3[p3] | _LEAD3[n1]]] = True
        return out


_LOADED: dict[str, ByteBpe] = {}


def load(path: str) -> ByteBpe:
    """The worker process's encoder for ``path``; tasks that a worker runs one after another share its cache."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]
