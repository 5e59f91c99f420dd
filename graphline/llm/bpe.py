"""Byte-level BPE encoding and decoding of our own, with a pair occurrence index.

All distinct pre-tokens of a batch lie in one array of symbols with links to the
neighbours. The index maps each pair that has a rank to the positions where it
stands. Active ranks are taken in ascending order; all positions of a pair are
merged at once, and the pairs that this makes with the neighbours are put on the
lists of their ranks. A position that has changed meanwhile is passed over when
its list comes up.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphline.llm.common import documents
from graphline.llm.encode import ChunkEncoder, byte_level_chunks, text_batches

#: Fixed value: the pre-tokenizer's pattern.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Bpe:
    """A vocabulary read from a tokenizer's JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        vocabulary = told["model"]["vocab"]
        of_char = {c: b for b, c in enumerate(byte_alphabet())}
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        size = max([*vocabulary.values(), *self.special.values()]) + 1
        spelled = [b""] * size
        for token, i in vocabulary.items():
            spelled[i] = bytes(of_char[c] for c in token) if all(c in of_char for c in token) else token.encode()
        for token, i in self.special.items():
            spelled[i] = token.encode()
        self.first = np.array([vocabulary[c] for c in byte_alphabet()], np.int64)
        self.bytes, self.size = np.frombuffer(b"".join(spelled), np.uint8), size
        self.length = np.array([len(s) for s in spelled], np.int64)
        self.start = np.cumsum(self.length) - self.length
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in told["model"]["merges"]]
        pair = np.array([vocabulary[a] * size + vocabulary[b] for a, b in merges], np.int64)
        order = np.argsort(pair, kind="stable")
        self.pair, self.rank = pair[order], order
        self.made = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        self.left, self.right = pair // size, pair % size
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.encoder = ChunkEncoder(byte_level_chunks, self._chunks)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 if it has none."""
        pair = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair, pair), len(self.pair) - 1)
        return np.where(self.pair[at] == pair, self.rank[at], -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and the number of ids of each word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        n = int(sizes.sum())
        # symbols with a wall of -1 around them
        symbol = np.full(n + 2, -1, np.int64)
        symbol[1:-1] = self.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.full(n + 2, -1, np.int64)
        word[1:-1] = np.repeat(np.arange(len(words)), sizes)
        right = np.arange(1, n + 3)
        right[-1] = n + 1
        left = np.arange(-1, n + 1)
        left[0] = 0
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(at: np.ndarray) -> None:
            """Put the pairs that begin at these positions on the lists of their ranks."""
            to = right[at]
            at, to = at[same := word[at] == word[to]], to[same]
            rank = self._ranks(symbol[at], symbol[to])
            at, rank = at[known := rank >= 0], rank[known]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, positions in zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts), strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(positions)

        note(np.flatnonzero(word >= 0))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            a, b = self.left[r], self.right[r]
            to = right[at]
            at = at[(symbol[at] == a) & (symbol[to] == b) & (word[at] == word[to])]
            if a == b and len(at) > 1:
                at = self._apart(at, right)
            if not len(at):
                continue
            to = right[at]
            after = right[to]
            symbol[at], symbol[to] = self.made[r], -1
            right[at], left[after] = after, at
            note(np.unique(np.concatenate([left[at], at])))
        on = symbol >= 0
        return symbol[on], np.bincount(word[on], minlength=len(words))

    @staticmethod
    def _apart(at: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of positions of a pair of equal symbols, every second one in a run, leftmost first."""
        follows = np.concatenate([[False], right[at[:-1]] == at[1:]])
        begin = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
        return at[(np.arange(len(at)) - begin) % 2 == 0]

    def _chunks(self, chunks: list[str]) -> list[np.ndarray]:
        numbers: dict[str, int] = {}
        rows: list[list[int]] = []  # numbers of pre-tokens; special ids as their complement
        for chunk in chunks:
            row: list[int] = []
            parts = self.split_special.split(chunk) if self.split_special else [chunk]
            for k, part in enumerate(parts):
                if k % 2:
                    row.append(~self.special[part])
                elif part:
                    row += [numbers.setdefault(p, len(numbers)) for p in PRE_TOKEN.findall(part)]
            rows.append(row)
        ids, sizes = self.merge([p.encode() for p in numbers])
        cuts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        listed = ids.tolist()
        return [[i for p in row for i in (listed[cuts[p] : cuts[p + 1]] if p >= 0 else [~p])] for row in rows]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.encoder.encode(texts)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The texts of consecutive runs of ids; bytes that aren't UTF-8 become U+FFFD."""
        length = self.length[ids]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        data = self.bytes[np.arange(total) + np.repeat(self.start[ids] - (ends - length), length)].tobytes()
        last = np.concatenate([[0], ends])[np.cumsum(sizes)] if len(sizes) else []
        cuts = [0, *map(int, last)]
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Bpe:
    return Bpe(path)


def digests(docs: DataFrame, path: str, batch_chars: int = 2 << 20) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null text counts as empty: no ids, and the digests of nothing. Strings of
    special tokens in a text become their ids. An empty table gives an empty
    result; other columns are ignored.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in parts:
            texts, n, of_ids, of_text = batch.column(1).to_pylist(), [], [], []
            for a, b in text_batches(texts, batch_chars):
                ids, sizes = bpe.encode(texts[a:b])
                data = memoryview(ids.astype("<u4")).cast("B")
                ends = np.cumsum(sizes)
                n += sizes.tolist()
                of_ids += [hashlib.sha256(data[4 * (e - s) : 4 * e]).hexdigest() for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                of_text += [hashlib.sha256(t.encode()).hexdigest() for t in bpe.decode(ids, sizes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = documents(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
