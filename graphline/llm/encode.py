"""Encoding whole texts with public tokenizers, chunk by chunk.

A text is cut where no token of the vocabulary can cross, so its ids are those of
its chunks one after another. Equal chunks are encoded once per cache; the cache
is emptied when it reaches its bound. The tests hold the cuts against encodings
of uncut texts.
"""

from __future__ import annotations

import base64
import contextlib
import ctypes
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Chunks begin at a run of blanks or newlines; further kinds of white space are not cut at.
PLAIN = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
OTHER_SPACE = re.compile(r"[^\S \n]")
CAREFUL = re.compile(r"(?<=\S)(?=[ \n])")
WORDS = re.compile(r"[^ \n]+")

#: Chunks that an encoder remembers; about 200 bytes each.
MAX_CHUNKS = 1_000_000


def byte_level_chunks(text: str) -> list[str]:
    """Cuts for byte-level BPE whose pre-tokens hold white space at their front only."""
    if OTHER_SPACE.search(text):
        return [c for c in CAREFUL.split(text) if c]
    return PLAIN.findall(text)


#: A chunk of more characters is cut further, about this often.
LONG_CHUNK = 2048
#: What stands before a chunk that continues another. No chunk of a text has a newline behind anything else.
GOES_ON = "x\n"


def piece_chunks(text: str, touching: frozenset[str] = frozenset()) -> list[str]:
    """Cuts for pieces that hold the blank at their front only; a chunk's first blank stands for the dummy prefix.

    With ``touching``, the pairs of characters that stand side by side in a piece, the
    model's sign for a blank is taken for one, and a long chunk is cut between
    characters that are no such pair; it stays whole where all are. Without it such
    texts and chunks stay whole.
    """
    if not text:
        return []
    if not touching:
        return [" " + text] if "▁" in text else PLAIN.findall(" " + text)
    chunks = PLAIN.findall(" " + text.replace("▁", " "))
    if max(map(len, chunks)) <= LONG_CHUNK:
        return chunks
    return [part for chunk in chunks for part in (_cut(chunk, touching) if len(chunk) > LONG_CHUNK else (chunk,))]


def _cut(chunk: str, touching: frozenset[str]) -> Iterator[str]:
    start, bare = 0, len(chunk) - len(chunk.lstrip(" \n"))
    for end in range(bare + 1, len(chunk)):
        if end - start >= LONG_CHUNK and chunk[end - 1 : end + 1] not in touching:
            yield (GOES_ON if start else "") + chunk[start:end]
            start = end
    yield (GOES_ON if start else "") + chunk[start:]


class _Index(dict):
    """Chunk to number; notes the chunks that are new."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        self.fresh.append(chunk)
        return n


class ChunkEncoder:
    """Ids of texts from the ids of their chunks.

    ``encode_many`` gives the ids of each of a list of chunks. The cache is
    emptied before a batch once it holds ``max_chunks`` chunks or ``max_chars`` characters.
    """

    def __init__(self, chunks: Callable[[str], list[str]], encode_many: Callable[[list[str]], list], max_chunks: int = MAX_CHUNKS, max_chars: int = 24 << 20):
        self.chunks, self.encode_many, self.max_chunks, self.max_chars = chunks, encode_many, max_chunks, max_chars
        self._clear()

    def _clear(self) -> None:
        self.index, self.chars, self.held = _Index(), 0, 0
        self.flat = np.empty(1 << 16, np.int32)
        self.length = np.empty(1 << 15, np.int32)
        self.start = np.empty(1 << 15, np.int64)

    def _learn(self) -> None:
        fresh, self.index.fresh = self.index.fresh, []
        if not fresh:
            return
        self.chars += sum(map(len, fresh))
        first = len(self.index) - len(fresh)
        for at in range(0, len(fresh), 20_000):
            ids = self.encode_many(fresh[at : at + 20_000])
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            end = self.held + int(sizes.sum())
            if end > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty(max(end, len(self.flat)), np.int32)])
            if first + len(ids) > len(self.start):
                more = max(first + len(ids), len(self.start))
                self.start, self.length = np.concatenate([self.start, np.empty(more, np.int64)]), np.concatenate([self.length, np.empty(more, np.int32)])
            self.flat[self.held : end] = np.fromiter((x for one in ids for x in one), np.int32, end - self.held)
            self.start[first : first + len(ids)] = self.held + np.cumsum(sizes) - sizes
            self.length[first : first + len(ids)] = sizes
            self.held, first = end, first + len(ids)

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all chunks, one after another, and the number of chunks of each text."""
        if len(self.index) > self.max_chunks or self.chars > self.max_chars:
            self._clear()
        get, chunks = self.index.__getitem__, self.chunks
        rows = [np.fromiter(map(get, c), np.int32, len(c)) for c in map(chunks, texts)]
        self._learn()
        return (np.concatenate(rows) if rows else np.empty(0, np.int32)), np.fromiter(map(len, rows), np.int64, len(rows))

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Number of ids of each text."""
        chunk, sizes = self.numbers(texts)
        return per_text(self.length[chunk], sizes)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the number of ids of each text."""
        chunk, sizes = self.numbers(texts)
        lens = self.length[chunk].astype(np.int64)
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.start[chunk] - (ends - lens), lens)
        return self.flat[at], per_text(lens, sizes)


def per_text(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values``, as many in each as ``sizes`` says."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def text_batches(texts: list[str], max_chars: int) -> Iterator[tuple[int, int]]:
    """(from, to) of consecutive texts with about ``max_chars`` characters; a longer text stands alone."""
    start = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > max_chars:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def text_slices(column: pa.Array, max_bytes: int) -> Iterator[tuple[int, int, list[str]]]:
    """(from, to, texts) of consecutive texts with about ``max_bytes`` bytes; null is empty, a longer text stands alone. Only these become Python strings."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(column):
        done = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + max_bytes, "right")))
        yield start, end, [t or "" for t in column.slice(start, end - start).to_pylist()]
        start = end


#: Encoders of this Python worker, by vocabulary: later batches and tasks find them warm.
_KEPT: dict[tuple[str, str], ChunkEncoder] = {}


def _byte_level(path: str) -> ChunkEncoder:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return ChunkEncoder(byte_level_chunks, lambda chunks: [e.ids for e in tokenizer.encode_batch_fast(chunks, add_special_tokens=False)])


def _word_level(path: str) -> ChunkEncoder:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return ChunkEncoder(WORDS.findall, lambda chunks: [e.ids for e in tokenizer.encode_batch_fast(chunks, add_special_tokens=False)])


def _piece(path: str, cut: bool = False) -> ChunkEncoder:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    blank = model.piece_to_id("▁")
    touching = set()
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if "▁" in piece.lstrip("▁") or "\n" in piece:
            raise ValueError(f"piece {piece!r} crosses the cuts of piece_chunks")
        touching.update(piece[k : k + 2] for k in range(len(piece) - 1))
    pairs = frozenset(touching if cut else ())

    def encode_many(chunks: list[str]) -> list[list[int]]:
        # the model puts a blank before each text; it stands for the first blank of the chunk.
        # What continues another chunk is encoded behind a newline, which no piece holds
        bare = [c[1:] if c[0] == " " or c.startswith(GOES_ON) else c for c in chunks]
        found = model.encode(bare, num_threads=1)
        return [[blank] if not b else ids if c[0] == " " else ids[2:] if c.startswith(GOES_ON) else ids[1:] for c, b, ids in zip(chunks, bare, found, strict=True)]

    return ChunkEncoder(lambda text: piece_chunks(text, pairs), encode_many)


MAKERS = {"byte": _byte_level, "word": _word_level, "piece": _piece, "cut": lambda path: _piece(path, cut=True)}


def encoder(kind: str, path: str, max_chunks: int = MAX_CHUNKS) -> ChunkEncoder:
    """``kind``: byte (byte-level BPE), word (BPE with word ends, white space dropped), piece (sentencepiece), cut (the same, with long runs of characters cut too). A worker keeps the last two."""
    if (kind, path) not in _KEPT:
        while len(_KEPT) > 1:
            _KEPT.pop(next(iter(_KEPT)))
        _KEPT[kind, path] = MAKERS[kind](path)
    found = _KEPT[kind, path]
    found.max_chunks = max_chunks
    return found


#: Pre-token pattern of the byte-level vocabulary, a fixed value of it.
BYTE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(1)
def _ranks(path: str):
    """The tiktoken encoding of a file of ranks."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("byte", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_lengths(path: str, texts: list[str], max_chunks: int = MAX_CHUNKS) -> np.ndarray:
    """Number of byte-level tokens of each text: by tiktoken on whole texts for .tiktoken (four times as fast), else by ``encoder``.

    Both give the same numbers for the same vocabulary, but tiktoken takes special strings as ordinary text.
    """
    if not path.endswith(".tiktoken"):
        return encoder("byte", path, max_chunks).lengths(texts)
    encode = _ranks(path).encode_ordinary
    return np.fromiter((len(encode(t)) for t in texts), np.int64, len(texts))


def release() -> None:
    """Give back what encoders of this worker hold, and memory that is free, for tasks that need none: a worker lives on from one operator to the next."""
    _KEPT.clear()
    _ranks.cache_clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, of a task that needs no encoder: what the worker holds is given back before it, and what the task held after it."""

    def tidied(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        try:
            yield from run(parts)
        finally:
            release()

    return tidied
