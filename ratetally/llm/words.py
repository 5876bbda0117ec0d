"""Hashes of the words of many texts at once, for operators that compare word sequences inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from ratetally.llm.common import kept

REMEMBERED = 150_000
# Words that are hashed together; a longer text is a chunk of its own.
CHUNK_WORDS = 400_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Bytes of a word to a 64-bit hash; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(kept("word hashes", WordHashes).__getitem__, words), "uint64", len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive words."""
    n = max(0, len(hashes) - k + 1)
    out = hashes[:n].copy()
    for i in range(1, k):
        out *= FACTOR
        out += hashes[i : i + n]
    return mixed(out)


def chunks(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, list[int], np.ndarray]]:
    """(first row, words per row, hashes of all these words) over a column of texts; null has no words."""
    first, counts, held, total = 0, [], [], 0
    for i, text in enumerate(column):
        raw = (text.as_py() or "").encode()
        words = (raw.lower() if lower else raw).split()
        counts.append(len(words))
        held.append(hashes_of(words))
        total += len(words)
        if total >= CHUNK_WORDS:
            yield first, counts, np.concatenate(held)
            first, counts, held, total = i + 1, [], [], 0
    if counts:
        yield first, counts, np.concatenate(held)
