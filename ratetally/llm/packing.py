"""Packing token sequences: best-fit decreasing with a segment tree over the remaining capacity."""

from __future__ import annotations

import re
import string
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ratetally.llm.common import kept, stored

END_ID = 2
# Words whose ids a worker remembers; the table is emptied when full.
REMEMBERED = 600_000
# Texts whose new words are encoded together.
TEXTS = 64
MARKS = string.punctuation.encode()
# Special tokens start so.
SPECIAL = b"<|"
# Bytes that start characters from U+0300 on; below it nothing is composed.
COMPOSED = bytes(range(0xCC, 0x100))
# Words of small letters, which the tokenizer neither changes nor cuts before it looks them up.
PLAIN = re.compile(rb"(?:[a-z]|\xC3[\x9F-\xB6\xB8-\xBF])+")
# A letter or digit at the end of what stands before marks.
LAST = re.compile(rb"(?:[0-9A-Za-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF])\Z")
# How the vocabulary writes bytes: those of no visible character come from U+0100 on.
HIDDEN = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b)]
BYTES = {b: 0x100 + i for i, b in enumerate(HIDDEN)}


class WordEncoder(dict):
    """Bytes of a word to the bytes of its ids.

    The vocabulary never joins what white space parts, and parts letters and digits from marks. So a word can be encoded by
    itself, and marks after a letter or digit apart from the word. Words are kept as they are written: composing comes before
    lower case, and special tokens are found before both. Only texts that cannot hold such a token, and of characters that
    nothing composes, have A-Z lower-cased at once to have fewer words. Plain words go straight to the model.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model

    def learn(self, words: set[bytes]) -> None:
        stems = {}
        for word in words:
            stem = word.rstrip(MARKS)
            if len(stem) < len(word) and SPECIAL not in word and LAST.search(stem, max(len(stem) - 2, 0)):
                stems[word] = stem, word[len(stem) :]
        new = [part for part in {part for word in words for part in stems.get(word, (word,))} if part not in self]
        tokens, others = self.model.tokenize, []
        for word in new:
            if PLAIN.fullmatch(word):
                self[word] = array("I", [t.id for t in tokens(word.decode("latin-1").translate(BYTES))]).tobytes()
            else:
                others.append(word)
        for word, got in zip(others, self.tokenizer.encode_batch_fast([w.decode() for w in others], add_special_tokens=False)):
            self[word] = array("I", got.ids).tobytes()
        for word, (stem, marks) in stems.items():
            self[word] = self[stem] + self[marks]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of every whole text."""
        split = []
        for text in texts:
            raw = text.encode()
            if SPECIAL not in raw and (text.isascii() or len(raw.translate(None, COMPOSED)) == len(raw)):
                raw = raw.lower()
            split.append(raw.split())
        if len(self) > REMEMBERED:
            self.clear()
        new = {word for word in set().union(*split) if word not in self}
        if new:
            self.learn(new)
        for some in split:
            yield b"".join(map(self.__getitem__, some))


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process, kept between tasks of this operator."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return kept(f"encoder {path}", lambda: WordEncoder(path))


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens): every document cut into full windows and a rest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            at, start, length, crc, whole = [], [], [], [], []
            texts = (text.as_py() or "" for text in batch.column(1))
            encoded = chain.from_iterable(encode(some) for some in iter(lambda: list(islice(texts, TEXTS)), []))
            for i, ids in enumerate(encoded):
                ids += end
                n = len(ids) // 4
                for s in range(0, n, capacity):
                    piece = ids[4 * s : 4 * (s + capacity)]
                    at.append(i)
                    start.append(s)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    whole.append(n)
            cols = [batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(x, pa.int64()) for x in (start, length, crc, whole)]]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "start", "length", "ids_crc32", "doc_tokens"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(narrow.dtypes)["id"]
    return narrow.mapInArrow(cut, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of every length, taken in the given (decreasing) order.

    A segment tree over the remaining capacities 0..capacity says where an open bin exists; the tightest that
    fits is the leftmost such leaf at or above the length, found in a logarithmic number of steps.
    """
    width = 1 << (capacity + 1).bit_length()
    tree = [0] * (2 * width)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    used: list[int] = []
    bins, offsets = [], []

    def change(leaf: int, by: int) -> None:
        node = leaf + width
        while node:
            tree[node] += by
            node >>= 1

    def tightest(least: int) -> int:
        node = least + width
        if tree[node]:
            return least
        while node > 1:
            if not node & 1 and tree[node + 1]:
                node += 1
                while node < width:
                    node = 2 * node if tree[2 * node] else 2 * node + 1
                return node - width
            node >>= 1
        return -1

    for n in lengths:
        room = tightest(n)
        if room < 0:
            b, room = len(used), capacity
            used.append(0)
        else:
            b = open_bins[room].pop()
            change(room, -1)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        if room > n:
            open_bins[room - n].append(b)
            change(room - n, 1)
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = 4096, group_rows: int = 32_768) -> DataFrame:
    """``pieces`` (id, start, length, …) with sequence_id and offset.

    The pieces are dealt by a hash of (id, start) over groups of about ``group_rows``, and every group is
    packed by itself, so memory is bounded and the padding lost to it is at most one sequence a group. Within a
    group the order is length descending, id, start: reruns agree. sequence_id holds the group and the place.
    Null ids are an id of their own; rows that repeat an id are packed as often as they occur.
    """
    pieces = stored(pieces)
    groups = max(1, -(-pieces.count() // group_rows))
    kind = dict(pieces.dtypes)["id"]

    def pack_group(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.drop_columns(["_group"]).sort_by([("length", "descending"), ("id", "ascending"), ("start", "ascending")])
        bins, offsets = best_fit(rows["length"].to_pylist(), capacity)
        first = key[0].as_py() << 32
        rows = rows.append_column("sequence_id", pa.array(np.array(bins, "int64") + first))
        return rows.append_column("offset", pa.array(offsets, pa.int64()))

    named = pieces.withColumn("_group", F.pmod(F.xxhash64("id", "start"), F.lit(groups)))
    return named.groupBy("_group").applyInArrow(pack_group, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize, cut and pack: id, start, length, ids_crc32, doc_tokens, sequence_id, offset per piece.

    A null or empty text is one piece that holds only the end id. An empty table gives an empty result; other
    columns are ignored.
    """
    return pack(pieces_of(docs, tokenizer, capacity, id_col, text_col), capacity).withColumnRenamed("id", id_col)
