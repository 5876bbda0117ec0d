"""Grouping spelling variants: Bloom-guided neighbourhoods of the words of a vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ratetally.llm.common import fold, stored, text_or_empty
from ratetally.llm.words import mixed

# Words per shard of the filter and its bits per word; bytes of filter that are broadcast at a time.
SHARD_WORDS = 1 << 18
BITS_PER_WORD = 16
FILTER_BYTES = 32 << 20
# Edited words that are probed at a time, and words per task.
PROBES = 1 << 20
TASK_WORDS = 20_000
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)


def values(points: np.ndarray) -> np.ndarray:
    """A 64-bit value of every code point."""
    return mixed(points.astype("uint64") + np.uint64(1))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, "uint64")
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(points: np.ndarray) -> np.ndarray:
    """Hash of every row of code points: a polynomial, so that the hash of an edited word follows from its parts."""
    return (values(points) * powers(BASE, points.shape[1])).sum(1, dtype="uint64")


def by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their code points as a matrix) for every length that occurs."""
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    for size in np.unique(lengths):
        at = np.flatnonzero(lengths == size)
        joined = "".join(words.take(pa.array(at)).to_pylist())
        yield at, np.frombuffer(joined.encode("utf-32-le"), "<u4").reshape(len(at), int(size))


def bits(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of every hash, one 64-bit word, and its four bits there."""
    spread = mixed(hashes)
    mask = np.zeros(len(spread), "uint64")
    for shift in (0, 6, 12, 18):
        mask |= np.uint64(1) << ((spread >> np.uint64(shift)) & np.uint64(63))
    return ((spread >> np.uint64(32)) % np.uint64(blocks)).astype("int64"), mask


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(hashes ^ np.uint64(BASE)) % np.uint64(parts)).astype("int64")


def filled(hashes: np.ndarray) -> np.ndarray:
    """The blocked Bloom filter of one shard."""
    out = np.zeros(max(1, -(-len(hashes) * BITS_PER_WORD // 64)), "uint64")
    block, mask = bits(hashes, len(out))
    np.bitwise_or.at(out, block, mask)
    return out


class Filters:
    """The shards of one broadcast: of every length and part of it, a filter."""

    def __init__(self, shards: list[tuple[int, int, bytes]], parts: dict[int, int]):
        self.parts = parts
        self.at: dict[tuple[int, int], tuple[int, int]] = {}
        arrays, offset = [], 0
        for size, part, raw in shards:
            arrays.append(np.frombuffer(raw, "<u8"))
            self.at[size, part] = (offset, len(arrays[-1]))
            offset += len(arrays[-1])
        self.blocks = np.concatenate(arrays) if arrays else np.zeros(0, "uint64")

    def holds(self, size: int) -> bool:
        return any((size, p) in self.at for p in range(self.parts.get(size, 0)))

    def hits(self, size: int, hashes: np.ndarray) -> np.ndarray:
        """Which of these hashes of words of one length may be words; those of shards not sent here are not."""
        parts = self.parts[size]
        if parts == 1:
            offset, n = self.at[size, 0]
            block, mask = bits(hashes, n)
            return np.flatnonzero((self.blocks[offset + block] & mask) == mask)
        place = np.array([self.at.get((size, p), (0, 0)) for p in range(parts)], "int64")
        offset, n = place[part_of(hashes, parts)].T
        here = np.flatnonzero(n > 0)
        block, mask = bits(hashes[here], n[here].astype("uint64"))
        return here[(self.blocks[offset[here] + block] & mask) == mask]


def neighbours(points: np.ndarray, alphabet: np.ndarray, filters: Filters) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, edited code points) of the edits of words of one length that the filters take for words.

    Every word less one code point, and every word with one code point replaced by a larger one: a pair of words
    that differ by one edit is met from exactly one side, the longer one or the one with the smaller code point.
    """
    n, size = points.shape
    own, power = values(points), powers(BASE, size)
    terms = own * power
    total = terms.sum(1, dtype="uint64")
    rows_at_once = max(1, PROBES // max(1, size))
    if size and filters.holds(size - 1):
        for a in range(0, n, rows_at_once):
            before = np.cumsum(terms[a : a + rows_at_once], axis=1, dtype="uint64")
            after = (total[a : a + rows_at_once, None] - before) * np.uint64(UNBASE)
            less = before - terms[a : a + rows_at_once] + after
            # Of a run of one code point only the last is left out: leaving out another one gives the same word.
            some = points[a : a + rows_at_once]
            fresh = np.ones(some.shape, bool)
            fresh[:, :-1] = some[:, :-1] != some[:, 1:]
            i, j = np.nonzero(fresh)
            got = filters.hits(size - 1, less[i, j])
            i, j = i[got], j[got]
            rest = some[i][np.arange(size)[None, :] != j[:, None]].reshape(len(i), size - 1)
            yield a + i, rest
    if filters.holds(size):
        letter = values(alphabet)
        step = max(1, PROBES // (rows_at_once * len(alphabet)))
        rows = max(1, PROBES // len(alphabet))
        for a in range(0, n, rows):
            some = points[a : a + rows]
            for j0 in range(0, size, step):
                for j in range(j0, min(size, j0 + step)):
                    i, k = np.nonzero(alphabet[None, :] > some[:, j, None])
                    changed = total[a + i] + (letter[k] - own[a + i, j]) * power[j]
                    got = filters.hits(size, changed)
                    new = some[i[got]].copy()
                    new[:, j] = alphabet[k[got]]
                    yield a + i[got], new


def texts_of(points: np.ndarray) -> list[str]:
    if not points.shape[1]:
        return [""] * len(points)
    raw = np.ascontiguousarray(points, "<u4").tobytes().decode("utf-32-le")
    size = points.shape[1]
    return [raw[i : i + size] for i in range(0, len(raw), size)]


def near_words(words: DataFrame, bits_sent: int = FILTER_BYTES * 8) -> DataFrame:
    """(word, other, word_n, other_n): every pair of different words one edit apart, once.

    ``words`` holds distinct words with their n. The filters are sharded by length and, within a length, by hash; at
    most ``bits_sent`` bits of them are broadcast at a time, and the words pass by once per broadcast. What the filters
    let through meets the vocabulary itself, which removes the false positives.
    """
    spark = words.sparkSession
    size = F.char_length("word")
    # One row per length of a word, one per code point.
    counts = {r["s"]: r["n"] for r in words.groupBy(size.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = {s: -(-n // SHARD_WORDS) for s, n in counts.items()}
    letters = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()
    alphabet = np.array(sorted(ord(r["c"]) for r in letters), "uint32")
    shared_parts = spark.sparkContext.broadcast(parts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = shared_parts.value
        for batch in batches:
            out = np.zeros((3, batch.num_rows), "int64")
            for at, points in by_length(batch.column(0)):
                hashes = word_hashes(points)
                out[:, at] = np.full(len(at), points.shape[1]), part_of(hashes, parts[points.shape[1]]), hashes.view("int64")
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["size", "part", "hash"])

    def fill(table: pa.Table) -> pa.Table:
        raw = filled(table["hash"].to_numpy().view("uint64")).astype("<u8").tobytes()
        return pa.table({"size": table["size"][:1], "part": table["part"][:1], "raw": pa.array([raw], pa.binary())})

    filters = stored(words.select("word").mapInArrow(place, "size long, part long, hash long").groupBy("size", "part").applyInArrow(fill, "size long, part long, raw binary"))
    found = None
    sizes = sorted((r["size"], r["part"], r["bytes"]) for r in filters.select("size", "part", F.octet_length("raw").alias("bytes")).collect())
    passes: list[list[tuple[int, int]]] = []
    room = 0
    for s, p, n in sizes:
        if not passes or n * 8 > room:
            passes.append([])
            room = bits_sent
        passes[-1].append((s, p))
        room -= n * 8
    tasks = max(1, -(-sum(counts.values()) // TASK_WORDS))
    spread = words.repartition(tasks, "word")
    for shards in passes:
        keys = F.struct("size", "part").isin([F.struct(F.lit(s).cast("long"), F.lit(p).cast("long")) for s, p in shards])
        sent = spark.sparkContext.broadcast(Filters([tuple(r) for r in filters.where(keys).collect()], parts))

        def probe(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, points in by_length(batch.column(0)):
                    for i, edited in neighbours(points, alphabet, sent.value):
                        if len(i):
                            rows = batch.take(pa.array(at[i]))
                            yield pa.RecordBatch.from_arrays([pa.array(texts_of(edited), pa.string()), rows.column(0), rows.column(1)], names=["maybe", "word", "word_n"])

        some = spread.select("word", "n").mapInArrow(probe, "maybe string, word string, word_n long")
        found = some if found is None else found.unionByName(some)
    if found is None:
        found = spark.createDataFrame([], "maybe string, word string, word_n long")
    known = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    return found.join(known, F.col("maybe") == F.col("other")).select("word", "other", "word_n", "other_n")


def spelling_groups(words: DataFrame, ratio: int = 10, bits_sent: int = FILTER_BYTES * 8) -> DataFrame:
    """One row per word of ``words`` (word, n): word, n, n_near, form, form_n, root.

    Two words are near when they differ by exactly one inserted, deleted or replaced code point. ``form`` is the near
    word of the largest n, of equals the smallest in code-point order, if its n is at least ``ratio`` times the word's;
    ``root`` follows forms to the last one. Forms grow in n, so there are no cycles, and a chain is as long as n has
    digits: pointer doubling ends after a few rounds.

    Null words are left out; rows that repeat a word count as one with their n added; the empty word is near every word of
    one code point. Words of any length are edited at every place, a few positions at a time. A word in many pairs is
    an aggregate, combined before the shuffle. An empty table gives an empty result; other columns are ignored.
    """
    if ratio < 2:
        raise ValueError("A form must be more frequent than its word: ratio is at least 2.")
    words = stored(words.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").cast("long").alias("n")))
    pairs = near_words(words, bits_sent)
    one, other = (F.struct(F.col(a).alias("word"), F.col(b).alias("near"), F.col(f"{b}_n").alias("near_n")) for a, b in (("word", "other"), ("other", "word")))
    both = pairs.select(F.explode(F.array(one, other)).alias("p")).select("p.*", F.lit(None).cast("long").alias("n"))
    own = words.select("word", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"), "n")
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))))
    met = both.unionByName(own).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    enough = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    out = stored(met.select("word", "n", "n_near", F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")))
    hops = out.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = hops.select(F.col("word").alias("_via"), F.col("root").alias("_next"))
        moved = hops.join(further, F.col("root") == F.col("_via"), "left")
        hops = stored(moved.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_on")))
        if hops.where("_on").isEmpty():
            break
        hops = hops.drop("_on")
    ends = hops.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
    return out.join(ends, F.col("word") == F.col("_word"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("_root", "word").alias("root"))


def misspelt(word: Column, seed: Column, every: int) -> Column:
    """``word`` less one code point where ``every`` divides the checksum of seed, colon and word."""
    h = F.crc32(F.concat(seed, F.lit(":"), word).cast("binary"))
    at = F.pmod(h, F.char_length(word)).cast("int")
    less = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))
    return F.when(h % every == 0, less).otherwise(word)


def vocabulary(docs: DataFrame, letters: str = r"A-Za-zÀ-ÿ", least_length: int = 7, least_n: int = 2, every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the maximal runs of ``letters`` in all texts, A-Z lower-cased, of at least that length and number.

    ``every`` plants errors, for measurements: a run whose checksum with the id of its document it divides loses one code
    point. Null and empty texts have no words; a null id is written as nothing. Words are counted before the shuffle.
    """
    run = F.explode(F.regexp_extract_all(fold(text_or_empty(F.col(text_col))), F.lit(f"[{letters}]{{{least_length},}}"), F.lit(0)))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_seed"), run.alias("_run"))
    word = misspelt(F.col("_run"), F.col("_seed"), every) if every else F.col("_run")
    words = rows.select(word.alias("word")).where(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)
