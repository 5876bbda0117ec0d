"""Line deduplication with a segment-partition edit join."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ratetally.llm.common import components, forget, sliced, stored
from ratetally.llm.edits import codes, probes, segments, within
from ratetally.llm.substrings import keyed
from ratetally.llm.words import mixed

# Lines that more than one in this many lines equals are looked up for one document only; so at most as many are sent.
OFTEN_SHARE = 100_000
# Documents looked at for segments that many lines share, and the lines of such a segment that meet at once.
SAMPLE_DOCS = 20_000
BLOCK_LINES = 4_096
# Line numbers that are sent to every task at most; more are joined by shuffle.
SENT_LINES = 50_000
# Characters of text whose keys a task holds at a time.
PIECE_CHARS = 500_000
BLANK = b" \t\n\r\x0b\x0c"


def line_hash(raw: bytes) -> int:
    """Signed 64-bit number of a line."""
    h = xxhash.xxh3_64_intdigest(raw)
    return h - (1 << 64) if h >> 63 else h


def line_check(raw: bytes) -> int:
    h = xxhash.xxh64_intdigest(raw, 1)
    return h - (1 << 64) if h >> 63 else h


def signature(lines: list[str]) -> np.ndarray:
    """32 parities of how often characters occur. One edit changes two of them at most."""
    if not lines:
        return np.zeros(0, "int64")
    sizes = np.array([len(x) for x in lines])
    chars = codes("".join(lines)).astype("uint32")
    bits = np.left_shift(np.uint32(1), (chars * np.uint32(0x9E3779B1)) >> np.uint32(27))
    out = np.zeros(len(lines), "uint32")
    some = sizes > 0
    out[some] = np.bitwise_xor.reduceat(bits, (np.cumsum(sizes) - sizes)[some])
    return out.astype("int64")


def segment_keys(line: str, raw: bytes, edits: int, shapes: dict) -> tuple[list[int], list[int]]:
    """Keys a line is filed under, and keys it only looks up; a key names length, segment and content."""
    n = len(line)
    if n not in shapes:
        if len(shapes) > 20_000:
            shapes.clear()
        own = [(n, i, at, size) for i, (at, size) in enumerate(segments(n, edits))]
        shapes[n] = own, [p for p in probes(n, edits) if p not in own]
    text = raw if len(raw) == n else None
    key = xxhash.xxh3_64_intdigest

    def keys(parts):
        if text is not None:
            return [key(text[a : a + s], length * 8 + i) for length, i, a, s in parts]
        return [key(line[a : a + s].encode(), length * 8 + i) for length, i, a, s in parts]

    own, looked = shapes[n]
    return keys(own), keys(looked)


def lines_of(text: str, least: int | None = None) -> dict[str, bytes]:
    """The distinct lines of a text that are not blank, with their bytes, in order."""
    out = {}
    for line in text.split("\n"):
        if (least is None or len(line) >= least) and line not in out:
            raw = line.encode()
            if raw.strip(BLANK):
                out[line] = raw
    return out


def candidates(keys: np.ndarray, ids: np.ndarray, marks: np.ndarray, filed: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different lines under one key, one of them filed, whose signatures may be within the edits.

    Rows are sorted by key. Row r meets row r + 1, r + 2, … of its key, for all keys at once; keys of very many
    rows meet themselves row by row, so memory stays bounded.
    """
    head = np.append(True, np.diff(keys) != 0)
    starts = np.flatnonzero(head)
    sizes = np.diff(np.append(starts, len(keys)))
    left, right = [], []

    def take(i, j):
        good = (ids[i] != ids[j]) & (filed[i] | filed[j]) & (np.bitwise_count(marks[i] ^ marks[j]) <= most)
        left.append(ids[i[good]])
        right.append(ids[j[good]])

    small = np.flatnonzero((sizes > 1) & (sizes <= 64))
    rest = np.repeat(starts[small] + sizes[small], sizes[small])
    rows = np.repeat(starts[small], sizes[small]) + np.arange(len(rest)) - np.repeat(np.cumsum(sizes[small]) - sizes[small], sizes[small])
    for step in range(1, 64):
        on = rows + step < rest
        rows, rest = rows[on], rest[on]
        if not len(rows):
            break
        take(rows, rows + step)
    for s in np.flatnonzero(sizes > 64):
        a, b = starts[s], starts[s] + sizes[s]
        for i in range(a, b - 1):
            j = np.arange(i + 1, b)
            take(np.full(len(j), i), j)
    if not left:
        return np.zeros(0, "int64"), np.zeros(0, "int64")
    a, b = np.concatenate(left), np.concatenate(right)
    return np.minimum(a, b), np.maximum(a, b)


def near_lines(docs: DataFrame, first: DataFrame, edits: int, least: int) -> DataFrame:
    """(a, b): numbers of different lines of at least ``least`` characters within ``edits`` edits.

    ``first`` holds (line, check, owner, copies) of every distinct line.
    """
    spark = docs.sparkSession
    total = first.agg(F.sum("copies")).first()[0] or 0
    often = first.where(F.col("copies") > max(8, total // OFTEN_SHARE)).select("line", "owner").toArrow()
    owners = spark.sparkContext.broadcast(dict(zip(often["line"].to_pylist(), often["owner"].to_pylist())))
    parts = max(1, docs.count() // SAMPLE_DOCS)

    def rows_of(batches: Iterator[pa.RecordBatch], wide: dict) -> Iterator[pa.RecordBatch]:
        forget()
        shapes: dict = {}
        for batch in batches:
            ids = batch.column("_id").to_pylist()
            at = 0
            while at < len(ids):
                # A batch of texts at a time keeps what is sent bounded.
                lines, numbers, keys, row, filed, chars = [], [], [], [], [], 0
                while at < len(ids) and chars < PIECE_CHARS:
                    text = batch.column("_text")[at].as_py()
                    for line, raw in lines_of(text, least).items():
                        number = line_hash(raw)
                        if owners.value.get(number, ids[at]) != ids[at]:
                            continue
                        own, looked = segment_keys(line, raw, edits, shapes)
                        row += [len(lines)] * (len(own) + len(looked))
                        keys += own
                        keys += looked
                        filed += [True] * len(own) + [False] * len(looked)
                        lines.append(line)
                        numbers.append(number)
                    chars += len(text) + 1
                    at += 1
                marks = signature(lines)
                numbers, row, filed, keys = np.array(numbers, "int64"), np.array(row, "int64"), np.array(filed, bool), np.array(keys, "uint64")
                if len(wide) and len(keys):
                    keys, row, filed = blocks(keys, row, filed, numbers, wide)
                cols = [keys.view("int64"), numbers[row], marks[row], filed] if len(keys) else [np.zeros(0, "int64")] * 3 + [np.zeros(0, bool)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "line", "mark", "filed"])

    schema = "key long, line long, mark long, filed boolean"
    some = docs.where(F.pmod(F.xxhash64("_id", "_check"), F.lit(parts)) == 0)
    shared = some.mapInArrow(lambda b: rows_of(b, {}), schema).groupBy("key").agg(F.approx_count_distinct("line").alias("n")).where(F.col("n") * parts > BLOCK_LINES)
    wide = {k & (1 << 64) - 1: -(-n * parts // BLOCK_LINES) for k, n in shared.select("key", "n").toArrow().to_pandas().itertuples(index=False)}
    wide = spark.sparkContext.broadcast(wide)
    rows = docs.mapInArrow(lambda b: rows_of(b, wide.value), schema)
    sorted_rows = rows.repartition("key").sortWithinPartitions("key", "line")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            cut = int(np.searchsorted(held[0], held[0][-1], "left")) if len(held[0]) else 0
            if cut:
                yield found([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield found(held)

    def found(cols: list[np.ndarray]) -> pa.RecordBatch:
        # Copies of a line under one key are one row, filed if one of them is.
        keys, ids, marks, filed = cols
        new = np.append(True, (np.diff(keys) != 0) | (np.diff(ids) != 0))
        heads = np.flatnonzero(new)
        filed = np.logical_or.reduceat(filed, heads)
        a, b = candidates(keys[heads], ids[heads], marks[heads], filed, 2 * edits)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    pairs = stored(sorted_rows.mapInArrow(meet, "a long, b long").distinct())
    wanted = pairs.select(F.col("a").alias("line")).unionByName(pairs.select(F.col("b").alias("line"))).distinct()
    wanted = stored(wanted.join(first.select(F.struct("line").alias("_l"), "owner"), F.struct("line") == F.col("_l")).select("line", "owner").dropDuplicates(["line"]))
    if wanted.count() <= SENT_LINES:
        sent = spark.sparkContext.broadcast(set(map(tuple, zip(*[c.to_pylist() for c in wanted.select("line", "owner").toArrow().columns]))))
        texts = docs.select("_id", "_text").mapInArrow(lambda b: line_texts(b, least, sent.value), "line long, text string")
    else:
        texts = docs.select("_id", "_text").mapInArrow(lambda b: line_texts(b, least, None), "line long, text string").join(wanted.select("line"), "line", "left_semi")
    texts = stored(texts.groupBy("line").agg(F.min("text").alias("text")))
    side = lambda c: texts.select(F.struct("line").alias(f"_k{c}"), F.col("text").alias(f"t{c}"))
    met = pairs.withColumn("_a", F.struct("a")).join(side("a"), F.col("_a") == F.col("_ka")).withColumn("_b", F.struct("b")).join(side("b"), F.col("_b") == F.col("_kb"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = within(list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())), edits)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return met.select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long")


def blocks(keys, row, filed, numbers, wide):
    """Rows of keys that very many lines share, dealt over pairs of blocks so that every filed row still meets every row."""
    n = np.array([wide.get(int(k), 1) for k in keys], "int64")
    line = numbers[row].view("uint64")
    block = (mixed(line) % n.astype("uint64")).astype("int64")
    plain = n == 1
    out = [(keys[plain], row[plain], filed[plain])]
    for i in np.flatnonzero(~plain):
        every = np.arange(n[i])
        for role, cell in (((True, block[i] * n[i] + every),) if filed[i] else ()) + ((False, every * n[i] + block[i]),):
            out.append((mixed(keys[i] + cell.astype("uint64") + np.uint64(1)), np.full(n[i], row[i]), np.full(n[i], role)))
    return tuple(np.concatenate(x) for x in zip(*out))


def line_texts(batches: Iterator[pa.RecordBatch], least: int, wanted: set | None) -> Iterator[pa.RecordBatch]:
    for batch in (part for b in batches for part in sliced(b, "_text")):
        numbers, texts = [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for line, raw in lines_of(text.as_py(), least).items():
                number = line_hash(raw)
                if wanted is None or (number, i) in wanted:
                    numbers.append(number)
                    texts.append(line)
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(texts, pa.string())], names=["line", "text"])


def line_dedup(docs: DataFrame, edits: int = 2, least: int = 24, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: id, the columns named in ``carry``, n_lines, n_removed, kept_text.

    Lines are what line feeds part. Two lines are alike when equal, or when both have at least ``least``
    characters and an edit distance of at most ``edits``. Of all lines that chains of alike lines connect, the
    one of the smallest id stays, within it the first. Blank lines (white space only) always stay.

    Every distinct line is split into ``edits`` + 1 segments; another line within the edits holds one of them
    nearly at its place, so lines meet under (length, segment, content), are screened by the parities of their
    characters and verified by their edit distance. A line that very many documents have is looked up for
    one of them; segments that very many lines share are dealt over pairs of blocks.

    Null text is one blank line. Rows without an id rank last and are told apart by their text, whose hash orders them;
    ids lie below 2^62. Rows that share an id, or lack one and share their text, share the decision on a line. Equal lines are told by 128 bits of hashes. An empty table gives an empty result; other columns are
    ignored.
    """
    rows = keyed(docs, id_col, text_col, apart=True)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in (part for b in batches for part in sliced(b, "_text")):
            ids, numbers, checks = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for raw in lines_of(text.as_py()).values():
                    ids.append(i)
                    numbers.append(line_hash(raw))
                    checks.append(line_check(raw))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, numbers, checks)], names=["id", "line", "check"])

    uses = stored(rows.select("_id", "_text").mapInArrow(number, "id long, line long, check long"))
    first = stored(uses.groupBy("line", "check").agg(F.min("id").alias("owner"), F.count(F.lit(1)).alias("copies")))
    group = stored(components(near_lines(rows, first, edits, least)))
    owned = first.join(group.select(F.struct("node").alias("_g"), "component"), F.struct("line") == F.col("_g"), "left")
    # Of connected lines the smallest owner; a line without partners is its own group.
    near = owned.where("component is not null").groupBy("component").agg(F.min("owner").alias("_owner"))
    owned = owned.join(near.select(F.struct("component").alias("_n"), "_owner"), F.struct("component") == F.col("_n"), "left")
    owned = owned.where("copies > 1 or component is not null").select(F.struct("line", "check").alias("_key"), F.coalesce("_owner", "owner").alias("_first"), "component")
    decided = uses.join(owned, F.struct("line", "check") == F.col("_key"))
    # Only what differs from "first here, so it stays" is sent back: lines owned elsewhere, and groups within a text.
    sent = decided.where("id <> _first or component is not null")
    sent = sent.groupBy("id").agg(F.collect_list(F.struct("line", F.when(F.col("id") == F.col("_first"), F.col("component")).alias("group"))).alias("lines"))
    rest = F.struct(F.col(id_col).cast("long").alias("_"), *[F.col(f"`{c}`").alias(f"_{n}") for n, c in enumerate(carry)])
    whole = keyed(docs, id_col, text_col, rest.alias("_rest"), apart=True)
    met = whole.join(sent, F.col("_id") == F.col("id"), "left").select("_id", "_text", "_rest", "lines")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in sliced(b, "_text")):
            out = [[], [], []]
            for text, known in zip(batch.column("_text"), batch.column("lines").to_pylist()):
                fate = {k["line"]: k["group"] for k in known or ()}
                lines, kept, seen = text.as_py().split("\n"), [], set()
                for line in lines:
                    raw = line.encode()
                    if raw.strip(BLANK):
                        n = line_hash(raw)
                        name = fate.get(n, n)
                        if name is None or name in seen:
                            continue
                        seen.add(name)
                    kept.append(line)
                for column, value in zip(out, (len(lines), len(lines) - len(kept), "\n".join(kept))):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.string())
            own = [batch.column("_rest"), *[pa.array(c, k) for c, k in zip(out, kinds)]]
            yield pa.RecordBatch.from_arrays(own, names=["rest", "n_lines", "n_removed", "kept_text"])

    kind = met.schema["_rest"].dataType.simpleString()
    out = met.mapInArrow(keep, f"rest {kind}, n_lines long, n_removed long, kept_text string")
    extra = [F.col(f"rest._{n}").alias(c) for n, c in enumerate(carry)]
    return out.select(F.col("rest._").alias(id_col), *extra, "n_lines", "n_removed", "kept_text")
