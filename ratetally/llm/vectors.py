"""Embedding near-dedup: an exact metric range join over cells around pivots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from ratetally.llm.common import components, stored
from ratetally.llm.substrings import NO_ID
from ratetally.operators.spread import attach

# Vectors per cell that the number of pivots aims at, and the most pivots; both only decide where rows go.
CELL_ROWS = 8_192
MAX_PIVOTS = 256
# Vectors that make one block, on average; blocks are compared pair by pair, in strips.
BLOCK_ROWS = 4_096
STRIP_ROWS = 512
# Blocks that a task holds of either side.
PART_BLOCKS = 32
# Further than rounding can carry a single-precision product of unit vectors.
SINGLE_SLACK = 1e-4


def plain(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The components of a list column whose lists have one length, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(column), -1)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit vectors in double precision."""
    out = plain(column)
    # Scaled first, so that squares neither overflow nor vanish.
    out = out / np.abs(out).max(1, keepdims=True)
    return out / np.sqrt((out * out).sum(1, keepdims=True))


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ pivots.T)))


def joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of a[i] and b[i]; ``labels`` points every node to the smallest node of its class."""
    while len(a):
        la, lb = labels[a], labels[b]
        differ = la != lb
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]


def compare(x: np.ndarray, y: np.ndarray, of_x: np.ndarray, of_y: np.ndarray, least: float, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked weight of every row of x and of y, and class labels over the rows of x followed by those of y.

    ``of_x`` and ``of_y`` are the weights. ``own`` says that y is x itself: a row is no neighbour of its own then, and the
    weights are those of x. Single precision finds candidates in strips; those near the bound are computed again in
    double precision, so no link is lost or invented.
    """
    to_x, to_y = np.zeros(len(x)), np.zeros(len(y))
    labels = np.arange(len(x) + len(y))
    fast = y.astype("float32").T
    for at in range(0, len(x), STRIP_ROWS):
        strip = x[at : at + STRIP_ROWS]
        near = strip.astype("float32") @ fast
        i, j = np.divmod(np.flatnonzero(near >= least - SINGLE_SLACK), len(y))
        unsure = np.flatnonzero(near[i, j] < least + SINGLE_SLACK)
        good = np.ones(len(i), bool)
        for u in range(0, len(unsure), 65_536):
            some = unsure[u : u + 65_536]
            good[some] = (strip[i[some]] * y[j[some]]).sum(1) >= least
        if own:
            good &= i + at != j
        i, j = i[good] + at, j[good]
        to_x += np.bincount(i, weights=of_y[j], minlength=len(x))
        to_y += np.bincount(j, weights=of_x[i], minlength=len(y))
        joined(labels, i, j if own else j + len(x))
    return to_x, np.zeros(len(y)) if own else to_y, labels


class Found:
    """What one task knows of the vectors of the blocks that it has met: their links and their classes."""

    def __init__(self) -> None:
        self.start: dict[int, int] = {}
        self.columns: dict[str, list[np.ndarray]] = {c: [] for c in ("id", "h", "g")}
        self.links = np.zeros(0)
        self.labels = np.zeros(0, "int64")

    def places(self, block: dict) -> np.ndarray:
        """Where the vectors of a block are; new ones have no link yet and are classes of their own."""
        if block["block"] not in self.start:
            self.start[block["block"]] = len(self.links)
            for c, known in self.columns.items():
                known.append(block[c])
            self.links = np.append(self.links, np.zeros(block["n"]))
            self.labels = np.append(self.labels, np.arange(len(self.labels), len(self.links)))
        return self.start[block["block"]] + np.arange(block["n"])

    def tables(self) -> Iterator[pa.RecordBatch]:
        """The linked weights that are not 0, and an edge to the first of its class from every vector that has others."""
        every = {c: np.concatenate(known) for c, known in self.columns.items()} if self.start else {}
        tied = np.flatnonzero(self.links)
        for at in range(0, len(tied), 65_536):
            t = tied[at : at + 65_536]
            none = pa.nulls(len(t), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(self.links[t].astype("int64")), pa.array(every["h"][t]), pa.array(every["g"][t])], names=list(FOUND))
        led = np.flatnonzero(self.labels != np.arange(len(self.labels)))
        for at in range(0, len(led), 65_536):
            t = led[at : at + 65_536]
            none = pa.nulls(len(t), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(every["id"][t]), pa.array(every["id"][self.labels[t]]), none, none, none], names=list(FOUND))


FOUND = ("id", "root", "links", "h", "g")
PACKED = {"block": "long", "dim": "int", "cell": "long", "n": "int", "radius": "double", "centre": "array<double>", "wide": "boolean", "v": "binary", "id": "binary", "weight": "binary", "h": "binary", "g": "binary"}
# Further than rounding can carry the distance of two unit vectors or means of such.
SLACK = 1e-6


def pack(table: pa.Table) -> pa.Table:
    """The vectors of a block as one row: bytes of their columns, the mean of the unit vectors and the largest distance from it."""
    values = table["v"].combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False)
    flat = flat if flat.dtype == "float32" else flat.astype("float64")
    units = matrix(values)
    centre = units.mean(0)
    one = {
        "block": table["block"][0].as_py(), "dim": units.shape[1], "cell": table["cell"][0].as_py(), "n": len(units),
        "radius": float(np.linalg.norm(units - centre, axis=1).max()), "centre": centre.tolist(), "wide": flat.dtype == "float64", "v": flat.tobytes(),
    }
    one |= {c: table[c].to_numpy().astype("int64").tobytes() for c in ("id", "weight", "h", "g")}
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.table({c: pa.array([one[c]], kinds[k]) for c, k in PACKED.items()})


def unpack(batch: pa.RecordBatch, row: int, side: str) -> dict:
    """A block of ``pack`` from the columns of one side of a pair; ``units`` are its unit vectors."""
    get = lambda c: batch.column(f"{side}_{c}")[row]
    out = {c: get(c).as_py() for c in ("block", "dim", "cell", "n", "radius")}
    out |= {c: np.frombuffer(get(c).as_buffer(), "int64") for c in ("id", "weight", "h", "g")}
    raw = np.frombuffer(get("v").as_buffer(), "float64" if get("wide").as_py() else "float32").reshape(out["n"], -1).astype("float64")
    raw = raw / np.abs(raw).max(1, keepdims=True)
    return out | {"centre": np.array(get("centre").as_py()), "units": raw / np.sqrt((raw * raw).sum(1, keepdims=True))}


def near_vectors(vectors: DataFrame, least: float, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Two vectors link when their cosine, in double precision, is at least ``least``; on unit vectors that is a
    Euclidean distance of at most r = sqrt(2 - 2 * least). Every vector lives in the cell of its nearest pivot, and the
    vectors of a cell are dealt over blocks of about ``BLOCK_ROWS``. A block is one row, and every pair of blocks meets in a
    product of the stored blocks with themselves: its tasks read the blocks from the checkpoint folder, so nothing is
    shuffled or written per pair, however many pairs there are. Two blocks whose means are further apart than r and their radii together do
    not meet; of those that do, a vector takes no part that is further than r plus the radius from the other mean, or nearer to its
    own pivot than to the other one by more than 2r. A task sends one count and one edge per vector at most, not
    pairs. Equal vectors are one class with a count, told by 128 bits of hashes where the vectors do not travel.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and vectors of different
    lengths do not link. Rows that share an id are one node, each with its own count; null ids rank last and are
    one id. component_id is the smallest id reachable, itself included; kept tells whether it is the row's own.
    An empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("id"), F.col(vector_col).alias("v"))
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    # Equal vectors have equal hashes, zeros of either sign included.
    hashed = {"h": F.xxhash64("v"), "g": F.xxhash64(F.lit(1), "v")}
    sound = rows.where(whole)
    marks = sound.select(hashed["h"].alias("h")).distinct()
    many = max(1, min(MAX_PIVOTS, -(-marks.count() // CELL_ROWS)))
    first = [r["h"] for r in marks.orderBy("h").limit(many).collect()]
    picked = sound.where(hashed["h"].isin(first)).groupBy("v").agg(F.size("v").alias("dim")).toArrow()
    pivots: dict[int, np.ndarray] = {}
    for d in sorted(set(picked["dim"].to_pylist())):
        pivots[d] = matrix(picked.filter(pa.compute.equal(picked["dim"], d))["v"])
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + SLACK
    vector_type = dict(rows.dtypes)["v"]

    def cells_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Length and cell of every vector."""
        dims = batch.column("dim").to_numpy()
        cell = np.zeros(batch.num_rows, "int64")
        for d in np.intersect1d(dims, list(pivots)):
            at = np.flatnonzero(dims == d)
            cell[at] = distances(matrix(batch.column("v").take(pa.array(at))), pivots[int(d)]).argmin(1)
        return dims, cell

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("dim"), pa.array(cells_of(batch)[1]), batch.column("h")], names=["dim", "cell", "h"])

    # One row per cell; copies count once, or thereabouts.
    settled = sound.select("v", F.size("v").alias("dim"), hashed["h"].alias("h")).mapInArrow(settle, "dim int, cell long, h long")
    sizes = {(r["dim"], r["cell"]): r["n"] for r in settled.groupBy("dim", "cell").agg(F.approx_count_distinct("h").alias("n")).collect()}
    blocks: dict[tuple[int, int], tuple[int, int]] = {}
    in_all = 0
    for key in sorted(sizes.keys() | {(d, q) for d, p in pivots.items() for q in range(len(p))}):
        ways = max(1, -(-sizes.get(key, 0) // BLOCK_ROWS))
        blocks[key] = (in_all, ways)
        in_all += ways

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cell = cells_of(batch)
            start, ways = np.array([blocks[int(d), int(q)] for d, q in zip(dims, cell)], "int64").reshape(-1, 2).T
            block = start + batch.column("h").to_numpy() % ways
            yield batch.append_column("cell", pa.array(cell)).append_column("block", pa.array(block))

    names = f"v {vector_type}, id long, weight long, dim int, h long, g long"
    classes = sound.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")).withColumns({"dim": F.size("v"), **hashed})
    # Each task of the product takes one part of the blocks from either side.
    cores = spark.sparkContext.defaultParallelism
    parts = max(1, min(in_all, max(round(3 * cores**0.5), -(-in_all // PART_BLOCKS))))
    dealt = classes.mapInArrow(deal, f"{names}, cell long, block long").repartition(parts, "block")
    packed = stored(dealt.groupBy("block").applyInArrow(pack, ", ".join(f"{c} {k}" for c, k in PACKED.items())))

    # However many partitions the session has made of them, the tasks of the product stay as few.
    side = lambda s: packed.coalesce(parts).select(*[F.col(c).alias(f"{s}_{c}") for c in PACKED])
    a, b = F.col("a_block"), F.col("b_block")
    once = (a == b) | ((a != b) & ((a < b) == ((a + b) % 2 == 0)))
    apart = F.sqrt(F.aggregate(F.zip_with("a_centre", "b_centre", lambda s, t: (s - t) * (s - t)), F.lit(0.0), lambda s, t: s + t))
    may = once & (F.col("a_dim") == F.col("b_dim")) & (apart <= F.col("a_radius") + F.col("b_radius") + reach)
    pairs = side("a").join(side("b").hint("shuffle_replicate_nl"), may)

    def part_of(home: dict, other: dict) -> np.ndarray:
        """Places of the vectors of a block that may have a neighbour in the other one."""
        x = home["units"]
        go = np.linalg.norm(x - other["centre"], axis=1) <= other["radius"] + reach
        if home["cell"] != other["cell"]:
            # Only vectors of a length that has pivots are in different cells.
            far = distances(x, pivots[home["dim"]][[home["cell"], other["cell"]]])
            go &= far[:, 1] - far[:, 0] <= 2 * reach
        return np.flatnonzero(go)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Found()
        for batch in batches:
            for row in range(batch.num_rows):
                home, other = unpack(batch, row, "a"), unpack(batch, row, "b")
                own = home["block"] == other["block"]
                s, t = (np.arange(home["n"]),) * 2 if own else (part_of(home, other), part_of(other, home))
                if not len(s) or not len(t):
                    continue
                to_s, to_t, labels = compare(home["units"][s], other["units"][t], home["weight"][s], other["weight"][t], least, own)
                at = np.append(found.places(home)[s], found.places(other)[t])
                found.links[at[: len(s)]] += to_s
                found.links[at[len(s) :]] += to_t
                led = np.flatnonzero(labels != np.arange(len(labels)))
                joined(found.labels, at[led], at[labels[led]])
        yield from found.tables()

    found = stored(pairs.mapInArrow(meet, ", ".join(f"{c} long" for c in FOUND)))
    counts = found.where("links is not null").groupBy("h", "g").agg(F.sum("links").alias("links"))
    each = sound.select("id", *[c.alias(n) for n, c in hashed.items()])
    heads = each.groupBy("h", "g").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("weight")).join(counts, ["h", "g"], "left")
    named = attach(each, heads, ["h", "g"])
    edges = found.where("root is not null").select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(named.select(F.col("id").alias("a"), F.col("head").alias("b")))
    group = components(edges)
    linked = named.select("id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    alone = rows.where(~whole).select("id", F.lit(0).cast("long").alias("n_links"))
    every = linked.unionByName(alone)
    final = every.join(group.select(F.struct("node").alias("_g"), "component"), F.struct("id") == F.col("_g"), "left")
    component = F.coalesce("component", "id")
    known = lambda c: F.nullif(c, F.lit(int(NO_ID)))
    return final.select(known(F.col("id")).alias(id_col), "n_links", known(component).alias("component_id"), (F.col("id") == component).alias("kept"))
