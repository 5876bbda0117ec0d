"""Hard-negative mining: clusters of anchors share one list of candidates, sorted by an angular upper bound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ratetally.llm.common import stored

# Anchors per cluster, candidates looked at between two certificates.
CLUSTER_ROWS = 64
STEP_ROWS = 2_048
# Rows of either side in one task at most, in rows and in bytes of vectors, and the blocks that a small table is cut into.
BLOCK_ROWS = 32_768
BLOCK_BYTES = 32 << 20
SMALL_BLOCKS = 64
# Anchors looked at to place similar ones in one task; it decides where rows go, never what is found.
SAMPLE_ANCHORS = 20_000
MAX_CELLS = 2_048
# Cosines of angles that were computed are right to better than this.
SLACK = 1e-6
MOST = np.iinfo("int64").max


def whole_vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """floor(256 x) of every component, as doubles; all lists have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return np.floor(256 * flat).reshape(len(column), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products as 64-bit integers; those beyond 64 bits are the nearest such number."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < 2.0**53:
        return (a @ b.T).astype("int64")
    whole = lambda x: np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
    exact = whole(a) @ whole(b).T
    limit = int(MOST)
    return np.array([[max(-limit, min(limit, int(s))) for s in row] for row in exact], "int64").reshape(len(a), len(b))


def units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions and lengths; a zero vector has no direction and length 0."""
    size = np.abs(x).max(1, keepdims=True, initial=0)
    scaled = x / np.where(size > 0, size, 1)
    norm = np.sqrt((scaled * scaled).sum(1, keepdims=True))
    return scaled / np.where(norm > 0, norm, 1), (norm * size).ravel()


def centres(x: np.ndarray, many: int, rounds: int = 3) -> np.ndarray:
    """Directions in the middle of ``many`` groups of directions."""
    mid = x[np.linspace(0, len(x) - 1, many).astype("int64")]
    for _ in range(rounds):
        own = (x @ mid.T).argmax(1)
        total = np.zeros_like(mid)
        np.add.at(total, own, x)
        norm = np.sqrt((total * total).sum(1, keepdims=True))
        mid = np.where(norm > 0, total / np.where(norm > 0, norm, 1), mid)
    return mid


def percent(score: np.ndarray, share: int, up: bool) -> np.ndarray:
    """share * score / 100 rounded up or down, without leaving 64 bits."""
    rest = (score % 100) * share
    return score // 100 * share + (-((-rest) // 100) if up else rest // 100)


class Best:
    """The first ``k`` candidates of every search, by score, then id, then tag."""

    def __init__(self, searches: int, k: int, ids: np.ndarray, tags: np.ndarray):
        self.k, self.ids, self.tags = k, ids, tags
        self.search, self.cand, self.score = (np.zeros(0, "int64") for _ in range(3))
        self.last = np.full(searches, -MOST)
        self.full = np.zeros(searches, bool)

    def add(self, search: np.ndarray, cand: np.ndarray, score: np.ndarray) -> None:
        search, cand, score = (np.concatenate(p) for p in ((self.search, search), (self.cand, cand), (self.score, score)))
        order = np.lexsort((self.tags[cand], self.ids[cand], -score, search))
        search, cand, score = search[order], cand[order], score[order]
        head = np.flatnonzero(np.append(True, np.diff(search) != 0)) if len(search) else np.zeros(0, "int64")
        rank = np.arange(len(search)) - np.repeat(head, np.diff(np.append(head, len(search))))
        stay = rank < self.k
        self.search, self.cand, self.score = search[stay], cand[stay], score[stay]
        end = rank == self.k - 1
        self.full[search[end]] = True
        self.last[search[end]] = score[end]


def walks(anchors: np.ndarray, cands: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(members, their lengths, the shared list of candidates, its bounds for a member of length 1) per anchor cluster.

    A member at most r from the cluster's centre meets a candidate at angle t from the centre at no less than t - r, so
    length times cos(t - r) bounds the product. The list is sorted by that once, for all members.
    """
    a_unit, a_norm = units(anchors)
    c_unit, c_norm = units(cands)
    many = -(-len(anchors) // CLUSTER_ROWS)
    mid = centres(a_unit, many)
    near = a_unit @ mid.T
    own = near.argmax(1)
    for c in np.unique(own):
        members = np.flatnonzero(own == c)
        moving = members[a_norm[members] > 0]
        reach = np.arccos(np.clip(near[moving, c], -1, 1)).max(initial=0)
        away = np.arccos(np.clip(c_unit @ mid[c], -1, 1))
        bound = c_norm * (np.cos(np.clip(away - reach, 0, np.pi)) + SLACK)
        order = np.argsort(-bound, kind="stable")
        yield members, a_norm[members], order, bound[order]


def walk(best: Best, member: np.ndarray, norm: np.ndarray, vectors: np.ndarray, cands: np.ndarray, order: np.ndarray, bound: np.ndarray, allowed, least: np.ndarray) -> int:
    """Every search goes along the list until nothing further on can enter its first ``k``; the products computed.

    ``member`` names the row of ``vectors`` of every search, ``allowed`` tells which (searches, candidates, scores) count,
    ``least`` is the lowest score that does.
    """
    active, seen = np.arange(len(member)), 0
    for at in range(0, len(order), STEP_ROWS):
        # A candidate of the score that is now last may still win by its id, so only smaller bounds end a walk.
        need = np.where(best.full[active], np.maximum(best.last[active], least[active]), least[active])
        active = active[norm[member[active]] * bound[at] * (1 + 1e-9) + 1e-9 >= need]
        if not len(active):
            break
        step = order[at : at + STEP_ROWS]
        used, place = np.unique(member[active], return_inverse=True)
        scores = products(vectors[used], cands[step])
        seen += scores.size
        scores = scores[place]
        need = np.where(best.full[active], best.last[active], -MOST)
        i, j = np.nonzero((scores >= need[:, None]) & allowed(active, step, scores))
        best.add(active[i], step[j], scores[i, j])
    return seen


def same_rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    label = pc.dictionary_encode(table["label"].combine_chunks()).indices.to_numpy(zero_copy_only=False)
    return np.flatnonzero(table["asks"].to_numpy()), np.flatnonzero(~table["asks"].to_numpy()), table["id"].to_numpy(), table["tag"].to_numpy(), label


def hard_negatives(
    vectors: DataFrame, asks: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where ``asks``, the anchors.

    A score is the inner product of vectors whose components x became floor(256 x), an exact integer. Higher scores come
    first, ties by the smaller id. The positives of an anchor are its first rows of its label; of every positive,
    the negatives are the first rows of another label that score from ``low`` to ``high`` percent of it.

    Anchors are dealt by cells of similar ones and all rows by blocks, both of bounded size, and every slice of anchors
    meets every block. There the anchors fall into clusters of about ``CLUSTER_ROWS``; a cluster sorts the block by one
    angular bound, and its members walk that list until their last place is certified. Blocks send their first few
    per anchor, which are cut down before the shuffle.

    Rows with a null id, label, vector or component, with NaN or infinite components, or where 256 x is not finite
    take no part; vectors of different lengths never meet. Equal rows count as one; other rows that share an id are
    rows of their own, told apart by a hash of label and vector. Scores beyond 64 bits are the nearest number of 64 bits.
    Zero vectors score 0. An empty table, or no anchors, gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"), F.coalesce(asks, F.lit(False)).alias("asks"))
    wrong = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) >= 2.0**1016))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & ~F.coalesce(wrong, F.lit(False)))
    rows = rows.groupBy("id", "label", "v").agg(F.max("asks").alias("asks"))
    rows = stored(rows.withColumns({"tag": F.xxhash64("label", "v"), "dim": F.size("v")}))
    count, dim, asking = rows.agg(F.count(F.lit(1)), F.coalesce(F.max("dim"), F.lit(0)), F.count_if("asks")).first()
    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, dim))))
    blocks = max(1, -(-count // min(most, max(STEP_ROWS, -(-count // SMALL_BLOCKS)))))
    anchors = stored(sliced(rows.where("asks").drop("asks"), asking, most))
    side = lambda df, asks: df.withColumn("asks", F.lit(asks))
    at_home = side(rows.drop("asks"), False).withColumns({"block": F.pmod(F.xxhash64("id", "tag"), F.lit(blocks)), "found": F.lit(None).cast("array<long>")})
    # One row per slice: slices are as many as tasks of anchors.
    slices = anchors.select("dim", "slice").distinct()
    columns = ["dim", "slice", "block", "asks", "id", "tag", "label", "v", "found"]

    def meet(askers: DataFrame, work, schema: str) -> DataFrame:
        spread = side(askers, True).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        here = at_home.join(F.broadcast(slices), "dim").select(columns)
        return spread.select(columns).unionByName(here).groupBy("dim", "slice", "block").applyInArrow(work, schema)

    pair = pa.schema([(n, pa.int64()) for n in ("id", "tag", "other", "other_tag", "score")])
    pair_text = "id long, tag long, other long, other_tag long, score long"

    def pairs_of(table: pa.Table, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], ids: np.ndarray, tags: np.ndarray) -> pa.Table:
        a, c, s = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, "int64") for k in range(3))
        return pa.table([pa.array(x) for x in (ids[a], tags[a], ids[c], tags[c], s)], schema=pair)

    def nearest_of_label(table: pa.Table) -> pa.Table:
        a, c, ids, tags, label = same_rows(table)
        found = []
        if len(a) and len(c):
            x = whole_vectors(table["v"])
            for members, norm, order, bound in walks(x[a], x[c]):
                best = Best(len(members), positives, ids[c], tags[c])
                mine = a[members]

                def allowed(active, step, scores):
                    me, it = mine[active][:, None], c[step][None, :]
                    return (label[me] == label[it]) & ~((ids[me] == ids[it]) & (tags[me] == tags[it]))

                walk(best, np.arange(len(members)), norm, x[mine], x[c], order, bound, allowed, np.full(len(members), -MOST))
                found.append((mine[best.search], c[best.cand], best.score))
        return pairs_of(table, found, ids, tags)

    def first_of_others(table: pa.Table) -> pa.Table:
        a, c, ids, tags, label = same_rows(table)
        found = []
        if len(a) and len(c):
            x = whole_vectors(table["v"])
            asked = dict(zip(a.tolist(), table["found"].take(pa.array(a)).to_pylist()))
            for members, norm, order, bound in walks(x[a], x[c]):
                mine = a[members]
                goals = [(m, s) for m, row in enumerate(mine) for s in sorted(set(asked[row]))]
                member, goal = np.array(goals, "int64").reshape(-1, 2).T
                least, top = percent(goal, low, True), percent(goal, high, False)
                best = Best(len(goals), negatives, ids[c], tags[c])

                def allowed(active, step, scores):
                    inside = (scores >= least[active][:, None]) & (scores <= top[active][:, None])
                    return inside & (label[mine[member[active]]][:, None] != label[c[step]][None, :])

                walk(best, member, norm, x[mine], x[c], order, bound, allowed, least)
                both = np.unique(np.stack([member[best.search], best.cand, best.score]), axis=1)
                found.append((mine[both[0]], c[both[1]], both[2]))
        return pairs_of(table, found, ids, tags)

    def first(df: DataFrame, keys: list[str], score: str, other: list[str], k: int) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), *other)
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    own = stored(first(meet(anchors.withColumn("found", F.lit(None).cast("array<long>")), nearest_of_label, pair_text), ["id", "tag"], "score", ["other", "other_tag"], positives))
    goals = own.groupBy("id", "tag").agg(F.collect_list("score").alias("found"))
    askers = anchors.join(goals, ["id", "tag"])
    rival = meet(askers, first_of_others, pair_text).select("id", "tag", F.col("other").alias("rival"), F.col("other_tag").alias("rival_tag"), F.col("score").alias("rival_score"))
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    both = rival.join(own.drop("rank"), ["id", "tag"])
    both = both.where((low * exact("score") <= 100 * exact("rival_score")) & (100 * exact("rival_score") <= high * exact("score")))
    out = first(both, ["id", "tag", "other", "other_tag"], "rival_score", ["rival", "rival_tag"], negatives)
    return out.select(
        F.col("id").alias("anchor_id"), F.col("other").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("rival").alias("negative_id"),
        F.col("score").alias("positive_score"), F.col("rival_score").alias("negative_score"),
    )


def sliced(anchors: DataFrame, asking: int, most: int) -> DataFrame:
    """``anchors`` with a column ``slice``: similar anchors together, at most about ``most`` of them.

    Cells lie around the middles of a bounded sample; a cell with more anchors is split by a hash.
    """
    many = -(-asking // most)
    mid: dict[int, np.ndarray] = {}
    if many > 1:
        some = anchors.orderBy(F.xxhash64("id", "tag")).limit(SAMPLE_ANCHORS).select("dim", "v").toArrow()
        for d in pc.unique(some["dim"]).to_pylist():
            x, _ = units(whole_vectors(some.filter(pc.equal(some["dim"], d))["v"]))
            mid[d] = centres(x, min(many, MAX_CELLS, len(x)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cell = np.zeros(len(dims), "int64")
            for d in np.unique(dims):
                if d in mid:
                    at = np.flatnonzero(dims == d)
                    x, _ = units(whole_vectors(batch.column("v").take(pa.array(at))))
                    cell[at] = (x @ mid[d].T).argmax(1)
            yield batch.append_column("cell", pa.array(cell))

    kinds = ", ".join(f"`{n}` {t}" for n, t in anchors.dtypes)
    placed = anchors.mapInArrow(place, f"{kinds}, cell long") if mid else anchors.withColumn("cell", F.lit(0).cast("long"))
    placed = stored(placed)
    # One row per cell.
    sizes = placed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / most).alias("_parts"))
    inside = F.pmod(F.xxhash64("id", "tag"), F.col("_parts"))
    return placed.join(F.broadcast(sizes), ["dim", "cell"]).withColumn("slice", F.concat_ws("/", "cell", inside)).drop("cell", "_parts")
