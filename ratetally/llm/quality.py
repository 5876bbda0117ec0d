"""Document quality by attention over passages, learnt from document labels only."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ratetally.llm.common import sliced
from ratetally.llm.words import hashes_of

# Words of a passage; the last passage of a text may be shorter.
PASSAGE_WORDS = 64
# Labelled documents that a model is fitted on at most: a bounded sample, by a hash of the id.
SAMPLE_DOCS = 4_000
SIGNATURE = 16

_CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", ".", ",;:", "!?", "'\"()-", "#$%&*@~^+=<>{}[]\\/_`", "|")


def _table() -> np.ndarray:
    table = np.full(256, len(_CLASSES) + 1, "int64")  # the last class: other bytes
    for i, chars in enumerate(_CLASSES):
        for c in chars.encode():
            table[c] = i
    table[128:] = len(_CLASSES)
    return table


BYTE_CLASS = _table()
N_CLASSES = len(_CLASSES) + 2
N_FEATURES = N_CLASSES + 7 + SIGNATURE


def class_counts(data: np.ndarray, sizes: np.ndarray, slab: int = 2048) -> np.ndarray:
    """Bytes of every class in consecutive runs of the given sizes; a slab of runs at a time bounds memory."""
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for at in range(0, len(sizes), slab):
        some = sizes[at : at + slab]
        cells = np.repeat(np.arange(len(some)) * N_CLASSES, some) + BYTE_CLASS[data[bounds[at] : bounds[at + len(some)]]]
        out.append(np.bincount(cells, minlength=len(some) * N_CLASSES).reshape(-1, N_CLASSES))
    return np.concatenate(out)


def encode(text: str) -> np.ndarray:
    """One row of features per passage; a text without words has one row of zeros.

    Shares of byte classes (letters by case, digits, punctuation, symbols, bars), word length, how many words
    repeat their neighbour, an earlier word of the passage or an earlier word of the text, words without a
    letter, lines and the passage's length, and a signed hash of the words' last two bytes.
    """
    raw = text.encode()
    words = raw.split()
    if not words:
        return np.zeros((1, N_FEATURES))
    n = len(words)
    starts = np.arange(0, n, PASSAGE_WORDS)
    sizes = np.diff(np.append(starts, n))
    ids = hashes_of(words)
    lengths = np.fromiter(map(len, words), "int64", n)
    passage = np.arange(n) // PASSAGE_WORDS
    data = np.frombuffer(b"".join(words), "uint8")
    counts = class_counts(data, np.add.reduceat(lengths, starts))
    total = np.add.reduceat(lengths, starts)
    shares = counts / total[:, None]
    same = np.append(False, ids[1:] == ids[:-1])
    same[starts] = False
    # First place of every word, in the text and in its passage.
    order = np.argsort(ids, kind="stable")
    ranked, at = ids[order], passage[order]
    again = np.append(False, ranked[1:] == ranked[:-1])
    here = again & np.append(False, at[1:] == at[:-1])
    seen, seen_here = np.empty(n, bool), np.empty(n, bool)
    seen[order], seen_here[order] = again, here
    ends = np.cumsum(lengths)
    last = data[ends - 1].astype("int64")
    before = data[np.maximum(ends - 2, 0)].astype("int64")
    slot = (last * 131 + before * 31) % (2 * SIGNATURE)
    signs = np.bincount(passage * 2 * SIGNATURE + slot, minlength=len(starts) * 2 * SIGNATURE).reshape(-1, 2, SIGNATURE)
    own = (BYTE_CLASS[last] >= 5) & (BYTE_CLASS[last] <= 8)
    mean = lambda x: np.add.reduceat(x.astype("float64"), starts) / sizes
    return np.column_stack([
        shares, mean(lengths) / 10, mean(same), mean(seen_here), mean(seen), mean(own), np.log1p(sizes) / 5, np.log1p(text.count("\n") / n * 64) * np.ones(len(starts)),
        (signs[:, 0] - signs[:, 1]) / sizes[:, None],
    ])


@dataclass
class Model:
    """Passage encoder h, gated attention (v, u, w) and the score of the weighted passage."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def score(self, features: list[np.ndarray]) -> np.ndarray:
        """Score of every document, given its passages' features."""
        starts = np.cumsum([0, *[len(f) for f in features[:-1]]])
        x = (np.concatenate(features) - self.mean) / self.scale
        return 1 / (1 + np.exp(-_forward(x, starts, self.weights)[0]))


def _forward(x: np.ndarray, starts: np.ndarray, p: dict[str, np.ndarray]):
    h = np.tanh(x @ p["encode"] + p["encode_bias"])
    v, u = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
    e = (v * u) @ p["w"]
    sizes = np.diff(np.append(starts, len(x)))
    a = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
    a /= np.repeat(np.add.reduceat(a, starts), sizes)
    z = np.add.reduceat(h * a[:, None], starts)
    return z @ p["out"] + p["out_bias"][0], h, v, u, a, z, sizes


def _gradients(x, starts, y, p):
    s, h, v, u, a, z, sizes = _forward(x, starts, p)
    ds = (1 / (1 + np.exp(-s)) - y) / len(y)
    g = {"out": z.T @ ds, "out_bias": np.array([ds.sum()])}
    dz = np.repeat(ds[:, None] * p["out"], sizes, axis=0)
    da = (dz * h).sum(1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
    g["w"] = (v * u).T @ de
    dv, du = de[:, None] * p["w"] * u * (1 - v * v), de[:, None] * p["w"] * v * u * (1 - u)
    g["v"], g["u"] = h.T @ dv, h.T @ du
    dh = (dz * a[:, None] + dv @ p["v"].T + du @ p["u"].T) * (1 - h * h)
    g["encode"], g["encode_bias"] = x.T @ dh, dh.sum(0)
    return g


def fit(features: list[np.ndarray], labels: np.ndarray, hidden: int = 16, gates: int = 8, epochs: int = 30, rate: float = 0.01, decay: float = 1e-4, batch: int = 128, seed: int = 7) -> Model:
    """Adam on the log loss, with gradients of the whole network."""
    rng = np.random.default_rng(seed)
    every = np.concatenate(features)
    mean, scale = every.mean(0), every.std(0) + 1e-3
    features = [(f - mean) / scale for f in features]
    d = every.shape[1]
    p = {
        "encode": rng.normal(0, d**-0.5, (d, hidden)), "encode_bias": np.zeros(hidden), "v": rng.normal(0, hidden**-0.5, (hidden, gates)),
        "u": rng.normal(0, hidden**-0.5, (hidden, gates)), "w": rng.normal(0, gates**-0.5, gates), "out": rng.normal(0, hidden**-0.5, hidden), "out_bias": np.zeros(1),
    }
    first, second, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs)
        order = rng.permutation(len(features))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            xs = [features[i] for i in part]
            starts = np.cumsum([0, *[len(x) for x in xs[:-1]]])
            g = _gradients(np.concatenate(xs), starts, labels[part], p)
            step += 1
            for k in p:
                grad = g[k] + decay * p[k]
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                p[k] = p[k] - lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, p)


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE_DOCS) -> Model | None:
    """Model from the labelled documents that are not held out, ``sample`` of them at most; None without any.

    The sample is the labelled ids of the smallest hash, so it does not depend on the order of the rows. Its
    passages are encoded by the tasks and their features come to the driver: bounded by the sample, except that
    of a very long document at most 512 evenly spread passages train. Null labels and labels of unknown ids do
    not train; an id labelled twice trains with its mean label.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y")).where("_id is not null and _y is not null")
    known = known.where(~held_out("_id")).groupBy("_id").agg(F.avg("_y").alias("_y"))
    picked = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(picked), "_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("_text"):
                f = encode(text.as_py() or "")
                out.append((f if len(f) <= 512 else f[np.linspace(0, len(f) - 1, 512).astype(int)]).astype("float32").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("_id").cast(pa.string()), batch.column("_y"), pa.array(out, pa.binary())], names=["id", "y", "f"])

    got = rows.select("_id", "_y", "_text").mapInArrow(features, "id string, y double, f binary").orderBy("id").toPandas()
    if not len(got):
        return None
    return fit([np.frombuffer(f, "float32").reshape(-1, N_FEATURES).astype("float64") for f in got["f"]], got["y"].to_numpy())


def score(docs: DataFrame, model: Model | None, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with held_out, score and predicted. Whole texts are scored; nothing but the text is an input.

    Null and empty texts are scored as one passage of zeros; without a model every score is 0.5. Columns named
    held_out, score or predicted are replaced; an empty table gives an empty result; repeated rows are scored
    each.
    """
    docs = docs.drop("held_out", "score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, text_col):
                got = np.full(part.num_rows, 0.5)
                if model is not None:
                    got = model.score([encode(t.as_py() or "") for t in part.column(text_col)])
                yield part.append_column("score", pa.array(got))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = docs.mapInArrow(run, f"{schema}, score double")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    return out.select(*cols, held_out(id_col).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
