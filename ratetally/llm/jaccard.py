"""N-gram Jaccard join by vertical partitioning: the global n-gram order is cut into fragments that are counted apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from ratetally.llm.common import components, stored
from ratetally.llm.substrings import LACKING, keyed
from ratetally.llm.words import chunks, grams, mixed

# Fragments of the global order, by the leading bits of an n-gram's hash; the first ones sort out lonely documents.
FRAGMENT_BITS = 3
LEADING_FRAGMENTS = 2
BUCKET_BYTES = 12_000_000
# Pairs per posting from which a round of stars comes first.
MANY_PAIRS = 16
STAR_ROUNDS = 2
# Pairs that are sent to every task at most (16 bytes each); more are joined by shuffle.
SENT_PAIRS = 1_000_000
# Documents whose ids are sent to every task at most (16 bytes each); more are joined by shuffle.
SENT_ROWS = 2_000_000


def sets_of(counts: list[int], hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, n-gram) of the distinct n-grams of every document, ascending.

    A document of fewer than ``k`` words has its whole sequence as one; one without words has none.
    """
    sizes = np.asarray(counts)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    n = max(0, len(hashes) - k + 1)
    inside = np.flatnonzero(doc[:n] == doc[k - 1 :]) if n else np.zeros(0, "int64")
    gram, owner = grams(hashes, k)[inside], doc[inside]
    starts = np.cumsum(sizes) - sizes
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    whole = np.array([grams(hashes[starts[i] : starts[i] + sizes[i]], int(sizes[i]))[0] for i in short], "uint64")
    gram = np.concatenate([gram, mixed(whole + sizes[short].astype("uint64"))])
    owner = np.concatenate([owner, short])
    order = np.lexsort((gram, owner))
    gram, owner = gram[order], owner[order]
    new = np.append(True, (np.diff(gram) != 0) | (np.diff(owner) != 0)) if len(gram) else np.zeros(0, bool)
    return owner[new], gram[new]


def spare(n: Column, percent: int) -> Column:
    """How many n-grams of a set of ``n`` must be looked at so that any linked set shares one of them."""
    return n - F.floor((n * percent + 99) / 100) + 1


def lonely(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, check, n) of documents that certainly link with no other text.

    Only the leading fragments of the order are counted. A document with as many n-grams there that no other
    document has as a linked pair may differ by is out: whatever it shares is too little. n-grams travel with the
    place of their document in its chunk of input, the counts travel back to the chunk, and the documents' ids travel
    once. An n-gram that several documents of a chunk have is sent once, so a common one costs a row per chunk.
    """
    size = docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = max(1, size // (2 * BUCKET_BYTES))
    several_docs = 0xFFFFFFFF

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, checks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for first, counts, hashes in chunks(batch.column(2), lower=True):
                owner, gram = sets_of(counts, hashes, k)
                n = np.bincount(owner, minlength=len(counts))
                docs_here = np.stack([ids[first : first + len(n)], checks[first : first + len(n)], n], 1).astype("<i8").tobytes()
                chunk = xxhash.xxh3_64_intdigest(docs_here) >> 1
                lead = np.flatnonzero(gram >> np.uint64(64 - FRAGMENT_BITS) < LEADING_FRAGMENTS)
                order = lead[np.argsort(gram[lead], kind="stable")]
                new = np.append(True, np.diff(gram[order]) != 0) if len(order) else np.zeros(0, bool)
                heads = np.flatnonzero(new)
                several = np.diff(np.append(heads, len(order))) > 1
                gram, owner = gram[order[heads]], np.where(several, several_docs, owner[order[heads]]).astype("<u4")
                bucket = (gram % np.uint64(buckets)).astype("int64")
                by = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.append(True, np.diff(bucket[by]) != 0)) if len(by) else []
                rows = [(chunk % buckets, chunk, docs_here, b"", b"")]
                for a, b in zip(cuts, [*cuts[1:], len(by)]):
                    e = by[a:b]
                    short = (gram[e] // np.uint64(buckets)).astype("<u8").view("uint8").reshape(-1, 8)[:, :5]
                    rows.append((int(bucket[e[0]]), chunk, b"", short.tobytes(), owner[e].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 2 + [pa.binary()] * 3)], names=["bucket", "chunk", "docs", "grams", "doc"])

    def count(table: pa.Table) -> pa.Table:
        """Per chunk, the documents that have n-grams alone, and how many; documents of chunks pass through."""
        out, keys, owners, chunk_of, names = [], [], [], [], []
        for row in table.to_pylist():
            if row["docs"]:
                out.append((row["chunk"], row["docs"], b"", b""))
                continue
            key = np.zeros((len(row["grams"]) // 5, 8), "uint8")
            key[:, :5] = np.frombuffer(row["grams"], "uint8").reshape(-1, 5)
            keys.append(key.view("<u8").ravel())
            owners.append(np.frombuffer(row["doc"], "<u4"))
            chunk_of.append(np.full(len(key), len(names)))
            names.append(row["chunk"])
        if keys:
            keys, owners, chunk_of = (np.concatenate(x) for x in (keys, owners, chunk_of))
            order = np.argsort(keys, kind="stable")
            differ = np.diff(keys[order]) != 0
            own = order[np.append(True, differ) & np.append(differ, True)]
            own = own[owners[own] != several_docs]
            place = (chunk_of[own].astype("uint64") << np.uint64(32)) | owners[own]
            place, times = np.unique(place, return_counts=True)
            at = (place >> np.uint64(32)).astype("int64")
            cuts = np.flatnonzero(np.append(True, np.diff(at) != 0)) if len(at) else []
            for a, b in zip(cuts, [*cuts[1:], len(at)]):
                out.append((names[at[a]], b"", place[a:b].astype("<u4").tobytes(), times[a:b].astype("<u4").tobytes()))
        cols = list(zip(*out)) or [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(cols, [pa.int64()] + [pa.binary()] * 3)], names=["chunk", "docs", "doc", "times"])

    def judge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        # Chunks of one name are copies with the same documents.
        here = np.frombuffer(next(r["docs"] for r in rows if r["docs"]), "<i8").reshape(-1, 3)
        copies = sum(1 for r in rows if r["docs"])
        alone = np.zeros(len(here), "int64")
        for r in rows:
            np.add.at(alone, np.frombuffer(r["doc"], "<u4"), np.frombuffer(r["times"], "<u4"))
        n = here[:, 2]
        gone = np.flatnonzero((n > 0) & (alone >= n - (n * percent + 99) // 100 + 1)) if copies == 1 else np.zeros(0, "int64")
        return pa.table({"id": here[gone, 0], "check": here[gone, 1], "n": n[gone]})

    sent = docs.mapInArrow(send, "bucket long, chunk long, docs binary, grams binary, doc binary")
    counted = sent.groupBy("bucket").applyInArrow(count, "chunk long, docs binary, doc binary, times binary")
    return counted.groupBy("chunk").applyInArrow(judge, "id long, check long, n long")


def gram_sets(docs: DataFrame, k: int) -> DataFrame:
    """(id, n, fragment, grams): the n-gram set of every row (id, text) of ``docs``, a row per fragment of the order.

    Every document also has one row with neither fragment nor grams. Ids must not repeat.
    """
    names = ["id", "n", "fragment", "grams"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, counts, hashes in chunks(batch.column(1), lower=True):
                owner, gram = sets_of(counts, hashes, k)
                n = np.bincount(owner, minlength=len(counts)).astype("int64")
                fragment = (gram >> np.uint64(64 - FRAGMENT_BITS)).astype("int64")
                cell = np.flatnonzero(np.append(True, (np.diff(owner) != 0) | (np.diff(fragment) != 0))) if len(gram) else np.zeros(0, "int64")
                lists = pa.ListArray.from_arrays(pa.array(np.append(cell, len(gram)), pa.int32()), pa.array(gram.view("int64")))
                for at, place, grams_here in ((owner[cell], pa.array(fragment[cell], pa.int32()), lists), (np.arange(len(n)), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.list_(pa.int64())))):
                    yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in (ids[first + at], n[at])], place, grams_here], names=names)

    return docs.mapInArrow(build, "id long, n long, fragment int, grams array<long>")


def overlapping(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that link: partial overlaps are counted per fragment and summed per pair."""
    left = sets.select(F.struct("id").alias("_ka"), F.col("n").alias("na"), "fragment", F.col("grams").alias("ga"))
    seconds = pairs.select(F.struct("b").alias("_b")).distinct()
    if pairs.count() <= SENT_PAIRS:
        pairs, seconds = F.broadcast(pairs), F.broadcast(seconds)
    # Only the sets of second members travel, not all.
    right = sets.withColumn("_i", F.struct(F.col("id").alias("b"))).join(seconds, F.col("_i") == F.col("_b"), "left_semi")
    right = right.select(F.struct("id", "fragment").alias("_kb"), F.col("n").alias("nb"), F.col("grams").alias("gb"))
    cells = pairs.withColumn("_k", F.struct("a")).join(left, F.col("_k") == F.col("_ka")).withColumn("_k2", F.struct("b", "fragment")).join(right, F.col("_k2") == F.col("_kb"))
    parts = cells.select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).cast("long").alias("part"))
    sums = parts.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("both"))
    return sums.where(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent).select("a", "b").distinct()


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(gram, id, n, own): of every set the n-grams by which it must meet any set that it links with.

    The order is by how many sets have an n-gram, the rare ones first. n-grams of one set only come first of
    all, so they fill the prefix but need no posting; ``own`` counts them.
    """
    postings = sets.select("id", "n", F.explode("grams").alias("gram"))
    often = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    key = F.struct("gram")
    met = postings.withColumn("_k", key).join(often.select(key.alias("_g"), F.col("often").cast("int").alias("often")), F.col("_k") == F.col("_g")).select("id", "n", "gram", "often")
    w = Window.partitionBy("id", "n")
    ranked = met.withColumns({"_rank": F.row_number().over(w.orderBy("often", "gram")), "own": F.col("n") - F.count(F.lit(1)).over(w)})
    return ranked.where(F.col("own") + F.col("_rank") <= spare(F.col("n"), percent)).select("gram", "id", "n", "own")


def may_link(percent: int) -> Column:
    """Can two sets link, given their sizes and how many n-grams each has alone?"""
    return F.least(F.col("n") - F.col("own"), F.col("n2") - F.col("own2")) * (100 + percent) >= (F.col("n") + F.col("n2")) * percent


def labels(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node within two links. Nodes of one label are connected; others may be."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("a").agg(F.min("b").alias("m")).select(F.struct("a").alias("_n"), F.least("a", "m").alias("m"))
    far = both.join(near, F.struct(F.col("b").alias("a")) == F.col("_n")).groupBy("a").agg(F.min("m").alias("m"))
    return far.select(F.col("a").alias("node"), F.least("a", "m").alias("component"))


def linked_sets(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect just the sets that all links connect.

    Sets that share an n-gram of their prefixes may link. Where n-grams have many sets, up to ``STAR_ROUNDS``
    rounds compare every set with a single leader per n-gram, which joins groups of near copies by a star. At
    last all pairs across groups that were not yet compared are compared; sets in one group need not be. Of those
    pairs the shared n-grams of the prefixes are counted: of the set whose prefix ends first, all that is shared
    is among them or lies behind its prefix, so most pairs are out before their sets are fetched.
    """
    posts = stored(prefixes(sets, percent))
    links, tried, turn = None, None, 0
    now = posts.withColumn("component", F.col("id"))
    key = F.struct("gram")
    while True:
        counts = now.groupBy("gram").agg(F.count(F.lit(1)).alias("c"))
        pairs, rows = counts.agg(F.sum(F.col("c") * (F.col("c") - 1)), F.sum("c")).first()
        star = turn < STAR_ROUNDS and (pairs or 0) > MANY_PAIRS * (rows or 0)
        lead = F.struct(F.col("own") if turn == 0 else F.xxhash64(F.lit(turn), "id").alias("own"), F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("own").alias("own2"), F.col("component").alias("component2"))
        if star:
            other = now.groupBy("gram").agg(F.min(lead).alias("_h")).select(key.alias("_g"), "_h.id2", "_h.n2", "_h.own2", "_h.component2")
            across = F.col("component") != F.col("component2")
        else:
            other = now.select(key.alias("_g"), F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("own").alias("own2"), F.col("component").alias("component2"))
            across = F.col("component") < F.col("component2")
        near = now.withColumn("_k", key).join(other, (F.col("_k") == F.col("_g")) & across & may_link(percent))
        ends = [F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")]
        if star:
            fresh = near.select(*ends).distinct()
        else:
            behind = lambda n: F.col(n) - spare(F.col(n), percent)
            most = F.greatest(behind("n"), behind("n2"))
            counted = near.groupBy(*ends, (F.col("n") + F.col("n2")).alias("n"), most.alias("most")).agg(F.count(F.lit(1)).alias("c"))
            fresh = counted.where((F.col("c") + F.col("most")) * (100 + percent) >= F.col("n") * percent).select("a", "b").distinct()
        if tried is not None:
            fresh = fresh.join(tried, ["a", "b"], "left_anti")
        fresh = stored(fresh)
        good = stored(overlapping(fresh, sets, percent))
        links = good if links is None else links.unionByName(good)
        if not star:
            return links
        tried = fresh if tried is None else tried.unionByName(fresh)
        group = stored(labels(links))
        named = posts.join(group.select(F.struct("node").alias("_n"), "component"), F.struct("id") == F.col("_n"), "left").select(*posts.columns, F.coalesce("component", "id").alias("component"))
        mixed_up = named.groupBy("gram").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo <> _hi").select(key.alias("_g"))
        now = stored(named.withColumn("_k", key).join(mixed_up, F.col("_k") == F.col("_g"), "left_semi").drop("_k"))
        turn += 1


def only(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the texts that ``wanted`` (_id, _check, _more, node, copies) names, each once.

    A short list is sent, a long one joined. Only texts whose row occurs several times are grouped.
    """
    key = F.struct("_id", "_check", "_more")

    def meet(some: DataFrame) -> DataFrame:
        names = some.select(key.alias("_w"), "node")
        return rows.withColumn("_k", key).join(F.broadcast(names) if sent else names, F.col("_k") == F.col("_w")).select("node", "_text")

    sent = wanted.count() <= SENT_ROWS
    if wanted.where("copies > 1").isEmpty():
        return meet(wanted)
    return meet(wanted.where("copies = 1")).unionByName(meet(wanted.where("copies > 1")).groupBy("node").agg(F.min("_text").alias("_text")))


def linked_texts(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows (_id, _check, _more), lonely ones (id, check, n), the other distinct ones (_id, _check, _more, copies, head, node, n), links (a, b).

    Every distinct text that may link is a node, numbered for itself: rows that repeat a text or an id add nothing
    to its set. ``head`` is the smallest id of the text, ``copies`` the number of equal rows.
    """
    rows = keyed(docs, id_col, text_col, F.hash(F.coalesce(F.col(text_col), F.lit(""))).alias("_more"), apart=True)
    here = rows.select("_id", "_check", "_more")
    out = stored(lonely(rows.select("_id", "_check", "_text"), k, percent))
    counted = here.groupBy("_id", "_check", "_more").agg(F.count(F.lit(1)).alias("copies"))
    left = counted.join(out.select(F.col("id").alias("_i"), F.col("check").alias("_c")), (F.col("_id") == F.col("_i")) & (F.col("_check") == F.col("_c")), "left_anti")
    heads = stored(left.groupBy("_check", "_more").agg(F.min("_id").alias("head")).withColumn("node", F.monotonically_increasing_id()))
    named = stored(left.join(heads.select(F.struct("_check", "_more").alias("_k"), "head", "node"), F.struct("_check", "_more") == F.col("_k")).drop("_k"))
    sets = stored(gram_sets(only(rows, named.where("_id = head")), k))
    links = linked_sets(sets.where("fragment IS NOT NULL").select("id", "n", "fragment", "grams"), percent)
    size = sets.where("fragment IS NULL").select(F.struct(F.col("id").alias("node")).alias("_s"), "n")
    sized = named.join(size, F.struct("node") == F.col("_s")).drop("_s")
    return here, out, sized, links


def near_copies(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_key, copies, first) of the distinct rows (id, text) whose text has n-grams and is not certainly alone.

    Texts are linked as in ``jaccard_join``, but no two are one because their rows share or lack an id. ``first`` is
    true for the row of every group of linked texts with the smallest id (null last; then by hashes of the text).
    ``_key`` is a struct of the first columns of ``keyed`` and the text's hash ``_more``.
    """
    _, _, sized, links = linked_texts(docs, k, percent, id_col, text_col)
    group = components(links).select(F.struct("node").alias("_n"), "component")
    named = sized.where("n > 0").join(group, F.struct("node") == F.col("_n"), "left")
    named = named.select(F.struct("_id", "_check", "_more").alias("_key"), "copies", F.coalesce("component", "node").alias("component"))
    lead = named.groupBy("component").agg(F.min("_key").alias("_lead")).select(F.struct("component").alias("_c"), "_lead")
    return named.join(lead, F.struct("component") == F.col("_c")).select("_key", "copies", (F.col("_key") == F.col("_lead")).alias("first"))


def jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links, itself included).

    Words are lower-cased A-Z; a document's set holds its distinct runs of ``k`` words, or the whole sequence
    where it has fewer. Two documents link when 100 * intersection >= ``percent`` * union, checked exactly. A
    document without words, or with null text, has no set and links with nothing. Copies of a text (told by 96
    bits of hashes) are one class, and only its smallest id is compared. Rows that share an id are one document,
    which has the links of each of its texts. Rows without an id rank last and are told apart by their text; ids lie
    below 2^62. An empty table gives an empty
    result; other columns are ignored.
    """
    here, out, sized, links = linked_texts(docs, k, percent, id_col, text_col)
    heads = sized.where("_id = head").select(F.struct("node").alias("_n"), "head")
    for end in ("a", "b"):
        links = links.withColumn("_k", F.struct(F.col(end).alias("node"))).join(heads, F.col("_k") == F.col("_n")).withColumn(end, F.col("head")).select("a", "b")
    # Texts without n-grams are no copies of each other.
    group = components(links.unionByName(sized.where("n > 0 AND _id <> head").select(F.col("_id").alias("a"), F.col("head").alias("b"))))
    facts = out.unionByName(sized.select(F.col("_id").alias("id"), F.col("_check").alias("check"), "n"))
    facts = facts.join(group, facts["id"] == group["node"], "left").select(F.struct("id", "check").alias("_k"), "n", F.coalesce("component", "id").alias("component"))
    final = here.select("_id", F.struct("_id", "_check").alias("_key")).join(facts, F.col("_key") == F.col("_k"))
    known = lambda c: F.when(c < LACKING, c)
    return final.select(known(F.col("_id")).alias(id_col), F.col("n").alias("n_shingles"), known(F.col("component")).alias("component_id"))
