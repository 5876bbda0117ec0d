"""Keyed reconciliation of a published table (left) with a warehouse table (right)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ratetally.functions.cells import comparisons, display, field_diffs
from ratetally.functions.names import left_for_right, mapped_pairs, parse_mapping, pick_modifier, resolve_column
from ratetally.functions.text import norm_key
from ratetally.operators.spread import GROUP_LIMIT, heavy_keys, lookup_join, ranked_per_group, stored_columns, top_per_group

# Left rows of one key from which on they are spread over so many groups.
HEAVY_ROWS = 1_000_000
SALTS = 64
STATUSES = ["mismatch", "left_only", "right_only", "match"]
NO_MODIFIER = (
    "The same code appears on several rows. Map a left modifier column to MOD (or MOD 1, MOD 2, …), "
    "or narrow the data so that codes are unique."
)


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


def has_duplicates(*sides: tuple[DataFrame, Column]) -> DataFrame:
    """One row, one column: does any non-blank normalised key repeat on any of the given sides?"""
    return most_rows(*sides).select(F.coalesce(F.greatest("left", "right") > 1, F.lit(False)).alias("duplicated"))


def most_rows(*sides: tuple[DataFrame, Column]) -> DataFrame:
    """One row: the most rows of a non-blank normalised key on the first side and on the others, null where there is none."""
    counts = None
    for n, (df, key) in enumerate(sides):
        c = key_counts(df.select(norm_key(key).alias("_key")).where("_key <> ''"), ["_key"]).select("n_rows", F.lit(n == 0).alias("first"))
        counts = c if counts is None else counts.unionAll(c)
    return counts.agg(F.max(F.when(F.col("first"), F.col("n_rows"))).alias("left"), F.max(F.when(~F.col("first"), F.col("n_rows"))).alias("right"))


@dataclass(frozen=True)
class Reconciliation:
    """Result of :func:`reconcile`. ``rows`` has one row per emitted result row."""

    rows: DataFrame
    pairs: list[tuple[str, str]]
    mapping: dict[str, str]
    left: DataFrame
    right: DataFrame
    use_modifier: bool


def _shared_keys(left, right, mapping, code, mode):
    code_left = left_for_right(mapping, code)
    if code_left is None:
        raise ValueError(f"The mapping must pair a left column with {code}.")
    code_right = resolve_column(right.columns, code)
    if code_right is None:
        raise ValueError(f"The right side has no {code} column.")
    modifier = pick_modifier(mapping, right.columns)
    for need in (code_left, modifier and modifier[0]):
        if need and need not in left.columns:
            raise ValueError(f"The left side has no column {need!r} from the mapping.")
    if mode not in ("code", "code_and_modifier", "auto"):
        raise ValueError(f"Unknown mode {mode!r}")
    sides = [(left, F.col(f"`{code_left}`")), (right, F.col(f"`{code_right}`"))]
    on_left, on_right = most_rows(*(sides if mode == "auto" else sides[:1])).first()
    use_mod = mode == "code_and_modifier" or mode == "auto" and max(on_left or 0, on_right or 0) > 1
    if use_mod and modifier is None:
        raise ValueError(NO_MODIFIER)
    return code_left, code_right, modifier, use_mod, (on_left or 0) >= HEAVY_ROWS


def _with_keys(df, code, modifier, use_mod):
    key = lambda c: norm_key(F.col(f"`{c}`"), df.schema[c].dataType)
    code_key = key(code)
    keyed = df.withColumn("_code", code_key).where(F.col("_code") != "")
    return keyed.withColumn("_mod", key(modifier)) if use_mod else keyed


def first_right_rows(right: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """First row per key as the struct ``first`` and the number of rows of the key, by one aggregate.

    Each task sends one row per key at most, so a key with very many rows is no burden. Rows that
    ``order`` does not tell apart are ordered by their other columns.
    """
    ties = [c for c in columns if not right.schema[c].dataType.simpleString().startswith(("map", "variant"))]
    place = F.struct(*[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate([*order, *ties])])
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    return right.groupBy(*keys).agg(F.min_by(row, place).alias("first"), F.count(F.lit(1)).alias("n_rows"))


def outer_lookup(left: DataFrame, firsts: DataFrame, keys: Sequence[str], heavy: DataFrame | None = None) -> DataFrame:
    """All left rows with what ``firsts``, unique on ``keys``, holds for their key, and the rows of ``firsts`` that no left row meets.

    One full outer join: the aggregate that made ``firsts`` has dealt its rows by the keys already, so each side is
    shuffled once. ``_left`` tells whether there is a left row. Left rows of the ``heavy`` keys, at most
    ``MAX_HEAVY``, follow their input partitions into ``SALTS`` groups, each with a copy of the row they look up.
    """
    keys = list(keys)
    if heavy is None:
        return left.withColumn("_left", F.lit(True)).join(firsts, keys, "full_outer")
    named = F.broadcast(heavy.select(*keys, F.lit(True).alias("_heavy")))
    spread = left.join(named, keys, "left").withColumn("_salt", F.when(F.col("_heavy"), F.pmod(F.spark_partition_id(), F.lit(SALTS))).otherwise(0)).drop("_heavy")
    copies = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copied = firsts.join(named, keys, "left").withColumn("_salt", F.explode(copies))
    met = spread.withColumn("_left", F.lit(True)).join(copied, [*keys, "_salt"], "full_outer")
    # A heavy key has left rows; a copy that met none of them is no row of its own.
    return met.where(F.col("_left").isNotNull() | F.col("_heavy").isNull()).drop("_heavy", "_salt")


def reconcile(
    left: DataFrame,
    right: DataFrame,
    mapping: Mapping[str, str] | str,
    *,
    right_order: Sequence[str],
    code: str = "CODE",
    mode: str = "auto",
    numeric_mode: str = "loose",
    profile: str = "compare",
    keep_left: Sequence[str] = (),
    images: bool = False,
) -> Reconciliation:
    """Compare two tables row by row and field by field.

    ``mapping`` pairs left columns with right columns. Rows join on the normalised code, or on code and
    modifier: ``mode`` is ``code``, ``code_and_modifier`` or ``auto`` (modifier when any code repeats on
    either side). The rows per code are counted at the call, by a job over the codes alone: ``auto`` decides by it, and
    left codes of ``HEAVY_ROWS`` rows are spread. Rows with a blank code take no part. A left row meets the first right row of its key in
    ``right_order``; further right rows of a matched key are not reported. Result columns: status
    (match, mismatch, left_only, right_only), code, modifier, diffs (one struct per pair), diff_count,
    right_group_rows (rows of the right key), the ``keep_left`` columns, and with ``images`` both rows as
    MAP<STRING, STRING>.
    """
    mapping = parse_mapping(mapping)
    if not mapping:
        raise ValueError("The mapping is empty.")
    pairs = mapped_pairs(mapping, right.columns)
    code_left, code_right, modifier, use_mod, crowded = _shared_keys(left, right, mapping, code, mode)
    keys = ["_code", "_mod"] if use_mod else ["_code"]

    right_cols = list(right.columns) if images else list(
        dict.fromkeys([code_right, *([modifier[1]] if modifier else []), *[r for _, r in pairs]])
    )
    left_cols = list(left.columns) if images else list(
        dict.fromkeys(
            [code_left, *([modifier[0]] if modifier else []), *[l for l, _ in pairs if l in left.columns], *keep_left]
        )
    )
    lk = _with_keys(left, code_left, modifier and modifier[0], use_mod).select(*keys, *[F.col(f"`{c}`") for c in left_cols])
    rk = _with_keys(right, code_right, modifier and modifier[1], use_mod)
    firsts = first_right_rows(rk, keys, right_order, right_cols).withColumnsRenamed({"first": "_right", "n_rows": "_group"})

    heavy = heavy_keys(lk, keys, HEAVY_ROWS) if crowded else None
    both = outer_lookup(lk, firsts, keys, heavy)
    there, here = F.col("_right").isNotNull(), F.col("_left").isNotNull()

    lcell = lambda c: F.col(f"`{c}`") if c in left_cols else F.lit(None).cast("string")
    rcell = lambda c: F.col("_right")[c]
    ltype = lambda c: left.schema[c].dataType if c in left_cols else None
    rtype = lambda c: right.schema[c].dataType
    # The array is one column that is computed once; status and count read it. (As columns of their own the
    # comparisons are repeated by the optimizer wherever they are used.)
    out = both.withColumn("_diffs", field_diffs(pairs, comparisons(pairs, lcell, rcell, numeric_mode, profile, ltype, rtype)))
    out = out.withColumn("_n", F.size(F.filter("_diffs", lambda d: ~d["same"])))
    status = F.when(~here, "right_only").when(~there, "left_only").when(F.col("_n") == 0, "match").otherwise("mismatch")
    shown = lambda l, r: F.when(here, F.col(f"`{l}`").cast("string")).otherwise(F.col("_right")[r].cast("string"))
    cols = [
        status.alias("status"),
        shown(code_left, code_right).alias("code"),
        (shown(*modifier) if use_mod else F.lit(None).cast("string")).alias("modifier"),
        F.col("_diffs").alias("diffs"),
        F.col("_n").alias("diff_count"),
        F.coalesce(F.col("_group"), F.lit(0)).cast("long").alias("right_group_rows"),
        *[F.col(f"`{c}`") for c in keep_left],
    ]
    if images:
        empty = F.create_map().cast("map<string,string>")
        image = lambda df, cell: F.map_from_arrays(F.array(*[F.lit(c) for c in df.columns]), F.array(*[display(cell(c), df.schema[c].dataType) for c in df.columns]))
        cols += [
            F.when(here, image(left, lambda c: F.col(f"`{c}`"))).otherwise(empty).alias("left_row"),
            F.when(there, image(right, rcell)).otherwise(empty).alias("right_row"),
        ]
    return Reconciliation(out.select(*cols), pairs, mapping, left, right, use_mod)


def left_only(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left rows whose non-blank normalised key is absent on the right."""
    keys = right.select(norm_key(F.col(f"`{right_key}`")).alias("_key")).where("_key <> ''").distinct()
    keyed = left.withColumn("_key", norm_key(F.col(f"`{left_key}`"))).where("_key <> ''")
    missing = lookup_join(keyed, keys, ["_key"], "_hit").where(F.col("_hit").isNull())
    return missing.drop("_key", "_hit")


def right_only(left: DataFrame, right: DataFrame, left_key: str, right_key: str, right_order: Sequence[str]) -> DataFrame:
    """First right row and row count of every right key that is absent on the left."""
    keys = left.select(norm_key(F.col(f"`{left_key}`")).alias("key")).where("key <> ''").distinct()
    keyed = right.withColumn("key", norm_key(F.col(f"`{right_key}`"))).where("key <> ''")
    return first_right_rows(keyed, ["key"], right_order, right.columns).join(keys, "key", "left_anti")


def filter_status(rows: DataFrame, status: str) -> DataFrame:
    """Rows of one status, or every row that is not a match for ``changed``."""
    return rows.where(F.col("status") != "match") if status == "changed" else rows.where(F.col("status") == status)


def bucket_counts(rows: DataFrame) -> DataFrame:
    """Emitted rows per status."""
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n_rows"))


def summarize(result: Reconciliation, returned: DataFrame | None = None) -> DataFrame:
    """One row of totals. ``returned`` is the capped result when there is one."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    one = result.rows.agg(
        F.count_if(F.col("status").isin("match", "mismatch")).alias("matched_row_count"),
        is_("mismatch").alias("mismatch_count"),
        is_("match").alias("match_count"),
        is_("left_only").alias("left_only_count"),
        F.coalesce(F.sum(F.when(F.col("status") == "right_only", F.col("right_group_rows"))), F.lit(0)).alias("right_only_row_count"),
        is_("right_only").alias("right_only_key_count"),
        F.count(F.lit(1)).alias("_possible"),
    )
    count = lambda df: df.agg(F.count(F.lit(1))).scalar()
    got = F.col("_possible") if returned is None else count(returned)
    return one.select(
        F.lit("code_and_modifier" if result.use_modifier else "code").alias("join_mode"),
        F.lit(len(result.mapping)).cast("long").alias("mapped_field_count"),
        count(result.left).alias("left_row_count"),
        count(result.right).alias("right_row_count"),
        *[c for c in one.columns if c != "_possible"],
        got.alias("result_rows_returned"),
        (got < F.col("_possible")).alias("result_rows_capped"),
    )


def match_rate(matches: Column, mismatches: Column) -> Column:
    """Share of joined rows without a difference, in percent; null when nothing joined."""
    return F.try_divide(matches * 100, matches + mismatches)


def diff_profile(rows: DataFrame) -> DataFrame:
    """Per mapped pair: joined rows compared and joined rows that differ."""
    d = rows.where(F.col("status").isin("match", "mismatch")).select(F.explode("diffs").alias("d"))
    return d.groupBy(F.col("d.left_column").alias("left_column"), F.col("d.right_column").alias("right_column")).agg(
        F.count(F.lit(1)).alias("compared"), F.count_if(~F.col("d.same")).alias("differing")
    )


def quotas(counts: DataFrame, cap: int, method: str = "residue_last") -> DataFrame:
    """(status, quota) for a result cut to ``cap`` rows; ``counts`` holds (status, n_rows).

    Differences share the cap in proportion to their numbers, matches get what is left.
    ``residue_last`` leaves the rounding residue to right_only and then to the first status with room;
    ``largest_remainder`` gives it to the largest fractions.
    """
    n = lambda s: F.coalesce(F.max(F.when(F.col("status") == s, F.col("n_rows"))), F.lit(0)).cast("long")
    names = ["mismatch", "left_only", "right_only"]
    one = counts.agg(*[n(s).alias(f"n_{s}") for s in STATUSES])
    total = F.col("n_mismatch") + F.col("n_left_only") + F.col("n_right_only")
    one = one.withColumn("_t", total).withColumn("_c", F.least(F.lit(max(0, cap)).cast("long"), total))
    # Within a share c of t no bucket is ever full after rounding down, so at most two rows remain to hand out.
    share = lambda s: F.when(F.col("_t") > 0, F.floor(F.col(f"n_{s}") * F.col("_c") / F.greatest(F.col("_t"), F.lit(1)))).otherwise(0).cast("long")
    for s in names:
        one = one.withColumn(f"q_{s}", F.expr(f"CASE WHEN _t > 0 THEN (n_{s} * _c) DIV _t ELSE 0 END").cast("long"))
    rest = F.col("_c") - F.col("q_mismatch") - F.col("q_left_only") - F.col("q_right_only")
    one = one.withColumn("_rest", rest)
    if method == "residue_last":
        one = one.withColumn("_last", F.least(F.col("q_right_only") + F.col("_rest"), F.col("n_right_only")))
        one = one.withColumn("_rest", F.col("_c") - F.col("q_mismatch") - F.col("q_left_only") - F.col("_last"))
        one = one.withColumn("q_right_only", F.col("_last"))
        for s in names:
            extra = F.least(F.col("_rest"), F.lit(1), F.col(f"n_{s}") - F.col(f"q_{s}"))
            one = one.withColumn("_extra", extra).withColumn(f"q_{s}", F.col(f"q_{s}") + F.col("_extra"))
            one = one.withColumn("_rest", F.col("_rest") - F.col("_extra"))
    elif method == "largest_remainder":
        frac = {s: F.expr(f"CASE WHEN _t > 0 THEN (n_{s} * _c) % _t ELSE 0 END") for s in names}
        ahead = {
            s: sum(
                ((frac[o] > frac[s]) | ((frac[o] == frac[s]) & F.lit(names.index(o) < names.index(s)))).cast("int")
                for o in names if o != s
            )
            for s in names
        }
        for s in names:
            one = one.withColumn(f"_x_{s}", F.when(ahead[s] < F.col("_rest"), 1).otherwise(0))
        for s in names:
            one = one.withColumn(f"q_{s}", F.col(f"q_{s}") + F.col(f"_x_{s}"))
    else:
        raise ValueError(f"Unknown method {method!r}")
    left_over = F.lit(max(0, cap)).cast("long") - F.col("q_mismatch") - F.col("q_left_only") - F.col("q_right_only")
    one = one.withColumn("q_match", F.least(F.col("n_match"), left_over))
    pairs = F.array(*[F.struct(F.lit(s).alias("status"), F.col(f"q_{s}").alias("quota")) for s in STATUSES])
    return one.select(F.inline(pairs))


def cap_result(rows: DataFrame, cap: int, order: Sequence[str], method: str = "residue_last") -> DataFrame:
    """The first rows of every status in ``order``, each status cut to its quota.

    A small cap is taken from every task's own first rows. Beyond that the rows are stored by columns, so that they are made
    once for the quotas, the ranges and the sort, and sorted by ranges, so that no task holds a status.
    """
    if cap <= GROUP_LIMIT:
        best = top_per_group(rows, ["status"], [F.col(c) for c in order], max(cap, 1), rank="rank_in_status")
    else:
        rows = stored_columns(rows)
        best = ranked_per_group(rows, ["status"], order, "rank_in_status")
    share = quotas(bucket_counts(rows), cap, method)
    return best.join(F.broadcast(share), "status").where(F.col("rank_in_status") <= F.col("quota")).drop("quota")
