"""Reconciliation queries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from checks import check, read
from ratetally.functions.jsontext import invert_map, left_for_right, paired_count, parse_column_map
from ratetally.operators import compare as c
from ratetally.plans.compare_run import compare_run
from ratetally.sources.sinks import export_bucket

PART_MAP = {"Procedure Code": "CODE", "Facility Rate": "FAC", "Description": "DESCR"}


def part_left(spark, sf) -> DataFrame:
    k = F.col("p_partkey")
    rate = (F.col("p_retailprice").cast("decimal(18,3)") + F.when(k % 7 == 0, 1).when(k % 5 == 0, 0.004).otherwise(0).cast("decimal(18,3)")).cast("decimal(18,3)")
    return read(spark, sf, "part").where("p_partkey % 11 <> 0").select(
        F.concat(F.lit(" p-"), k.cast("string"), F.when(k % 3 == 0, "\t").otherwise("")).alias("Procedure Code"),
        F.concat(F.when(k % 4 == 0, "$").otherwise(""), rate.cast("string")).alias("Facility Rate"),
        F.concat(F.upper("p_name"), F.when(k % 9 == 0, "  ").otherwise("")).alias("Description"),
        F.col("p_size").alias("size"),
    )


def part_right(spark, sf) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, sf, "part").where("p_partkey % 13 <> 0").select(
        F.concat(F.lit("P-"), k.cast("string")).alias("Code"),
        F.col("p_retailprice").cast("decimal(18,2)").alias("FAC"),
        F.when(k % 17 == 0, None).otherwise(F.upper("p_name")).alias("DESCR"),
        k.alias("row_no"),
    )


def part_result(spark, sf, **kw):
    return c.reconcile(part_left(spark, sf), part_right(spark, sf), PART_MAP, right_order=["row_no"], **kw)


NORM = r"trim(regexp_replace(coalesce(cast({0} as varchar), ''), '\s+', ' ', 'g'))"
NUM = r"try_cast(nullif(regexp_replace({0}, '[^0-9.\-]', '', 'g'), '') as decimal(37,10))"


def norm(x):
    return NORM.format(x)


def num(x):
    return NUM.format(x)


PART_SQL = rf"""
l0 AS (SELECT p_partkey AS k, ' p-' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN chr(9) ELSE '' END AS code,
   CASE WHEN p_partkey % 4 = 0 THEN '$' ELSE '' END || cast(cast(cast(p_retailprice AS decimal(18,3)) +
     CASE WHEN p_partkey % 7 = 0 THEN 1.000 WHEN p_partkey % 5 = 0 THEN 0.004 ELSE 0.000 END AS decimal(18,3)) AS varchar) AS rate,
   upper(p_name) || CASE WHEN p_partkey % 9 = 0 THEN '  ' ELSE '' END AS descr
  FROM part WHERE p_partkey % 11 <> 0),
r0 AS (SELECT p_partkey AS k, 'P-' || p_partkey AS code, cast(cast(p_retailprice AS decimal(18,2)) AS varchar) AS rate,
   CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE upper(p_name) END AS descr FROM part WHERE p_partkey % 13 <> 0),
j AS (SELECT l0.k AS lk, r0.k AS rk, {norm('l0.code')} AS lc, {norm('r0.code')} AS rc, l0.code AS lraw, r0.code AS rraw,
   {norm('l0.rate')} AS lr, {norm('r0.rate')} AS rr, {norm('l0.descr')} AS ld, {norm('r0.descr')} AS rd
  FROM l0 FULL OUTER JOIN r0 ON upper({norm('l0.code')}) = upper({norm('r0.code')})),
n AS (SELECT *, {num('lr')} AS ln, {num('rr')} AS rn, {num('lc')} AS lcn, {num('rc')} AS rcn, {num('ld')} AS ldn, {num('rd')} AS rdn FROM j),
d AS (SELECT *,
   lc = rc OR coalesce(abs(lcn - rcn) <= 0.005, false) AS s1,
   lr = rr OR coalesce(round(ln, 2) = round(rn, 2), false) AS s2,
   ld = rd OR coalesce(abs(ldn - rdn) <= 0.005, false) AS s3,
   CASE WHEN lr <> rr AND ln IS NOT NULL AND rn IS NOT NULL THEN cast(cast(round(ln, 2) AS decimal(30,2)) AS varchar) ELSE lr END AS lshow,
   CASE WHEN lr <> rr AND ln IS NOT NULL AND rn IS NOT NULL THEN cast(cast(round(rn, 2) AS decimal(30,2)) AS varchar) ELSE rr END AS rshow
  FROM n),
res AS (SELECT *, CASE WHEN rk IS NULL THEN 'left_only' WHEN lk IS NULL THEN 'right_only' WHEN s1 AND s2 AND s3 THEN 'match' ELSE 'mismatch' END AS status,
   coalesce(lraw, rraw) AS code, cast(3 - s1::int - s2::int - s3::int AS integer) AS diff_count FROM d)
"""


@check(f"WITH {PART_SQL} SELECT status, code, diff_count, cast((rk IS NOT NULL)::int AS bigint) AS right_group_rows FROM res")
def reconcile_by_code(spark, sf):
    return part_result(spark, sf).rows.select("status", "code", "diff_count", "right_group_rows")


@check(f"""WITH {PART_SQL}
SELECT status, code, 'Procedure Code' AS left_column, 'Code' AS right_column, lc AS left_value, rc AS right_value, s1 AS same FROM res UNION ALL
SELECT status, code, 'Facility Rate', 'FAC', lshow, rshow, s2 FROM res UNION ALL
SELECT status, code, 'Description', 'DESCR', ld, rd, s3 FROM res""")
def reconcile_field_diffs(spark, sf):
    rows = part_result(spark, sf, mode="code").rows
    return rows.select("status", "code", F.inline("diffs"))


@check(f"""WITH {PART_SQL} SELECT status, code, 'D ' || coalesce(ld, '') AS left_descr, 'D ' || coalesce(rd, '') AS right_descr FROM (
  SELECT status, code, CASE WHEN lk IS NULL THEN NULL ELSE ld END AS ld, rd FROM res)""")
def reconcile_row_images(spark, sf):
    rows = part_result(spark, sf, images=True).rows
    get = lambda m, k: F.concat(F.lit("D "), F.coalesce(F.element_at(m, F.lit(k)), F.lit("")))
    return rows.select("status", "code", get("left_row", "Description").alias("left_descr"), get("right_row", "DESCR").alias("right_descr"))


@check(f"WITH {PART_SQL} SELECT status, code, diff_count FROM res")
def compare_run_through_a_saved_mapping(spark, sf):
    """The mapping is looked up for a file; the warehouse side is one state's rows of a table of several."""
    artifacts = read(spark, sf, "customer").select(F.col("c_custkey").alias("artifact_id"), F.lit("ny").alias("state_code"), F.concat(F.lit("key "), F.col("c_custkey").cast("string")).alias("logical_schedule_key"))
    stamp = F.lit(None).cast("timestamp_ntz")
    text = F.when(F.col("artifact_id") == 7, json.dumps(PART_MAP)).otherwise('{"Procedure Code": "OTHER"}')
    maps = artifacts.select(F.col("artifact_id").alias("mapping_id"), F.lit("NY").alias("state_code"), F.col("logical_schedule_key").alias("state_logical_schedule_key"), F.lit("parts").alias("dst_fsname"), text.alias("column_map_json"), stamp.alias("created_at_utc"), stamp.alias("updated_at_utc"))
    house = part_right(spark, sf)
    house = house.withColumn("state_code", F.lit("NY")).unionByName(house.withColumn("state_code", F.lit("GA")))
    rows = compare_run(part_left(spark, sf), house, artifacts, maps, state="ny", artifact_id=7, table="parts", right_order=["row_no"]).rows
    return rows.select("status", "code", "diff_count")


LINES = {"Order": "CODE", "Line": "MOD 1", "Units": "QTY", "Allowed Amount": "PRICE"}


def lines_left(spark, sf):
    return read(spark, sf, "lineitem").where("l_partkey % 7 <> 0").select(
        F.col("l_orderkey").alias("Order"), F.col("l_linenumber").alias("Line"), F.col("l_quantity").cast("decimal(18,2)").alias("Units"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("Allowed Amount"),
    )


def lines_right(spark, sf):
    return read(spark, sf, "lineitem").where("l_partkey % 5 <> 0").select(
        F.col("l_orderkey").cast("string").alias("CODE"), F.col("l_linenumber").cast("string").alias("MOD 1"),
        F.col("l_quantity").cast("decimal(18,2)").alias("QTY"), F.col("l_extendedprice").cast("decimal(18,2)").alias("PRICE"),
        "l_partkey", "l_suppkey", "l_shipdate",
    )


def lines_result(spark, sf, **kw):
    return c.reconcile(lines_left(spark, sf), lines_right(spark, sf), LINES, right_order=["l_partkey", "l_suppkey", "l_shipdate", "PRICE", "QTY"], **kw)


LINES_SQL = """
l0 AS (SELECT cast(l_orderkey AS varchar) AS code, cast(l_linenumber AS varchar) AS mod, cast(l_quantity AS decimal(18,2)) AS q, cast(l_extendedprice AS decimal(18,2)) AS p
  FROM lineitem WHERE l_partkey % 7 <> 0),
r0 AS (SELECT cast(l_orderkey AS varchar) AS code, cast(l_linenumber AS varchar) AS mod, cast(l_quantity AS decimal(18,2)) AS q, cast(l_extendedprice AS decimal(18,2)) AS p,
  l_partkey, l_suppkey, l_shipdate FROM lineitem WHERE l_partkey % 5 <> 0),
r1 AS (SELECT *, row_number() OVER (PARTITION BY code, mod ORDER BY l_partkey, l_suppkey, l_shipdate, p, q) AS rn, count(*) OVER (PARTITION BY code, mod) AS n FROM r0),
rf AS (SELECT * FROM r1 WHERE rn = 1),
res AS (SELECT CASE WHEN rf.code IS NULL THEN 'left_only' WHEN l0.code IS NULL THEN 'right_only'
    WHEN abs(l0.q - rf.q) <= 0.005 AND l0.p = rf.p THEN 'match' ELSE 'mismatch' END AS status,
    coalesce(l0.code, rf.code) AS code, coalesce(l0.mod, rf.mod) AS modifier, coalesce(rf.n, 0) AS right_group_rows,
    CASE WHEN l0.code IS NOT NULL AND rf.code IS NOT NULL THEN (abs(l0.q - rf.q) > 0.005)::int END AS dq,
    CASE WHEN l0.code IS NOT NULL AND rf.code IS NOT NULL THEN (l0.p <> rf.p)::int END AS dp
  FROM l0 FULL OUTER JOIN rf ON l0.code = rf.code AND l0.mod = rf.mod)
"""


@check(f"WITH {LINES_SQL} SELECT status, code, modifier, right_group_rows FROM res")
def reconcile_by_code_and_modifier(spark, sf):
    return lines_result(spark, sf).rows.select("status", "code", "modifier", "right_group_rows")


SUMMARY = """SELECT '{mode}' AS join_mode, cast({n} AS bigint) AS mapped_field_count, (SELECT count(*) FROM l0) AS left_row_count, (SELECT count(*) FROM r0) AS right_row_count,
 count(*) FILTER (status IN ('match','mismatch')) AS matched_row_count, count(*) FILTER (status = 'mismatch') AS mismatch_count,
 count(*) FILTER (status = 'match') AS match_count, count(*) FILTER (status = 'left_only') AS left_only_count,
 cast(coalesce(sum({g}) FILTER (status = 'right_only'), 0) AS bigint) AS right_only_row_count, count(*) FILTER (status = 'right_only') AS right_only_key_count,
 count(*) AS result_rows_returned, false AS result_rows_capped FROM res"""


@check(f"WITH {LINES_SQL} {SUMMARY.format(mode='code_and_modifier', n=4, g='right_group_rows')}")
def compare_summary(spark, sf):
    return c.summarize(lines_result(spark, sf))


@check(f"WITH {PART_SQL} {SUMMARY.format(mode='code', n=3, g='1')}")
def compare_summary_unique_codes(spark, sf):
    return c.summarize(part_result(spark, sf))


@check(f"WITH {LINES_SQL} SELECT cast(100 * count(*) FILTER (status = 'match') // count(*) FILTER (status IN ('match','mismatch')) AS bigint) AS whole_percent FROM res")
def compare_match_rate(spark, sf):
    s = c.summarize(lines_result(spark, sf))
    return s.select(F.floor(c.match_rate(F.col("match_count"), F.col("mismatch_count"))).cast("bigint").alias("whole_percent"))


@check(f"WITH {LINES_SQL} SELECT status, count(*) AS n_rows FROM res GROUP BY status")
def compare_bucket_counts(spark, sf):
    return c.bucket_counts(lines_result(spark, sf).rows)


@check(f"WITH {PART_SQL} SELECT status, code, diff_count FROM res WHERE status <> 'match'")
def compare_changed_rows(spark, sf):
    return c.filter_status(part_result(spark, sf).rows, "changed").select("status", "code", "diff_count")


@check(f"""WITH {LINES_SQL} SELECT 'Units' AS left_column, 'QTY' AS right_column, count(*) AS compared, cast(sum(dq) AS bigint) AS differing FROM res WHERE dq IS NOT NULL
UNION ALL SELECT 'Allowed Amount', 'PRICE', count(*), cast(sum(dp) AS bigint) FROM res WHERE dp IS NOT NULL""")
def compare_diff_profile(spark, sf):
    return c.diff_profile(lines_result(spark, sf).rows).where("left_column IN ('Units', 'Allowed Amount')")


@check("""SELECT max(n) > 1 AS duplicated FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT o_orderkey, count(*) FROM orders GROUP BY 1)""")
def duplicate_key_test(spark, sf):
    return c.has_duplicates((read(spark, sf, "lineitem"), F.col("l_orderkey")), (read(spark, sf, "orders"), F.col("o_orderkey")))


@check("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_partkey % 3 = 0)")
def left_only_rows(spark, sf):
    right = read(spark, sf, "lineitem").where("l_partkey % 3 = 0")
    return c.left_only(read(spark, sf, "orders"), right, "o_orderkey", "l_orderkey").select("o_orderkey")


@check("""SELECT cast(l_orderkey AS varchar) AS key, min(struct_pack(a := l_partkey, b := l_suppkey)).a AS first_part, count(*) AS n_rows FROM lineitem
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 3 = 0) GROUP BY l_orderkey""")
def right_only_keys(spark, sf):
    left = read(spark, sf, "orders").where("o_orderkey % 3 = 0")
    right = read(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    out = c.right_only(left, right, "o_orderkey", "l_orderkey", ["l_partkey", "l_suppkey"])
    return out.select("key", F.col("first.l_partkey").alias("first_part"), "n_rows")


CAP = 100


def capped(spark, sf, method, cap=CAP):
    rows = lines_result(spark, sf).rows.drop("diffs")
    return c.cap_result(rows.withColumn("_m", F.coalesce("modifier", F.lit(""))), cap, ["code", "_m", "right_group_rows", "diff_count"], method).select("status", "code", "modifier", "right_group_rows", F.col("rank_in_status").cast("bigint").alias("rank_in_status"))


def quota_sql(cap, method):
    residue = """least(c - m * c // t - s * c // t, d) AS q3, m * c // t AS q1, s * c // t AS q2"""
    if method == "residue_last":
        pick = f"""q AS (SELECT *, {residue} FROM b), q_ AS (SELECT *, c - q1 - q2 - q3 AS x FROM q),
        f AS (SELECT q1 + CASE WHEN x > 0 AND q1 < m THEN 1 ELSE 0 END AS a1, q2 + CASE WHEN x > 0 AND q1 >= m AND q2 < s THEN 1 ELSE 0 END AS a2, q3 AS a3, ma, c FROM q_)"""
    else:
        pick = """q AS (SELECT *, m * c // t AS q1, s * c // t AS q2, d * c // t AS q3, (m * c) % t AS f1, (s * c) % t AS f2, (d * c) % t AS f3 FROM b),
        q_ AS (SELECT *, c - q1 - q2 - q3 AS x, (f2 > f1)::int + (f3 > f1)::int AS o1, (f1 >= f2)::int + (f3 > f2)::int AS o2, (f1 >= f3)::int + (f2 >= f3)::int AS o3 FROM q),
        f AS (SELECT q1 + (o1 < x)::int AS a1, q2 + (o2 < x)::int AS a2, q3 + (o3 < x)::int AS a3, ma, c FROM q_)"""
    return f"""n AS (SELECT count(*) FILTER (status = 'mismatch') AS m, count(*) FILTER (status = 'left_only') AS s, count(*) FILTER (status = 'right_only') AS d,
      count(*) FILTER (status = 'match') AS ma FROM res), b AS (SELECT *, m + s + d AS t, least({cap}, m + s + d) AS c FROM n), {pick}
    , share AS (SELECT * FROM (SELECT 'mismatch' AS status, a1 AS quota FROM f UNION ALL SELECT 'left_only', a2 FROM f UNION ALL SELECT 'right_only', a3 FROM f
      UNION ALL SELECT 'match', least(ma, {cap} - a1 - a2 - a3) FROM f))
    SELECT status, code, modifier, right_group_rows, row_number() OVER (PARTITION BY status ORDER BY code, modifier, right_group_rows) AS rank_in_status
    FROM res JOIN share USING (status) QUALIFY rank_in_status <= quota"""


@check(f"WITH {LINES_SQL}, {quota_sql(CAP, 'residue_last')}")
def capped_result_residue_last(spark, sf):
    return capped(spark, sf, "residue_last")


@check(f"WITH {LINES_SQL}, {quota_sql(CAP + 1, 'largest_remainder')}")
def capped_result_largest_remainder(spark, sf):
    return capped(spark, sf, "largest_remainder", CAP + 1)


@check(f"WITH {LINES_SQL}, {quota_sql(100000000, 'residue_last')}")
def capped_result_large_cap(spark, sf):
    return capped(spark, sf, "residue_last", 100000000)


@check(f"""WITH {PART_SQL} SELECT 'modified' AS bucket, lc AS code, lshow AS rate FROM res WHERE status = 'mismatch' UNION ALL
SELECT 'added', lc, lshow FROM res WHERE status = 'left_only' UNION ALL SELECT 'right_only', rc, rshow FROM res WHERE status = 'right_only'""")
def compare_export_buckets(spark, sf):
    res = part_result(spark, sf, mode="code")
    out = None
    for bucket in ("modified", "added", "right_only"):
        names = ["Code", "FAC"] if bucket == "right_only" else ["Procedure Code", "Facility Rate"]
        part = export_bucket(res, bucket).select(F.lit(bucket).alias("bucket"), F.col(f"`{names[0]}`").alias("code"), F.col(f"`{names[1]}`").alias("rate"))
        out = part if out is None else out.unionByName(part)
    return out


def part_mappings(spark, sf):
    k = F.col("p_partkey")
    return read(spark, sf, "part").select(
        "p_partkey",
        F.when(k % 5 == 0, "not json").when(k % 7 == 0, "[1]").otherwise(
            F.concat(F.lit('{" Proc '), k.cast("string"), F.lit(' ": " code ", "Name": "'), F.col("p_name"), F.lit('", " ": "x", "Empty": " "}'))
        ).alias("column_map_json"),
    )


MAPS = """m AS (SELECT p_partkey, p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AS ok, p_name FROM part)"""


@check(f"""WITH {MAPS} SELECT p_partkey, cast(CASE WHEN ok THEN 3 ELSE 0 END AS integer) AS n_entries, cast(CASE WHEN ok THEN 2 ELSE 0 END AS integer) AS paired,
 CASE WHEN ok THEN 'Proc ' || p_partkey ELSE '' END AS left_of_code, CASE WHEN ok THEN 'Name' ELSE '' END AS by_name FROM m""")
def column_map_functions(spark, sf):
    m = part_mappings(spark, sf).withColumn("m", parse_column_map(F.col("column_map_json")))
    return m.join(read(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey").select(
        "p_partkey", F.size("m").alias("n_entries"), paired_count(F.col("m")).alias("paired"),
        F.coalesce(left_for_right(F.col("m"), "CODE"), F.lit("")).alias("left_of_code"),
        F.coalesce(F.element_at(invert_map(F.col("m")), F.upper("p_name")), F.lit("")).alias("by_name"),
    )
