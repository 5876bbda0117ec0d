"""Registry, mapping and rule queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window, functions as F

from checks import check, read
from checks.versions import REG, registry
from ratetally.operators.rules import match_rule_table
from ratetally.operators import links, mappings as m, registry as reg, versions as v
from ratetally.operators.spread import shared_folder
from ratetally.sources import tables



def now():
    return F.expr("timestamp_ntz'2024-05-01 00:00:00'")


def stamp(name):
    return F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias(name)


NONE_TS = "cast(null as timestamp_ntz)"


def mappings(spark, sf) -> DataFrame:
    """One mapping per supplier."""
    k = F.col("s_suppkey")
    return read(spark, sf, "supplier").select(
        k.alias("mapping_id"), F.concat(F.lit("S"), (k % 5).cast("string")).alias("state_code"), F.concat(F.lit("key_"), (k % 37).cast("string")).alias("state_logical_schedule_key"),
        F.concat(F.lit("table_"), k.cast("string")).alias("dst_fsname"), F.concat(F.lit('{"Code": "CODE", "Old": "'), k.cast("string"), F.lit('"}')).alias("column_map_json"),
        stamp("created_at_utc"), F.when(k % 3 == 0, F.expr("timestamp_ntz'2024-02-01 00:00:00' + make_dt_interval(cast(s_suppkey as int)) ")).alias("updated_at_utc"), F.lit("me").alias("updated_by"),
    )


MAPS = """m AS (SELECT s_suppkey AS mapping_id, 'S' || (s_suppkey % 5) AS state_code, 'key_' || (s_suppkey % 37) AS k, 'table_' || s_suppkey AS t,
 coalesce(CASE WHEN s_suppkey % 3 = 0 THEN timestamp '2024-02-01' + to_days(cast(s_suppkey AS integer)) END, timestamp '2024-01-01') AS changed FROM supplier)"""


@check(f"WITH {MAPS} SELECT mapping_id FROM m QUALIFY row_number() OVER (PARTITION BY state_code, k ORDER BY changed DESC, mapping_id DESC) = 1")
def latest_mappings(spark, sf):
    return v.latest_mapping(mappings(spark, sf)).select("mapping_id")


@check(f"""WITH {MAPS}, q AS (SELECT c_custkey, 'S' || (c_custkey % 6) AS state_code, 'key_' || (c_custkey % 41) AS k, CASE WHEN c_custkey % 2 = 0 THEN 'table_' || (c_custkey % 200) ELSE '' END AS t FROM customer)
SELECT c_custkey, coalesce((SELECT max_by(mapping_id, (changed, mapping_id)) FROM m WHERE m.state_code = q.state_code AND m.k = q.k AND (q.t = '' OR m.t = q.t)), -1) AS mapping_id FROM q""")
def mapping_lookup(spark, sf):
    k = F.col("c_custkey")
    q = read(spark, sf, "customer").select(
        "c_custkey", F.concat(F.lit(" s"), (k % 6).cast("string")).alias("state_code"), F.concat(F.lit("key_"), (k % 41).cast("string")).alias("schedule_key"),
        F.when(k % 2 == 0, F.concat(F.lit("table_"), (k % 200).cast("string"))).otherwise("").alias("dst_fsname"),
    )
    return m.lookup_mapping(q, mappings(spark, sf)).select("c_custkey", F.coalesce("mapping_id", F.lit(-1)).alias("mapping_id"))


@check(f"WITH {MAPS} SELECT mapping_id, row_number() OVER (ORDER BY changed DESC, mapping_id DESC) AS place FROM m WHERE state_code = 'S2'")
def mapping_list(spark, sf):
    listed = reg.list_mappings(mappings(spark, sf), "s2")
    return listed.select("mapping_id", place_of(listed, F.coalesce("updated_at_utc", "created_at_utc").desc(), F.col("mapping_id").desc()))


INCOMING = """i AS (SELECT p_partkey AS row_no, upper('s' || (p_partkey % 5)) AS state_code, 'key_' || (p_partkey % 37) AS k, CASE WHEN p_partkey % 29 = 0 THEN '' ELSE 'table_' || (p_partkey % 900) END AS t,
 CASE WHEN p_partkey % 31 = 0 THEN 'bad' ELSE '{"Code": "' || p_partkey || '"}' END AS j FROM part),
good AS (SELECT * FROM i WHERE t <> '' AND j <> 'bad' QUALIFY row_number() OVER (PARTITION BY state_code, k, t ORDER BY row_no DESC) = 1)"""


def incoming(spark, sf):
    k = F.col("p_partkey")
    return read(spark, sf, "part").select(
        k.alias("row_no"), F.concat(F.lit("s"), (k % 5).cast("string")).alias("state_code"), F.concat(F.lit("key_"), (k % 37).cast("string")).alias("state_logical_schedule_key"),
        F.when(k % 29 == 0, " ").otherwise(F.concat(F.lit("table_"), (k % 900).cast("string"))).alias("dst_fsname"),
        F.when(k % 31 == 0, "bad").otherwise(F.concat(F.lit('{"Code": "'), k.cast("string"), F.lit('"}'))).alias("column_map_json"), F.lit("you").alias("updated_by"),
    )


@check(f"""WITH {MAPS}, {INCOMING} SELECT coalesce(m.mapping_id, (SELECT max(mapping_id) FROM m) + row_number() OVER (PARTITION BY m.mapping_id IS NULL ORDER BY good.row_no)) AS mapping_id, coalesce(m.t, good.t) AS dst_fsname,
 coalesce(good.j, '{{"Code": "CODE", "Old": "' || m.mapping_id || '"}}') AS column_map_json, CASE WHEN good.t IS NULL THEN 'me' ELSE 'you' END AS updated_by
 FROM m FULL OUTER JOIN good ON good.state_code = m.state_code AND good.k = m.k AND good.t = m.t""")
def upserted_mappings(spark, sf):
    nxt, _ = reg.upsert_mappings(mappings(spark, sf), incoming(spark, sf), now())
    return nxt.select("mapping_id", "dst_fsname", "column_map_json", "updated_by")


@check(f"WITH {INCOMING} SELECT row_no FROM i WHERE t = '' OR j = 'bad'")
def rejected_mappings(spark, sf):
    return reg.upsert_mappings(mappings(spark, sf), incoming(spark, sf), now())[1].select("row_no")


STATES = ["AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ"]


def nation_state(key):
    return F.element_at(F.array(*[F.lit(s) for s in STATES]), (key % 30 + 1).cast("int"))


def sql_state(key):
    return f"(ARRAY{STATES})[cast({key} % 30 + 1 AS integer)]".replace("ARRAY", "")


def portals(spark, sf):
    n = read(spark, sf, "nation")
    k = F.col("n_nationkey").cast("long")
    return n.select((k + 1).alias("link_id"), nation_state(k).alias("state_code"), F.col("n_name").alias("display_label"), F.concat(F.lit("http://old/"), k.cast("string")).alias("portal_url"),
                    F.lit(0).alias("sort_order"), stamp("created_at_utc"), F.expr(NONE_TS).alias("updated_at_utc"), F.expr(NONE_TS).alias("last_agent_run_at_utc"))


PORTALS = f"p AS (SELECT n_nationkey + 1 AS link_id, {sql_state('n_nationkey')} AS state_code, n_name AS display_label, 'http://old/' || n_nationkey AS portal_url FROM nation)"
NEWP = f"""n AS (SELECT s_suppkey AS row_no, {sql_state('s_suppkey')} AS state_code, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE s_name END AS display_label, 'http://new/' || s_suppkey AS portal_url FROM supplier WHERE s_suppkey % 9 <> 0),
l AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY state_code ORDER BY row_no DESC) = 1)"""


@check(f"""WITH {PORTALS}, {NEWP} SELECT cast(coalesce(p.link_id, (SELECT max(link_id) FROM p) + row_number() OVER (PARTITION BY p.link_id IS NULL ORDER BY l.row_no)) AS bigint) AS link_id, coalesce(p.state_code, l.state_code) AS state_code,
 coalesce(nullif(l.display_label, ''), l.portal_url, p.display_label) AS display_label, coalesce(l.portal_url, p.portal_url) AS portal_url FROM p FULL OUTER JOIN l ON p.state_code = l.state_code""")
def upserted_portals(spark, sf):
    s = read(spark, sf, "supplier")
    k = F.col("s_suppkey")
    new = s.select(k.alias("row_no"), F.when(k % 9 == 0, "Atlantis").otherwise(F.lower(nation_state(k))).alias("state_code"), F.when(k % 2 == 0, " ").otherwise(F.col("s_name")).alias("display_label"),
                   F.concat(F.lit(" http://new/"), k.cast("string")).alias("portal_url"), F.lit(1).alias("sort_order"))
    nxt, _ = reg.upsert_portals(portals(spark, sf), new, now())
    return nxt.select("link_id", "state_code", "display_label", "portal_url")


PATCHES = """a AS (SELECT s_suppkey AS row_no, s_suppkey * 6 % 40 + 1 AS link_id, CASE WHEN s_suppkey % 3 = 0 THEN s_name END AS label, CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey END AS sort FROM supplier)"""


def portal_patches(spark, sf):
    k = F.col("s_suppkey")
    return read(spark, sf, "supplier").select(
        k.alias("row_no"), (k * 6 % 40 + 1).alias("link_id"), F.when(k % 3 == 0, F.concat(F.lit(" "), "s_name", F.lit(" "))).alias("display_label"),
        F.lit(None).cast("string").alias("portal_url"), F.when(k % 5 == 0, k).alias("sort_order"),
    )


@check(f"""WITH {PORTALS}, {PATCHES}, g AS (SELECT link_id, arg_max(label, row_no) AS label, arg_max(sort, row_no) AS sort FROM a GROUP BY link_id)
SELECT cast(p.link_id AS bigint) AS link_id, coalesce(g.label, p.display_label) AS display_label, cast(coalesce(g.sort, 0) AS bigint) AS sort_order,
 CASE WHEN coalesce(g.label, cast(g.sort AS varchar)) IS NOT NULL THEN 1 ELSE 0 END AS touched, CASE WHEN state_code IN ('AL', 'CA', 'IA') THEN 1 ELSE 0 END AS ran FROM p LEFT JOIN g ON p.link_id = g.link_id""")
def patched_and_touched_portals(spark, sf):
    p = portals(spark, sf)
    patched, _ = reg.patch_portals(p, portal_patches(spark, sf), now())
    states = read(spark, sf, "nation").where("n_nationkey IN (0, 4, 14)").select(F.lower(nation_state(F.col("n_nationkey"))).alias("state_code"))
    ran = reg.touch_portals(p, states, now()).select("link_id", F.col("last_agent_run_at_utc").isNotNull().cast("int").alias("ran"))
    patched = patched.select("link_id", "display_label", F.col("sort_order").cast("bigint").alias("sort_order"), F.col("updated_at_utc").isNotNull().cast("int").alias("touched"))
    return patched.join(ran, "link_id").select("link_id", "display_label", "sort_order", "touched", "ran")


@check(f"WITH {PORTALS}, {PATCHES} SELECT row_no FROM a WHERE link_id NOT IN (SELECT link_id FROM p)")
def rejected_portal_patches(spark, sf):
    return reg.patch_portals(portals(spark, sf), portal_patches(spark, sf), now())[1].select("row_no")


def contacts(spark, sf, which="c_custkey % 2 = 0"):
    k = F.col("c_custkey")
    flags = [F.lit(True).alias(f) for f in ("notifications_enabled", "notify_new_state_file", "notify_compare_result")]
    return read(spark, sf, "customer").where(which).select(
        k.alias("notification_contact_id"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("state_code"), F.col("c_name").alias("contact_name"),
        F.concat(F.lower("c_name"), F.lit("@x.org")).alias("email"), F.lit(None).cast("string").alias("team_name"), F.col("c_mktsegment").alias("department_name"), *flags,
        stamp("created_at_utc"), F.expr(NONE_TS).alias("updated_at_utc"),
    )


# A batch with repeated updates, updates of unknown contacts, and addresses that an update gives up.
NEWC = """i AS (SELECT c_custkey AS row_no, 'N' || c_nationkey AS state_code, CASE WHEN c_custkey % 10 = 7 THEN '' ELSE 'New ' || c_custkey END AS contact_name,
  CASE WHEN c_custkey % 10 = 9 THEN 'none' ELSE lower(c_name) || '@x.org' END AS email, CASE WHEN c_custkey % 8 = 0 THEN c_custkey END AS id FROM customer WHERE c_custkey % 4 <> 1 UNION ALL
 SELECT 1000000000 + c_custkey, 'N' || c_nationkey, 'Again ' || c_custkey, lower(c_name) || '@x.org', c_custkey FROM customer WHERE c_custkey % 16 = 0 UNION ALL
 SELECT 2000000000 + c_custkey, 'N' || c_nationkey, 'Lost ' || c_custkey, 'lost' || c_custkey || '@x.org', c_custkey + 500000000 FROM customer WHERE c_custkey % 12 = 3 UNION ALL
 SELECT 3000000000 + c_custkey, 'N' || c_nationkey, 'Moved ' || c_custkey, 'moved' || c_custkey || '@x.org', c_custkey FROM customer WHERE c_custkey % 20 = 10 UNION ALL
 SELECT 4000000000 + c_custkey, 'N' || c_nationkey, 'Heir ' || c_custkey, lower(c_name) || '@x.org', NULL FROM customer WHERE c_custkey % 20 = 10),
cur AS (SELECT c_custkey AS id, 'N' || c_nationkey AS state_code, c_name AS contact_name, lower(c_name) || '@x.org' AS email FROM customer WHERE c_custkey % 2 = 0),
ok AS (SELECT * FROM i WHERE contact_name <> '' AND email <> 'none'),
upd AS (SELECT ok.* FROM ok JOIN cur USING (id, state_code) QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_no DESC) = 1),
after AS (SELECT cur.id, cur.state_code, coalesce(u.contact_name, cur.contact_name) AS contact_name, coalesce(u.email, cur.email) AS email FROM cur LEFT JOIN upd u ON u.id = cur.id),
ins AS (SELECT * FROM ok WHERE id IS NULL AND (state_code, email) NOT IN (SELECT (state_code, email) FROM after) QUALIFY row_number() OVER (PARTITION BY state_code, email ORDER BY row_no) = 1)"""


def new_contacts(spark, sf):
    k, name, state = F.col("c_custkey"), F.col("c_name"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    c = read(spark, sf, "customer")
    own = F.concat(name, F.lit("@X.org "))

    def rows(which, first, label, email, contact):
        return c.where(which).select(
            (k + F.lit(first).cast("long")).alias("row_no"), state.alias("state_code"), label.alias("contact_name"), email.alias("email"), F.lit("t").alias("team_name"), F.lit("d").alias("department_name"),
            *[F.lit(None).cast("boolean").alias(f) for f in ("notifications_enabled", "notify_new_state_file", "notify_compare_result")], contact.cast("long").alias("notification_contact_id"),
        )

    said = lambda word: F.concat(F.lit(word + " "), k.cast("string"))
    at = lambda word: F.concat(F.lit(word), k.cast("string"), F.lit("@x.org"))
    base = rows("c_custkey % 4 <> 1", 0, F.when(k % 10 == 7, " ").otherwise(said("New")), F.when(k % 10 == 9, "none").otherwise(own), F.when(k % 8 == 0, k))
    more = [
        rows("c_custkey % 16 = 0", 1_000_000_000, said("Again"), own, k), rows("c_custkey % 12 = 3", 2_000_000_000, said("Lost"), at("lost"), k + 500_000_000),
        rows("c_custkey % 20 = 10", 3_000_000_000, said("Moved"), at("moved"), k), rows("c_custkey % 20 = 10", 4_000_000_000, said("Heir"), own, F.lit(None)),
    ]
    for m in more:
        base = base.unionByName(m)
    return base


@check(f"""WITH {NEWC} SELECT id AS contact_id, contact_name, email FROM after UNION ALL
SELECT (SELECT max(id) FROM cur) + row_number() OVER (ORDER BY row_no), contact_name, email FROM ins""")
def upserted_contacts(spark, sf):
    nxt, _ = reg.upsert_contacts(contacts(spark, sf), new_contacts(spark, sf), now())
    return nxt.select(F.col("notification_contact_id").alias("contact_id"), "contact_name", "email")


@check(f"WITH {NEWC} SELECT row_no FROM i WHERE row_no NOT IN (SELECT row_no FROM upd UNION ALL SELECT row_no FROM ins)")
def rejected_contacts(spark, sf):
    return reg.upsert_contacts(contacts(spark, sf), new_contacts(spark, sf), now())[1].select("row_no")


@check("""SELECT c_custkey AS contact_id, row_number() OVER (ORDER BY c_mktsegment, c_name, c_custkey) AS place FROM customer WHERE c_nationkey = 2""")
def contact_list(spark, sf):
    listed = reg.list_contacts(contacts(spark, sf, "true"), "n2")
    return listed.select(F.col("notification_contact_id").alias("contact_id"), place_of(listed, "department_name", "team_name", "contact_name", "notification_contact_id"))


def place_of(listed, *order):
    """Place of a row in a listing, by the keys the listing is sorted by."""
    return F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("place")


@check("SELECT c_custkey AS contact_id FROM customer WHERE NOT (c_custkey % 6 = 0 AND c_nationkey <> 3)")
def deleted_rows(spark, sf):
    c = contacts(spark, sf, "true")
    victims = c.where("notification_contact_id % 6 = 0").select("notification_contact_id", F.when(F.col("state_code") == "N3", "other").otherwise(F.col("state_code")).alias("state_code"))
    return reg.delete_rows(c, victims, ["notification_contact_id", "state_code"]).select(F.col("notification_contact_id").alias("contact_id"))


BULK_ROWS = """b AS (SELECT l_orderkey * 100 + l_linenumber AS k0, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) + 1 AS row_no, l_orderkey % 60 AS g, l_partkey % 12 AS col, l_suppkey % 20 AS dst,
 CASE WHEN l_linenumber = 2 THEN 'Merge' WHEN l_linenumber = 3 THEN '' ELSE 'replace' END AS action FROM lineitem)"""


def bulk_rows(spark, sf):
    """Long mapping rows from the order lines, numbered like the lines of a file."""
    li = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    from ratetally.operators.spread import dense_ids

    li = dense_ids(li, "row_no", F.lit(1), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"])
    g = F.col("l_orderkey") % 60
    return li.select(
        "row_no",
        F.when(g < 20, F.concat(F.lit("  LABEL "), g.cast("string"))).when(g < 30, "").when(g < 40, "Nothing").otherwise("Shared").alias("state_schedule"),
        F.when((g >= 20) & (g < 30), g.cast("string")).otherwise("").alias("artifact_id"),
        F.when(g == 59, "").otherwise(F.concat(F.lit("dst_"), (g % 7).cast("string"))).alias("dst_schedule"),
        F.concat(F.lit("Col "), (F.col("l_partkey") % 12).cast("string")).alias("state_column"), F.concat(F.lit("D"), (F.col("l_suppkey") % 20).cast("string")).alias("dst_column"),
        F.when(F.col("l_linenumber") == 2, "Merge").when(F.col("l_linenumber") == 3, "").otherwise("replace").alias("action"),
    )


def bulk_artifacts(spark, sf):
    k = F.col("c_custkey")
    base = registry(spark, sf)
    a = read(spark, sf, "customer").select(
        k.alias("artifact_id"), F.lit("NY").alias("state_code"), F.concat(F.lit("key_"), k.cast("string")).alias("logical_schedule_key"),
        F.when(k < 20, F.concat(F.lit("Label "), k.cast("string"))).when(k >= 30, "Shared").alias("source_label"),
    )
    have = set(a.columns)
    return a.select(*[F.col(c) if c in have else F.lit(None).cast(base.schema[c].dataType).alias(c) for c in base.columns])


def saved_mappings(spark, sf):
    k = F.col("c_custkey")
    return read(spark, sf, "customer").select(
        (k + 1).alias("mapping_id"), F.lit("NY").alias("state_code"), F.concat(F.lit("key_"), k.cast("string")).alias("state_logical_schedule_key"),
        F.concat(F.lit("dst_"), (k % 7).cast("string")).alias("dst_fsname"), F.lit('{"Saved": "S1", "Col 0": "S2"}').alias("column_map_json"),
        stamp("created_at_utc"), F.expr(NONE_TS).alias("updated_at_utc"), F.lit("me").alias("updated_by"),
    )


BULK = f"""{BULK_ROWS}, r AS (SELECT *, CASE WHEN g < 20 THEN 'label ' || g WHEN g < 30 THEN 'aid:' || g WHEN g < 40 THEN 'nothing' ELSE 'shared' END AS gk, 'dst_' || (g % 7) AS d FROM b WHERE g <> 59),
grp AS (SELECT gk, d, max_by(CASE WHEN action LIKE 'Merg%' THEN 'merge' ELSE 'replace' END, row_no) AS action, min(row_no) AS first_row, min(g) AS g FROM r GROUP BY gk, d),
prs AS (SELECT gk, d, col, max_by(dst, row_no) AS dst FROM r GROUP BY gk, d, col),
ok AS (SELECT grp.*, g AS id FROM grp WHERE g < 30),
cnt AS (SELECT ok.gk, ok.d, count(*) + CASE WHEN any_value(ok.action) = 'merge' THEN 1 + (1 - max((col = 0)::int)) ELSE 0 END AS pairs FROM ok JOIN prs USING (gk, d) GROUP BY ok.gk, ok.d)"""


@check(f"WITH {BULK} SELECT id AS artifact_id, d AS dst_fsname, 'key_' || id AS logical_schedule_key, cast(pairs AS bigint) AS pairs, action FROM ok JOIN cnt USING (gk, d)")
def bulk_import_applied(spark, sf):
    out = m.bulk_import(bulk_rows(spark, sf), bulk_artifacts(spark, sf), saved_mappings(spark, sf), "ny", now(), dry_run=True)
    return out.applied.select("artifact_id", "dst_fsname", "logical_schedule_key", "pairs", "action")


@check(f"""WITH {BULK} SELECT row_no, 'DstSchedule, StateColumn, and DstColumn are required.' AS message FROM b WHERE g = 59 UNION ALL
SELECT first_row, 'No saved file matches StateSchedule Nothing for NY.' FROM grp WHERE gk = 'nothing' UNION ALL
SELECT first_row, 'Multiple artifacts match Shared: ids 30, 31, 32, 33, 34, 35, 36, 37, 38, 39, 40, 41…. Set ArtifactId column to disambiguate.' FROM grp WHERE gk = 'shared'""")
def bulk_import_errors(spark, sf):
    return m.bulk_import(bulk_rows(spark, sf), bulk_artifacts(spark, sf), saved_mappings(spark, sf), "ny", now()).errors


@check(f"""WITH {BULK} SELECT row_no, 'Duplicate StateColumn Col ' || col || ': overwriting D' || was || ' → D' || dst AS message FROM (
  SELECT *, lag(dst) OVER (PARTITION BY gk, d, col ORDER BY row_no) AS was FROM r) WHERE was <> dst""")
def bulk_import_warnings(spark, sf):
    return m.bulk_import(bulk_rows(spark, sf), bulk_artifacts(spark, sf), saved_mappings(spark, sf), "ny", now()).warnings


@check("""SELECT s_suppkey % 20 AS artifact_id, 'dst_' || (s_suppkey % 20 % 7) AS dst_fsname, count(DISTINCT s_suppkey % 120 // 20) AS pairs FROM supplier GROUP BY ALL""")
def bulk_import_of_a_file(spark, sf):
    """A written file with headers of other spellings and cells over two lines, read and imported."""
    out = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    k = F.col("s_suppkey")
    line = F.concat(F.lit('"Label '), (k % 20).cast("string"), F.lit('",,dst_'), (k % 20 % 7).cast("string"), F.lit(',"Col\n'), F.expr("s_suppkey % 120 DIV 20").cast("string"), F.lit('",D'), k.cast("string"))
    rows = read(spark, sf, "supplier").select((k + 1).alias("at"), line.alias("value"))
    head = spark.createDataFrame([(-1, "State Fee Schedule,Artifact-ID,DST Table,STATE COL,dst column")], "at long, value string")
    rows.unionByName(head).coalesce(1).sortWithinPartitions("at").select("value").write.text(out)
    found = m.bulk_import(m.read_mapping_file(spark, out), bulk_artifacts(spark, sf), saved_mappings(spark, sf), "ny", now())
    return found.applied.select("artifact_id", "dst_fsname", "pairs")


@check(f"""WITH {BULK} SELECT 'key_' || id AS schedule_key, d AS dst_fsname, cast(pairs AS integer) AS paired, 'D' || coalesce(z.dst::varchar, '') AS col_1 FROM ok JOIN cnt USING (gk, d) LEFT JOIN prs z ON z.gk = ok.gk AND z.d = ok.d AND z.col = 1""")
def bulk_import_saved(spark, sf):
    out = m.bulk_import(bulk_rows(spark, sf), bulk_artifacts(spark, sf), saved_mappings(spark, sf), "ny", now(), updated_by="loader")
    from ratetally.functions.jsontext import paired_count, parse_column_map

    mine = out.mappings.where("updated_by = 'loader'").withColumn("m", parse_column_map(F.col("column_map_json")))
    return mine.select(F.col("state_logical_schedule_key").alias("schedule_key"), "dst_fsname", paired_count(F.col("m")).alias("paired"), F.coalesce(F.element_at("m", F.lit("Col 1")), F.lit("D")).alias("col_1"))


@check(f"""WITH {REG}, lab AS (SELECT artifact_id, unnest([lower(coalesce(source_label, nullif(trim(logical_schedule_key), ''), 'f ' || artifact_id)), lower(trim(logical_schedule_key)), 'f_' || artifact_id, 'artifact:' || artifact_id, '' || artifact_id]) AS label FROM g),
 d AS (SELECT DISTINCT artifact_id, label FROM lab WHERE label <> ''), n AS (SELECT label, count(*) AS n, min(artifact_id) AS id FROM d GROUP BY label),
 q AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'label ' || o_orderkey WHEN 1 THEN 'artifact:' || o_orderkey WHEN 2 THEN lower(o_orderpriority) ELSE 'f_' || o_orderkey END AS label FROM orders)
SELECT k, coalesce(n, 0) AS matches, CASE WHEN n = 1 THEN id ELSE -1 END AS artifact_id, CASE WHEN n IS NULL THEN 'unknown' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS resolution FROM q LEFT JOIN n USING (label)""")
def resolved_labels(spark, sf):
    k = F.col("o_orderkey")
    lab = F.when(k % 4 == 0, F.concat(F.lit(" LABEL  "), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit("artifact:"), k.cast("string"))).when(k % 4 == 2, F.col("o_orderpriority")).otherwise(F.concat(F.lit("f_"), k.cast("string")))
    q = read(spark, sf, "orders").select(k.alias("k"), lab.alias("label"))
    return m.resolve_labels(q, registry(spark, sf)).select("k", "matches", F.coalesce("artifact_id", F.lit(-1)).alias("artifact_id"), "resolution")


@check(f"""WITH {REG} SELECT s_suppkey AS mapping_id, 2 AS paired_column_count, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN a.artifact_id ELSE c.artifact_id END, -1) AS artifact_id,
 CASE WHEN s_suppkey % 2 = 0 THEN coalesce(a.source_label, nullif(trim(a.logical_schedule_key), ''), 'f ' || a.artifact_id, 'artifact:' || s_suppkey) ELSE coalesce(c.source_label, c.logical_schedule_key, '2-HIGH') END AS schedule_label
 FROM supplier LEFT JOIN g a ON a.artifact_id = s_suppkey LEFT JOIN c ON c.is_current AND c.state_code = 'BUILDING' AND c.logical_schedule_key = '2-HIGH'""")
def mapping_inventory(spark, sf):
    k = F.col("s_suppkey")
    maps = read(spark, sf, "supplier").select(
        k.alias("mapping_id"), F.lit("BUILDING").alias("state_code"), F.when(k % 2 == 0, F.concat(F.lit("artifact:"), k.cast("string"))).otherwise("2-HIGH").alias("state_logical_schedule_key"), F.lit("t").alias("dst_fsname"),
        F.lit('{"a": "b", "c": "d", "e": ""}').alias("column_map_json"), stamp("created_at_utc"), F.expr(NONE_TS).alias("updated_at_utc"), F.lit("me").alias("updated_by"),
    )
    return m.mapping_inventory(maps, registry(spark, sf)).select("mapping_id", "paired_column_count", F.coalesce("artifact_id", F.lit(-1)).alias("artifact_id"), "schedule_label")


@check("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'state_schedule' WHEN 1 THEN 'state_schedule' WHEN 2 THEN 'dst_column' WHEN 3 THEN 'action' ELSE '' END AS field FROM part""")
def canonical_headers(spark, sf):
    n = F.col("p_partkey") % 5
    h = F.when(n == 0, " State  Fee Schedule ").when(n == 1, "StateSchedule").when(n == 2, "dst_col").when(n == 3, "MODE").otherwise(F.col("p_name"))
    return read(spark, sf, "part").select("p_partkey", F.coalesce(m.canonical_header(h), F.lit("")).alias("field"))


@check(f"""WITH {REG} SELECT artifact_id, CASE WHEN trim(logical_schedule_key) = '' THEN 'artifact:' || artifact_id ELSE logical_schedule_key END AS k FROM g""")
def schedule_keys(spark, sf):
    return registry(spark, sf).select("artifact_id", v.schedule_key(F.col("logical_schedule_key"), F.col("artifact_id")).alias("k"))


@check("""SELECT l_orderkey, l_linenumber, l_quantity::bigint AS qty FROM lineitem WHERE l_returnflag = 'R'""")
def warehouse_scan(spark, sf):
    li = read(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "State_Code").withColumn("row_id", F.lit(1))
    out = tables.clean_table(li, " r ")
    return out.select(*[c for c in out.columns if c in ("l_orderkey", "l_linenumber", "row_id", "State_Code")], F.col("l_quantity").cast("bigint").alias("qty"))


@check("""SELECT 'customer' AS table_name WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = 7) UNION ALL SELECT 'supplier' WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = 7)""")
def tables_of_state(spark, sf):
    t = {"customer": read(spark, sf, "customer").withColumnRenamed("c_nationkey", "STATE_CODE"), "supplier": read(spark, sf, "supplier").withColumnRenamed("s_nationkey", "state_code"), "part": read(spark, sf, "part")}
    return tables.tables_with_rows(t, "state_code", "7")


@check("""SELECT page_id, array_to_string(list_filter([CASE WHEN lower(regexp_extract(url, '://([^/?#]*)', 1)) LIKE '%.example.com%' THEN 'host' END, CASE WHEN url LIKE '%/en/%' THEN 'path' END,
  CASE WHEN regexp_matches(url, '(?i)^https://M\\.') THEN 'pattern' END, CASE WHEN lower(regexp_extract(url, '://([^/?#]*)', 1)) LIKE '%net%' AND url LIKE '%/en/%' THEN 'both' END], lambda x: x IS NOT NULL), ',') AS rules FROM pages""")
def matched_rules(spark, sf):
    rules = [{"id": "host", "host_contains": ".Example.com"}, {"id": "path", "path_contains": "/en/"}, {"id": "pattern", "url_regex": r"^https://M\."}, {"id": "both", "host_contains": "net", "path_contains": "/en/"}]
    return links.match_rules(read(spark, sf, "pages"), "url", rules).select("page_id", F.array_join("rule_ids", ",").alias("rules"))


HOST = "lower(regexp_extract(url, '://([^/?#]*)', 1))"


@check(f"""WITH u AS (SELECT page_id, url, {HOST} AS host, lower(url) AS low FROM pages),
 r AS (SELECT 'h' || page_id AS id, page_id * 3 AS position, regexp_extract(host, '[^.]+\\.(.*)', 1) AS h, '' AS p, '' AS x FROM u WHERE page_id % 5 = 0
  UNION ALL SELECT 'p' || page_id, page_id * 3 + 1, '', regexp_extract(low, '/([a-z]+/[0-9]+)', 1), '' FROM u WHERE page_id % 3 = 0
  UNION ALL SELECT 'b' || page_id, page_id * 3 + 2, host, regexp_extract(low, '/([a-z]+/)', 1), '^https' FROM u WHERE page_id % 4 = 0)
 SELECT page_id, coalesce(string_agg(id, ',' ORDER BY position), '') AS rules FROM u LEFT JOIN r
 ON contains(host, h) AND contains(low, p) AND (x = '' OR regexp_matches(url, '(?i)' || x)) GROUP BY page_id""")
def matched_rules_of_a_table(spark, sf):
    """Rules taken from the pages themselves: parents of hosts, sections with numbers, and hosts with sections and a pattern."""
    p = read(spark, sf, "pages").select("page_id", "url")
    host, low = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)), F.lower("url")
    no = F.col("page_id")
    rule = lambda some, mark, place, h, path, x: p.where(some).select(
        F.concat(F.lit(mark), no.cast("string")).alias("rule_id"), (no * 3 + place).alias("position"), h.alias("host_contains"), path.alias("path_contains"), x.alias("url_regex"))
    none = F.lit(None).cast("string")
    rules = rule(no % 5 == 0, "h", 0, F.regexp_extract(host, r"[^.]+\.(.*)", 1), none, none)
    rules = rules.unionByName(rule(no % 3 == 0, "p", 1, F.lit(" "), F.upper(F.regexp_extract(low, "/([a-z]+/[0-9]+)", 1)), none))
    rules = rules.unionByName(rule(no % 4 == 0, "b", 2, host, F.regexp_extract(low, "/([a-z]+/)", 1), F.lit("^https")))
    return match_rule_table(p, "url", rules).select("page_id", F.array_join("rule_ids", ",").alias("rules"))
