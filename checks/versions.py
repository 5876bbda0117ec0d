"""Version registry queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from checks import check, read
from checks.urlcells import NORMAL
from ratetally.functions.text import artifact_title, natural_key
from ratetally.operators import registry as reg, versions as v
from ratetally.plans import ingest
from ratetally.streaming.fetches import best_version

EPOCH = "timestamp_ntz'2024-02-01 00:00:00'"


def registry(spark, sf) -> DataFrame:
    o = read(spark, sf, "orders").join(read(spark, sf, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    return o.select(
        k.alias("artifact_id"), F.substring("c_mktsegment", 1, 8).alias("state_code"),
        F.when(k % 50 == 0, " ").otherwise(F.col("o_orderpriority")).alias("logical_schedule_key"),
        F.concat(F.lit("http://files.example.com/a/"), (k % 500).cast("string"), F.lit(".pdf")).alias("source_url"),
        F.sha2((k % 900).cast("string"), 256).alias("content_sha256"), F.lit("x").alias("stored_rel_path"),
        F.concat(F.lit("f_"), k.cast("string"), F.lit(".pdf")).alias("original_filename"), F.lit("application/pdf").alias("mime_type"),
        k.alias("bytes_size"), F.expr("o_orderdate + interval 10 days").alias("fetched_at_utc"), F.lit(False).alias("is_current"),
        F.when(k % 3 == 0, F.concat(F.lit("Label "), k.cast("string"))).alias("source_label"),
        F.concat(F.lit("tag"), (k % 7).cast("string")).alias("remote_etag"), F.lit(None).cast("timestamp_ntz").alias("remote_last_modified_utc"),
        F.when(k % 4 != 0, F.to_date("o_orderdate")).alias("portal_effective_date"), F.lit("catalog").alias("effective_date_source"),
        (F.col("o_orderstatus") == "F").alias("is_superseded_hint"),
    )


REG = """g AS (SELECT o_orderkey AS artifact_id, substr(c_mktsegment, 1, 8) AS state_code, CASE WHEN o_orderkey % 50 = 0 THEN ' ' ELSE o_orderpriority END AS logical_schedule_key,
  'http://files.example.com/a/' || (o_orderkey % 500) || '.pdf' AS source_url, sha256(cast(o_orderkey % 900 AS varchar)) AS content_sha256,
  o_orderdate + INTERVAL 10 DAY AS fetched_at_utc, CASE WHEN o_orderkey % 3 = 0 THEN 'Label ' || o_orderkey END AS source_label, 'tag' || (o_orderkey % 7) AS remote_etag,
  CASE WHEN o_orderkey % 4 <> 0 THEN cast(o_orderdate AS date) END AS portal_effective_date, o_orderstatus = 'F' AS is_superseded_hint
  FROM orders JOIN customer ON o_custkey = c_custkey),
w AS (SELECT *, row_number() OVER (PARTITION BY state_code, logical_schedule_key ORDER BY is_superseded_hint, coalesce(portal_effective_date, cast(fetched_at_utc AS date)) DESC, artifact_id DESC) AS rn FROM g),
c AS (SELECT *, rn = 1 AND trim(logical_schedule_key) <> '' AS is_current FROM w)"""


@check(f"WITH {REG} SELECT artifact_id, is_current FROM c")
def current_flags(spark, sf):
    return v.mark_current(registry(spark, sf)).select("artifact_id", "is_current")


@check(f"WITH {REG} SELECT artifact_id, is_current AND state_code = 'BUILDING' AS is_current FROM c")
def current_flags_for_state(spark, sf):
    return v.mark_current_for(registry(spark, sf), "building").select("artifact_id", "is_current")


@check(f"WITH {REG} SELECT state_code, logical_schedule_key, artifact_id FROM c WHERE is_current")
def current_versions(spark, sf):
    return v.current_versions(registry(spark, sf)).select("state_code", "logical_schedule_key", "artifact_id")


@check(f"WITH {REG} SELECT state_code, logical_schedule_key, artifact_id FROM c WHERE is_current")
def current_versions_merged_from_parts(spark, sf):
    r = registry(spark, sf)
    halves = best_version(r.where("artifact_id % 2 = 0")).unionByName(best_version(r.where("artifact_id % 2 = 1")))
    best = halves.groupBy("state_code", "logical_schedule_key").agg(F.max("best").alias("best"))
    return best.select("state_code", "logical_schedule_key", "best.artifact_id")


@check("SELECT c_nationkey, min(c_custkey) AS c_custkey FROM customer GROUP BY c_nationkey")
def keep_lowest_id(spark, sf):
    return v.keep_first(read(spark, sf, "customer"), ["c_nationkey"], [F.col("c_custkey")]).select("c_nationkey", "c_custkey")


@check(f"""WITH {REG} SELECT artifact_id, row_number() OVER (ORDER BY state_code, logical_schedule_key, portal_effective_date DESC NULLS LAST, fetched_at_utc DESC, artifact_id DESC) AS place
 FROM c QUALIFY place <= 200""")
def version_listing(spark, sf):
    top = v.list_versions(registry(spark, sf), current_only=False, limit=200)
    return top.select("artifact_id", (F.monotonically_increasing_id() + 1).alias("place"))


@check(f"""WITH {REG} SELECT artifact_id, CASE WHEN trim(logical_schedule_key) = '' THEN '' ELSE '0001' || lower(logical_schedule_key) END AS k,
 strftime(coalesce(portal_effective_date::timestamp, fetched_at_utc), '%Y-%m-%d %H:%M:%S') AS edition FROM c""")
def version_history_order(spark, sf):
    h = v.version_history(registry(spark, sf))
    return h.select("artifact_id", natural_key(F.col("logical_schedule_key")).alias("k"), F.date_format("edition", "yyyy-MM-dd HH:mm:ss").alias("edition"))


HIST = "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS recency FROM events QUALIFY recency <= 35"


@check(f"SELECT event_id, user_id, cast(recency AS integer) AS recency FROM ({HIST})")
def recent_compares(spark, sf):
    return v.recent(read(spark, sf, "events"), "user_id", "ts", 35, tie=["event_id"]).select("event_id", "user_id", "recency")


@check("""SELECT doc_id, coalesce(k.m, -1) AS known_id FROM (SELECT doc_id, sha256(text) AS h, lang FROM documents WHERE doc_id % 3 = 0) n
LEFT JOIN (SELECT sha256(text) AS h, lang, max(doc_id) AS m FROM documents WHERE doc_id % 2 = 0 GROUP BY 1, 2) k USING (h, lang)""")
def known_content(spark, sf):
    d = read(spark, sf, "documents").select(
        F.col("doc_id").alias("artifact_id"), F.col("lang").alias("state_code"), F.lit("k").alias("logical_schedule_key"), F.sha2("text", 256).alias("content_sha256")
    )
    out = v.with_known_content(d.where("artifact_id % 3 = 0"), d.where("artifact_id % 2 = 0"))
    return out.select(F.col("artifact_id").alias("doc_id"), F.coalesce("known_artifact_id", F.lit(-1)).alias("known_id"))


@check("""SELECT lang, count(*) AS fresh FROM documents n WHERE doc_id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM documents k WHERE k.doc_id % 2 = 0 AND k.text = n.text AND k.lang = n.lang) GROUP BY lang""")
def skip_known_content(spark, sf):
    d = read(spark, sf, "documents").select(
        F.col("doc_id").alias("artifact_id"), F.col("lang").alias("state_code"), F.lit("k").alias("logical_schedule_key"), F.sha2("text", 256).alias("content_sha256"), "lang"
    )
    return v.skip_known(d.where("artifact_id % 3 = 0"), d.where("artifact_id % 2 = 0")).groupBy("lang").agg(F.count(F.lit(1)).alias("fresh"))


@check(f"""WITH {REG}, cur AS (SELECT * FROM c WHERE is_current)
SELECT o_orderkey AS id, coalesce(cur.remote_etag = 'tag' || (o_orderkey % 5), false) AS unchanged FROM orders JOIN customer ON o_custkey = c_custkey
 LEFT JOIN cur ON cur.state_code = substr(c_mktsegment, 1, 8) AND cur.logical_schedule_key = o_orderpriority""")
def unchanged_by_etag(spark, sf):
    r = registry(spark, sf)
    heads = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), F.substring("c_mktsegment", 1, 8).alias("state_code"), F.col("o_orderpriority").alias("logical_schedule_key"),
        F.concat(F.lit(" tag"), (F.col("o_orderkey") % 5).cast("string")).alias("remote_etag"),
    )
    return v.with_unchanged(heads, r).select("id", "unchanged")


@check(f"""WITH {REG} SELECT artifact_id, source_url FROM g UNION ALL
SELECT (SELECT max(artifact_id) FROM g) + row_number() OVER (ORDER BY p_partkey), 'http://new.example.com/' || p_partkey FROM part""")
def append_with_new_ids(spark, sf):
    new = read(spark, sf, "part").select(
        F.lit("ny").alias("state_code"), F.lit("k").alias("logical_schedule_key"), F.concat(F.lit("http://new.example.com/"), F.col("p_partkey").cast("string")).alias("source_url"),
        F.sha2("p_name", 256).alias("content_sha256"), F.col("p_partkey").alias("pos"),
    )
    return v.append_versions(registry(spark, sf), new, "pos").select("artifact_id", "source_url")


@check(f"""WITH {REG} SELECT count(*) AS n, count(DISTINCT artifact_id) AS ids, max(artifact_id) AS top FROM (SELECT artifact_id FROM g UNION ALL
SELECT (SELECT max(artifact_id) FROM g) + row_number() OVER () FROM part)""")
def append_without_order(spark, sf):
    new = read(spark, sf, "part").select(
        F.lit("ny").alias("state_code"), F.lit("k").alias("logical_schedule_key"), F.col("p_name").alias("source_url"), F.sha2(F.col("p_partkey").cast("string"), 256).alias("content_sha256")
    )
    out = v.append_versions(registry(spark, sf), new)
    return out.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("artifact_id").alias("ids"), F.max("artifact_id").alias("top"))


@check(f"""WITH {REG}, k AS (SELECT * EXCLUDE (rn, is_current) FROM c WHERE NOT is_current), w2 AS (SELECT *, row_number() OVER (PARTITION BY state_code, logical_schedule_key
 ORDER BY is_superseded_hint, coalesce(portal_effective_date, cast(fetched_at_utc AS date)) DESC, artifact_id DESC) AS rn FROM k)
SELECT artifact_id, rn = 1 AND trim(logical_schedule_key) <> '' AS is_current FROM w2""")
def remove_and_reelect(spark, sf):
    r = registry(spark, sf)
    return v.remove_versions(r, v.current_versions(r)).select("artifact_id", "is_current")


@check(f"""WITH {REG}, f AS (SELECT state_code, count(*) AS n FROM c WHERE is_current GROUP BY 1), h AS (SELECT upper(event_type) AS state_code, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1),
 p AS (SELECT DISTINCT state_code FROM g UNION SELECT DISTINCT upper(event_type) FROM events)
SELECT p.state_code, coalesce(f.n, 0) AS file_count, coalesce(h.n, 0) AS compare_count, coalesce('run ' || h.last, '') AS last_compare FROM p LEFT JOIN f USING (state_code) LEFT JOIN h USING (state_code)""")
def state_dashboard(spark, sf):
    r = v.mark_current(registry(spark, sf))
    e = read(spark, sf, "events")
    h = e.select(F.col("event_type").alias("state_code"), F.col("event_id").alias("at"), F.concat(F.lit("run "), F.col("event_id").cast("string")).alias("label"))
    p = r.select("state_code").distinct().union(e.select(F.upper("event_type")).distinct()).withColumn("last_agent_run_at_utc", F.expr(EPOCH))
    return v.state_dashboard(r, h, p).select("state_code", "file_count", "compare_count", F.coalesce("last_compare", F.lit("")).alias("last_compare"))


@check("""SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'current' ELSE 'history' END AS src FROM customer""")
def merge_current_and_history(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    cur = c.where("id % 2 = 0").withColumn("src", F.lit("current"))
    return v.merge_lists(cur, c.withColumn("src", F.lit("history")), "id")


def page_registry(spark, sf):
    p = read(spark, sf, "pages")
    return p.select(
        F.col("page_id").alias("artifact_id"), F.when(F.col("page_id") % 3 == 0, "NY").otherwise("GA").alias("state_code"), F.col("url").alias("source_url"), "page_id"
    )


def noisy(p):
    u = F.col("url")
    return F.when(F.col("page_id") % 4 == 0, F.concat(F.regexp_replace(u, "#.*$", ""), F.lit("#x"))).otherwise(F.concat(F.lit("  "), u, F.lit(" ")))


@check(f"""WITH u AS (SELECT page_id, {NORMAL} AS u FROM pages) SELECT page_id FROM u WHERE page_id % 3 = 0 OR u IN (SELECT u FROM u WHERE page_id % 2 = 0 AND page_id % 3 <> 0)""")
def prune_unpublished(spark, sf):
    p = read(spark, sf, "pages")
    pub = p.where("page_id % 2 = 0 AND page_id % 3 <> 0").select(F.lit("GA").alias("state_code"), noisy(p).alias("url"))
    return ingest.prune(page_registry(spark, sf), pub).select("page_id")


@check("SELECT page_id FROM pages")
def prune_with_nothing_published(spark, sf):
    p = read(spark, sf, "pages").where("page_id < 0")
    return ingest.prune(page_registry(spark, sf), p.select(F.lit("GA").alias("state_code"), "url")).select("page_id")


FETCHED = """f AS (SELECT p_partkey AS position, substr(p_type, 1, 8) AS state_code, 'http://files.example.com/a/' || (p_partkey % 400) || '.pdf' AS url, p_brand AS k,
  'c' || (p_partkey % 700) AS body, p_partkey % 23 = 0 AS bad FROM part)"""


def fetched(spark, sf):
    k = F.col("p_partkey")
    return read(spark, sf, "part").select(
        k.alias("position"), F.substring("p_type", 1, 8).alias("state_code"), F.concat(F.lit("http://files.example.com/a/"), (k % 400).cast("string"), F.lit(".pdf")).alias("url"),
        F.col("p_brand").alias("logical_schedule_key"), F.col("p_name").alias("source_label"), F.sha2(F.concat(F.lit("c"), (k % 700).cast("string")), 256).alias("content_sha256"),
        k.alias("bytes_size"), F.lit("application/pdf").alias("mime_type"), F.lit("2024-03-01").alias("portal_date"), F.lit("").alias("effective_date_source"),
        F.lit(False).alias("superseded_hint"), F.when(k % 23 == 0, "timeout").alias("error"),
    )


def part_registry(spark, sf):
    empty = registry(spark, sf)
    k = F.col("p_partkey")
    old = read(spark, sf, "part").where("p_partkey % 5 = 0").select(
        k.alias("artifact_id"), F.substring("p_type", 1, 8).alias("state_code"), F.col("p_brand").alias("logical_schedule_key"),
        F.concat(F.lit("http://files.example.com/a/"), (k % 500).cast("string"), F.lit(".pdf")).alias("source_url"), F.sha2(F.concat(F.lit("c"), (k % 700).cast("string")), 256).alias("content_sha256"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("fetched_at_utc"), F.lit(False).alias("is_superseded_hint"),
    )
    have = set(old.columns)
    return old.select(*[F.col(c) if c in have else F.lit(None).cast(empty.schema[c].dataType).alias(c) for c in empty.columns])


INGEST = f"""{FETCHED}, old AS (SELECT p_partkey AS id, substr(p_type, 1, 8) AS state_code, p_brand AS k, 'http://files.example.com/a/' || (p_partkey % 500) || '.pdf' AS url, 'c' || (p_partkey % 700) AS body FROM part WHERE p_partkey % 5 = 0),
fresh AS (SELECT *, row_number() OVER (PARTITION BY state_code, k, body ORDER BY position) AS rn FROM f WHERE NOT bad AND NOT EXISTS (SELECT 1 FROM old WHERE old.state_code = f.state_code AND old.k = f.k AND old.body = f.body)),
wr AS (SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY position) AS id, state_code, k, url, body, position, date '2024-03-01' AS day FROM fresh WHERE rn = 1),
grown AS (SELECT id, state_code, k, url, date '2024-01-01' AS day FROM old UNION ALL SELECT id, state_code, k, url, day FROM wr),
gone AS (SELECT * FROM grown WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.state_code = grown.state_code AND f.url = grown.url) AND state_code IN (SELECT state_code FROM f)),
kept AS (SELECT *, row_number() OVER (PARTITION BY state_code, k ORDER BY day DESC, id DESC) = 1 AS is_current FROM grown WHERE id NOT IN (SELECT id FROM gone))"""


@check(f"WITH {INGEST} SELECT id AS artifact_id, state_code, k AS logical_schedule_key, url AS source_url, is_current FROM kept")
def ingest_registry(spark, sf):
    run = ingest.ingest_run(part_registry(spark, sf), fetched(spark, sf), F.expr(EPOCH))
    return run.registry.select("artifact_id", "state_code", "logical_schedule_key", "source_url", "is_current")


@check(f"""WITH {INGEST} SELECT state_code, count(*) FILTER (o <> 'pruned') AS candidates, count(*) FILTER (o = 'written') AS written, count(*) FILTER (o = 'skipped') AS skipped,
 count(*) FILTER (o = 'error') AS errors, cast(0 AS bigint) AS truncated, count(*) FILTER (o = 'pruned') AS pruned FROM (
 SELECT state_code, CASE WHEN bad THEN 'error' WHEN position IN (SELECT position FROM wr) THEN 'written' ELSE 'skipped' END AS o FROM f UNION ALL SELECT state_code, 'pruned' FROM gone) GROUP BY state_code""")
def ingest_summary(spark, sf):
    return ingest.ingest_run(part_registry(spark, sf), fetched(spark, sf), F.expr(EPOCH)).summary


@check(f"""WITH {REG} SELECT artifact_id, CASE WHEN source_label IS NOT NULL THEN 'Label ' || artifact_id WHEN trim(logical_schedule_key) <> '' THEN
  (SELECT string_agg(CASE WHEN length(w) <= 2 THEN upper(w) ELSE upper(substr(w, 1, 1)) || lower(substr(w, 2)) END, '-') FROM (SELECT unnest(string_split(replace(logical_schedule_key, ' SPECIFIED', ''), '-')) AS w)) || CASE WHEN logical_schedule_key LIKE '% SPECIFIED' THEN ' Specified' ELSE '' END
  ELSE 'F ' || artifact_id END || CASE WHEN is_current THEN '' ELSE ' · prior' END AS title FROM c""")
def artifact_titles(spark, sf):
    r = v.mark_current(registry(spark, sf))
    return r.select("artifact_id", artifact_title(*[F.col(c) for c in ("artifact_id", "source_label", "logical_schedule_key", "original_filename", "is_current")]).alias("title"))
