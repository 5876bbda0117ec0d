"""Properties, skew handling, plans and fixtures for the operators."""

import random

import pytest
from pyspark.sql import functions as F

from ratetally.operators import contained, compare as c, frontier, grids, jsoncols, links, registry as reg, rules, spread, versions as v
from ratetally.plans.compare_run import compare_run

MAP = {"Code": "CODE", "Rate": "FAC", "Mod": "MOD"}


def sides(frame, left, right):
    return frame(left, "Code string, Rate string, Mod string"), frame(right, "CODE string, FAC string, MOD string, n int")


def statuses(res):
    return sorted((r["status"], r["code"], r["modifier"]) for r in res.rows.collect())


def test_reconcile_with_itself_is_all_match(frame):
    left, right = sides(frame, [("A ", "1", ""), ("B", "2", "x"), (" ", "3", "")], [("A", "1.00", "", 1), ("B ", "2", "x", 2)])
    res = c.reconcile(left, right, MAP, right_order=["n"])
    assert statuses(res) == [("match", "A ", None), ("match", "B", None)]
    s = c.summarize(res).first()
    assert (s["join_mode"], s["left_row_count"], s["match_count"], s["mapped_field_count"]) == ("code", 3, 2, 3)


def test_reconcile_repeated_codes(frame):
    left, right = sides(frame, [("a", "1", "x"), ("a", "9", "x"), ("c", "1", None)], [("a", "1", "x", 2), ("A", "7", "X", 1), ("b", "5", "", 1), ("b", "6", "", 2)])
    res = c.reconcile(left, right, MAP, right_order=["n"])
    assert statuses(res) == [("left_only", "c", None), ("mismatch", "a", "x"), ("mismatch", "a", "x"), ("right_only", "b", "")]
    s = c.summarize(res).first()
    assert (s["join_mode"], s["matched_row_count"], s["right_only_row_count"], s["right_only_key_count"]) == ("code_and_modifier", 2, 2, 1)
    only = [r for r in res.rows.collect() if r["status"] == "left_only"][0]
    assert [d["same"] for d in only["diffs"]] == [False, False, True]


def test_reconcile_needs_a_modifier_for_repeats(frame):
    left, right = sides(frame, [("a", "1", ""), ("a", "2", "")], [("a", "1", "", 1)])
    with pytest.raises(ValueError, match="Map a left modifier"):
        c.reconcile(left, right, {"Code": "CODE", "Rate": "FAC"}, right_order=["n"])
    with pytest.raises(ValueError, match="must pair"):
        c.reconcile(left, right, {"Rate": "FAC"}, right_order=["n"])
    with pytest.raises(ValueError, match="no column"):
        c.reconcile(left, right, {"Nope": "CODE"}, right_order=["n"])
    with pytest.raises(ValueError, match="empty"):
        c.reconcile(left, right, "[]", right_order=["n"])


def brute_quotas(cap, m, s, d, method):
    t = m + s + d
    cap = min(cap, t)
    if t == 0:
        return [0, 0, 0]
    q = [m * cap // t, s * cap // t, d * cap // t]
    n = [m, s, d]
    if method == "residue_last":
        q[2] = min(d, cap - q[0] - q[1])
        order = [0, 1, 2]
    else:
        order = sorted(range(3), key=lambda i: (-(n[i] * cap % t), i))
    while sum(q) < cap:
        for i in order:
            if sum(q) < cap and q[i] < n[i]:
                q[i] += 1
    return q


@pytest.mark.parametrize("method", ["residue_last", "largest_remainder"])
def test_quotas_against_brute_force(frame, method):
    rnd = random.Random(7)
    for _ in range(12):
        n = [rnd.choice([0, 1, 2, 5, 17, 100]) for _ in range(4)]
        cap = rnd.choice([0, 1, 2, 3, 10, 50, 500])
        counts = frame(list(zip(["mismatch", "left_only", "right_only", "match"], n)), "status string, n_rows long")
        got = {r["status"]: r["quota"] for r in c.quotas(counts, cap, method).collect()}
        want = brute_quotas(cap, *n[:3], method)
        assert [got["mismatch"], got["left_only"], got["right_only"]] == want
        assert got["match"] == min(n[3], cap - sum(want))


def skewed(spark, n=6000):
    left = spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 997).cast("string")).alias("k"), F.col("id"))
    right = spark.range(900).select(F.col("id").cast("string").alias("k"), (F.col("id") * 2).alias("x")).unionByName(spark.sql("SELECT 'hot' AS k, 7L AS x"))
    return left, right


def test_lookup_join_with_heavy_keys_taken_out(spark):
    left, right = skewed(spark)
    left = left.withColumn("k", F.when(F.col("id") % 100 == 1, None).otherwise(F.col("k")))
    plain = left.join(right, "k", "left").select("k", "id", "x").collect()
    usual = spread.lookup_join(left, right, ["k"]).select("k", "id", "hit.x").collect()
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        split = spread.lookup_join(left, right, ["k"], least=50)
        assert {r["k"] for r in spread.heavy_keys(left.select("k"), ["k"], 50).collect()} == {"hot", None}
        split = split.select("k", "id", "hit.x").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.skewJoin.enabled")
    assert sorted(map(str, plain)) == sorted(map(str, split)) == sorted(map(str, usual))


def test_skewed_partition_is_split_at_run_time(spark):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, x in conf.items():
        spark.conf.set(k, x)
    try:
        left, right = skewed(spark, 60000)
        left = left.repartition(8)
        # The right side is an aggregate on the join key, as in a reconciliation.
        once = right.groupBy("k").agg(F.max("x").alias("x"))
        out = spread.lookup_join(left, once, ["k"])
        assert out.where("hit.x = 7").count() == 20000
        out.write.format("noop").mode("overwrite").save()
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=true" in plan and "skew=true" in plan
    finally:
        for k, x in old.items():
            spark.conf.unset(k) if x is None else spark.conf.set(k, x)


def test_reconcile_shuffles_each_side_once(frame):
    """First right rows, their number, the join and the right-only rows come from one exchange per side."""
    left, right = sides(frame, [("a", "1", "")], [("a", "1", "", 1)])
    spark = left.sparkSession
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = c.reconcile(left, right, MAP, right_order=["n"], mode="code").rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert plan.count("Exchange ") == 2 and "FullOuter" in plan and "Window" not in plan


def test_reconcile_spreads_left_rows_of_heavy_keys(frame, monkeypatch):
    left = [("a", str(i % 4), "") for i in range(400)] + [("b", "1", ""), ("d", "1", "")]
    right = [("a", "1", "", 2), ("a", "2", "", 1), ("b", "1", "", 1), ("c", "1", "", 1), ("c", "2", "", 2)]
    make = lambda: sides(lambda rows, schema: frame(rows, schema).repartition(8), left, right)
    once = statuses(c.reconcile(*make(), MAP, right_order=["n"], mode="code"))
    monkeypatch.setattr(c, "HEAVY_ROWS", 100)
    res = c.reconcile(*make(), MAP, right_order=["n"], mode="code")
    assert statuses(res) == once and "spark_partition_id" in res.rows._jdf.queryExecution().toString().lower()
    assert [s for s in once if s[1] == "c"] == [("right_only", "c", None)] and sum(s[0] == "match" and s[1] == "a" for s in once) == 100


def test_reconcile_plan_stays_in_the_jvm(frame):
    left, right = sides(frame, [("a", "1", "")], [("a", "1", "", 1)])
    plan = c.reconcile(left, right, MAP, right_order=["n"]).rows._jdf.queryExecution().executedPlan().toString()
    for bad in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan


def test_first_per_group_is_cut_down_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("x"))
    out = spread.first_per_group(df, ["k"], [F.col("x").desc()])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and out.count() == 7


def test_top_per_group_beyond_the_group_limit(spark):
    df = spark.range(20000).select(F.lit("one").alias("k"), F.col("id").alias("x"))
    out = spread.top_per_group(df, ["k"], [F.col("x").desc()], 3000, rank="r")
    assert out.count() == 3000 and out.agg(F.min("x"), F.max("r")).first() == (17000, 3000)


def test_previous_value_across_slices(spark):
    rows = [("a", i, str(i * i % 11)) for i in range(0, 400, 3)] + [(None, 5, "n"), (None, 250, "m")]
    df = spark.createDataFrame(rows, "k string, p long, v string")
    got = {(r["k"], r["p"]): r["was"] for r in spread.previous_value(df, ["k"], "p", "v", "was", rows_per_slice=7).collect()}
    last = {}
    for k, p, val in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        assert got[(k, p)] == last.get(k)
        last[k] = val
    assert len(got) == len(rows)


def test_dense_ids_are_consecutive(spark):
    df = spark.range(0, 5000, 3).withColumn("u", F.concat(F.lit("u"), F.col("id").cast("string")))
    got = [(r["id"], r["new"]) for r in spread.dense_ids(df, "new", F.lit(100), "id", ["u"]).orderBy("new").collect()]
    assert got == [(3 * i, 101 + i) for i in range(1667)]
    got = [r["new"] for r in spread.dense_ids(df, "new", F.lit(0), None, ["u"]).orderBy("new").collect()]
    assert got == list(range(1, 1668))


def test_mark_current_has_one_winner_per_key(spark, frame):
    rnd = random.Random(3)
    import datetime as dt

    rows = [
        (i, rnd.choice(["NY", "ny ", None]), rnd.choice(["k1", "k2", " "]), rnd.choice([None, dt.date(2024, 1, rnd.randint(1, 5))]), dt.datetime(2024, 1, rnd.randint(1, 9)), rnd.choice([True, False, None]))
        for i in range(200)
    ]
    r = frame(rows, "artifact_id long, state_code string, logical_schedule_key string, portal_effective_date date, fetched_at_utc timestamp_ntz, is_superseded_hint boolean")
    out = v.mark_current(r).collect()
    groups = {}
    for x in out:
        groups.setdefault(((x["state_code"] or "").strip().upper(), x["logical_schedule_key"].strip()), []).append(x)
    for (_, key), g in groups.items():
        won = [x for x in g if x["is_current"]]
        assert len(won) == (1 if key else 0)
        if won:
            best = max(g, key=lambda x: (not x["is_superseded_hint"], x["portal_effective_date"] or x["fetched_at_utc"].date(), x["artifact_id"]))
            assert won[0]["artifact_id"] == best["artifact_id"]


def test_all_superseded_versions_compete(frame):
    import datetime as dt

    r = frame([(1, "NY", "k", dt.date(2024, 1, 1), None, True), (2, "NY", "k", dt.date(2023, 1, 1), None, True)],
              "artifact_id long, state_code string, logical_schedule_key string, portal_effective_date date, fetched_at_utc timestamp_ntz, is_superseded_hint boolean")
    assert [x["artifact_id"] for x in v.mark_current(r).where("is_current").collect()] == [1]


def test_upsert_is_idempotent(frame, spark):
    cur = spark.createDataFrame([], "mapping_id long, state_code string, state_logical_schedule_key string, dst_fsname string, column_map_json string, created_at_utc timestamp_ntz, updated_at_utc timestamp_ntz, updated_by string")
    new = frame([(1, "ny", "k", "t", '{"a": "b"}', "me"), (2, "ny", "k2", "t", None, "me"), (3, "NY", "k", "t", '{"a": "c"}', "me")], "row_no long, state_code string, state_logical_schedule_key string, dst_fsname string, column_map_json string, updated_by string")
    now = F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    once, _ = reg.upsert_mappings(cur, new, now)
    once = spread.cut_lineage(once)
    assert sorted((r["mapping_id"], r["column_map_json"]) for r in once.collect()) == [(1, "{}"), (2, '{"a": "c"}')]
    twice, bad = reg.upsert_mappings(once, new, now)
    assert sorted(map(str, twice.collect())) == sorted(map(str, once.collect())) and bad.count() == 0


def test_expand_json_collisions(frame):
    df = frame([("1", "base", '{"A": {"FROM": "x"}, "code": "j"}'), ("2", "kept", "oops"), ("3", "base", '{"B": 2}')], "id string, code string, blob string")
    out = jsoncols.expand_json(df)
    assert out.columns == ["id", "A", "B", "code"]
    assert sorted(map(tuple, out.collect())) == [("1", "x", None, "j"), ("2", None, None, "kept"), ("3", None, "2", "base")]


def test_compare_run_through_a_saved_mapping(frame, spark):
    arts = frame([(7, "NY", "dental"), (8, "GA", None)], "artifact_id long, state_code string, logical_schedule_key string")
    maps = spark.sql("""SELECT 1L AS mapping_id, 'NY' AS state_code, 'dental' AS state_logical_schedule_key, 'fees' AS dst_fsname, '{"Proc": "CODE", "Price": "FAC"}' AS column_map_json,
        timestamp_ntz'2024-01-01 00:00:00' AS created_at_utc, cast(null AS timestamp_ntz) AS updated_at_utc""")
    house = frame([(1, "NY", '{"CODE": "70240", "FAC": {"FROM": "36.98"}}'), (2, "GA", '{"CODE": "1"}')], "row_id int, state_code string, blob string")
    pub = frame([("70240", "$36.979"), ("99999", "1")], "Proc string, Price string")
    res = compare_run(pub, house, arts, maps, state="ny", artifact_id=7, table="fees", right_order=["row_id"])
    assert statuses(res) == [("left_only", "99999", None), ("match", "70240", None)]
    for kw, msg in [({"artifact_id": 9}, "not found"), ({"artifact_id": 8}, "does not match"), ({"table": "other"}, "No column mapping"), ({"table": "a b"}, "Invalid table")]:
        with pytest.raises(ValueError, match=msg):
            compare_run(pub, house, arts, maps, **{"state": "ny", "artifact_id": 7, "table": "fees", "right_order": ["row_id"], **kw})


def grid_frame(frame, rows):
    return frame([("f", i, j, x) for i, row in enumerate(rows) for j, x in enumerate(row)], "file_id string, row_idx int, col_idx int, cell string")


def test_grid_without_data_rows_takes_the_widest_early_row(frame):
    cells = grid_frame(frame, [["a title that is long"], ["alpha beta", "gamma delta", "epsilon z"], ["words here", "more words", "and words"]])
    h = grids.detect_header(cells).first()
    assert (h["header_row"], h["header_score"]) == (1, None)


def test_grid_header_score(frame):
    cells = grid_frame(frame, [["Program"], ["Rate Code", "Service Name", "Amount"], ["", "", ""], ["12345", "some service", "10.50"], ["12346", "other service", "$1,200.00"], ["12347", "third service", "3.00"]])
    h = grids.detect_header(cells).first()
    assert h["header_row"] == 1 and h["header_score"] == pytest.approx(8 * 3 + 4 + 14)


def test_label_merge(frame):
    df = frame([("A", "b"), ("A", "a"), ("", "x"), ("y", ""), ("12", "13"), ("12345AB", "54321CD")], "p string, q string")
    assert [r[0] for r in df.select(grids.merge_labels(F.col("p"), F.col("q"))).collect()] == ["A · b", "A", "x", "y", "13", "54321CD"]


def test_link_rows_against_brute_force(frame):
    rnd = random.Random(11)
    words = ["dental", "fee", "rates", "clinic", "a", "2024", "home"]
    mk = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4)))
    a = [(i, f"fa{i}", rnd.choice(["t1", "t2", ""]), mk()) for i in range(60)]
    b = [(i, f"fa{i}" if i % 9 == 0 else f"fb{i}", rnd.choice(["t1", "t2"]), mk()) for i in range(60)]
    got = {(r["b_id"], r["a_id"], r["how"]) for r in links.link_rows(
        frame(a, "a_id long, fingerprint string, token string, title string"), frame(b, "b_id long, fingerprint string, token string, title string")).collect()}
    by_print = {f: i for i, f, _, _ in a}
    taken = {by_print[f] for _, f, _, _ in b if f in by_print}
    want = set()
    for i, f, tok, title in b:
        if f in by_print:
            want.add((i, by_print[f], "fingerprint"))
            continue
        pool = [(x, t) for x, _, k, t in a if x not in taken and k in (tok, "")]
        same = [x for x, t in pool if t == title]
        part = [x for x, t in pool if t in title or title in t]
        if len(same) == 1:
            want.add((i, same[0], "title"))
        elif not same and len(part) == 1:
            want.add((i, part[0], "contained"))
    assert got == want


def test_frontier_depth_and_budget(frame):
    e = frame([("a", 0, "b"), ("b", 0, "c"), ("c", 0, "d"), ("d", 0, "e"), ("a", 1, "a")], "src string, pos int, dst string")
    seed = frame([("a#x",)], "url string")
    got = lambda **k: {(r["url"], r["depth"]) for r in frontier.expand_frontier(e, seed, **k).collect()}
    assert got(depth=1) == {("a", 0)} and got(depth=9) == {("a", 0), ("b", 1), ("c", 2), ("d", 3), ("e", 4)} and got(depth=4, max_pages=2) == {("a", 0), ("b", 1)}


def test_frontier_rounds_store_what_they_add_and_end_by_themselves(frame, monkeypatch):
    stored = []

    def watched(df):
        out = spread.cut_lineage(df)
        stored.append(out.count())
        return out

    monkeypatch.setattr(frontier, "cut_lineage", watched)
    edges = frame([(f"p{i}", j, f"p{j}") for i in range(40) for j in (i // 2, 2 * i, 2 * i + 1) if j < 40], "src string, pos int, dst string")
    got = {r["url"]: r["depth"] for r in frontier.expand_frontier(edges, frame([("p1",)], "url string"), depth=50).collect()}
    want, now, d = {"p1": 0}, {1}, 0
    while now:
        d += 1
        now = {j for i in now for j in (i // 2, 2 * i, 2 * i + 1) if j < 40 and f"p{j}" not in want}
        want |= {f"p{j}": d for j in now}
    assert got == want and stored == [sum(v == n for v in want.values()) for n in range(len(stored))] and stored[-1] == 0 and len(stored) < 10


@pytest.mark.parametrize("how", ["sum", "last"])
def test_running_values_in_slices(frame, how):
    rnd = random.Random(4)
    rows = [(g, i, rnd.choice([None, 1, 5, -2])) for g in ("a", "b", None) for i in range(60) if rnd.random() < 0.8]
    for size in (1, 7, 1000):
        for before in (False, True):
            got = {(r["g"], r["p"]): r["x"] for r in spread.running(frame(rows, "g string, p int, v int"), ["g"], "p", "x", F.col("v"), how, before, size).collect()}
            want, state = {}, {}
            for g, i, v in rows:
                old = state.get(g, 0 if how == "sum" else None)
                state[g] = old + (v or 0) if how == "sum" else old if v is None else v
                want[g, i] = old if before else state[g]
            # A null key is a group of its own, but takes nothing on from slice to slice.
            if size < 1000:
                got, want = ({k: v for k, v in d.items() if k[0]} for d in (got, want))
            assert got == want


def test_a_page_of_very_many_elements_is_spread_over_tasks(spark):
    from ratetally.operators import pages
    from ratetally.sources import html

    n = 300_000
    i = F.col("id")
    head = i % 100_000 == 10
    facts = {
        "page_id": F.lit(1), "url": F.lit("https://h/p"), "pos": i.cast("int"), "kind": F.when(head, "heading").otherwise("text"), "tag": F.when(head, "h2").otherwise("p"),
        "text": F.when(head, F.concat(F.lit("head "), i)).otherwise(F.concat(F.lit("t"), i)), "tight": F.concat(F.lit("head "), i), "n_texts": F.lit(0), "in_footer": F.lit(False),
    }
    schema = html.page_elements(spark.createDataFrame([], "page_id int, url string, html string")).schema
    e = spark.range(n).select(*[facts.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
    got = {r["section_no"]: (r["title"], r["text_sample"]) for r in pages.page_sections(e).collect()}
    ends = [10, 100_010, 200_010, n]
    assert got == {k + 1: (f"head {a}", " ".join(f"t{j}" for j in range(a + 1, b))) for k, (a, b) in enumerate(zip(ends, ends[1:]))}
    parts = spread.running(e, ["page_id"], "pos", "x", F.lit(1), rows_per_slice=20_000).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < n


def test_presentation_orders(frame):
    import datetime as dt

    from ratetally.operators import pages

    t = frame([("b", 1, 0, None), ("a", 1, 0, None), ("c", 5, 0, "bad"), ("d", 5, 2, "bad"), ("e", 5, 0, None)], "block_id string, n_rows int, linked_rows int, error string")
    assert [r[0] for r in pages.order_tables(t).collect()] == ["d", "e", "c", "a", "b"]
    h = frame([(1, "k10", dt.date(2024, 1, 1), None), (2, "K2", dt.date(2024, 1, 1), None), (3, "k2", None, dt.datetime(2024, 2, 1)), (4, "k2", None, None)],
              "artifact_id int, logical_schedule_key string, portal_effective_date date, fetched_at_utc timestamp_ntz")
    assert [r["artifact_id"] for r in v.version_history(h).collect()] == [3, 2, 4, 1]


def test_copies_do_not_gather_in_one_slice(spark):
    df = spark.range(0, 20000, 1, 8).select(F.lit("one").alias("k"), F.lit(5).alias("x"))
    out = spread.top_per_group(df, ["k"], [F.col("x")], 2000, ways=8)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SPARK_PARTITION_ID" in plan and out.count() == 2000


def test_short_titles_on_both_sides_link_under_their_token_only(frame):
    a = [(i, f"fa{i}", f"t{i % 300}", "ab") for i in range(300)] + [(900, "fx", "", "zz")]
    b = [(i, f"fb{i}", f"t{i % 300}", f"x ab {i}") for i in range(3000)] + [(9000, "fy", "t1", "a zz")]
    out = links.link_rows(
        frame(a, "a_id long, fingerprint string, token string, title string"), frame(b, "b_id long, fingerprint string, token string, title string"))
    got = {(r["b_id"], r["a_id"]) for r in out.collect()}
    assert got == {(i, i % 300) for i in range(3000)} | {(9000, 900)}


def test_one_letter_titles_on_both_sides_stay_linear(frame, monkeypatch):
    """Every row enters each direction once where a token fits one index; cut into parts and blocks the result is the same."""
    rnd = random.Random(3)
    a = [(i, f"fa{i}", "t", rnd.choice(["a", "b", f"{rnd.choice('xyz')} a {i}", f"w{i} b"]) if i else "q") for i in range(400)]
    b = [(i, f"fb{i}", "t", rnd.choice(["x", "w", f"q {i}", f"q{rnd.choice('uv')}{i}", f"a {i}"])) for i in range(400)]
    schema = "_id long, fingerprint string, token string, title string"
    run = lambda: {(r["b_id"], r["a_id"], r["how"]) for r in links.link_rows(frame(a, "a" + schema), frame(b, "b" + schema)).collect()}
    pool = lambda t: [x for x, _, _, s in a if s in t or t in s]
    same = lambda t: [x for x, _, _, s in a if s == t]
    want = {(i, pool(t)[0], "contained") for i, _, _, t in b if not same(t) and len(pool(t)) == 1} | {(i, same(t)[0], "title") for i, _, _, t in b if len(same(t)) == 1}
    assert run() == want and any(how == "contained" for *_, how in want)
    known = frame([("t", t, 1, i, False) for t, i in {t: i for i, _, _, t in a}.items()], "scope string, title string, n long, a_id long, asks boolean")
    asked = frame([("t", t, None, None, True) for t in {t for *_, t in b}], known.schema)
    both = known.unionByName(asked)
    assert [contained.dealt(both, d).count() for d in (True, False)] == [both.count()] * 2
    monkeypatch.setattr(contained, "PATTERN_CHARS", 100)
    monkeypatch.setattr(contained, "TEXT_CHARS", 300)
    assert run() == want


def test_ten_thousand_rules_are_one_join(spark, frame):
    import re

    rnd = random.Random(8)
    words = [f"{rnd.choice('abcdefgh')}{i}" for i in range(400)]
    pages = [(i, f" HTTPS://{rnd.choice(words)}.{rnd.choice(words)}.org/{rnd.choice(words)}/{rnd.choice(words)}?q={rnd.choice(words)}") for i in range(300)] + [(900, None), (901, ""), (902, "no scheme a1.b2")]
    given = []
    for n in range(10_000):
        host = rnd.choice([None, "", f"{rnd.choice(words)}.", "org", "z"])
        path = rnd.choice([f"/{rnd.choice(words)}/{rnd.choice(words)}", f" {rnd.choice(words).upper()} ", rnd.choice(words), "ho" if not host else ""])
        given.append((f"r{n}", n, host, path or (None if host else "x"), rnd.choice([None, "", "", f"{rnd.choice(words)}$", "(broken", r"\\d+\\?q"])))
    given += [("only", 20_000, None, None, "^https://A"), ("bad", 20_001, None, None, "[")]
    schema = "rule_id string, position int, host_contains string, path_contains string, url_regex string"
    got = {r["id"]: r["rule_ids"] for r in rules.match_rule_table(frame(pages, "id int, url string"), "url", frame(given, schema)).collect()}

    def hits(u):
        u = (u or "").strip()
        host = (re.match(r"^[a-z]+://([^/?#]*)", u, re.I) or [None, ""])[1].lower()
        out = []
        for rid, _, h, p, x in given:
            try:
                fits = not x or re.search(x, u, re.I)
            except re.error:
                continue
            if u and fits and (h or "").strip().lower() in host and (p or "").strip().lower() in u.lower():
                out.append(rid)
        return out

    assert got == {i: hits(u) for i, u in pages} and any(got.values())
    with pytest.raises(ValueError, match="states nothing"):
        rules.match_rule_table(frame(pages, "id int, url string"), "url", frame([("e", 1, " ", None, "")], schema))
    assert all(r["rule_ids"] == [] for r in rules.match_rule_table(frame(pages, "id int, url string"), "url", frame([], schema)).collect())


def test_previous_values_and_ids_shuffle_their_rows_once(spark, frame):
    rows = [(None if k == 3 else k, i * 7 % 100, None if i % 9 == 0 else f"v{i}") for i in range(100) for k in range(4) if (i + k) % 3]
    df = frame(rows, "k int, pos long, v string")
    got = spread.previous_value(df, ["k"], "pos", "v", "was", rows_per_slice=10)
    want, last = {}, {}
    for k, at, v in sorted(rows, key=lambda r: r[1]):
        want[k, at] = (v, last.get(k))
        last[k] = v
    assert {(r["k"], r["pos"]): (r["v"], r["was"]) for r in got.collect()} == want and got.count() == len(rows)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    ids = spread.dense_ids(df, "id", F.lit(10), "pos", ["k"])
    assert [r["id"] for r in ids.orderBy("pos", "k").collect()] == list(range(11, 11 + len(rows)))
    plan = ids._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_equal_rules_are_compared_once_and_listed_once(spark, frame, monkeypatch):
    """Rules that many URLs meet: their ids do not pass a shuffle once per URL and rule."""
    pages = [(i, f"https://a{i % 3}.same.org/x/{i}") for i in range(300)] + [(900, None), (901, "https://other.net/x/7")]
    given = [(f"h{n}", 3 * n, "same.org", None, None) for n in range(200)] + [(f"x{n}", 3 * n + 1, None, "/x/7", None) for n in range(5)]
    given += [(f"p{n}", 3 * n + 2, " ", "", "NET/x") for n in range(70)] + [("a", 7, "a1.", "/x/", "^https"), ("a", 7, "a1.", "/x/", "^https")]
    schema = "rule_id string, position int, host_contains string, path_contains string, url_regex string"

    def want(u):
        fits = lambda h, p, x: (h or "").strip() in u.split("/")[2] and (p or "") in u and (not x or x.strip("^").lower() in u)
        return [r for r, _, h, p, x in sorted(given, key=lambda g: (g[1], g[0])) if u and fits(h, p, x)]

    seen = []
    monkeypatch.setattr(rules, "cut_lineage", lambda df, kept=rules.cut_lineage: seen.append(kept(df)) or seen[-1])
    got = rules.match_rule_table(frame(pages, "id int, url string"), "url", frame(given, schema))
    assert {r["id"]: r["rule_ids"] for r in got.collect()} == {i: want(u) for i, u in pages}
    # Four different rules; what is stored per URL holds the ids of rules with few equals only.
    assert seen[0].count() == 4 and max(len(r["_few"]) for r in seen[-1].collect()) == 7


def test_large_cap_makes_its_rows_once_and_joins_them_with_short_sides_only(spark):
    n = F.col("id")
    status = F.when(n % 2 == 0, "match").when(n % 3 == 0, "mismatch").when(n % 5 == 0, "left_only").otherwise("right_only")
    rows = spark.range(6000).select(status.alias("status"), (n * 7919 % 6000).alias("k"), F.array(F.struct(n.alias("x"))).alias("diffs"), F.lit(None).alias("nothing"))
    for some in (rows, rows.drop("nothing")):
        got = c.cap_result(some, 2000, ["k"])
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Range (" not in plan and "SortMergeJoin" not in plan
        seen = {}
        for r in got.collect():
            seen.setdefault(r["status"], []).append((r["rank_in_status"], r["k"], r["diffs"][0]["x"]))
        share = {r["status"]: r["quota"] for r in c.quotas(c.bucket_counts(rows), 2000).collect()}
        every = {}
        for r in rows.orderBy("k").collect():
            every.setdefault(r["status"], []).append((len(every.get(r["status"], [])) + 1, r["k"], r["diffs"][0]["x"]))
        assert {s: sorted(v) for s, v in seen.items()} == {s: v[: share[s]] for s, v in every.items() if share[s]}


def test_records_are_flattened_with_one_shuffle(spark, frame):
    import json

    from ratetally.operators import records

    def call(scope, no, rows, table="x_fee_schedule", fields="name,file,sys_id", url="https://h.example.com/api/now/sp/rectangle/1", **more):
        labels = {"name": "Title", "file": "Title"} if scope == "twice" else {"name": "Title", "file": "Link"}
        body = {"result": {"data": {"table": table, "title": "t", "fields": fields, "column_labels": labels, "row_count": "4", "list": rows}, **more}}
        return (scope, no, url, "POST", "{}", json.dumps(body, ensure_ascii=False))

    file = lambda v, **m: {"type": "file_attachment", "value": v, **m}
    rows = [
        {"sys_id": "a", "name": {"display_value": " A\u3000", "value": "x"}, "file": file(" f1 ", display_value="Sheet")}, "no object",
        {"sys_id": {"display_value": "b", "value": None}, "name": {"value": 1.5}, "file": file("")}, {"sys_id": " a", "name": "again"},
        {"name": "no id", "file": ' {"type": "FILE_attachment", "value": "f2"}'}, {"sys_id": " ", "name": "[{", "file": '[{"type": "file_attachment", "value": "f3"}]'},
    ]
    calls = [
        call("one", 1, [{"sys_id": "z"}], table="fee_codes"), call("one", 3, rows), call("one", 4, [{"sys_id": "late"}] * 6), call("two", 1, [{"sys_id": "c", "q": "v"}], fields="", template='src="/api/x/pubatt/dl/"'),
        call("twice", 1, [{"sys_id": "d", "name": "n", "file": "last"}]), call("none", 1, []), ("other", 1, "https://h.example.com/x", "GET", "", "{bad"),
        ("two", 2, "https://h.example.com/x", "GET", "", "{}"), ("twice", 9, "https://d.example.com/pubatt/dl/9", "GET", None, None),
    ]
    calls[2] = (*calls[2][:3], "GET", *calls[2][4:])
    out = records.flatten_records(frame(calls, "scope string, call_no int, url string, method string, payload string, data_sample string"), ["scope"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Window" not in plan
    got = {(r["scope"], r["row_no"]): (r["sys_id"], r["cells"], [(l["url"], l["text"]) for l in r["links"]], r["columns"], r["complete"]) for r in out.collect()}
    at, names = "https://h.example.com/api/now/attachment/", ["Title", "Link", "sys_id"]
    assert got == {
        ("one", 0): ("a", {"Title": "A", "Link": "Sheet", "sys_id": "a"}, [(at + "f1/file", "Sheet")], names, True),
        ("one", 2): ("b", {"Title": "1.5", "Link": "", "sys_id": "b"}, [], names, True),
        ("one", 4): ("", {"Title": "no id", "Link": '{"type": "FILE_attachment", "value": "f2"}', "sys_id": ""}, [(at + "f2/file", '{"type": "FILE_attachment", "value": "f2"}')], names, True),
        ("one", 5): ("", {"Title": "[{", "Link": '[{"type": "file_attachment", "value": "f3"}]', "sys_id": ""}, [], names, True),
        ("two", 0): ("c", {"sys_id": "c", "q": "v"}, [], ["sys_id", "q"], False),
        ("twice", 0): ("d", {"Title": "last", "sys_id": "d"}, [], ["Title", "Title", "sys_id"], False),
    }


def test_trimmed_takes_all_white_space(spark):
    from ratetally.functions.text import strip
    from ratetally.operators.records import trimmed

    around = F.concat(F.col("c"), F.lit("a b"), F.col("c"))
    chars = spark.createDataFrame([(chr(i),) for i in range(1, 0x3100)], "c string")
    assert chars.where(strip(around) != trimmed(around)).count() == 0
    assert [r[0] for r in spark.sql("SELECT explode(array(null, '', ' ', ' x ')) AS c").select(trimmed(F.col("c"))).collect()] == ["", "", "", "x"]
