"""Upserts and deletes of small registries. Each call returns the next snapshot of the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ratetally.functions.text import blank_to_null, norm_email, strip
from ratetally.operators.spread import attach, cut_lineage, dense_ids, first_per_group
from ratetally.operators.versions import state_key

# Two-letter codes and names accepted as a state (fixed values).
US_STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado",
    "CT": "Connecticut", "DE": "Delaware", "DC": "District of Columbia", "FL": "Florida", "GA": "Georgia",
    "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas",
    "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts",
    "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri", "MT": "Montana",
    "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico",
    "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma",
    "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota",
    "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington",
    "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming",
}


def name_key(c: Column) -> Column:
    """Letters only, upper case, one blank between words."""
    return F.trim(F.regexp_replace(F.upper(strip(c)), "[^A-Z]+", " "))


def resolve_state(df: DataFrame, column: str, states: DataFrame | None = None, name: str = "resolved_state") -> DataFrame:
    """Two-letter code for a code or a full name; null when unknown.

    ``states`` (code, name) is a dimension table; by default the fixed list of US states is looked up in place.
    """
    compact = F.regexp_replace(F.upper(strip(F.col(column))), r"[\s._-]+", "")
    if states is None:
        codes = F.create_map(*[F.lit(x) for c in US_STATES for x in (c, c)])
        names = F.create_map(*[F.lit(x) for c, n in US_STATES.items() for x in (n.upper(), c)])
        found = F.coalesce(F.element_at(codes, compact), F.element_at(names, name_key(F.col(column))))
        return df.withColumn(name, found)
    keys = states.select(F.upper(F.col("code")).alias("_k"), F.upper(F.col("code")).alias("_c"), F.lit(0).alias("_p")).unionByName(
        states.select(name_key(F.col("name")).alias("_k"), F.upper(F.col("code")).alias("_c"), F.lit(1).alias("_p"))
    )
    keys = keys.groupBy("_k").agg(F.min(F.struct("_p", "_c")).alias("_m")).select("_k", F.col("_m._c").alias("_c"))
    by_code = keys.select(F.col("_k").alias("_k1"), F.col("_c").alias("_c1"))
    tagged = df.withColumn("_k1", compact).withColumn("_k", name_key(F.col(column)))
    out = attach(attach(tagged, by_code, ["_k1"], "left"), keys, ["_k"], "left")
    return out.withColumn(name, F.coalesce("_c1", "_c")).drop("_k", "_k1", "_c", "_c1")


def last_per_key(incoming: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """The last row of every key by ``position``."""
    return first_per_group(incoming, keys, [F.col(position).desc()])


def _merge(current: DataFrame, incoming: DataFrame, keys, id_column, position, set_on_update, set_on_insert) -> DataFrame:
    """Full outer merge of two sides that are unique on ``keys``; ids of new rows follow ``position``."""
    keys = list(keys)
    new = incoming.select(
        *keys,
        F.struct(*[F.col(c) for c in incoming.columns if c not in keys]).alias("_new"),
    )
    old = current.select(*keys, F.struct(*[F.col(c) for c in current.columns if c not in keys]).alias("_old"))
    both = old.join(new, keys, "full_outer")
    kept = both.where("_old IS NOT NULL")
    cols = []
    for c in current.columns:
        if c in keys:
            cols.append(F.col(c))
        else:
            value = F.col(f"_old.{c}")
            if c in set_on_update:
                value = F.when(F.col("_new").isNotNull(), set_on_update[c]).otherwise(value)
            cols.append(value.cast(current.schema[c].dataType).alias(c))
    updated = kept.select(*cols)
    added = both.where("_old IS NULL").withColumn("_pos", F.col(f"_new.{position}"))
    top = F.coalesce(current.agg(F.max(id_column)).scalar(), F.lit(0))
    added = dense_ids(added, "_id", top, "_pos", keys)
    cols = []
    for c in current.columns:
        if c in keys:
            cols.append(F.col(c))
        elif c == id_column:
            cols.append(F.col("_id").cast(current.schema[c].dataType).alias(c))
        else:
            cols.append(set_on_insert.get(c, F.lit(None)).cast(current.schema[c].dataType).alias(c))
    return updated.unionByName(added.select(*cols))


def upsert_mappings(current: DataFrame, incoming: DataFrame, now: Column, position: str = "row_no") -> tuple[DataFrame, DataFrame]:
    """(next snapshot, rejected rows) of the column mappings.

    A mapping is unique on state, schedule key and target table; the last incoming row of a key counts.
    Rows without one of the three or with text that is not JSON are rejected.
    """
    keys = ["state_code", "state_logical_schedule_key", "dst_fsname"]
    map_text = F.coalesce(blank_to_null(F.col("column_map_json")), F.lit("{}"))
    clean = (
        incoming.withColumn("state_code", state_key(F.col("state_code")))
        .withColumn("state_logical_schedule_key", strip(F.col("state_logical_schedule_key")))
        .withColumn("dst_fsname", strip(F.col("dst_fsname")))
        .withColumn("column_map_json", map_text)
        .withColumn("updated_by", blank_to_null(F.col("updated_by")))
    )
    reason = F.when(
        (F.col("state_code") == "") | (F.col("state_logical_schedule_key") == "") | (F.col("dst_fsname") == ""),
        "state_code, state_logical_schedule_key and dst_fsname are required",
    ).when(F.try_parse_json(F.col("column_map_json")).isNull(), "column_map_json is not JSON")
    judged = clean.withColumn("reason", reason)
    good = last_per_key(judged.where("reason IS NULL").drop("reason"), keys, position)
    change = {"column_map_json": F.col("_new.column_map_json"), "updated_at_utc": now, "updated_by": F.col("_new.updated_by")}
    nxt = _merge(current, good, keys, "mapping_id", position, change, {**change, "created_at_utc": now})
    return nxt, judged.where("reason IS NOT NULL")


def upsert_portals(current: DataFrame, incoming: DataFrame, now: Column, position: str = "row_no") -> tuple[DataFrame, DataFrame]:
    """(next snapshot, rejected rows) of the portal list: one URL per state, the label defaults to the URL."""
    url = strip(F.col("portal_url"))
    label = F.coalesce(F.nullif(strip(F.col("display_label")), F.lit("")), url)
    clean = resolve_state(incoming, "state_code", name="_state").withColumn("display_label", label).withColumn("portal_url", url)
    reason = F.when(F.col("_state").isNull(), "state_code is unknown").when(F.col("portal_url") == "", "portal_url is required")
    judged = clean.withColumn("reason", reason)
    good = judged.where("reason IS NULL").withColumn("state_code", F.col("_state")).drop("reason", "_state")
    good = last_per_key(good, ["state_code"], position)
    change = {c: F.col(f"_new.{c}") for c in ("display_label", "portal_url", "sort_order")}
    nxt = _merge(
        current, good, ["state_code"], "link_id", position, {**change, "updated_at_utc": now}, {**change, "created_at_utc": now}
    )
    return nxt, judged.where("reason IS NOT NULL").drop("_state")


def patch_portals(current: DataFrame, patches: DataFrame, now: Column, position: str = "row_no") -> tuple[DataFrame, DataFrame]:
    """(next snapshot, rejected patches): change only the fields that are not null in ``patches``.

    ``patches`` has link_id, display_label, portal_url and sort_order. Several patches of one portal count
    together, for each field the last one by ``position`` that has it. Patches of unknown portals are rejected.
    """
    last = lambda c, value: F.max_by(value, F.when(F.col(c).isNotNull(), F.col(position)))
    p = patches.where("link_id IS NOT NULL").groupBy("link_id").agg(
        last("display_label", strip(F.col("display_label"))).alias("_label"),
        last("portal_url", strip(F.col("portal_url"))).alias("_url"),
        last("sort_order", F.col("sort_order")).alias("_sort"),
        F.max(F.col("display_label").isNotNull()).alias("_has_label"),
        F.max(F.col("portal_url").isNotNull()).alias("_has_url"),
        F.max(F.col("sort_order").isNotNull()).alias("_has_sort"),
    )
    hit = F.coalesce(F.col("_has_label") | F.col("_has_url") | F.col("_has_sort"), F.lit(False))
    patched = attach(current, p, ["link_id"], "left").withColumns({
        "display_label": F.when(F.col("_has_label"), F.col("_label")).otherwise(F.col("display_label")),
        "portal_url": F.when(F.col("_has_url"), F.col("_url")).otherwise(F.col("portal_url")),
        "sort_order": F.coalesce("_sort", "sort_order"),
        "updated_at_utc": F.when(hit, now).otherwise(F.col("updated_at_utc")),
    })
    unknown = attach(patches, current.select("link_id"), ["link_id"], "anti").withColumn("reason", F.lit("portal not found"))
    return patched.select(*current.columns), unknown


def touch_portals(current: DataFrame, states: DataFrame, now: Column) -> DataFrame:
    """Stamp the last run of the given states (column ``state_code``); other states and unknown ones are left alone."""
    hit = states.select(state_key(F.col("state_code")).alias("state_code")).distinct().withColumn("_hit", F.lit(True))
    j = current.join(hit, "state_code", "left")
    for c in ("last_agent_run_at_utc", "updated_at_utc"):
        j = j.withColumn(c, F.when(F.col("_hit"), now).otherwise(F.col(c)))
    return j.select(*current.columns)


def upsert_contacts(current: DataFrame, incoming: DataFrame, now: Column, position: str = "row_no") -> tuple[DataFrame, DataFrame]:
    """(next snapshot, rejected rows) of the contacts, unique on state and e-mail.

    Incoming rows with ``notification_contact_id`` update that contact of their state, the others are
    inserted. Rejected are rows without a name or an address, updates of unknown contacts, all but the last
    update of one contact, and rows whose address is taken in the resulting table: contacts that keep their
    address come first, then updates, then inserts, by ``position``. An address that an update gives up is free.
    An update that is rejected for its address leaves its contact, and the address of it, as they were.
    """
    id_col, mail = "notification_contact_id", ["state_code", "email"]
    clean = incoming.withColumn("state_code", state_key(F.col("state_code"))).withColumn("email", norm_email(F.col("email")))
    flags = ("notifications_enabled", "notify_new_state_file", "notify_compare_result")
    clean = clean.withColumns({c: blank_to_null(F.col(c)) for c in ("contact_name", "team_name", "department_name")})
    clean = clean.withColumns({c: F.coalesce(F.col(c), F.lit(True)) for c in flags})
    reason = F.when(F.col("contact_name").isNull(), "contact_name is required").when(F.col("email").isNull(), "email is required")
    judged = clean.withColumn("reason", reason)
    columns = judged.columns
    known = current.select(id_col, "state_code", F.col("email").alias("_old"))
    updates = judged.where(f"reason IS NULL AND {id_col} IS NOT NULL")
    updates = attach(updates, known.withColumn("_known", F.lit(True)), [id_col, "state_code"], "left")
    unknown = updates.where("_known IS NULL").withColumn("reason", F.lit("contact not found"))
    updates = updates.where("_known")
    last = updates.groupBy(id_col).agg(F.max(position).alias("_last"))
    updates = attach(updates, last, [id_col])
    early = updates.where(F.col(position) < F.col("_last")).withColumn("reason", F.lit("a later row updates the contact"))
    updates = updates.where(F.col(position) == F.col("_last"))
    inserts = judged.where(f"reason IS NULL AND {id_col} IS NULL")
    # An update that stays on its address holds it; one that moves may give its old one to others. Rounds of moves are
    # settled one by one: a refused move holds its old address again, which may refuse others.
    moves = cut_lineage(updates.where("NOT (email <=> _old)"))
    held = attach(current.select(id_col, *mail), moves.select(id_col), [id_col], "anti").select(*mail)
    lost = None
    while True:
        queue = moves.select(*mail, F.lit(0).alias("_turn"), F.col(position).alias("_at"), F.col(id_col).alias("_who"))
        first = first_per_group(queue, mail, [F.col("_at")])
        winners = attach(first, held.distinct(), mail, "anti").select("_who")
        refused = attach(moves.withColumn("_who", F.col(id_col)), winners, ["_who"], "anti").drop("_who")
        refused = cut_lineage(refused)
        if refused.isEmpty():
            break
        lost = refused if lost is None else lost.unionByName(refused)
        held = cut_lineage(held.unionByName(refused.select("state_code", F.col("_old").alias("email"))))
        moves = cut_lineage(attach(moves, refused.select(id_col), [id_col], "anti"))
    good = updates.where("email <=> _old").unionByName(moves)
    taken = held.unionByName(moves.select(*mail)).distinct()
    free = attach(inserts, taken, mail, "anti")
    added = first_per_group(free, mail, [F.col(position)])
    kept = added.select(*mail, F.col(position).alias("_kept"))
    again = attach(free, kept, mail).where(F.col(position) != F.col("_kept"))
    occupied = attach(inserts, taken, mail, "semi").select(*columns).unionByName(again.select(*columns))
    if lost is not None:
        occupied = occupied.unionByName(lost.select(*columns))
    occupied = occupied.withColumn("reason", F.lit("email is already registered for the state"))

    fields = ["contact_name", "email", "team_name", "department_name", *flags]
    new = good.select(id_col, F.struct(*fields).alias("_new"))
    updated = attach(current, new, [id_col], "left")
    hit = F.col("_new").isNotNull()
    updated = updated.withColumns({c: F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in fields})
    updated = updated.withColumn("updated_at_utc", F.when(hit, now).otherwise(F.col("updated_at_utc")))
    top = F.coalesce(current.agg(F.max(id_col)).scalar(), F.lit(0))
    added = dense_ids(added.drop(id_col), id_col, top, position, mail)
    added = added.withColumn("created_at_utc", now).withColumn("updated_at_utc", F.lit(None))
    cols = [F.col(c).cast(current.schema[c].dataType).alias(c) for c in current.columns]
    rejected = judged.where("reason IS NOT NULL")
    for some in (unknown, early, occupied):
        rejected = rejected.unionByName(some.select(*columns))
    return updated.select(*cols).unionByName(added.select(*cols)), rejected


def delete_rows(current: DataFrame, victims: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``current`` that agree with no row of ``victims`` on all ``on`` columns (an id within a state, or a state)."""
    return current.join(victims.select(*on).distinct(), list(on), "left_anti").select(*current.columns)


def list_contacts(contacts: DataFrame, state: str, limit: int | None = None) -> DataFrame:
    """Contacts of a state by department, team, name and id, all of them unless ``limit`` says otherwise."""
    mine = contacts.where(F.col("state_code") == state.strip().upper())
    mine = mine.orderBy("department_name", "team_name", "contact_name", "notification_contact_id")
    return mine if limit is None else mine.limit(limit)


def list_mappings(mappings: DataFrame, state: str, limit: int | None = None) -> DataFrame:
    """Mappings of a state, last changed first, all of them unless ``limit`` says otherwise."""
    mine = mappings.where(F.col("state_code") == state.strip().upper())
    changed = F.coalesce(F.col("updated_at_utc"), F.col("created_at_utc"))
    mine = mine.orderBy(changed.desc(), F.col("mapping_id").desc())
    return mine if limit is None else mine.limit(limit)
