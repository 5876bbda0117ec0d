"""Rules that URLs are matched with, kept as a table under an inverted index of pieces of their literal parts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ratetally.functions import urls
from ratetally.functions.text import strip, text
from ratetally.operators.spread import cut_lineage, lookup_join

# Letters of an indexed piece; shorter literals are indexed whole.
PIECE = 4
# Rules with a pattern and no literal part: each is looked for in every URL, so they have to be few.
MAX_BARE_PATTERNS = 1_000
# Equal rules from which their ids are listed once for all URLs that meet the same such groups, not once per URL.
MANY_EQUAL = 64


def checked_rules(rules: DataFrame) -> DataFrame:
    """(rule_id, position, host, path, pattern, literal) of rules that can match; a pattern that is none matches nothing.

    The literal, the longer one of the host and path parts, must occur in a URL that the rule matches.
    """
    part = lambda c: F.lower(strip(text(F.col(c))))
    out = rules.select("rule_id", "position", part("host_contains").alias("host"), part("path_contains").alias("path"), strip(text(F.col("url_regex"))).alias("pattern"))

    def sound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for pattern in batch.column("pattern").to_pylist():
                try:
                    re.compile(pattern)
                    keep.append(True)
                except re.error:
                    keep.append(False)
            yield batch.filter(pa.array(keep, pa.bool_()))

    schema = ", ".join(f"{n} {t}" for n, t in out.dtypes)
    literal = F.when(F.char_length("path") >= F.char_length("host"), F.col("path")).otherwise(F.col("host"))
    return out.mapInArrow(sound, schema).withColumn("literal", literal)


def _pieces(c: Column, sizes: list[int]) -> Column:
    """The distinct pieces of a text, of every given size."""
    n = F.char_length(c)
    cut = lambda size: F.transform(F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substr(c, i, F.lit(size)))
    return F.array_distinct(F.flatten(F.array(*[cut(s) for s in sizes])))


def match_rule_table(df: DataFrame, url: str, rules: DataFrame, name: str = "rule_ids") -> DataFrame:
    """``df`` with the ids of the rules that its URL meets, by the rules' ``position``; an empty array where there are none.

    ``rules`` has rule_id, position, host_contains, path_contains, url_regex; a rule matches when all the parts that it
    states hold, and one that states nothing is an error. Any number of rules makes one plan: equal rules are one, each is
    filed under the rarest piece of its literal part, distinct URLs bring the pieces that rules are filed under, and only what
    meets there is compared. Ids of ``MANY_EQUAL`` equal rules or more are listed once per set of such rules that some URL
    meets, and reach the rows of ``df`` last, so the lists are not shuffled row by row. Rules that are a pattern alone have
    no piece; they are tested with every URL, ``MAX_BARE_PATTERNS`` different ones at most. Null URLs meet nothing.
    """
    member = F.struct("position", "rule_id")
    known = checked_rules(rules).groupBy("host", "path", "pattern", "literal").agg(F.array_sort(F.collect_list(member)).alias("members"))
    known = cut_lineage(known.withColumn("rule", F.monotonically_increasing_id()))
    if not known.where("literal = '' AND pattern = ''").isEmpty():
        raise ValueError("A rule states nothing to match.")
    u = strip(F.col(url))
    seen = df.select(u.alias("_u")).where("_u <> ''").distinct()
    full = F.lower("_u")
    filed = known.where("literal <> ''")
    size = F.least(F.char_length("literal"), F.lit(PIECE))
    # At most PIECE different sizes.
    sizes = sorted(r[0] for r in filed.select(size.alias("s")).distinct().collect())
    hits = None
    if sizes:
        own = F.filter(_pieces(F.col("literal"), sizes), lambda p: F.char_length(p) == size)
        of_rule = filed.select("rule", F.explode(own).alias("piece"))
        of_url = seen.select("_u", F.explode(_pieces(full, sizes)).alias("piece"))
        met = cut_lineage(of_url.join(of_rule.select("piece").distinct(), "piece", "left_semi"))
        often = met.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
        rarest = of_rule.join(often, "piece", "left").groupBy("rule").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("best"))
        rarest = rarest.where("best.n > 0").select("rule", F.col("best.piece").alias("piece"))
        keyed = rarest.join(filed.select("rule", "host", "path", "pattern"), "rule")
        # The literal part comes first: few that share a piece hold it, and hosts and patterns cost more.
        here = full.contains(F.col("path")) & full.contains(F.col("host")) & F.lower(urls.host(F.col("_u"))).contains(F.col("host"))
        here = here & ((F.col("pattern") == "") | F.rlike("_u", F.concat(F.lit("(?i)"), F.col("pattern"))))
        hits = met.join(keyed, "piece").where(here).select("_u", "rule")
    bare = known.where("literal = ''").select("rule", "pattern").limit(MAX_BARE_PATTERNS + 1).collect()
    if len(bare) > MAX_BARE_PATTERNS:
        raise ValueError(f"More than {MAX_BARE_PATTERNS} rules are a pattern alone.")
    if bare:
        cases = [F.when(F.col("_u").rlike("(?i)" + r["pattern"]), F.lit(r["rule"]).cast("long")) for r in bare]
        tested = seen.select("_u", F.explode(F.array_compact(F.array(*cases))).alias("rule"))
        hits = tested if hits is None else hits.unionByName(tested)
    none = F.array().cast(f"array<{rules.schema['rule_id'].dataType.simpleString()}>")
    if hits is None:
        return df.withColumn(name, none)
    few = F.size("members") < MANY_EQUAL
    listed = hits.join(known.select("rule", F.when(few, F.col("members")).alias("_few")), "rule")
    groups = F.array_sort(F.collect_list(F.when(F.col("_few").isNull(), F.col("rule"))))
    met_by = cut_lineage(listed.groupBy("_u").agg(groups.alias("_groups"), F.flatten(F.collect_list("_few")).alias("_few")))
    sets = met_by.where(F.size("_groups") > 0).select("_groups").distinct()
    lists = sets.select("_groups", F.explode("_groups").alias("rule")).join(known.where(~few).select("rule", "members"), "rule")
    lists = lists.groupBy("_groups").agg(F.array_sort(F.flatten(F.collect_list("members"))).alias("_many"))
    out = lookup_join(df.withColumn("_u", u), met_by, ["_u"], "_hit").withColumn("_groups", F.col("_hit._groups"))
    out = lookup_join(out, lists, ["_groups"], "_long")
    one, many = F.col("_hit._few"), F.col("_long._many")
    both = F.when(many.isNull(), F.array_sort(one)).when(F.size(one) == 0, many).otherwise(F.array_sort(F.concat(many, one)))
    return out.withColumn(name, F.coalesce(F.transform(both, lambda h: h["rule_id"]), none)).drop("_u", "_hit", "_groups", "_long")
