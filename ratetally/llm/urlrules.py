"""URL filter: listed rules, and association rules mined from URL tokens for all other URLs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from ratetally.llm.common import LOWER, UPPER, stored

ALLOW, BLOCK = "allow", "block"
# Rules that are sent to every task at most; more are joined by shuffle.
SENT_RULES = 10_000


def after_scheme(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"(?s)^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def listed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest listed rule that fits, else null. Rules: (verdict, host, path).

    A rule fits its host and all subdomains where the path starts with the rule's path; of rules of one length
    the first listed wins.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, host suffixes, path segments by place with digits as #, ending, query names."""
    text = F.coalesce(url, F.lit(""))
    scheme = F.concat(F.lit("scheme="), F.regexp_extract(text, r"(?s)^(.*?)://", 1))
    labels = F.reverse(F.split(host_of(url), r"\."))
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.lit("host="), F.array_join(F.reverse(F.slice(labels, F.lit(1), n)), ".")))
    parts = F.filter(F.split(F.regexp_replace(path_of(url), r"[0-9]+", "#"), "/"), lambda s: s != "")
    places = F.transform(parts, lambda s, i: F.concat(F.lit("path"), i.cast("string"), F.lit("="), s))
    ending = F.concat(F.lit("ending="), F.regexp_extract(path_of(url), r"(\.[A-Za-z0-9]{1,5}|/)$", 1))
    query = F.transform(F.filter(F.split(F.regexp_extract(text, r"(?s)\?([^#]*)", 1), "&"), lambda s: s != ""), lambda s: F.concat(F.lit("query="), F.regexp_extract(s, r"(?s)^([^=]*)", 1)))
    mark = F.when(F.contains(text, F.lit("#")), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(scheme), hosts, places, F.array(ending), query, mark))


def mined_rules(labelled: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """(rule_id, items, n_items, rarest, verdict, confidence, support) from labelled (tokens, verdict).

    FP-growth finds token combinations of at least ``min_support``; a rule says which verdict a combination
    goes with, at a confidence of at least ``min_confidence``. A rule is dropped where a part of its
    combination already gives the same verdict with at least its confidence. Each rule is filed under its
    rarest token, so that common ones gather no postings.
    """
    # Distinct (tokens, verdict) would change the counts, so every labelled row is a basket.
    baskets = labelled.select(F.array_append("tokens", F.concat(F.lit("verdict="), F.col("verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(F.element_at("consequent", 1).startswith("verdict="))
    rules = rules.where(~F.exists("antecedent", lambda x: x.startswith("verdict=")))
    rules = rules.select(F.array_sort("antecedent").alias("items"), F.substring(F.element_at("consequent", 1), 9, 100).alias("verdict"), "confidence", "support")
    rules = stored(rules)
    single = model.freqItemsets.where("size(items) = 1").select(F.element_at("items", 1).alias("token"), "freq")
    # A more general rule shares the verdict and is a proper subset: it is found by its first token.
    general = rules.select(F.element_at("items", 1).alias("_t"), F.col("items").alias("_less"), F.col("verdict").alias("_v"), F.col("confidence").alias("_c"))
    tokens = rules.select("items", "verdict", "confidence", F.explode("items").alias("_t"))
    covered = tokens.join(general, "_t").where("verdict = _v and _c >= confidence and size(_less) < size(items) and size(array_except(_less, items)) = 0").select("items", "verdict").distinct()
    rules = rules.join(covered, ["items", "verdict"], "left_anti")
    spread = rules.withColumn("token", F.explode("items")).join(single, "token")
    filed = spread.groupBy("items", "verdict").agg(F.min_by("token", F.struct("freq", "token")).alias("rarest"), F.first("confidence").alias("confidence"), F.first("support").alias("support"))
    return filed.withColumn("rule_id", F.concat_ws(" & ", "items"))


def filter_urls(
    pages: DataFrame, listed: Sequence[tuple[str, str, str]], labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url",
    min_support: float = 0.01, min_confidence: float = 0.6, default: str = ALLOW,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, mined_rule, confidence.

    A listed rule decides where one fits. Other pages get the verdict of the best mined rule among those whose
    tokens they all have (highest confidence, then support, then more tokens, then name), and ``default``
    where none fires. ``labelled`` (url, verdict) trains the miner; without it the pages that a listed rule
    judges do. Pages meet rules through an inverted index on each rule's rarest token. A null url, or one without
    "://", has an empty host and path. Repeated ids are judged row by row; without labelled rows no rule is
    mined; an empty table gives an empty result; other columns are ignored.
    """
    url = F.col("_url")
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url")).withColumns({"host": host_of(url), "path": path_of(url)})
    rows = rows.withColumn("_listed", listed_rule(F.col("host"), F.col("path"), listed))
    if labelled is None:
        train = rows.where("_listed is not null").select("_url", F.col("_listed.verdict").alias("verdict"))
    else:
        train = labelled.select(F.col("url").alias("_url"), "verdict")
    train = train.where("verdict is not null").select(url_tokens(url).alias("tokens"), "verdict")
    judged = rows.where("_listed is not null").select("_id", "host", "path", "_listed.rule", "_listed.verdict", F.lit(None).cast("string").alias("mined_rule"), F.lit(None).cast("double").alias("confidence"))
    open_rows = rows.where("_listed is null").select("_id", "host", "path", url_tokens(url).alias("_tokens"))
    rules = stored(mined_rules(train, min_support, min_confidence))
    many = rules.count()
    # What a token can fire is one list; a page looks its tokens up by content, so equal URLs' lists are judged once.
    forms = open_rows.select("_tokens").distinct()
    index = rules.select(F.col("rarest").alias("_t"), "items", F.struct(F.col("confidence"), F.col("support"), F.size("items").alias("n"), F.col("rule_id"), F.col("verdict")).alias("_hit"))
    index = F.broadcast(index) if many <= SENT_RULES else index
    fired = forms.withColumn("_t", F.explode("_tokens")).join(index, "_t").where("size(array_except(items, _tokens)) = 0")
    best = fired.groupBy("_tokens").agg(F.max("_hit").alias("_best"))
    met = open_rows.join(best.select(F.struct("_tokens").alias("_key"), "_best"), F.struct("_tokens") == F.col("_key"), "left")
    rest = met.select(
        "_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
        F.col("_best.rule_id").alias("mined_rule"), F.col("_best.confidence").alias("confidence"),
    )
    return judged.unionByName(rest).withColumnRenamed("_id", id_col)
