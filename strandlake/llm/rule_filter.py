"""URL filtering by host and path rules, and by association rules mined from labelled URLs.

FP-growth finds combinations of URL tokens that labelled pages share; those that lead to a bad label with enough support,
confidence and lift become blocking rules. A rule whose tokens include those of another says nothing more and is dropped.
Rules are indexed by one token each, the rarest, so a URL is held only against rules of which it has that token.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from strandlake.session import materialize

#: Host and path rules.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
SUPPORT, CONFIDENCE, LIFT = 0.005, 0.6, 1.5
BAD = "label=bad"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def tokens_of(url: Column) -> Column:
    """Distinct tokens: scheme, host labels, path segments (all digits as one), endings, query fields and fragment."""
    tail = F.regexp_extract(url, r"\?([^#]*)", 1)
    parts = F.concat(
        F.array(F.concat(F.lit("scheme="), F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))),
        F.transform(F.split(host_of(url), r"\."), lambda x: F.concat(F.lit("host="), x)),
        F.transform(F.split(path_of(url), "/"), lambda x: F.concat(F.lit("path="), F.regexp_replace(x, r"[0-9]+", "0"))),
        F.transform(F.split(tail, "&"), lambda x: F.concat(F.lit("query="), x)),
        F.array(F.concat(F.lit("end="), F.regexp_extract(path_of(url), r"\.([A-Za-z0-9]+)$", 1)),
                F.concat(F.lit("fragment="), F.regexp_extract(url, r"#(.*)$", 1))))
    return F.array_distinct(F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda x: ~x.endswith("=")))


def mine(pages: DataFrame, labels: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT) -> DataFrame:
    """(rule_id, tokens, confidence, support) of the rules that lead to a bad label.

    A page is labelled by the row of ``labels`` whose doc_id is its page_id; it is bad if its quality is 0 or it is toxic.
    Labels that are null in both are not used. Without labelled pages there are no rules.
    """
    bad = F.max(F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False)))
    known = labels.filter("doc_id is not null and (quality is not null or toxic is not null)").groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(bad.alias("bad"))
    urls = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url")).filter("url is not null")
    baskets = materialize(urls.join(known, "page_id").select(
        F.concat(tokens_of(F.col("url")), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items")
    ).filter(F.size("items") > 0), "baskets")
    if not baskets.limit(1).count():
        return baskets.sparkSession.createDataFrame([], "rule_id long, tokens array<string>, confidence double, support double")
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    rules = model.associationRules.filter((F.col("consequent")[0] == BAD) & (F.col("lift") >= lift)).select(
        F.xxhash64(F.array_sort("antecedent")).alias("rule_id"), F.array_sort("antecedent").alias("tokens"), "confidence", "support")
    rules = materialize(rules, "rules")
    shorter = rules.select(F.col("rule_id").alias("short_id"), F.col("tokens").alias("short"), F.col("tokens")[0].alias("token"))
    wider = (rules.select("rule_id", "tokens", F.explode("tokens").alias("token")).join(shorter, "token")
             .filter((F.size("short") < F.size("tokens")) & (F.size(F.array_except("short", "tokens")) == 0)).select("rule_id").distinct())
    return rules.join(wider, "rule_id", "left_anti")


def matches(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, url, rule_id) of the most confident mined rule that each distinct (page_id, url) fulfils."""
    urls = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"))
    urls = urls.withColumn("tokens", tokens_of(F.col("url")))
    each = rules.select("rule_id", "confidence", F.col("tokens").alias("needed"), F.explode("tokens").alias("token"))
    seen = urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    index = (each.join(seen, "token").groupBy("rule_id").agg(F.min(F.struct("n", "token")).alias("rarest"), F.first("confidence").alias("confidence"),
                                                            F.first("needed").alias("needed"))
             .select("rule_id", "confidence", "needed", F.col("rarest.token").alias("token")))
    found = urls.withColumn("token", F.explode("tokens")).join(index, "token").filter(F.size(F.array_except("needed", "tokens")) == 0)
    best = F.max(F.struct("confidence", "rule_id")).alias("best")
    return found.groupBy("page_id", "url").agg(best).select("page_id", "url", F.col("best.rule_id").alias("rule_id"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT) -> DataFrame:
    """(page_id, host, path, rule, mined_rule, verdict) of every row of ``pages``.

    The longest fitting host and path rule decides; else a page is blocked if a mined rule holds, and allowed if none
    does. A null url or one without ``://`` has empty host and path, no rule and no tokens of a host, and is allowed
    unless a mined rule of other tokens holds. Null page_ids and repeated rows keep their rows. Other columns are not
    read. An empty table gives no rows.
    """
    mined = materialize(mine(pages, labels, support, confidence, lift), "mined-rules")
    hits = matches(pages, mined).select(F.col("page_id").alias("hit_id"), F.col("url").alias("hit_url"), F.col("rule_id").alias("mined_rule"))
    urls = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"))
    joined = urls.join(hits, urls["page_id"].eqNullSafe(hits["hit_id"]) & (urls["url"] == hits["hit_url"]), "left")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return joined.select("page_id", host.alias("host"), path.alias("path"), "mined_rule").select(
        "page_id", "host", "path", rule.alias("rule"), "mined_rule",
        F.coalesce(verdict, F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")).alias("verdict"))
