"""URL filters from association rules.

FP-growth mines combinations of URL tokens that come with bad labels; rules are pruned by support, confidence and
redundancy and are matched through an inverted index on each rule's rarest token.
"""

from __future__ import annotations

import functools

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegrove.llm._shared import written

#: Share of the labelled URLs that hold a rule's tokens and are bad, at least; their number, at least; share of bad ones among those that hold the tokens.
MIN_SUPPORT, MIN_ROWS, MIN_CONFIDENCE = 0.002, 5, 0.5
#: Factor by which a rule raises the share of bad URLs, or else lowers that of good ones, at least; a rule without good URLs meets it always.
MIN_LIFT = 1.5
BAD = "label:bad"
#: Kinds of host tokens that are left out of a run: what a host implies never stands beside it, so sets don't multiply.
WITHOUT = (("sub:", "domain:", "suffix:"), ("host:", "suffix:"), ("host:", "domain:"))


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL in order: scheme, host, sub-domain, domain, suffix, path segments, extension, query keys and pairs, fragment; null for null.

    Segments that are numbers are one token; a URL without a scheme counts as a path.
    """
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.when(scheme != "", F.lower(F.regexp_extract(rest, r"^([^/?#:]*)", 1))).otherwise("")
    labels = F.split(host, r"\.")
    path = F.regexp_extract(F.when(scheme != "", F.regexp_replace(rest, r"^[^/?#]*", "")).otherwise(rest), r"^([^?#]*)", 1)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    segments = F.filter(F.split(F.regexp_replace(path, r"\.[A-Za-z0-9]{1,5}$", ""), "/"), lambda s: s != "")
    pairs = F.filter(F.split(query, "&"), lambda s: s != "")
    tag = lambda name, value: F.when(value != "", F.array(F.concat(F.lit(name), value))).otherwise(F.array().cast("array<string>"))
    parts = F.concat(
        tag("scheme:", scheme),
        tag("host:", host),
        tag("sub:", F.when(F.size(labels) > 2, labels[0]).otherwise("")),
        tag("domain:", F.when(F.size(labels) > 1, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(host)),
        tag("suffix:", F.element_at(labels, -1)),
        F.transform(segments, lambda s: F.when(s.rlike(r"^\d+$"), F.lit("seg:#")).otherwise(F.concat(F.lit("seg:"), F.lower(s)))),
        tag("ext:", F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1))),
        F.transform(pairs, lambda s: F.concat(F.lit("key:"), F.substring_index(s, "=", 1))),
        F.transform(pairs, lambda s: F.concat(F.lit("pair:"), s)),
        tag("fragment:", F.regexp_extract(url, r"#(.*)$", 1)),
    )
    return F.when(url.isNotNull(), F.array_sort(F.array_distinct(parts)))


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad): a page takes the label of the document whose number its path ends with."""
    number = F.regexp_extract("url", r"/(\d{1,18})(?:[./?#]|$)", 1)
    known = labels.filter("quality IS NOT NULL").select(F.col("doc_id").cast("long").alias("number"), (F.col("quality") <= 0).alias("bad"))
    return pages.filter("url IS NOT NULL").select("url", F.when(number != "", number.cast("long")).alias("number")).join(known, "number").select("url", "bad")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_rows: int = MIN_ROWS, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> DataFrame:
    """(tokens, confidence, support, key): rules tokens -> bad from (url, bad), every row a transaction.

    FP-growth runs once with hosts, once with sub-domains and domains, once with sub-domains and suffixes: a set that holds
    a host and what that implies says no more than the set without it. A rule goes where a rule on part of its tokens is at least as confident. key: its token that is rarest among the
    labelled URLs, the first of equally rare ones.
    """
    spark = labelled.sparkSession
    tokens = url_tokens(F.col("url"))
    baskets = written(labelled.select(F.when(F.col("bad"), F.concat(tokens, F.array(F.lit(BAD)))).otherwise(tokens).alias("items")), "baskets")
    schema = "tokens array<string>, confidence double, support double, key string"
    total, bad = baskets.agg(F.count("*"), F.count_if(F.array_contains("items", BAD))).first()
    if not bad:
        return spark.createDataFrame([], schema)
    found = None
    for kinds in WITHOUT:
        some = baskets.select(F.filter("items", lambda t: ~functools.reduce(lambda a, b: a | b, (F.startswith(t, F.lit(k)) for k in kinds))).alias("items"))  # noqa: B023
        rules = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, min_rows / total)), minConfidence=min_confidence).fit(some).associationRules
        found = rules if found is None else found.unionByName(rules)
    bar = min(min_lift * bad / total, 1 - (1 - bad / total) / min_lift)
    rules = found.filter(F.col("consequent")[0] == BAD).filter(F.col("confidence") >= bar).select(F.array_sort("antecedent").alias("tokens"), "confidence", "support").groupBy("tokens").agg(F.max("confidence").alias("confidence"), F.max("support").alias("support"))
    rules = written(rules, "rules")
    part = rules.select(F.col("tokens").alias("less"), F.col("confidence").alias("c"), F.explode("tokens").alias("token")).withColumn("one", F.col("less")[0]).filter("token = one").drop("token")
    redundant = rules.select("tokens", "confidence", F.explode("tokens").alias("one")).join(part, "one").filter((F.size("less") < F.size("tokens")) & (F.col("c") >= F.col("confidence")) & (F.size(F.array_except("less", "tokens")) == 0)).select("tokens").distinct()
    often = baskets.select(F.explode("items").alias("token")).groupBy("token").count()
    rarest = Window.partitionBy("tokens").orderBy("count", "token")
    keyed = rules.join(redundant, "tokens", "left_anti").withColumn("token", F.explode("tokens")).join(often, "token").withColumn("nth", F.row_number().over(rarest)).filter("nth = 1")
    return keyed.select("tokens", "confidence", "support", F.col("token").alias("key"))


def apply_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, url, n_rules, confidence, blocked) for every row of pages: how many rules its URL meets and the best confidence of them.

    Only the URLs move, never the pages. A null URL meets no rule; no rules, n_rules 0 and a null confidence. Rows
    repeat as they do in pages.
    """
    urls = pages.select("url").filter("url IS NOT NULL").distinct().withColumn("have", url_tokens(F.col("url")))
    met = urls.withColumn("key", F.explode("have")).join(rules, "key").filter(F.size(F.array_except("tokens", "have")) == 0)
    best = met.groupBy("url").agg(F.count("*").alias("n_rules"), F.max("confidence").alias("confidence"))
    return pages.select("page_id", "url").join(best, "url", "left").select("page_id", "url", F.coalesce("n_rules", F.lit(0)).alias("n_rules"), "confidence", F.col("confidence").isNotNull().alias("blocked"))


def filter_urls(pages: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """Rules mined from all labelled pages, matched against all pages; see mine and apply_rules.

    Null labels, null URLs and URLs without a number are not mined; repeated rows count each. Empty tables give no
    rules, and an empty table of pages an empty result. Other columns are not read.
    """
    return apply_rules(pages, written(mine(labelled_urls(pages, labels), **settings), "url-rules"))
