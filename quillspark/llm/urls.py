"""Operator 5: association-rule filtering of URLs.

A URL is a set of tokens: its scheme, host, subdomain, domain, words of dashed hosts, path words, extension,
query names, fragment. FP-growth over the labelled pages' tokens and their label finds the combinations
that go with bad pages. Rules below the least confidence or support go, and those that a
shorter rule of no less confidence covers. Rules are matched through an inverted index by the rarest token of each. A page is blocked by a matching rule
whose confidence stands out from the share of bad pages by at least `least_z` standard errors; other matches are reported alone, as with many
token combinations some reach any confidence by chance.

Labels are those of documents. A page's document is the one numbered in its URL's path (`document`); where
the URL has no such number, it is the one with the page's own number.

Defined results: a null or empty url has no tokens, matches nothing and passes. Repeated rows give repeated
rows, and repeated labels of a page count once (bad, if any of them is). Without labelled pages of both kinds there are no
rules and everything passes. Pages with a null page_id are matched too, yet not mined. Of rules with the same confidence the one with more
support is shown, then the last in alphabetical order. An empty table gives an empty result. Very long URLs are matched whole. Extra
columns are left aside, whatever their names.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.shared import checkpoint

BAD = "label=bad"


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL, in the JVM. Numbers count by their length alone."""
    low = F.lower(F.trim(url))
    scheme = F.regexp_extract(low, r"^([a-z][a-z0-9+.-]*)://", 1)
    rest = F.regexp_replace(low, r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_extract(rest, r"^([^/?#:]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"\?([^#]*)", 1)
    fragment = F.regexp_extract(rest, r"#(.*)$", 1)
    parts = F.filter(F.split(path, "[/._-]+"), lambda x: x != "")
    named = lambda prefix, x: F.when(x != "", F.concat(F.lit(prefix), x))
    one = F.array(
        named("scheme=", scheme), named("host=", host), named("sub=", F.regexp_extract(host, r"^([^.]+)\.[^.]+\.[^.]+", 1)),
        named("domain=", F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)), named("top=", F.regexp_extract(host, r"\.([^.]+)$", 1)),
        named("ext=", F.regexp_extract(path, r"\.([a-z0-9]{1,5})$", 1)), named("end=", F.regexp_extract(path, r"(/)$", 1)), named("frag=", fragment),
    )
    words = F.transform(parts, lambda x: F.concat(F.lit("path="), F.regexp_replace(x, "[0-9]", "9")))
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query="), F.regexp_extract(x, "^([^=]*)", 1)))
    dashed = F.flatten(F.transform(F.filter(F.split(host, "[.]"), lambda x: x.contains("-")), lambda x: F.split(x, "-+")))
    split = F.transform(F.filter(dashed, lambda x: x != ""), lambda x: F.concat(F.lit("word="), x))
    every = F.array_distinct(F.filter(F.concat(one, split, words, names), lambda x: x.isNotNull()))
    return F.when(F.coalesce(low, F.lit("")) != "", every).otherwise(F.array().cast("array<string>"))


def document(url: Column, page_id: Column) -> Column:
    """The number that is the last part of a URL's path, an extension aside; else page_id."""
    path = F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.nullif(F.regexp_extract(path, r"/([0-9]{1,18})(?:\.[A-Za-z0-9]{1,5})?/?$", 1), F.lit("")).cast("long"), page_id.cast("long"))


def mine(pages: DataFrame, labels: DataFrame, least_support: float = 0.002, least_count: int = 5, least_confidence: float = 0.4, least_z: float = 4.0) -> DataFrame:
    """rule (sorted tokens), anchor, support, confidence, lift of each rule for bad pages, and whether it is sure enough to block.

    The itemsets are distributed; their number is bounded by the support, not by the pages.
    """
    bad = F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad")
    marks = labels.filter("doc_id is not null and (quality is not null or toxic is not null)").groupBy(F.col("doc_id").cast("long").alias("doc")).agg(bad)
    items = pages.filter("page_id is not null").select(document(F.col("url").cast("string"), F.col("page_id")).alias("doc"), tokens(F.col("url").cast("string")).alias("t")).join(marks, "doc").filter("size(t) > 0")
    baskets = checkpoint(items.select(F.when(F.col("bad") == 1, F.concat("t", F.array(F.lit(BAD)))).otherwise(F.col("t")).alias("items")))
    n = baskets.count()
    spark = pages.sparkSession
    none = spark.createDataFrame([], "rule array<string>, anchor string, support double, confidence double, lift double, sure boolean")
    if n < least_count:
        return none
    model = FPGrowth(itemsCol="items", minSupport=max(least_support, least_count / n), minConfidence=least_confidence).fit(baskets)
    share = F.col("confidence") / F.col("lift")  # of bad pages among all
    z = (F.col("confidence") - share) / F.sqrt(share * (1 - share) / (F.lit(float(n)) * F.col("support") / F.col("confidence")))
    rules = checkpoint(model.associationRules.filter(F.col("consequent") == F.array(F.lit(BAD))).filter(share < 1).select(F.array_sort("antecedent").alias("rule"), "support", "confidence", "lift", (z >= least_z).alias("sure")))
    times = model.freqItemsets.filter("size(items) = 1").select(F.col("items")[0].alias("token"), "freq")
    # rules that a shorter one covers; the two share the shorter one's first token
    short = rules.select(F.col("rule").alias("s"), F.col("confidence").alias("c"), F.col("sure").alias("u"), F.col("rule")[0].alias("token"))
    long = rules.select("rule", "confidence", "sure", F.explode("rule").alias("token"))
    covered = long.join(short, "token").filter((F.size("s") < F.size("rule")) & (F.col("c") >= F.col("confidence")) & (F.col("u") | ~F.col("sure")) & (F.size(F.array_except("s", "rule")) == 0)).select("rule").distinct()
    left = rules.join(covered, "rule", "left_anti")
    rarest = F.row_number().over(W.partitionBy("rule").orderBy("freq", "token"))
    anchors = left.select("rule", F.explode("rule").alias("token")).join(times, "token").withColumn("i", rarest).filter("i = 1").select("rule", F.col("token").alias("anchor"))
    return checkpoint(left.join(anchors, "rule").select("rule", "anchor", *(F.round(c, 6).alias(c) for c in ("support", "confidence", "lift")), "sure"))


def match(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, url, n_rules, confidence, rule, block of each page; rule: the one with the highest confidence, block: whether a sure one matches.

    Every distinct url is matched once: its tokens meet the rules' anchors in a join, which Spark broadcasts
    where it finds the rules small and shuffles otherwise.
    """
    urls = pages.select(F.col("url").cast("string").alias("url")).filter("url is not null").distinct()
    seen = urls.withColumn("t", tokens(F.col("url")))
    probe = seen.select("url", "t", F.explode("t").alias("anchor")).join(rules, "anchor").filter(F.size(F.array_except("rule", "t")) == 0)
    best = probe.groupBy("url").agg(F.count("*").alias("n_rules"), F.max("confidence").alias("confidence"), F.max_by(F.array_join("rule", " & "), F.struct("confidence", "support", F.array_join("rule", " & "))).alias("rule"), F.max("sure").alias("sure"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).join(best, "url", "left")
    return rows.select("page_id", "url", F.coalesce("n_rules", F.lit(0)).alias("n_rules"), "confidence", "rule", F.coalesce("sure", F.lit(False)).alias("block"))


def screen(pages: DataFrame, labels: DataFrame, **how) -> DataFrame:
    return match(pages, mine(pages, labels, **how))
