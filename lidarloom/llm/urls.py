"""URL filter: listed rules first, then association rules that FP-growth mines from labelled URLs."""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: (verdict, host, path); a rule fits its host and all its subdomains where the URL's path starts with the rule's.
LISTED = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
SUPPORT, CONFIDENCE = 0.002, 0.6
#: Bad URLs that a mined rule needs at least, however few are labelled.
LEAST_URLS = 10
BAD = "label:bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    return ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])


def listed_rule(host: Column, path: Column, rules=LISTED) -> Column:
    """struct(rule, verdict) of the longest rule that fits, ties to the one that sorts first; null if none does."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        this = F.struct(F.lit(r[1] + r[2]).alias("rule"), F.lit(r[0]).alias("verdict"))
        out = F.when(fits(host, path, r), this) if out is None else out.when(fits(host, path, r), this)
    return out


def tokens(url: Column) -> Column:
    """Sorted distinct tokens: host labels and their words, path segments and keys of the query; digits become #."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    plain = lambda x: F.regexp_replace(F.translate(x, UPPER, LOWER), r"\d+", "#")
    tag = lambda kind, parts: F.transform(F.array_remove(parts, ""), lambda x: F.concat(F.lit(f"{kind}:"), x))
    all_of = F.concat(
        tag("host", F.split(plain(host), r"\.")),
        tag("word", F.split(plain(host), r"[-_.]")),
        tag("path", F.split(plain(path), r"[/.]")),
        tag("key", F.transform(F.split(query, "&"), lambda x: plain(F.substring_index(x, "=", 1)))),
        F.array(F.concat(F.lit("scheme:"), plain(F.substring_index(F.coalesce(url, F.lit("")), "://", 1)))),
    )
    return F.array_sort(F.array_distinct(all_of))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least_urls: int = LEAST_URLS) -> DataFrame:
    """mine_classes(), with each rule spelled out for every token of its classes: antecedent, confidence, support. For
    reading; classes of m tokens in rules of k give m^k rows, so judge() doesn't use it."""
    rules, classes = mine_classes(labelled, support, confidence, least_urls)
    rules = rules.withColumn("id", F.monotonically_increasing_id())
    parts = rules.select("id", "confidence", "support", F.explode("antecedent").alias("t"))
    spelled = parts.join(classes.groupBy("t").agg(F.collect_list("token").alias("same")), "t").groupBy("id", "confidence", "support").agg(F.collect_list("same").alias("each"))
    one_of_each = F.aggregate("each", F.array(F.array().cast("array<string>")), lambda sets, same: F.flatten(F.transform(sets, lambda x: F.transform(same, lambda t: F.concat(x, F.array(t))))))
    return spelled.select(F.explode(one_of_each).alias("antecedent"), "confidence", "support").withColumn("antecedent", F.array_sort("antecedent"))


def mine_classes(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least_urls: int = LEAST_URLS) -> tuple[DataFrame, DataFrame]:
    """(tokens, bad boolean) -> rules (antecedent, confidence, support) over classes of tokens, and the classes (token, t:
    the class's first token, by which rules name it). Sets that go with a bad label in at least `confidence` of their
    URLs and make up, with it, at least `support` of all URLs and `least_urls` in number; of nested sets the larger goes
    unless it is surer.

    No basket is cut. What FP-growth needn't see is left out: tokens that go with too few bad labels for any rule, all
    but one of tokens of the very same URLs (they are a class), tokens of every URL, which are rules alone or add
    nothing, and tokens that are always bad: each is a rule alone, and nothing that holds it is surer.

    Null bad counts as not bad; null tokens are an empty basket. Repeated rows count each. No rows, or too few bad ones:
    no rules.
    """
    rows = stored(labelled.select(F.monotonically_increasing_id().alias("row"), "tokens", F.coalesce("bad", F.lit(False)).alias("bad")))
    n, n_bad = rows.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    least = math.ceil(min(1.0, max(support, least_urls / max(n, 1))) * n - 1e-6)
    if not n or n_bad < least:
        spark = rows.sparkSession
        return spark.createDataFrame([], "antecedent array<string>, confidence double, support double"), spark.createDataFrame([], "token string, t string")
    each = rows.select("row", "bad", F.explode("tokens").alias("t"))
    counts = each.groupBy("t").agg(F.count(F.lit(1)).alias("n_all"), F.count_if("bad").alias("n_bad"), F.bit_xor(F.xxhash64("row")).alias("where"))
    classes = stored(counts.filter(F.col("n_bad") >= least).groupBy("n_all", "n_bad", "where").agg(F.min("t").alias("t"), F.collect_list("t").alias("same")))
    always, sure = F.col("n_all") == n, F.col("n_all") == F.col("n_bad")
    shown = each.join(classes.filter(~always & ~sure).select("t"), "t").select("row", "t").union(rows.filter("bad").select("row", F.lit(BAD).alias("t")))
    kept = stored(shown.groupBy("row").agg(F.collect_list("t").alias("items")).select("items"))
    n_kept = kept.count()
    # half a URL less than the least, so that rounding leaves the least itself in
    model = FPGrowth(itemsCol="items", minSupport=max(0.0, (least - 0.5) / n_kept), minConfidence=confidence).fit(kept)
    rules = model.associationRules.filter(F.col("consequent") == F.array(F.lit(BAD))).select(F.array_sort("antecedent").alias("antecedent"), "confidence", (F.col("support") * n_kept / n).alias("support"))
    rules = stored(rules)
    part = rules.select(F.explode("antecedent").alias("t"), F.col("antecedent").alias("small"), F.col("confidence").alias("sure"))
    nested = (
        rules.withColumn("t", F.explode("antecedent"))
        .join(part, "t")
        .filter((F.size("small") < F.size("antecedent")) & (F.size(F.array_except("small", "antecedent")) == 0) & (F.col("sure") >= F.col("confidence")))
        .select("antecedent")
        .distinct()
    )
    rules = rules.join(nested, "antecedent", "left_anti")
    alone = classes.filter(sure | (always & F.lit(n_bad / n >= confidence)))
    rules = rules.union(alone.select(F.array("t"), F.col("n_bad") / F.col("n_all"), F.col("n_bad") / n))
    return stored(rules), classes.select(F.explode("same").alias("token"), "t")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (key, tokens) -> key, rule_confidence: the surest rule that fits, for those that some rule fits.

    Rules are posted in an inverted index under that one of their tokens which the fewest URLs have; URLs look theirs
    up, and what is met is checked in full. Distinct URLs keep a hot host from meeting a rule once for each page. No
    URLs or no rules: no rows. Rules may come in any number; repeated ones count once.
    """
    each = urls.select("key", F.explode("tokens").alias("t"))
    named = rules.select(F.explode("antecedent").alias("t")).distinct()
    frequency = each.join(named, "t").groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    posted = rules.withColumn("t", F.explode("antecedent")).join(frequency, "t", "left").groupBy("antecedent", "confidence").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "t"))["t"].alias("t"))
    met = urls.select("key", "tokens", F.explode("tokens").alias("t")).join(posted, "t")
    return met.filter(F.size(F.array_except("antecedent", "tokens")) == 0).groupBy("key").agg(F.max("confidence").alias("rule_confidence"))


def in_classes(urls: DataFrame, classes: DataFrame) -> DataFrame:
    """urls (key distinct, tokens) with the class of each token in its place; tokens of no class are in no rule and go."""
    each = urls.select("key", F.explode("tokens").alias("token")).join(classes, "token")
    return each.groupBy("key").agg(F.collect_set("t").alias("tokens"))


def judge(pages: DataFrame, labels: DataFrame, rules=LISTED, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(page_id, url), labels (doc_id = page_id, quality, toxic) -> page_id, host, path, rule, verdict, rule_confidence.

    The longest listed rule that fits decides. Else a URL that a mined rule fits is blocked, all others are allowed. A
    labelled page counts as bad if it is toxic or of quality 0.

    Null URLs and those without :// have an empty host and path, and no tokens but their scheme's. Null labels are left
    out; a page with several labels counts once for each. Repeated rows are judged alike. With no labels nothing is
    mined. An empty table gives no rows. Other columns don't take part.
    """
    p = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"))
    known = labels.select(F.col("doc_id").alias("__id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad")).filter("bad is not null")
    labelled = stored(p.join(known, F.col("page_id") == F.col("__id")).select(tokens(F.col("url")).alias("tokens"), "bad"))
    p = p.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).withColumn("listed", listed_rule(F.col("host"), F.col("path"), rules))
    if labelled.limit(1).count():
        open_urls = stored(p.filter(F.col("listed").isNull()).select(F.coalesce("url", F.lit("")).alias("key")).distinct().withColumn("tokens", tokens(F.col("key"))))
        rules_, classes = mine_classes(labelled, support, confidence)
        hits = match(in_classes(open_urls, classes), rules_)
        p = p.join(hits, F.coalesce(p["url"], F.lit("")) == hits["key"], "left").drop("key")
    else:
        p = p.withColumn("rule_confidence", F.lit(None).cast("double"))
    mined = F.when(F.col("rule_confidence").isNotNull(), "block").otherwise("allow")
    return p.select("page_id", "host", "path", F.col("listed.rule").alias("rule"), F.coalesce("listed.verdict", mined).alias("verdict"), F.when(F.col("listed").isNull(), F.col("rule_confidence")).alias("rule_confidence"))
