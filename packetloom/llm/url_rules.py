"""URL filter by association rules: FP-growth mines combinations of URL tokens that go with bad pages; rules that pass the
support and confidence bounds are matched through an inverted index on one of each rule's tokens.

A rule has to be more often right than wrong, and to be better than chance: the lower end of its confidence's Wilson interval has
to lie above the share of bad pages among all labelled ones. With CHANCE deviations a rule without meaning passes about once in
30,000 candidates, so that labels that say nothing about URLs give no rules.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, table, unused

BAD = "label:bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (action, host, start of the path): the fixed rules of the query.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Share of labelled pages that a rule's tokens and the label need together; share of bad pages among those it fits.
MIN_SUPPORT, MIN_CONFIDENCE = 0.001, 0.5
#: A rule rests on at least so many bad pages, and its confidence stands out by so many deviations.
MIN_ROWS, CHANCE = 20, 4.0
#: A rule index of up to so many rows is broadcast; beyond that the join is shuffled.
BROADCAST_RULES = 20_000


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z in lower case; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits the host or a parent of it and the start of the path, else nulls."""
    rule = action = F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fits, h + p).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def url_tokens(url: Column) -> Column:
    """Distinct tokens: host labels, path parts (numbers as one token), file type, query keys. Null or empty: none."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    parts = F.transform(F.split(path, "/"), lambda p: F.when(F.length(p) > 0, F.concat(F.lit("path:"), F.regexp_replace(p, "[0-9]+", "0"))))
    labels = F.transform(F.split(host, r"\."), lambda p: F.when(F.length(p) > 0, F.concat(F.lit("host:"), p)))
    keys = F.transform(F.split(query, "&"), lambda p: F.when(F.length(p) > 0, F.concat(F.lit("query:"), F.substring_index(p, "=", 1))))
    return F.array_distinct(F.filter(F.concat(labels, parts, keys), lambda x: x.isNotNull()))


def wilson_low(share: Column, rows: Column, z: float = CHANCE) -> Column:
    """The lower end of the Wilson interval of a share that was seen in so many rows."""
    middle = share + z * z / (2 * rows)
    return (middle - z * F.sqrt((share * (1 - share) + z * z / (4 * rows)) / rows)) / (1 + z * z / rows)


def token_classes(baskets: DataFrame) -> DataFrame:
    """baskets: (tokens). Returns (token, lead): tokens that stand in exactly the same baskets have one lead, the first of them."""
    numbered = materialise(baskets.select("tokens").withColumn("row", F.monotonically_increasing_id()), "baskets")
    hashes = [F.sum(F.xxhash64(F.lit(seed), "row").cast("decimal(38,0)")) for seed in (1, 2)]  # two sums of 64-bit hashes name a set of rows
    sets = numbered.select("row", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), hashes[0].alias("h1"), hashes[1].alias("h2"))
    return sets.select("token", F.min("token").over(Window.partitionBy("n", "h1", "h2")).alias("lead"))


def mine_rules(urls: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """urls: (tokens, bad). Returns (antecedent, classes, confidence, support): the rules whose result is the bad label. Of tokens that
    always come together only one is mined, so that a common path of k tokens is one item and not 2^k sets; classes has for each item of
    the antecedent all such tokens, any of which stands for it.

    With fewer than MIN_ROWS labelled rows there are no rules. FP-growth runs distributed; what it sends to the driver is the list of
    frequent single tokens, at most (tokens a URL) / min_support.
    """
    spark = urls.sparkSession
    known = urls.where("bad is not null and tokens is not null").select("tokens", "bad")
    classes = materialise(token_classes(known), "classes")
    leads = known.withColumn("row", F.monotonically_increasing_id()).select("row", "bad", F.explode_outer("tokens").alias("token")).join(classes, "token", "left")
    leads = leads.groupBy("row", "bad").agg(F.collect_set("lead").alias("leads"))
    baskets = materialise(leads.select(F.when(F.col("bad"), F.array_append("leads", F.lit(BAD))).otherwise(F.col("leads")).alias("items"), "bad").where(F.size("items") > 0), "items")
    labelled, bad = baskets.agg(F.count("*"), F.count_if("bad")).first()
    if labelled < MIN_ROWS:
        return spark.createDataFrame([], "antecedent array<string>, classes array<array<string>>, confidence double, support double")
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, MIN_ROWS / labelled), minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.where(F.col("consequent")[0] == BAD)
    sure = wilson_low(F.col("confidence"), F.col("support") * labelled / F.col("confidence")) > bad / labelled
    items = found.where(sure).select("antecedent", "confidence", "support", F.explode("antecedent").alias("lead"))
    alike = classes.groupBy("lead").agg(F.array_sort(F.collect_set("token")).alias("class"))
    return items.join(alike, "lead").groupBy("antecedent", "confidence", "support").agg(F.collect_list("class").alias("classes")).select("antecedent", "classes", "confidence", "support")


def matched_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls: (url, tokens), each url once. Returns the urls that hold a token of each class of some rule, with the best confidence. Rules
    are looked up by the tokens of their smallest class."""
    anchors = F.array_sort("classes", lambda a, b: F.size(a) - F.size(b))[0]
    index = materialise(rules.select(F.explode(anchors).alias("anchor"), "classes", "confidence"), "url-rules")
    small = index.count() <= BROADCAST_RULES
    found = urls.select("url", "tokens", F.explode("tokens").alias("anchor")).join(F.broadcast(index) if small else index, "anchor")
    return found.where(F.forall("classes", lambda c: F.arrays_overlap(c, "tokens"))).groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """pages: (page_id, url, ...); labels: (page_id, bad). Adds host, path, rule, verdict and learned (the confidence of the
    best mined rule that fits, else null), in place of columns of these names. A fixed rule decides first, then a mined rule blocks,
    else the page is allowed. Of equally long fixed rules the last by name decides. Null or odd urls have empty host and path and are
    allowed; repeated rows are judged alike; whole urls are read; an empty input gives no rows."""
    base = pages.drop("host", "path", "rule", "verdict", "learned")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, action = fixed_rule(host, path, rules)
    known = labels.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    tokens = base.select("page_id", "url", url_tokens(F.col("url")).alias("tokens"))
    mined = mine_rules(tokens.join(known, "page_id").select("tokens", "bad"), min_support, min_confidence)
    hits = matched_urls(tokens.where("url is not null").select("url", "tokens").dropDuplicates(["url"]), mined)
    key = unused(base, "hit")
    given = base.where("url is not null").join(hits.select(F.col("url").alias(key), F.col("confidence").alias("learned")), F.col("url") == F.col(key), "left").drop(key)
    judged = given.unionByName(base.where("url is null").withColumn("learned", F.lit(None).cast("double")))  # nulls never meet in one task
    verdict = F.coalesce(action, F.when(F.col("learned").isNotNull(), "block"), F.lit("allow"))
    return judged.withColumns({"host": host, "path": path, "rule": rule, "verdict": verdict})


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels: a page is bad where `labels` marks the row of the same number as of low quality or toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return judge_urls(pages, labels).select("page_id", "host", "path", "rule", "verdict", "learned")
