"""URL filters: a list of host and path rules, and association rules mined from labels by FP-growth.

Everything here is DataFrame and Spark ML work; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripleloom.llm.common import ascii_lower, written

#: (host, path) and verdict.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
#: A mined rule holds for at least this share of the labelled urls and this many of them, and is right for at least this
#: share of those it fits.
MIN_SUPPORT = 0.002
MIN_ROWS = 20
MIN_CONFIDENCE = 0.6
BLOCKED = "label=block"


def host_of(url: Column) -> Column:
    """What stands after the first :// up to / ? # or the end, A-Z lower-cased; empty where there is none."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def listed(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """The longest fitting rule as struct<rule, verdict>; null where none fits. Of rules of one length the first one wins."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for at, start, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(at + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of a url: host suffixes by whole labels, path segments with digits as 0, query keys."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, F.least(i, F.greatest(n, F.lit(1))), F.greatest(n, F.lit(1))), ".")),
    )
    segments = F.transform(
        F.filter(F.split(path, "/"), lambda x: x != ""),
        lambda x: F.concat(F.lit("path="), F.regexp_replace(ascii_lower(x), "[0-9]+", "0")),
    )
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(
        F.filter(F.split(query, "&"), lambda x: x != ""),
        lambda x: F.concat(F.lit("query="), ascii_lower(F.regexp_extract(x, "^([^=]*)", 1))),
    )
    return F.array_distinct(F.concat(F.when(n > 0, suffixes).otherwise(F.array().cast("array<string>")), segments, keys))


def token_classes(labelled: DataFrame) -> DataFrame:
    """token, class: tokens of the same labelled rows are one class, named by the least of them.

    Tokens that always come together, such as the segments of one path, would make every combination of them a frequent set. Any of them
    says what all of them say, so rules are mined over classes and fit whatever member a url has.
    """
    shapes = labelled.where(F.col("blocked").isNotNull()).groupBy(F.array_sort("tokens").alias("tokens")).agg(F.lit(1))
    each = shapes.select(F.xxhash64("tokens").alias("a"), F.xxhash64("tokens", F.lit(1)).alias("b"), F.explode("tokens").alias("token"))
    # two hashes of the set of shapes that a token is in
    places = each.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    names = places.groupBy("n", "a", "b").agg(F.min("token").alias("class"))
    return places.join(names, ["n", "a", "b"]).select("token", "class")


def in_classes(rows: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """key and the classes of its tokens; a token that no labelled row has belongs to none."""
    each = rows.select(key, F.explode("tokens").alias("token")).join(classes, "token")
    return each.groupBy(key).agg(F.array_sort(F.collect_set("class")).alias("tokens"))


def mine(
    labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_rows: int = MIN_ROWS
) -> DataFrame:
    """Token combinations that point to blocked urls: antecedent, confidence, lift, support.

    labelled: tokens array<string>, blocked boolean. A combination is dropped when a part of it is already a rule of the
    same confidence or better, since the part fits wherever the whole does. Rows without tokens or without a label don't
    count; a table without labelled rows gives no rule.
    """
    spark = labelled.sparkSession
    schema = T.StructType.fromDDL("antecedent array<string>, confidence double, lift double, support double")
    items = labelled.where(F.col("blocked").isNotNull() & (F.size("tokens") > 0)).select(
        F.when(F.col("blocked"), F.concat("tokens", F.array(F.lit(BLOCKED)))).otherwise(F.col("tokens")).alias("items")
    )
    rows = items.count()
    min_support = max(min_support, min_rows / max(rows, 1))
    if rows == 0 or min_support > 1:
        return spark.createDataFrame([], schema)
    # a url has few tokens and every frequent set meets min_support, so the rules don't grow with the input
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(BLOCKED))).select(
        F.array_sort("antecedent").alias("antecedent"), "confidence", "lift", "support"
    )
    parts = rules.select(F.col("antecedent").alias("part"), F.col("confidence").alias("part_confidence"))
    wider = (
        rules.select("antecedent", "confidence", F.explode("antecedent").alias("token"))
        .join(parts.select("part", "part_confidence", F.element_at("part", 1).alias("token")), "token")
        .where(
            (F.size("part") < F.size("antecedent"))
            & (F.size(F.array_except("part", "antecedent")) == 0)
            & (F.col("part_confidence") >= F.col("confidence"))
        )
        .select("antecedent")
        .distinct()
    )
    return rules.join(wider, "antecedent", "left_anti").select("antecedent", "confidence", "lift", "support")


def match(urls: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """Keys of urls that some rule fits, each with its best rule: key, antecedent, confidence.

    urls: key, tokens. The inverted index posts each rule once, under the token that the fewest rules hold; urls are looked
    up by token and the rest of the rule is compared in place, so no url meets a rule it shares nothing with.
    """
    posted = rules.withColumn("rule_id", F.xxhash64("antecedent"))
    each = posted.select("rule_id", F.explode("antecedent").alias("token"))
    rare = each.join(each.groupBy("token").agg(F.count("*").alias("n")), "token")
    rare = rare.groupBy("rule_id").agg(F.min(F.struct("n", "token"))["token"].alias("token"))
    index = posted.join(rare, "rule_id").select("token", "antecedent", "confidence")
    found = (
        urls.select(key, "tokens", F.explode("tokens").alias("token"))
        .join(index, "token")
        .where(F.size(F.array_except("antecedent", "tokens")) == 0)
    )
    best = F.max(F.struct("confidence", "antecedent"))
    return found.groupBy(key).agg(best.alias("best")).select(key, "best.antecedent", "best.confidence")


def judge(
    pages: DataFrame,
    labels: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    min_rows: int = MIN_ROWS,
    rules: tuple[tuple[str, str, str], ...] = RULES,
) -> DataFrame:
    """A verdict for every url: id_col, host, path, rule, verdict, mined (the combination of token classes that fits, if any), confidence.

    labels: the id of a page and `blocked`. Where no listed rule fits, a url is blocked when a mined one does, else allowed. A
    null url, or one without ://, has an empty host and path and is allowed. Repeated rows and ids each get their verdict;
    a null id is kept and never labelled. Without labels nothing is mined.
    """
    pages = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    split = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    known = split.withColumn("tokens", tokens(F.col("host"), F.col("path"), F.col("url")))
    labels = labels.select(F.col(labels.columns[0]).alias("id"), F.col("blocked"))
    # urls of one shape have the same tokens: each shape is looked at once
    shaped = known.withColumn("shape", F.xxhash64("tokens"))
    marked = written(shaped.join(labels, "id").select("shape", "tokens", "blocked"), "labelled-urls")
    classes = written(token_classes(marked), "token-classes")
    shapes = shaped.groupBy("shape").agg(F.first("tokens").alias("tokens"))
    shapes = written(in_classes(shapes, classes, "shape"), "url-shapes")
    mined = mine(marked.select("shape", "blocked").join(shapes, "shape").select("tokens", "blocked"), min_support, min_confidence, min_rows)
    # written down, so that the join can split the urls of a very common shape
    hits = written(match(shapes, mined, "shape").select("shape", F.col("antecedent").alias("mined"), "confidence"), "url-hits")
    found = listed(F.col("host"), F.col("path"), rules)
    out = shaped.join(hits, "shape", "left").withColumn("found", found)
    by_method = F.when(F.col("mined").isNotNull(), "block").otherwise("allow")
    return out.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", by_method).alias("verdict"),
        "mined",
        "confidence",
    )
