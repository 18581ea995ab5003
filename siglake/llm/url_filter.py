"""URL filters by association rules, in DataFrame functions and Spark's FP-growth alone.

A fixed rule list decides first: a rule fits its host and all subdomains where the path starts with the rule's, and the
longest that fits wins. Other urls get the verdict of mined rules: FP-growth finds sets of url tokens that occur with a
label; rules of enough support and confidence stay if they say more than the labels' base rate, unless a shorter one is as
confident. Rules for either verdict compete. An inverted index from a rule's rarest token finds the rules that may fit a
url, and a rule fits if all of its tokens are found. Of those that fit, the one with most evidence decides: the odds of its
verdict, against the odds without any rule. Then the better supported, the longer, block. Urls without any are allowed.

Null urls and urls without `://`: host and path empty, no tokens, allowed. Repeated rows each give a row; empty tables give
none, and without labels no rule is mined. Labels of null toxic are not used. Other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siglake.llm.common import ascii_lower, checkpointed

# Fixed values of the contract: host, path prefix, verdict.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.7
#: A rule stands on so many labelled rows at least, however few there are.
MIN_ROWS = 30
#: An index of up to so many rows is broadcast.
BROADCAST_ROWS = 20_000
LABEL = "label="
RULE = "items array<string>, verdict string, confidence double, support double, evidence double"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else null. Host and path weigh together; ties go to list order."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for own, prefix, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(own + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a url: scheme, labels of the host, its last two labels, words of the path, names of the query."""
    host, path = host_of(url), path_of(url)
    named = lambda kind, words: F.transform(F.filter(words, lambda w: (w != "") & ~w.rlike("^[0-9]+$")), lambda w: F.concat(F.lit(kind), w))
    scheme = F.coalesce(F.regexp_extract(url, r"(?s)^(.*?)://", 1), F.lit(""))
    query = F.coalesce(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(""))
    return F.array_distinct(
        F.concat(
            named("scheme=", F.array(ascii_lower(scheme))),
            named("host=", F.split(host, r"[.:]")),
            named("domain=", F.array(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1))),
            named("path=", F.split(ascii_lower(path), r"[/._-]")),
            named("query=", F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))),
        )
    )


def mined(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_rows: int = MIN_ROWS) -> DataFrame:
    """Rules (items, verdict, confidence, support, evidence) from labelled(url, verdict) rows.

    evidence: log odds of the verdict among the n rows that a rule fits, (hits + 1/2) to (misses + 1/2), less those among all.
    """
    spark = labelled.sparkSession
    baskets = labelled.select(F.array_append(tokens_of(F.col("url")), F.concat(F.lit(LABEL), F.col("verdict"))).alias("items"))
    if (n := baskets.count()) < min_rows:
        return spark.createDataFrame([], RULE)
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, min_rows / n), minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(F.element_at("consequent", 1).startswith(LABEL) & (F.col("lift") > 1))
    odds = lambda hits, of: F.log((hits + 0.5) / (of - hits + 0.5))
    hits, base = F.col("support") * n, F.col("confidence") / F.col("lift")
    rules = checkpointed(
        rules.select(
            F.array_sort("antecedent").alias("items"), F.substring(F.element_at("consequent", 1), len(LABEL) + 1, 99).alias("verdict"), "confidence", "support",
            (odds(hits, hits / F.col("confidence")) - odds(base * n, F.lit(n))).alias("evidence"),
        )
    )
    # A rule is redundant if some part of its tokens has the verdict at no less confidence; its rarest token leads to it.
    part = rarest(rules).select("token", "verdict", F.col("items").alias("some"), F.col("confidence").alias("c"))
    longer = rules.select("items", "verdict", "confidence", F.explode("items").alias("token")).join(part, ["token", "verdict"])
    longer = longer.where((F.size("some") < F.size("items")) & (F.col("c") >= F.col("confidence")) & (F.size(F.array_except("some", "items")) == 0))
    redundant = longer.select("items", "verdict").distinct()
    return rules.join(redundant, ["items", "verdict"], "left_anti").select("items", "verdict", "confidence", "support", "evidence")


def rarest(rules: DataFrame) -> DataFrame:
    """The rules with token, the one of their tokens that fewest rules have."""
    rules = rules.withColumn("id", F.xxhash64("items", "verdict"))
    counted = rules.select(F.explode("items").alias("token")).groupBy("token").count()
    ranked = rules.select("id", F.explode("items").alias("token")).join(counted, "token").groupBy("id").agg(F.min_by("token", F.struct("count", "token")).alias("token"))
    return rules.join(ranked, "id").select("token", "items", "verdict", "confidence", "support", "evidence")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url and mined, the verdict of the best rule, of the distinct urls that some rule fits."""
    rules = checkpointed(rules)
    index = rarest(rules)
    if (n := rules.count()) == 0:
        return urls.sparkSession.createDataFrame([], "url string, mined string")
    index = F.broadcast(index) if n <= BROADCAST_ROWS else index
    tokens = urls.where("url is not null").select("url", tokens_of(F.col("url")).alias("tokens")).select("url", "tokens", F.explode("tokens").alias("token"))
    fits = tokens.join(index, "token").where(F.size(F.array_except("items", "tokens")) == 0)
    best = F.max_by("verdict", F.struct("evidence", "support", F.size("items"), (F.col("verdict") == "block").cast("int")))
    # Cut off here, so that a join on a very common url has exchanges of its own on both sides and can be split.
    return checkpointed(fits.groupBy("url").agg(best.alias("mined")))


def url_verdicts(pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of each page row. labels: doc_id (a page_id) and toxic, of which 1 asks to block."""
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"))
    toxic = labels.where("toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("page_id"), F.when(F.col("toxic") == 1, "block").otherwise("allow").alias("verdict"))
    found = matched(pages, mined(pages.join(toxic, "page_id").where("url is not null")))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    out = pages.join(found, "url", "left").select("page_id", host.alias("host"), path.alias("path"), "mined")
    out = out.withColumn("fit", ruled(F.col("host"), F.col("path"), rules))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", "mined", F.lit("allow")).alias("verdict"))
