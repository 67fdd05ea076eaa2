"""URL filtering by mined association rules (operator 5).

Explicit rules (host, path) decide where they fit. The URLs that they decide are the labels:
each distinct set of tokens with its verdict counts once, however many copies a URL has.
Spark's FP-growth mines combinations of up to LONGEST tokens that come with a verdict, one
length after the other: a combination grows only while it is frequent and no verdict is
certain with it, as longer ones could then say nothing new. So the work is bounded by the
combinations of a URL's tokens that are frequent and undecided, not by all its subsets.
Rules are pruned by support, confidence and whatever a shorter rule already says. The rest
of the URLs is judged by the mined rules: an inverted index holds each rule under its rarest
token, and a URL's tokens look up the rules to verify.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no explicit
rule and is allowed; an empty text is such a URL; very long URLs are read whole; repeated
rows are judged each; of explicit rules equally long the first by text wins, of mined ones
the higher confidence, then support, then ``block``; an empty table, or one without labels,
mines nothing; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import column, cut, table

Rule = tuple[str, str, str]
#: The rules of this query: verdict, host, path.
EXPLICIT: tuple[Rule, ...] = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SUPPORT, CONFIDENCE, LONGEST = 0.002, 0.8, 3
#: Up to so many rules (some 100 bytes each) are sent to every task; more are joined by their tokens.
SENT_RULES = 20_000
LABEL, TOKENS = "verdict=", "tokens="
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def explicit_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest fitting rule as a struct of its text and verdict, or null."""
    fits = [
        F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")))
        for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    ]
    return F.coalesce(*fits, F.lit(None).cast("struct<rule:string,verdict:string>"))


def tokens(url: Column, host: Column, path: Column) -> Column:
    """A URL's distinct tokens: scheme, host labels, domain, path parts, last part's ending, query names."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    shape = lambda x: F.regexp_replace(x, "[0-9]+", "0")  # noqa: E731  numbers differ from page to page
    names = F.transform(F.regexp_extract_all(url, F.lit(r"[?&]([^=&#]+)="), F.lit(1)), lambda x: F.concat(F.lit("query:"), x))
    found = F.concat(
        F.array(F.concat(F.lit("scheme:"), F.substring_index(url, "://", 1)), F.concat(F.lit("domain:"), F.substring_index(host, ".", -2))),
        F.transform(labels, lambda x: F.concat(F.lit("host:"), x)), F.transform(parts, lambda x: F.concat(F.lit("path:"), shape(x))), names,
    )
    plain = F.transform(found, lambda x: F.replace(x, F.lit(" "), F.lit("%20")))
    return F.when(host != "", F.array_distinct(plain)).otherwise(F.array().cast("array<string>"))


def frequent(combinations: DataFrame, least: int) -> DataFrame:
    """(combination, label, freq) of (combination, verdict) rows: FP-growth's sets of a combination, alone or with a verdict."""
    items = cut(combinations.select(F.array(F.concat(F.lit(TOKENS), "combination"), F.concat(F.lit(LABEL), "verdict")).alias("items")))
    rows = items.count()
    schema = "combination string, label string, freq long"
    if not rows:
        return items.sparkSession.createDataFrame([], schema)
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / rows), minConfidence=1.0).fit(items).freqItemsets
    of = lambda name: F.substring(F.get(F.filter("items", lambda x: x.startswith(name)), F.lit(0)), len(name) + 1, 1 << 30)
    return sets.select(of(TOKENS).alias("combination"), of(LABEL).alias("label"), "freq").where("combination is not null")


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, longest: int = LONGEST) -> DataFrame:
    """(tokens, anchor, verdict, confidence, support) of the rules from (tokens, verdict) rows, equal rows counted once.

    Tokens are joined by spaces in a combination, in order; they hold none, as ``tokens`` has written them.
    """
    rows = labelled.where("verdict is not null").select(F.array_sort(F.array_distinct("tokens")).alias("tokens"), "verdict").distinct()
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    total = rows.count()
    least = max(1, math.ceil(support * total))
    # (row, verdict, combination, last token) of the combinations of one length that may still grow
    grown = rows.select("row", "verdict", F.explode("tokens").alias("last")).withColumn("combination", F.col("last"))
    singles, known = None, None
    for length in range(1, longest + 1):
        found = cut(frequent(grown.select("combination", "verdict"), least))
        bare = found.where("label is null").select("combination", F.col("freq").alias("all"))
        said = found.where("label is not null").join(bare, "combination").select("combination", F.col("label").alias("verdict"), "freq", "all")
        rules = said.select(F.split("combination", " ").alias("tokens"), "verdict", (F.col("freq") / F.col("all")).alias("confidence"), (F.col("freq") / F.lit(total)).alias("support")).where(F.col("confidence") >= confidence)
        known = rules if known is None else known.union(rules)
        if length == 1:
            singles = bare
        if length == longest:
            break
        # certain combinations need no more tokens, and neither do those too rare
        open_ = cut(bare.join(said.where("freq = all").select("combination"), "combination", "left_anti").select("combination"))
        if open_.isEmpty():
            break
        kept = cut(grown.join(open_, "combination"))
        if length == 1:
            one = kept.select("row", F.col("last").alias("next"))
        grown = kept.join(one, "row").where("next > last").select("row", "verdict", F.concat_ws(" ", "combination", "next").alias("combination"), F.col("next").alias("last"))
    rules = cut(known)
    # a rule goes if one with a token less has the same verdict with as much confidence
    less = rules.where(F.size("tokens") > 1).select("*", F.explode("tokens").alias("left_out")).withColumn("shorter", F.array_remove(F.col("tokens"), F.col("left_out")))
    had = rules.select(F.col("tokens").alias("shorter"), "verdict", F.col("confidence").alias("had"))
    needless = less.join(had, ["shorter", "verdict"]).where("had >= confidence").select("tokens", "verdict").distinct()
    kept = rules.join(needless, ["tokens", "verdict"], "left_anti")
    rarest = kept.select("tokens", F.explode("tokens").alias("combination")).join(singles, "combination").groupBy("tokens").agg(F.min_by("combination", F.struct("all", "combination")).alias("anchor"))
    return kept.join(rarest, "tokens").select("tokens", "anchor", "verdict", "confidence", "support")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = EXPLICIT, key: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, mined), one row a page; ``mined`` is the rule that decided, if any."""
    picked = pages.select(column(pages, key, "long").alias("page_id"), column(pages, url, "string").alias("url"))
    read = lambda df: df.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    decided = read(picked).withColumn("by", explicit_rule(F.col("host"), F.col("path"), rules))
    described = decided.withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))
    found = cut(mine(described.where("by is not null").select("tokens", F.col("by.verdict").alias("verdict"))))
    index = found.select(F.col("anchor").alias("token"), F.col("tokens").alias("needs"), F.struct("confidence", "support", "verdict", F.array_join("tokens", " ").alias("said")).alias("mined"))
    index = F.broadcast(index) if found.count() <= SENT_RULES else index
    # each distinct URL that no explicit rule decides looks up its tokens once
    open_urls = described.where("by is null and host <> ''").select("url", "tokens").distinct()
    hits = open_urls.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token").where(F.size(F.array_except("needs", "tokens")) == 0)
    best = hits.groupBy(F.col("url").alias("asks")).agg(F.max("mined").alias("mined"))
    # URLs that look up nothing are spread by their pages; no such name has a "://"
    asks = decided.withColumn("asks", F.when(F.col("by").isNull() & (F.col("host") != ""), F.col("url")).otherwise(F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    return asks.join(best, "asks", "left").select(
        "page_id", "host", "path", "by.rule",
        F.coalesce("by.verdict", "mined.verdict", F.lit("allow")).alias("verdict"), F.when(F.col("by").isNull(), F.col("mined.said")).alias("mined"),
    )


def op5_url_rules(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"))
