"""URL filters: explicit host and path rules, then association rules mined from labelled URLs.

Explicit rules come first; the longest that fits decides. URLs that none fits are judged by mined rules: FP-growth finds token combinations
that are frequent among labelled URLs, and those whose confidence for ``block`` is high enough, also among labelled URLs that were kept apart from mining,
block. Matching goes by inverted index: each mined rule is listed under its tokens, a URL's tokens look their rules up, and a rule fires when all of its
tokens did.

Labels for mining: a column of the caller's (``block``, ``allow``, anything else or null: not labelled), or by default the verdicts of the explicit rules on the
URLs that they fit. The latter say nothing new about the rules themselves; what is mined then are the hosts, paths and parameters that went with blocked URLs.
Labelled URLs are dealt by hash (``parts``): 12 in 16 are mined, 4 in 16 prune, and ``measured`` deals a further 4 of the 12 out, to count right verdicts on
URLs that neither step has seen. Tokens: ``host:`` labels (the top-level label and ``www`` and ``m`` included), ``first:`` path segment, ``query:`` parameter names. Pages
without a verdict by rules or mining are allowed.

Everything is DataFrame work: expressions, joins and Spark's own FP-growth, whose trees combine equal transactions before they are shuffled; what is
broadcast is decided by Spark from measured sizes (the index joins by plain equality).
Verdicts are computed once for each distinct token set, so that a host or URL with many copies costs one look-up, and joined back.

Defined cases: a null url, or one without ``://``, has empty host and path, no rule, no tokens and verdict allow; equal rule lengths cannot fit
one URL; repeated pages are judged alike; an empty table gives an empty result; without labelled URLs nothing is mined; extra columns are
ignored (the page id, the url and the label are read); a url may be as long as a string can be.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Mining:
    """support: least share of labelled URLs; confidence: least share of block among a combination's URLs; length: most tokens of a rule."""

    support: float = 0.005
    confidence: float = 0.9
    length: int = 3


def host(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, url.substr(F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, url.substr(F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    found = None
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Sorted distinct tokens of one URL; empty for an empty host."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query:"), F.substring_index(x, "=", 1)))
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("host:"), x))
    first = F.regexp_extract(path, r"^/([^/]+)", 1)
    every = F.concat(labels, F.when(first != "", F.array(F.concat(F.lit("first:"), first))).otherwise(F.array().cast("array<string>")), names)
    return F.coalesce(F.when(host != "", F.array_sort(F.array_distinct(every))), F.array().cast("array<string>"))


#: First hexadecimal digits of a URL's md5: those below the first prune, those from the second on are left out by ``measured``.
PRUNING, MEASURING = "4", "c"


def part(url: Column) -> Column:
    return F.substring(F.md5(url), 1, 1)


def mine(labelled: DataFrame, pruning: DataFrame, config: Mining = Mining()) -> DataFrame:
    """(antecedent: sorted tokens, support, confidence, lift) of block rules, from rows (tokens, verdict).

    A rule that never fires on the ``pruning`` rows, or not with that confidence, is dropped; then a longer rule is dropped when a shorter one over a part of
    its tokens is at least as confident."""
    label = F.concat(F.lit("verdict:"), F.col("verdict"))
    items = labelled.where(F.size("tokens") > 0).select(F.array_append("tokens", label).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=config.support, minConfidence=config.confidence).fit(items)
    rules = model.associationRules.where((F.element_at("consequent", 1) == "verdict:block") & (F.size("antecedent") <= config.length))
    rules = rules.select(F.array_sort("antecedent").alias("antecedent"), "support", "confidence", "lift")
    sets = pruning.where(F.size("tokens") > 0).groupBy("tokens").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "block").alias("block"))
    held = _matches(sets, rules).join(sets, "tokens").groupBy("antecedent").agg((F.sum("block") / F.sum("n")).alias("share")).where(F.col("share") >= config.confidence)
    rules = rules.join(held.select("antecedent"), "antecedent", "left_semi")
    parts = rules.select(F.explode("antecedent").alias("token"), F.struct("antecedent", "confidence").alias("of"))
    # a shorter rule's least token is in the longer one, so candidates meet on that token only
    shorter = rules.select(F.element_at("antecedent", 1).alias("token"), F.col("antecedent").alias("part"), F.col("confidence").alias("part_confidence"))
    beaten = parts.join(shorter, "token").where((F.size("part") < F.size("of.antecedent")) & (F.size(F.array_except("part", "of.antecedent")) == 0) & (F.col("part_confidence") >= F.col("of.confidence")))
    return rules.join(beaten.select(F.col("of.antecedent").alias("antecedent")).distinct(), "antecedent", "left_anti")


def _matches(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, antecedent, confidence) of distinct token sets and the rules all of whose tokens they have."""
    index = rules.select("antecedent", "confidence", F.explode("antecedent").alias("token"))
    hits = sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
    return hits.groupBy("tokens", "antecedent").agg(F.count(F.lit(1)).alias("n"), F.first("confidence").alias("confidence")).where(F.col("n") == F.size("antecedent")).drop("n")


def fired(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, confidence) of distinct token sets in which some rule fires; the most confident counts."""
    return _matches(sets, rules).groupBy("tokens").agg(F.max("confidence").alias("confidence"))


def described(pages: DataFrame, id_column: str, url_column: str, label_column: str | None, rules) -> DataFrame:
    """page_id, url, host, path, fit, tokens, label."""
    label = F.lit(None).cast("string") if label_column is None else F.col(label_column)
    base = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), label.alias("label"))
    base = base.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    base = base.withColumns({"fit": fitting(F.col("host"), F.col("path"), rules), "tokens": tokens(F.col("url"), F.col("host"), F.col("path"))})
    return base.withColumn("label", F.col("fit.verdict")) if label_column is None else base


def mined(base: DataFrame, config: Mining = Mining(), apart: bool = False) -> DataFrame:
    """Rules from the labelled rows of ``described``; ``apart``: without those that ``measured`` counts."""
    labelled = base.where(F.col("label").isin("block", "allow") & F.col("url").isNotNull()).select("tokens", F.col("label").alias("verdict"), part(F.col("url")).alias("part"))
    learn = labelled.where(F.col("part") >= PRUNING)
    return mine(learn.where(F.col("part") < MEASURING) if apart else learn, labelled.where(F.col("part") < PRUNING), config)


def judge(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", rules=RULES, config: Mining = Mining(), label_column: str | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence (of the mined rule that blocked, else null)."""
    base = described(pages, id_column, url_column, label_column, rules)
    open_sets = base.where(F.col("fit").isNull() & (F.size("tokens") > 0)).select("tokens").distinct()
    blocked = fired(open_sets, mined(base, config)).withColumn("key", F.xxhash64("tokens")).select("key", F.col("tokens").alias("of"), "confidence")
    keyed = base.withColumn("key", F.when(F.col("fit").isNull(), F.xxhash64("tokens")))
    judged = keyed.join(blocked, (keyed["key"] == blocked["key"]) & (keyed["tokens"] == blocked["of"]), "left")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("confidence").isNotNull(), F.lit("block")), F.lit("allow"))
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "confidence")


def measured(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", rules=RULES, config: Mining = Mining(), label_column: str | None = None) -> DataFrame:
    """One row: n labelled URLs that neither mining nor pruning saw, block (labelled so), blocked (by mined rules alone) and right (both)."""
    base = described(pages, id_column, url_column, label_column, rules)
    rows = base.where(F.col("label").isin("block", "allow") & (part(F.col("url")) >= MEASURING)).select("tokens", "label")
    sets = rows.groupBy("tokens").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "block").alias("block"))
    hit = sets.join(fired(sets, mined(base, config, apart=True)), "tokens", "left")
    on = F.col("confidence").isNotNull()
    return hit.agg(F.sum("n").alias("n"), F.sum("block").alias("block"), F.sum(F.when(on, F.col("n")).otherwise(F.lit(0))).alias("blocked"), F.sum(F.when(on, F.col("block")).otherwise(F.lit(0))).alias("right"))
