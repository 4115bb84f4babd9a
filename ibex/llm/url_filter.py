"""URL filtering with curated rules and mined association rules.

Curated rules (host and path prefix, longest wins) decide first.  For other
URLs Spark's FP-growth mines token combinations from the labelled pages; rules
"tokens => block" that reach a support and a confidence, and that no shorter
rule of at least the same confidence implies, are matched by an inverted
index: each rule is filed under its rarest token, a URL looks up its tokens,
and the rules found are verified in full.

Tokens that the same labelled pages have (the segments of one long URL that
many pages share) can't be told apart by any label.  They are one item for
FP-growth, which would otherwise list all their subsets; a URL has the item if
it has one of them, which is what all those rules together say.

Matching runs once per distinct token set, so a host with a third of all
pages costs one look-up per shape of its URLs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ibex.llm.frames import checkpointed

BLOCK, ALLOW = "block", "allow"
#: The label enters the transactions as an item of its own.
_LABEL = "label="


@dataclass(frozen=True)
class CuratedRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The curated rules of the registered query.
CURATED = (
    CuratedRule(ALLOW, "com", "/"),
    CuratedRule(BLOCK, "example.com", "/en/"),
    CuratedRule(ALLOW, "www.example.com", "/en/"),
    CuratedRule(BLOCK, "net", "/es/"),
    CuratedRule(BLOCK, "net", "/fr/"),
)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """Host up to ``/``, ``?`` or ``#``, A-Z lower-cased; empty for null and
    for URLs without ``://``."""
    found = F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*", 0)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``."""
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    """What follows ``?``, up to ``#``."""
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^?#]*\?([^#]*)", 1)


def url_tokens(host: Column, path: Column, query: Column | None = None) -> Column:
    """Distinct tokens: host labels, path segments, and the query's keys and
    settings; digits folded but for hosts."""
    def folded(x):
        return F.regexp_replace(x, "[0-9]+", "#")

    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), folded(x)))
    parts = [labels, segments]
    if query is not None:
        settings = F.split(query, "&")
        parts += [F.transform(settings, lambda x: F.concat(F.lit("k:"), folded(F.substring_index(x, "=", 1)))),
                  F.transform(settings, lambda x: F.concat(F.lit("q:"), folded(x)))]
    return F.array_sort(F.array_distinct(F.filter(F.concat(*parts), lambda x: F.length(x) > 2)))


def curated_rule(host: Column, path: Column, rules: Sequence[CuratedRule]) -> Column:
    """Name and verdict of the longest fitting rule; null where none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest is asked first
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        out = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def token_classes(labelled: DataFrame, min_support: float) -> DataFrame:
    """(token, item) of the tokens that enough rows of ``labelled`` (row,
    tokens) have for a rule; tokens of the very same rows share an item, the
    first of them.  Their number is bounded by the tokens of a URL over the
    support."""
    least = F.lit(min_support) * F.lit(labelled.count())
    marks = [F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"mark{k}") for k in (1, 2)]
    tokens = (labelled.select("row", F.explode("tokens").alias("token")).groupBy("token")
              .agg(F.count(F.lit(1)).alias("n"), *marks).where(F.col("n") >= least))
    items = tokens.groupBy("n", "mark1", "mark2").agg(F.min("token").alias("item"))
    return tokens.join(items, ["n", "mark1", "mark2"]).select("token", "item")


def as_items(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """``sets`` (tokens and other columns) with their distinct ``items``; sets
    without any are left out."""
    keys = sets.columns
    return (sets.withColumn("token", F.explode("tokens")).join(F.broadcast(classes), "token")
            .groupBy(*keys).agg(F.array_sort(F.collect_set("item")).alias("items")))


def mine_rules(labelled: DataFrame, *, min_support: float = 0.005, min_confidence: float = 0.8) -> DataFrame:
    """(antecedent, confidence, support) of the block rules mined from
    ``labelled`` (tokens, label): rules of any number of tokens, from all rows.

    A rule is dropped if a rule with a subset of its tokens has at least its
    confidence.
    """
    items = labelled.select(
        F.array_append("tokens", F.concat(F.lit(_LABEL), F.col("label"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    rules = (model.associationRules
             .where((F.col("consequent")[0] == _LABEL + BLOCK)
                    & ~F.exists("antecedent", lambda x: F.startswith(x, F.lit(_LABEL))))
             .select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support"))
    # shorter rules that imply a rule share one of its tokens: join by token, not all pairs
    short = rules.select(F.col("antecedent").alias("sub"), F.col("confidence").alias("sub_confidence"),
                         F.col("antecedent")[0].alias("token"))
    implied = (rules.select("antecedent", "confidence", F.explode("antecedent").alias("token")).join(short, "token")
               .where((F.size("sub") < F.size("antecedent")) & (F.size(F.array_except("sub", "antecedent")) == 0)
                      & (F.col("sub_confidence") >= F.col("confidence")))
               .select("antecedent").distinct())
    return rules.join(implied, "antecedent", "left_anti")


def match_rules(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, confidence): the best mined rule of each token set that any
    fits, through an inverted index on each rule's rarest token."""
    tokens = token_sets.select("tokens").distinct()
    postings = tokens.select("tokens", F.explode("tokens").alias("token"))
    frequency = postings.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    filed = (rules.select("antecedent", "confidence", F.explode("antecedent").alias("token"))
             .join(frequency, "token", "left")
             .groupBy("antecedent", "confidence")
             .agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token")))
    return (postings.join(filed, "token")
            .where(F.size(F.array_except("antecedent", "tokens")) == 0)
            .groupBy("tokens").agg(F.max("confidence").alias("confidence")))


def filter_urls(pages: DataFrame, labels: DataFrame | None = None, url_col: str = "url", id_col: str = "page_id",
                label_id_col: str = "doc_id", *, curated: Sequence[CuratedRule] = CURATED,
                min_support: float = 0.005, min_confidence: float = 0.8) -> DataFrame:
    """One row per page: ``id``, ``host``, ``path``, ``rule`` (curated rule
    that decided, else null), ``verdict`` and ``confidence`` (of the mined
    rule that blocked, else null).

    Mining uses every page with a row in ``labels`` (quality 0 or toxic 1
    means block) and nothing else: what curated rules say of other hosts is no
    evidence.  Pages that no curated rule decides are allowed unless a mined
    rule fits.

    Null URLs and URLs without ``://`` have an empty host and path, fit no
    rule and are allowed.  Repeated ids keep one row each; of repeated label
    rows, one that says block wins.  Other columns are ignored.  Without
    labelled pages nothing is mined and nothing is blocked beyond the curated
    rules.
    """
    parsed = _parsed(pages, url_col, id_col, curated)
    matched = parsed.select("tokens").limit(0).withColumn("confidence", F.lit(None).cast("double"))
    if labels is not None:
        matched = _mined(parsed, _told(labels, label_id_col), parsed.where("by IS NULL").select("tokens").distinct(), min_support, min_confidence)
    return (parsed.join(matched, "tokens", "left")
            .select("id", "host", "path", F.col("by.rule").alias("rule"),
                    F.coalesce("by.verdict", F.when(F.col("confidence").isNotNull(), F.lit(BLOCK)), F.lit(ALLOW)).alias("verdict"),
                    F.when(F.col("by").isNull(), F.col("confidence")).alias("confidence")))


def _parsed(pages: DataFrame, url_col: str, id_col: str, curated: Sequence[CuratedRule]) -> DataFrame:
    url = F.col(url_col).cast("string")
    parsed = pages.select(F.col(id_col).cast("long").alias("id"), host_of(url).alias("host"), path_of(url).alias("path"),
                          query_of(url).alias("query"))
    return parsed.select("id", "host", "path", url_tokens(F.col("host"), F.col("path"), F.col("query")).alias("tokens"),
                         curated_rule(F.col("host"), F.col("path"), curated).alias("by"))


def _told(labels: DataFrame, label_id_col: str) -> DataFrame:
    """(id, label): of repeated label rows, one that says block wins."""
    bad = F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))
    return (labels.select(F.col(label_id_col).cast("long").alias("id"), bad.cast("int").alias("bad")).groupBy("id")
            .agg(F.when(F.max("bad") == 1, F.lit(BLOCK)).otherwise(F.lit(ALLOW)).alias("label")))


def _mined(parsed: DataFrame, told: DataFrame, sets: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """(tokens, confidence) of the token sets that a rule mined from the told
    pages fits."""
    labelled = checkpointed(parsed.join(told, "id").where(F.size("tokens") > 0)
                            .select(F.monotonically_increasing_id().alias("row"), "tokens", "label"))
    classes = checkpointed(token_classes(labelled, min_support))
    items = as_items(labelled, classes).select(F.col("items").alias("tokens"), "label")
    # pages without a frequent token count for the supports
    rest = labelled.join(as_items(labelled, classes), "row", "left_anti").select(F.array().cast("array<string>").alias("tokens"), "label")
    rules = mine_rules(items.unionByName(rest), min_support=min_support, min_confidence=min_confidence)
    shown = as_items(sets, classes)
    matched = match_rules(shown.select(F.col("items").alias("tokens")), rules)
    return shown.join(matched.withColumnRenamed("tokens", "items"), "items").select("tokens", "confidence")


def held_out_quality(pages: DataFrame, labels: DataFrame, url_col: str = "url", id_col: str = "page_id", label_id_col: str = "doc_id", *,
                     curated: Sequence[CuratedRule] = CURATED, min_support: float = 0.005, min_confidence: float = 0.8) -> DataFrame:
    """One row: how the mined rules do on labelled pages they were not mined
    from (a third, by the checksum of the id) and that no curated rule decides:
    ``pages``, ``bad`` ones, ``blocked`` and ``hits`` (bad and blocked);
    precision is hits / blocked, recall hits / bad."""
    parsed = checkpointed(_parsed(pages, url_col, id_col, curated))
    told = _told(labels, label_id_col).where("id IS NOT NULL")
    away = F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(3)) == 1
    asked = parsed.where("by IS NULL").join(told.where(away), "id").select("tokens", "label")
    matched = _mined(parsed, told.where(~away), asked.select("tokens").distinct(), min_support, min_confidence)
    bad, blocked = F.col("label") == BLOCK, F.col("confidence").isNotNull()
    return asked.join(matched, "tokens", "left").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(bad).alias("bad"), F.count_if(blocked).alias("blocked"), F.count_if(bad & blocked).alias("hits"))
