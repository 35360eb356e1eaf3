"""URL filters: stated host and path rules, then mined association rules (operator 5).

Everything here is DataFrame work: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stated rules: host and path, verdict.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: Mined rules up to this many are broadcast; more are joined by shuffle.
BROADCAST_RULES = 20_000
BLOCK, ALLOW = "verdict=block", "verdict=allow"


def parts(pages: DataFrame) -> DataFrame:
    """``pages`` columns page_id and url, with host and path."""
    rest = F.expr("CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END")
    return pages.select("page_id", "url", rest.alias("rest")).select(
        "page_id",
        "url",
        F.translate(F.regexp_extract("rest", r"\A([^/?#]*)", 1), UPPER, LOWER).alias("host"),
        F.regexp_extract("rest", r"\A[^/?#]*([^?#]*)", 1).alias("path"),
    )


def stated(rules: dict[str, str]) -> Column:
    """The longest rule that fits ``host`` or a domain above it and begins ``path``, or null."""
    fits = []
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        host, path = rule[: rule.index("/")], rule[rule.index("/") :]
        at = (F.col("host") == host) | F.col("host").endswith("." + host)
        fits.append(F.when(at & F.col("path").startswith(path), F.lit(rule)))
    return F.coalesce(*fits, F.lit(None).cast("string"))


def tokens() -> Column:
    """Distinct tokens of ``host`` and ``path``: domain labels, path words, digits as one mark."""
    labels = F.transform(F.split("host", r"\."), lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(F.split("path", r"[/._-]"), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, r"^[0-9]+$", "#")))
    return F.array_distinct(F.filter(F.concat(labels, words), lambda x: F.length(x) > 2))


def document() -> Column:
    """Number of the document that a page shows: the last part of ``path``, less any suffix."""
    return F.expr(r"try_cast(regexp_extract(path, '/([0-9]{1,18})(?:/|[.][a-z]+)?$', 1) AS BIGINT)")


def mine(labelled: DataFrame, support: float = 0.005, confidence: float = 0.9, lift: float = 1.02, least: int = 10) -> DataFrame:
    """Rules antecedent (array) -> verdict by FP-growth over ``tokens`` and ``label`` of labelled pages.

    Rows without a label take no part. ``support``, ``confidence`` and ``lift`` are the least of a
    rule, and ``least`` the fewest pages that it must fit. A rule whose antecedent has a proper part with at least its confidence for the same
    verdict adds nothing, and is pruned. No labelled rows give no rules.
    """
    goods = labelled.where("label is not null").select(F.concat("tokens", F.array("label")).alias("items"))
    floor = min(1.0, max(support, least / max(1, goods.count())))
    model = FPGrowth(itemsCol="items", minSupport=floor, minConfidence=confidence).fit(goods)
    found = model.associationRules.where(F.col("consequent")[0].isin(BLOCK, ALLOW)).select(
        F.array_sort("antecedent").alias("antecedent"), F.col("consequent")[0].alias("label"), "confidence", "support", "lift"
    )
    found = found.where(~F.array_contains("antecedent", BLOCK) & ~F.array_contains("antecedent", ALLOW))
    # a part of a rule is met by dropping each token in turn; the parts of frequent rules are frequent
    parts_of = found.select(
        "antecedent", "label", "confidence",
        F.explode(F.transform("antecedent", lambda x: F.array_remove(F.col("antecedent"), x))).alias("part"),
    )
    better = parts_of.join(
        found.select(F.col("antecedent").alias("part"), "label", F.col("confidence").alias("part_confidence")), ["part", "label"]
    ).where(F.col("part_confidence") >= F.col("confidence"))
    return found.where(F.col("lift") >= lift).join(better.select("antecedent", "label").distinct(), ["antecedent", "label"], "left_anti")


def judge(pages: DataFrame, labels: DataFrame | None = None, rules: dict[str, str] | None = None, support: float = 0.005, confidence: float = 0.9, lift: float = 1.02, least: int = 10) -> DataFrame:
    """page_id, host, path, rule and verdict of every row, then the mined rule's tokens and confidence.

    Association rules are mined from the labelled pages. A page's label is the verdict of the
    stated rule that fits it; or else that of the document it shows, if ``labels`` (doc_id,
    toxic) has one: block if toxic. Of a document with several labels any toxic one counts;
    nulls are no labels.

    Where no stated rule fits, an inverted index from tokens to mined rules finds those whose
    tokens a page all has; the most confident one decides (ties: larger support, then block,
    then the first tokens), and where none fits the page is allowed. Null urls and urls without
    ``://`` have empty host and path. An empty table gives no rows.
    """
    rules = rules or RULES
    told = F.create_map(*[F.lit(x) for kv in rules.items() for x in kv])
    base = parts(pages).withColumn("rule", stated(rules)).withColumn("tokens", tokens())
    label = F.when(F.col("rule").isNotNull(), F.concat(F.lit("verdict="), told[F.col("rule")]))
    labelled = base.where("rule is not null").select("tokens", label.alias("label"))
    if labels is not None:
        said = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.max("toxic").alias("toxic"))
        shown = base.where("rule is null").select("tokens", document().alias("doc")).join(said, "doc")
        labelled = labelled.union(shown.select("tokens", F.when(F.col("toxic") > 0, BLOCK).otherwise(ALLOW)))
    mined = mine(labelled, support, confidence, lift, least)
    # the rules are few by support, but that is checked: their number decides how they travel
    ranked = mined.select(F.xxhash64("antecedent", "label").alias("rule_id"), "*")
    index = ranked.select(
        F.explode("antecedent").alias("token"), "rule_id", F.size("antecedent").alias("needed"),
        F.struct("confidence", "support", F.col("label").alias("label"), "antecedent").alias("mined"),
    )
    if ranked.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    rows = base.select(F.monotonically_increasing_id().alias("row"), "page_id", "host", "path", "rule", "tokens")
    each = rows.select("row", "page_id", "host", "path", "rule", F.explode_outer(F.when(F.col("rule").isNull(), F.col("tokens"))).alias("token"))
    keys = ["row", "page_id", "host", "path", "rule"]
    hits = each.join(index, "token", "left").repartition("row").groupBy(*keys, "rule_id", "needed", "mined").agg(F.count("*").alias("met"))
    best = hits.groupBy(*keys).agg(F.max(F.when(F.col("met") == F.col("needed"), F.col("mined"))).alias("mined"))
    verdict = F.coalesce(told[F.col("rule")], F.regexp_replace(F.col("mined.label"), "^verdict=", ""), F.lit("allow"))
    return best.select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"),
        F.array_join("mined.antecedent", " ").alias("mined_tokens"), F.col("mined.confidence").alias("mined_confidence"),
    )
