"""URL filters: rules by host and path, and a path-template tree for what no rule decides.

Paths are cut into segments, runs of digits in them become one sign, and pages are counted by (host, shape); all that
follows works on these counts. Level by level, a child of a tree node stays literal if it holds enough of the node's
pages, else it becomes the wildcard. Literal siblings are merged where their labelled block rates do not differ
significantly. A template's block probability is its labelled share, smoothed towards its host's, which is smoothed
towards that of all pages; so a template without labelled pages has its host's. Templates that reach the threshold are
blocked. Labels are a column (1 bad, 0 good, null unknown). The verdicts of rules are no labels: they follow from the
path alone, and would convict the pages beside them. The query labels each page by what it holds: the quality
classifier, learnt from labelled documents, scores the page's visible text.

Null urls and urls without `://` have an empty host and path, fit no rule and are allowed. Repeated rows are kept; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import quality
from .common import checkpoint, materialize, spread_join

# The rules as (verdict, host and path prefix).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
DEPTH, LEAST_PAGES, LEAST_SHARE, DIFFERENCE, HOST_PRIOR, ALL_PRIOR, REJECT = 4, 3, 0.02, 1.96, 4.0, 8.0, 0.6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits the host or a domain above it, and the path's beginning; else null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        domain, _, prefix = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + prefix)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def verdict_of_rule(rule: Column, rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for verdict, name in rules:
        out = F.when(rule == name, F.lit(verdict)).otherwise(out)
    return out


def shape_of(path: Column) -> Column:
    return F.regexp_replace(path, "[0-9]+", "0")


def templates(pages: DataFrame, depth: int = DEPTH, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """host, shape, template, block (probability) and n (pages) of each shape; pages: host, path, bad (1, 0 or null)."""
    shapes = pages.groupBy("host", shape_of(pages["path"]).alias("shape")).agg(
        F.count("*").alias("n"), F.count("bad").alias("known"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    )
    shapes = checkpoint(shapes)
    parts = F.filter(F.split("shape", "/"), lambda s: s != "")
    tree = shapes.withColumn("parts", parts).withColumn("template", F.lit(""))
    for level in range(depth):
        tree = tree.withColumn("seg", F.coalesce(F.get("parts", F.lit(level)), F.lit("")))
        child = tree.groupBy("host", "template", "seg").agg(F.sum("n").alias("c"), F.sum("known").alias("k"), F.sum("bad").alias("b"))
        node = tree.groupBy("host", "template").agg(F.sum("n").alias("all"))
        child = child.where((F.col("seg") != "") & (F.col("c") >= least_pages)).join(node, ["host", "template"]).where(F.col("c") >= F.col("all") * least_share)
        # at most 1 / least_share literal children a node: siblings of like rates merge in the order of their rates
        beside = Window.partitionBy("host", "template").orderBy(F.col("rate"), "seg")
        child = child.withColumn("rate", F.when(F.col("k") > 0, F.col("b") / F.col("k")).otherwise(F.lit(-1.0)))
        k0, b0, r0 = (F.lag(c).over(beside) for c in ("k", "b", "rate"))
        both = (F.col("b") + b0) / F.greatest(F.col("k") + k0, F.lit(1))
        spread = F.sqrt(F.greatest(both * (1 - both) * (1 / F.greatest(F.col("k"), F.lit(1)) + 1 / F.greatest(k0, F.lit(1))), F.lit(0.0)))
        alike = (F.col("k") > 0) & (k0 > 0) & (F.abs(F.col("rate") - r0) <= DIFFERENCE * spread + 1e-12)
        child = child.withColumn("new", F.when(F.coalesce(alike, F.lit(False)), 0).otherwise(1))
        child = child.withColumn("group", F.sum("new").over(beside.rowsBetween(Window.unboundedPreceding, 0)))
        names = F.array_join(F.array_sort(F.collect_set("seg").over(Window.partitionBy("host", "template", "group"))), "|")
        child = child.select("host", "template", "seg", names.alias("literal"))
        tree = tree.join(child, ["host", "template", "seg"], "left")
        step = F.when(F.col("seg") == "", F.lit("")).otherwise(F.concat(F.lit("/"), F.coalesce("literal", F.lit("*"))))
        # each level reads the last one three times, so its plan is cut; the table has a row per shape, not per page
        tree = checkpoint(tree.withColumn("template", F.concat("template", step)).drop("literal", "seg"))
    tree = tree.withColumn("template", F.concat("template", F.when(F.size("parts") > depth, "/**").otherwise("")))
    total = shapes.agg((F.sum("bad") / F.greatest(F.sum("known"), F.lit(1))).alias("overall"))
    hosts = shapes.groupBy("host").agg(F.sum("known").alias("hk"), F.sum("bad").alias("hb")).crossJoin(F.broadcast(total))  # one row
    hosts = hosts.select("host", ((F.col("hb") + ALL_PRIOR * F.coalesce("overall", F.lit(0.0))) / (F.col("hk") + ALL_PRIOR)).alias("host_rate"))
    per = tree.groupBy("host", "template").agg(F.sum("known").alias("tk"), F.sum("bad").alias("tb")).join(hosts, "host")
    rate = (F.col("tb") + HOST_PRIOR * F.col("host_rate")) / (F.col("tk") + HOST_PRIOR)
    per = per.select("host", "template", rate.alias("block"))
    return tree.select("host", "shape", "template", "n").join(per, ["host", "template"])


def visible_text(html: Column) -> Column:
    """The text between tags, without scripts, styles and comments."""
    return F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>", " ")


def labelled(pages: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, url and bad of every page: 1 where the quality classifier rejects its visible text, null without html."""
    rows = pages.select("page_id", "url", pages["html"].isNotNull().alias("known"), visible_text(pages["html"]).alias("text"))
    scored = quality.with_score(rows, quality.train(docs, labels))
    return scored.select("page_id", "url", F.when(F.col("known"), (F.col("score") < quality.THRESHOLD).cast("long")).alias("bad"))


def judge(pages: DataFrame, rules=RULES, reject: float = REJECT, label: str | None = None) -> DataFrame:
    """page_id, host, path, rule, template and verdict of every page; `label` names the column of labels, if there is one."""
    host, path = host_and_path(pages["url"])
    bad = pages[label].cast("long") if label else F.lit(None).cast("long")
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), bad.alias("bad"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("shape", shape_of(F.col("path")))
    rows = materialize(rows, "urls")
    ruled = verdict_of_rule(F.col("rule"), rules)
    rows = spread_join(rows, materialize(templates(rows.select("host", "path", "bad")), "templates"), ["host", "shape"], "n")
    verdict = F.coalesce(ruled, F.when(F.col("block") >= reject, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template")
