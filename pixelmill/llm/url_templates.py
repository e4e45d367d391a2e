"""Operator 2: URL filters by a path-template tree.

Listed rules come first. For all other URLs, each host's paths form a tree that is generalised level by level: a
segment that too small a share of its parent's pages has becomes a wildcard, the others stay. Templates of one shape
under a host are branches; those whose labelled share of bad pages doesn't differ significantly from that of all
branches of the shape are merged into one. A template is rejected if its smoothed share of bad labels says that a page
of it is likelier bad than good. Smoothing draws templates with few labels to the share of all labels, by as many
labels' worth as the labels themselves call for: the more the branches differ beyond chance, the less. Where they
don't differ beyond chance, all are drawn to the share of all labels, and nothing is rejected unless most labels are bad.

Counts are taken over all URLs, distinct paths first, with partial sums before each shuffle; a host with most of the
rows is one key of sums only. A level is generalised in a round of its own; only paths that have a further segment and
share their template so far with enough pages go on, as no segment of the others can stay. So there are as many rounds
as the deepest template with a literal has levels, whatever the deepest URL has.

Defined results: a null URL, or one without ://, has an empty host and path and is allowed; several labels of a page
count as their mean; labels of pages that aren't there don't count; without labels nothing is rejected but by rule;
repeated rows count as often as they stand; a null page_id has no label; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Holds for a host and all its subdomains where the path begins with the rule's."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


@dataclass(frozen=True)
class Shape:
    """How templates are made and judged."""

    #: A segment stays literal with this share of its parent's pages and this many of them at least.
    literal_share: float = 0.05
    literal_pages: int = 5
    #: Branches merge if they are within so many standard deviations of the pooled share.
    merge_deviations: float = 1.5
    #: Labels' worth of the overall share that each template is drawn to, at least.
    smoothing: float = 1.0
    reject: float = 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def by_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. The rules are a short list."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        name, verdict = F.when(r.fits(host, path), r.text).otherwise(name), F.when(r.fits(host, path), r.verdict).otherwise(verdict)
    return name, verdict


def templates(paths: DataFrame, how: Shape) -> DataFrame:
    """paths (host, path, n, labelled, bad) with their template."""
    segments = F.split(F.expr("if(startswith(path, '/'), substring(path, 2), path)"), "/", -1)
    now, done, level = written(paths.withColumn("segments", segments).withColumn("template", F.lit("")), "templates"), [], 0
    while True:
        counts = now.groupBy("host", "template", F.get("segments", F.lit(level)).alias("segment")).agg(F.sum("n").alias("c"))
        total = counts.groupBy("host", "template").agg(F.sum("c").alias("t"))
        literal = counts.join(total, ["host", "template"]).where((F.col("c") >= how.literal_pages) & (F.col("c") >= F.col("t") * how.literal_share)).select("host", "template", "segment", F.lit(True).alias("literal"))
        now = now.withColumn("segment", F.get("segments", F.lit(level))).join(literal, ["host", "template", "segment"], "left")
        now = now.withColumn("template", F.concat("template", F.lit("/"), F.when(F.col("literal"), F.col("segment")).otherwise("*")))
        level += 1
        # what goes on: further segments, under a template with pages enough for a literal
        pages = now.where(F.size("segments") > level).groupBy("host", "template").agg(F.sum("n").alias("pages")).where(F.col("pages") >= how.literal_pages).select("host", "template", F.lit(True).alias("on"))
        now = written(now.drop("segment", "literal").join(pages, ["host", "template"], "left").withColumn("on", F.coalesce("on", F.lit(False)) & (F.size("segments") > level)), "templates")
        wild = F.repeat(F.lit("/*"), F.greatest(F.lit(0), F.size("segments") - level))
        done.append(now.where("not on").withColumn("template", F.concat("template", wild)))
        now = now.where("on").drop("on")
        if now.isEmpty():
            return reduce(DataFrame.unionByName, done).select("host", "path", "n", "labelled", "bad", "template")


def drawn(groups: DataFrame, least: float) -> Column:
    """How many labels' worth the groups (l labels, b bad, prior) are drawn to the prior; as an aggregate.

    By moments: sums of squared deviations beyond those of chance, relative to what they would be if all labels of a
    group were alike, give the correlation of labels inside groups.
    """
    chance = F.col("prior") * (1 - F.col("prior"))
    beyond = F.sum(F.pow(F.col("b") - F.col("l") * F.col("prior"), 2) - F.col("l") * chance)
    alike = F.least(F.lit(1.0), beyond / F.nullif(F.sum(F.col("l") * (F.col("l") - 1) * chance), F.lit(0.0)))
    return F.greatest(F.lit(least), F.coalesce(F.when(alike > 0, (1 - alike) / alike), F.lit(1e12)))


def judged(paths: DataFrame, how: Shape) -> DataFrame:
    """(host, path, template, purity, rejected): purity is the smoothed share of bad labels of the (merged) template."""
    named = templates(paths, how)
    rows = written(named.withColumn("shape", F.regexp_replace("template", "/[^/*]+", "/+")), "named")
    each = rows.groupBy("host", "shape", "template").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    pool = rows.groupBy("host", "shape").agg(F.sum("labelled").alias("all_l"), F.sum("bad").alias("all_b"))
    each = each.join(pool, ["host", "shape"])
    share = F.when(F.col("all_l") > 0, F.col("all_b") / F.col("all_l")).otherwise(0.0)
    spread = F.sqrt(F.col("l") * share * (1 - share))
    each = each.withColumn("alike", F.abs(F.col("b") - F.col("l") * share) <= spread * how.merge_deviations + 1e-9)
    branch = F.when(F.col("alike"), F.col("shape")).otherwise(F.col("template"))
    each = written(each.select("host", "shape", "template", "l", "b", branch.alias("branch")), "branches")
    overall = F.broadcast(rows.agg(F.coalesce(F.sum("bad") / F.nullif(F.sum("labelled"), F.lit(0)), F.lit(0.0)).alias("prior")))  # one row
    sums = written(each.groupBy("host", "branch").agg(F.sum("l").alias("l"), F.sum("b").alias("b")).crossJoin(overall), "sums")
    sums = sums.crossJoin(F.broadcast(sums.agg(drawn(sums, how.smoothing).alias("worth"))))  # one row
    purity = (F.col("b") + F.col("prior") * F.col("worth")) / (F.col("l") + F.col("worth"))
    verdicts = each.select("host", "template", "branch").join(sums.select("host", "branch", purity.alias("purity")), ["host", "branch"])
    return rows.join(verdicts, ["host", "template"]).select("host", "path", "template", "branch", "purity", (F.col("purity") >= how.reject).alias("rejected"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[Rule], how: Shape = Shape()) -> DataFrame:
    """One row for each page. labels: (page_id, bad), bad from 0 to 1."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = written(rows.join(labels.groupBy("page_id").agg(F.avg("bad").alias("bad")), "page_id", "left"), "urls")
    paths = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad"))
    found = rows.drop("bad").join(judged(written(paths, "paths"), how), ["host", "path"])
    rule, verdict = by_rule(rules, F.col("host"), F.col("path"))
    method = F.when(F.col("rejected"), "block").otherwise("allow")
    return found.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "template", "branch", "purity")
