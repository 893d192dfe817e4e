"""URL filters: rules for hosts and paths first, then a tree of path templates judged by labelled urls.

Each path is cut at its slashes and goes down its host's tree. Among the children of a node, those with a fair share of its
paths keep their names; the others (page numbers, slugs), if they are several, become one wildcard. Named siblings are compared
with the rest of their kind, by the whole subtrees below them: their share of bad urls, and the shape that most of their paths
have. Those that do not differ by more than chance are merged, and so are their descendants. A sibling without labels is not
compared and keeps its name.

A template's purity is the share of bad ones among its labelled urls, smoothed towards its parent's purity, and so on up to
the share over all hosts. The deepest part of a template with enough labelled urls decides: where its purity reaches the
threshold, all urls that it covers are rejected. A url whose template has too few labels at every level is allowed.

Labels are given; for pages with texts, ``labelled_pages`` takes the base quality verdict of their visible text. A rule's verdict
is final for the urls that it fits and says nothing about others.

Every level is a grouped count that is combined before the shuffle: a host that holds a third of all urls costs one row per
distinct node and task, and no host's urls are ever gathered.

A null url, or one without ``://``, has an empty host and path and is judged like any other. Repeated rows are judged alike
and each returned; labels of urls that no row has play no part, and of several labels of one id the bad one counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quality
from .common import stored

#: (verdict, host suffix, path prefix)
RULES: tuple[tuple[str, str, str], ...] = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Levels of a tree; what lies deeper is one last segment.
LEVELS = 8
WILD = "*"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """``(rule, verdict)`` of the longest rule that fits, else null: host and path taken together, and the first given of equals."""
    order = sorted(rules, key=lambda r: -len(r[1] + r[2]))

    def fits(r: tuple[str, str, str]) -> Column:
        return ((host == r[1]) | host.endswith("." + r[1])) & path.startswith(r[2])

    nothing = F.lit(None).cast("struct<rule:string,verdict:string>")
    return reduce(lambda rest, r: F.when(fits(r), F.struct(F.lit(r[1] + r[2]).alias("rule"), F.lit(r[0]).alias("verdict"))).otherwise(rest), reversed(order), nothing)


def segments(path: Column) -> Column:
    """The path's segments, the ones past ``LEVELS`` joined; a last empty one (a closing slash) is dropped."""
    parts = F.split(F.regexp_replace(F.regexp_replace(path, "^/", ""), "/$", ""), "/")
    return F.when(F.size(parts) <= LEVELS, parts).otherwise(F.concat(F.slice(parts, 1, LEVELS - 1), F.array(F.array_join(F.slice(parts, F.lit(LEVELS), F.size(parts)), "/"))))


def shape(rest: Column) -> Column:
    """What the segments below a node look like: ``9`` for digits, ``a`` for letters, runs taken together."""
    text = F.array_join(rest, "/")
    return F.regexp_replace(F.regexp_replace(text, r"\p{N}+", "9"), r"[\p{L}_]+", "a")


def labelled_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, bad)``: pages with 1 where the base quality rules reject their visible text (a null page is an empty text)."""
    tagless = F.regexp_replace(F.coalesce(F.col(html_col).cast("string"), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    visible = F.regexp_replace(F.regexp_replace(tagless, r"(?i)<(br|/p|/h\d|/li|/div)\b[^>]*>", "\n"), r"<[^>]*>", "")
    measured = quality.measure(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), visible.alias("text")), "text", ("id", "url"))
    return quality.ledger(measured).select(F.col("id").alias(id_col), F.col("url").alias(url_col), (~quality.passes(quality.BASE)).cast("int").alias("bad"))


def _level(rows: DataFrame, level: int, fanout: int, z: float) -> DataFrame:
    """The template of each path one segment longer: ``rows`` hold ``host, path, seg, template, bad, labelled``."""
    at = F.get("seg", F.lit(level))
    below = F.slice("seg", F.lit(level + 2), F.greatest(F.size("seg") - level - 1, F.lit(0)))
    open_ = rows.where(F.size("seg") > level)
    by_shape = open_.groupBy("host", "template", at.alias("child"), shape(below).alias("shape")).agg(F.count("*").alias("n"), F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"))
    most = F.max(F.struct("n", F.col("shape").alias("s")))["s"]
    nodes = stored(by_shape.groupBy("host", "template", "child").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"), most.alias("shape")), "nodes")
    parents = nodes.groupBy("host", "template").agg(F.sum("n").alias("all_n"), F.count("*").alias("children"), F.count_if(F.col("n") == 1).alias("singles"))
    # variable segments: those of one path, and of many children those with less than an even share of so many
    variable = ((F.col("n") == 1) & (F.col("singles") > 1)) | ((F.col("children") > fanout) & (F.col("n") * fanout < F.col("all_n")))
    # from a stored table, so that Spark may split the rows of a node with many children
    named = nodes.join(stored(parents, "parents").hint("merge"), ["host", "template"]).withColumn("variable", variable)
    mostly = (2 * F.col("bad") > F.col("labelled")).alias("mostly")
    kin = ["host", "template", "shape", "mostly"]
    kept = named.where(~F.col("variable")).select("host", "template", "child", "shape", mostly, "bad", "labelled")
    pool = kept.where("labelled > 0").groupBy(*kin).agg(F.sum("bad").alias("pool_bad"), F.sum("labelled").alias("pool_labelled"), F.count("*").alias("siblings"))
    met = kept.join(pool, kin, "left")
    # against the others of its kind, itself left out
    others, bad_others = F.col("pool_labelled") - F.col("labelled"), F.col("pool_bad") - F.col("bad")
    share = (F.col("pool_bad") + 0.5) / (F.col("pool_labelled") + 1.0)
    error = F.sqrt(share * (1 - share) * (1 / F.col("labelled") + 1 / others))
    alike = F.coalesce((F.col("siblings") > 1) & (F.col("labelled") > 0) & (F.abs(F.col("bad") / F.col("labelled") - bad_others / others) <= z * error), F.lit(False))
    branch = F.when(alike, F.concat(F.lit("{"), F.when(F.col("mostly"), "bad ").otherwise(""), F.lit("like "), F.col("shape"), F.lit("}"))).otherwise(F.col("child"))
    names = named.where("variable").select("host", "template", "child", F.lit(WILD).alias("name")).unionByName(met.select("host", "template", "child", branch.alias("name")))
    longer = open_.withColumn("child", at).join(names, ["host", "template", "child"])
    grown = longer.select("host", "path", "seg", F.concat("template", F.array("name")).alias("template"), "bad", "labelled")
    return grown.unionByName(rows.where(F.size("seg") <= level))


def templates(paths: DataFrame, fanout: int = 12, z: float = 1.96) -> DataFrame:
    """``(host, path, template, bad, labelled)``: distinct paths with their templates.

    ``paths``: distinct ``host, path, bad, labelled``. A node's children of a single path become a wildcard if they are two or
    more, and those with less than ``1 / fanout`` of its paths when it has more than ``fanout`` children; siblings are merged that are within ``z`` standard errors.
    """
    rows = paths.select("host", "path", segments(F.col("path")).alias("seg"), F.array().cast("array<string>").alias("template"), "bad", "labelled")
    depth = min(LEVELS, rows.agg(F.max(F.size("seg"))).first()[0] or 0)
    for level in range(depth):
        rows = stored(_level(rows, level, fanout, z), "templates")
    return rows.select("host", "path", "template", "bad", "labelled")


def purities(found: DataFrame, strength: float, least: int) -> DataFrame:
    """``(host, template, purity, support, judged)`` of every template: the smoothed purity and labelled urls of its deepest part
    that has ``least`` of them, and whether there is one (else of the whole template)."""
    counted = stored(found.groupBy("host", "template").agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled")), "counted")
    parts = F.transform(F.sequence(F.lit(0), F.size("template")), lambda k: F.slice("template", F.lit(1), k))
    nodes = stored(counted.select("host", F.explode(parts).alias("part"), "bad", "labelled").groupBy("host", "part").agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled")), "nodes")
    bad, labelled = counted.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("labelled"), F.lit(0))).first()
    # without labels a url is presumed good
    scored = counted.select("host", "template", F.lit((bad + 0.1) / (labelled + 2.0)).alias("purity"), F.lit(0).cast("long").alias("support"), F.lit(False).alias("judged"), F.lit(None).cast("double").alias("ruling"))
    depth = nodes.agg(F.max(F.size("part"))).first()[0] or 0
    for level in range(depth + 1):
        step = nodes.where(F.size("part") == level).select("host", "part", "bad", "labelled")
        joined = scored.withColumn("part", F.when(F.size("template") >= level, F.slice("template", 1, level))).join(step, ["host", "part"], "left")
        there = F.col("labelled").isNotNull()
        purity = F.when(there, (F.col("bad") + strength * F.col("purity")) / (F.col("labelled") + strength)).otherwise(F.col("purity"))
        enough = F.coalesce(F.col("labelled") >= least, F.lit(False)) & F.lit(level > 0)  # a whole host is no template
        scored = joined.select("host", "template", purity.alias("purity"), F.when(enough | (there & ~F.col("judged")), F.col("labelled")).otherwise(F.col("support")).alias("support"), (F.col("judged") | enough).alias("judged"), F.when(enough, purity).otherwise(F.col("ruling")).alias("ruling"))
    return stored(scored.select("host", "template", F.coalesce("ruling", "purity").alias("purity"), "support", "judged"), "purity")


def judge(pages: DataFrame, labels: DataFrame | None = None, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = 0.5, strength: float = 8.0, least: int = 5, id_col: str = "page_id", url_col: str = "url", bad_col: str | None = None) -> DataFrame:
    """``(id, host, path, rule, verdict, template, purity, support)`` for every row.

    ``labels``: ``(id, bad)``; or ``bad_col`` is a column of ``pages`` with the labels (1, 0 or null). ``strength``: how many labelled urls the parent's purity counts for. ``least``: how many labelled
    urls the part of a template that decides has.
    """
    url = F.col(url_col)
    bad = F.col(bad_col) if bad_col else F.lit(None)
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), bad.cast("int").alias("bad"))
    if labels is not None:
        told = labels.select(F.col("id").alias("_id"), F.col("bad").cast("int").alias("_bad")).where("_bad is not null").groupBy("_id").agg(F.max("_bad").alias("_bad"))
        rows = rows.join(told, F.col("id") == F.col("_id"), "left").select("id", "host", "path", F.coalesce("_bad", "bad").alias("bad"))
    rows = stored(rows, "urls")
    paths = stored(rows.groupBy("host", "path").agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count("bad").alias("labelled")), "paths")
    found = templates(paths)
    verdicts = found.select("host", "path", "template").join(purities(found, strength, least), ["host", "template"])
    out = rows.join(verdicts, ["host", "path"], "left").withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    rejected = F.col("judged") & (F.col("purity") >= threshold)
    verdict = F.coalesce(F.col("fit.verdict"), F.when(rejected, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), F.round("purity", 9).alias("purity"), "support")
