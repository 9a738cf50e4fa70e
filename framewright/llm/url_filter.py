"""URL filters with DataFrame functions only: rules first, then a path-template tree for each host, judged by smoothed labelled purity."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._session import written

#: (verdict, host, path prefix); a rule fits its host and all subdomains, the longest one wins.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

#: A position of a host's tree with more different segments than this becomes a wildcard.
MOST_BRANCHES = 12
#: Levels of the tree; what lies deeper is one last segment.
DEPTH = 6
#: Labelled urls that the share of the level above counts for, and the share of bad ones from which a template is rejected.
PRIOR = 8
REJECT_FROM = 0.75
#: Sibling templates whose shares of bad urls differ by fewer standard errors than this are one branch.
ALIKE_BELOW = 1.96


def host_of(url: Column) -> Column:
    after = F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    return F.coalesce(F.translate(after, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    after = F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1))
    return F.coalesce(after, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest fitting rule, or null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in reversed(ordered):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def shape_of(path: Column) -> Column:
    """The segments of a path with digits, hashes and long identifiers as wildcards; the ones below DEPTH together."""
    marked = F.regexp_replace(F.regexp_replace(path, r"[0-9a-fA-F]{8}[0-9a-fA-F-]{8,}", "*"), r"[0-9]+", "*")
    parts = F.filter(F.split(marked, "/", -1), lambda s: s != "")
    deep = F.array_join(F.slice(parts, DEPTH, F.greatest(F.size(parts) - DEPTH + 1, F.lit(0))), "|")
    return F.when(F.size(parts) > DEPTH, F.concat(F.slice(parts, 1, DEPTH - 1), F.array(deep))).otherwise(parts)


def domain_of(host: Column) -> Column:
    """The last two labels of a host, as its owner's domain."""
    return F.substring_index(host, ".", -2)


def generalised(leaves: DataFrame) -> DataFrame:
    """``leaves`` (host, shape, ...) with ``template``: level by level, a position with too many branches becomes a wildcard."""
    tree = leaves.withColumn("template", F.lit(""))
    for level in range(leaves.agg(F.max(F.size("shape"))).first()[0] or 0):
        seg = F.get("shape", F.lit(level))
        wide = tree.where(seg.isNotNull()).groupBy("host", "template").agg(F.countDistinct(seg).alias("branches"))
        wide = wide.where(F.col("branches") > MOST_BRANCHES).select("host", "template", F.lit(True).alias("wide"))
        tree = tree.join(wide, ["host", "template"], "left")
        step = F.when(F.col("wide"), F.lit("*")).otherwise(seg)
        tree = tree.withColumn("template", F.when(seg.isNotNull(), F.concat("template", F.lit("/"), step)).otherwise(F.col("template"))).drop("wide")
        tree = written(tree, "url-tree")  # each level reads the one above twice
    return tree


def branches(nodes: DataFrame) -> DataFrame:
    """``nodes`` (host, template, bad, labelled) with ``parent`` and ``branch``: siblings whose shares of bad labels do not differ.

    Labelled siblings, at most MOST_BRANCHES and a wildcard, stand in order of their shares; neighbours are compared by the
    test of two shares, and a clear difference begins a new branch. One without labels has nothing to be alike by: its branch
    is null.
    """
    nodes = nodes.withColumn("parent", F.regexp_replace("template", r"/[^/]*$", ""))
    by = "PARTITION BY host, parent ORDER BY bad / labelled, template"
    known = nodes.where("labelled > 0").withColumn("b", F.expr(f"lag(bad) OVER ({by})")).withColumn("l", F.expr(f"lag(labelled) OVER ({by})"))
    both = (F.col("bad") + F.col("b")) / (F.col("labelled") + F.col("l"))
    error = F.sqrt(F.greatest(both * (1 - both), F.lit(1e-6)) * (1 / F.col("labelled") + 1 / F.col("l")))
    new = F.coalesce((F.col("bad") / F.col("labelled") - F.col("b") / F.col("l")) / error >= ALIKE_BELOW, F.lit(True))
    known = known.withColumn("new", new.cast("int")).withColumn("branch", F.expr(f"sum(new) OVER ({by})")).drop("b", "l", "new")
    return known.unionByName(nodes.where("labelled = 0").withColumn("branch", F.lit(None).cast("long")))


def template_tree(urls: DataFrame) -> DataFrame:
    """(host, shape, template, purity, labels) for each host and shape of ``urls`` (host, shape, bad); bad is 1, 0 or null (not labelled).

    Counts are gathered once for each host and shape, so a host with a third of all urls is a few rows. A branch's purity, its
    share of bad labels, is smoothed by that of its template over its domain, that by the template over all hosts, that by the
    whole table: so a template that has no label on its own host is judged by what it is elsewhere. ``labels`` is how many
    labels these levels have, without the whole table's.
    """
    leaves = written(urls.groupBy("host", "shape").agg(F.sum(F.coalesce("bad", F.lit(0))).alias("bad"), F.count("bad").alias("labelled")), "url-leaves")
    tree = generalised(leaves)
    nodes = branches(tree.groupBy("host", "template").agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"))).withColumn("domain", domain_of(F.col("host")))
    nodes = written(nodes, "url-nodes")
    sums = lambda rows, name, *by: rows.groupBy(*by).agg(F.sum("bad").alias(f"b_{name}"), F.sum("labelled").alias(f"l_{name}"))
    whole = leaves.agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled")).first()
    share = whole["bad"] / whole["labelled"] if whole["labelled"] else 0.0
    every, near = sums(nodes, "t", "template"), sums(nodes, "d", "domain", "template")
    own = sums(nodes.where("branch IS NOT NULL"), "h", "host", "parent", "branch")
    rows = nodes.join(every, "template").join(near, ["domain", "template"]).join(own, ["host", "parent", "branch"], "left").na.fill(0, ["b_h", "l_h"])
    for name in "tdh":
        rows = rows.withColumn(f"p_{name}", (F.col(f"b_{name}") + PRIOR * (F.lit(share) if name == "t" else F.col("p_t" if name == "d" else "p_d"))) / (F.col(f"l_{name}") + PRIOR))
    rows = rows.select("host", "template", F.col("p_h").alias("purity"), F.greatest("l_t", "l_h").alias("labels"))
    return tree.select("host", "shape", "template").join(rows, ["host", "template"]).select("host", "shape", "template", "purity", "labels")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], labels: DataFrame | None = None) -> DataFrame:
    """Every row of ``pages`` (page_id, url) with host, path, rule, template, purity and verdict.

    A fitting rule decides; else the template of the url's host does: block if its smoothed share of bad labels is at least
    REJECT_FROM and some label, on its host or elsewhere, speaks of the template; the whole table's share never blocks alone.
    Labels are the rules' own verdicts, or ``labels`` (url, bad 0/1) where given. Null and odd urls have an empty host and
    path, and are judged alike; repeated rows stay; an empty table gives no rows; other columns are ignored.
    """
    parts = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = parts.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).withColumn("shape", shape_of(F.col("path")))
    if labels is None:
        learned = parts.select("host", "shape", F.when(F.col("found.verdict") == "block", 1).when(F.col("found.verdict") == "allow", 0).alias("bad"))
    else:
        given = labels.select(host_of(F.col("url")).alias("host"), shape_of(path_of(F.col("url"))).alias("shape"), F.col("bad").cast("int").alias("bad"))
        learned = parts.select("host", "shape", F.lit(None).cast("int").alias("bad")).unionByName(given)
    tree = template_tree(learned)
    bad = (F.col("purity") >= REJECT_FROM) & (F.col("labels") > 0)
    verdict = F.coalesce(F.col("found.verdict"), F.when(bad, "block").otherwise("allow"))
    return parts.join(tree, ["host", "shape"], "left").select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")


def report(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of each row by RULES; labels are the rules' verdicts. Edge cases as in ``judge``."""
    return judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


def oracle(rules: list[tuple[str, str, str]]) -> str:
    """The report in DuckDB: the same rules, tree, tests and smoothing over the view ``pages``."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    rule = " ".join(f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p}'" for _, h, p in ordered)
    ruling = " ".join(f"WHEN '{h + p}' THEN '{v}'" for v, h, p in ordered)
    levels = [
        f"""t{i + 1} AS (SELECT x.host, shape, bad, labelled, CASE WHEN len(shape) > {i} THEN template || '/' || CASE WHEN wide THEN '*' ELSE shape[{i + 1}] END ELSE template END AS template
    FROM t{i} x LEFT JOIN (SELECT host, template, true AS wide FROM t{i} WHERE len(shape) > {i} GROUP BY ALL HAVING count(DISTINCT shape[{i + 1}]) > {MOST_BRANCHES}) w USING (host, template))"""
        for i in range(DEPTH)
    ]
    return rf"""
WITH split AS (
    SELECT page_id, row_number() OVER () AS r, coalesce(CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') END, '') AS host,
        coalesce(CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) END, '') AS path
    FROM pages
), ruled AS (
    SELECT *, CASE {rule} END AS rule, list_filter(string_split(regexp_replace(regexp_replace(path, '[0-9a-fA-F]{{8}}[0-9a-fA-F-]{{8,}}', '*', 'g'), '[0-9]+', '*', 'g'), '/'), lambda s: s <> '') AS segments FROM split
), parts AS (
    SELECT *, CASE rule {ruling} END AS ruling, CASE WHEN len(segments) > {DEPTH} THEN list_append(segments[1 : {DEPTH - 1}], array_to_string(segments[{DEPTH} :], '|')) ELSE segments END AS shape FROM ruled
), t0 AS (
    SELECT host, shape, count(*) FILTER (ruling = 'block') AS bad, count(ruling) AS labelled, '' AS template FROM parts GROUP BY host, shape
), {", ".join(levels)},
nodes AS (
    SELECT host, template, sum(bad)::DOUBLE AS bad, sum(labelled)::DOUBLE AS labelled, regexp_replace(template, '/[^/]*$', '') AS parent, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain
    FROM t{DEPTH} GROUP BY host, template
), beside AS (
    SELECT *, lag(bad) OVER w AS b, lag(labelled) OVER w AS l FROM nodes WHERE labelled > 0 WINDOW w AS (PARTITION BY host, parent ORDER BY bad / labelled, template)
), told AS (
    SELECT *, CASE WHEN l IS NULL THEN 1 WHEN (bad / labelled - b / l) / sqrt(greatest((bad + b) / (labelled + l) * (1 - (bad + b) / (labelled + l)), 1e-6) * (1 / labelled + 1 / l)) >= {ALIKE_BELOW} THEN 1 ELSE 0 END AS fresh FROM beside
), grouped AS (
    SELECT host, template, sum(fresh) OVER (PARTITION BY host, parent ORDER BY bad / labelled, template) AS branch, parent, bad, labelled FROM told
), own AS (SELECT host, parent, branch, sum(bad) AS b, sum(labelled) AS l FROM grouped GROUP BY ALL),
whole AS (SELECT coalesce(sum(bad) / nullif(sum(labelled), 0), 0) AS share FROM nodes),
every AS (SELECT template, sum(labelled) AS l, (sum(bad) + {PRIOR} * any_value(share)) / (sum(labelled) + {PRIOR}) AS p FROM nodes, whole GROUP BY template),
near AS (SELECT domain, template, (sum(bad) + {PRIOR} * any_value(every.p)) / (sum(labelled) + {PRIOR}) AS p FROM nodes JOIN every USING (template) GROUP BY domain, template),
scored AS (
    SELECT n.host, n.template, (coalesce(own.b, 0) + {PRIOR} * near.p) / (coalesce(own.l, 0) + {PRIOR}) AS purity, greatest(every.l, coalesce(own.l, 0)) AS labels
    FROM nodes n JOIN every USING (template) JOIN near USING (domain, template) LEFT JOIN grouped g ON g.host = n.host AND g.template = n.template LEFT JOIN own ON own.host = g.host AND own.parent = g.parent AND own.branch = g.branch
)
SELECT page_id, parts.host, path, rule, coalesce(ruling, CASE WHEN purity >= {REJECT_FROM} AND labels > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM parts JOIN t{DEPTH} USING (host, shape) JOIN scored ON scored.host = t{DEPTH}.host AND scored.template = t{DEPTH}.template
"""


ORACLE = oracle(RULES)
