"""URL filter: a tree of path templates for every host, and rules that come before it.

Level by level, segments that few urls of a node share become a wildcard, siblings whose labels agree statistically are
merged, and a url gets the template of the node that it reaches. A template is blocked by its smoothed share of blocked
urls. Only DataFrame operations are used; a node is known by its counts, never by its urls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Squared normal quantile: siblings are told apart at 10 per cent, two-sided.
APART = 2.706


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, its A-Z lower-cased, and path of a url; both empty without ``://`` and for null."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name (host and path) and verdict of the longest rule (host, path, verdict) that fits; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def _smoothed(of: str, weight: float) -> str:
    """SQL: the share of blocked urls among the labelled ones, with ``weight`` more of the parent's share."""
    return f"(CAST({of}blocked AS DOUBLE) + {weight!r}D * parent) / (CAST({of}labelled AS DOUBLE) + {weight!r}D)"


NONE = "CAST(array() AS ARRAY<STRUCT<segment: STRING, labelled: BIGINT, blocked: BIGINT, n: BIGINT>>)"
#: All other children of a node as one, without a segment.
_REST = "struct(CAST(NULL AS STRING) AS segment, %s)" % ", ".join(f"all_{c} - aggregate(kept, 0L, (s, x) -> s + x.{c}) AS {c}" for c in ("labelled", "blocked", "n"))
#: Children in the order of their share of blocked urls, those without labels last.
SIBLINGS = f"""array_sort(transform(filter(concat(kept, array({_REST})), x -> x.n > 0), x -> struct(x.labelled = 0 AS unknown,
 IF(x.labelled = 0, 0D, x.blocked / CAST(x.labelled AS DOUBLE)) AS rate, x.segment AS segment, x.labelled AS labelled, x.blocked AS blocked)))"""
_A, _N, _B, _M = (f"CAST({of}.{c} AS DOUBLE)" for of in ("get(acc, size(acc) - 1)", "x") for c in ("blocked", "labelled"))
#: Two groups whose shares of blocked urls differ, by the chi-square of their counts.
_DIFFER = f"{_A} * {_M} <> {_B} * {_N} AND ({_A} * {_M} - {_B} * {_N}) * ({_A} * {_M} - {_B} * {_N}) * ({_N} + {_M}) >= {APART}D * {_N} * {_M} * ({_A} + {_B}) * ({_N} + {_M} - {_A} - {_B})"
#: Each child in turn joins the group before it unless the two differ; those without labels make a group of their own.
GROUPS = f"""aggregate(siblings, CAST(array() AS ARRAY<STRUCT<segments: ARRAY<STRING>, labelled: BIGINT, blocked: BIGINT>>), (acc, x) ->
 IF(size(acc) = 0 OR (get(acc, size(acc) - 1).labelled = 0) <> (x.labelled = 0) OR ({_DIFFER}), concat(acc, array(struct(array(x.segment) AS segments, x.labelled AS labelled, x.blocked AS blocked))),
 concat(slice(acc, 1, size(acc) - 1), array(struct(concat(get(acc, size(acc) - 1).segments, array(x.segment)) AS segments, get(acc, size(acc) - 1).labelled + x.labelled AS labelled, get(acc, size(acc) - 1).blocked + x.blocked AS blocked)))))"""
#: A branch's name; signs with a meaning of their own are written as in urls.
SHOWN = "array_join(array_sort(transform(x.segments, s -> coalesce(replace(replace(replace(s, '%', '%25'), '*', '%2A'), '|', '%7C'), '*'))), '|')"
OWN_BRANCH = "IF(segment IS NULL, NULL, coalesce(get(filter(branches, b -> array_contains(b.segments, segment)), 0), get(filter(branches, b -> exists(b.segments, s -> s IS NULL)), 0)))"


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], depth: int = 4, share: float = 0.05, least: int = 3, weight: float = 2.0, purity: float = 0.5, label: str | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, blocked_share) for every row of ``pages(page_id, url)``.

    ``rules`` are (host, path, ``allow`` or ``block``); they are part of the plan, so give them by the hundred at most. The
    longest one that fits decides. Other urls are judged by their template: ``block`` where its smoothed share of blocked
    urls is ``purity`` or more. Urls are labelled by the boolean column ``label`` of ``pages`` where it is given and not
    null, else by the rule that fits them.

    Templates are paths of at most ``depth`` segments, what follows is left open. Below each node a segment stays as it is
    if ``least`` of the node's urls at least and this ``share`` of them have it, so a node keeps 1 / ``share`` of them at
    most; all others are ``*``. A node's share is smoothed by ``weight`` urls of its parent's share, a host's by all urls'; a node that has all
    labels of its parent has its parent's share.
    A path without segments counts as one empty segment.
    Null urls and those without ``://`` have host and path empty and are judged as a host of their own. Ids may be null or
    repeat; each row gives one row; without labels everything is allowed. Other columns of ``pages`` are left out.
    """
    host, path = host_and_path(F.col("url"))
    marked = F.lit(None).cast("boolean") if label is None else F.col(f"`{label}`").cast("boolean")
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), marked.alias("marked"))
    name, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "says": verdict, "marked": F.coalesce("marked", verdict == "block")})
    segments = F.slice(F.split(F.substring("path", 2, F.length("path")), "/", depth + 1), 1, depth)
    rows = cut(rows.withColumns({"segments": segments, "labelled": F.col("marked").isNotNull().cast("long"), "blocked": F.coalesce(F.col("marked"), F.lit(False)).cast("long")}).drop("marked"))
    total = rows.agg(F.coalesce(F.sum("labelled"), F.lit(0)).alias("n"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("k")).first()
    rows = rows.withColumns({"blocked_share": F.lit(total.k / total.n if total.n else 0.0), "template": F.lit("")})
    node = ["host", "template"]
    for level in range(depth):
        segment = F.get("segments", F.lit(level))
        here = rows.filter(segment.isNotNull())
        children = here.groupBy(*node, segment.alias("segment")).agg(F.count("*").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
        totals = here.groupBy(*node).agg(F.count("*").alias("all_n"), F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"), F.max("blocked_share").alias("parent"))
        # written, so that joins with them shuffle both sides and Spark can split a node of very many urls or children
        totals = cut(totals.withColumn("parent", F.expr(_smoothed("all_", weight)) if level == 0 else F.col("parent")))
        frequent = children.filter(F.col("n") >= least).join(totals.select(*node, "all_n"), node).filter(F.col("n") >= share * F.col("all_n"))
        kept = frequent.repartition(*node).groupBy(*node).agg(F.collect_list(F.struct("segment", "labelled", "blocked", "n")).alias("kept"))  # 1 / share of them at most
        nodes = totals.join(kept, node, "left").withColumn("kept", F.expr(f"coalesce(kept, {NONE})")).withColumn("siblings", F.expr(SIBLINGS)).withColumn("groups", F.expr(GROUPS))
        known = f"IF(x.labelled = all_labelled, parent, {_smoothed('x.', weight)})"  # no more labels than the node had: they count once
        branches = f"transform(groups, x -> struct(x.segments AS segments, {SHOWN} AS shown, {known} AS blocked_share))"
        table = cut(nodes.select(*node, F.expr(branches).alias("branches")))
        met = rows.withColumn("segment", segment).join(table, node, "left").withColumn("branch", F.expr(OWN_BRANCH))
        rows = met.select(
            "page_id", "host", "path", "rule", "says", "segments", "labelled", "blocked",
            F.coalesce(F.col("branch.blocked_share"), F.col("blocked_share")).alias("blocked_share"),
            F.concat("template", F.coalesce(F.concat(F.lit("/"), F.col("branch.shown")), F.lit(""))).alias("template"),
        )
        rows = cut(rows) if level < depth - 1 else rows
    decided = F.coalesce(F.col("says"), F.when(F.col("blocked_share") >= purity, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", decided.alias("verdict"), "template", "blocked_share")
