"""URL filter: fixed rules first, then a path-template tree learned for each host.

The urls that a rule judges are the labelled ones, with those that a label column of the caller's marks. For each host a
tree of path segments is grown level by level. At a node with N urls, a segment that n of them have stays literal if
``n >= MIN_COUNT`` and the lower end of the Wilson interval of n / N is at least ``MIN_SHARE``: names, numbers and dates
that vary don't recur that often. All others become the wildcard ``*``. So a node has at most 1 / MIN_SHARE literal
branches, and what a level gathers is counts by branch, never urls. Literal branches that have labelled urls are
merged where neither the labels (two-proportion z-test) nor the depth of what lies below (mean, z-test) tell them
apart. Below a node of fewer than MIN_COUNT urls all is wildcards; the tree has no greatest depth. A template is rejected
if its smoothed purity ``(allowed + PRIOR * STRENGTH) / (allowed + blocked + STRENGTH)`` is below ``CUT``; one without
labelled urls keeps the benefit of the doubt.

Defined results: a null url or one without ``://`` has empty host and path, fits no rule and forms a template of its
own host; repeated rows stay and count as often as they stand; a url's rule is the one of most characters (host and path
together), of equally long ones the first; an empty table gives an empty one; further columns don't matter.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import Scratch, dealt_join, prepare

#: (verdict, host, path) of the query's rules: fixed values.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
MIN_SHARE, MIN_COUNT, MIN_LABELLED, Z, PRIOR, STRENGTH, CUT = 0.02, 10, 5, 1.96, 0.8, 4.0, 0.5
#: Levels between two written tables.
LEVELS = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parted(pages: DataFrame) -> DataFrame:
    """Adds host and path."""
    rest = F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return pages.withColumns({"host": host, "path": F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)})


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and verdict of the longest rule that fits; null where none does."""
    order = sorted(rules, key=lambda r: -len(r[1] + r[2]))

    def fits(h, p):
        return ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)

    rule = F.coalesce(*[F.when(fits(h, p), F.lit(h + p)) for _, h, p in order], F.lit(None).cast("string"))
    verdict = F.coalesce(*[F.when(fits(h, p), F.lit(v)) for v, h, p in order], F.lit(None).cast("string"))
    return pages.withColumns({"rule": rule, "verdict": verdict})


def _merge_branches(branches: pd.DataFrame) -> pd.DataFrame:
    """Labels of the literal branches of one node (at most 1 / MIN_SHARE rows): merged ones share theirs."""
    branches = branches.sort_values("seg").reset_index(drop=True)
    groups: list[dict] = []
    for r in branches.itertuples():
        own = {"segs": [r.seg], "n": r.n, "good": r.good, "bad": r.bad, "deep": r.deep, "deep2": r.deep2}
        for g in groups:
            if min(g["good"] + g["bad"], r.good + r.bad) >= MIN_LABELLED and _alike(g, own):
                g["segs"].append(r.seg)
                for k in ("n", "good", "bad", "deep", "deep2"):
                    g[k] += own[k]
                break
        else:
            groups.append(own)
    name = {s: "|".join(sorted(g["segs"])) for g in groups for s in g["segs"]}
    return pd.DataFrame({"host": branches.host, "tmpl": branches.tmpl, "seg": branches.seg, "branch": branches.seg.map(name)})


def _alike(a: dict, b: dict) -> bool:
    na, nb = a["good"] + a["bad"], b["good"] + b["bad"]
    p = (a["bad"] + b["bad"]) / (na + nb)
    if abs(a["bad"] / na - b["bad"] / nb) > Z * (p * (1 - p) * (1 / na + 1 / nb)) ** 0.5 + 1e-12:
        return False
    ma, mb = a["deep"] / a["n"], b["deep"] / b["n"]
    va, vb = a["deep2"] / a["n"] - ma * ma, b["deep2"] / b["n"] - mb * mb
    return abs(ma - mb) <= Z * (max(va, 0) / a["n"] + max(vb, 0) / b["n"]) ** 0.5 + 1e-9


def wilson_low(n, whole):
    """Lower end of the Wilson interval of n / whole (numbers or columns)."""
    p = n / whole
    root = (p * (1 - p) / whole + Z * Z / (4 * whole * whole)) ** 0.5
    return (p + Z * Z / (2 * whole) - Z * root) / (1 + Z * Z / whole)


def templates(urls: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds tmpl, the template of each row's path (columns host, path, label: 1 allowed, 0 blocked, null)."""
    segs = F.filter(F.split("path", "/", -1), lambda s: s != "")
    rows = urls.withColumn("segs", segs).withColumns({"size": F.size("segs"), "tmpl": F.lit(""), "open": F.lit(True)})
    level = 0
    while True:
        here = rows.where((F.col("size") > level) & F.col("open")).withColumn("seg", F.get("segs", F.lit(level)))
        below = F.col("size") - level
        counts = here.groupBy("host", "tmpl", "seg").agg(
            F.count("*").alias("n"), F.count(F.when(F.col("label") == 1, 1)).alias("good"), F.count(F.when(F.col("label") == 0, 1)).alias("bad"), F.sum(below).alias("deep"), F.sum(below * below).alias("deep2")
        )
        counts = scratch.keep(counts.where(F.col("seg").isNotNull()), "counts")
        whole = counts.groupBy("host", "tmpl").agg(F.sum("n").alias("whole")).where(f"whole >= {MIN_COUNT}")
        literal = counts.where(f"n >= {MIN_COUNT}").join(whole, ["host", "tmpl"]).where(wilson_low(F.col("n"), F.col("whole")) >= MIN_SHARE).drop("whole")
        literal = scratch.keep(literal.groupBy("host", "tmpl").applyInPandas(_merge_branches, "host string, tmpl string, seg string, branch string"), "branches")
        whole = scratch.keep(whole.select("host", "tmpl", F.lit(True).alias("large")), "nodes")
        more = bool(whole.take(1))
        scratch.drop(counts)
        if not more:
            break
        seg = F.when((F.col("size") > level) & F.col("open"), F.get("segs", F.lit(level)))
        rows = dealt_join(rows.withColumn("seg", seg), literal, ["host", "tmpl", "seg"], "left")
        rows = dealt_join(rows, whole, ["host", "tmpl"], "left")
        # Nodes of too few urls are done: what is left of their urls is wildcards.
        going = F.col("open") & (F.col("size") > level)
        step = F.concat("tmpl", F.lit("/"), F.coalesce("branch", F.lit("*")))
        rest = F.concat("tmpl", F.repeat(F.lit("/*"), F.col("size") - level))
        tmpl = F.when(going & F.col("large"), step).when(going, rest).otherwise(F.col("tmpl"))
        rows = rows.withColumns({"tmpl": tmpl, "open": going & F.coalesce("large", F.lit(False))}).drop("branch", "seg", "large")
        level += 1
        if level % LEVELS == 0:
            rows = scratch.keep(rows, "rows")
    # What is open still lies at nodes of too few urls.
    rest = F.when(F.col("open") & (F.col("size") > level), F.concat("tmpl", F.repeat(F.lit("/*"), F.col("size") - level))).otherwise(F.col("tmpl"))
    return rows.withColumn("tmpl", rest).drop("segs", "size", "open")


def judged(pages: DataFrame, rules=RULES, label: str | None = None, prior: float = PRIOR, strength: float = STRENGTH, cut: float = CUT) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every row of pages (page_id, url).

    ``label`` names a column of pages that marks urls no rule judges: 1 allowed, 0 blocked, null.
    """
    prepare(pages.sparkSession)
    scratch = Scratch(pages.sparkSession, "urls")
    own = F.col(label).cast("int") if label else F.lit(None).cast("int")
    rows = ruled(parted(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), own.alias("label"))), rules).drop("url")
    marked = F.when(F.col("verdict") == "allow", 1).when(F.col("verdict") == "block", 0).otherwise(F.col("label"))
    rows = scratch.keep(templates(scratch.keep(rows.withColumn("label", marked), "rows"), scratch), "templates")
    purity = (F.count(F.when(F.col("label") == 1, 1)) + prior * strength) / (F.count("label") + strength)
    scores = scratch.keep(rows.groupBy("host", "tmpl").agg(purity.alias("purity")), "scores")
    scratch.at_exit()
    out = dealt_join(rows, scores, ["host", "tmpl"])
    learned = F.when(F.col("purity") < cut, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", learned).alias("verdict"), F.col("tmpl").alias("template"), "purity")
