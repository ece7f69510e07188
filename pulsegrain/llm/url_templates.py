"""URL filters: given rules first, and a path-template tree per host for the rest.

Rules name a host (with its subdomains) and a path prefix; the longest that fits wins.  Their verdicts
are also the labels the trees learn from.  A host's tree is grown level by level from its root:

1. Generalise: numbers and long hex segments are wildcards; of more than `many` siblings those with
   less than the share `rare` of their parent's urls become one wildcard.
2. Merge: labelled siblings in the order of their blocked share are compared with the one before by a
   two-sample test of proportions; neighbours that do not differ (|z| <= `similar_z`) become one
   branch, and the next level is grown under it.
3. Judge: a branch's purity is its blocked share, smoothed by `parent_weight` labels of its parent's
   purity and `corpus_weight` labels of what all hosts together say about the same path; that is
   smoothed towards its own parent in the same way, and at the root the share of all labels.

A tree is grown where at least two path shapes part, to any depth.  A url's template is the branch it
ends in, and is rejected if its purity reaches `reject`.  A branch without labels is thus judged by
its host's neighbouring branches and by other hosts' labels for the same path, and a host without
labels by other hosts' alone.

Only counts per distinct (host, path shape) enter the trees, pre-aggregated on the map side, so that a
host with a third of all rows costs no more than another; a parent has at most about
`many` + 1 / `rare` named children, so that no window holds more.

Defined results: a null url or one without `://` has an empty host and path and is allowed, without
template and purity, and takes no part in the trees; an empty path has the template `/`; without
labels everything is allowed; repeated rows get repeated verdicts; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

#: Verdict and host/path of each rule.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VARIABLE = r"^[0-9]+(\.[A-Za-z0-9]+)?$|^[0-9a-fA-F-]{16,}$"


def parse(url: Column) -> tuple[Column, Column]:
    """Host and path of a url, both empty without `://`."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null without one."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, prefix = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{prefix}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _branches(live: DataFrame, many: int, rare: float, similar_z: float) -> DataFrame:
    """(host, template, segment, branch): the branch of the next level that each segment falls into."""
    place = ["host", "template"]
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    child = live.groupBy(*place, "segment").agg(*sums)
    parent = child.groupBy(*place).agg(F.count(F.lit(1)).alias("children"), F.sum("n").alias("n_parent"))
    minor = (F.col("children") > many) & (F.col("n") < rare * F.col("n_parent"))
    named = child.join(parent, place).withColumn("name", F.when(minor, F.lit("*")).otherwise(F.col("segment")))
    share = F.try_divide("blocked", "labelled")
    ahead = Window.partitionBy(*place).orderBy(share, "name")
    node = named.groupBy(*place, "name").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")).where("labelled > 0")
    node = node.select("*", F.lag("labelled").over(ahead).alias("l0"), F.lag("blocked").over(ahead).alias("b0"))
    pool = (F.col("blocked") + F.col("b0")) / (F.col("labelled") + F.col("l0"))
    spread = F.sqrt(pool * (1 - pool) * (1 / F.col("labelled") + 1 / F.col("l0")))
    apart = F.col("l0").isNull() | (F.abs(share - F.col("b0") / F.col("l0")) > similar_z * spread)
    node = node.withColumn("apart", apart.cast("int")).withColumn("group", F.sum("apart").over(ahead))
    names = F.sort_array(F.collect_list("name").over(Window.partitionBy(*place, "group")))
    merged = node.select(*place, "name", F.when(F.size(names) > 1, F.concat(F.lit("{"), F.array_join(names, "|"), F.lit("}"))).otherwise(F.col("name")).alias("branch"))
    return named.select(*place, "segment", "name").join(merged, [*place, "name"], "left").select(*place, "segment", F.coalesce("branch", "name").alias("branch"))


def _grown(rows: DataFrame, many: int, rare: float, similar_z: float, parent_weight: float, corpus_weight: float) -> DataFrame:
    """One level deeper: rows with their segment, template, purities (host's and corpus's) and whether to go on."""
    live = rows.where("open").withColumn("segment", F.get("rest", F.lit(0)))
    placed = live.join(_branches(live, many, rare, similar_z), ["host", "template", "segment"]).withColumn("raw", F.concat_ws("/", "raw", "segment"))
    corpus = live.groupBy(F.concat_ws("/", "raw", "segment").alias("raw")).agg(((F.sum("blocked") + parent_weight * F.first("shared")) / (F.sum("labelled") + parent_weight)).alias("shared_"))
    placed = placed.join(corpus, "raw").withColumn("rest", F.slice("rest", 2, 1 << 20))
    branch = placed.groupBy("host", "template", "branch").agg(
        ((F.sum("blocked") + parent_weight * F.first("purity") + corpus_weight * F.sum(F.col("shared_") * F.col("n")) / F.sum("n")) / (F.sum("labelled") + parent_weight + corpus_weight)).alias("purity_"),
        F.count(F.lit(1)).alias("shapes"),
    )
    deeper = (F.col("shapes") > 1) & (F.size("rest") > 0)
    tail = F.when(deeper | (F.size("rest") == 0), F.lit("")).otherwise(F.concat(F.lit("/"), F.array_join("rest", "/")))
    return placed.join(branch, ["host", "template", "branch"]).select(
        "host", "shape", "rest", "n", "labelled", "blocked", F.concat("template", F.lit("/"), "branch", tail).alias("template"), "raw", F.col("purity_").alias("purity"), F.col("shared_").alias("shared"), deeper.alias("open")
    )


def templates(counts: DataFrame, many: int = 20, rare: float = 0.05, similar_z: float = 1.96, parent_weight: float = 2.0, corpus_weight: float = 10.0) -> DataFrame:
    """(host, shape, template, purity) of (host, shape, n, labelled, blocked), written once."""
    total = counts.agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("b")).first()
    prior = F.lit((total["b"] or 0) / total["n"] if total["n"] else 0.0)
    root = counts.groupBy("host").agg(((F.sum("blocked") + corpus_weight * prior) / (F.sum("labelled") + corpus_weight)).alias("purity"))
    rest = F.filter(F.split("shape", "/"), lambda s: s != "")
    rows = counts.join(root, "host").select("host", "shape", rest.alias("rest"), "n", "labelled", "blocked", F.lit("").alias("template"), F.lit("").alias("raw"), "purity", prior.alias("shared"), (F.size(rest) > 0).alias("open"))
    levels, finished = [written(rows, "url-level")], []
    while True:
        rows = levels[-1]
        finished.append(rows.where("NOT open").select("host", "shape", F.when(F.col("template") == "", "/").otherwise(F.col("template")).alias("template"), F.round("purity", 6).alias("purity")))
        if rows.where("open").isEmpty():
            break
        levels.append(written(_grown(rows, many, rare, similar_z, parent_weight, corpus_weight), "url-level"))
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    done = written(out, "url-verdicts")
    discard(*levels)
    return done


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, reject: float = 0.7, id_column: str = "page_id", url_column: str = "url", **tree: float) -> DataFrame:
    """Per row: id, host, path, rule, verdict, template and purity (smoothed blocked share)."""
    host, path = parse(F.col(url_column))
    read = pages.select(F.col(id_column).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = match(F.col("host"), F.col("path"), rules)
    shape = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), lambda s: F.when(s.rlike(VARIABLE), F.lit("*")).otherwise(s))
    urls = read.select("*", rule.alias("rule"), verdict.alias("ruled"), F.concat(F.lit("/"), F.array_join(shape, "/")).alias("shape"))
    given = urls.where("host <> '' OR path <> ''")
    counts = written(given.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count("ruled").alias("labelled"), F.count_if(F.col("ruled") == "block").alias("blocked")), "url-shapes")
    judged = templates(counts, **tree)
    discard(counts)
    own = F.when(F.col("purity") >= reject, F.lit("block")).otherwise(F.lit("allow"))
    known = judged.select(F.col("host").alias("at_host"), F.col("shape").alias("at_shape"), "template", "purity")
    joined = urls.join(known, (urls.host == known.at_host) & (urls["shape"] == known.at_shape) & ((urls.host != "") | (urls.path != "")), "left")
    return joined.select(F.col("id").alias(id_column), "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "template", "purity")
