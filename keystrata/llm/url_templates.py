"""URL filters: rules first, then a path-template tree per host (DataFrame only).

Rules are (verdict, host, path prefix): one fits its host and all subdomains
where the path starts with its path; the longest wins.  Urls that a rule judges
are the labelled rows of the tree.  Its levels are the host and every path
segment, however deep; runs of digits in a segment are wildcards.  Below a node,
statistically similar branches are merged: those whose block rate lies
significantly above the node's into one, those significantly below into one, and
all others, labelled or not, into the wildcard branch, so there are three
branches a node at most.  The purity of a template is its block rate, smoothed
towards its parent's (a host's towards the overall rate); a template with fewer
than ``least_labelled`` labelled rows has its parent's purity.  Urls without a
rule are blocked where the purity of their template reaches ``reject``.

The tree is grown level by level over the distinct masked paths of each host,
with sums of labels, never over urls; its nodes and branches meet in joins that
Spark can split or, if they are small, broadcasts.  The overall rate is one
number.  Null or malformed urls have empty host and path, no rule, and are
allowed; repeated rows are judged alike; an empty table gives an empty result;
further columns are ignored.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.plans.checkpoints import forget, own_folder, written

#: Fixed values: (verdict, host, path prefix).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SMOOTHING, REJECT, LEAST_LABELLED, SIGNIFICANT = 4.0, 0.8, 5, 2.0


def split_url(pages: DataFrame) -> DataFrame:
    """page_id, host and path of each row."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.substring(F.col("url"), at + 3, F.length("url"))).otherwise("")
    raw = F.regexp_extract("rest", "^[^/?#]*+", 0)
    tail = F.substring(F.col("rest"), F.length("raw_host") + 1, F.length("rest"))
    parts = pages.select("page_id", rest.alias("rest")).select("page_id", "rest", raw.alias("raw_host"))
    return parts.select("page_id", F.coalesce(F.translate("raw_host", UPPER, LOWER), F.lit("")).alias("host"), F.coalesce(F.regexp_extract(tail, "^[^?#]*+", 0), F.lit("")).alias("path"))


def rule_columns(rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host and path, else null."""
    name = verdict = F
    for kind, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name = name.when(fits, F.lit(host + path))
        verdict = verdict.when(fits, F.lit(kind))
    none = F.lit(None).cast("string")
    return (name, verdict) if rules else (none, none)


def segments(path: Column) -> Column:
    """The path's segments, runs of digits as wildcards."""
    return F.transform(F.slice(F.split(path, "/"), F.lit(2), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), lambda s: F.regexp_replace(s, "[0-9]++", "*"))


def smoothed(bad: str, n: str, prior) -> Column:
    return (F.col(bad) + F.lit(SMOOTHING) * prior) / (F.col(n) + F.lit(SMOOTHING))


def side(bad: str, n: str, rate: str) -> Column:
    """The branch that a child falls into: significantly above or below the node, or neither."""
    own = F.col(bad) / F.greatest(F.col(n), F.lit(1))
    spread = F.lit(SIGNIFICANT) * F.sqrt(F.greatest(F.col(rate) * (1 - F.col(rate)), F.lit(0.01)) / F.greatest(F.col(n), F.lit(1)))
    return F.when(F.col(n) == 0, "*").when(own - F.col(rate) > spread, "+").when(F.col(rate) - own > spread, "-").otherwise("*")


def grown(leaves: DataFrame, least_labelled: int) -> DataFrame:
    """host, masked and the purity of each leaf (host, masked, segs, n, bad)."""
    total = leaves.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.max(F.size("segs")).alias("depth")).first()
    overall = (total.bad or 0) / max(total.n or 0, 1)
    hosts = leaves.groupBy("host").agg(F.sum("n").alias("tn"), F.sum("bad").alias("tbad")).withColumn("rate", smoothed("tbad", "tn", F.lit(float(overall))))
    purity = F.when(F.col("tn") >= least_labelled, F.col("rate"))
    now = written(leaves.join(hosts, "host").select("host", "masked", "segs", "n", "bad", F.col("host").alias("node"), "rate", purity.alias("purity")))
    done = []
    for level in range(1, (total.depth or 0) + 1):
        done.append(now.where(F.size("segs") < level).select("host", "masked", "purity"))
        open_ = now.where(F.size("segs") >= level).withColumn("seg", F.element_at("segs", level))
        branches = open_.groupBy("node", "seg").agg(F.sum("n").alias("bn"), F.sum("bad").alias("bbad"), F.first("rate").alias("rate"), F.first("purity").alias("purity"))
        branches = written(branches.withColumn("side", side("bbad", "bn", "rate")))
        nodes = branches.groupBy("node", "side").agg(F.sum("bn").alias("tn"), F.sum("bbad").alias("tbad"), F.first("rate").alias("above"), F.first("purity").alias("pure"))
        nodes = nodes.withColumn("rate", smoothed("tbad", "tn", F.col("above"))).withColumn("purity", F.when(F.col("tn") >= least_labelled, F.col("rate")).otherwise(F.col("pure")))
        nodes = written(nodes.select("node", "side", "rate", "purity"))
        placed = open_.drop("rate", "purity").join(branches.select("node", "seg", "side"), ["node", "seg"]).join(nodes, ["node", "side"])
        now = written(placed.select("host", "masked", "segs", "n", "bad", F.concat_ws("/", "node", "side").alias("node"), "rate", "purity"))
        forget(branches, nodes)
    out = now.select("host", "masked", "purity")
    for d in done:
        out = out.unionByName(d)
    return out


def judge(pages: DataFrame, rules=RULES, reject: float = REJECT, least_labelled: int = LEAST_LABELLED) -> DataFrame:
    """page_id, host, path, rule and verdict of every url."""
    own_folder(pages.sparkSession)
    rule, verdict = rule_columns(rules)
    urls = split_url(pages).withColumns({"rule": rule, "by_rule": verdict, "segs": segments(F.col("path"))}).withColumn("masked", F.concat(F.size("segs").cast("string"), F.lit("/"), F.array_join("segs", "/")))
    labelled = F.col("by_rule").isNotNull().cast("long")
    bad = F.coalesce((F.col("by_rule") == "block").cast("long"), F.lit(0))
    leaves = written(urls.groupBy("host", "masked", "segs").agg(F.sum(labelled).alias("n"), F.sum(bad).alias("bad")))
    rejected = written(grown(leaves, least_labelled).where(F.col("purity") >= reject).select("host", "masked").distinct().withColumn("rejected", F.lit(True)))
    forget(leaves)
    judged = urls.join(rejected, ["host", "masked"], "left")
    by_tree = F.when(F.col("rejected"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_tree).alias("verdict"))
