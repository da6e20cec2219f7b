"""Mixing sources to target weights by hierarchical budgeting (DataFrame only).

Leaves of the domain-language-source tree have weights at every level.  The
token budget goes down the tree: the children of a node share its budget by
weight, none above what its documents can give in ``max_epochs`` passes; what a
child can't take goes to its siblings by weight, and only what no sibling can
take is left to the siblings of an ancestor (a parent's capacity is the sum of
its children's, so it never gets more than they can take).  Each leaf then
takes whole epochs, and of the last one the token-prefix in seeded order; the
document at the end of a prefix is taken in part, so budgets are met exactly.

Prefix sums run over seeded slices of a leaf (``4096`` by the first hex digits
of the order key): only slice totals of a leaf meet, never its documents.
Null levels are the name ''; null text has no tokens and is taken whenever a
whole epoch is; rows that repeat a doc_id, null ids too, are taken row by row,
and equal rows are selected together; an empty table gives an empty result;
further columns are ignored by ``allocate``.  Budgets are shared over one row a
child of a node, never over documents.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.plans.checkpoints import own_folder

WORD = r"[^\x20\x09-\x0D]+"
SLICE_DIGITS = 3

#: The tree of the registered query: integer weights, 1 where none is named.
WEIGHTS = {"domain": {"web": 3, "curated": 2}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 2}}
CURATED = "src1[0-9]$"
LEVELS = ("domain", "lang", "source")
#: Products of a token sum and a weight don't fit a long.
EXACT = "cast({} as decimal(28,0))"
SHARE, MAX_EPOCHS, SEED = 0.5, 2, "mix-1"


def domain_of(source: Column) -> Column:
    """The domain of a source where documents have no such column."""
    return F.when(F.coalesce(source, F.lit("")).rlike(CURATED), "curated").otherwise("web")


def weight(level: str, weights: dict) -> Column:
    out = F
    for name, w in weights.get(level, {}).items():
        out = out.when(F.col(level) == name, F.lit(w))
    return out.otherwise(F.lit(1)) if out is not F else F.lit(1)


def share_out(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """``nodes`` with ``budget``: their parent's ``above``, shared by weight.

    ``capacity`` limits a node.  In rising order of capacity for its weight,
    a node is full if the rest, shared among it and those after it, would give
    it its capacity; the others take an equal part for their weight.  Parts are
    whole tokens: what rounding leaves goes to the largest remainders, of equal
    ones by name.  All sums and products are exact integers.
    """
    family = Window.partitionBy(*parents)
    up = family.orderBy("fill", name)
    earlier = up.rowsBetween(Window.unboundedPreceding, -1)
    later = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = nodes.withColumn("fill", F.col("capacity").cast("double") / F.col("weight")).withColumns({
        "order": F.row_number().over(up),
        "rest": F.col("above") - F.coalesce(F.sum("capacity").over(earlier), F.lit(0)),
        "weights": F.sum("weight").over(later),
    })
    ranked = ranked.withColumn("open", F.expr(f"{EXACT.format('rest')} * weight < {EXACT.format('capacity')} * weights"))
    first = F.min(F.when(F.col("open"), F.struct("order", "rest", "weights"))).over(family)
    parts = ranked.withColumn("first", first).withColumn("open", F.coalesce(F.col("order") >= F.col("first.order"), F.lit(False))).withColumns({
        "part": F.when(F.col("open"), F.expr(f"{EXACT.format('first.rest')} * weight div first.weights")).otherwise(F.col("capacity")),
        "over": F.when(F.col("open"), F.expr(f"{EXACT.format('first.rest')} * weight % first.weights")).cast("long"),
    })
    left = F.col("first.rest") - F.sum(F.when(F.col("open"), F.col("part"))).over(family)
    rank = F.row_number().over(family.orderBy(F.desc_nulls_last("over"), name))
    shared = parts.withColumns({"left": left, "rank": rank})
    more = F.when(F.col("open") & (F.col("rank") <= F.col("left")), 1).otherwise(0)
    return shared.withColumn("budget", (F.col("part") + more).cast("long")).drop("fill", "order", "rest", "weights", "open", "first", "part", "over", "left", "rank")


def leaf_budgets(counted: DataFrame, weights: dict, levels, share: float, max_epochs: int) -> DataFrame:
    """Each leaf with its tokens and its budget."""
    levels = list(levels)
    leaves = counted.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"))
    nodes = None
    for depth in range(1, len(levels) + 1):
        own = levels[:depth]
        level = leaves.groupBy(*own).agg((F.sum("tokens") * max_epochs).alias("capacity")).withColumn("weight", weight(own[-1], weights).cast("long"))
        if nodes is None:
            # The root's children are as many as there are domains.
            whole = F.expr(f"sum(capacity) over (partition by root) div {int(max_epochs)}")
            level, parents = level.withColumn("root", F.lit(0)).withColumn("above", F.floor(whole.cast("double") * F.lit(float(share))).cast("long")), ["root"]
        else:
            level, parents = level.join(nodes.select(*own[:-1], F.col("budget").alias("above")), own[:-1]), own[:-1]
        nodes = share_out(level, parents, own[-1])
    return leaves.join(nodes.select(*levels, "budget"), levels)


def placed_documents(docs: DataFrame, weights: dict | None, levels, share: float, max_epochs: int, seed: str) -> DataFrame:
    """What ``allocate`` returns, with ``text_hash``."""
    own_folder(docs.sparkSession)
    levels, weights = list(levels), WEIGHTS if weights is None else weights
    if "domain" in levels and "domain" not in docs.columns:
        docs = docs.withColumn("domain", domain_of(F.col("source")))
    tokens = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.coalesce(c, F.lit("")).alias(c) for c in levels), tokens.alias("n_tokens"), F.xxhash64("text").alias("text_hash")).checkpoint()
    budgets = leaf_budgets(counted, weights, levels, share, max_epochs)
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.greatest("tokens", F.lit(1)))).otherwise(0).cast("long")
    plan = budgets.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")).drop("tokens", "budget")
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("epochs") + 1, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    placed = counted.join(plan, levels).withColumn("key", key).withColumn("slice", F.substring("key", 1, SLICE_DIGITS))
    slice_sums = placed.groupBy(*levels, "slice").agg(F.sum("n_tokens").alias("slice_tokens"))
    before = F.coalesce(F.sum("slice_tokens").over(Window.partitionBy(*levels).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = slice_sums.select(*levels, "slice", before.alias("offset"))
    in_slice = Window.partitionBy(*levels, "slice").orderBy("key", "n_tokens", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("offset") + F.coalesce(F.sum("n_tokens").over(in_slice), F.lit(0))
    taken = placed.join(offsets, [*levels, "slice"]).withColumn("start", start)
    prefix = F.greatest(F.least("n_tokens", F.col("rest") - F.col("start")), F.lit(0)).cast("long")
    out = taken.withColumn("prefix_tokens", prefix)
    return out.select("doc_id", *levels, "n_tokens", "epochs", "prefix_tokens", (F.col("epochs") * F.col("n_tokens") + F.col("prefix_tokens")).alias("taken_tokens"), "text_hash")


def allocate(docs: DataFrame, weights: dict | None = None, levels=LEVELS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, the levels, n_tokens, epochs (whole ones), prefix_tokens, taken_tokens.

    ``share`` is the token budget as a part of all tokens.
    """
    return placed_documents(docs, weights, levels, share, max_epochs, seed).drop("text_hash")


def select_documents(docs: DataFrame, weights: dict | None = None, levels=LEVELS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The rows of ``docs`` that are taken, whole or in part, at least once.

    Rows are known by doc_id, levels and text, so of rows with one doc_id and
    different texts each goes by its own place.
    """
    levels = list(levels)
    own = docs.withColumn("__domain", domain_of(F.col("source"))) if "domain" in levels and "domain" not in docs.columns else docs
    named = {c: F.col("__domain") if c == "domain" and c not in docs.columns else F.col(c) for c in levels}
    taken = placed_documents(docs, weights, levels, share, max_epochs, seed).where("epochs > 0 or prefix_tokens > 0")
    taken = taken.select(F.col("doc_id").alias("taken_id"), F.col("text_hash").alias("taken_hash"), *(F.col(c).alias(f"taken_{c}") for c in levels)).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("taken_id")) & (F.xxhash64("text") == F.col("taken_hash"))
    for c in levels:
        same &= F.coalesce(named[c], F.lit("")) == F.col(f"taken_{c}")
    return own.join(taken, same, "left_semi").select(*docs.columns)
