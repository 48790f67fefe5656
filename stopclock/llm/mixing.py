"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations alone.

The tree is domain, language, source. A budget of tokens goes down from the root: each node hands its budget to
its children by weight, no child gets more than its subtree can give, and what one cannot take goes to its
siblings. A node asks for no more than its subtree has, so a shortage reaches a node's own siblings only when its
children are used up. Each leaf then takes a prefix of its documents in seeded order, epoch after epoch.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopclock.llm.store import one_per_document, stored

LEVELS = ("domain", "language", "source")


def budgets(leaves: DataFrame, total: Column | float, weights: DataFrame | None = None) -> DataFrame:
    """The leaves (domain, language, source, capacity) with the column `budget`.

    `weights` (level, name, weight) names nodes by their path, "domain", "domain/language" or
    "domain/language/source"; nodes without a weight, or with a null or negative one, weigh 1. Nodes that weigh 0 get
    what their siblings cannot take, in equal parts, last of all.
    """
    nodes = leaves
    for depth, level in enumerate(LEVELS):
        nodes = nodes.withColumn(f"path{depth + 1}", F.concat_ws("/", *LEVELS[: depth + 1]))
    budget = None
    for depth in range(1, len(LEVELS) + 1):
        above = [f"path{d}" for d in range(1, depth)]
        level = nodes.groupBy(*above, f"path{depth}").agg(F.sum("capacity").alias("capacity"))
        if weights is None:
            level = level.withColumn("weight", F.lit(1.0))
        else:
            given = weights.where(F.col("weight") >= 0).groupBy("name").agg(F.max("weight").cast("double").alias("weight"))
            level = level.join(given.withColumnRenamed("name", f"path{depth}"), f"path{depth}", "left")
        # a weight of nothing comes after every other weight
        level = level.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(1e-9)))
        level = level.withColumn("given", F.lit(total).cast("double")) if budget is None else level.join(budget, above)
        budget = _shared_out(level, above, f"path{depth}").select(*above, f"path{depth}", F.col("share").alias("given"))
    keys = [f"path{d}" for d in range(1, len(LEVELS) + 1)]
    out = nodes.join(budget, keys)
    return out.select(*leaves.columns, F.col("given").alias("budget"))


def _shared_out(level: DataFrame, above: list[str], name: str) -> DataFrame:
    """Weighted shares of `given` among the children of a node, none above its capacity.

    Children in order of capacity per weight fill up one after another; the first that does not fill sets the rate
    for itself and all after it."""
    ratio = F.col("capacity") / F.col("weight")
    per = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
    ordered = per.orderBy(ratio, name)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    after = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = level.withColumn("used", F.coalesce(F.sum("capacity").over(before), F.lit(0))).withColumn("open_weight", F.sum("weight").over(after))
    level = level.withColumn("rate", F.greatest(F.col("given") - F.col("used"), F.lit(0.0)) / F.col("open_weight"))
    full = ratio <= F.col("rate")
    level = level.withColumn("open_rate", F.min(F.when(~full, F.struct(ratio.alias("r"), F.col(name).alias("n"), F.col("rate").alias("rate")))).over(per))
    return level.withColumn("share", F.when(full, F.col("capacity").cast("double")).otherwise(F.col("weight") * F.col("open_rate.rate")))


def mix(
    docs: DataFrame,
    total: float,
    weights: DataFrame | None = None,
    seed: int = 0,
    epochs: int = 2,
    domain: Column | None = None,
    per_bucket: int = 1000,
) -> DataFrame:
    """doc_id, domain, language, source, epoch, n_tokens, budget: the documents of the mixture, once per epoch.

    `total` is the share of all tokens (words apart by white space) that the mixture should hold; above 1 documents
    come in several epochs, up to `epochs`. A leaf takes its documents in the order of a hash of seed, epoch and
    doc_id as long as the tokens with the next one stay within its budget, rounded down to whole tokens; the first
    document that passes the budget ends it. `domain` defaults to the letters of the source.

    Null in lang or source is the node "unknown", in text no tokens; documents without tokens are never taken. Rows
    without a doc_id are left out. Rows that repeat a doc_id are one document (`one_per_document`). An empty table
    gives no rows. A leaf of any size is cut by buckets of the order: sums per bucket decide, and only the bucket
    where the budget ends, of about `per_bucket` documents, is put in order.
    """
    docs = one_per_document(docs.select("doc_id", "text", "lang", "source"), "text", "lang", "source").where("doc_id is not null")
    source = F.coalesce("source", F.lit("unknown"))
    domain = F.coalesce(F.nullif(F.regexp_extract("source", r"^[^0-9]+", 0), F.lit("")), F.lit("unknown")) if domain is None else domain
    sized = docs.select(
        "doc_id",
        F.coalesce(domain, F.lit("unknown")).alias("domain"),
        F.coalesce("lang", F.lit("unknown")).alias("language"),
        source.alias("source"),
        F.coalesce(F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))), F.lit(0)).cast("long").alias("n_tokens"),
    ).where("n_tokens > 0")
    sized = stored(sized, "sized")
    leaf = list(LEVELS)
    leaves = stored(sized.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")), "leaves")
    everything = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    plan = budgets(leaves.withColumn("capacity", F.col("tokens") * epochs), float(everything) * total, weights)
    # whole epochs need no order
    plan = plan.withColumn("budget", F.floor(F.round("budget", 3)).cast("long"))
    plan = plan.withColumn("whole", F.least(F.lit(epochs), F.floor(F.col("budget") / F.col("tokens"))).cast("int"))
    plan = plan.withColumn("rest", F.when(F.col("whole") < epochs, F.col("budget") - F.col("whole") * F.col("tokens")).otherwise(0))
    plan = plan.withColumn("buckets", F.ceil(F.col("n") / per_bucket).cast("long"))
    plan = stored(plan.select(*leaf, "budget", "whole", "rest", "buckets"), "plan")

    placed = sized.join(plan, leaf)
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col("whole"), F.col("doc_id")))
    spot = F.conv(F.substring(order, 1, 12), 16, 10).cast("long")
    placed = placed.withColumn("order", order).withColumn("bucket", F.floor(spot * F.col("buckets") / F.lit(float(16**12))))
    last = placed.where("rest > 0")
    sums = last.groupBy(*leaf, "bucket", "rest").agg(F.sum("n_tokens").alias("tokens"))
    so_far = F.coalesce(F.sum("tokens").over(Window.partitionBy(*leaf).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("before", so_far)
    ending = sums.where("before <= rest and before + tokens > rest").groupBy(*leaf).agg(F.min("bucket").alias("ending"), F.min("before").alias("before"))
    ending = stored(ending, "ending")
    last = last.join(ending, leaf)
    within = F.sum("n_tokens").over(Window.partitionBy(*leaf, "bucket").orderBy("order", "doc_id"))
    partial = last.where("bucket = ending").withColumn("upto", F.col("before") + within).where("upto <= rest")
    columns = ["doc_id", *leaf, "n_tokens", "budget"]
    taken = last.where("bucket < ending").select(*columns, F.col("whole").alias("epoch")).unionByName(partial.select(*columns, F.col("whole").alias("epoch")))
    rounds = placed.where("whole > 0").select(*columns, F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("epoch"))
    return rounds.unionByName(taken)
