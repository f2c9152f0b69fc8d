"""Connected components of an edge table."""

from pyspark.sql import functions as F

from voxstars.sources.staging import stage


def _linked(rows):
    """Each (node, other) with the smallest of node and its others as ``low``."""
    lows = rows.groupBy("node").agg(F.min("other").alias("low")).withColumn("low", F.least("low", "node"))
    return rows.join(lows.hint("merge"), "node")


def components(edges, a="a", b="b"):
    """(node, root) for every node of an edge, root being the smallest node that it reaches.

    Large stars and small stars in turn; each round is a written table, so a lost executor costs at
    most a round, and no node's neighbours are gathered. Self-loops and repeated edges do no harm.
    """
    now = stage(
        edges.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("node"), F.least(a, b).alias("other"))
        .distinct()
    )
    print_of = lambda t: t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "other").cast("decimal(38,0)"))).first()
    before = print_of(now)
    while True:
        both = now.unionByName(now.select(F.col("other").alias("node"), F.col("node").alias("other")))
        large = _linked(both).filter("other > node").select(F.col("other").alias("node"), F.col("low").alias("other")).distinct()
        starred = _linked(large)
        small = starred.select(F.col("other").alias("node"), F.col("low").alias("other")).unionByName(
            starred.select("node", F.col("low").alias("other"))
        )
        now = stage(small.filter("node <> other").distinct())
        after = print_of(now)
        if after == before:
            break
        before = after
    roots = now.select("node", F.col("other").alias("root"))
    return roots.unionByName(now.select(F.col("other").alias("node"), F.col("other").alias("root")).distinct())
