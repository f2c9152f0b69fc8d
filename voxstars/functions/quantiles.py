"""Exact interpolated quantiles that no single task has to hold the values for."""

from pyspark.sql import Window
from pyspark.sql import functions as F

BUCKETS = 1 << 16


def exact_quantiles(df, columns, probabilities):
    """One row; column ``{c}_{i}`` is the i-th probability's linearly interpolated quantile of c.

    Equal values are counted first. A histogram of at most BUCKETS + 1 cells per column then tells
    which cell holds each wanted rank, and only the values of those few cells are ranked.
    """
    values = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])
    counted = (
        df.select(F.inline(values)).filter("v IS NOT NULL").groupBy("name", "v").agg(F.count(F.lit(1)).alias("n"))
    )
    ranges = counted.groupBy("name").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("total"))
    # One row per column: the broadcast cannot grow with the data.
    placed = counted.join(F.broadcast(ranges), "name").withColumn(
        "cell", F.coalesce(F.floor(F.try_divide(F.expr("v - lo"), F.expr("hi - lo")) * BUCKETS), F.lit(0))
    )
    by_cell = Window.partitionBy("name").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = (
        placed.groupBy("name", "cell")
        .agg(F.sum("n").alias("in_cell"), F.first("total").alias("total"))
        .withColumn("upto", F.sum("in_cell").over(by_cell))
    )
    wanted = F.array(
        *[
            F.struct(F.lit(i).alias("i"), f(F.expr(f"(total - 1) * {p}D")).alias("rank"), F.lit(side).alias("side"))
            for i, p in enumerate(probabilities)
            for side, f in (("below", F.floor), ("above", F.ceil))
        ]
    )
    # At most two rows per column and probability.
    hits = cells.select("*", F.inline(wanted)).filter("rank >= upto - in_cell AND rank < upto")
    hits = hits.select("name", "cell", "i", "rank", "side", F.expr("upto - in_cell").alias("before"))
    by_value = Window.partitionBy("name", "i", "side").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        placed.join(F.broadcast(hits), ["name", "cell"])
        .withColumn("reached", F.col("before") + F.sum("n").over(by_value))
        .filter("rank >= reached - n AND rank < reached")
    )

    def pick(c, i, side, what):
        return F.max(F.when((F.col("name") == c) & (F.col("i") == i) & (F.col("side") == side), F.col(what)))

    out = []
    for c in columns:
        for i, p in enumerate(probabilities):
            below, above = pick(c, i, "below", "v"), pick(c, i, "above", "v")
            position = (pick(c, i, "below", "total") - 1) * F.lit(float(p))
            fraction = position - pick(c, i, "below", "rank")
            out.append((below + (above - below) * fraction).alias(f"{c}_{i}"))
    return found.agg(*out)
