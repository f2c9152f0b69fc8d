"""Exact distinct counts that add up: dense numbers for values, and bitmaps of them per month.

``countDistinct`` over several columns sends every row once per column through the shuffle, and its
result for one month says nothing about two. A bitmap of 32,768 numbers takes 4 KB whatever the
number of reviews; bitmaps of months, or of batches, are merged with OR.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxstars import schema as S
from voxstars.functions import columns as C
from voxstars.operators.trends import MONTH
from voxstars.sources.staging import stage

CELL = 65_536  # values that one task numbers


def dense_ids(values, known=None):
    """(value, id) for the distinct known values of a one-column table; ids are 1, 2, ... without a gap.

    With ``known``, an earlier result, its values keep their numbers and new ones follow.
    """
    name = values.columns[0]
    fresh = values.select(F.col(name).alias("value")).filter("value IS NOT NULL").distinct()
    first = 1
    if known is not None:
        fresh = fresh.join(known.select("value"), "value", "left_anti")
        first = known.agg(F.coalesce(F.max("id") + 1, F.lit(1))).first()[0]
    fresh = stage(fresh)
    cells = max(1, -(-fresh.count() // CELL))
    placed = fresh.withColumn("cell", F.pmod(F.xxhash64("value"), F.lit(cells)))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # one row per 65,536 values
    starts = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("cell").orderBy("value")) - 1
    numbered = placed.withColumn("inside", inside).join(starts, "cell").select("value", (F.col("start") + F.col("inside") + first).alias("id"))
    return stage(numbered if known is None else known.unionByName(numbered))


def distinct_bitmaps(df, column, ids):
    """(Month, bucket, bits): which numbered values each month's reviews have."""
    known = df.select(C.month_of().alias(MONTH), F.col(column).alias("value")).filter("value IS NOT NULL")
    # Months are gathered by value, which is also what the ids are joined by: one shuffle serves both.
    months = known.groupBy("value").agg(F.collect_set(F.struct(MONTH)).alias("months"))
    met = months.join(ids, "value").select("id", F.inline("months"))
    return met.groupBy(MONTH, F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))


def merge_bitmaps(bitmaps, *group):
    """OR of all bitmaps of a bucket, for the whole table or per group."""
    return bitmaps.groupBy(*group, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def count_distinct(bitmaps, *group):
    """Distinct values over all rows, or per group."""
    total = F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n")
    return merge_bitmaps(bitmaps, *group).groupBy(*group).agg(total)


def kpis(state, products, users):
    """The key figures from a monthly state and the bitmaps of products and users, for the months these have."""
    scored = F.when(F.col(S.SCORE).isNotNull(), F.col("reviews"))
    totals = state.agg(
        F.coalesce(F.sum("reviews"), F.lit(0)).alias("total_reviews"),
        F.try_divide(F.sum(F.col(S.SCORE) * F.col("reviews")), F.sum(scored)).alias("avg_score"),
    )
    n_products = count_distinct(products).select(F.col("n").alias("unique_products"))
    n_users = count_distinct(users).select(F.col("n").alias("unique_customers"))
    joined = totals.crossJoin(F.broadcast(n_products)).crossJoin(F.broadcast(n_users))  # one row each
    return joined.select("total_reviews", "unique_products", "unique_customers", "avg_score")
