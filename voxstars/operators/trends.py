"""Monthly rollups and the figures taken from them.

A rollup has one row per calendar month, so whatever follows it works on a few thousand rows at most.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxstars import schema as S
from voxstars.functions import columns as C

MONTH = "Month"


def month_bucket(df):
    """Rows with a known time, with the first day of their month."""
    return df.filter(F.col(S.TIME).isNotNull()).withColumn(MONTH, C.month_of())


def monthly_volume(df):
    return month_bucket(df).groupBy(MONTH).agg(F.count(F.lit(1)).alias("reviews")).orderBy(MONTH)


def monthly_avg_score(df):
    return month_bucket(df).groupBy(MONTH).agg(F.avg(S.SCORE).alias("avg_score")).orderBy(MONTH)


def monthly_helpfulness(df):
    """Mean ratio per month over the reviews that have votes."""
    voted = month_bucket(df).filter(F.col(S.VOTES_ALL) > 0)
    return voted.groupBy(MONTH).agg(F.avg(S.RATIO).alias("avg_helpfulness")).orderBy(MONTH)


def last_n_years(trend, years):
    """Months from the same month ``years`` before the latest one on, that month included."""
    latest = F.max(MONTH).over(Window.partitionBy())
    kept = trend.withColumn("_from", F.add_months(latest, -12 * years)).filter(F.col(MONTH) >= F.col("_from"))
    return kept.drop("_from").orderBy(MONTH)


def period_volume(trend):
    return trend.agg(F.coalesce(F.sum("reviews"), F.lit(0)).alias("reviews"))


def period_avg_score(trend):
    """Mean of the monthly means, each month with the same weight; 0 without months."""
    return trend.agg(F.coalesce(F.avg("avg_score"), F.lit(0.0)).alias("avg_score"))


def product_monthly_score(df, product=None):
    """Mean score per month of one product, or of every product."""
    if product is not None:
        df = df.filter(F.col(S.PRODUCT) == product)
    rows = month_bucket(df).filter(F.col(S.PRODUCT).isNotNull())
    return rows.groupBy(S.PRODUCT, MONTH).agg(F.avg(S.SCORE).alias("avg_score"))


def product_current_score(trend):
    """The latest month's mean of each product of a product rollup."""
    return trend.groupBy(S.PRODUCT).agg(
        F.max(MONTH).alias(MONTH), F.max_by("avg_score", MONTH).alias("current_score")
    )


def trend_direction(trend, column="avg_helpfulness"):
    """First and last month of a rollup compared; null direction without months."""
    ends = trend.agg(
        F.min_by(column, MONTH).alias("start_avg"),
        F.max_by(column, MONTH).alias("end_avg"),
        F.count(F.lit(1)).alias("_months"),
    )
    start, end = F.round("start_avg", 9), F.round("end_avg", 9)
    label = F.when(end > start, "increased").when(end < start, "decreased").otherwise("remained stable")
    return ends.withColumn("direction", F.when(F.col("_months") > 0, label)).drop("_months")
