"""Monthly state: sums per month, product and score that add up, kept as one partition a month.

Equal reviews have equal times, so a month's deduplicated reviews, and its state, depend on that month
alone. A new month writes its own partition; a month that gets late reviews is computed again and
replaced; no other month is read or written. The reports on trends and products follow from the
state, whose size grows with products and months instead of reviews and texts.
"""

from pyspark.sql import functions as F

from voxstars import schema as S
from voxstars.functions import columns as C
from voxstars.operators.metrics import percent
from voxstars.operators.trends import MONTH

SCHEMA = f"{S.PRODUCT} string, {S.SCORE} double, reviews long, voted long, ratio_sum double, votes_up long, {MONTH} date"


def monthly_state(df):
    """State of prepared reviews. Unknown months, products and scores have rows of their own."""
    has_votes = F.col(S.VOTES_ALL) > 0
    return df.groupBy(C.month_of().alias(MONTH), S.PRODUCT, S.SCORE).agg(
        F.count(F.lit(1)).alias("reviews"),
        F.count_if(has_votes).alias("voted"),
        F.coalesce(F.sum(F.when(has_votes, F.col(S.RATIO))), F.lit(0.0)).alias("ratio_sum"),
        F.coalesce(F.sum(S.VOTES_UP), F.lit(0)).alias("votes_up"),
    )


def write_months(state, path):
    """Replace the months that the state has; others keep their files.

    The rows are dealt by month first, so a month is few files; adaptive execution splits a large one.
    """
    columns = [f.split()[0] for f in SCHEMA.split(", ")]
    dealt = state.select(*columns).hint("rebalance", MONTH)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)


def load_state(spark, path):
    return spark.read.schema(SCHEMA).parquet(path)


def _mean(total, n):
    return F.try_divide(F.sum(total), F.sum(n))


def _score_sum():
    return F.col(S.SCORE) * F.col("reviews")


def _scored():
    return F.when(F.col(S.SCORE).isNotNull(), F.col("reviews")).otherwise(0)


def _by_month(state):
    return state.filter(F.col(MONTH).isNotNull()).groupBy(MONTH)


def monthly_volume(state):
    return _by_month(state).agg(F.sum("reviews").alias("reviews")).orderBy(MONTH)


def monthly_avg_score(state):
    return _by_month(state).agg(_mean(_score_sum(), _scored()).alias("avg_score")).orderBy(MONTH)


def monthly_helpfulness(state):
    """Months in which some review has votes."""
    return _by_month(state.filter("voted > 0")).agg(_mean("ratio_sum", "voted").alias("avg_helpfulness")).orderBy(MONTH)


def product_monthly_score(state, product=None):
    rows = state if product is None else state.filter(F.col(S.PRODUCT) == product)
    rows = rows.filter(F.col(MONTH).isNotNull() & F.col(S.PRODUCT).isNotNull())
    return rows.groupBy(S.PRODUCT, MONTH).agg(_mean(_score_sum(), _scored()).alias("avg_score"))


def product_performance(state, min_reviews=20):
    """Reviews without votes count with ratio 0, as they do in the reviews' own mean."""
    return (
        state.filter(F.col(S.PRODUCT).isNotNull())
        .groupBy(S.PRODUCT)
        .agg(
            _mean(_score_sum(), _scored()).alias("AverageScore"),
            F.sum("reviews").alias("ReviewCount"),
            _mean("ratio_sum", "reviews").alias("AverageHelpfulnessRatio"),
        )
        .filter(F.col("ReviewCount") >= min_reviews)
    )


def score_distribution(state):
    return state.filter(F.col(S.SCORE).isNotNull()).groupBy(S.SCORE).agg(F.sum("reviews").alias("reviews")).orderBy(S.SCORE)


def five_star_share(state):
    stars = F.sum(F.when(F.col(S.SCORE) == 5, F.col("reviews")).otherwise(0))
    return state.agg(F.coalesce(percent(stars, F.sum(_scored())), F.lit(0.0)).alias("five_star_pct"))


def top_products_by_volume(state, n=10):
    counts = state.filter(F.col(S.PRODUCT).isNotNull()).groupBy(S.PRODUCT).agg(F.sum("reviews").alias("reviews"))
    return counts.orderBy(F.desc("reviews"), S.PRODUCT).limit(n)
