"""Product segments by quality and popularity."""

from pyspark.sql import functions as F

from voxstars import schema as S
from voxstars.functions.ranking import top_per_group
from voxstars.operators.metrics import performance_thresholds

CATEGORY = "Category"


def classify_products(performance, thresholds=None):
    """Label every product by its quartiles.

    The last label takes all products that no other rule covers, mid-range ones included. Means are
    compared after rounding to nine digits, so a product on a threshold is on it in any row order.
    """
    if thresholds is None:
        thresholds = performance_thresholds(performance)
    score, high, low = (F.round(c, 9) for c in ("AverageScore", "score_high", "score_low"))
    count = F.col("ReviewCount")
    label = (
        F.when((score >= high) & (count >= F.col("count_high")), S.CASH_COW)
        .when((score < low) & (count >= F.col("count_high")), S.PROBLEM_CHILD)
        .when((score >= high) & (count < F.col("count_low")), S.HIDDEN_GEM)
        .otherwise(S.UNDERPERFORMER)
    )
    joined = performance.crossJoin(F.broadcast(thresholds))  # one row
    return joined.withColumn(CATEGORY, label).select(*performance.columns, CATEGORY)


def segment_sizes(classified):
    return classified.groupBy(CATEGORY).agg(F.count(F.lit(1)).alias("products"))


def segment_top(classified, k=20):
    """The first k products of each segment: problem children by lowest score, underperformers by
    fewest reviews, the others by most reviews; ties by product id."""
    category = F.col(CATEGORY)
    priority = (
        F.when(category == S.PROBLEM_CHILD, F.round("AverageScore", 9))
        .when(category == S.UNDERPERFORMER, F.col("ReviewCount").cast("double"))
        .otherwise(-F.col("ReviewCount").cast("double"))
    )
    ranked = top_per_group(classified, [CATEGORY], [priority.asc_nulls_last(), F.col(S.PRODUCT)], k, S.PRODUCT)
    return ranked.select(CATEGORY, "rank", S.PRODUCT, "AverageScore", "ReviewCount")


def product_lookup(classified, product):
    """Figures of one product, its label split into name and description."""
    name = F.split_part(CATEGORY, F.lit(" ("), F.lit(1))
    description = F.regexp_extract(CATEGORY, r"\((.*)\)$", 1)
    return classified.filter(F.col(S.PRODUCT) == product).select(
        S.PRODUCT,
        "AverageScore",
        "ReviewCount",
        "AverageHelpfulnessRatio",
        name.alias("category_name"),
        description.alias("category_description"),
    )
