"""Key figures, distributions and aggregates."""

from itertools import combinations_with_replacement

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxstars import schema as S
from voxstars.functions import columns as C
from voxstars.functions.quantiles import exact_quantiles


def percent(part, whole):
    return F.try_divide(part, whole) * 100


def kpis(df):
    """Reviews, distinct products and users, mean score.

    Two groupings with map-side merging, each over one narrow column: several ``countDistinct`` in one
    aggregate would send every row through the shuffle once per column and once more (Expand).
    """
    by_product = df.groupBy(S.PRODUCT).agg(
        F.count(F.lit(1)).alias("n"), F.sum(S.SCORE).alias("stars"), F.count(S.SCORE).alias("scored")
    )
    products = by_product.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_reviews"),
        F.count(S.PRODUCT).alias("unique_products"),
        F.try_divide(F.sum("stars"), F.sum("scored")).alias("avg_score"),
    )
    users = df.select(S.USER).distinct().agg(F.count(S.USER).alias("unique_customers"))
    joined = products.crossJoin(F.broadcast(users))  # one row each
    return joined.select("total_reviews", "unique_products", "unique_customers", "avg_score")


def score_distribution(df):
    return (
        df.filter(F.col(S.SCORE).isNotNull())
        .groupBy(S.SCORE)
        .agg(F.count(F.lit(1)).alias("reviews"))
        .orderBy(S.SCORE)
    )


def five_star_share(df):
    share = percent(F.count_if(F.col(S.SCORE) == 5), F.count(S.SCORE))
    return df.agg(F.coalesce(share, F.lit(0.0)).alias("five_star_pct"))


def helpfulness_histogram(df, nbins=50):
    """Rows per bin [i/nbins, (i+1)/nbins) of the vote ratio; reviews without votes are in bin 0."""
    return (
        df.withColumn("bin", C.helpfulness_bin(nbins))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("reviews"))
        .orderBy("bin")
    )


def highly_helpful_share(df):
    """Reviews with a ratio of exactly 1 in percent of the voted ones; 0 when none has votes."""
    share = percent(F.count_if(F.col(S.RATIO) == 1.0), F.count_if(F.col(S.VOTES_ALL) > 0))
    return df.agg(F.coalesce(share, F.lit(0.0)).alias("highly_helpful_pct"))


def zero_helpful_share(voted):
    """Voted reviews that nobody found helpful, in percent; null when none has votes."""
    return voted.agg(percent(F.count_if(F.col(S.RATIO) == 0), F.count(F.lit(1))).alias("zero_helpful_pct"))


def sentiment_distribution(df):
    """Reviews and percentage per sentiment class of the stars; unclassed scores do not count."""
    everything = Window.partitionBy()  # three rows
    return (
        df.withColumn("sentiment", C.mapped_sentiment())
        .filter(F.col("sentiment").isNotNull())
        .groupBy("sentiment")
        .agg(F.count(F.lit(1)).alias("reviews"))
        .withColumn("pct", percent(F.col("reviews"), F.sum("reviews").over(everything)))
    )


def helpfulness_by_score(voted):
    return (
        voted.filter(F.col(S.SCORE).isNotNull())
        .groupBy(S.SCORE)
        .agg(F.avg(S.RATIO).alias("avg_helpfulness"))
        .orderBy(S.SCORE)
    )


def best_score_for_helpfulness(voted):
    """The star value with the highest mean ratio; the lowest one on ties."""
    means = helpfulness_by_score(voted)
    return means.orderBy(F.round("avg_helpfulness", 9).desc_nulls_last(), S.SCORE).limit(1)


def length_bin_score(df, keep_empty=False, exclude_max=False):
    """Mean score per length bin in bin order.

    ``exclude_max`` leaves out the longest reviews, as a last bin does whose open right edge is the
    maximum; ``keep_empty`` lists all six bins, with a null mean where nothing falls.
    """
    # First one row per length: the maximum is then taken over that short list, not over the reviews.
    lengths = df.groupBy(S.LENGTH).agg(F.sum(S.SCORE).alias("total"), F.count(S.SCORE).alias("n"))
    if exclude_max:
        longest = F.max(S.LENGTH).over(Window.partitionBy())
        lengths = lengths.withColumn("longest", longest).filter(F.col(S.LENGTH) < F.col("longest"))
    means = (
        lengths.withColumn("bin", C.length_bin_index())
        .groupBy("bin")
        .agg(F.try_divide(F.sum("total"), F.sum("n")).alias("avg_score"))
    )
    if keep_empty:
        bins = df.sparkSession.range(len(S.LENGTH_LABELS)).select(F.col("id").cast("int").alias("bin"))
        means = bins.join(means, "bin", "left")
    else:
        means = means.filter("bin IS NOT NULL AND avg_score IS NOT NULL")
    return means.select("bin", C.length_bin_label("bin").alias("label"), "avg_score").orderBy("bin")


def best_length_bin(df):
    """The bin with the highest mean score; the earliest one on ties."""
    return length_bin_score(df).orderBy(F.col("avg_score").desc_nulls_last(), "bin").limit(1)


def product_performance(df, min_reviews=20):
    return (
        df.filter(F.col(S.PRODUCT).isNotNull())
        .groupBy(S.PRODUCT)
        .agg(
            F.avg(S.SCORE).alias("AverageScore"),
            F.count(F.lit(1)).alias("ReviewCount"),
            F.avg(S.RATIO).alias("AverageHelpfulnessRatio"),
        )
        .filter(F.col("ReviewCount") >= min_reviews)
    )


def performance_thresholds(performance):
    """One row: exact upper and lower quartiles of the mean score and of the review count."""
    quartiles = exact_quantiles(performance, ["AverageScore", "ReviewCount"], [0.25, 0.75])
    return quartiles.select(
        F.col("AverageScore_0").alias("score_low"),
        F.col("AverageScore_1").alias("score_high"),
        F.col("ReviewCount_0").alias("count_low"),
        F.col("ReviewCount_1").alias("count_high"),
    )


def correlation_matrix(df, columns=S.CORRELATION_COLUMNS):
    """Pearson correlation of every pair over the rows where both are known, as rows (x, y, r).

    All pairs come from one pass. A constant column gives null instead of a division error.
    """
    present = [c for c in columns if c in df.columns]
    number = {c: F.col(c).cast("double") for c in present}

    def known(a, b):
        return F.when(F.col(b).isNotNull(), number[a])

    pairs = list(combinations_with_replacement(present, 2))
    r = {}
    for a, b in pairs:
        if a == b:
            r[a, b] = F.when(F.stddev_pop(number[a]) > 0, F.lit(1.0))
        else:
            spread = F.stddev_pop(known(a, b)) * F.stddev_pop(known(b, a))
            r[a, b] = F.try_divide(F.covar_pop(number[a], number[b]), spread)
    wide = df.agg(*[r[p].alias(f"r{i}") for i, p in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"r{i}").alias("r")))
    return wide.select(F.inline(F.array(*cells)))
