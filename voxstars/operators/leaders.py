"""Product and user leaderboards. Ties are ordered by the key."""

from pyspark.sql import functions as F

from voxstars import schema as S


def _counts(df, key):
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("reviews"))


def top_products_by_volume(df, n=10):
    return _counts(df, S.PRODUCT).orderBy(F.desc("reviews"), S.PRODUCT).limit(n)


def most_active_users(df, n=10):
    return _counts(df, S.USER).orderBy(F.desc("reviews"), S.USER).limit(n)


def top_products_by_score(df, n=10, min_reviews=50):
    """The minimum count and the mean come from one grouping: no join back to the reviews."""
    products = (
        df.filter(F.col(S.PRODUCT).isNotNull())
        .groupBy(S.PRODUCT)
        .agg(F.avg(S.SCORE).alias("avg_score"), F.count(F.lit(1)).alias("_n"))
    )
    kept = products.filter((F.col("_n") >= min_reviews) & F.col("avg_score").isNotNull())
    return kept.drop("_n").orderBy(F.desc("avg_score"), S.PRODUCT).limit(n)


def top_users_by_avg_helpfulness(df, n=10, min_reviews=10):
    """Users with enough reviews of any kind, by the mean ratio of their voted reviews."""
    users = (
        df.filter(F.col(S.USER).isNotNull())
        .groupBy(S.USER)
        .agg(
            F.avg(F.when(F.col(S.VOTES_ALL) > 0, F.col(S.RATIO))).alias("avg_helpfulness"),
            F.count(F.lit(1)).alias("_n"),
        )
    )
    kept = users.filter((F.col("_n") >= min_reviews) & F.col("avg_helpfulness").isNotNull())
    return kept.drop("_n").orderBy(F.round("avg_helpfulness", 9).desc(), S.USER).limit(n)


def helpful_reviewer_leaderboard(voted, min_votes=10, n=10):
    users = (
        voted.filter(F.col(S.USER).isNotNull())
        .groupBy(S.USER)
        .agg(F.sum(S.VOTES_UP).alias("total_helpful_votes"), F.count(S.ID).alias("total_reviews"))
    )
    kept = users.filter(F.col("total_helpful_votes") >= min_votes)
    return kept.orderBy(F.desc("total_helpful_votes"), S.USER).limit(n)


def id_directory(df):
    """Every product and user id once, with its kind.

    Equal reviews share both ids, so raw reviews give the same directory as deduplicated ones. One
    scan emits both ids, and each map task merges repeats before the shuffle.
    """
    ids = F.array(
        F.struct(F.lit("product").alias("kind"), F.col(S.PRODUCT).alias("id")),
        F.struct(F.lit("user").alias("kind"), F.col(S.USER).alias("id")),
    )
    return df.select(F.inline(ids)).filter("id IS NOT NULL").distinct()


def sorted_product_ids(performance):
    """Products that can be looked up, in order."""
    return performance.select(S.PRODUCT).distinct().orderBy(S.PRODUCT)
