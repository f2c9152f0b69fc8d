"""Filters, keyword search, semi-joins, samples and drill-down."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxstars import schema as S
from voxstars.functions import columns as C
from voxstars.functions.pieces import may_match
from voxstars.functions.sizing import salted_join

CELL_BITS = 20
DRAW_BITS = 60


def filter_score_range(df, lo, hi):
    return df.filter(F.col(S.SCORE).between(lo, hi))


def keyword_matches(df, query, literal=False):
    """Reviews whose combined text contains the query, a regular expression unless ``literal``.

    Case is ignored, and the classes \\w, \\d, \\s and \\b cover all of Unicode. An empty query
    matches nothing. Where every match holds a literal piece of the query, only texts with that piece
    are compared with the query itself.
    """
    if not query:
        return df.filter(F.lit(False))
    if literal:
        matches = F.contains(F.lower(S.COMBINED), F.lower(F.lit(query)))
    else:
        matches = F.col(S.COMBINED).rlike(f"(?iU){query}")
    held = may_match(F.col(S.COMBINED), query, literal)
    # One expression: of two filters Spark would run the pattern first.
    return df.filter(matches if held is None else F.when(held, matches))


def keyword_count(df, query, literal=False):
    return keyword_matches(df, query, literal).agg(F.count(F.lit(1)).alias("matches"))


def newest(df, k=10):
    found = df.orderBy(F.col(S.TIME).desc_nulls_last(), S.ID).limit(k)
    return found.select(S.ID, S.TIME, S.SCORE, S.RATIO, S.SUMMARY, S.TEXT)


def keyword_search(df, query, k=10, literal=False):
    """The newest k matches."""
    return newest(keyword_matches(df, query, literal), k)


def semi_join_min_count(df, key, minimum):
    """Reviews whose product (or user) has at least ``minimum`` reviews.

    The counts are made by a grouping with map-side merging; the join back is salted by review, so
    a product with a third of all reviews is spread over many tasks.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= minimum)
    return salted_join(df, counts.select(key), key, "left_semi", [S.ID])


def most_helpful_reviews(voted, min_ratio=0.8, min_votes=5, k=10):
    kept = voted.filter((F.col(S.RATIO) >= min_ratio) & (F.col(S.VOTES_ALL) >= min_votes))
    return kept.orderBy(F.desc(S.RATIO), F.desc(S.VOTES_ALL), S.ID).limit(k)


def least_helpful_reviews(voted, min_votes=5, k=10):
    kept = voted.filter((F.col(S.RATIO) == 0) & (F.col(S.VOTES_ALL) >= min_votes))
    return kept.orderBy(F.desc(S.VOTES_ALL), S.ID).limit(k)


def recent_reviews(df, wanted, k=20):
    """The newest k reviews of a product; of a user when no product has that id.

    Rows of a product sort before rows of a user, so one pass finds both; among the k kept rows the
    second kind is then dropped if the first is there.
    """
    of_product = F.coalesce(F.col(S.PRODUCT) == wanted, F.lit(False))
    hits = df.filter((F.col(S.PRODUCT) == wanted) | (F.col(S.USER) == wanted))
    top = (
        hits.withColumn("_product", of_product)
        .orderBy(F.desc("_product"), F.col(S.TIME).desc_nulls_last(), S.ID)
        .limit(k)
    )
    any_product = F.max("_product").over(Window.partitionBy())  # at most k rows
    kept = top.withColumn("_any", any_product).filter(F.col("_product") == F.col("_any"))
    return kept.select(S.ID, S.TIME, S.SCORE, S.RATIO, S.SUMMARY, S.TEXT)


def draw_number(key, seed):
    """A number of 60 bits that any engine with MD5 can repeat: the first 15 hex digits of MD5("key:seed")."""
    text = F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def sample_rows(df, n, seed=42, key=S.ID, keys=None):
    """n rows without replacement, or all when there are no more; the same rows on every run.

    The sample is the n smallest (number drawn for the id, id). A histogram over the leading bits finds
    the cell with the n-th row, only that cell's ids are ranked, and the rows are then filtered by
    that one pair. So no task holds the sample, whatever its size. Ids must be unique. ``keys``, the
    written ids of ``df``, spares the first two steps the work behind its rows.
    """
    h = draw_number(key, seed)
    hashed = (df if keys is None else keys).select(h.alias("h"), F.col(key).alias("k")).withColumn("cell", F.shiftright("h", DRAW_BITS - CELL_BITS))
    running = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = hashed.groupBy("cell").agg(F.count(F.lit(1)).alias("c")).withColumn("upto", F.sum("c").over(running))
    cut = cells.filter((F.col("upto") >= n) & (F.col("upto") - F.col("c") < n)).select(
        "cell", (n - F.col("upto") + F.col("c")).alias("need")
    )
    last = (
        hashed.join(F.broadcast(cut), "cell")  # at most one row
        .withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("h", "k")))
        .filter("r = need")
        .agg(F.max("h").alias("_h"), F.max("k").alias("_k"))
    )
    inside = F.col("_h").isNull() | (h < F.col("_h")) | ((h == F.col("_h")) & (F.col(key) <= F.col("_k")))
    return df.crossJoin(F.broadcast(last)).filter(inside).drop("_h", "_k")  # one row


def length_vs_helpfulness(df, n=50000, seed=42, keys=None):
    sample = sample_rows(df, n, seed, keys=keys)
    return sample.select(S.ID, S.LENGTH, S.RATIO, S.SCORE, S.SUMMARY, S.TEXT)


def review_card(df):
    """The columns shown for one review."""
    title = F.when(F.col(S.SUMMARY) != "", F.col(S.SUMMARY)).otherwise("No Summary")
    return df.select(
        S.ID,
        F.concat(F.substring(title, 1, 60), F.lit("...")).alias("title"),
        F.col(S.SCORE).cast("int").alias("stars"),
        F.concat_ws("/", F.col(S.VOTES_UP), F.col(S.VOTES_ALL)).alias("helpful"),
        S.RATIO,
        S.PRODUCT,
        S.USER,
        C.minute_label().alias("written"),
        S.TEXT,
    )
