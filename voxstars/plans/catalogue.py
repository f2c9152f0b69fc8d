"""One query per operator over the review table derived from the given tables.

Queries shape their output for comparison: dates and times as text, whole texts as their MD5,
means rounded to nine digits. The library's own results carry the plain types.
"""

import uuid

from pyspark.sql import functions as F

from voxstars import schema as S
from voxstars.functions import columns as C
from voxstars.operators import bayes as B
from voxstars.operators import distinct as D
from voxstars.operators import leaders as K
from voxstars.operators import leastsquares as L
from voxstars.operators import metrics as A
from voxstars.operators import models as M
from voxstars.operators import prepare as P
from voxstars.operators import search as Q
from voxstars.operators import segments as G
from voxstars.operators import state as Z
from voxstars.operators import text as N
from voxstars.operators import trends as T
from voxstars.operators import wordindex as X
from voxstars.session import shared_folder
from voxstars.sources import vocabulary
from voxstars.sources.csv import read_reviews, read_split_reviews
from voxstars.sources.staging import drop, shared_path, stage
from voxstars.sources.tables import reviews_from_tables

QUERIES = {}

FILE_COLUMNS = [f.name for f in S.CSV_SCHEMA]

KEYWORD = "worthless|red wid.et"
ACCENTED = "ÉMENT"
PRODUCT_ID = "P7"
USER_ID = "U7"
MIN_USER_REVIEWS = 45
CSV_PART_BYTES = 8 << 30  # of plain CSV on disk at a time, more where it takes MAX_CSV_PARTS parts
MAX_CSV_PARTS = 16  # each part joins the tables again


def query(name):
    """Register a function of the raw reviews as a query of (session, folder)."""

    def register(f):
        QUERIES[name] = lambda spark, folder: f(reviews_from_tables(spark, folder))
        return f

    return register


def table_query(name):
    """Register a function of (session, folder) as it is."""

    def register(f):
        QUERIES[name] = f
        return f

    return register


def text_of(c):
    return F.col(c).cast("string").alias(c)


def digest(c):
    return F.md5(c).alias(f"{c.lower()}_md5")


def rounded(c, digits=9):
    return F.round(c, digits).alias(c)


# --- sources and preparation -------------------------------------------------------------------


def _csv_of(raw, compression="none"):
    spark = raw.sparkSession
    path = f"{shared_folder(spark)}/reviews-{uuid.uuid4().hex}.csv"
    raw = raw.withColumn(S.PROFILE_NAME, F.lit(None).cast("string"))
    plain = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "compression": compression}
    raw.select(*FILE_COLUMNS).write.options(**plain).csv(path)
    return path


def _read(reviews):
    return P.coerce_score(reviews).withColumn(S.TEXT, F.md5(S.TEXT)).select(*FILE_COLUMNS)


@table_query("p1_read_reviews")
def read_back(spark, folder):
    # Files with line breaks in fields are read whole, so compressing them takes no parallelism away.
    return _read(read_reviews(spark, _csv_of(reviews_from_tables(spark, folder), "gzip")))


def _csv_parts(raw, at_most):
    """The reviews in at most MAX_CSV_PARTS parts, of which the whole texts come to some ``at_most`` bytes each; a row is in one part."""
    texts = F.sum(F.coalesce(F.octet_length(S.SUMMARY), F.lit(0)) + F.coalesce(F.octet_length(S.TEXT), F.lit(0)) + F.lit(100))
    n = min(-(-(raw.agg(texts).first()[0] or 1) // at_most), MAX_CSV_PARTS)
    place = F.pmod(F.xxhash64(S.PRODUCT, S.USER), F.lit(n))
    return [raw.filter(place == i) for i in range(n)]


@table_query("p1_read_split_reviews")
def read_back_split(spark, folder):
    # Compressed files are not split, and plain ones take as much disk as the texts: so a part of the
    # reviews is written, read and dropped before the next, and the disk holds one part at a time.
    read = shared_path(spark, "read")
    for part in _csv_parts(reviews_from_tables(spark, folder), CSV_PART_BYTES):
        path = _csv_of(part)
        out = _read(read_split_reviews(spark, path))
        out.write.mode("append").option("compression", "zstd").parquet(read)
        drop(spark, path)
    return spark.read.schema(out.schema).parquet(read)


@query("p2_drop_columns")
def drop_columns(raw):
    out = P.prepare(raw.withColumn(S.PROFILE_NAME, F.lit(None).cast("string")), P.OVERVIEW)
    return out.withColumns({S.TIME: F.col(S.TIME).cast("string"), S.TEXT: F.md5(S.TEXT), S.RATIO: F.round(S.RATIO, 9)})


@query("p3_drop_nulls")
def drop_nulls(raw):
    return P.drop_nulls(raw, S.TEXT, S.SUMMARY, S.SCORE).select(S.ID, S.SCORE, S.SUMMARY, digest(S.TEXT))


@query("p4_fill_text_nulls")
def fill_text_nulls(raw):
    return P.fill_text_nulls(raw).select(S.ID, S.SUMMARY, digest(S.TEXT))


@query("p5_coerce_score")
def coerce_score(raw):
    spelled = F.when(F.col(S.TIME).isNull(), "abc").when(F.col(S.SCORE) == 2, "NaN").otherwise(
        F.concat(F.col(S.SCORE).cast("string"), F.lit(".5"))
    )
    return P.coerce_score(raw.withColumn(S.SCORE, spelled)).select(S.ID, S.SCORE)


@query("p6_epoch_to_time")
def epoch_to_time(raw):
    moved = F.when(F.col(S.VOTES_ALL) == 7, F.lit(10**14)).otherwise(F.col(S.TIME) + F.col(S.ID) % 86400 - 10**9)
    return raw.select(S.ID, C.time_of(moved).cast("string").alias("time"))


@query("p7_helpfulness_ratio")
def helpfulness_ratio(raw):
    return P.with_ratio(raw).select(S.ID, rounded(S.RATIO))


@query("p8_cap_ratio")
def cap_ratio(raw):
    ratio = C.helpfulness_ratio()
    return raw.select(
        S.ID,
        F.round(C.cap_ratio(ratio), 9).alias("capped"),
        F.round(C.cap_ratio(ratio, 1.0, 0.98), 9).alias("replaced"),
    )


@query("p9_combined_text")
def combined_text(raw):
    return P.fill_text_nulls(raw).withColumn(S.COMBINED, C.combined_text()).select(S.ID, digest(S.COMBINED))


@query("p10_review_length")
def review_length(raw):
    return P.fill_text_nulls(raw).select(S.ID, C.review_length().cast("bigint").alias("length"))


@query("p11_dedup_reviews")
def dedup_reviews(raw):
    return P.dedup_reviews(P.fill_text_nulls(P.coerce_score(raw))).select(S.ID, S.PRODUCT, S.USER, S.VOTES_UP)


@query("p12_voted_reviews")
def voted_reviews(raw):
    kept, copies = P.prepare_helpfulness(raw)
    tagged = P.voted(kept).select(S.ID, F.lit("deduplicated").alias("form"))
    return tagged.unionByName(copies.select(S.ID, F.lit("with copies").alias("form")))


@query("p13_sentiment_from_score")
def sentiment_from_score(raw):
    half = F.when(F.col(S.VOTES_ALL) == 3, F.col(S.SCORE) + 0.5).otherwise(F.col(S.SCORE).cast("double"))
    known = raw.filter(F.col(S.SCORE).isNotNull()).withColumn(S.SCORE, half)
    return known.select(S.ID, C.true_sentiment().alias("by_range"), C.mapped_sentiment().alias("by_star"))


@query("p14_validate_reviews")
def validate_reviews(raw):
    return P.validate_reviews(P.prepare(raw, P.REVENUE))


# --- metrics -----------------------------------------------------------------------------------


@query("a1_kpis")
def kpis(raw):
    return A.kpis(P.prepare(raw, P.OVERVIEW)).withColumn("avg_score", F.round("avg_score", 9))


@query("a2_score_distribution")
def score_distribution(raw):
    return A.score_distribution(P.prepare(raw, P.OVERVIEW))


@query("a3_five_star_share")
def five_star_share(raw):
    return A.five_star_share(P.prepare(raw, P.OVERVIEW)).select(rounded("five_star_pct"))


@query("a4_helpfulness_histogram")
def helpfulness_histogram(raw):
    return A.helpfulness_histogram(P.prepare(raw, P.OVERVIEW))


@query("a4_helpfulness_histogram_voted")
def helpfulness_histogram_voted(raw):
    return A.helpfulness_histogram(P.prepare_helpfulness(raw)[1])


@query("a5_highly_helpful_share")
def highly_helpful_share(raw):
    return A.highly_helpful_share(P.prepare(raw, P.OVERVIEW)).select(rounded("highly_helpful_pct"))


@query("a6_zero_helpful_share")
def zero_helpful_share(raw):
    return A.zero_helpful_share(P.prepare_helpfulness(raw)[1]).select(rounded("zero_helpful_pct"))


@query("a7_sentiment_distribution")
def sentiment_distribution(raw):
    return A.sentiment_distribution(P.prepare(raw, P.SENTIMENT)).withColumn("pct", F.round("pct", 9))


@query("a8_helpfulness_by_score")
def helpfulness_by_score(raw):
    return A.helpfulness_by_score(P.prepare_helpfulness(raw)[1]).select(S.SCORE, rounded("avg_helpfulness"))


@query("a9_best_score_for_helpfulness")
def best_score_for_helpfulness(raw):
    return A.best_score_for_helpfulness(P.prepare_helpfulness(raw)[1]).select(S.SCORE, rounded("avg_helpfulness"))


def _bins(out):
    return out.select(F.col("bin").cast("bigint").alias("bin"), "label", rounded("avg_score"))


@query("a10_length_bin_score")
def length_bin_score(raw):
    return _bins(A.length_bin_score(P.prepare(raw, P.ADVANCED)))


@query("a11_length_bin_score_open")
def length_bin_score_open(raw):
    return _bins(A.length_bin_score(P.prepare(raw, P.SHARED), keep_empty=True, exclude_max=True))


@query("a12_best_length_bin")
def best_length_bin(raw):
    return _bins(A.best_length_bin(P.prepare(raw, P.ADVANCED)))


def _performance(raw):
    return A.product_performance(P.prepare(raw, P.REVENUE))


@query("a13_product_performance")
def product_performance(raw):
    return _performance(raw).select(
        S.PRODUCT, rounded("AverageScore"), "ReviewCount", rounded("AverageHelpfulnessRatio")
    )


@query("a14_performance_thresholds")
def performance_thresholds(raw):
    out = A.performance_thresholds(stage(_performance(raw)))  # read by the histogram and by the cells
    return out.select(*[rounded(c) for c in out.columns])


@query("a15_correlation_matrix")
def correlation_matrix(raw):
    return A.correlation_matrix(P.prepare(raw, P.ADVANCED)).select("x", "y", rounded("r", 6))


@query("a15_correlation_matrix_shared")
def correlation_matrix_shared(raw):
    return A.correlation_matrix(P.prepare(raw, P.SHARED)).select("x", "y", rounded("r", 6))


# --- trends ------------------------------------------------------------------------------------


def _trend(out, *columns):
    return out.select(text_of(T.MONTH), *[rounded(c) for c in columns])


@query("t1_month_bucket")
def month_bucket(raw):
    return T.month_bucket(P.prepare(raw, P.HELPFULNESS)).select(S.ID, text_of(T.MONTH))


@query("t2_monthly_volume")
def monthly_volume(raw):
    return T.monthly_volume(P.prepare(raw, P.OVERVIEW)).select(text_of(T.MONTH), "reviews")


@query("t3_monthly_avg_score")
def monthly_avg_score(raw):
    return _trend(T.monthly_avg_score(P.prepare(raw, P.OVERVIEW)), "avg_score")


@query("t3_monthly_avg_score_sentiment")
def monthly_avg_score_sentiment(raw):
    return _trend(T.monthly_avg_score(P.prepare(raw, P.SENTIMENT)), "avg_score")


@query("t4_monthly_helpfulness")
def monthly_helpfulness(raw):
    return _trend(T.monthly_helpfulness(P.prepare(raw, P.HELPFULNESS)), "avg_helpfulness")


@query("t5_volume_last_3_years")
def volume_last_3_years(raw):
    trend = T.last_n_years(T.monthly_volume(P.prepare(raw, P.OVERVIEW)), 3)
    return trend.select(text_of(T.MONTH), "reviews")


@query("t5_score_last_1_year")
def score_last_1_year(raw):
    return _trend(T.last_n_years(T.monthly_avg_score(P.prepare(raw, P.SENTIMENT)), 1), "avg_score")


@query("t5_helpfulness_last_5_years")
def helpfulness_last_5_years(raw):
    return _trend(T.last_n_years(T.monthly_helpfulness(P.prepare(raw, P.HELPFULNESS)), 5), "avg_helpfulness")


@query("t6_period_volume")
def period_volume(raw):
    return T.period_volume(T.last_n_years(T.monthly_volume(P.prepare(raw, P.OVERVIEW)), 3))


@query("t7_period_avg_score")
def period_avg_score(raw):
    trend = T.last_n_years(T.monthly_avg_score(P.prepare(raw, P.OVERVIEW)), 3)
    return T.period_avg_score(trend).select(rounded("avg_score"))


@query("t8_product_monthly_score")
def product_monthly_score(raw):
    out = T.product_monthly_score(P.prepare(raw, P.SENTIMENT))
    return out.select(S.PRODUCT, text_of(T.MONTH), rounded("avg_score"))


@query("t8_one_product_monthly_score")
def one_product_monthly_score(raw):
    one = raw.filter(F.col(S.PRODUCT) == PRODUCT_ID)  # equal reviews have equal products
    out = T.product_monthly_score(P.prepare(one, P.SENTIMENT, few=True), PRODUCT_ID)
    return out.select(S.PRODUCT, text_of(T.MONTH), rounded("avg_score"))


@query("t9_product_current_score")
def product_current_score(raw):
    out = T.product_current_score(T.product_monthly_score(P.prepare(raw, P.SENTIMENT)))
    return out.select(S.PRODUCT, text_of(T.MONTH), rounded("current_score"))


@query("t10_trend_direction")
def trend_direction(raw):
    trend = T.last_n_years(T.monthly_helpfulness(P.prepare(raw, P.HELPFULNESS)), 3)
    return T.trend_direction(trend).select(rounded("start_avg"), rounded("end_avg"), "direction")


# --- from the monthly state --------------------------------------------------------------------


def _state(raw):
    path = shared_path(raw.sparkSession, "state")
    Z.write_months(Z.monthly_state(P.prepare(raw, P.REVENUE)), path)
    return Z.load_state(raw.sparkSession, path)


@query("t2_monthly_volume_from_state")
def monthly_volume_from_state(raw):
    return Z.monthly_volume(_state(raw)).select(text_of(T.MONTH), "reviews")


@query("t3_monthly_avg_score_from_state")
def monthly_avg_score_from_state(raw):
    return _trend(Z.monthly_avg_score(_state(raw)), "avg_score")


@query("t5_helpfulness_last_5_years_from_state")
def helpfulness_last_5_years_from_state(raw):
    return _trend(T.last_n_years(Z.monthly_helpfulness(_state(raw)), 5), "avg_helpfulness")


@query("t7_period_avg_score_from_state")
def period_avg_score_from_state(raw):
    return T.period_avg_score(T.last_n_years(Z.monthly_avg_score(_state(raw)), 3)).select(rounded("avg_score"))


@query("t8_product_monthly_score_from_state")
def product_monthly_score_from_state(raw):
    return Z.product_monthly_score(_state(raw)).select(S.PRODUCT, text_of(T.MONTH), rounded("avg_score"))


@query("t9_product_current_score_from_state")
def product_current_score_from_state(raw):
    out = T.product_current_score(Z.product_monthly_score(_state(raw)))
    return out.select(S.PRODUCT, text_of(T.MONTH), rounded("current_score"))


@query("a2_score_distribution_from_state")
def score_distribution_from_state(raw):
    return Z.score_distribution(_state(raw))


@query("a13_product_performance_from_state")
def product_performance_from_state(raw):
    return Z.product_performance(_state(raw)).select(
        S.PRODUCT, rounded("AverageScore"), "ReviewCount", rounded("AverageHelpfulnessRatio")
    )


def _kpi_tables(raw):
    columns = P.prepare(raw, P.REVENUE).select(S.PRODUCT, S.USER, S.SCORE, S.TIME, S.VOTES_UP, S.VOTES_ALL, S.RATIO)
    prepared = stage(columns, compression="zstd")
    bitmaps = [stage(D.distinct_bitmaps(prepared, c, D.dense_ids(prepared.select(c)))) for c in (S.PRODUCT, S.USER)]
    return stage(Z.monthly_state(prepared)), *bitmaps


@query("a1_kpis_from_state")
def kpis_from_state(raw):
    return D.kpis(*_kpi_tables(raw)).withColumn("avg_score", F.round("avg_score", 9))


@query("a1_kpis_last_3_years_from_state")
def kpis_last_3_years(raw):
    out = D.kpis(*[T.last_n_years(t.filter(F.col(T.MONTH).isNotNull()), 3) for t in _kpi_tables(raw)])
    return out.withColumn("avg_score", F.round("avg_score", 9))


# --- filters, search, leaderboards -------------------------------------------------------------


def _reviews(out):
    time = F.col(S.TIME).cast("string").alias(S.TIME)
    return out.select(S.ID, time, S.SCORE, rounded(S.RATIO), S.SUMMARY, digest(S.TEXT))


@query("f1_filter_score_range")
def filter_score_range(raw):
    return Q.filter_score_range(P.prepare(raw, P.SENTIMENT), 2, 4).select(S.ID, S.SCORE)


@query("f2_keyword_search")
def keyword_search(raw):
    return _reviews(Q.keyword_search(P.prepare(raw, P.ADVANCED), KEYWORD))


@query("f2_keyword_count")
def keyword_count(raw):
    return Q.keyword_count(P.prepare(raw, P.ADVANCED), KEYWORD)


@query("f2_keyword_search_shared")
def keyword_search_shared(raw):
    return _reviews(Q.keyword_search(P.prepare(raw, P.SHARED), ACCENTED))


@query("f2_keyword_count_literal")
def keyword_count_literal(raw):
    return Q.keyword_count(P.prepare(raw, P.SHARED), " the the", literal=True)


def _indexed(raw, profile):
    # The combined text repeats summary and text, so it is put together where the rows are read.
    stored = stage(P.prepare(raw, profile).drop(S.COMBINED), compression="zstd")
    reviews = stored.withColumn(S.COMBINED, C.combined_text())
    path = shared_path(raw.sparkSession, "index")
    X.build_index(reviews, path)
    return reviews, raw.sparkSession.read.parquet(path)


@query("f2_keyword_search_indexed")
def keyword_search_indexed(raw):
    return _reviews(Q.newest(X.indexed_matches(*_indexed(raw, P.ADVANCED), KEYWORD)))


@query("f2_keyword_count_indexed")
def keyword_count_indexed(raw):
    return X.indexed_matches(*_indexed(raw, P.SHARED), " the the", literal=True).agg(F.count(F.lit(1)).alias("matches"))


@query("f3_semi_join_products")
def semi_join_products(raw):
    return Q.semi_join_min_count(P.prepare(raw, P.PRODUCT_USER), S.PRODUCT, 30).select(S.ID, S.PRODUCT)


@query("f3_semi_join_users")
def semi_join_users(raw):
    return Q.semi_join_min_count(P.prepare(raw, P.PRODUCT_USER), S.USER, MIN_USER_REVIEWS).select(S.ID, S.USER)


@query("f4_most_helpful_reviews")
def most_helpful_reviews(raw):
    return _reviews(Q.most_helpful_reviews(P.prepare_helpfulness(raw)[1]))


@query("f5_least_helpful_reviews")
def least_helpful_reviews(raw):
    return _reviews(Q.least_helpful_reviews(P.prepare_helpfulness(raw)[1]))


def _reviews_of(raw, wanted):
    # Product and user are part of the key of equal reviews, so the filter may come first.
    rows = raw.filter((F.col(S.PRODUCT) == wanted) | (F.col(S.USER) == wanted))
    return _reviews(Q.recent_reviews(P.prepare(rows, P.PRODUCT_USER, few=True), wanted))


@query("f6_recent_reviews_product")
def recent_reviews_product(raw):
    return _reviews_of(raw, PRODUCT_ID)


@query("f6_recent_reviews_user")
def recent_reviews_user(raw):
    return _reviews_of(raw, USER_ID)


@query("f7_sample_rows")
def sample_rows(raw):
    out = Q.sample_rows(P.prepare(raw, P.SHARED), 10000)
    return out.select(S.ID, S.SCORE, F.col(S.LENGTH).cast("bigint").alias(S.LENGTH))


@query("f8_length_vs_helpfulness")
def length_vs_helpfulness(raw):
    reviews = P.prepare(raw, P.ADVANCED)
    # Only ids are written: texts of the rows outside the sample are never kept.
    return Q.length_vs_helpfulness(reviews, 50000, keys=stage(reviews.select(S.ID))).select(
        S.ID, F.col(S.LENGTH).cast("bigint").alias(S.LENGTH), rounded(S.RATIO), S.SCORE, S.SUMMARY, digest(S.TEXT)
    )


def _cards(top):
    return Q.review_card(top).withColumns({S.RATIO: F.round(S.RATIO, 9), S.TEXT: F.md5(S.TEXT)})


@query("f9_review_card_most_helpful")
def review_card_most_helpful(raw):
    return _cards(Q.most_helpful_reviews(P.prepare_helpfulness(raw)[1], k=30))


@query("f9_review_card_least_helpful")
def review_card_least_helpful(raw):
    return _cards(Q.least_helpful_reviews(P.prepare_helpfulness(raw)[1], k=30))


@query("k1_top_products_by_volume")
def top_products_by_volume(raw):
    return K.top_products_by_volume(P.prepare(raw, P.PRODUCT_USER))


@query("k1_product_selector")
def product_selector(raw):
    return K.top_products_by_volume(P.prepare(raw, P.SENTIMENT), 20)


@query("k2_top_products_by_score")
def top_products_by_score(raw):
    out = K.top_products_by_score(P.prepare(raw, P.PRODUCT_USER), min_reviews=30)
    return out.select(S.PRODUCT, rounded("avg_score"))


@query("k3_most_active_users")
def most_active_users(raw):
    return K.most_active_users(P.prepare(raw, P.PRODUCT_USER))


@query("k4_top_users_by_avg_helpfulness")
def top_users_by_avg_helpfulness(raw):
    out = K.top_users_by_avg_helpfulness(P.prepare(raw, P.PRODUCT_USER))
    return out.select(S.USER, rounded("avg_helpfulness"))


@query("k5_helpful_reviewer_leaderboard")
def helpful_reviewer_leaderboard(raw):
    return K.helpful_reviewer_leaderboard(P.prepare_helpfulness(raw)[1])


@query("k6_id_directory")
def id_directory(raw):
    return K.id_directory(raw)


@query("k6_sorted_product_ids")
def sorted_product_ids(raw):
    return K.sorted_product_ids(_performance(raw))


# --- segments ----------------------------------------------------------------------------------


def _classified(raw):
    # Staged: thresholds and labels both read the product table, and the reviews are read once.
    return G.classify_products(stage(_performance(raw)))


@query("g1_classify_products")
def classify_products(raw):
    out = _classified(raw)
    return out.select(
        S.PRODUCT, rounded("AverageScore"), "ReviewCount", rounded("AverageHelpfulnessRatio"), G.CATEGORY
    )


@query("g2_segment_sizes")
def segment_sizes(raw):
    return G.segment_sizes(_classified(raw))


@query("g3_segment_top")
def segment_top(raw):
    out = G.segment_top(_classified(raw))
    return out.withColumns({"rank": F.col("rank").cast("bigint"), "AverageScore": F.round("AverageScore", 9)})


@query("g4_product_lookup")
def product_lookup(raw):
    out = G.product_lookup(_classified(raw), PRODUCT_ID)
    return out.withColumns({c: F.round(c, 9) for c in ("AverageScore", "AverageHelpfulnessRatio")})


# --- text --------------------------------------------------------------------------------------


@query("n1_clean_text_punct")
def clean_text_punct(raw):
    return N.with_clean_text(P.prepare(raw, P.SENTIMENT)).select(S.ID, F.md5("CleanText").alias("clean_md5"))


@query("n2_clean_text_alpha")
def clean_text_alpha(raw):
    out = N.with_letters_only(P.prepare(raw, P.SHARED))
    return out.select(S.ID, F.md5("Cleaned_Text_ML").alias("clean_md5"))


@query("n3_tokens")
def tokens(raw):
    found = N.tokens(P.prepare(raw, P.SENTIMENT))
    return found.groupBy(S.ID).agg(
        F.count("word").alias("words"), F.sum(F.length("word").cast("bigint")).alias("letters")
    )


@table_query("n4_lemmatise")
def lemmatise(spark, folder):
    found = N.tokens(P.prepare(reviews_from_tables(spark, folder), P.SENTIMENT))
    out = N.lemmatise(found, vocabulary.lemmas(spark, folder))
    return out.groupBy(S.ID).agg(
        F.count("lemma").alias("words"),
        F.count_if(F.col("lemma") != F.col("word")).alias("changed"),
        F.sum(F.length("lemma").cast("bigint")).alias("letters"),
    )


@query("n5_word_frequencies")
def word_frequencies(raw):
    return N.word_frequencies(P.prepare(raw, P.SENTIMENT))


@table_query("n5_word_frequencies_lemmas")
def word_frequencies_lemmas(spark, folder):
    reviews = P.prepare(reviews_from_tables(spark, folder), P.SENTIMENT)
    return N.word_frequencies(reviews, 1, 2, lemmas=vocabulary.lemmas(spark, folder))


@query("n6_word_frequencies_by_class")
def word_frequencies_by_class(raw):
    out = N.word_frequencies_by_class(P.prepare(raw, P.SHARED), S.TRUE_SENTIMENT)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


@table_query("n7_lexicon_sentiment")
def lexicon_sentiment(spark, folder):
    reviews = P.prepare(reviews_from_tables(spark, folder), P.SHARED)
    return N.lexicon_sentiment(reviews, vocabulary.lexicon(spark, folder))


# --- models ------------------------------------------------------------------------------------

_fitted = {}


def _models(spark, folder):
    """Sentiment and rating model fitted on all reviews, once per session and folder."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _fitted:
        reviews = P.prepare(reviews_from_tables(spark, folder), P.SHARED)
        _fitted[key] = M.fit_sentiment(reviews), M.fit_rating(reviews)
    return _fitted[key]


def _shared(spark, folder):
    return P.prepare(reviews_from_tables(spark, folder), P.SHARED)


def _bayes(spark, folder):
    """Naive Bayes on all reviews, once per session and folder."""
    key = (spark.sparkContext.applicationId, folder, "bayes")
    if key not in _fitted:
        _fitted[key] = B.fit_bayes(_shared(spark, folder))
    return _fitted[key]


def _scored(spark, folder):
    found = B.bayes_scores(_bayes(spark, folder), _shared(spark, folder), keep=(S.TRUE_SENTIMENT,))
    return found.select(S.ID, S.TRUE_SENTIMENT, S.PREDICTED)


@table_query("m1_score_sentiment")
def score_sentiment(spark, folder):
    return _scored(spark, folder)


@table_query("m2_predicted_distribution")
def predicted_distribution(spark, folder):
    return M.predicted_distribution(_scored(spark, folder))


def _judged(raw):
    """Labels from the stars against a fixed rule on the votes, so that SQL can repeat them."""
    rule = F.when(F.col(S.RATIO) >= 0.6, S.POSITIVE).when(F.col(S.RATIO) > 0.3, S.NEUTRAL).otherwise(S.NEGATIVE)
    return P.prepare(raw, P.SHARED).withColumn(S.PREDICTED, rule)


@query("m3_classification_report")
def classification_report(raw):
    out = M.classification_report(_judged(raw))
    return out.select("label", rounded("precision"), rounded("recall"), rounded("f1"), "support")


@table_query("m3_classification_report_model")
def classification_report_model(spark, folder):
    out = M.classification_report(_scored(spark, folder))
    return out.select("label", rounded("precision"), rounded("recall"), rounded("f1"), "support")


@query("m4_confusion_matrix")
def confusion_matrix(raw):
    return M.confusion_matrix(_judged(raw))


@table_query("m5_score_text")
def score_text(spark, folder):
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return M.score_text(_bayes(spark, folder), vocabulary.lexicon(spark, folder), texts, "doc_id")


@table_query("m6_score_rating")
def score_rating(spark, folder):
    reviews = _shared(spark, folder)
    model = L.fit_least_squares(reviews)
    return L.score_least_squares(model, reviews).select(S.ID, S.SCORE, F.col(M.RATING).cast("bigint").alias(M.RATING))


@query("m6_clamp_rating")
def clamp_rating(raw):
    guess = (F.col(S.VOTES_UP) * 5 - F.col(S.VOTES_ALL)) / F.lit(2.0)
    return raw.select(S.ID, M.clamp_rating(guess).cast("bigint").alias("rating"))


@table_query("m7_fit_models")
def fit_models(spark, folder):
    sentiment, rating = _models(spark, folder)
    logistic, linear = sentiment.stages[-2], rating.stages[-1]
    rows = [
        ("sentiment", logistic.numClasses, logistic.numFeatures, logistic.summary.totalIterations),
        ("rating", 1, linear.numFeatures, linear.summary.totalIterations),
    ]
    return spark.createDataFrame(rows, "model string, outputs int, features int, iterations int")


@table_query("m7_fit_bayes")
def fit_bayes(spark, folder):
    model = _bayes(spark, folder)
    return model.summary().withColumn("vocabulary", F.lit(model.vocabulary).cast("bigint"))


@table_query("m7_fit_rating")
def fit_rating(spark, folder):
    model = L.fit_least_squares(_shared(spark, folder))
    return L.coefficient_table(spark, model).select("term", rounded("coefficient", 12))


@table_query("n6_word_frequencies_by_predicted_class")
def word_frequencies_by_predicted_class(spark, folder):
    out = N.word_frequencies_by_class(B.score_bayes(_bayes(spark, folder), _shared(spark, folder)))
    return out.withColumn("rank", F.col("rank").cast("bigint"))
