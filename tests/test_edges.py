"""Edge cases on small tables."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxstars import schema as S
from voxstars.functions import columns as C
from voxstars.functions import sizing
from voxstars.functions.quantiles import exact_quantiles
from voxstars.functions.ranking import top_per_group
from voxstars.functions.stopwords import ENGLISH
from voxstars.operators import leaders as K
from voxstars.operators import metrics as A
from voxstars.operators import models as M
from voxstars.operators import prepare as P
from voxstars.operators import search as Q
from voxstars.operators import segments as G
from voxstars.operators import text as N
from voxstars.operators import trends as T
from voxstars.sources.csv import load_reviews, read_reviews, write_reviews
from voxstars.sources.tables import reviews_from_tables


def column(df, name, order="Id"):
    return [r[0] for r in df.orderBy(order).select(name).collect()]


def test_ratio_and_caps(make):
    df = make(dict(HelpfulnessNumerator=3, HelpfulnessDenominator=0), dict(HelpfulnessNumerator=3, HelpfulnessDenominator=2))
    assert column(P.prepare(df, P.REVENUE).withColumn("k", F.col(S.RATIO)).select("Id", "k"), "k") == [0.0]  # one review
    other = make(
        dict(HelpfulnessNumerator=3, HelpfulnessDenominator=0, Text="a"),
        dict(HelpfulnessNumerator=3, HelpfulnessDenominator=2, Text="b"),
    )
    assert column(P.prepare(other, P.REVENUE), S.RATIO) == [0.0, 1.5]
    assert column(P.prepare(other, P.PRODUCT_USER), S.RATIO) == [0.0, 1.0]
    assert column(P.prepare(other, P.ADVANCED), S.RATIO) == [0.0, 0.98]


def test_first_of_equal_reviews_is_kept(make):
    df = make(dict(Id=7, Text=None, Summary="x"), dict(Id=3, Text=None, Summary="y"), dict(Id=9, Text=None, Score=None))
    out = P.prepare(df, P.SENTIMENT)
    assert column(out, S.ID) == [3, 9]
    assert column(out, S.SUMMARY) == ["y", "good"]


def test_dedup_time_before_or_after_conversion(make):
    df = make(dict(Time=10**14), dict(Time=None), dict(Time=2 * 10**14))
    assert P.prepare(df, P.SENTIMENT).count() == 3
    assert P.prepare(df, P.OVERVIEW).count() == 1


def test_bad_scores_become_null_or_go(make):
    df = make(dict(Score="abc"), dict(Score="4"), dict(Score="NaN", Text="b"))
    assert column(P.prepare(df, P.REVENUE), S.SCORE) == [None, 4.0, None]
    assert column(P.prepare(df, P.SHARED), S.ID) == [2]


def test_times_out_of_range_are_null_and_leave_trends(make):
    df = P.prepare(make(dict(Time=None), dict(Time=10**14, Text="b"), dict(Time=-1, Text="c")), P.HELPFULNESS)
    assert column(df.withColumn("t", F.col(S.TIME).cast("string")), "t") == [None, None, "1969-12-31 23:59:59"]
    assert [str(r[0]) for r in T.monthly_volume(df).collect()] == ["1969-12-01"]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_do_not_depend_on_the_session_zone(spark, make, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # 2011-03-13 02:30 does not exist in New York
        df = P.prepare(make(dict(Time=1299983400), dict(Time=1349049600, Text="b")), P.HELPFULNESS_VOTED)
        cards = Q.review_card(df)
        assert column(cards, "written") == ["2011-03-13 02:30", "2012-10-01 00:00"]
        assert [str(r[0]) for r in T.monthly_volume(df).collect()] == ["2011-03-01", "2012-10-01"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_sentiment_variants(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 3.5D), (2, 4D), (3, 2.5D), (4, 2D) AS t(Id, Score)")
    assert column(df.withColumn("s", C.true_sentiment()), "s") == ["Neutral", "Positive", "Neutral", "Negative"]
    assert column(df.withColumn("s", C.mapped_sentiment()), "s") == [None, "Positive", None, "Negative"]


def test_length_bins(spark):
    lengths = [0, 49, 50, 149, 150, 499, 500, 999, 1000, 1999, 2000, 10**6]
    df = spark.createDataFrame(list(enumerate(lengths)), "Id int, ReviewLength int")
    expected = pd.cut(
        pd.Series(lengths), bins=[0, 50, 150, 500, 1000, 2000, 10**6 + 1], labels=list(S.LENGTH_LABELS), right=False
    )
    assert column(df.withColumn("b", C.length_bin_label(C.length_bin_index())), "b") == list(expected)


def test_open_bins_lose_the_longest_review(make):
    df = P.prepare(make(dict(Text="x" * 30), dict(Text="x" * 2500, Score="1"), dict(Text="x" * 2600, Score="3")), P.SHARED)
    rows = {r.label: r.avg_score for r in A.length_bin_score(df, keep_empty=True, exclude_max=True).collect()}
    assert rows == {"<50": 5.0, "50-150": None, "150-500": None, "500-1000": None, "1000-2000": None, ">2000": 1.0}
    assert A.best_length_bin(df).first().label == "<50"


def test_histogram_bin_is_exact(make):
    df = make(dict(HelpfulnessNumerator=29, HelpfulnessDenominator=50), dict(HelpfulnessDenominator=0))
    assert column(df.withColumn("b", C.helpfulness_bin(50)), "b") == [29, 0]


def test_shares_of_empty_tables(make):
    df = P.prepare(make(dict()), P.OVERVIEW).filter("false")
    assert A.five_star_share(df).first()[0] == 0
    assert A.highly_helpful_share(df).first()[0] == 0
    assert T.period_avg_score(T.monthly_avg_score(df)).first()[0] == 0
    assert T.period_volume(T.monthly_volume(df)).first()[0] == 0
    assert A.performance_thresholds(A.product_performance(df)).first().score_low is None


def test_validation(spark, make):
    good = {r.requirement: r.violated for r in P.validate_reviews(make(dict())).collect()}
    assert list(good.values()) == [False] * 3
    bad = P.validate_reviews(make(dict(ProductId=None)).drop(S.SCORE))
    assert [r.violated for r in bad.collect()] == [False, True, True]


def test_last_year_is_inclusive(spark):
    trend = spark.sql(
        "SELECT explode(sequence(DATE'2011-08-01', DATE'2012-10-01', INTERVAL 1 MONTH)) AS Month, 1L AS reviews"
    )
    months = [str(r[0]) for r in T.last_n_years(trend, 1).collect()]
    assert months[0] == "2011-10-01" and len(months) == 13


def test_trend_direction(spark):
    def direction(values):
        rows = [(f"2012-{i + 1:02d}-01", v) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, "m string, avg_helpfulness double")
        return T.trend_direction(df.withColumn(T.MONTH, F.col("m").cast("date"))).first().direction

    assert [direction(v) for v in ([0.1, 0.9, 0.2], [0.3, 0.1], [0.5, 0.9, 0.5], [])] == [
        "increased", "decreased", "remained stable", None,
    ]


def test_ties_go_to_the_smaller_key(make):
    df = P.prepare(make(dict(ProductId="B"), dict(ProductId="A"), dict(ProductId="C", Score="1")), P.PRODUCT_USER)
    assert column(K.top_products_by_score(df, 2, 1), S.PRODUCT, S.PRODUCT) == ["A", "B"]
    assert K.top_products_by_volume(df, 1).first()[0] == "A"


def test_leaderboard_counts_copies(make):
    df, voted = P.prepare_helpfulness(make(*[dict(HelpfulnessNumerator=6, HelpfulnessDenominator=6)] * 2))
    assert tuple(K.helpful_reviewer_leaderboard(voted).first()) == ("U1", 12, 2)
    assert K.helpful_reviewer_leaderboard(P.voted(df)).count() == 0


def test_null_mean_is_underperformer(spark):
    rows = [("A", None, 50, 0.0), ("B", 5.0, 50, 0.0), ("C", 1.0, 50, 0.0), ("D", 5.0, 20, 0.0)]
    df = spark.createDataFrame(rows, "ProductId string, AverageScore double, ReviewCount long, AverageHelpfulnessRatio double")
    out = {r.ProductId: r.Category for r in G.classify_products(df).collect()}
    assert out["A"] == S.UNDERPERFORMER and out["B"] == S.CASH_COW


@pytest.mark.parametrize("seed", range(4))
def test_exact_quantiles_match_pandas(spark, seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    n = [1, 2, 57, 4001][seed]
    pdf = pd.DataFrame({"a": rng.pareto(1.0, n) * 100, "b": rng.integers(0, 9, n).astype(float)})
    pdf.loc[pdf.index % 7 == 3, "a"] = float("nan")
    df = spark.createDataFrame(pdf).withColumn("a", F.when(~F.isnan("a"), F.col("a")))
    row = exact_quantiles(df, ["a", "b"], [0.0, 0.25, 0.5, 0.75, 1.0]).first()
    for c in ("a", "b"):
        for i, p in enumerate([0.0, 0.25, 0.5, 0.75, 1.0]):
            assert row[f"{c}_{i}"] == pytest.approx(pdf[c].quantile(p), rel=1e-12)


def test_correlation(spark):
    pdf = pd.DataFrame({"a": [1.0, 2, 3, None, 5], "b": [2.0, 1, 4, 3, None], "c": [7.0] * 5})
    df = spark.createDataFrame([tuple(None if pd.isna(v) else v for v in r) for r in pdf.values.tolist()], "a double, b double, c double")
    got = {(r.x, r.y): r.r for r in A.correlation_matrix(df, ("a", "b", "c", "missing")).collect()}
    want = pdf.corr()
    for (x, y), r in got.items():
        assert (r is None and pd.isna(want.loc[x, y])) or r == pytest.approx(want.loc[x, y])
    assert len(got) == 9


def test_keyword_is_a_case_blind_regex(make):
    texts = ["Good. Yes", "goodx", "GOOD", "Crème BRÛLÉE", "a+b"]
    df = P.prepare(make(*[dict(Text=t, Summary="") for t in texts]), P.ADVANCED)
    assert column(Q.keyword_matches(df, "good."), S.ID) == [1, 2]
    assert column(Q.keyword_matches(df, "brûlée"), S.ID) == [4]
    assert column(Q.keyword_matches(df, r"\bcr\w+\b"), S.ID) == [4]
    assert column(Q.keyword_matches(df, "A+B", literal=True), S.ID) == [5]
    assert Q.keyword_matches(df, "").count() == 0


def test_newest_first_unknown_times_last(make):
    df = P.prepare(make(dict(Time=None), dict(Time=1, Text="b"), dict(Time=2, Text="c")), P.PRODUCT_USER)
    assert [r[0] for r in Q.recent_reviews(df, "P1").collect()] == [3, 2, 1]


def test_product_id_wins_over_user_id(make):
    df = P.prepare(make(dict(UserId="P2"), dict(ProductId="P2"), dict(UserId="U9")), P.PRODUCT_USER)
    assert column(Q.recent_reviews(df, "P2"), S.ID) == [2]
    assert column(Q.recent_reviews(df, "U9"), S.ID) == [3]
    assert Q.recent_reviews(df, "nobody").count() == 0


def test_sample_is_exact_and_repeatable(spark, reviews):
    total = reviews.count()
    for n in (1, 777, total - 1, total, total + 5):
        first = column(Q.sample_rows(reviews, n), S.ID)
        assert len(first) == len(set(first)) == min(n, total)
        spread = Q.sample_rows(reviews.repartition(3), n)
        assert column(spread, S.ID) == first
    assert column(Q.sample_rows(reviews, 777, seed=1), S.ID) != column(Q.sample_rows(reviews, 777), S.ID)


def test_semi_join_equals_plain_count(reviews):
    pdf = P.prepare(reviews, P.PRODUCT_USER).select(S.ID, S.PRODUCT).toPandas()
    counts = pdf[S.PRODUCT].value_counts()
    want = sorted(pdf[pdf[S.PRODUCT].isin(counts[counts >= 30].index)][S.ID])
    got = Q.semi_join_min_count(P.prepare(reviews, P.PRODUCT_USER), S.PRODUCT, 30)
    assert column(got, S.ID) == want


def test_review_card(make):
    df = P.prepare(make(dict(Summary=None, Time=None, Score=None), dict(Summary="s" * 70, Text="b")), P.HELPFULNESS_VOTED)
    first, second = Q.review_card(df).orderBy("Id").collect()
    assert (first.title, first.stars, first.helpful, first.written) == ("No Summary...", None, "1/2", "N/A")
    assert second.title == "s" * 60 + "..."


CLEANED = [  # text, without punctuation and digits, letters only
    ("Don't!  STOP\tnow 24/7", "dont stop now", "dont  stop\tnow "),
    ("  x y\u001cz ", "x y z", "  x y\u001cz "),
    ("Élan_vital 3٣", "élanvital", "lanvital "),
    ("", "", ""),
    ("a\n\nb", "a b", "a\n\nb"),
    ("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "", ""),
    ("1st, 2nd & 3rd!", "st nd rd", "st nd  rd"),
]


def test_cleaning(spark):
    df = spark.createDataFrame([(i, row[0]) for i, row in enumerate(CLEANED)], "Id int, t string")
    assert column(df.withColumn("c", C.clean_punct("t")), "c") == [row[1] for row in CLEANED]
    assert column(df.withColumn("c", C.letters_only("t")), "c") == [row[2] for row in CLEANED]
    split = df.withColumn("w", F.filter(C.words(C.without_punct("t")), lambda w: w != ""))
    assert column(split, "w") == [["dont", "stop", "now"], ["x", "y", "z"], ["élanvital"], [], ["a", "b"], [], ["st", "nd", "rd"]]
    assert column(N.with_letters_only(df, "t"), "Cleaned_Text_ML")[0] == "dont stop"


def test_stop_words_are_the_default_list(spark):
    from pyspark.ml.feature import StopWordsRemover

    assert StopWordsRemover.loadDefaultStopWords("english") == ENGLISH


def test_lemmas_and_frequencies(spark, make):
    df = P.prepare(make(dict(Text="the cats cat dogs", Summary=""), dict(Text="Cats!", Summary="", Score="1")), P.SENTIMENT)
    table = spark.createDataFrame([("cats", "cat"), ("dogs", "dog")], "form string, lemma string")
    got = [tuple(r) for r in N.word_frequencies(df, lemmas=table).collect()]
    assert got == [("cat", 3), ("dog", 1)]
    assert [tuple(r) for r in N.word_frequencies(df, 1, 1).collect()] == [("cats", 1)]
    small = N.lemmatise(N.tokens(df), table).select("Id", "position", "lemma")
    assert [r.lemma for r in small.orderBy("Id", "position").collect()] == ["cat", "cat", "dog", "cat"]


def test_lookup_join_is_the_same_beyond_the_bound(spark, reviews, folder, monkeypatch):
    from voxstars.sources import vocabulary

    words = N.tokens(P.prepare(reviews.filter("ProductId = 'P7'"), P.SENTIMENT))
    table = vocabulary.lemmas(spark, folder)
    assert table.count() > 3
    small = N.lemmatise(words, table)
    assert sizing.is_small(table)
    assert not sizing.is_small(table, max_rows=3)
    assert not sizing.is_small(table, max_bytes=9)
    monkeypatch.setattr(sizing, "is_small", lambda df: False)
    salted = N.lemmatise(words, table)
    assert small.exceptAll(salted.select(*small.columns)).count() == 0
    assert small.count() == salted.count() == words.count()


def test_lexicon_sentiment(spark, make):
    df = P.prepare(make(dict(Text="Good, good bad."), dict(Text="awful"), dict(Text="unknown"), dict(Text=None)), P.SENTIMENT)
    table = spark.createDataFrame([("good", 0.5), ("bad", -0.4), ("awful", -1.0)], "word string, polarity double")
    out = N.lexicon_sentiment(df, table)
    assert column(out, "polarity") == [0.2, -1.0, 0.0, 0.0]
    assert column(out, "sentiment") == ["Positive", "Negative", "Neutral", "Neutral"]
    edge = spark.createDataFrame([(1, 0.05), (2, -0.05), (3, 0.051)], "Id int, p double")
    assert column(edge.withColumn("s", N.polarity_class("p")), "s") == ["Neutral", "Neutral", "Positive"]


def test_top_per_group_beyond_the_window_limit(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 2).alias("g"))
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10")
    try:
        got = top_per_group(df, ["g"], [F.col("id").desc()], 50, "id")
        assert sorted(r.id for r in got.collect()) == list(range(4900, 5000))
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


def test_report_and_matrix(spark):
    y = ["Positive"] * 6 + ["Negative"] * 3 + ["Mixed"]
    p = ["Positive"] * 5 + ["Negative"] + ["Negative", "Positive", "Positive"] + ["Positive"]
    df = spark.createDataFrame(list(zip(y, p)), "y string, p string")
    rows = {r.label: r for r in M.classification_report(df, "y", "p").collect()}
    assert set(rows) == {"Mixed", "Negative", "Neutral", "Positive", "accuracy", "macro avg", "weighted avg"}
    assert (rows["Positive"].precision, rows["Positive"].recall) == (5 / 8, 5 / 6)
    assert (rows["Neutral"].precision, rows["Neutral"].support) == (0.0, 0)
    assert rows["accuracy"].f1 == 0.6 and rows["accuracy"].support == 10
    assert rows["macro avg"].recall == pytest.approx((5 / 6 + 1 / 3) / 4)
    assert rows["weighted avg"].precision == pytest.approx((6 * 5 / 8 + 3 * 0.5) / 10)
    cells = {(r.actual, r.predicted): r.n for r in M.confusion_matrix(df, "y", "p").collect()}
    assert len(cells) == 16 and cells["Positive", "Positive"] == 5 and cells["Neutral", "Mixed"] == 0


def test_rating_is_rounded_half_even_and_clamped(spark):
    df = spark.createDataFrame([(1, 2.5), (2, 7.2), (3, -1.0), (4, 3.5), (5, float("nan")), (6, 1e300)], "Id int, p double")
    assert column(df.withColumn("r", M.clamp_rating(F.col("p"))), "r") == [2, 5, 1, 4, None, 5]


def test_models_score_every_row(spark, reviews):
    df = P.prepare(reviews, P.SHARED)
    sentiment, rating = M.fit_sentiment(df, n_features=1 << 10, max_iter=3), M.fit_rating(df)
    scored = M.score_sentiment(sentiment, P.prepare(reviews, P.HELPFULNESS_VOTED))
    assert scored.count() == reviews.count()
    assert {r[0] for r in scored.select(S.PREDICTED).distinct().collect()} <= set(S.SENTIMENTS)
    rated = M.score_rating(rating, df.withColumn(S.VOTES_UP, F.when(F.col(S.ID) % 2 == 0, F.col(S.VOTES_UP))))
    assert rated.count() == df.count()
    assert {r[0] for r in rated.select(M.RATING).distinct().collect()} <= {1, 2, 3, 4, 5, None}


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(
        "Id,ProductId,UserId,ProfileName,HelpfulnessNumerator,HelpfulnessDenominator,Score,Time,Summary,Text\n"
        '1,B1,A1,"Ann ""x""",1,2,5,1303862400,"Good, ""really""","two\nlines"\n'
        "2,B1,A2,,0,0,bad,,NA,\n"
        '3,B2,A3,nan,0,0,4,1303862400," kept ","é"\n'
    )
    rows = read_reviews(spark, str(path)).orderBy("Id").collect()
    assert [r.Summary for r in rows] == ['Good, "really"', None, " kept "]
    assert [r.Text for r in rows] == ["two\nlines", None, "é"]
    assert [r.ProfileName for r in rows] == ['Ann "x"', None, None]
    assert [r.Score for r in rows] == ["5", "bad", "4"]
    assert [r.Time for r in rows] == [1303862400, None, 1303862400]
    pdf = pd.read_csv(path)
    assert [r.Text for r in rows] == [None if pd.isna(t) else t for t in pdf["Text"]]
    assert [r.Summary for r in rows] == [None if pd.isna(t) else t for t in pdf["Summary"]]
    write_reviews(read_reviews(spark, str(path)), str(tmp_path / "table"))
    assert load_reviews(spark, str(tmp_path / "table")).count() == 3


def test_derived_reviews_have_the_stated_profile(spark, folder):
    df = reviews_from_tables(spark, folder)
    row = df.agg(
        F.count("*"), F.countDistinct("Id"), F.countDistinct("ProductId"), F.countDistinct("UserId"), F.sum("Score"),
        F.count_if(F.isnull("Score")), F.count_if(F.isnull("Text")), F.count_if(F.isnull("Time")), F.count_if(F.isnull("Summary")),
        F.count_if(F.expr("HelpfulnessNumerator > HelpfulnessDenominator AND HelpfulnessDenominator > 0")),
    ).first()
    assert tuple(row) == (6116, 6116, 200, 150, 23623, 61, 53, 56, 69, 24)
    pdf = P.fill_text_nulls(df).toPandas().sort_values("Id")
    kept = pdf.drop_duplicates(subset=list(S.REVIEW_KEY))
    assert column(P.prepare(df, P.REVENUE), S.ID) == kept["Id"].tolist()
