"""What the physical plans must look like, and results that must not depend on partitioning."""

import pytest
from pyspark.sql import functions as F

from voxstars import schema as S
from voxstars.functions.ranking import top_per_group
from voxstars.operators import leaders as K
from voxstars.operators import metrics as A
from voxstars.operators import models as M
from voxstars.operators import prepare as P
from voxstars.operators import search as Q
from voxstars.plans import views
from voxstars.plans.catalogue import QUERIES
from voxstars.sources.tables import reviews_from_tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return [line for line in plan(df).split("\n") if "Exchange hashpartitioning" in line]


def test_dedup_cuts_copies_before_the_shuffle(spark, folder):
    text = plan(P.prepare(reviews_from_tables(spark, folder), P.REVENUE))
    assert text.count("WindowGroupLimit") == 2
    shuffled = [line for line in text.split("\n") if "Exchange hashpartitioning(ProductId" in line]
    assert len(shuffled) == 1 and all(k in shuffled[0] for k in ("UserId", "Score", "Time", "Text"))


def test_only_suspects_carry_their_text(spark, tmp_path, make):
    """Over a stored table: one shuffle of hashes, one of suspects with text, and the other rows are not shuffled."""
    make(dict(), dict(Text="b")).write.parquet(str(tmp_path / "r"))
    out = P.dedup_reviews(P.fill_text_nulls(P.coerce_score(spark.read.parquet(str(tmp_path / "r")))))
    text = plan(out)
    shuffles = exchanges(out)
    with_text = [x for x in shuffles if "Text#" in x]
    assert len(with_text) == 1 and all("_groupingexpression#" in x or "_cell#" in x for x in shuffles if x not in with_text)
    # The scan that finds suspects reads the four light columns only.
    scans = [line.split("ReadSchema: ")[1] for line in text.split("\n") if "ReadSchema" in line]
    assert sum("Text" not in s and "UserId" in s for s in scans) >= 1
    # A job that needs no text reads it for suspects only.
    scans = [line.split("ReadSchema: ")[1] for line in plan(A.score_distribution(out)).split("\n") if "ReadSchema" in line]
    assert sum("Text" in s for s in scans) == 1
    branch = plan(out).split("Union")[1].split("WindowGroupLimit")[0].split("Window ")[0]
    assert "BroadcastHashJoin" in branch and "Exchange hashpartitioning(ProductId" not in branch


def test_unread_columns_stay_below_the_shuffle(spark, folder):
    text = plan(K.top_products_by_volume(P.prepare(reviews_from_tables(spark, folder), P.PRODUCT_USER)))
    assert "p_name" not in text and "l_suppkey" in text  # the id needs the supplier, nothing needs the summary


def test_point_lookup_reaches_the_scan(spark, folder):
    text = plan(Q.recent_reviews(P.prepare(reviews_from_tables(spark, folder), P.PRODUCT_USER), "P7"))
    assert "TakeOrderedAndProject" in text


def test_key_figures_need_no_expand(spark, folder, make):
    raw = reviews_from_tables(spark, folder)
    assert "Expand" not in plan(A.kpis(P.prepare(raw, P.OVERVIEW)))
    df = P.coerce_score(make(dict(ProductId=None), dict(UserId=None, Score="2"), dict(ProductId=None, Score=None)))
    assert tuple(A.kpis(df).first()) == (3, 1, 1, 3.5)
    assert tuple(A.kpis(df.filter("false")).first()) == (0, 0, 0, None)


def test_top_per_group_is_cut_before_the_shuffle(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("g"))
    assert plan(top_per_group(df, ["g"], [F.col("id")], 5, "id")).count("WindowGroupLimit") == 2


@pytest.mark.parametrize("cell_bits", [1, 20])
def test_two_phases_equal_one_window(spark, reviews, cell_bits):
    """With one bit of cells nearly every row is a suspect; the result is the same."""
    df = P.fill_text_nulls(P.coerce_score(reviews))
    df = df.unionByName(df.filter("Id % 7 = 0").withColumn("Id", F.col("Id") + 1)).unionByName(
        df.filter("Id % 11 = 0").withColumns({"Id": F.col("Id") + 2, "Text": F.concat("Text", F.lit("!"))})
    )
    df = df.withColumn("UserId", F.when(F.col("Id") % 5 > 0, F.col("UserId"))).withColumn("Score", F.when(F.col("Score") == 1, -0.0).otherwise(F.col("Score")))
    want = P._first_of(df, S.REVIEW_KEY, S.ID)
    got = P.dedup_reviews(df, cell_bits=cell_bits)
    assert sorted(r[0] for r in got.select("Id").collect()) == sorted(r[0] for r in want.select("Id").collect())
    assert got.columns == df.columns
    marked = P.suspected_copies(df, ["ProductId", "UserId", "Score", "Time"], cell_bits)
    assert marked.filter("_suspect").count() < df.count() or cell_bits == 1


def test_zero_and_minus_zero_are_one_score(spark, make):
    df = P.coerce_score(make(dict(Score="0.0"), dict(Score="-0.0"), dict(Score="0.0", Text="other")))
    assert sorted(r[0] for r in P.dedup_reviews(df).select("Id").collect()) == [1, 3]


def test_hot_copies_and_hot_product(spark, make):
    """A third of all rows is one copied review, another third one product."""
    base = make(dict()).drop("Id")
    n = 3000
    rows = spark.range(n).crossJoin(base).withColumnRenamed("id", "Id")
    rows = rows.withColumn("Text", F.when(F.col("Id") % 3 == 0, "same").otherwise(F.concat(F.lit("t"), F.col("Id"))))
    rows = rows.withColumn("ProductId", F.when(F.col("Id") % 3 < 2, "hot").otherwise(F.concat(F.lit("p"), F.col("Id") % 50)))
    out = P.prepare(rows, P.PRODUCT_USER)
    assert out.count() == 2 * n // 3 + 1
    assert K.top_products_by_volume(out, 1).first().reviews == n // 3 + 1
    assert Q.semi_join_min_count(out, S.PRODUCT, n // 3).count() == n // 3 + 1


@pytest.mark.parametrize("name", ["g1_classify_products", "a14_performance_thresholds", "n6_word_frequencies_by_class"])
def test_results_do_not_depend_on_partitioning(spark, folder, name):
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            return sorted(map(tuple, QUERIES[name](spark, folder).collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")

    assert run("1") == run("8")


def test_reports(spark, reviews):
    df = P.prepare(reviews, P.SHARED)
    sentiment, rating = M.fit_sentiment(df, n_features=1 << 10, max_iter=2), M.fit_rating(df)
    reports = [
        views.overview(reviews, years=3),
        views.sentiment(reviews, product="P7", years=1),
        views.helpfulness(reviews, years=5),
        views.product_user(reviews, wanted="U7"),
        views.advanced(reviews, query="worthless"),
        views.revenue(reviews, product="P7"),
        views.modelling(reviews, sentiment, rating, sample=2000, query="Worthless"),
    ]
    for report in reports:
        for name, df in report.items():
            assert df.count() > 0 or name == "top_products_by_score", name
    assert reports[-1]["predicted_rating"].count() == 2000
    own = views.modelling(reviews, sample=2000)
    assert {n: t.columns for n, t in own.items()} == {n: t.columns for n, t in reports[-1].items() if not n.startswith("keyword")}
    assert own["predicted_rating"].count() == 2000 and own["predicted_distribution"].agg(F.sum("reviews")).first()[0] == 2000
    lazy = views.overview(reviews, years=3, share=lambda t: t)
    assert lazy["kpis"].collect() == reports[0]["kpis"].collect()
    assert A.kpis(P.prepare(reviews, P.OVERVIEW)).collect() == lazy["kpis"].collect()
