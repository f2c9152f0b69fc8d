"""Reports from the monthly state, and what a new month writes."""

import os

import pytest
from pyspark.sql import functions as F

from voxstars import schema as S
from voxstars.operators import leaders as K
from voxstars.operators import metrics as A
from voxstars.operators import prepare as P
from voxstars.operators import state as Z
from voxstars.operators import trends as T


def rows(df):
    return sorted(str(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in df.collect())


REPORTS = [
    (Z.monthly_volume, T.monthly_volume),
    (Z.monthly_avg_score, T.monthly_avg_score),
    (Z.monthly_helpfulness, T.monthly_helpfulness),
    (Z.product_monthly_score, T.product_monthly_score),
    (lambda t: Z.product_monthly_score(t, "P7"), lambda t: T.product_monthly_score(t, "P7")),
    (Z.product_performance, A.product_performance),
    (Z.score_distribution, A.score_distribution),
    (Z.five_star_share, A.five_star_share),
    (Z.top_products_by_volume, K.top_products_by_volume),
    (lambda t: T.trend_direction(Z.monthly_helpfulness(t)), lambda t: T.trend_direction(T.monthly_helpfulness(t))),
]


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


@pytest.fixture(scope="module")
def prepared(reviews):
    return P.prepare(reviews, P.REVENUE)


def test_reports_equal_those_of_the_reviews(spark, prepared, tmp_path):
    Z.write_months(Z.monthly_state(prepared), str(tmp_path))
    state = Z.load_state(spark, str(tmp_path))
    for from_state, from_reviews in REPORTS:
        assert rows(from_state(state)) == rows(from_reviews(prepared))


def test_a_new_month_writes_its_own_partition(spark, reviews, prepared, tmp_path):
    months = [r[0] for r in T.monthly_volume(prepared).collect()]
    last, late = months[-1], months[3]
    month = F.trunc(F.timestamp_seconds(S.TIME).cast("date"), "MM")
    early = reviews.filter((month < F.lit(last)) | month.isNull()).filter((month != F.lit(late)) | (F.col(S.ID) % 3 > 0) | month.isNull())
    Z.write_months(Z.monthly_state(P.prepare(early, P.REVENUE)), str(tmp_path))
    before = files(tmp_path)
    # The last month is new and one month got late reviews: only those months' reviews are read again.
    again = reviews.filter(month.isin(last, late))
    Z.write_months(Z.monthly_state(P.prepare(again, P.REVENUE)), str(tmp_path))
    after = files(tmp_path)
    touched = {os.path.basename(os.path.dirname(f)) for f, _ in set(before.items()) ^ set(after.items())}
    assert touched == {f"Month={last}", f"Month={late}"}
    state = Z.load_state(spark, str(tmp_path))
    assert rows(Z.monthly_volume(state)) == rows(T.monthly_volume(prepared))
    assert rows(Z.product_performance(state)) == rows(A.product_performance(prepared))


def test_empty_and_unknown_values(spark, make, tmp_path):
    df = P.prepare(make(dict(Time=None, ProductId=None), dict(Score=None, Text="b"), dict(HelpfulnessDenominator=0, Text="c")), P.REVENUE)
    Z.write_months(Z.monthly_state(df), str(tmp_path / "a"))
    state = Z.load_state(spark, str(tmp_path / "a"))
    assert state.agg(F.sum("reviews")).first()[0] == 3
    for from_state, from_reviews in REPORTS:
        assert rows(from_state(state)) == rows(from_reviews(df))
    nothing = Z.monthly_state(df.filter("false"))
    assert Z.monthly_volume(nothing).collect() == [] and Z.five_star_share(nothing).first()[0] == 0
