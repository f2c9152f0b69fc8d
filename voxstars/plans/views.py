"""The seven reports: each prepares its table once and returns its results by name.

``share`` decides how the prepared table is shared by the jobs of a report. The default writes it
to the session's shared folder, so the deduplication runs once and lost executors cost nothing but
a re-read; pass ``lambda df: df`` to keep everything in one lazy plan.
"""

from voxstars import schema as S
from voxstars.operators import bayes as B
from voxstars.operators import leaders as K
from voxstars.operators import leastsquares as L
from voxstars.operators import metrics as A
from voxstars.operators import models as M
from voxstars.operators import prepare as P
from voxstars.operators import search as Q
from voxstars.operators import segments as G
from voxstars.operators import text as N
from voxstars.operators import trends as T
from voxstars.sources.staging import stage


def _period(trend, years):
    return trend if years is None else T.last_n_years(trend, years)


def overview(reviews, years=None, share=stage):
    df = share(P.prepare(reviews, P.OVERVIEW))
    volume = _period(T.monthly_volume(df), years)
    score = _period(T.monthly_avg_score(df), years)
    return {
        "kpis": A.kpis(df),
        "score_distribution": A.score_distribution(df),
        "five_star_share": A.five_star_share(df),
        "monthly_volume": volume,
        "period_volume": T.period_volume(volume),
        "monthly_avg_score": score,
        "period_avg_score": T.period_avg_score(score),
        "helpfulness_histogram": A.helpfulness_histogram(df),
        "highly_helpful_share": A.highly_helpful_share(df),
    }


def sentiment(reviews, product=None, years=None, scores=(1, 5), lemmas=None, share=stage):
    df = share(P.prepare(reviews, P.SENTIMENT))
    score = _period(T.monthly_avg_score(df), years)
    by_product = T.product_monthly_score(df, product)
    return {
        "sentiment_distribution": A.sentiment_distribution(df),
        "monthly_avg_score": score,
        "period_avg_score": T.period_avg_score(score),
        "word_frequencies": N.word_frequencies(df, *scores, lemmas=lemmas),
        "product_selector": K.top_products_by_volume(df, 20),
        "product_monthly_score": by_product,
        "product_current_score": T.product_current_score(by_product),
    }


def helpfulness(reviews, years=None, min_votes=10, users=10, shown=10, share=stage):
    df, voted = (share(t) for t in P.prepare_helpfulness(reviews))
    trend = _period(T.monthly_helpfulness(df), years)
    return {
        "helpfulness_histogram": A.helpfulness_histogram(voted),
        "zero_helpful_share": A.zero_helpful_share(voted),
        "helpfulness_by_score": A.helpfulness_by_score(voted),
        "best_score_for_helpfulness": A.best_score_for_helpfulness(voted),
        "monthly_helpfulness": trend,
        "trend_direction": T.trend_direction(trend),
        "helpful_reviewers": K.helpful_reviewer_leaderboard(voted, min_votes, users),
        "most_helpful_reviews": Q.review_card(Q.most_helpful_reviews(voted, k=shown)),
        "least_helpful_reviews": Q.review_card(Q.least_helpful_reviews(voted, k=shown)),
    }


def product_user(reviews, wanted=None, n=10, share=stage):
    df = share(P.prepare(reviews, P.PRODUCT_USER))
    out = {
        "top_products_by_volume": K.top_products_by_volume(df, n),
        "top_products_by_score": K.top_products_by_score(df, n),
        "most_active_users": K.most_active_users(df, n),
        "top_users_by_avg_helpfulness": K.top_users_by_avg_helpfulness(df, n),
        "id_directory": K.id_directory(df),
    }
    if wanted is not None:
        out["recent_reviews"] = Q.recent_reviews(df, wanted)
    return out


def _structure(df, query, length_bins):
    out = {
        "length_vs_helpfulness": Q.length_vs_helpfulness(df),
        "length_bin_score": length_bins,
        "correlation_matrix": A.correlation_matrix(df),
    }
    if query:
        out["keyword_search"] = Q.keyword_search(df, query)
        out["keyword_count"] = Q.keyword_count(df, query)
    return out


def advanced(reviews, query=None, share=stage):
    df = share(P.prepare(reviews, P.ADVANCED))
    return {**_structure(df, query, A.length_bin_score(df)), "best_length_bin": A.best_length_bin(df)}


def revenue(reviews, product=None, min_reviews=20, k=20, share=stage):
    df = P.prepare(reviews, P.REVENUE)
    performance = share(A.product_performance(df, min_reviews))
    thresholds = A.performance_thresholds(performance)
    classified = G.classify_products(performance, thresholds)
    out = {
        "thresholds": thresholds,
        "classified": classified,
        "segment_sizes": G.segment_sizes(classified),
        "segment_top": G.segment_top(classified, k),
        "product_ids": K.sorted_product_ids(performance),
    }
    if product is not None:
        out["product_lookup"] = G.product_lookup(classified, product)
    return out


def _classified(model, df):
    return B.score_bayes(model, df) if isinstance(model, B.BayesModel) else M.score_sentiment(model, df)


def _rated(model, df):
    return L.score_least_squares(model, df) if isinstance(model, L.LinearModel) else M.score_rating(model, df)


def modelling(reviews, sentiment_model=None, rating_model=None, sample=None, query=None, share=stage):
    """Scoring and evaluation; ``sample`` is the number of reviews to look at, default all.

    Models of either family serve; without one, naive Bayes and least squares are fitted on all reviews.
    """
    df = P.prepare(reviews, P.SHARED)
    sentiment_model = sentiment_model or B.fit_bayes(df)
    rating_model = rating_model or L.fit_least_squares(df)
    df = share(df if sample is None else Q.sample_rows(df, sample))
    scored = share(_classified(sentiment_model, df))
    bins = A.length_bin_score(df, keep_empty=True, exclude_max=True)
    # The query is lowered first, as in the interactive search of this report.
    return {
        **_structure(df, query.lower() if query else None, bins),
        "predicted_distribution": M.predicted_distribution(scored),
        "classification_report": M.classification_report(scored),
        "confusion_matrix": M.confusion_matrix(scored),
        "predicted_rating": _rated(rating_model, df).select(S.ID, S.SCORE, M.RATING),
        "word_frequencies_by_class": N.word_frequencies_by_class(scored),
    }
