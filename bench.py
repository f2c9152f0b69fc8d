"""Time the headline queries: one JSON line with the seconds of each and their sum.

Every query starts from the raw tables and is written whole to the no-op sink. Environment:
BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma-separated
names, default the headline set; ``all`` for every query).
"""

import json
import os
import time

from voxstars.plans.catalogue import QUERIES
from voxstars.session import local_session

HEADLINE = """
a1_kpis a4_helpfulness_histogram a8_helpfulness_by_score a10_length_bin_score a11_length_bin_score_open
a14_performance_thresholds a15_correlation_matrix t2_monthly_volume t5_volume_last_3_years t8_product_monthly_score
t10_trend_direction f2_keyword_search f3_semi_join_products f4_most_helpful_reviews f6_recent_reviews_product
f7_sample_rows k1_top_products_by_volume k4_top_users_by_avg_helpfulness k5_helpful_reviewer_leaderboard
k6_id_directory g1_classify_products g3_segment_top n3_tokens n5_word_frequencies n6_word_frequencies_by_class
n7_lexicon_sentiment m3_classification_report m4_confusion_matrix
""".split()


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    QUERIES["a8_helpfulness_by_score"](spark, folder).write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
