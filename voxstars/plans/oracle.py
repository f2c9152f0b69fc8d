"""The same queries in DuckDB's SQL, over the given tables as views."""

import re

from voxstars.functions.stopwords import ENGLISH
from voxstars.plans.catalogue import ACCENTED, KEYWORD, MIN_USER_REVIEWS, PRODUCT_ID, USER_ID
from voxstars import schema as S

# The blanks of Unicode, with the 0x1c-0x1f separators, as a regex class.
BLANK_CLASS = (
    r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH)

TABLES = f"""
WITH lines AS MATERIALIZED (
  SELECT *, CAST((l_suppkey + l_linenumber) % 8 AS BIGINT) AS den,
         CAST((CAST(l_quantity AS BIGINT) + p_size) % 10 AS INT) AS x,
         ((l_orderkey * 100000 + l_partkey) * 10 + l_linenumber) * 100000
           + l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS line_id
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN part ON l_partkey = p_partkey
  JOIN documents ON doc_id = (l_orderkey * 8 + l_linenumber) % (SELECT count(*) FROM documents)
), once AS (
  SELECT line_id AS Id, l_orderkey, 'P' || CAST(l_partkey AS VARCHAR) AS ProductId,
         'U' || CAST(o_custkey AS VARCHAR) AS UserId,
         CASE WHEN l_orderkey % 500 = 0 THEN den + 1 ELSE (l_partkey + l_orderkey) % (den + 1) END AS num,
         den,
         CAST(CASE WHEN l_orderkey % 107 = 0 THEN NULL WHEN x < 5 THEN 5 WHEN x < 7 THEN 4
              WHEN x = 7 THEN 3 WHEN x = 8 THEN 2 ELSE 1 END AS DOUBLE) AS Score,
         CASE WHEN l_orderkey % 103 = 0 THEN NULL
              ELSE date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 86400 END AS secs,
         CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE p_name END AS Summary,
         CASE WHEN l_orderkey % 101 = 0 THEN NULL ELSE text END AS Text
  FROM lines
), reviews AS (
  SELECT * FROM once
  UNION ALL
  SELECT * REPLACE (Id + 1000000000000000000 AS Id) FROM once WHERE l_orderkey % 50 = 0
), filled AS (
  SELECT * REPLACE (coalesce(Summary, '') AS Summary, coalesce(Text, '') AS Text),
         CASE WHEN den > 0 THEN num / den ELSE 0 END AS ratio
  FROM reviews
), dedup AS (
  SELECT * FROM filled
  QUALIFY row_number() OVER (PARTITION BY ProductId, UserId, Score, secs, Text ORDER BY Id) = 1
), voted AS (
  SELECT * FROM filled WHERE den > 0
), shared AS (
  SELECT *, CASE WHEN Score >= 4 THEN 'Positive' WHEN Score <= 2 THEN 'Negative' ELSE 'Neutral' END AS truth,
         Summary || ' ' || Text AS combined, length(Summary || ' ' || Text) AS len
  FROM filled
  WHERE Id IN (SELECT Id FROM reviews WHERE Summary IS NOT NULL AND Text IS NOT NULL AND Score IS NOT NULL)
), advanced AS (
  SELECT * REPLACE (CASE WHEN ratio >= 1 THEN 0.98 ELSE ratio END AS ratio),
         Summary || ' ' || Text AS combined, length(Summary || ' ' || Text) AS len
  FROM dedup
), capped AS (
  SELECT * REPLACE (least(ratio, 1.0) AS ratio) FROM dedup
), performance AS (
  SELECT ProductId, avg(Score) AS score, count(*) AS cnt, avg(ratio) AS help
  FROM dedup GROUP BY ProductId HAVING count(*) >= 20
), thresholds AS (
  SELECT quantile_cont(score, 0.25) AS score_low, quantile_cont(score, 0.75) AS score_high,
         quantile_cont(cnt, 0.25) AS count_low, quantile_cont(cnt, 0.75) AS count_high
  FROM performance
), classified AS (
  SELECT performance.*, CASE
      WHEN round(score, 9) >= round(score_high, 9) AND cnt >= count_high THEN '{S.CASH_COW}'
      WHEN round(score, 9) < round(score_low, 9) AND cnt >= count_high THEN '{S.PROBLEM_CHILD}'
      WHEN round(score, 9) >= round(score_high, 9) AND cnt < count_low THEN '{S.HIDDEN_GEM}'
      ELSE '{S.UNDERPERFORMER}' END AS Category
  FROM performance, thresholds
)"""


def month(secs="secs"):
    return f"strftime(date_trunc('month', make_timestamp({secs} * 1000000)), '%Y-%m-%d')"


def second(secs="secs"):
    return f"strftime(make_timestamp({secs} * 1000000), '%Y-%m-%d %H:%M:%S')"


def plain(text):
    return rf"regexp_replace(lower({text}), '[[:punct:]\p{{Nd}}]+', '', 'g')"


def letters(text):
    return f"regexp_replace(lower({text}), '[^a-z{BLANK_CLASS}]+', '', 'g')"


def split(cleaned):
    return f"[w FOR w IN string_split_regex({cleaned}, '[{BLANK_CLASS}]+') IF w <> '']"


def monthly(table, value, where="secs IS NOT NULL"):
    return f"SELECT {month()} AS Month, {value} FROM {table} WHERE {where} GROUP BY 1"


def last_years(trend, years):
    start = f"(SELECT CAST(max(CAST(Month AS DATE)) - INTERVAL {years} YEAR AS DATE) FROM ({trend}))"
    return f"SELECT * FROM ({trend}) AS trend WHERE CAST(Month AS DATE) >= {start}"


def bin_of(length):
    return (
        f"CASE WHEN {length} < 50 THEN 0 WHEN {length} < 150 THEN 1 WHEN {length} < 500 THEN 2"
        f" WHEN {length} < 1000 THEN 3 WHEN {length} < 2000 THEN 4 ELSE 5 END"
    )


LABELS = "['<50', '50-150', '150-500', '500-1000', '1000-2000', '>2000']"
BINS = f"""SELECT CAST(bin AS BIGINT) AS bin, {LABELS}[bin + 1] AS label, round(avg(Score), 9) AS avg_score
  FROM (SELECT {bin_of('len')} AS bin, Score FROM advanced) GROUP BY 1, 2 HAVING avg(Score) IS NOT NULL"""


def correlation(table):
    cols = {c: c for c in S.CORRELATION_COLUMNS}
    cols.update(HelpfulnessNumerator="num", HelpfulnessDenominator="den", HelpfulnessRatio="ratio", ReviewLength="len")
    rows = []
    for x in cols:
        for y in cols:
            r = "1.0" if x == y else f"corr({cols[x]}, {cols[y]})"
            rows.append(f"SELECT '{x}' AS x, '{y}' AS y, round(nullif({r}, 'nan'::DOUBLE), 6) AS r FROM {table}")
    return " UNION ".join(rows)


REVIEW_ROWS = (
    f"Id, {second()} AS Time, Score, round(ratio, 9) AS HelpfulnessRatio, Summary, md5(Text) AS text_md5"
)


def newest(table, where, k):
    return f"SELECT {REVIEW_ROWS} FROM {table} WHERE {where} ORDER BY secs DESC NULLS LAST, Id LIMIT {k}"


MOST_HELPFUL = "FROM voted WHERE ratio >= 0.8 AND den >= 5 ORDER BY ratio DESC, den DESC, Id LIMIT"
LEAST_HELPFUL = "FROM voted WHERE ratio = 0 AND den >= 5 ORDER BY den DESC, Id LIMIT"
CARD = f"""SELECT Id, substr(CASE WHEN Summary <> '' THEN Summary ELSE 'No Summary' END, 1, 60) || '...' AS title,
  CAST(Score AS INT) AS stars, num || '/' || den AS helpful, round(ratio, 9) AS HelpfulnessRatio, ProductId, UserId,
  coalesce(strftime(make_timestamp(secs * 1000000), '%Y-%m-%d %H:%M'), 'N/A') AS written, md5(Text) AS Text"""

VOCABULARY = f"""SELECT DISTINCT word FROM (SELECT unnest({split(plain('text'))}) AS word FROM documents)
  WHERE length(word) >= 3"""
LEMMAS = """SELECT word AS form, substr(word, 1, length(word) - 1) AS lemma FROM vocabulary
  WHERE substr(word, 1, length(word) - 1) IN (SELECT word FROM vocabulary)"""
SENTIMENT_WORDS = f"""SELECT Id, Score, word FROM (
    SELECT Id, Score, unnest({split(plain("Summary || ' ' || Text"))}) AS word FROM dedup)
  WHERE length(word) >= 3 AND word NOT IN ({STOP})"""
JUDGED = """SELECT truth AS y, CASE WHEN ratio >= 0.6 THEN 'Positive' WHEN ratio > 0.3 THEN 'Neutral'
  ELSE 'Negative' END AS p FROM shared"""
PERCENT = "coalesce(100.0 * {} / nullif({}, 0), 0)"

BODIES = {
    "p1_read_reviews": """SELECT Id, ProductId, UserId, CAST(NULL AS VARCHAR) AS ProfileName,
        num AS HelpfulnessNumerator, den AS HelpfulnessDenominator, Score, secs AS Time, Summary, md5(Text) AS Text
        FROM reviews""",
    "p2_drop_columns": f"""SELECT ProductId, UserId, num AS HelpfulnessNumerator, den AS HelpfulnessDenominator, Score,
        {second()} AS Time, Summary, md5(Text) AS Text, round(ratio, 9) AS HelpfulnessRatio FROM dedup""",
    "p3_drop_nulls": """SELECT Id, CAST(Score AS INT) AS Score, Summary, md5(Text) AS text_md5 FROM reviews
        WHERE Text IS NOT NULL AND Summary IS NOT NULL AND Score IS NOT NULL""",
    "p4_fill_text_nulls": "SELECT Id, Summary, md5(Text) AS text_md5 FROM filled",
    "p5_coerce_score": """SELECT Id, CASE WHEN secs IS NULL OR Score = 2 THEN NULL ELSE Score + 0.5 END AS Score
        FROM reviews""",
    "p6_epoch_to_time": f"""SELECT Id, CASE WHEN den = 7 THEN NULL
        ELSE {second('(secs + Id % 86400 - 1000000000)')} END AS time FROM reviews""",
    "p7_helpfulness_ratio": "SELECT Id, round(ratio, 9) AS HelpfulnessRatio FROM filled",
    "p8_cap_ratio": """SELECT Id, round(least(ratio, 1.0), 9) AS capped,
        round(CASE WHEN ratio >= 1 THEN 0.98 ELSE ratio END, 9) AS replaced FROM filled""",
    "p9_combined_text": "SELECT Id, md5(Summary || ' ' || Text) AS combinedtext_md5 FROM filled",
    "p10_review_length": "SELECT Id, length(Summary || ' ' || Text) AS length FROM filled",
    "p11_dedup_reviews": "SELECT Id, ProductId, UserId, num AS HelpfulnessNumerator FROM dedup",
    "p12_voted_reviews": """SELECT Id, 'deduplicated' AS form FROM dedup WHERE den > 0
        UNION ALL SELECT Id, 'with copies' FROM voted""",
    "p13_sentiment_from_score": """SELECT Id,
        CASE WHEN s >= 4 THEN 'Positive' WHEN s <= 2 THEN 'Negative' ELSE 'Neutral' END AS by_range,
        CASE WHEN s IN (4, 5) THEN 'Positive' WHEN s = 3 THEN 'Neutral' WHEN s IN (1, 2) THEN 'Negative' END AS by_star
        FROM (SELECT Id, CASE WHEN den = 3 THEN Score + 0.5 ELSE Score END AS s FROM reviews WHERE Score IS NOT NULL)""",
    "p14_validate_reviews": """SELECT 'table is not empty' AS requirement, count(*) = 0 AS violated FROM dedup
        UNION ALL SELECT 'ProductId is present and not entirely empty', count(ProductId) = 0 FROM dedup
        UNION ALL SELECT 'Score is present and not entirely empty', count(Score) = 0 FROM dedup""",
    "a1_kpis": """SELECT count(*) AS total_reviews, count(DISTINCT ProductId) AS unique_products,
        count(DISTINCT UserId) AS unique_customers, round(avg(Score), 9) AS avg_score FROM dedup""",
    "a2_score_distribution": "SELECT Score, count(*) AS reviews FROM dedup WHERE Score IS NOT NULL GROUP BY Score",
    "a3_five_star_share": f"""SELECT round({PERCENT.format('count(*) FILTER (Score = 5)', 'count(Score)')}, 9)
        AS five_star_pct FROM dedup""",
    "a4_helpfulness_histogram": """SELECT CASE WHEN den > 0 THEN num * 50 // den ELSE 0 END AS bin,
        count(*) AS reviews FROM dedup GROUP BY 1""",
    "a4_helpfulness_histogram_voted": "SELECT num * 50 // den AS bin, count(*) AS reviews FROM voted GROUP BY 1",
    "a5_highly_helpful_share": f"""SELECT round({PERCENT.format(
        'count(*) FILTER (ratio = 1)', 'count(*) FILTER (den > 0)')}, 9) AS highly_helpful_pct FROM dedup""",
    "a6_zero_helpful_share": f"""SELECT round({PERCENT.format('count(*) FILTER (num = 0)', 'count(*)')}, 9)
        AS zero_helpful_pct FROM voted""",
    "a7_sentiment_distribution": """SELECT CASE WHEN Score >= 4 THEN 'Positive' WHEN Score = 3 THEN 'Neutral'
        ELSE 'Negative' END AS sentiment, count(*) AS reviews,
        round(100.0 * count(*) / (SELECT count(Score) FROM dedup), 9) AS pct
        FROM dedup WHERE Score IS NOT NULL GROUP BY 1""",
    "a8_helpfulness_by_score": """SELECT Score, round(avg(ratio), 9) AS avg_helpfulness FROM voted
        WHERE Score IS NOT NULL GROUP BY Score""",
    "a9_best_score_for_helpfulness": """SELECT Score, round(avg(ratio), 9) AS avg_helpfulness FROM voted
        WHERE Score IS NOT NULL GROUP BY Score ORDER BY 2 DESC, 1 LIMIT 1""",
    "a10_length_bin_score": BINS,
    "a11_length_bin_score_open": f"""SELECT b.bin, {LABELS}[b.bin + 1] AS label, round(avg(Score), 9) AS avg_score
        FROM range(6) AS b(bin) LEFT JOIN (SELECT {bin_of('len')} AS bin, Score FROM shared
        WHERE len < (SELECT max(len) FROM shared)) AS s ON s.bin = b.bin GROUP BY 1, 2""",
    "a12_best_length_bin": f"{BINS} ORDER BY avg(Score) DESC, bin LIMIT 1",
    "a13_product_performance": """SELECT ProductId, round(score, 9) AS AverageScore, cnt AS ReviewCount,
        round(help, 9) AS AverageHelpfulnessRatio FROM performance""",
    "a14_performance_thresholds": """SELECT round(score_low, 9) AS score_low, round(score_high, 9) AS score_high,
        round(count_low, 9) AS count_low, round(count_high, 9) AS count_high FROM thresholds""",
    "a15_correlation_matrix": correlation("advanced"),
    "a15_correlation_matrix_shared": correlation("shared"),
    "t1_month_bucket": f"SELECT Id, {month()} AS Month FROM dedup WHERE secs IS NOT NULL",
    "t2_monthly_volume": monthly("dedup", "count(*) AS reviews"),
    "t3_monthly_avg_score": monthly("dedup", "round(avg(Score), 9) AS avg_score"),
    "t3_monthly_avg_score_sentiment": monthly("dedup", "round(avg(Score), 9) AS avg_score"),
    "t4_monthly_helpfulness": monthly(
        "dedup", "round(avg(ratio), 9) AS avg_helpfulness", "secs IS NOT NULL AND den > 0"
    ),
    "t5_volume_last_3_years": last_years(monthly("dedup", "count(*) AS reviews"), 3),
    "t5_score_last_1_year": last_years(monthly("dedup", "round(avg(Score), 9) AS avg_score"), 1),
    "t5_helpfulness_last_5_years": last_years(
        monthly("dedup", "round(avg(ratio), 9) AS avg_helpfulness", "secs IS NOT NULL AND den > 0"), 5
    ),
    "t6_period_volume": f"""SELECT CAST(sum(reviews) AS BIGINT) AS reviews
        FROM ({last_years(monthly('dedup', 'count(*) AS reviews'), 3)})""",
    "t7_period_avg_score": f"""SELECT round(avg(avg_score), 9) AS avg_score
        FROM ({last_years(monthly('dedup', 'avg(Score) AS avg_score'), 3)})""",
    "t8_product_monthly_score": f"""SELECT ProductId, {month()} AS Month, round(avg(Score), 9) AS avg_score
        FROM dedup WHERE secs IS NOT NULL GROUP BY 1, 2""",
    "t8_one_product_monthly_score": f"""SELECT ProductId, {month()} AS Month, round(avg(Score), 9) AS avg_score
        FROM dedup WHERE secs IS NOT NULL AND ProductId = '{PRODUCT_ID}' GROUP BY 1, 2""",
    "t9_product_current_score": f"""SELECT ProductId, Month, avg_score AS current_score FROM (
        SELECT ProductId, {month()} AS Month, round(avg(Score), 9) AS avg_score
        FROM dedup WHERE secs IS NOT NULL GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY ProductId ORDER BY Month DESC) = 1""",
    "t10_trend_direction": f"""SELECT a.h AS start_avg, b.h AS end_avg,
        CASE WHEN b.h > a.h THEN 'increased' WHEN b.h < a.h THEN 'decreased' ELSE 'remained stable' END AS direction
        FROM (SELECT h FROM period ORDER BY Month LIMIT 1) AS a, (SELECT h FROM period ORDER BY Month DESC LIMIT 1) AS b""",
    "f1_filter_score_range": "SELECT Id, Score FROM dedup WHERE Score BETWEEN 2 AND 4",
    "f2_keyword_search": newest("advanced", f"regexp_matches(combined, '(?i){KEYWORD}')", 10),
    "f2_keyword_count": f"SELECT count(*) AS matches FROM advanced WHERE regexp_matches(combined, '(?i){KEYWORD}')",
    "f2_keyword_search_shared": newest("shared", f"regexp_matches(combined, '(?i){ACCENTED}')", 10),
    "f2_keyword_count_literal": "SELECT count(*) AS matches FROM shared WHERE contains(lower(combined), ' the the')",
    "f3_semi_join_products": """SELECT Id, ProductId FROM dedup WHERE ProductId IN (
        SELECT ProductId FROM dedup GROUP BY 1 HAVING count(*) >= 30)""",
    "f3_semi_join_users": f"""SELECT Id, UserId FROM dedup WHERE UserId IN (
        SELECT UserId FROM dedup GROUP BY 1 HAVING count(*) >= {MIN_USER_REVIEWS})""",
    "f4_most_helpful_reviews": f"SELECT {REVIEW_ROWS} {MOST_HELPFUL} 10",
    "f5_least_helpful_reviews": f"SELECT {REVIEW_ROWS} {LEAST_HELPFUL} 10",
    "f6_recent_reviews_product": newest("capped", f"ProductId = '{PRODUCT_ID}'", 20),
    "f6_recent_reviews_user": newest("capped", f"UserId = '{USER_ID}'", 20),
    "f9_review_card_most_helpful": f"{CARD} {MOST_HELPFUL} 30",
    "f9_review_card_least_helpful": f"{CARD} {LEAST_HELPFUL} 30",
    "k1_top_products_by_volume": """SELECT ProductId, count(*) AS reviews FROM dedup GROUP BY 1
        ORDER BY 2 DESC, 1 LIMIT 10""",
    "k1_product_selector": "SELECT ProductId, count(*) AS reviews FROM dedup GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "k2_top_products_by_score": """SELECT ProductId, round(avg(Score), 9) AS avg_score FROM dedup
        GROUP BY 1 HAVING count(*) >= 30 ORDER BY avg(Score) DESC NULLS LAST, 1 LIMIT 10""",
    "k3_most_active_users": "SELECT UserId, count(*) AS reviews FROM dedup GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "k4_top_users_by_avg_helpfulness": """SELECT UserId, round(avg(ratio) FILTER (den > 0), 9) AS avg_helpfulness
        FROM capped GROUP BY 1 HAVING count(*) >= 10 ORDER BY 2 DESC NULLS LAST, 1 LIMIT 10""",
    "k5_helpful_reviewer_leaderboard": """SELECT UserId, CAST(sum(num) AS BIGINT) AS total_helpful_votes,
        count(Id) AS total_reviews FROM voted GROUP BY 1 HAVING sum(num) >= 10 ORDER BY 2 DESC, 1 LIMIT 10""",
    "k6_id_directory": """SELECT DISTINCT 'product' AS kind, ProductId AS id FROM dedup
        UNION ALL SELECT DISTINCT 'user', UserId FROM dedup""",
    "k6_sorted_product_ids": "SELECT ProductId FROM performance",
    "g1_classify_products": """SELECT ProductId, round(score, 9) AS AverageScore, cnt AS ReviewCount,
        round(help, 9) AS AverageHelpfulnessRatio, Category FROM classified""",
    "g2_segment_sizes": "SELECT Category, count(*) AS products FROM classified GROUP BY 1",
    "g3_segment_top": f"""SELECT Category, row_number() OVER (PARTITION BY Category ORDER BY
          CASE WHEN Category = '{S.PROBLEM_CHILD}' THEN round(score, 9)
               WHEN Category = '{S.UNDERPERFORMER}' THEN cnt ELSE -cnt END NULLS LAST, ProductId) AS rank,
        ProductId, round(score, 9) AS AverageScore, cnt AS ReviewCount FROM classified QUALIFY rank <= 20""",
    "g4_product_lookup": f"""SELECT ProductId, round(score, 9) AS AverageScore, cnt AS ReviewCount,
        round(help, 9) AS AverageHelpfulnessRatio, split_part(Category, ' (', 1) AS category_name,
        rtrim(split_part(Category, ' (', 2), ')') AS category_description
        FROM classified WHERE ProductId = '{PRODUCT_ID}'""",
    "n1_clean_text_punct": rf"""SELECT Id, md5(trim(regexp_replace({plain("Summary || ' ' || Text")},
        '[{BLANK_CLASS}]+', ' ', 'g'))) AS clean_md5 FROM dedup""",
    "n2_clean_text_alpha": f"""SELECT Id, md5(array_to_string(
        [w FOR w IN {split(letters('Text'))} IF NOT list_contains([{STOP}], w)], ' ')) AS clean_md5 FROM shared""",
    "n3_tokens": f"""SELECT Id, count(*) AS words, CAST(sum(length(word)) AS BIGINT) AS letters
        FROM ({SENTIMENT_WORDS}) GROUP BY Id""",
    "n5_word_frequencies": f"""SELECT word, count(*) AS n FROM ({SENTIMENT_WORDS}) WHERE Score BETWEEN 1 AND 5
        GROUP BY word ORDER BY n DESC, word LIMIT 200""",
    "n6_word_frequencies_by_class": f"""SELECT truth AS True_Sentiment_Category,
        row_number() OVER (PARTITION BY truth ORDER BY n DESC, word) AS rank, word, n FROM (
          SELECT truth, word, count(*) AS n FROM (SELECT truth, unnest({split(letters('Text'))}) AS word FROM shared)
          WHERE word NOT IN ({STOP}) GROUP BY 1, 2) QUALIFY rank <= 200""",
    "m4_confusion_matrix": """SELECT a.label AS actual, b.label AS predicted,
        count(j.y) AS n FROM labels AS a CROSS JOIN labels AS b
        LEFT JOIN judged AS j ON j.y = a.label AND j.p = b.label GROUP BY 1, 2""",
    "m6_clamp_rating": """SELECT Id, CAST(greatest(1, least(5, round_even((num * 5 - den) / 2.0, 0))) AS BIGINT)
        AS rating FROM reviews""",
}

EXTRA = {
    "t10_trend_direction": f""", period AS ({last_years(
        monthly('dedup', 'round(avg(ratio), 9) AS h', 'secs IS NOT NULL AND den > 0'), 3)})""",
    "m4_confusion_matrix": f", judged AS ({JUDGED}), labels AS (SELECT unnest(['Negative', 'Neutral', 'Positive']) AS label)",
}

WITH_VOCABULARY = f", vocabulary AS ({VOCABULARY}), lemmas AS ({LEMMAS})"
BODIES["n4_lemmatise"] = f"""SELECT Id, count(*) AS words, count(lemma) AS changed,
    CAST(sum(length(coalesce(lemma, word))) AS BIGINT) AS letters
    FROM ({SENTIMENT_WORDS}) AS t LEFT JOIN lemmas ON form = word GROUP BY Id"""
EXTRA["n4_lemmatise"] = WITH_VOCABULARY
BODIES["n5_word_frequencies_lemmas"] = f"""SELECT coalesce(lemma, word) AS word, count(*) AS n
    FROM ({SENTIMENT_WORDS}) AS t LEFT JOIN lemmas ON form = word WHERE Score BETWEEN 1 AND 2
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200"""
EXTRA["n5_word_frequencies_lemmas"] = WITH_VOCABULARY
BODIES["n7_lexicon_sentiment"] = """SELECT Id, polarity, CASE WHEN polarity > 0.05 THEN 'Positive'
    WHEN polarity < -0.05 THEN 'Negative' ELSE 'Neutral' END AS sentiment FROM means"""
EXTRA["n7_lexicon_sentiment"] = f""", vocabulary AS ({VOCABULARY}), hits AS (
    SELECT Id, avg(((length(t.word) * 7) % 9 - 4) / 4.0) AS polarity
    FROM (SELECT Id, unnest({split(plain('Text'))}) AS word FROM shared) AS t JOIN vocabulary USING (word) GROUP BY Id),
    means AS (SELECT Id, round(coalesce(polarity, 0.0), 9) AS polarity FROM shared LEFT JOIN hits USING (Id))"""
EXTRA["m3_classification_report"] = f""", judged AS ({JUDGED}), per_label AS (
    SELECT label, (SELECT count(*) FROM judged WHERE y = label) AS support,
           (SELECT count(*) FROM judged WHERE p = label) AS guessed,
           (SELECT count(*) FROM judged WHERE p = label AND y = label) AS hit
    FROM (SELECT unnest(['Negative', 'Neutral', 'Positive']) AS label)
  ), scores AS (SELECT *, coalesce(hit / nullif(guessed, 0), 0) AS p, coalesce(hit / nullif(support, 0), 0) AS r
    FROM per_label
  ), report AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM scores)"""
BODIES["m3_classification_report"] = """SELECT label, round(p, 9) AS precision, round(r, 9) AS recall,
    round(f, 9) AS f1, support FROM report
    UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hit) / sum(support), 9), CAST(sum(support) AS BIGINT) FROM report
    UNION ALL SELECT 'macro avg', round(avg(p), 9), round(avg(r), 9), round(avg(f), 9), CAST(sum(support) AS BIGINT)
    FROM report
    UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 9),
    round(sum(r * support) / sum(support), 9), round(sum(f * support) / sum(support), 9),
    CAST(sum(support) AS BIGINT) FROM report"""

# Texts repeat, so words are taken once per distinct text and weighed by the rows that have it.
TEXTS = """, texts AS MATERIALIZED (
    SELECT Text, row_number() OVER () AS tid FROM (SELECT DISTINCT Text FROM shared)
  ), text_rows AS MATERIALIZED (SELECT Id, truth, tid FROM shared JOIN texts USING (Text))"""
BODIES["p12_voted_reviews"] = """SELECT Id, 'deduplicated' AS form FROM (
      SELECT min(Id) AS Id, arg_min(den, Id) AS den FROM filled GROUP BY ProductId, UserId, Score, secs, Text)
    WHERE den > 0
    UNION ALL SELECT Id, 'with copies' FROM voted"""
EXTRA["n2_clean_text_alpha"] = TEXTS + f""", cleaned AS (SELECT tid, md5(array_to_string(
    [w FOR w IN {split(letters('Text'))} IF NOT list_contains([{STOP}], w)], ' ')) AS clean_md5 FROM texts)"""
BODIES["n2_clean_text_alpha"] = "SELECT Id, clean_md5 FROM text_rows JOIN cleaned USING (tid)"
EXTRA["n7_lexicon_sentiment"] = TEXTS + f""", vocabulary AS ({VOCABULARY}), hits AS (
    SELECT tid, avg(((length(t.word) * 7) % 9 - 4) / 4.0) AS polarity
    FROM (SELECT tid, unnest({split(plain('Text'))}) AS word FROM texts) AS t JOIN vocabulary USING (word) GROUP BY tid),
    means AS (SELECT Id, round(coalesce(polarity, 0.0), 9) AS polarity FROM text_rows LEFT JOIN hits USING (tid))"""

DRAWN = "CAST('0x' || substr(md5(CAST(Id AS VARCHAR) || ':42'), 1, 15) AS BIGINT)"
BODIES["f7_sample_rows"] = f"SELECT Id, Score, len AS ReviewLength FROM shared ORDER BY {DRAWN}, Id LIMIT 10000"
BODIES["f8_length_vs_helpfulness"] = f"""SELECT Id, len AS ReviewLength, round(ratio, 9) AS HelpfulnessRatio, Score, Summary,
    md5(Text) AS text_md5 FROM advanced ORDER BY {DRAWN}, Id LIMIT 50000"""

CLASSES = list(enumerate(S.SENTIMENTS))


def weight(part, whole):
    return f"CAST(round(ln(({part} + 1.0) / ({whole})) * 1000000) AS BIGINT)"


BAYES = TEXTS + f""", bag AS MATERIALIZED (
    SELECT tid, word, count(*) AS c FROM (SELECT tid, unnest({split(letters('Text'))}) AS word FROM texts)
    WHERE word NOT IN ({STOP}) GROUP BY ALL
  ), times AS (SELECT tid, truth, count(*) AS m FROM text_rows GROUP BY ALL
  ), counts AS MATERIALIZED (SELECT word, {", ".join(
      f"coalesce(sum(c * m) FILTER (truth = '{c}'), 0) AS n_{i}" for i, c in CLASSES)}
    FROM bag JOIN times USING (tid) GROUP BY word
  ), totals AS (SELECT count(*) AS v, {", ".join(f"sum(n_{i}) AS all_{i}" for i, _ in CLASSES)} FROM counts
  ), weights AS MATERIALIZED (SELECT word, {", ".join(f"{weight(f'n_{i}', f'all_{i} + v')} AS w_{i}" for i, _ in CLASSES)}
    FROM counts, totals
  ), documents_of AS (SELECT {", ".join(f"count(*) FILTER (truth = '{c}') AS d_{i}" for i, c in CLASSES)}, count(*) AS d
    FROM text_rows
  ), priors AS (SELECT {", ".join(f"{weight(f'd_{i}', f'd + {len(CLASSES)}')} AS p_{i}" for i, _ in CLASSES)} FROM documents_of)"""


def bayes_class(bag, texts, key):
    """Predicted class per key of a table of texts, given its words."""
    sums = ", ".join(f"coalesce(sum(c * w_{i}), 0) + any_value(p_{i}) AS s_{i}" for i, _ in CLASSES)
    return f"""SELECT {key}, CASE WHEN s_0 = greatest(s_0, s_1, s_2) THEN '{S.SENTIMENTS[0]}'
        WHEN s_1 = greatest(s_0, s_1, s_2) THEN '{S.SENTIMENTS[1]}' ELSE '{S.SENTIMENTS[2]}' END AS predicted
      FROM (SELECT t.{key}, {sums} FROM {texts} AS t CROSS JOIN priors
        LEFT JOIN ({bag}) AS b USING ({key}) LEFT JOIN weights USING (word) GROUP BY t.{key})"""


SCORED = BAYES + f""", classed AS ({bayes_class('SELECT * FROM bag', 'texts', 'tid')}
  ), scored AS MATERIALIZED (SELECT Id, tid, truth AS y, predicted AS p FROM text_rows JOIN classed USING (tid))"""
EXTRA["m1_score_sentiment"] = EXTRA["m2_predicted_distribution"] = SCORED
BODIES["m1_score_sentiment"] = "SELECT Id, y AS True_Sentiment_Category, p AS Predicted_Sentiment_ML FROM scored"
BODIES["m2_predicted_distribution"] = "SELECT p AS Predicted_Sentiment_ML, count(*) AS reviews FROM scored GROUP BY p"
EXTRA["m3_classification_report_model"] = SCORED + EXTRA["m3_classification_report"].replace(f"judged AS ({JUDGED})", "judged AS (SELECT y, p FROM scored)")
BODIES["m3_classification_report_model"] = BODIES["m3_classification_report"]
EXTRA["n6_word_frequencies_by_predicted_class"] = SCORED
BODIES["n6_word_frequencies_by_predicted_class"] = """SELECT p AS Predicted_Sentiment_ML,
    row_number() OVER (PARTITION BY p ORDER BY n DESC, word) AS rank, word, n FROM (
      SELECT p, word, CAST(sum(c * m) AS BIGINT) AS n FROM bag JOIN (
        SELECT tid, p, count(*) AS m FROM scored GROUP BY ALL) USING (tid) GROUP BY ALL) QUALIFY rank <= 200"""
EXTRA["m5_score_text"] = BAYES + f""", vocabulary AS ({VOCABULARY}), own AS (SELECT doc_id, coalesce(text, '') AS t FROM documents
  ), own_bag AS (SELECT doc_id, word, count(*) AS c FROM (SELECT doc_id, unnest({split(letters('t'))}) AS word FROM own) GROUP BY ALL
  ), own_class AS ({bayes_class('SELECT * FROM own_bag', 'own', 'doc_id')}
  ), own_mean AS (SELECT doc_id, avg(((length(w.word) * 7) % 9 - 4) / 4.0) AS polarity
    FROM (SELECT doc_id, unnest({split(plain('t'))}) AS word FROM own) AS w JOIN vocabulary USING (word) GROUP BY doc_id)"""
BODIES["m5_score_text"] = """SELECT doc_id, predicted AS Predicted_Sentiment_ML,
    CASE WHEN round(coalesce(polarity, 0), 9) > 0.05 THEN 'Positive' WHEN round(coalesce(polarity, 0), 9) < -0.05 THEN 'Negative'
    ELSE 'Neutral' END AS Lexicon_Sentiment FROM own_class LEFT JOIN own_mean USING (doc_id)"""
EXTRA["m7_fit_bayes"] = BAYES
BODIES["m7_fit_bayes"] = " UNION ALL ".join(
    f"SELECT '{c}' AS class, d_{i} AS documents, CAST(all_{i} AS BIGINT) AS words, p_{i} AS prior, v AS vocabulary FROM documents_of, totals, priors"
    for i, c in CLASSES
)

# Normal equations of stars on length (a), helpful votes (b) and votes (c), centred, by Cramer's rule.
PAIRS = ("aa", "ab", "ac", "bb", "bc", "cc", "az", "bz", "cz")
DET = "({0} * ({4} * {8} - {5} * {7}) - {1} * ({3} * {8} - {5} * {6}) + {2} * ({3} * {7} - {4} * {6}))"
GRID = ("aa", "ab", "ac", "ab", "bb", "bc", "ac", "bc", "cc")


def cramer(at):
    """Determinant of the equations with one column replaced, over that of the equations."""
    grid = [f"{'abc'[i // 3]}z" if i % 3 == at else GRID[i] for i in range(9)]
    return f"{DET.format(*grid)} / {DET.format(*GRID)}"


RATING_MODEL = f""", numbers AS (SELECT CAST(len AS HUGEINT) AS a, CAST(num AS HUGEINT) AS b, CAST(den AS HUGEINT) AS c,
    CAST(Score AS HUGEINT) AS z FROM shared
  ), raw_sums AS (SELECT CAST(count(*) AS HUGEINT) AS n, {", ".join(f"CAST(sum({x}) AS HUGEINT) AS {x}" for x in "abcz")},
    {", ".join(f"CAST(sum({x[0]} * {x[1]}) AS HUGEINT) AS {x}" for x in PAIRS)} FROM numbers
  ), centred AS (SELECT n, a, b, c, z, {", ".join(f"CAST(n * {x} - {x[0]} * {x[1]} AS DOUBLE) AS {x}_" for x in PAIRS)} FROM raw_sums
  ), solved AS (SELECT n, a, b, c, z, {", ".join(f"{re.sub('([abcz]{2})', chr(92) + '1_', cramer(i))} AS k_{x}" for i, x in enumerate("abc"))} FROM centred
  ), model AS (SELECT *, (z - k_a * a - k_b * b - k_c * c) / n AS k_0 FROM solved)"""
EXTRA["m6_score_rating"] = EXTRA["m7_fit_rating"] = RATING_MODEL
BODIES["m6_score_rating"] = """SELECT Id, Score, CAST(greatest(1, least(5, round_even(k_0 + len * k_a + num * k_b + den * k_c, 0))) AS BIGINT)
    AS PredictedRating FROM shared, model"""
BODIES["m7_fit_rating"] = " UNION ALL ".join(
    f"SELECT '{term}' AS term, round({k}, 12) AS coefficient FROM model"
    for term, k in zip(("(intercept)", S.LENGTH, S.VOTES_UP, S.VOTES_ALL), ("k_0", "k_a", "k_b", "k_c"))
)

for name in ("t2_monthly_volume", "t3_monthly_avg_score", "t5_helpfulness_last_5_years", "t7_period_avg_score",
             "t8_product_monthly_score", "t9_product_current_score", "a2_score_distribution", "a13_product_performance"):
    BODIES[f"{name}_from_state"] = BODIES[name]

BODIES["p1_read_split_reviews"] = BODIES["p1_read_reviews"]
BODIES["f2_keyword_search_indexed"] = BODIES["f2_keyword_search"]
BODIES["f2_keyword_count_indexed"] = BODIES["f2_keyword_count_literal"]
BODIES["a1_kpis_from_state"] = BODIES["a1_kpis"]
BODIES["a1_kpis_last_3_years_from_state"] = f"""SELECT count(*) AS total_reviews, count(DISTINCT ProductId) AS unique_products,
    count(DISTINCT UserId) AS unique_customers, round(avg(Score), 9) AS avg_score
    FROM ({last_years(f"SELECT {month()} AS Month, * FROM dedup WHERE secs IS NOT NULL", 3)})"""

ORACLE = {name: f"{TABLES}{EXTRA.get(name, '')}\n{body}" for name, body in BODIES.items()}
