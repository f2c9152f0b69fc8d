"""The review table: column names, explicit schema and the fixed labels used across the jobs."""

from pyspark.sql import types as T

ID = "Id"
PRODUCT = "ProductId"
USER = "UserId"
PROFILE_NAME = "ProfileName"
VOTES_UP = "HelpfulnessNumerator"
VOTES_ALL = "HelpfulnessDenominator"
SCORE = "Score"
TIME = "Time"
SUMMARY = "Summary"
TEXT = "Text"

COMBINED = "CombinedText"
LENGTH = "ReviewLength"
RATIO = "HelpfulnessRatio"
TRUE_SENTIMENT = "True_Sentiment_Category"
PREDICTED = "Predicted_Sentiment_ML"

# Score is read as text because badly typed scores must become null, not fail the scan.
CSV_SCHEMA = T.StructType(
    [
        T.StructField(ID, T.LongType()),
        T.StructField(PRODUCT, T.StringType()),
        T.StructField(USER, T.StringType()),
        T.StructField(PROFILE_NAME, T.StringType()),
        T.StructField(VOTES_UP, T.LongType()),
        T.StructField(VOTES_ALL, T.LongType()),
        T.StructField(SCORE, T.StringType()),
        T.StructField(TIME, T.LongType()),
        T.StructField(SUMMARY, T.StringType()),
        T.StructField(TEXT, T.StringType()),
    ]
)

# Two rows are the same review when these five agree (nulls agree with each other).
REVIEW_KEY = (PRODUCT, USER, SCORE, TIME, TEXT)

# Sentiment labels, length bins (left-closed) and product segments.
POSITIVE, NEUTRAL, NEGATIVE = "Positive", "Neutral", "Negative"
SENTIMENTS = (NEGATIVE, NEUTRAL, POSITIVE)
LENGTH_EDGES = (0, 50, 150, 500, 1000, 2000)
LENGTH_LABELS = ("<50", "50-150", "150-500", "500-1000", "1000-2000", ">2000")
CASH_COW = "Cash Cow (High Score, High Volume)"
PROBLEM_CHILD = "Problem Child (Low Score, High Volume)"
HIDDEN_GEM = "Hidden Gem (High Score, Low Volume)"
UNDERPERFORMER = "Underperformer (Low Score, Low Volume)"

CORRELATION_COLUMNS = (SCORE, VOTES_UP, VOTES_ALL, RATIO, LENGTH)
