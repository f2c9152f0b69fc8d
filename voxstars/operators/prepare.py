"""Preparation of the raw review table.

Each dashboard of the reference prepares its own table, and the differences change results; a
``Profile`` states them as options and ``prepare`` is the one job behind all of them.
"""

from dataclasses import dataclass

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxstars import schema as S
from voxstars.functions import columns as C


CELL_BITS = 20  # the marks of possible copies take at most 2^20 x 16 bytes
MARKS = 3  # bits that a value with copies sets in its cell


@dataclass(frozen=True)
class Profile:
    name: str
    drop_null_text: bool = False  # drop rows without text, summary or score; otherwise fill with ''
    dedup: bool = True
    dedup_raw_time: bool = False  # compare raw seconds instead of the converted time
    cap: float | None = None
    one_becomes: float | None = None
    ratio: bool = True
    combined: bool = False
    sentiment: bool = False
    drop: tuple = ()


SHARED = Profile("shared", drop_null_text=True, dedup=False, combined=True, sentiment=True)
OVERVIEW = Profile("overview", drop=(S.ID, S.PROFILE_NAME))
SENTIMENT = Profile("sentiment", dedup_raw_time=True, ratio=False, combined=True)
HELPFULNESS = Profile("helpfulness")
# The voted table is cut off before duplicates go; the clean form is voted(prepare(df, HELPFULNESS)).
HELPFULNESS_VOTED = Profile("helpfulness_voted", dedup=False)
PRODUCT_USER = Profile("product_user", cap=1.0)
ADVANCED = Profile("advanced", cap=1.0, one_becomes=0.98, combined=True)
REVENUE = Profile("revenue")


def drop_columns(df, *names):
    return df.drop(*names)


def drop_nulls(df, *names):
    return df.na.drop(subset=list(names))


def fill_text_nulls(df):
    return df.na.fill("", [S.SUMMARY, S.TEXT])


def coerce_score(df):
    return df.withColumn(S.SCORE, C.as_number(S.SCORE))


def with_ratio(df, cap=None, one_becomes=None):
    ratio = C.helpfulness_ratio()
    if cap is not None:
        ratio = C.cap_ratio(ratio, cap, one_becomes)
    return df.withColumn(S.RATIO, ratio)


def _first_of(df, key, order):
    """Row 1 of each window: Spark cuts every group to one row inside each map task before the shuffle
    (WindowGroupLimit), so a review copied a billion times reaches its reducer as one row per task."""
    first = Window.partitionBy(*key).orderBy(F.col(order).asc_nulls_last())
    return df.withColumn("_copy", F.row_number().over(first)).filter("_copy = 1").drop("_copy")


def _probe(df, columns):
    """One hash of the columns that equal values share: -0.0 and 0.0 are one value, null is a value."""
    kinds = dict(df.dtypes)
    return F.xxhash64(*[F.col(c) + F.lit(0.0) if kinds[c] in ("double", "float") else F.col(c) for c in columns])


def suspected_copies(df, columns, cell_bits=CELL_BITS):
    """Mark in ``_suspect`` every row whose values in ``columns`` some other row has.

    Rows are counted by one 8-byte hash. Hashes with several rows set MARKS bits in one of at most
    2^cell_bits cells of 64 bits, which are broadcast and looked up where the rows are read. Other rows
    that have all their bits set are marked too, so a mark means "compare", no mark means "has no copy".
    With four copied reviews a cell that is one row in 120, with a single bit it would be one in 16.
    """
    cell = F.expr(f"shiftrightunsigned(_h, {64 - cell_bits})").alias("_cell")
    bits = F.expr(" | ".join(f"shiftleft(1L, CAST(shiftright(_h, {6 * i}) & 63 AS INT))" for i in range(MARKS))).alias("_mask")
    several = df.groupBy(_probe(df, columns).alias("_h")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    cells = several.select(cell, bits).groupBy("_cell").agg(F.expr("bit_or(_mask)").alias("_bits"))
    placed = df.withColumn("_h", _probe(df, columns)).select("*", cell, bits)
    marked = placed.join(F.broadcast(cells), "_cell", "left")  # at most 2^cell_bits rows
    hit = F.coalesce(F.expr("_bits & _mask = _mask"), F.lit(False))
    return marked.withColumn("_suspect", hit).drop("_h", "_cell", "_mask", "_bits")


def dedup_reviews(df, key=S.REVIEW_KEY, order=S.ID, heavy=(S.TEXT,), cell_bits=CELL_BITS):
    """Keep the first row (smallest Id) of every group of equal reviews; nulls equal each other.

    Two phases: the key without its heavy columns tells which rows may have a copy, from a scan that
    does not read the texts. All others are kept where they are read, without a shuffle; only
    suspects carry their text to the exact comparison. Columns that a job never reads are pruned in
    every branch. A filter on key columns commutes with this: put it before, so that it reaches all scans.
    """
    light = [c for c in key if c not in heavy]
    if not light or len(light) == len(key):
        return _first_of(df, key, order)
    marked = suspected_copies(df, light, cell_bits)
    alone = marked.filter(~F.col("_suspect")).drop("_suspect")
    return alone.unionByName(_first_of(marked.filter("_suspect").drop("_suspect"), key, order))


def voted(df):
    return df.filter(F.col(S.VOTES_ALL) > 0)


def prepare(df, profile, few=False):
    """Raw reviews to the table that a profile's jobs read.

    With ``few``, when a filter on a product or user came before, equal reviews are found by one window
    over all rows, which costs less there than looking for suspects first.
    """
    df = coerce_score(df)
    if profile.drop_null_text:
        df = drop_nulls(df, S.TEXT, S.SUMMARY, S.SCORE)
    else:
        df = fill_text_nulls(df)
    # Fixed-width derived columns come before the dedup: jobs that need only the length or the
    # ratio then carry a number through the shuffle, not the summary.
    if profile.ratio:
        df = with_ratio(df, profile.cap, profile.one_becomes)
    if profile.combined:
        df = df.withColumn(S.LENGTH, C.review_length())
    if not profile.dedup_raw_time:
        df = df.withColumn(S.TIME, C.seconds_in_range(S.TIME))
    if profile.dedup:
        df = _first_of(df, S.REVIEW_KEY, S.ID) if few else dedup_reviews(df)
    df = df.withColumn(S.TIME, C.time_of(S.TIME))
    if profile.combined:
        df = df.withColumn(S.COMBINED, C.combined_text())
    if profile.sentiment:
        df = df.withColumn(S.TRUE_SENTIMENT, C.true_sentiment())
    return drop_columns(df, *profile.drop)


def prepare_helpfulness(df):
    """Both tables of the helpfulness dashboard: deduplicated reviews, and voted ones with copies."""
    return prepare(df, HELPFULNESS), voted(prepare(df, HELPFULNESS_VOTED))


def validate_reviews(df):
    """One row per requirement of the product jobs, with ``violated`` telling whether it fails.

    One pass counts everything; a missing column is a violation, not an error.
    """
    required = (S.PRODUCT, S.SCORE)
    known = {c: F.count(c) if c in df.columns else F.lit(0) for c in required}
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[known[c].alias(f"n_{c}") for c in required])
    checks = [F.struct(F.lit("table is not empty").alias("requirement"), (F.col("n") == 0).alias("violated"))]
    for c in required:
        text = F.lit(f"{c} is present and not entirely empty")
        checks.append(F.struct(text.alias("requirement"), (F.col(f"n_{c}") == 0).alias("violated")))
    return counts.select(F.inline(F.array(*checks)))
