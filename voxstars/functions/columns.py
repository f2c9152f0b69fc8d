"""Column expressions on reviews. All are built-in Spark expressions, so they stay in generated code."""

from functools import reduce

from pyspark.sql import functions as F

from voxstars import schema as S

# Nanosecond timestamps cover this many seconds around 1970; times outside become null.
MAX_SECONDS = 9223372036

# The blanks of Unicode and the 0x1c-0x1f separators. Named by property: spelled out as ranges, the
# negated class is matched eight times slower.
BLANK_CLASS = r"\p{IsWhite_Space}\x1c-\x1f"


def col(c):
    return F.col(c) if isinstance(c, str) else c


def as_number(c):
    """Text or number to double; text that is no number, and NaN, become null."""
    value = col(c).try_cast("double")
    return F.when(~F.isnan(value), value)


def seconds_in_range(c):
    """Unix seconds as a long, or null when no nanosecond timestamp can hold them."""
    seconds = col(c).try_cast("bigint")
    return F.when(seconds.between(-MAX_SECONDS, MAX_SECONDS), seconds)


def time_of(c):
    """Unix seconds to a zone-free timestamp."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds_in_range(c).cast("decimal(18,6)"))


def month_of(c=S.TIME):
    """First day of the month of a zone-free timestamp."""
    return F.trunc(col(c).cast("date"), "MM")


def minute_label(c=S.TIME):
    """``YYYY-MM-DD HH:MM``, or N/A without a time. Goes through text: no session zone is involved."""
    return F.coalesce(F.substring(col(c).cast("string"), 1, 16), F.lit("N/A"))


def helpfulness_ratio(up=S.VOTES_UP, total=S.VOTES_ALL):
    return F.when(col(total) > 0, col(up) / col(total)).otherwise(F.lit(0.0))


def cap_ratio(ratio, upper=1.0, one_becomes=None):
    """Clip at ``upper``; optionally move an exact 1.0 elsewhere."""
    capped = F.when(col(ratio) > upper, F.lit(upper)).otherwise(col(ratio))
    if one_becomes is None:
        return capped
    return F.when(capped == 1.0, F.lit(one_becomes)).otherwise(capped)


def combined_text(summary=S.SUMMARY, text=S.TEXT):
    return F.concat(col(summary), F.lit(" "), col(text))


def review_length(summary=S.SUMMARY, text=S.TEXT):
    """Character count of the combined text without building it."""
    return F.length(col(summary)) + F.lit(1) + F.length(col(text))


def true_sentiment(score=S.SCORE):
    """At least 4 is positive, at most 2 negative, the rest neutral."""
    return (
        F.when(col(score) >= 4, S.POSITIVE).when(col(score) <= 2, S.NEGATIVE).otherwise(S.NEUTRAL)
    )


def mapped_sentiment(score=S.SCORE):
    """The strict variant: only whole stars 1 to 5 have a class, anything else is null."""
    return (
        F.when(col(score).isin(4, 5), S.POSITIVE)
        .when(col(score) == 3, S.NEUTRAL)
        .when(col(score).isin(1, 2), S.NEGATIVE)
    )


def length_bin_index(length=S.LENGTH):
    """Index 0-5 of the left-closed length bin."""
    value = col(length)
    chain = reduce(
        lambda acc, step: acc.when(value < step[1], step[0]),
        enumerate(S.LENGTH_EDGES[2:], start=1),
        F.when(value < S.LENGTH_EDGES[1], 0),
    )
    return F.when(value >= 0, chain.otherwise(len(S.LENGTH_LABELS) - 1))


def length_bin_label(index):
    return F.element_at(F.array(*[F.lit(x) for x in S.LENGTH_LABELS]), col(index) + 1)


def helpfulness_bin(nbins, up=S.VOTES_UP, total=S.VOTES_ALL):
    """Histogram bin of the vote ratio in whole-number arithmetic: 29/50 is bin 29 of 50, never 28."""
    return F.expr(f"CASE WHEN {total} > 0 THEN ({up} * {int(nbins)}) DIV {total} ELSE 0L END")


def without_punct(text):
    """Lower case, no ASCII punctuation, no digits."""
    return F.regexp_replace(F.lower(col(text)), r"[\p{Punct}\p{Nd}]+", "")


def clean_punct(text):
    """``without_punct`` with blanks squeezed and trimmed."""
    return F.trim(F.regexp_replace(without_punct(text), f"[{BLANK_CLASS}]+", " "))


def letters_only(text):
    """Lower case, everything but a-z and blanks removed; null becomes the empty string."""
    return F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), f"[^a-z{BLANK_CLASS}]+", "")


def words(cleaned):
    """Split on runs of blanks. A blank at either end leaves an empty word there, which readers skip
    after exploding: a row filter is compiled, a filter inside the array is not."""
    return F.split(col(cleaned), f"[{BLANK_CLASS}]+")
