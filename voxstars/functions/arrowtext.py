"""Words cut from the UTF-8 bytes of whole Arrow columns, inside the tasks that read the texts.

The words are those of ``columns.words`` over ``without_punct`` and ``letters_only``, in a tenth of the time
that regular expressions take. Texts arrive in lower case from Spark, so that both ways fold alike; where only the
letters a to z are kept, the tasks fold case themselves.
"""

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxstars.functions.cuts import letters_only, without_punct
from voxstars.functions.wordkeys import Counts, Table, Words, slices

# Functions that run in tasks travel with the job, so executors need no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_COUNTED = 500_000  # distinct words that one task counts before it hands them on
MAX_WORD_BYTES = 128 << 20
ROWS = 1 << 16


def texts_of(column):
    """The texts of an Arrow column as bytes; a null is empty."""
    return (t or b"" for t in column.cast(pa.large_binary()).to_pylist())


def _strings(words):
    return pa.array(words, pa.binary()).cast(pa.string())


def lowered(text):
    return F.lower(F.coalesce(F.col(text), F.lit("")) if isinstance(text, str) else text)


def _given(text, cut):
    """The text as a cut takes it."""
    if cut is not letters_only:
        return lowered(text)
    return F.coalesce(F.col(text), F.lit("")) if isinstance(text, str) else text


def _joined(column, cut, stop=None):
    """Texts cut into words and joined by single blanks, without the words of the table ``stop``."""
    parts = []
    for _, data, offsets in slices(column):
        words = Words(data, offsets, cut)
        parts.append(words.texts(None if stop is None else stop.places(words) == stop.unknown))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def clean_punct(text):
    """``columns.clean_punct``: words without punctuation, joined by single blanks."""

    @F.arrow_udf("string")
    def clean(column: pa.Array) -> pa.Array:
        return _joined(column, without_punct)

    return clean(lowered(text))


def letters_without(text, stop_words):
    """Letters-only words that are no stop words, joined by single blanks."""
    stop = Table(pa.array([w.encode() for w in stop_words], pa.binary()))

    @F.arrow_udf("string")
    def kept(column: pa.Array) -> pa.Array:
        return _joined(column, letters_only, stop)

    return kept(_given(text, letters_only))


def split_words(text):
    """``columns.words``: a blank at either end leaves an empty word there."""
    words = text.split()
    if not words:
        return [b"", b""] if text else [b""]
    if text[0] == 32:
        words.insert(0, b"")
    if text[-1] == 32:
        words.append(b"")
    return words


def word_arrays(text, cut=without_punct):
    """The array of ``columns.words`` over a cut text."""

    @F.arrow_udf("array<string>")
    def arrays(column: pa.Array) -> pa.Array:
        words, ends = [], [0]
        for t in texts_of(column):
            words += split_words(cut(t))
            ends.append(len(words))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _strings(words))

    return arrays(lowered(text))


def _by_group(batch, n):
    """(values, texts) of a batch for each value of its first n columns."""
    if not n:
        return [((), batch.column(0))]
    rows = {}
    for i, values in enumerate(zip(*[batch.column(i).to_pylist() for i in range(n)])):
        rows.setdefault(values, []).append(i)
    return [(values, batch.column(n).take(pa.array(which))) for values, which in rows.items()]


def word_counts(df, text, cut, *group):
    """(*group, word, n): words of all texts. Each task counts its own, so a word leaves it as few rows.

    A task holds some twice MAX_COUNTED words, each as two numbers and a count, and those of one slice of text more.
    """
    rows = df.select(*group, _given(text, cut).alias("_text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def batches_of(counts, types):
        for values, words in counts.items():
            for names, numbers in words.columns(ROWS):
                columns = [pa.array([v] * len(names), t) for v, t in zip(values, types)]
                yield pa.RecordBatch.from_arrays([*columns, names, numbers], names=schema.names)

    def run(batches):
        counts, types = {}, []
        for batch in batches:
            types = [f.type for f in batch.schema][:-1]
            for values, texts in _by_group(batch, len(types)):
                words = counts.setdefault(values, Counts())
                for _, data, offsets in slices(texts):
                    words.add(Words(data, offsets, cut))
                    if sum(c.held + len(c.odd) for c in counts.values()) > 2 * MAX_COUNTED and sum(c.merge() for c in counts.values()) > MAX_COUNTED:
                        yield from batches_of(counts, types)
                        words = Counts()
                        counts = {values: words}
        yield from batches_of(counts, types)

    return rows.mapInArrow(run, schema).groupBy(*group, "word").agg(F.sum("n").alias("n"))


def _summed(values, places, first):
    """Sums of the values at the places of each text's words; whole numbers stay exact."""
    if values.dtype.kind == "i":
        upto = np.zeros(len(places) + 1, np.int64)
        np.cumsum(values[places], dtype=np.int64, out=upto[1:])
        return upto[first[1:]] - upto[first[:-1]]
    sums = np.bincount(np.repeat(np.arange(len(first) - 1), np.diff(first)), weights=values[places], minlength=len(first) - 1)
    return sums.astype(np.float64)  # of no words at all they would be whole numbers


def _narrow(values):
    """Whole numbers in 32 bits where all fit."""
    small = values.dtype.kind == "i" and (not len(values) or max(-int(values.min()), int(values.max())) < 1 << 31)
    return values.astype(np.int32) if small else values


def _sent(hot, names, skip=()):
    """A bounded (word, *names) table as places of words and their weights, sent to every task."""
    table = hot.select("word", *names).toArrow()
    words = table.column("word").combine_chunks().cast(pa.large_binary())
    columns = [_narrow(table.column(c).to_numpy()) for c in names]
    del table
    stop = pa.array([w.encode() for w in skip], pa.large_binary())
    if len(stop):
        words = pa.concat_arrays([words, stop.filter(pc.invert(pc.is_in(stop, words)))])
    places = Table(words)
    # Stop words and unknown ones weigh nothing.
    weights = [np.append(np.append(v, np.zeros(len(words) - len(v), v.dtype))[places.order], v.dtype.type(0)) for v in columns]
    return hot.sparkSession.sparkContext.broadcast((places, weights))


def weights_of(text, cut, hot, names):
    """A struct of the sums of each text's words, where ``hot`` has all words that weigh anything."""
    bring = _sent(hot, names)

    @F.arrow_udf(T.StructType([T.StructField(c, hot.schema[c].dataType) for c in names]))
    def sums(column: pa.Array) -> pa.Array:
        places, values = bring.value
        parts = [[np.zeros(0, v.dtype.kind + "8")] for v in values]
        for _, data, offsets in slices(column):
            found = Words(data, offsets, cut)
            at = places.places(found)
            for part, v in zip(parts, values):
                part.append(_summed(v, at, found.first))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(p)) for p in parts], names=list(names))

    # Else the optimizer may run it once for each use.
    return sums.asNondeterministic()(_given(text, cut))


def weigh(df, text, cut, hot, rare, names, keys, skip=()):
    """(*keys, *names): sums of the weights of each text's words; one row a text if ``rare`` is None.

    ``hot`` is a bounded (word, *names) table that goes to every task, where its words are weighed as
    the text is cut. Only the other words, without those in ``skip``, leave the task, and meet the table ``rare``
    in a merge join; then a text has several rows, whose sums add up.
    """
    bring = _sent(hot, names, skip)
    rows = df.select(*keys, _given(text, cut).alias("_text"))
    fields = rows.schema.fields[:-1]
    kinds = [T.StructField(c, hot.schema[c].dataType) for c in names]
    others = T.StructField("_others", T.ArrayType(T.StringType()))
    schema = T.StructType([*fields, *kinds, *([] if rare is None else [others])])
    wanted = rare is not None

    def run(batches):
        places, values = bring.value
        for batch in batches:
            for which, data, offsets in slices(batch.column(len(fields))):
                found = Words(data, offsets, cut)
                at = places.places(found)
                sums = [pa.array(_summed(v, at, found.first)) for v in values]
                if wanted:
                    left = np.flatnonzero(at == places.unknown)
                    ends = np.searchsorted(left, found.first).astype(np.int32)
                    sums.append(pa.ListArray.from_arrays(pa.array(ends), _strings(found.spelled(left))))
                kept = [batch.column(i).slice(which.start, which.stop - which.start) for i in range(len(fields))]
                yield pa.RecordBatch.from_arrays([*kept, *sums], names=schema.names)

    met = rows.mapInArrow(run, schema)
    if not wanted:
        return met
    # The row of a text itself goes along under a word that no table has, dealt over many tasks.
    own = F.concat(F.lit("#"), F.pmod(F.xxhash64(*keys), F.lit(1 << 16)).cast("string"))
    each = met.select(*keys, *names, F.posexplode(F.concat(F.array(own), "_others")).alias("_place", "word"))
    each = each.select(*keys, "word", *[F.when(F.col("_place") == 0, F.col(c)).alias(c) for c in names])
    more = rare.select("word", *[F.col(c).alias(f"_{c}") for c in names]).hint("merge")
    return each.join(more, "word", "left").select(*keys, *[F.coalesce(c, f"_{c}").alias(c) for c in names])


def few_words(table, at_most):
    """Whether a table has at most so many words, none of them so long that they take more than MAX_WORD_BYTES."""
    rows, size = table.agg(F.count(F.lit(1)), F.sum(F.octet_length("word"))).first()
    return rows <= at_most and (size or 0) <= MAX_WORD_BYTES


def most_frequent(table, at_most, n="n"):
    """Condition for the most frequent rows of a table by ``n``, at most ``at_most`` of them.

    Frequencies are compared by eighths of powers of two, so the driver sees some hundred rows.
    """
    level = F.floor(F.log2(F.greatest(F.col(n), F.lit(1)) + F.lit(0.0)) * 8)
    cut, held = 1 << 20, 0
    for grade, rows in sorted(table.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("c")).collect(), reverse=True):
        held += rows
        if held > at_most:
            break
        cut = grade
    return level >= cut
