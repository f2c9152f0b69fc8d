"""Review files: read the CSV once, keep the table as Parquet."""

import sys
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxstars.schema import CSV_SCHEMA
from voxstars.sources.staging import stage

# Functions that run in tasks travel with the job, so executors need no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The texts that the usual CSV reader of the Python data stack takes as missing.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


OPTIONS = {"quote": '"', "escape": '"', "multiLine": True}


def without_missing(raw, missing=MISSING):
    strings = [f.name for f in CSV_SCHEMA if isinstance(f.dataType, T.StringType)]
    return raw.withColumns({c: F.when(~F.col(c).isin(list(missing)), F.col(c)) for c in strings})


def read_reviews(spark, path, missing=MISSING, multi_line=True):
    """Review CSV with a header, quoted fields and doubled quotes.

    ``multi_line`` reads fields with line breaks; such files are not split, so give many files, or read
    large ones with ``read_split_reviews``. Texts in ``missing`` are null.
    """
    raw = spark.read.schema(CSV_SCHEMA).option("header", True).options(**{**OPTIONS, "multiLine": multi_line}).csv(path)
    return without_missing(raw, missing)


def _pieces(inner):
    """A function of Arrow batches (part, at_start, before, value), the lines of splits in their order.

    A record begins at every line with an even number of quotes before it. With ``inner`` it gives
    (part, text) of the records that another record follows in their split, but not a file's first
    one, the header. Without, it gives (part, opens, header, text) of the other pieces, at most two a
    split: what comes before the first record, and the last record.
    """
    names = ["part", "text"] if inner else ["part", "opens", "header", "text"]

    def rows(part, texts):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(texts), part, np.int64)), texts], names=names)

    def end(part, opens, header, held):
        columns = pa.array([part], pa.int64()), pa.array([opens]), pa.array([header]), pa.array([b"\n".join(held)], pa.large_binary())
        return pa.RecordBatch.from_arrays(list(columns), names=names)

    def run(batches):
        # The piece in progress: its lines, whether it begins with a record, and whether that is the header.
        part, held, opens, header, before = None, [], False, False, 0
        for batch in batches:
            parts, at_start = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            values = batch.column(3).cast(pa.large_binary())
            quotes = pc.count_substring(values, b'"').to_numpy().astype(np.int64)
            borders = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for a, b in zip(borders, borders[1:]):
                if a == b:
                    continue
                if parts[a] != part:
                    if held and not inner:
                        yield end(part, opens, header, held)
                    part, held, opens, header = int(parts[a]), [], False, False
                    before, file_start = batch.column(2)[a].as_py(), bool(at_start[a])
                upto = before + np.cumsum(quotes[a:b])
                starts = a + np.flatnonzero((upto - quotes[a:b]) % 2 == 0)
                before = int(upto[-1])
                if not len(starts):
                    held += values.slice(a, b - a).to_pylist()
                    continue
                first, last = int(starts[0]), int(starts[-1])
                held += values.slice(a, first - a).to_pylist()
                if opens and inner and not header:
                    yield rows(part, pa.array([b"\n".join(held)], pa.large_binary()))
                if not opens and held and not inner:
                    yield end(part, False, False, held)
                is_header = file_start and not opens  # the first record of the file begins at its first line
                if inner and len(starts) > 1:
                    kept = starts[1:] if is_header else starts
                    if len(kept) > 1:
                        lists = pa.LargeListArray.from_arrays(pa.array(kept - kept[0]), values.slice(kept[0], last - kept[0]))
                        yield rows(part, pc.binary_join(lists, pa.scalar(b"\n", pa.large_binary())))
                held, opens, header = values.slice(last, b - last).to_pylist(), True, is_header and len(starts) == 1
        if held and not inner:
            yield end(part, opens, header, held)

    return run


def split_records(spark, path):
    """(file, record) for every record of CSV files whose quoted fields may hold line breaks, read in splits.

    A line break ends a record if the quotes before it in the file are even in number; doubled quotes
    keep the count right. One scan counts the quotes of each split, and a running sum over the splits of
    a file, a written table of one row per split, tells how each begins. Then the tasks that read the
    lines put them together in their order, without a shuffle. What a split holds before its first
    record belongs to the last record of an earlier split and is joined to it: only these pieces, at
    most two a split, are shuffled, from a scan of their own. Header records are left out.
    A quote inside a field that is not quoted is no CSV and would shift the count.
    """
    place = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")
    lines = spark.read.option("lineSep", "\n").text(path).select(*place, F.col("value"))
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    order = Window.partitionBy("file").orderBy("split")
    starts = lines.groupBy("file", "split").agg(F.sum(quotes).alias("quotes"))
    before = F.coalesce(F.sum("quotes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row per split, some hundred bytes for as many megabytes of input; one task numbers them.
    number = F.row_number().over(Window.orderBy("file", "split")).cast("long")
    starts = F.broadcast(stage(starts.select("file", "split", before.alias("before"), number.alias("part"))))

    known = lines.join(starts, ["file", "split"]).select("part", (F.col("split") == 0).alias("at_start"), "before", F.col("value").cast("binary").alias("value"))
    inner = known.mapInArrow(_pieces(True), "part long, text binary")
    ends = known.mapInArrow(_pieces(False), "part long, opens boolean, header boolean, text binary").join(starts, "part")
    order = Window.partitionBy("file").orderBy("part", "opens")
    owner = F.count(F.when(F.col("opens"), 1)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    owned = ends.withColumn("owner", owner).groupBy("file", "owner").agg(
        F.max("header").alias("header"), F.array_sort(F.collect_list(F.struct("part", "opens", F.col("text").cast("string").alias("text")))).alias("parts")
    )
    # A piece of a later split follows the line break that the split before it ended with.
    joined = owned.filter("NOT header").select("file", F.array_join(F.transform("parts", lambda x: x["text"]), "\n").alias("text"))
    records = inner.join(starts, "part").select("file", F.col("text").cast("string").alias("text")).unionByName(joined)
    # Only such ends can match the pattern; few texts go through it.
    ended = reduce(or_, [F.endswith("text", F.lit("\r" + e)) for e in ("", "\n", "\x85", "\u2028", "\u2029")])
    text = F.when(ended, F.regexp_replace("text", "\\r$", "")).otherwise(F.col("text"))
    return records.select("file", text.alias("record")).filter("record <> ''")


def read_split_reviews(spark, path, missing=MISSING):
    """Review CSV like ``read_reviews``, with large files read by many tasks; equal rows for well-formed files."""
    options = {k: str(v).lower() for k, v in OPTIONS.items()}
    parsed = split_records(spark, path).select(F.from_csv("record", CSV_SCHEMA.simpleString()[7:-1].replace(":", " "), options).alias("r"))
    return without_missing(parsed.select("r.*"), missing)


def write_reviews(df, path, mode="errorifexists"):
    """Keep a review table as Parquet."""
    df.write.mode(mode).parquet(path)


def load_reviews(spark, path):
    return spark.read.parquet(path)
