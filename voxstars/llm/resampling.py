"""Quality selection by importance resampling.

Two generative models over hashed n-grams (one and two tokens, a fixed number of bins) are counted:
one over the target text, documents labelled good, one over all raw text. A document's weight is the
log ratio of its likelihoods; Gumbel noise is added and the k largest keys are kept, which draws k
documents without replacement in proportion to their importance (``scale`` is the temperature; small
values keep the draw close to the order of the weights). k is the number of documents above the
weight that best splits labelled rows which the target model has not seen. The k-th key is found by narrowing counts, never by sorting all rows in one task.

Bounds: at most about ``max_labelled`` labelled rows are used, so their ids can be broadcast; the
models have ``BINS`` bins each. All else covers every document.

Cases: null and empty texts weigh 0 like a text without known tokens, against a threshold found on
labelled rows; ids that are null or repeat are drawn row by row by the hash of id and text; without
any labelled rows of either class, every document is kept.
Other columns stay as they are, whatever their names, but for ``log_weight`` and ``sample_key``, which are
replaced. A text is weighed whole, in slices of 1 MB; a longer text is one slice.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from voxstars.llm.texts import LOWER, mixed, pieces, rows_of, slices, text_bytes, token_hashes
from voxstars.sources.staging import stage

BINS = 1 << 16
MAX_LABELLED = 500_000
RANGE = 1 << 16
SMOOTH = 1.0


def _grams(data, offsets):
    """(bin, row) of every token and every pair of neighbouring tokens of one text."""
    starts, ends = pieces(data, offsets)
    hashes, rows = token_hashes(data, starts, ends), rows_of(offsets, starts)
    pair = rows[1:] == rows[:-1]
    both = mixed(hashes[:-1] * np.uint64(3) + hashes[1:])
    both[hashes[1:] == hashes[:-1]] = np.uint64(0)  # a token that repeats the one before it, whichever it is
    both = both[pair]
    bins = (np.r_[hashes, both] & np.uint64(BINS - 1)).astype(np.int64)
    return bins, np.r_[rows, rows[1:][pair]]


def _counted(batches):
    raw, target = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
    for batch in batches:
        data, offsets = text_bytes(batch.column(0))
        good = batch.column(1).to_numpy(zero_copy_only=False)
        for a, part, at in slices(data, offsets):
            bins, rows = _grams(LOWER[part], at)
            raw += np.bincount(bins, minlength=BINS)
            target += np.bincount(bins[good[a:][rows]], minlength=BINS)
    seen = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays(
        [pa.array(seen), pa.array(raw[seen]), pa.array(target[seen])], names=["bin", "raw", "target"]
    )


def labelled(labels, label, max_labelled=MAX_LABELLED):
    """One row per labelled document, all of them or a hashed sample of about ``max_labelled``."""
    rows = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label"))
        .filter("_id IS NOT NULL AND _label IN (0, 1)")
        .groupBy("_id")
        .agg(F.max("_label").alias("_label"))
    )
    n = rows.count()
    if n > max_labelled:
        part = int(1_000_000 * 0.97 * max_labelled / n)
        rows = rows.filter(F.pmod(F.xxhash64("_id", F.lit("labelled")), F.lit(1_000_000)) < part).limit(max_labelled)
    return rows


def log_ratios(docs, marked):
    """Log ratio of the two models in every bin; ``marked`` tells the target documents."""
    counts = (
        docs.select("text", F.coalesce(marked, F.lit(False)).alias("good"))
        .mapInArrow(_counted, "bin long, raw long, target long")
        .groupBy("bin")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
        .toPandas()
    )
    raw, target = np.full(BINS, SMOOTH), np.full(BINS, SMOOTH)
    raw[counts["bin"]] += counts["raw"]
    target[counts["bin"]] += counts["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weight_column(ratios):
    """A column function from texts to their log weight."""
    table = ratios.astype(np.float64)

    @F.arrow_udf("double")
    def weigh(texts: pa.Array) -> pa.Array:
        data, offsets = text_bytes(texts)
        out = np.zeros(len(texts))
        for a, part, at in slices(data, offsets):
            bins, rows = _grams(LOWER[part], at)
            out[a : a + len(at) - 1] = np.bincount(rows, weights=table[bins], minlength=len(at) - 1)
        return pa.array(out)

    return weigh


def best_split(rows, care=4.0):
    """The weight that best tells the two labels apart; a share of good rows lost counts ``care`` times.

    Exact whatever the range of the weights: running counts over the ordered distinct weights, taken
    in ranges of about ``RANGE`` of them, each from the totals of the ranges below.
    """
    counts = stage(rows.groupBy("weight").agg(F.sum("_label").alias("good"), F.sum(1 - F.col("_label")).alias("bad")))
    n, low, good, bad = counts.agg(F.count(F.lit(1)), F.min("weight"), F.sum("good"), F.sum("bad")).first()
    if n < 2 or not good or not bad:
        return None
    ranges = counts.repartitionByRange(1 + n // RANGE, "weight").withColumn("range", F.spark_partition_id())
    ranges = stage(ranges)
    sums = ranges.groupBy("range").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toPandas().sort_values("range")
    sums[["good", "bad"]] = sums[["good", "bad"]].cumsum() - sums[["good", "bad"]]
    below = rows.sparkSession.createDataFrame(
        [tuple(map(int, r)) for r in sums[["range", "good", "bad"]].to_numpy()], "range int, good_below long, bad_below long"
    )
    upto = Window.partitionBy("range").orderBy("weight")
    # Share of bad rows up to each weight, less that of good rows, both times good * bad.
    gain = (F.col("bad_below") + F.sum("bad").over(upto)) * F.lit(float(good)) - (
        F.col("good_below") + F.sum("good").over(upto)
    ) * F.lit(care * bad)
    best = ranges.join(F.broadcast(below), "range").select("weight", gain.alias("gain")).orderBy(F.desc("gain"), "weight").first()
    if best["gain"] <= 0:
        return low
    # The middle between the best weight and the next one above it.
    above = ranges.filter(F.col("weight") > best["weight"]).agg(F.min("weight")).first()[0]
    above = float(np.nextafter(best["weight"], np.inf)) if above is None else above
    middle = best["weight"] + (above - best["weight"]) / 2
    return middle if middle > best["weight"] else above


def kth_largest(rows, key, k):
    """The k-th largest value of a column: counts in 4096 cells, again inside the cell that holds it."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    if low is None:
        return None
    for _ in range(8):
        if low == high:
            break
        width = (high - low) / 4096
        inside = rows.filter((F.col(key) >= low) & (F.col(key) <= high))
        cell = F.least(F.lit(4095), F.floor((F.col(key) - low) / width)).alias("cell")
        counts = inside.groupBy(cell).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"))
        above = rows.filter(F.col(key) > high).count()
        for row in sorted(counts.collect(), key=lambda r: -r["cell"]):
            if above + row["n"] >= k:
                low, high = row["lo"], row["hi"]
                break
            above += row["n"]
    return low


def resample(docs, labels, label="quality", scale=0.1, seed=11, max_labelled=MAX_LABELLED):
    """The rows of ``docs`` that are drawn, with ``log_weight`` and ``sample_key`` added.

    Half of the labelled rows (by a hash of the id) give the target model, the others the split.
    """
    given = labelled(labels, label, max_labelled)
    half = F.pmod(F.xxhash64("_id", F.lit("fold")), F.lit(2))
    target = F.broadcast(given.filter((half == 0) & (F.col("_label") == 1)).select("_id", F.lit(True).alias("_good")))
    texts = docs.select("doc_id", "text")
    ratios = log_ratios(texts.join(target, texts["doc_id"] == target["_id"], "left"), F.col("_good"))
    weigh = weight_column(ratios)
    uniform = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    gumbel = -F.log(-F.log(uniform)) * F.lit(scale)
    scored = docs.withColumn("log_weight", weigh("text")).withColumn("sample_key", F.col("log_weight") + gumbel)
    keys = stage(scored.select("doc_id", "log_weight", "sample_key"))
    check = F.broadcast(given.filter(half == 1))
    split = best_split(keys.join(check, keys["doc_id"] == check["_id"]).select(F.col("log_weight").alias("weight"), "_label"))
    if split is None:
        return scored
    k = keys.filter(F.col("log_weight") >= split).count()
    least = kth_largest(keys, "sample_key", k) if k else None
    return scored.filter(F.col("sample_key") >= F.lit(least)) if k else scored.limit(0)
