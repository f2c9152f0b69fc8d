import numpy as np
from helpers import make_docs
from pyspark.sql import functions as F

from voxstars.llm import resampling


def corpus(spark, n=400):
    rng = np.random.default_rng(2)
    good, bad = [f"word{i}" for i in range(60)], [f"JUNK{i}!!" for i in range(60)]
    rows, labels = [], []
    for i in range(n):
        junk = i % 5 == 0
        rows.append((i, " ".join(rng.choice(bad if junk else good, rng.integers(5, 80)))))
        if i % 2:
            labels.append((i, int(not junk), 0))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, _label int")


def test_junk_goes_and_clean_documents_stay(spark):
    rows, labels = corpus(spark)
    rows += [(1000, None), (1001, ""), (None, "word1 word2 word3"), (1002, "word5 " * 50_000), (1003, "JUNK7!! " * 9), rows[1], rows[1]]
    docs = make_docs(spark, rows)
    kept = resampling.resample(docs, labels)
    ids = sorted((r["doc_id"] for r in kept.select("doc_id").collect()), key=str)
    want = [i for i, t in rows if t is None or "JUNK" not in t]
    assert sum(i not in want for i in ids) <= 0.08 * (len(rows) - len(want))
    assert sum(i in want for i in ids) >= 0.99 * len(want)
    assert {1000, 1001, None, 1} <= set(ids) and ids.count(1) == 3
    assert set(docs.columns) < set(kept.columns)
    again = sorted((r["doc_id"] for r in resampling.resample(docs, labels).select("doc_id").collect()), key=str)
    assert again == ids


def test_weights_equal_a_plain_count(spark):
    docs = make_docs(spark, [(1, "Aa bb aa bb"), (2, "cc aa"), (3, None)])
    ratios = resampling.log_ratios(docs, F.col("doc_id") == 1)
    got = {r[0]: r[1] for r in docs.select("doc_id", resampling.weight_column(ratios)("text")).collect()}
    raw = {"aa": 3, "bb": 2, "cc": 1, "aa bb": 2, "bb aa": 1, "cc aa": 1}
    target = {"aa": 2, "bb": 2, "aa bb": 2, "bb aa": 1}
    t, r = sum(target.values()) + resampling.BINS, sum(raw.values()) + resampling.BINS
    value = lambda g: np.log((target.get(g, 0) + 1) / t) - np.log((raw.get(g, 0) + 1) / r)
    assert abs(got[1] - (2 * value("aa") + 2 * value("bb") + 2 * value("aa bb") + value("bb aa"))) < 1e-9
    assert abs(got[2] - (value("aa") + value("cc") + value("cc aa"))) < 1e-9
    assert got[3] == 0


def test_kth_largest(spark):
    rng = np.random.default_rng(0)
    values = np.r_[rng.normal(size=2000), np.full(500, 0.25), 1e9, -1e9].tolist()
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 500, 1000, len(values)):
        assert resampling.kth_largest(df, "x", k) == ordered[k - 1]


def plain_split(rows, care=4.0):
    """The best of all thresholds at a distinct weight, the lowest of equal ones, and the weight below it."""
    good, bad = [w for w, y in rows if y], [w for w, y in rows if not y]
    tried = [(sum(w < t for w in bad) * len(good) - care * sum(w < t for w in good) * len(bad), -t) for t in {w for w, _ in rows}]
    best = max(tried)
    return -best[1], max((w for w, _ in rows if w < -best[1]), default=None)


def test_split_does_not_depend_on_the_range(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(float(w), 1) for w in rng.normal(20, 12, 300)] + [(float(w), 0) for w in rng.normal(-30, 14, 300)]
    for far in ([], [(-3e6, 0)], [(-3e12, 0), (9e11, 1)]):
        above, below = plain_split(rows + far)
        df = spark.createDataFrame(rows + far, "weight double, _label int")
        for size in (1 << 16, 50):
            monkeypatch.setattr(resampling, "RANGE", size)
            assert below < resampling.best_split(df) <= above


def test_one_labelled_text_of_a_million_words(spark):
    rows, labels = corpus(spark)
    ordinary = [r[0] % 5 == 0 for r in rows]
    rng = np.random.default_rng(8)
    ids = spark.range(2000, 2100).filter(F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(2)) == 1)
    far = ids.first()[0]
    rows.append((far, " ".join(rng.choice([f"JUNK{i}!!" for i in range(60)], 500_000))))  # a word and its signs are two tokens
    labels = labels.union(spark.createDataFrame([(far, 0, 0)], labels.schema))
    kept = {r["doc_id"] for r in resampling.resample(make_docs(spark, rows), labels).select("doc_id").collect()}
    bad = [r[0] for r, junk in zip(rows, ordinary) if junk]
    assert far not in kept and sum(i in kept for i in bad) <= 0.08 * len(bad)
    good = [r[0] for r, junk in zip(rows, ordinary) if not junk]
    assert sum(i in kept for i in good) >= 0.99 * len(good)


def test_without_labels_or_documents(spark):
    docs, none = make_docs(spark, [(1, "a"), (2, None)]), spark.createDataFrame([], "doc_id long, quality int")
    assert resampling.resample(docs, none).count() == 2
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 7), (2, 1), (2, 1)], "doc_id long, quality int")
    assert resampling.resample(docs, odd).count() == 2
    assert resampling.resample(make_docs(spark, []), none).count() == 0


def test_labelled_rows_are_bounded(spark):
    labels = spark.range(2000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    assert 0 < resampling.labelled(labels, "quality", 500).count() <= 500
    assert resampling.labelled(labels, "quality", 5000).count() == 2000
