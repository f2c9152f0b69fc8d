"""The stages on small documents, each against what it should have kept of its own input."""

import itertools
import random

import pytest
from helpers import make_docs
from pyspark.sql import functions as F
from test_repeats import brute as brute_repeats
from test_simhash import fingerprint, roots

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from voxstars.llm import decontamination, mixing
from voxstars.sources.staging import stage

STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def parts(spark, folder):
    """Documents after each stage."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for _, function in corpus_pipeline.STAGES:
        out.append(stage(function(spark, out[-1], folder)))
    return out


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_in_order(parts):
    assert list(STAGE) == [
        "quality classifier", "SimHash near-dedup", "suffix-array dedup", "benchmark decontamination", "mixing sources to target weights",
    ]
    assert all(p.columns == parts[0].columns for p in parts[:-1])
    assert parts[5].count() > 0


def test_quality_keeps_good_labels(spark, folder):
    """At sf0.01: the smallest scale has 11 bad labels, of which half cannot fix a split."""
    folder = folder.replace("sf0.001", "sf0.01")
    labels = by_id(spark.read.parquet(f"{folder}/labels.parquet"))
    kept = by_id(STAGE["quality classifier"](spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).select("doc_id"))
    good = [i for i, r in labels.items() if r["quality"] == 1]
    bad = [i for i, r in labels.items() if r["quality"] == 0]
    assert sum(i in kept for i in good) >= 0.95 * len(good)
    assert sum(i in kept for i in bad) <= 0.2 * len(bad)


def test_one_document_of_each_component(parts):
    before, after = by_id(parts[1]), by_id(parts[2])
    marks = {i: fingerprint(r["text"]) for i, r in before.items()}
    links = [(a, b) for a, b in itertools.combinations(before, 2) if bin(marks[a] ^ marks[b]).count("1") <= 2]
    assert set(after) == {i for i, root in roots(list(before), links).items() if i == root}


def test_repeats_are_cut(parts):
    before, after = by_id(parts[2]), by_id(parts[3])
    removed = {i: n for i, _, n, *_ in brute_repeats([(i, r["text"]) for i, r in before.items()], 50)}
    assert set(before) == set(after)
    for i, r in after.items():
        assert r["n_chars"] == len(r["text"])
        if not removed[i]:
            assert r["text"] == before[i]["text"]
        else:
            assert len(r["text"].encode()) <= len(before[i]["text"].encode()) - removed[i]


def test_no_benchmark_passage_is_left(spark, folder, parts):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    matcher = decontamination.Matcher(items)
    before, after = by_id(parts[3]), by_id(parts[4])
    assert set(after) == {i for i, r in before.items() if not matcher.find(r["text"].encode())}


def test_run_equals_its_stages(spark, folder, parts):
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(str, got)) == sorted(map(str, parts[5].collect()))


def test_stages_on_odd_rows(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(99)) for _ in range(40)), f"s{i % 3}") for i in range(30)]
    rows += [(None, None, None), (None, "no id", "s1"), (40, "", "s2"), (41, None, "s0"), rows[3], (50, rows[4][1], "s1")]
    for table in ("labels", "benchmark"):
        schema = "doc_id long, quality int, toxic int" if table == "labels" else "item_id long, text string"
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{table}.parquet")
    for given in (rows, []):
        docs = make_docs(spark, given)
        for _, function in corpus_pipeline.STAGES:
            out = stage(function(spark, docs, str(tmp_path)))
            assert set(out.columns) >= set(docs.columns)
            docs = out


def test_near_copies_go_by_row_where_ids_repeat(spark):
    rng = random.Random(3)
    one, two, three = (" ".join(f"word{rng.randrange(999)}" for _ in range(60)) for _ in range(3))
    rows = [(1, one), (5, one), (5, two), (5, None), (6, two), (7, three), (7, three), (None, one), (8, None)]
    kept = STAGE["SimHash near-dedup"](spark, make_docs(spark, rows), "")
    assert kept.columns == make_docs(spark, []).columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert got == sorted([(1, one), (5, two), (5, None), (7, three), (7, three), (None, one)], key=str)


def test_mixing_keeps_the_figures_of_rows_with_shared_ids(spark):
    text = lambda n: " ".join(f"w{i}" for i in range(n))
    rows = [(1, text(600), "a"), (1, text(150), "a"), (2, text(900), "b")]
    rows += [(None, text(40 + i), "b") for i in range(30)] + [(None, text(77), "a")] * 5 + [(None, "", "a"), (3, None, "b")]
    docs = make_docs(spark, rows).withColumn("_id", F.lit(5)).withColumn("mix_taken", F.lit("old")).withColumn("file", F.lit("f"))
    got = STAGE["mixing sources to target weights"](spark, docs, "")
    assert set(got.columns) == set(docs.columns) | {"mix_size", "mix_source_size", "mix_target", "mix_taken"}
    found = got.collect()
    assert all(r["mix_size"] == len(r["text"].split()) and 0 < r["mix_taken"] <= 3 * r["mix_size"] and r["_id"] == 5 for r in found)
    mixed = mixing.mix(docs).filter("taken > 0")
    assert len(found) <= len(rows) - 2
    for source in ("a", "b"):
        near = mixed.filter(F.col("source") == source).agg({"taken": "sum"}).first()[0]
        assert abs(sum(r["mix_taken"] for r in found if r["source"] == source) - near) <= 2 * 128


CLASHES = ("_id", "_row", "_good", "_label", "_own_fp", "_gone_id", "_gone_fp", "row", "file", "line", "number", "chunk", "weight")


def test_stages_with_clashing_names(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    named = docs.select("*", *[F.lit(7).alias(c) for c in CLASHES])
    for name, function in corpus_pipeline.STAGES:
        plain, out = function(spark, docs, folder), function(spark, named, folder)
        assert set(out.columns) >= set(named.columns), name
        assert out.filter(" AND ".join(f"{c} = 7" for c in CLASHES)).count() == plain.count(), name


def test_registered():
    names = [n for n in queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in queries()
    assert set(oracle_sql()) <= set(queries())
