import re
from collections import defaultdict

from helpers import make_docs
from pyspark.sql import functions as F

from voxstars.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water_filling(sizes, weights=(1, 2, 3), limit=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > limit * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = float(limit * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def documents():
    out = [(i, "w " * (i % 7 * 40 + 5), f"s{i % 5}") for i in range(300)]
    out += [(1000 + i, "common word", "hot") for i in range(400)]
    return out + [
        (2000, None, "s0"), (2001, "", "s1"), (2002, " \t\n", None), (2003, "a b c", None), (None, "no id here", None),
        (2004, "dup row", "tiny"), (2004, "dup row", "tiny"), (2005, "x y z", "s2"), (2006, "long " * 30_000, "s3"),
    ]


def test_mix_against_brute_force(spark):
    rows = documents()
    mixed = mixing.mix(make_docs(spark, rows), block_words=16, shard_slots=64)
    assert "Python" not in mixed._jdf.queryExecution().toString() and "Arrow" not in mixed._jdf.queryExecution().toString()
    got = mixed.collect()
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    want = water_filling(sizes)
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for source in sizes:
        assert abs(taken[source] - want[source]) <= 24, source  # half a block by rounding, and a last block that is not full
    again = mixing.mix(make_docs(spark, rows), block_words=16, shard_slots=64).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 1000):
        seen = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), 3, F.lit(1)).alias("x")).collect()
        assert sorted(r["x"] for r in seen) == list(range(n))


def test_block_texts_hold_what_is_taken(spark):
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(10 + i % 9)), f"s{i % 3}") for i in range(60)] + [(99, None, "s0")]
    docs = make_docs(spark, rows)
    want = {r["doc_id"]: r["taken"] for r in mixing.mix(docs, block_words=8, shard_slots=16).collect()}
    got = defaultdict(int)
    for r in mixing.block_texts(docs, block_words=8, shard_slots=16).collect():
        for word in r["text"].split():
            got[int(word[1 : word.index("w")])] += 1
    assert {k: v for k, v in want.items() if v} == dict(got)


def test_empty_and_wordless(spark):
    assert mixing.mix(make_docs(spark, [])).count() == 0
    got = mixing.mix(make_docs(spark, [(1, None), (2, " ")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 2
