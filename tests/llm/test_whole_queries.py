"""Quality selection and toxicity from end to end against plain Python, without slices, hashed tables or Spark sums."""

import math
import re
from collections import Counter

import numpy as np
from helpers import make_docs
from pyspark.sql import functions as F
from test_resampling import plain_split
from test_toxicity import corpus, plain_segments

from voxstars.llm import resampling, toxicity
from voxstars.llm.queries import QUERIES
from voxstars.llm.texts import mixed, token_hashes

PIECE = re.compile(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff\x20\x09-\x0d]+")
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def hash_of(token):
    data = np.frombuffer(token, np.uint8)
    return int(token_hashes(data, np.array([0]), np.array([len(data)]))[0])


def plain_bins(text, known):
    """Bins of all tokens and pairs of neighbours of one text."""
    tokens = PIECE.findall((text or "").encode().lower())
    hashes = [known.setdefault(t, hash_of(t)) if t not in known else known[t] for t in tokens]
    out = [h % resampling.BINS for h in hashes]
    for a, b in zip(hashes, hashes[1:]):
        with np.errstate(over="ignore"):
            pair = 0 if a == b else int(mixed(np.array([a], np.uint64) * np.uint64(3) + np.array([b], np.uint64))[0])
        out.append(pair % resampling.BINS)
    return out


def test_quality_query_over_the_whole_table(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    half = {r[0]: r[1] for r in labels.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2))).collect()}
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    uniform = (F.pmod(F.xxhash64(F.lit(11), F.col("doc_id"), F.col("text")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    rows = docs.select("doc_id", "text", uniform.alias("u")).collect()
    known, raw, target, bins = {}, Counter(), Counter(), {}
    for r in rows:
        bins[r["doc_id"]] = plain_bins(r["text"], known)
        raw.update(bins[r["doc_id"]])
        if quality.get(r["doc_id"]) == 1 and half[r["doc_id"]] == 0:
            target.update(bins[r["doc_id"]])
    all_raw, all_target = sum(raw.values()) + resampling.BINS, sum(target.values()) + resampling.BINS
    ratio = lambda b: math.log((target[b] + 1) / all_target) - math.log((raw[b] + 1) / all_raw)
    value = {b: ratio(b) for b in raw}
    weight = {i: math.fsum(value[b] for b in found) for i, found in bins.items()}
    key = {r["doc_id"]: weight[r["doc_id"]] - math.log(-math.log(r["u"])) * 0.1 for r in rows}
    above, below = plain_split([(weight[i], y) for i, y in quality.items() if half[i] == 1 and y in (0, 1) and i in weight])
    k = sum(w >= below + (above - below) / 2 for w in weight.values())
    want = set(sorted(key, key=lambda i: -key[i])[:k])
    got = {r["doc_id"]: r for r in QUERIES["op6_resample_quality"](spark, folder).collect()}
    assert set(got) == want
    assert all(abs(r["log_weight"] - weight[i]) < 1e-6 and abs(r["sample_key"] - key[i]) < 1e-6 for i, r in got.items())
    # What the noise changes against the plain order of the weights.
    plain = set(sorted(weight, key=lambda i: -weight[i])[:k])
    print(f"kept {k}, of which {len(want - plain)} by the draw alone")


def parts_of(word):
    """The beginnings of a word, shortest first, and the word itself, as different keys."""
    return [("b", word[:n]) for n in toxicity.BEGINNINGS if len(word) >= n] + [("w", word)]


def plain_toxicity(rows, label, fold):
    """Scores of (id, text) rows; ``fold`` tells which labelled ids give log-odds (above 0) or the curve (0)."""
    texts = [(i, WORD.findall((t or "").encode().lower())) for i, t in rows]
    first = [(w, label[i]) for i, w in texts if i in label and fold[i] > 0]
    clean, toxic = Counter(), Counter()
    for words, y in first:
        (toxic if y else clean).update({p for w in words for p in parts_of(w)})
    n_clean, n_toxic = sum(clean.values()), sum(toxic.values())
    weight, odds = toxicity.PRIOR * (n_clean + n_toxic), {}
    base = sum(y for _, y in first) / len(first)
    for p in {*clean, *toxic}:
        a = toxicity.PRIOR * (clean[p] + toxic[p])
        score = math.log((toxic[p] + a) / (n_toxic + weight - toxic[p] - a)) - math.log((clean[p] + a) / (n_clean + weight - clean[p] - a))
        error = math.sqrt(1 / (toxic[p] + a) + 1 / (clean[p] + a))
        if abs(score / error) >= toxicity.SURE and (score < 0 or score > math.log(1 / base - 1)):
            odds[p] = score

    def scores(words):
        return [next((odds[p] for p in reversed(parts_of(w)) if p in odds), 0.0) - toxicity.DRIFT for w in words]

    grid = Counter(round(s / toxicity.STEP) for w, y in first if not y for s in scores(w))
    n = sum(grid.values())
    lam = toxicity.solve_lambda(np.array([g * toxicity.STEP for g in grid]), np.array([c / n for c in grid.values()]))
    held, best = {}, {}
    for i, words in texts:
        given = scores(words)
        segments = plain_segments(given) if any(s > 0 for s in given) else []
        gain = [0.0] * len(words)
        for a, b, s in segments:
            gain[a:b] = [s] * (b - a)
        place = {}  # the one place where each scoring word counts
        for at, (w, s) in enumerate(zip(words, given)):
            if s > 0 and (w not in place or gain[at] > gain[place[w]] + 1e-12):
                place[w] = at
        once = [s if s <= 0 or place[w] == at else -toxicity.DRIFT for at, (w, s) in enumerate(zip(words, given))]
        held.setdefault(i, []).append((len(words), [s for *_, s in plain_segments(once)] if segments else []))
        best[i] = max((s for *_, s in segments), default=0.0)
    centre = [best[i] * lam - math.log(v[0][0]) for i, v in held.items() if i in label and fold[i] == 0 and not label[i] and v[0][0]]
    log_k = sum(centre) / len(centre) - toxicity.EULER
    value = {i: math.log1p(sum(max(0.0, lam * s - log_k - math.log(n)) for s in found)) for i, [(n, found), *_] in held.items()}
    import pandas as pd

    cells = Counter((round(value[i] + 1e-12, 2), label[i]) for i in label if fold[i] == 0 and i in value)
    a, b = toxicity.fit_curve(pd.DataFrame([(x, y, n) for (x, y), n in cells.items()], columns=["value", "_label", "n"]))
    return {i: 1 / (1 + math.exp(-(a + b * v))) for i, v in value.items()}


def test_toxicity_from_end_to_end(spark):
    rows, labels = corpus(spark, 500)
    rows += [(2000, None), (2001, "w001x"), (2002, "MORON scummy w003x " * 3 + "w004x " * 50 + "scumbag moron"), (2003, "?? !!")]
    label = dict(labels)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    fold = {r[0]: r[1] for r in known.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(4))).collect()}
    want = plain_toxicity(rows, label, fold)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(make_docs(spark, rows), known).collect()}
    assert set(got) == set(want)
    assert max(abs(got[i] - want[i]) for i in want) < 1e-3
    assert sum((got[i] >= 0.7) != (want[i] >= 0.7) for i in want) == 0
