import math
from collections import defaultdict

import numpy as np
import pytest
from helpers import make_docs
from pyspark.sql import functions as F

from voxstars.llm import ppm


class Trie:
    """Plain PPM: a dictionary of contexts, walked byte by byte."""

    def __init__(self, texts, order):
        self.order, self.counts = order, defaultdict(lambda: defaultdict(int))
        for t in texts:
            for context, byte in self.steps(t):
                for d in range(order + 1):
                    self.counts[context[len(context) - d :]][byte] += 1

    def steps(self, text):
        padded = bytes([ppm.START]) * self.order + text + bytes([ppm.END])
        for i in range(self.order, len(padded)):
            yield padded[i - self.order : i], padded[i]

    def log_p(self, context, byte):
        p, excluded = 0.0, set()
        for d in range(self.order, -1, -1):
            here = {b: n for b, n in self.counts.get(context[len(context) - d :], {}).items() if b not in excluded}
            total = sum(here.values())
            if byte in here:
                return p + math.log10((here[byte] - 0.5) / total)
            if total:
                p += math.log10(0.5 * len(here) / total)
            excluded |= set(here)
        return p - math.log10(ppm.ALPHABET - len(excluded))

    def score(self, text):
        return sum(self.log_p(c, b) for c, b in self.steps(text))


def lower(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


ROWS = [(i, t) for i, t in enumerate(
    ["the cat sat on the mat", "The Dog sat", "", None, "été à la mer", "the the the", "unseen words zzz", "x" * 5000, " \n ", "the cat sat on the mat", "ça va"]
)] + [(None, "a row without id"), (1, "The Dog sat"), (50, "漢字 and more"), (51, "the cat")]


@pytest.mark.parametrize("order,most_alike", [(2, 10**6), (3, 10**6), (5, 10**6), (2, 1), (3, 1), (5, 1), (5, 6)])
def test_against_a_plain_trie(spark, order, most_alike):
    held = F.col("doc_id").isin(4, 6, 50)
    got = ppm.score(make_docs(spark, ROWS), F.coalesce(held, F.lit(False)), order=order, chunk_bytes=900, most_alike=most_alike).collect()
    out = {4, 6, 50}
    train = [lower(t) for i, t in ROWS if i not in out]
    trie = Trie(train, order)
    counts = defaultdict(int)
    for t in train:
        for w in [*t.split(), None]:
            counts[w] += 1
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in ROWS:
        words = [*lower(t).split(), None]
        base = sum(math.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        want.append((i, i in out, len(words), sum(w in counts for w in words), n, base, trie.score(lower(t))))
    key = lambda r: (str(r[0]), r[2], round(r[6], 6))
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got), key=key)
    want.sort(key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], atol=1e-9)


def test_probabilities_add_up_to_one():
    trie = Trie([b"abracadabra", b"abba"], 3)
    symbols = [b for b in range(0xF5) if b not in (0xC0, 0xC1)] + [ppm.END]
    assert len(symbols) == ppm.ALPHABET
    for context in (b"abr", b"zzz", b"\xff\xff\xff"):
        assert abs(sum(10 ** trie.log_p(context, s) for s in symbols) - 1) < 1e-9


def test_nothing_to_learn_from_and_empty(spark):
    got = ppm.score(make_docs(spark, [(1, "ab")]), F.lit(True)).first()
    assert got["train_tokens"] == 0 and abs(got["score"] + 3 * math.log10(ppm.ALPHABET)) < 1e-9
    assert ppm.score(make_docs(spark, []), F.lit(False)).count() == 0
