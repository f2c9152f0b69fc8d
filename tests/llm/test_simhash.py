import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from helpers import make_docs

from voxstars.llm import graph, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text, size=3):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = WORD.findall(text)
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for i in range(64):
            counts[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * counts[i] > len(shingles))


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_documents_against_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("alpha Beta gamma délta epsilon zeta".split()) for _ in range(60)) for _ in range(8)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(100):
        words = rng.choice(base).split()
        words[rng.randrange(len(words))] = rng.choice(["omega", "Sigma", "été"])
        rows.append((20 + i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "one"), (204, "one two"), (205, "ONE"), (206, "x" * 100_000), (207, "word " * 20_000)]
    rows += [(None, "null id"), (300, "null id"), rows[5], rows[5]]
    got = simhash.near_duplicates(make_docs(spark, rows)).collect()
    marks = [fingerprint(t) for _, t in rows]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    links = [(a, b) for a, b in itertools.combinations(set(marks), 2) if bin(a ^ b).count("1") <= 2]
    root = roots(set(marks), links)
    least = {}
    for (i, _), m in zip(rows, marks):
        if i is not None:
            least[root[m]] = min(i, least.get(root[m], i))
    want = sorted(((i, signed(m), least.get(root[m])) for (i, _), m in zip(rows, marks)), key=str)
    assert sorted(((r["doc_id"], r["fp"], r["component_id"]) for r in got), key=str) == want


def test_links_are_exact_when_crowded(spark):
    rng = random.Random(5)
    fps = {0, -1, 1 << 62, -(1 << 63)}
    for centre in [rng.getrandbits(64) for _ in range(4)]:
        for _ in range(120):
            x = centre
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x - (1 << 64) if x >> 63 else x)
    table = spark.createDataFrame([(x,) for x in fps], "fp long")
    mask = (1 << 64) - 1
    want = roots(fps, [(a, b) for a, b in itertools.combinations(fps, 2) if bin((a ^ b) & mask).count("1") <= 2])
    for full in (1, 64, 10_000):
        found = simhash.links(table, 2, full).collect()
        assert all(bin((a ^ b) & mask).count("1") <= 2 for a, b in found)
        assert roots(fps, found) == want


def test_pairs_agree_in_some_key():
    """Two fingerprints at most two bits apart share all coordinates of some choice of groups."""
    for a, b in [(0, 1), (0, 63), (1, 2), (31, 32)]:
        pairs = {a // 2, b // 2}
        groups = {p % 4 for p in pairs}
        assert any(not groups & set(c) for c in itertools.combinations(range(4), 2))


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 200)] + [(500, 500 + i) for i in range(1, 60)] + [(7, 7)]
    edges += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)] + [(-5, 3), (2, 1)]
    got = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert {r["node"]: r["root"] for r in got} == roots(nodes, edges)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_table(spark):
    assert simhash.near_duplicates(make_docs(spark, [])).count() == 0


@pytest.mark.parametrize("text", ["a bb ccc " * 400, "one", "x" * 500 + " " + "y" * 700, " \t\n " * 300, "", " lead and trail ", "w " * 5 + "z" * 900 + " v u"])
def test_a_long_text_in_parts(text):
    data = np.frombuffer(text.encode(), np.uint8)
    want = simhash.fingerprints_of(data, np.array([0, len(data)]), 3)
    for part in (1, 7, 64, 1000):
        assert (simhash._long_fingerprint(data, 3, part) == want).all()
        assert (simhash._long_fingerprint(data, 1, part) == simhash.fingerprints_of(data, np.array([0, len(data)]), 1)).all()
