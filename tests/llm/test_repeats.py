import hashlib
import random

import numpy as np
import pytest
from helpers import make_docs

from voxstars.llm import repeats


def brute(rows, length):
    last = repeats.LAST
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(first.get(w, last), last if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < (last if i is None else i):
                gone[p : p + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((gone[1:] & ~gone[:-1]).sum()) + int(len(b) > 0 and gone[0])
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def sample(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [text(n) for n in (49, 50, 51, 120, 400)]
    rows = [(i, text(rng.randrange(200)) + rng.choice(shared) + text(rng.randrange(150)) + rng.choice(shared)) for i in range(120)]
    rows += [(200 + i, shared[4]) for i in range(30)] + [(300, None), (301, ""), (302, "a" * 3000), (303, "a" * 49), (304, "a" * 50)]
    rows += [(305, "ab" * 700 + shared[3]), (None, shared[3]), (None, text(90)), (306, "\x00" * 200), (307, "x" + "\x00" * 120)]
    rows += rows[:2] + [(5, shared[3] + "other text of the same id")]
    return rows


@pytest.mark.parametrize("seed, hot, block_bytes, batch_bytes", [(1, 4096, 1 << 23, 1 << 21), (2, 3, 4000, 500), (3, 4096, 4000, 3000), (4, 20, 9000, 1 << 20)])
def test_against_brute_force(spark, seed, hot, block_bytes, batch_bytes):
    rows = sample(seed)
    found = repeats.remove_repeats(make_docs(spark, rows), block_bytes=block_bytes, batch_bytes=batch_bytes, hot=hot)
    got = sorted(map(tuple, found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)
    assert got == brute(rows, 50)


def test_long_texts_over_several_steps(spark):
    rng = np.random.default_rng(0)
    long = bytes(rng.integers(97, 123, 3 << 20, dtype=np.uint8)).decode()
    rows = [(1, long), (2, "start " + long[: 1 << 20]), (3, long[-(1 << 20) :] + " end")]
    found = repeats.remove_repeats(make_docs(spark, rows)).select("doc_id", "n_removed", "n_spans").collect()
    assert sorted(map(tuple, found)) == [(1, 0, 0), (2, 1 << 20, 1), (3, 1 << 20, 1)]


def test_common_prefixes_are_right():
    rng = np.random.default_rng(4)
    text = rng.integers(1, 4, 300).astype(np.int16)
    text[[60, 140, 299]] = 0
    end = np.flatnonzero(text == 0)
    left = end[np.searchsorted(end, np.arange(300))] - np.arange(300)
    order = repeats.suffix_order(text, left, 20)
    new = repeats.unequal_neighbours(text[order - 1], text[order], 20)
    suffix = [tuple(text[i : i + 20][: left[i] + 1]) for i in order]
    assert suffix == sorted(suffix)
    for p in range(1, 300):
        if left[order[p]] >= 20 and left[order[p - 1]] >= 20:
            assert new[p] == (suffix[p] != suffix[p - 1])


def test_kept_text_and_empty_table(spark):
    passage = "é" * 60
    df = repeats.remove_repeats(make_docs(spark, [(1, passage), (2, "tête " + passage + " fin")]), carry=("doc_id", "text", "lang"))
    assert {r["doc_id"]: (r["text"], r["lang"]) for r in df.collect()} == {1: (passage, "en"), 2: ("tête  fin", "en")}
    assert repeats.remove_repeats(make_docs(spark, [])).count() == 0


def test_order_of_rows_does_not_matter(spark):
    """A block larger than one step, its rows in another order each time."""
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    shared = [text(300) for _ in range(20)]
    rows = [(i, text(700) + rng.choice(shared) + text(900) + rng.choice(shared)) for i in range(1500)]
    df = make_docs(spark, rows).repartition(13, "text")
    got = sorted(map(tuple, repeats.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)
    assert got == brute(rows, 50)
