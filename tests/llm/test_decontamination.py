import random

import pytest
from helpers import make_docs

from voxstars.llm import decontamination as d


def distance(pattern, text):
    """Smallest edit distance of the pattern to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def edited(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        at = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars[at] = "z"
        elif kind == 1:
            chars.insert(at, "z")
        else:
            del chars[at]
    return "".join(chars)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_are_those_within_the_budget(spark, seed):
    rng = random.Random(seed)
    items = [(i, words(rng, 12 + 5 * i)) for i in range(6)]
    rows = []
    for k in range(90):
        item = items[k % 6][1]
        budget = int(len(item) * d.ERROR_RATE)
        rows.append((k, words(rng, 20) + " " + edited(rng, item.upper() if k % 2 else item, rng.randrange(0, 2 * budget)) + "\n " + words(rng, 9)))
    bench = spark.createDataFrame([(*i, 1) for i in items] + [(90, None, 1), (91, "", 1), (items[0][0], items[0][1], 2)], "item_id long, text string, doc_id long")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in d.matches(make_docs(spark, rows), bench).collect()}
    want = {}
    for k, text in rows:
        for i, item in items:
            found = distance(item, d.normal(text.encode()))
            if found <= int(len(item) * d.ERROR_RATE):
                want[k, i] = found
    assert got == want


def test_myers_equals_plain_distance():
    rng = random.Random(9)
    for _ in range(60):
        pattern = "".join(rng.choice("ab c") for _ in range(rng.randrange(1, 90)))
        text = "".join(rng.choice("ab c") for _ in range(rng.randrange(0, 120)))
        bits = {}
        for i, c in enumerate(pattern):
            bits[c] = bits.get(c, 0) | 1 << i
        found = d.myers(bits, len(pattern), text, len(pattern))
        assert (found[0] if found else len(pattern)) == distance(pattern, text)


def test_clean_and_odd_rows(spark):
    item = "a passage of the benchmark that is long enough to matter here"
    bench = spark.createDataFrame([(1, item), (None, "ünïcode passage of another kind, quite long as well")], "item_id long, text string")
    rows = [(1, None), (2, ""), (3, "x " * 50_000 + item + " y" * 10), (4, item.upper().replace(" ", "\n ")), (None, item), (5, "clean text"),
            (6, "says ÜNÏCODE passage of another kind, quite long as well"), (7, "says ünïcode passage of another kind, quite long as well"), (5, "clean text")]
    kept = d.clean(make_docs(spark, rows), bench)
    assert kept.columns == make_docs(spark, []).columns
    assert sorted((r["doc_id"] for r in kept.collect())) == [1, 2, 5, 5]
    assert d.clean(make_docs(spark, rows), bench.limit(0)).count() == len(rows)
    assert d.matches(make_docs(spark, []), bench).count() == 0


def test_capitals_of_any_script(spark):
    items = [(1, "l'été dernier, où çà et là les élèves étaient fatigués, l'âne brun a mangé à côté du théâtre"),
             (2, "съешь же ещё этих мягких французских булок, да выпей чаю в тени старого дуба"),
             (3, "die große straße am fluß führt weit hinaus über die äcker und höfe")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, f"avant {t.upper()} après") for i, t in items] + [(i + 10, f"avant {t.title()}") for i, t in items]
    got = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in d.matches(make_docs(spark, rows), bench).collect())
    assert got == [(i + k, i, 0) for k in (0, 10) for i, _ in items]
    assert d.clean(make_docs(spark, [*rows, (30, "ДРУГОЙ ТЕКСТ")]), bench).collect()[0]["doc_id"] == 30


def test_an_edit_of_any_letter_counts_once(spark):
    rng = random.Random(6)
    item = " ".join("".join(rng.choice("абвгдежзиклмнопрст") for _ in range(6)) for _ in range(20))
    budget = int(len(item) * d.ERROR_RATE)
    rows = []
    for k, edits in enumerate([1, budget, budget + 1]):
        chars = list(item)
        for at in [i for i, c in enumerate(item) if c != " "][:: len(item) // (budget + 2)][:edits]:
            chars[at] = "漢"
        rows.append((k, "".join(chars)))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: (r["distance"], r["start"], r["end"]) for r in d.matches(make_docs(spark, rows), bench).collect()}
    assert got == {0: (1, 0, len(item)), 1: (budget, 0, len(item))}


def test_short_items_match_whole_words_only():
    matcher = d.Matcher([(1, "no"), (2, "a b"), (3, "né"), (4, "(x)")])
    found = lambda text: sorted((m[0], m[1], m[2]) for m in matcher.find(text.encode()))
    assert found("another notable north piano") == []
    assert found("No, no. no") == [(1, 0, 2), (1, 4, 6), (1, 8, 10)]
    assert found("a b ba b a bc") == [(2, 0, 3)]
    assert found("née né") == [(3, 4, 6)] and found("f(x)y (x)") == [(4, 1, 4), (4, 6, 9)]
