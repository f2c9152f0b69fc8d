"""The search behind the literal pieces against the pattern alone."""

import pytest
from pyspark.sql import functions as F

from voxstars import schema as S
from voxstars.functions import pieces as B
from voxstars.operators import search as Q

TEXTS = [
    "worthless", "WORTHLEſS", "worth less", "xx red wid-et", "RED WİDGET", "red wıdget", "\u212aelvin", "KELVIN", "ÉMENTAIRE", "élément", "ement",
    "straße", "STRASSE", "Ångström", "ångström", "a the the b", "THE THE", "ab", "", None, "don't", "wor\nthless", "worth" * 50, "less", "red", "wid",
]
QUERIES = [
    "worthless", "worthless|red wid.et", "ÉMENT", "ément", "kelvin", "KELVIN", "widget|kelvin", "wor.*less", "wort?hless", "ab|worthless", "straße", "STRASSE", "ångström",
    "^worth", "less$", "red (wid|gad)get", r"\bred\b", "wid+get", "a?|kelvin", "the the", " the the", "éééééément", "İ", ".", "s+trasse", "worth+less",
]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)]
    return spark.createDataFrame(rows, f"{S.ID} long, {S.COMBINED} string").repartition(3).cache()


@pytest.mark.parametrize("literal", [False, True])
def test_equals_the_pattern_alone(texts, literal):
    for query in QUERIES:
        plain = F.contains(F.lower(S.COMBINED), F.lower(F.lit(query))) if literal else F.col(S.COMBINED).rlike(f"(?iU){query}")
        want = sorted(r[0] for r in texts.filter(plain).select(S.ID).collect())
        assert sorted(r[0] for r in Q.keyword_matches(texts, query, literal).select(S.ID).collect()) == want, query


def test_letters_have_no_other_forms(spark):
    """Every code point against the letters that the bytes are searched for."""
    letters = "abcdefghijklmnopqrstuvwxyz" + B.TWO_FORMS
    points = spark.range(0x80, 0x110000).filter("id NOT BETWEEN 55296 AND 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    alike = points.filter(F.col("c").rlike("(?iU)^(?:" + "|".join(letters) + ")$")).collect()
    assert {r[0] for r in alike} == set(B.ALIKE) | set(B.TWO_FORMS) | set(B.TWO_FORMS.upper())


def test_the_pattern_runs_behind_the_pieces(texts):
    plan = Q.keyword_matches(texts, "worthless|red wid.et")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan
    assert plan.index("RLIKE") < plan.index("ArrowEvalPython") and plan.count("RLIKE") == 1  # a plan is printed from its top
    assert B.wanted_bytes("worthless|red wid.et") == [b"worthless", b"red wid"]
    assert B.wanted_bytes("ÉMENT") == ["ément".encode(), "Ément".encode()]
    assert B.wanted_bytes("ab|worthless") is None and B.wanted_bytes("(a|b)cde") is None


def test_sliced_and_empty_columns():
    import pyarrow as pa

    column = pa.array(["worthless", None, "x WORTH", "", "orth"])
    assert B._found(column, [b"worth"]).tolist() == [True, False, True, False, False]
    assert B._found(column.slice(2), [b"worth"]).tolist() == [True, False, False]
    assert B._found(column.slice(5), [b"worth"]).tolist() == [] and B._found(pa.nulls(2, pa.string()), [b"a"]).tolist() == [False, False]
