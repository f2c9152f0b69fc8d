"""Records of large CSV files read in splits, against Spark's own multi-line reader."""

import os
import random
import re

import pytest

from voxstars.plans import catalogue
from voxstars.schema import CSV_SCHEMA
from voxstars.sources.csv import read_reviews, read_split_reviews, split_records

HEADER = ",".join(f.name for f in CSV_SCHEMA)


def quoted(text):
    return '"' + text.replace('"', '""') + '"'


def write(path, rows, end="\n"):
    lines = [HEADER]
    for i, (summary, text) in enumerate(rows):
        lines.append(f'{i},P{i % 7},U{i % 5},{quoted("N " + str(i))},1,2,{i % 5 + 1},13490496{i % 90 + 10},{summary},{text}')
    path.write_bytes((end.join(lines) + end).encode())


def texts(seed, n):
    rng = random.Random(seed)
    pieces = ["plain", 'a "word"', "two\nlines", "a, comma", "", '"', "\n\n", "é ü", 'end"\n"begin', "NA", "x" * 300, "\n" * 40]
    return [(quoted(rng.choice(pieces) + rng.choice(pieces)), quoted("".join(rng.choice(pieces) for _ in range(rng.randrange(6))))) for _ in range(n)]


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equals_the_whole_file_reader(small_splits, tmp_path, end):
    spark = small_splits
    write(tmp_path / "a.csv", texts(1, 150), end)
    write(tmp_path / "b.csv", texts(2, 40), end)
    write(tmp_path / "empty.csv", [], end)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    got, want = read_split_reviews(spark, str(tmp_path)), read_reviews(spark, str(tmp_path))
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert len(rows(got)) == 190 and rows(got) == rows(want)


def test_a_field_over_many_splits(small_splits, tmp_path):
    write(tmp_path / "a.csv", [(quoted("s"), quoted("line\n" * 2000)), (quoted("t"), quoted("after")), (quoted("u"), quoted("\n" * 3000))])
    got = read_split_reviews(small_splits, str(tmp_path))
    assert rows(got) == rows(read_reviews(small_splits, str(tmp_path)))
    assert split_records(small_splits, str(tmp_path)).count() == 3


def test_unquoted_fields_and_blank_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f"{HEADER}\n1,P,U,n,1,2,5,99,short,words here\n\n2,P,U,,0,0,4,98,NA,null")
    got = read_split_reviews(spark, str(tmp_path))
    assert rows(got) == rows(read_reviews(spark, str(tmp_path))) and got.count() == 2


def test_lines_are_put_together_where_they_are_read(small_splits, tmp_path):
    write(tmp_path / "a.csv", texts(3, 60))
    plan = split_records(small_splits, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Exchange hashpartitioning\((\w+)", plan) == ["file"]  # of the pieces at the borders
    assert plan.index("Exchange hashpartitioning") < plan.rindex("MapInArrow")


def test_the_disk_holds_one_part_of_the_reviews(spark, folder, monkeypatch):
    made, paths, there = catalogue._csv_of, [], []

    def note(*a):
        there.append([p for p in paths if os.path.exists(p)])
        paths.append(made(*a))
        return paths[-1]

    monkeypatch.setattr(catalogue, "_csv_of", note)
    monkeypatch.setattr(catalogue, "CSV_PART_BYTES", 6_000_000)
    got = catalogue.read_back_split(spark, folder)
    assert len(paths) > 2 and there == [[]] * len(paths) and not any(map(os.path.exists, paths))
    assert rows(got) == rows(catalogue.read_back(spark, folder))
