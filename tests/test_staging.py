"""Shared tables and their removal."""

import os

from voxstars.sources import staging


def test_dropped_tables_are_gone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "shared_folder", lambda spark: str(tmp_path))
    monkeypatch.setattr(staging, "_made", {})
    kept = tmp_path / "other"
    kept.mkdir()
    tables = [staging.stage(spark.range(n)) for n in (3, 4)]
    assert [t.count() for t in tables] == [3, 4] and len(os.listdir(tmp_path)) == 3
    assert staging.drop_staged(spark) == 2
    assert os.listdir(tmp_path) == ["other"]
    assert staging.drop_staged(spark) == 0
