"""Replaced tables: whole for every reader, before, during and after a failed replacement."""

import os

import pytest

from skyledger.operators import merge as M
from skyledger.session import scratch_path
from skyledger.sources import versions as V
from skyledger.sources.tables import replace_table


def rows(spark, n):
    return spark.range(n).selectExpr("id", "id % 3 AS part")


def test_a_reader_during_the_swap_keeps_its_version(spark):
    path = scratch_path(spark, "table")
    replace_table(rows(spark, 10), path, ["part"])
    held = V.read_current(spark, path)
    replace_table(rows(spark, 20), path, ["part"])
    assert held.count() == 10 and held.agg({"id": "sum"}).first()[0] == 45
    assert V.read_current(spark, path).count() == 20


def test_a_failure_in_the_swap_leaves_the_old_table(spark, monkeypatch):
    path = scratch_path(spark, "table")
    replace_table(rows(spark, 10), path)

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(V, "commit", broken)
        with pytest.raises(OSError):
            replace_table(rows(spark, 20), path)
    bad = rows(spark, 5).selectExpr("id", "raise_error('lost') AS x")
    with pytest.raises(Exception, match="lost"):
        replace_table(bad, path)
    assert V.read_current(spark, path).count() == 10
    assert len(os.listdir(f"{path}.versions")) == 1  # nothing is left of what failed


def test_two_writers_cannot_both_win(spark):
    path = scratch_path(spark, "table")
    replace_table(rows(spark, 10), path)
    with pytest.raises(ValueError, match="another job"):
        # another writer commits while this one is still checking
        V.replace_version(rows(spark, 20), path, allowed=lambda old, new: replace_table(rows(spark, 15), path) and None)
    assert V.read_current(spark, path).count() == 15


def test_guards_refuse_and_keep_a_backup(spark):
    path = scratch_path(spark, "table")
    M.guarded_overwrite(spark, rows(spark, 10), path)
    for n, message in ((0, "nothing to write"), (4, "would shrink")):
        with pytest.raises(ValueError, match=message):
            M.guarded_overwrite(spark, rows(spark, n), path)
    with pytest.raises(ValueError, match="protected"):
        M.guarded_overwrite(spark, rows(spark, 30), path, protected=True)
    backup = V.current(spark, path)
    M.guarded_overwrite(spark, rows(spark, 30), path, protected=True, unlock=True)
    assert V.read_current(spark, path).count() == 30 and spark.read.parquet(backup).count() == 10
    M.guarded_overwrite(spark, rows(spark, 40), path)
    assert not os.path.exists(backup) and V.version_numbers(spark, path) == [2, 3]


def test_plain_tables_and_missing_ones(spark):
    path = scratch_path(spark, "table")
    assert V.current(spark, path) is None
    with pytest.raises(FileNotFoundError):
        V.read_current(spark, path)
    rows(spark, 7).write.parquet(path)
    assert V.read_current(spark, path).count() == 7
    replace_table(rows(spark, 8), path)
    assert V.read_current(spark, path).count() == 8
