"""Versioned points: add, remove, add again, compaction and what a crash leaves behind."""

import pytest

from lidarloom.sources import versions

SCHEMA = "drive_id string, scan_id int, point_id long, x double"


def at(spark, path, version=None):
    return sorted((r.point_id if r.point_id is not None else -1, r.x) for r in versions.read(spark, path, version).collect())


def test_versions(spark, tmp_path):
    path = str(tmp_path / "p")
    d = lambda *rows: spark.createDataFrame([("d", 1, i, x) for i, x in rows], SCHEMA)
    with pytest.raises(ValueError):
        versions.read(spark, path)
    assert versions.latest(spark, path) is None
    versions.add(d((1, 1.0), (2, 2.0), (2, 2.5), (None, 9.0)), path, 0)
    versions.remove(d((2, 0.0), (7, 0.0)), path, 1)
    versions.add(d((3, 3.0)), path, 1)
    versions.add(d((2, 20.0), (1, 10.0)), path, 2)
    versions.remove(d((1, 0.0)), path, 2)  # of one version additions count last
    assert at(spark, path, 0) == [(-1, 9.0), (1, 1.0), (2, 2.0), (2, 2.5)]
    assert at(spark, path, 1) == [(-1, 9.0), (1, 1.0), (3, 3.0)]
    now = [(-1, 9.0), (1, 10.0), (2, 20.0), (3, 3.0)]
    assert at(spark, path) == now and versions.latest(spark, path) == 2
    versions.compact(spark, path)
    versions.compact(spark, path)
    assert at(spark, path) == now and at(spark, path, 1) == [(-1, 9.0), (1, 1.0), (3, 3.0)]
    versions.remove(d((3, 0.0)), path, 3)
    assert at(spark, path) == [x for x in now if x[0] != 3] and at(spark, path, 2) == now
    assert versions.vacuum(spark, path) == 5 and versions.vacuum(spark, path) == 0
    assert at(spark, path, 2) == now and at(spark, path) == [x for x in now if x[0] != 3]
    versions.add(d((4, 4.0)), path, 4)
    (tmp_path / "p" / "version=4" / "op=add" / "_SUCCESS").unlink()
    assert at(spark, path) == [x for x in now if x[0] != 3]
    plan = versions.read(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
