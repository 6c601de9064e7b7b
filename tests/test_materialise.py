from types import SimpleNamespace

import pytest

from riskloom.plans import materialise


def session(master, named=None):
    context = SimpleNamespace(master=master, folder=None)
    context.getCheckpointDir = lambda: context.folder
    context.setCheckpointDir = lambda path: setattr(context, "folder", path)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: named))


def test_a_cluster_needs_a_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            materialise.shared_folder(session(master))
        assert materialise.shared_folder(session(master, "hdfs:///shared")) == "hdfs:///shared"
    assert materialise.shared_folder(session("local[4]"))


def test_spread_tables_follow_their_size(spark, monkeypatch):
    monkeypatch.setattr(materialise, "PART_ROWS", 50)
    table = materialise.stored(spark.range(1000), "spread-test", spread=True)
    assert len(table.inputFiles()) >= 20 and table.count() == 1000


def test_every_core_gets_as_many_parts():
    for rows in (0, 1, 250_000, 2_241_000, 13_446_000):
        for cores in (1, 8, 12):
            parts = materialise.even_parts(rows, cores)
            assert parts % cores == 0 and parts * materialise.PART_ROWS >= rows
            assert parts == cores or (parts - cores) * materialise.PART_ROWS < rows
