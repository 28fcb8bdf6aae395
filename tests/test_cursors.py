"""Refresh cursors: what is written but not committed doesn't count, and the next refresh takes it again."""

import pytest

from viaduct.streaming import cursors


def test_a_refresh_that_ends_before_its_commit(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    changes = lambda n: spark.createDataFrame([(s, i) for s in ("a", "b") for i in range(n)], "source_id string, sequence long")
    held = lambda: sorted(map(tuple, cursors.committed_rows(spark, root, changes(1).schema).collect()))
    assert cursors.load_cursors(spark, root).count() == 0
    first = cursors.refresh(changes(3), root, "t1").collect()
    assert {(r.source_id, r.number, r.mode, r.state.replication_sequence) for r in first} == {("a", 1, "full_seed", 2), ("b", 1, "full_seed", 2)}

    def fail(*a):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(cursors, "commit", fail)
        with pytest.raises(RuntimeError):
            cursors.refresh(changes(6), root, "t2")
    assert held() == [(s, i) for s in ("a", "b") for i in range(3)]
    again = cursors.refresh(changes(6), root, "t3").collect()
    assert {(r.source_id, r.number, r.mode, r.last_successful_refresh_at, r.state.replication_sequence) for r in again} == {("a", 2, "incremental", "t3", 5), ("b", 2, "incremental", "t3", 5)}
    assert held() == [(s, i) for s in ("a", "b") for i in range(6)]
    assert {r.number for r in cursors.refresh(changes(6), root, "t4").collect()} == {2} and held() == [(s, i) for s in ("a", "b") for i in range(6)]
