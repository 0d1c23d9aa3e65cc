"""Appends by several writers: each key once, whoever is first."""

import threading

import pytest

from tallyloom.sources.sinks import Appends

SCHEMA = "k long, w string"


def frame(spark, keys, writer):
    return spark.createDataFrame([(k, writer) for k in keys], SCHEMA)


def test_one_writer(spark, tmp_path):
    table = Appends(spark, str(tmp_path / "t"))
    assert table.commits() == [] and table.rows(SCHEMA).count() == 0
    assert table.append(frame(spark, [1, 2, 2, None, None], "a"), ["k"]) == 1
    assert table.append(frame(spark, [2, 3, None], "b"), ["k"]) == 2
    assert table.append(frame(spark, [1, 2, 3, None], "c"), ["k"]) == 0 and table.append(frame(spark, [], "c"), ["k"]) == 0
    assert sorted((r.k or 0, r.w) for r in table.rows(SCHEMA).collect()) == [(0, "a"), (1, "a"), (2, "a"), (3, "b")]


def test_a_writer_between(spark, tmp_path, monkeypatch):
    """The second writer commits after the first has read the table and before it commits."""
    table, claim, between = Appends(spark, str(tmp_path / "t")), Appends._claim, [[2, 3], [4], []]
    table.append(frame(spark, [0], "z"), ["k"])

    def slow(self, number, folder):
        keys = between.pop(0) if between else []
        if keys:
            with monkeypatch.context() as plain:
                plain.setattr(Appends, "_claim", claim)
                Appends(spark, self.path).append(frame(spark, keys, "other"), ["k"])
        return claim(self, number, folder)

    monkeypatch.setattr(Appends, "_claim", slow)
    assert table.append(frame(spark, [0, 1, 2, 4, 5], "mine"), ["k"]) == 4
    assert sorted((r.k, r.w) for r in table.rows(SCHEMA).collect()) == [(0, "z"), (1, "mine"), (2, "other"), (3, "other"), (4, "other"), (5, "mine")]
    monkeypatch.setattr(Appends, "_claim", lambda *_: False)
    with pytest.raises(TimeoutError):
        table.append(frame(spark, [9], "late"), ["k"], tries=2)
    assert table.rows(SCHEMA).where("k = 9").count() == 0


def test_many_writers(spark, tmp_path):
    path, ready, faults = str(tmp_path / "t"), threading.Barrier(4), []

    def write(i):
        try:
            rows = frame(spark, range(10 * i, 10 * i + 25), str(i))
            ready.wait()
            Appends(spark, path).append(rows, ["k"])
        except Exception as fault:  # noqa: BLE001
            faults.append(fault)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not faults and sorted(r.k for r in Appends(spark, path).rows(SCHEMA).collect()) == list(range(55)) and len(Appends(spark, path).commits()) in (3, 4)  # one of the writers in the middle may come when all its keys are there
