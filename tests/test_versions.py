"""Versions of a stored table: commits, crashes, repeated batches, pruning."""

import pytest
from pyspark.sql import functions as F

from strikeline.session import shared_dir
from strikeline.sources import files
from strikeline.sources.versions import VersionedTable


@pytest.fixture
def table(spark):
    frame = spark.createDataFrame([], "id string, day int, value int")
    return VersionedTable(spark, shared_dir(spark), frame.schema, "id", F.col("day"))


def rows(spark, *values):
    return spark.createDataFrame(list(values), "id string, day int, value int")


def read(table, number=None):
    return sorted(tuple(r) for r in table.read(number).collect())


def test_commits_and_earlier_versions(spark, table):
    assert read(table) == [] and table.numbers() == []
    table.commit(rows(spark, ("a", 1, 1), ("b", 1, 1), ("c", 2, 1)))
    table.commit(rows(spark, ("b", 1, 2), ("d", 3, 2)))
    assert read(table) == [("a", 1, 1), ("b", 1, 2), ("c", 2, 1), ("d", 3, 2)]
    assert read(table, 1) == [("a", 1, 1), ("b", 1, 1), ("c", 2, 1)]
    # the untouched part is the same folder in both
    one, two = table.version(1), table.version(2)
    assert one.folders["2"] == two.folders["2"] and one.folders["1"] != two.folders["1"]


def test_merge_may_empty_a_part(spark, table):
    table.commit(rows(spark, ("a", 1, 1), ("b", 2, 1)))
    table.commit(
        rows(spark, ("a", 1, 0)), merge=lambda old, new, key: old.join(new.select(key), key, "left_anti")
    )
    assert read(table) == [("b", 2, 1)] and set(table.version().folders) == {"2"}


def test_a_commit_that_dies_leaves_the_version_before(spark, table, monkeypatch):
    table.commit(rows(spark, ("a", 1, 1)))

    def dies(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(files, "create_whole", dies)
        with pytest.raises(RuntimeError):
            table.commit(rows(spark, ("a", 1, 2)))
    assert read(table) == [("a", 1, 1)] and table.numbers() == [1]
    data = f"{table._root}/data"
    assert len(files.names(spark, data)) == 2
    table.prune(grace_seconds=3600)  # might belong to a commit under way
    assert len(files.names(spark, data)) == 2
    table.prune(grace_seconds=0)
    assert len(files.names(spark, data)) == 1
    table.commit(rows(spark, ("a", 1, 3)))
    assert read(table) == [("a", 1, 3)]


def test_two_commits_on_one_version(spark, table, monkeypatch):
    """The second one fails and changes nothing."""
    table.commit(rows(spark, ("a", 1, 1)))
    stale = table.version()
    table.commit(rows(spark, ("a", 1, 2)))
    monkeypatch.setattr(table, "version", lambda number=None: stale)
    with pytest.raises(FileExistsError):
        table.commit(rows(spark, ("a", 1, 3)))
    monkeypatch.undo()
    assert read(table) == [("a", 1, 2)]


def test_a_repeated_batch_is_not_committed_again(spark, table):
    table.commit(rows(spark, ("a", 1, 1)), batch=("s", 0))
    table.commit(rows(spark, ("a", 1, 2)), batch=("s", 1))
    table.commit(rows(spark, ("a", 1, 9)), batch=("s", 1))
    table.commit(rows(spark, ("a", 1, 9)), batch=("s", 0))
    table.commit(rows(spark, ("b", 1, 3)), batch=("other", 0))
    assert read(table) == [("a", 1, 2), ("b", 1, 3)] and table.numbers() == [1, 2, 3]


def test_pruned_versions_leave_a_constant_number_of_files(spark, table):
    counts = []
    for i in range(5):
        table.commit(rows(spark, ("a", 1, i), ("b", 2, 0) if i == 0 else ("c", 3, i)))
        table.prune(keep=2, grace_seconds=0)
        counts.append(len(files.names(spark, f"{table._root}/data")))
    assert table.numbers() == [4, 5] and counts[-1] == counts[-2] == 3
    assert read(table) == [("a", 1, 4), ("b", 2, 0), ("c", 3, 4)]
    assert read(table, 4) == [("a", 1, 3), ("b", 2, 0), ("c", 3, 3)]
