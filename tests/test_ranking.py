import random

import pytest

from postmill.operators.ranking import most_frequent, ranked
from postmill.sources.staging import run_folder, settle, shared_folder


@pytest.mark.parametrize("limit", [0, 1, 7, 30, 31, 200])
def test_the_most_frequent_with_ties_at_the_cut(spark, limit):
    rng = random.Random(limit)
    rows = [(f"k{i:03d}", rng.randrange(6)) for i in range(100)]
    table = settle(spark.createDataFrame(rows, "gram string, cf bigint"), "grams")
    wanted = sorted(rows, key=lambda row: (-row[1], row[0]))[:limit]
    assert sorted(tuple(row) for row in most_frequent(table, "cf", "gram", limit).collect()) == sorted(wanted)


def test_ranks_over_partitions(spark):
    frame = spark.createDataFrame([(i * 7 % 100,) for i in range(100)], "x bigint")
    assert all(row["rank"] == row["x"] + 1 for row in ranked(frame, frame["x"].asc()).collect())
    assert ranked(frame.limit(0), frame["x"].asc()).collect() == []


def test_a_run_removes_what_it_has_settled(spark):
    with run_folder(spark) as path:
        inside = settle(spark.range(3), "inside")
        assert inside.count() == 3 and path.startswith(shared_folder(spark))
        assert path in inside.inputFiles()[0]
    with pytest.raises(Exception, match="(?i)exist|not found"):
        spark.read.parquet(path).count()
