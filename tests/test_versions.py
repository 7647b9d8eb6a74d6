import statistics
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from postmill.operators import audit
from postmill.sources import jsonl, sinks, versions


def written(spark, place, value):
    spark.createDataFrame([(value,)], "value string").write.parquet(f"{place}/table")


def read(spark, path):
    return spark.read.parquet(f"{versions.current(spark, path)}/table").first()["value"]


def test_a_version_counts_once_it_is_whole(spark, tmp_path):
    path = str(tmp_path / "out")
    assert versions.published(spark, path) == [] and versions.current(spark, path, "old") == "old"
    with versions.new_version(spark, path) as place:
        written(spark, place, "one")
        assert versions.published(spark, path) == []
    with pytest.raises(KeyError), versions.new_version(spark, path) as place:
        written(spark, place, "broken")
        raise KeyError
    assert read(spark, path) == "one"
    # A driver that is lost leaves a version without its mark.
    (tmp_path / "out" / "v-000000009-lost" / "table").mkdir(parents=True)
    assert read(spark, path) == "one"
    for value in ("two", "three"):
        with versions.new_version(spark, path) as place:
            written(spark, place, value)
    assert read(spark, path) == "three" and len(versions.published(spark, path)) == versions.KEPT
    assert Path(versions.current(spark, path)).name.startswith("v-000000011")


def test_splits_are_replaced_together(spark, tmp_path):
    def save(text, **options):
        df = spark.createDataFrame([("a", text, 0, "train")], "id string, text string, label int, split string")
        manifest = df.groupBy("split").agg(F.count("*").alias("rows"))
        sinks.save_splits(df, manifest, {"text": text}, str(tmp_path), **options)

    save("first")
    with pytest.raises(FileExistsError):
        save("second")
    held = sinks.read_split(spark, str(tmp_path))
    save("second", force=True)
    assert sinks.read_split(spark, str(tmp_path), "train").first()["text"] == "second"
    assert held.first()["text"] == "first"  # a reader of the earlier version is not disturbed


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 7, 8, 9])
def test_first_n_over_files_and_blocks(spark, monkeypatch, n):
    monkeypatch.setattr(jsonl, "BLOCK_LINES", 3)
    rows = [(file, line, "malformed" if (line + len(file)) % 3 == 0 else None) for file in ("a", "bb") for line in range(1, 7)]
    parsed = spark.createDataFrame(rows, "source_file string, source_line bigint, _problem string")
    expected, good = [], 0
    for row in rows:
        if good == n:
            break
        expected.append(row)
        good += row[2] is None
    assert sorted(map(tuple, jsonl.first_n(parsed, n).collect())) == sorted(expected)


def test_length_stats_are_exact(spark):
    sizes = {"odd": [5, 1, 9000], "even": [10, 20, 1023, 1024], "apart": [1, 1, 5000, 7000], "hot": [7] * 50, None: [3, 4], "none": []}
    rows = [(name, size) for name, values in sizes.items() for size in [*values, None]]
    df = spark.createDataFrame(rows, "domain string, text_len_chars int")
    found = {row["domain"]: row for row in audit.length_stats(df, "domain").collect()}
    assert set(found) == set(sizes)
    for name, values in sizes.items():
        row = found[name]
        if values:
            assert (row["count"], row["median"], row["min"], row["max"]) == (len(values), statistics.median(values), min(values), max(values))
            assert row["mean"] == pytest.approx(statistics.mean(values))
        else:
            assert row["count"] == 0 and row["mean"] is None and row["median"] is None
    assert audit.length_stats(df.limit(0), "domain").collect() == []
