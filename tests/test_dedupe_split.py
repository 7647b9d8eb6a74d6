import math

import pytest
from pyspark.sql import functions as F

from postmill.operators import dedupe, leakage, sampling, split
from postmill.operators.dedupe import dedupe_report, deduplicate, label_conflicts

POSTS = "id string, text string, label int, domain string, model_family string, source_file string, source_line bigint"


def frame(spark, per_label=10, domains=2):
    rows = [
        (f"{label}_{i}", f"text {label} {i}", label, f"d{i % domains}", "gpt" if label else None, "f", i)
        for label in (0, 1)
        for i in range(per_label)
    ]
    return spark.createDataFrame(rows, POSTS)


def test_conflicts_leave_and_first_copy_stays(spark):
    extra = [("x", "text 0 0", 1, "d", None, "f", 50), ("y", "text 0 1", 0, "d", None, "a", 9), ("z", "text 1 2", 1, "d", None, "z", 0)]
    df = frame(spark, 3).unionByName(spark.createDataFrame(extra, POSTS))
    assert {row["id"] for row in label_conflicts(df).collect()} == {"0_0", "x"}
    assert {row["id"] for row in deduplicate(df).collect()} == {"y", "0_2", "1_0", "1_1", "1_2"}
    assert dedupe_report(df).first().asDict() == {
        "input_rows": 9, "conflict_text_values": 1, "conflict_rows_removed": 2,
        "within_label_duplicate_rows_removed": 2, "output_rows": 5}


def test_hot_text_is_folded(spark):
    df = spark.range(3000).select(
        F.concat(F.lit("i"), "id").alias("id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("text"),
        F.lit(0).alias("label"), F.lit("f").alias("source_file"), F.col("id").alias("source_line"))
    kept = deduplicate(df)
    assert kept.count() == 2001
    assert kept.where("text = 'hot'").first()["source_line"] == 0


@pytest.mark.parametrize("width", [3, 15, 18])
def test_every_copy_reaches_the_exact_path(spark, width, monkeypatch):
    """Also when the map is far too small for the keys, or spans several chunks."""
    monkeypatch.setattr(dedupe, "map_bits", lambda keys: width)
    rows = spark.range(4000).select(
        F.concat(F.lit("t"), (F.col("id") % 3000).cast("string")).alias("text"), F.lit(0).alias("label"),
        F.lit("f").alias("source_file"), F.col("id").alias("source_line"))
    unique, copies = dedupe.split_copies(rows)
    assert unique.count() + copies.count() == 4000
    assert {r["text"] for r in unique.collect()}.isdisjoint({f"t{i}" for i in range(1000)})
    kept = deduplicate(rows)
    assert kept.count() == 3000 and kept.agg(F.max("source_line")).first()[0] == 2999


def test_map_width_is_bounded():
    assert [dedupe.map_bits(n) for n in (0, 2000, 5000, 10**12)] == [15, 15, 17, 31]


def test_ratios_are_checked():
    with pytest.raises(ValueError, match="sum"):
        split.Ratios(0.5, 0.2, 0.2)
    with pytest.raises(ValueError, match="positive"):
        split.Ratios(1.0, 0.0, 0.0)


def test_splits_hold_both_labels_and_exact_sizes(spark):
    made, design = split.create_splits(frame(spark), seed=7)
    leakage.validate_splits(made)
    sizes = {row["split"]: row["count"] for row in made.groupBy("split").count().collect()}
    assert sizes == {"train": 14, "val": 3, "test": 3}
    assert design["stratify_by"] == "label+domain" and design["group_column"] is None
    assert leakage.near_duplicate_leakage(made).first()["rows_involved"] == 0


def test_published_split_sizes():
    rows = 58_882
    held = math.ceil((0.15 + 0.15) * rows)
    assert (rows - held, held - math.ceil(0.5 * held), math.ceil(0.5 * held)) == (41_217, 8_832, 8_833)


def test_split_quotas_follow_strata_and_do_not_depend_on_partitions(spark):
    df = frame(spark, 173, 4)
    one = {row["id"]: row["split"] for row in split.stratified_split(df, True, seed=3).collect()}
    other = {row["id"]: row["split"] for row in split.stratified_split(df.repartition(7), True, seed=3).collect()}
    assert one == other
    total = {name: sum(value == name for value in one.values()) for name in split.SPLITS}
    held = math.ceil(0.3 * 346)
    assert total == {"train": 346 - held, "val": held - math.ceil(held / 2), "test": math.ceil(held / 2)}


def test_tiny_second_strata_fall_back_to_label(spark):
    df = frame(spark, 8, 2)
    made = split.stratified_split(df, True, seed=1)
    assert {row["split"]: row["count"] for row in made.groupBy("split").count().collect()} == {"train": 11, "val": 2, "test": 3}


def test_group_split_keeps_groups_together(spark):
    df = frame(spark, 40).withColumn("seed_id", F.col("source_line").cast("string"))
    made, design = split.create_splits(df, seed=5)
    assert design["split_strategy"] == "group" and design["group_column"] == "seed_id"
    assert made.groupBy("seed_id").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert made.select("seed_id", "split").distinct().groupBy("split").count().where("split = 'train'").first()["count"] == 28


def test_group_column_looks_at_every_candidate(spark):
    df = spark.createDataFrame([("p1", "n1"), ("", "n1"), ("", "n2"), ("", "n2")], "post_id string, note_id string")
    assert split.detect_group_column(df)[0] == "note_id"
    unique = spark.createDataFrame([("n1",), ("n2",), ("n3",)], "note_id string")
    column, note = split.detect_group_column(unique)
    assert column is None and "0 repeats" in note


def test_leakage_checks(spark):
    rows = [("今天真的绝了", "train"), ("另一条", "train"), ("今天真的绝了！！😊", "val"), ("完全不同", "test")]
    df = spark.createDataFrame(rows, "text string, split string")
    found = leakage.near_duplicate_leakage(df).first()
    assert (found["train_val_shared_fingerprints"], found["train_test_shared_fingerprints"], found["rows_involved"]) == (1, 0, 2)
    both = [(f"t{i}", s, l) for i, (s, l) in enumerate((s, l) for s in split.SPLITS for l in (0, 1))]
    shared = spark.createDataFrame(both + [("t0", "test", 0)], "text string, split string, label int")
    with pytest.raises(ValueError, match="two splits"):
        leakage.validate_splits(shared)
    with pytest.raises(ValueError, match="only one label"):
        leakage.validate_splits(spark.createDataFrame(both[:-1], "text string, split string, label int"))
    with pytest.raises(ValueError, match="no rows"):
        leakage.validate_splits(spark.createDataFrame(both[:4], "text string, split string, label int"))


def test_stratified_sample_sizes(spark):
    df = frame(spark, 30).where("label = 0 or source_line < 5")
    sample = sampling.stratified_sample(df, 7, seed=1)
    assert {row["label"]: row["count"] for row in sample.groupBy("label").count().collect()} == {0: 6, 1: 1}
    assert sampling.stratified_sample(df, 35).count() == 35
    assert sorted(r["id"] for r in sample.collect()) == sorted(
        r["id"] for r in sampling.stratified_sample(df.repartition(5), 7, seed=1).collect())
    tiny = sampling.stratified_sample(frame(spark, 300).where("label = 0 or source_line < 1"), 1, seed=1)
    assert tiny.count() == 1
