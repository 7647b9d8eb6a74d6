import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from postmill.functions import scores as sc
from postmill.operators import buckets
from postmill.operators import metrics as mt


def scored(spark, labels, values, **extra):
    names = ["label", "score_ai", *extra]
    return spark.createDataFrame(list(zip(labels, values, *extra.values(), strict=True)),
                                 ", ".join(["label int", "score_ai double", *[f"{n} string" for n in extra]])).select(*names)


def from_counts(spark, tn, fp, fn, tp):
    row = spark.createDataFrame([(tn, fp, fn, tp)], "tn bigint, fp bigint, fn bigint, tp bigint")
    metrics = sc.threshold_metrics(*[F.col(name) for name in ("tn", "fp", "fn", "tp")])
    return row.select(*[value.alias(name) for name, value in metrics.items()]).first()


def test_fixed_example(spark):
    m = mt.binary_metrics(scored(spark, [0, 0, 1, 1], [0.1, 0.7, 0.8, 0.2])).first()
    assert (m["accuracy"], m["recall_ai"], m["f1_ai"], m["auroc"]) == (0.5, 0.5, 0.5, 0.75)
    assert [m["tn"], m["fp"], m["fn"], m["tp"]] == [1, 1, 1, 1]


def test_one_class_slice_still_averages_both_classes(spark):
    m = mt.binary_metrics(scored(spark, [1, 1, 1], [0.9, 0.8, 0.7])).first()
    assert (m["recall_ai"], m["f1_ai"], m["f1_human"], m["macro_f1"], m["weighted_f1"]) == (1, 1, 0, 0.5, 1)
    assert m["macro_precision"] == m["macro_recall"] == 0.5
    assert m["auroc"] is None and m["average_precision"] is None and m["support_human"] == 0
    assert m["balanced_accuracy"] == 1
    assert mt.roc_points(scored(spark, [1, 1], [0.9, 0.8])).count() == 0
    assert mt.pr_points(scored(spark, [1, 1], [0.9, 0.8])).count() == 0


def test_published_confusion_matrices(spark):
    m = from_counts(spark, 7655, 92, 113, 973)
    assert m["accuracy"] == pytest.approx(0.976791577040643, abs=1e-12)
    assert m["balanced_accuracy"] == pytest.approx(0.9420364349438659, abs=1e-12)
    assert m["macro_f1"] == pytest.approx(0.945741235405577, abs=1e-12)
    assert m["weighted_f1"] == pytest.approx(0.9766939929079976, abs=1e-12)
    assert m["weighted_precision"] == pytest.approx(0.9766207856368201, abs=1e-12)
    other = from_counts(spark, 7625, 122, 30, 1056)
    assert (round(other["accuracy"], 4), round(other["macro_f1"], 4)) == (0.9828, 0.9615)


def test_published_majority_row(spark):
    rows = spark.range(8833).select(F.when(F.col("id") < 1086, 1).otherwise(0).alias("label"))
    m = mt.majority_baseline(rows).first()
    assert (round(m["accuracy"], 4), round(m["macro_f1"], 4), m["auroc"], round(m["average_precision"], 4)) == (0.8771, 0.4672, 0.5, 0.1229)


def wilson(spark, k, n):
    row = spark.createDataFrame([(k, n)], "k bigint, n bigint")
    return tuple(row.select(*sc.wilson_bounds(F.col("k"), F.col("n"))).first())


def test_wilson(spark):
    assert wilson(spark, 10, 100) == pytest.approx((0.05523, 0.17437), abs=1e-4)
    low, high = wilson(spark, 105, 105)
    assert 0.96 < low < 1 and high == pytest.approx(1)
    assert wilson(spark, 0, 0) == (0, 0)
    assert wilson(spark, 973, 1086) == pytest.approx((0.8764, 0.9127), abs=1e-4)
    assert wilson(spark, 1056, 1086) == pytest.approx((0.9608, 0.9806), abs=1e-4)


def brute_ranks(labels, values):
    pos = [v for y, v in zip(labels, values) if y]
    neg = [v for y, v in zip(labels, values) if not y]
    auroc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    ap, seen = 0.0, 0.0
    for cut in sorted(set(values), reverse=True):
        tp = sum(v >= cut for v in pos)
        ap += (tp / len(pos) - seen) * tp / (tp + sum(v >= cut for v in neg))
        seen = tp / len(pos)
    return auroc, ap


@pytest.mark.parametrize("ranges", [1, 4, 64])
def test_rank_metrics_with_ties_against_brute_force(spark, ranges, monkeypatch):
    rng = random.Random(ranges)
    labels = [rng.random() < 0.3 for _ in range(400)]
    # A third of all rows shares one score.
    values = [0.5 if rng.random() < 0.33 else rng.randrange(60) / 59 for _ in labels]
    df = scored(spark, [int(y) for y in labels], values)
    table = mt.score_table(df.withColumn("g", F.lit("a")), ["g"])
    monkeypatch.setattr(mt, "RANGE_ROWS", max(1, 64 // ranges))
    steps = mt.score_steps(table, ["g"], max(1, 64 // ranges))
    assert steps.count() == len(set(values))
    got = mt.rank_metrics(df).first()
    assert (got["auroc"], got["average_precision"]) == pytest.approx(brute_ranks(labels, values))
    top = steps.orderBy("score_ai").first()
    assert top["ai_above"] == sum(labels) and top["human_above"] == len(labels) - sum(labels)


def test_subgroups(spark):
    df = scored(spark, [0, 1, 0, 1, 1], [0.1, 0.9, 0.1, 0.2, 0.9], domain=["美食", "美食", "学习", "学习", None])
    table = {row["domain"]: row for row in mt.subgroup_metrics(df, "domain").collect()}
    assert table["美食"]["recall_ai"] == 1 and table["学习"]["recall_ai"] == 0 and table["<missing>"]["rows"] == 1
    assert mt.subgroup_metrics(df, "domain", min_rows=2).count() == 2
    assert mt.subgroup_metrics(df.drop("domain"), "domain").isEmpty()
    every = mt.all_subgroups(df)
    assert every.where("dimension = 'domain'").count() == 3


def test_log_loss_is_null_without_scores(spark):
    assert mt.binary_metrics(scored(spark, [0, 1, 1], [0.2, None, 0.4])).first()["log_loss"] is None


def test_length_chart_puts_unknown_buckets_last(spark):
    rows = spark.createDataFrame([("nan", 0.1), ("long", 0.2), ("short", 0.3), ("medium", 0.4)], "length_bucket string, recall_ai double")
    assert [row["length_bucket"] for row in mt.length_chart(rows).collect()] == ["short", "medium", "long", "nan"]


def pandas_buckets(sizes):
    series = pd.Series(sizes, dtype=float)
    names = ["short", "medium", "long"]
    try:
        return pd.qcut(series, q=3, labels=names, duplicates="drop").astype(str).tolist()
    except ValueError:
        return pd.cut(series, bins=3, labels=names, include_lowest=True).astype(str).tolist()


def test_length_buckets_agree_with_pandas(spark):
    rng = np.random.default_rng(3)
    cases = [[5, 5, 5], [1, 1, 1, 9], [1, 2, 3, 4], [7], [0, 0], list(range(1, 11)), [3, None, 8, 12]]
    cases += [rng.integers(1, 40, size=int(n)).tolist() for n in (4, 7, 10, 13, 28, 31)]
    for sizes in cases:
        df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "i int, text_len_chars int")
        got = [row["length_bucket"] for row in buckets.add_length_buckets(df).orderBy("i").collect()]
        assert got == pandas_buckets(sizes), sizes


def test_rows_without_a_score_are_not_lost(spark):
    df = scored(spark, [0, 1, 1, 1, 0], [0.1, 0.9, float("nan"), None, 0.4])
    got = mt.rank_metrics(df).first()
    assert got["auroc"] is None and got["average_precision"] is None
    assert mt.roc_points(df).isEmpty() and mt.pr_points(df).isEmpty()
    record = mt.binary_metrics(df, threshold=0.5).first()
    assert (record["rows"], record["tp"], record["fn"], record["tn"], record["log_loss"]) == (5, 1, 2, 2, None)
