"""Binary metrics over labels 0 (human) and 1 (AI), overall and per subgroup.

Rows are folded once into confusion counts per group.  Rank metrics fold rows
into distinct scores and order those inside score ranges, so no task ever
sorts the whole table and ties are exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions import scores as sc
from postmill.functions.text import missing_label
from postmill.sources.staging import settle

# Distinct scores that one task orders.
RANGE_ROWS = 200_000

METRIC_COLUMNS = [
    "accuracy",
    "balanced_accuracy",
    "precision_human",
    "recall_human",
    "f1_human",
    "precision_ai",
    "recall_ai",
    "f1_ai",
    "macro_precision",
    "macro_recall",
    "macro_f1",
    "weighted_f1",
]
COUNT_COLUMNS = ["tn", "fp", "fn", "tp"]


def predictions(df: DataFrame, threshold: float = sc.DEFAULT_THRESHOLD) -> DataFrame:
    """``df`` with the hard label of its score."""
    return df.withColumn("pred_label", sc.hard_label(F.col("score_ai"), threshold))


def confusion(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Confusion counts per group; ``df`` has ``label`` and ``pred_label``."""
    counts = sc.confusion_counts(F.col("label"), F.col("pred_label"))
    return df.groupBy(*keys).agg(*[count.alias(name) for name, count in counts.items()])


def _no_score(score: Column) -> Column:
    return score.isNull() | F.isnan(score)


def _fold(df: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """Everything the non-rank metrics need, as sums that can be added up again."""
    score = F.col("score_ai")
    counts = sc.confusion_counts(F.col("label"), sc.hard_label(score, threshold))
    loss = sc.row_log_loss(F.col("label"), score)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        *[count.alias(name) for name, count in counts.items()],
        F.sum(loss).alias("loss"),
        F.count_if(_no_score(score)).alias("unscored"),
    )


def score_table(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of each label per group and distinct score; rows without a score share a null one."""
    score = F.when(~_no_score(F.col("score_ai")), F.col("score_ai"))
    return df.groupBy(*keys, score.alias("score_ai")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("label") == 1).alias("ai"),
        F.count_if(F.col("label") == 0).alias("human"),
    )


def _fold_scores(table: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """The sums of ``_fold`` from a score table."""
    score, ai, human = F.col("score_ai"), F.col("ai"), F.col("human")
    above = sc.hard_label(score, threshold) == 1
    loss = ai * sc.row_log_loss(F.lit(1), score) + human * sc.row_log_loss(F.lit(0), score)
    zero = F.lit(0).cast("bigint")

    def total(rows: Column, kept: Column) -> Column:
        return F.sum(F.when(kept, rows).otherwise(zero))

    return table.groupBy(*keys).agg(
        F.sum("rows").alias("rows"),
        total(human, ~above).alias("tn"),
        total(human, above).alias("fp"),
        total(ai, ~above).alias("fn"),
        total(ai, above).alias("tp"),
        F.sum(loss).alias("loss"),
        total(F.col("rows"), score.isNull()).alias("unscored"),
    )


def _finish(folded: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    metrics = sc.threshold_metrics(*[F.col(name) for name in COUNT_COLUMNS])
    loss = F.when(F.col("unscored") == 0, F.try_divide(F.col("loss"), F.col("rows").cast("double")))
    return folded.select(
        *keys,
        "rows",
        *[metrics[name].alias(name) for name in METRIC_COLUMNS],
        loss.alias("log_loss"),
        "unscored",
        *COUNT_COLUMNS,
        (F.col("tn") + F.col("fp")).alias("support_human"),
        (F.col("fn") + F.col("tp")).alias("support_ai"),
        F.lit(float(threshold)).alias("threshold"),
    )


def score_steps(table: DataFrame, keys: Sequence[str] = (), range_rows: int = RANGE_ROWS) -> DataFrame:
    """The scored rows of a written score table with the classes at and above each score.

    ``ai_above`` and ``human_above`` include the score itself.  Keys must not be null.  Scores
    are cut into as many ranges as hold about ``range_rows`` distinct scores each; running
    sums are taken inside a range and offset by those of the ranges above.
    """
    keys = list(keys)
    steps = table.where(F.col("score_ai").isNotNull())
    ranges = max(1, -(-steps.count() // range_rows))
    shares = [i / ranges for i in range(1, ranges)]
    edges = steps.agg(F.percentile_approx("score_ai", shares, 10 * ranges)).first()[0] if shares else []
    splits = [float("-inf"), *sorted(set(edges)), float("inf")]
    if len(splits) > 2:
        steps = Bucketizer(splits=splits, inputCol="score_ai", outputCol="_range").transform(steps)
    else:
        steps = steps.withColumn("_range", F.lit(0.0))
    higher = Window.partitionBy(*keys).orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        steps.groupBy(*keys, "_range")
        .agg(F.sum("ai").alias("_ai"), F.sum("human").alias("_human"))
        .select(
            *keys,
            "_range",
            F.coalesce(F.sum("_ai").over(higher), F.lit(0)).alias("_ai_before"),
            F.coalesce(F.sum("_human").over(higher), F.lit(0)).alias("_human_before"),
        )
    )
    within = (
        Window.partitionBy(*keys, "_range")
        .orderBy(F.col("score_ai").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return steps.join(offsets, [*keys, "_range"]).select(
        *keys,
        "score_ai",
        "ai",
        "human",
        (F.sum("ai").over(within) + F.col("_ai_before")).alias("ai_above"),
        (F.sum("human").over(within) + F.col("_human_before")).alias("human_above"),
    )


def _rank_sums(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    steps = score_steps(table, keys)
    ai, human = F.col("ai").cast("double"), F.col("human").cast("double")
    above = F.col("ai_above").cast("double")
    pairs = F.sum(human * (above - ai / 2))
    area = F.sum(ai * above / (above + F.col("human_above")))
    positives, negatives = F.sum(ai), F.sum(human)
    both = (positives > 0) & (negatives > 0)
    return steps.groupBy(*keys).agg(
        F.when(both, F.try_divide(pairs, positives * negatives)).alias("auroc"),
        F.when(both, F.try_divide(area, positives)).alias("average_precision"),
    )


def rank_metrics(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """AUROC (ties count half) and average precision; null with one class or an unscored row."""
    names = list(keys) or ["_all"]
    scored = df.withColumn("_all", F.lit(0)) if not keys else df
    table = settle(score_table(scored, names), "scores")
    groups = table.groupBy(*names).agg(F.count_if(F.col("score_ai").isNull()).alias("unscored"))
    return groups.join(_rank_sums(table, names), names, "left").select(*keys, *_ranks_if_scored())


def binary_metrics(df: DataFrame, keys: Sequence[str] = (), threshold: float = sc.DEFAULT_THRESHOLD) -> DataFrame:
    """The full metric record per group of non-null ``keys``, or one row without keys.

    Score-based metrics are null where a row has no score.  Everything comes from one
    table of the distinct scores.
    """
    names = list(keys) or ["_all"]
    scored = df.withColumn("_all", F.lit(0)) if not keys else df
    table = settle(score_table(scored, names), "scores")
    basic = _finish(_fold_scores(table, names, threshold), names, threshold)
    joined = basic.join(_rank_sums(table, names), names, "left")
    return joined.select(*keys, "rows", *METRIC_COLUMNS, "log_loss", *_ranks_if_scored(), *COUNT_COLUMNS,
                          "support_human", "support_ai", "threshold")


def _ranks_if_scored() -> list[Column]:
    return [F.when(F.col("unscored") == 0, F.col(name)).alias(name) for name in ("auroc", "average_precision")]


def class_report(df: DataFrame) -> DataFrame:
    """Per-class precision, recall, F1 and support, with accuracy and averages."""
    counts = confusion(df)
    m = sc.threshold_metrics(*[F.col(name) for name in COUNT_COLUMNS])
    humans, ais = F.col("tn") + F.col("fp"), F.col("fn") + F.col("tp")

    def line(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class_name"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1_score"),
            support.alias("support"),
        )

    accuracy = m["accuracy"]
    lines = [
        line("human", m["precision_human"], m["recall_human"], m["f1_human"], humans),
        line("ai", m["precision_ai"], m["recall_ai"], m["f1_ai"], ais),
        line("accuracy", accuracy, accuracy, accuracy, humans + ais),
        line("macro avg", m["macro_precision"], m["macro_recall"], m["macro_f1"], humans + ais),
        line("weighted avg", m["weighted_precision"], m["weighted_recall"], m["weighted_f1"], humans + ais),
    ]
    return counts.select(F.explode(F.array(*lines)).alias("e")).select("e.*")


def _with_recall_interval(df: DataFrame) -> DataFrame:
    low, high = sc.wilson_bounds(F.col("tp"), F.col("support_ai"))
    return df.withColumns({"recall_ai_low": low, "recall_ai_high": high})


def subgroup_metrics(
    df: DataFrame, column: str, threshold: float = sc.DEFAULT_THRESHOLD, min_rows: int = 1
) -> DataFrame:
    """Metrics per value of ``column``, largest group first; null is ``<missing>``.

    An absent column gives an empty table.  The confusion counts stay out, a
    Wilson interval of the AI recall is added.
    """
    if column not in df.columns:
        return df.sparkSession.createDataFrame([], f"{column} string, rows bigint")
    kept = df.select(missing_label(F.col(column)).alias(column), "label", "score_ai")
    table = _with_recall_interval(binary_metrics(kept, [column], threshold)).drop(*COUNT_COLUMNS)
    return table.where(F.col("rows") >= min_rows).orderBy(F.desc("rows"), F.asc(column))


# Dimensions of the standard tables; generator tables hold AI rows only.
DIMENSIONS = {"domain": False, "model_family": True, "model": True, "length_bucket": False}


def all_subgroups(df: DataFrame, threshold: float = sc.DEFAULT_THRESHOLD, min_rows: int = 1) -> DataFrame:
    """Every standard subgroup table at once, as (dimension, value) rows.

    Rows are folded to one small cube before being repeated per dimension; only
    the two-class dimensions take part in the ranking.
    """
    present = [name for name in DIMENSIONS if name in df.columns]
    keys = ["dimension", "value"]
    named = df.select(*[missing_label(F.col(name)).alias(name) for name in present], "label", "score_ai")

    def slots(names: list[str]) -> Column:
        entries = []
        for name in names:
            slot = F.struct(F.lit(name).alias("dimension"), F.col(name).alias("value"))
            entries.append(F.when(F.col("label") == 1, slot) if DIMENSIONS[name] else slot)
        return F.explode(F.array_compact(F.array(*entries))).alias("_slot")

    cube = _fold(named, [*present, "label"], threshold)
    sums = ["rows", *COUNT_COLUMNS, "loss", "unscored"]
    folded = (
        cube.select(*sums, slots(present))
        .groupBy(F.col("_slot.dimension").alias("dimension"), F.col("_slot.value").alias("value"))
        .agg(*[F.sum(name).alias(name) for name in sums])
    )
    ranked_dims = [name for name in present if not DIMENSIONS[name]]
    table = _finish(folded, keys, threshold)
    if ranked_dims:
        long = named.select("label", "score_ai", slots(ranked_dims)).select("_slot.*", "label", "score_ai")
        table = table.join(_rank_sums(settle(score_table(long, keys), "scores"), keys), keys, "left")
    else:
        table = table.withColumns({name: F.lit(None).cast("double") for name in ("auroc", "average_precision")})
    table = _with_recall_interval(table.where(F.col("rows") >= min_rows))
    return table.select(*keys, "rows", *METRIC_COLUMNS, "log_loss", *_ranks_if_scored(), "support_human", "support_ai", "recall_ai_low", "recall_ai_high", "threshold")


def majority_baseline(df: DataFrame) -> DataFrame:
    """The record of a model that gives every row the more frequent label."""
    counts = df.agg(F.count_if(F.col("label") == 0).alias("humans"), F.count_if(F.col("label") == 1).alias("ais"))
    humans_win = F.col("humans") >= F.col("ais")
    zero = F.lit(0).cast("bigint")
    m = sc.threshold_metrics(
        F.when(humans_win, F.col("humans")).otherwise(zero),
        F.when(humans_win, zero).otherwise(F.col("humans")),
        F.when(humans_win, F.col("ais")).otherwise(zero),
        F.when(humans_win, zero).otherwise(F.col("ais")),
    )
    both = (F.col("humans") > 0) & (F.col("ais") > 0)
    return counts.select(
        F.when(humans_win, 0).otherwise(1).alias("majority_label"),
        m["accuracy"].alias("accuracy"),
        m["macro_f1"].alias("macro_f1"),
        # A constant score ties every pair and puts every row on one step.
        F.when(both, F.lit(0.5)).alias("auroc"),
        F.when(both, sc.ratio(F.col("ais"), F.col("humans") + F.col("ais"))).alias("average_precision"),
    )


def roc_points(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score plus the origin; empty with one class or an unscored row."""
    names = list(keys) or ["_all"]
    scored = df.withColumn("_all", F.lit(0)) if not keys else df
    steps, totals = _steps_and_totals(scored, names)
    points = steps.select(
        *keys,
        F.col("score_ai").alias("threshold"),
        (F.col("human_above") / F.col("humans")).alias("fpr"),
        (F.col("ai_above") / F.col("ais")).alias("tpr"),
    )
    origin = totals.select(
        *keys, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(origin)


def pr_points(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(threshold, precision, recall) per distinct score plus the (1, 0) end point; empty like the other curve."""
    names = list(keys) or ["_all"]
    scored = df.withColumn("_all", F.lit(0)) if not keys else df
    steps, totals = _steps_and_totals(scored, names)
    points = steps.select(
        *keys,
        F.col("score_ai").alias("threshold"),
        (F.col("ai_above") / (F.col("ai_above") + F.col("human_above"))).alias("precision"),
        (F.col("ai_above") / F.col("ais")).alias("recall"),
    )
    end = totals.select(
        *keys, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return points.unionByName(end)


def _steps_and_totals(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Score steps with the class totals of their group, where it has both classes and all scores."""
    table = settle(score_table(df, keys), "scores")
    totals = (
        table.groupBy(*keys)
        .agg(
            F.sum("ai").alias("ais"),
            F.sum("human").alias("humans"),
            F.count_if(F.col("score_ai").isNull()).alias("unscored"),
        )
        .where((F.col("ais") > 0) & (F.col("humans") > 0) & (F.col("unscored") == 0))
        .drop("unscored")
    )
    return score_steps(table, keys).join(totals, list(keys)), totals


def per_class_f1(metrics: DataFrame) -> DataFrame:
    """Chart rows (class_name, f1) of one metric record."""
    return metrics.select(F.col("f1_human").alias("human"), F.col("f1_ai").alias("ai")).unpivot(
        [], ["human", "ai"], "class_name", "f1"
    )


def domain_chart(subgroups: DataFrame) -> DataFrame:
    """Domain and macro F1, lowest first."""
    return subgroups.select("domain", "macro_f1").orderBy(F.asc("macro_f1"), F.asc("domain"))


def fold_recall_chart(summary: DataFrame) -> DataFrame:
    """Recall per left-out family, best first, beside the other recalls that the summary has."""
    recalls = [f"recall_ai_{name}" for name in ("holdout", "in_distribution", "control")]
    present = [name for name in recalls if name in summary.columns]
    return summary.select("held_out_family", *present).orderBy(F.desc("recall_ai_holdout"), F.asc("held_out_family"))


def length_chart(subgroups: DataFrame) -> DataFrame:
    """AI recall per length bucket: short, medium, long, then any other bucket."""
    places = {"short": 0, "medium": 1, "long": 2}
    place = reduce(
        lambda chain, item: chain.when(F.col("length_bucket") == item[0], item[1]),
        places.items(),
        F.when(F.lit(False), 99),
    ).otherwise(99)
    return subgroups.select("length_bucket", "recall_ai", place.alias("place")).orderBy("place", "length_bucket")


def train_val_table(df: DataFrame, threshold: float = sc.DEFAULT_THRESHOLD) -> DataFrame:
    """The training-curve metrics side by side for every value of ``split``."""
    wanted = ["accuracy", "macro_f1", "recall_ai", "average_precision", "log_loss"]
    record = binary_metrics(df.select(missing_label(F.col("split")).alias("split"), "label", "score_ai"), ["split"], threshold)
    return record.select("split", *wanted)


