"""Score rules: hard labels, softmax, Wilson intervals and confusion-count metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spacing of 64-bit floats at 1.0 (the log-loss clip) and the 95 %
# normal quantile of the Wilson interval.
LOG_LOSS_EPS = 2.220446049250313e-16
WILSON_Z = 1.96
DEFAULT_THRESHOLD = 0.5


def hard_label(score: Column, threshold: float = DEFAULT_THRESHOLD) -> Column:
    """1 when the score reaches the threshold (inclusive); a row without a score stays below it."""
    return F.coalesce((score >= F.lit(float(threshold))) & ~F.isnan(score), F.lit(False)).cast("int")


def softmax_ai(logit_human: Column, logit_ai: Column) -> Column:
    """P(AI) from two logits, shifted by the larger one."""
    top = F.greatest(logit_human, logit_ai)
    ai = F.exp(logit_ai - top)
    return ai / (F.exp(logit_human - top) + ai)


def ratio(part: Column, whole: Column) -> Column:
    """Division that yields 0 on a zero denominator (ANSI mode would raise)."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def wilson_bounds(successes: Column, trials: Column, z: float = WILSON_Z) -> tuple[Column, Column]:
    """Lower and upper Wilson score bounds, (0, 0) without trials."""
    n = trials.cast("double")
    share = F.try_divide(successes.cast("double"), n)
    z2_over_n = F.try_divide(F.lit(z * z), n)
    spread = F.lit(z) * F.sqrt(F.try_divide(share * (1 - share), n) + F.try_divide(z2_over_n, 4 * n))
    middle = share + z2_over_n / 2
    low = F.greatest(F.lit(0.0), (middle - spread) / (1 + z2_over_n))
    high = F.least(F.lit(1.0), (middle + spread) / (1 + z2_over_n))
    some = trials > 0
    return F.when(some, low).otherwise(F.lit(0.0)), F.when(some, high).otherwise(F.lit(0.0))


def row_log_loss(label: Column, score: Column) -> Column:
    """Negative log of the clipped probability given to the true label."""
    truth = F.when(label == 1, score).otherwise(1 - score)
    return -F.ln(F.least(F.greatest(truth, F.lit(LOG_LOSS_EPS)), F.lit(1.0 - LOG_LOSS_EPS)))


def confusion_counts(label: Column, predicted: Column) -> dict[str, Column]:
    """The four aggregate counts, rows = truth, columns = prediction."""
    return {
        "tn": F.count_if((label == 0) & (predicted == 0)),
        "fp": F.count_if((label == 0) & (predicted == 1)),
        "fn": F.count_if((label == 1) & (predicted == 0)),
        "tp": F.count_if((label == 1) & (predicted == 1)),
    }


def threshold_metrics(tn: Column, fp: Column, fn: Column, tp: Column) -> dict[str, Column]:
    """Every metric that needs only the four counts, over the pinned labels 0 and 1."""
    humans, ais = tn + fp, fn + tp
    precision = {"human": ratio(tn, tn + fn), "ai": ratio(tp, tp + fp)}
    recall = {"human": ratio(tn, humans), "ai": ratio(tp, ais)}
    f1 = {"human": ratio(2 * tn, 2 * tn + fp + fn), "ai": ratio(2 * tp, 2 * tp + fp + fn)}

    def macro(by_class: dict[str, Column]) -> Column:
        return (by_class["human"] + by_class["ai"]) / 2

    def weighted(by_class: dict[str, Column]) -> Column:
        return ratio(by_class["human"] * humans + by_class["ai"] * ais, humans + ais)

    return {
        "accuracy": ratio(tn + tp, humans + ais),
        "balanced_accuracy": F.when((humans > 0) & (ais > 0), macro(recall))
        .when(ais > 0, recall["ai"])
        .otherwise(recall["human"]),
        "precision_human": precision["human"],
        "recall_human": recall["human"],
        "f1_human": f1["human"],
        "precision_ai": precision["ai"],
        "recall_ai": recall["ai"],
        "f1_ai": f1["ai"],
        "macro_precision": macro(precision),
        "macro_recall": macro(recall),
        "macro_f1": macro(f1),
        "weighted_precision": weighted(precision),
        "weighted_recall": weighted(recall),
        "weighted_f1": weighted(f1),
    }
