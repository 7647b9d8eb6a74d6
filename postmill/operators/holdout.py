"""Leave-one-generator-out folds, size-matched controls and their comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.ordering import seeded_rank
from postmill.operators.sampling import rank_cutoffs
from postmill.sources.staging import settle

FAMILY = "model_family"
MODES = ("holdout", "control")


def family_counts(df: DataFrame, min_rows: int = 1) -> DataFrame:
    """AI rows per generator family, largest first."""
    if FAMILY not in df.columns:
        raise ValueError(f"the folds are families: the rows need {FAMILY!r}")
    return (
        df.where((F.col("label") == 1) & F.col(FAMILY).isNotNull())
        .groupBy(FAMILY)
        .agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") >= min_rows)
        .orderBy(F.desc("rows"), F.asc(FAMILY))
    )


def list_families(df: DataFrame, min_rows: int = 1) -> list[str]:
    return [row[FAMILY] for row in family_counts(df, min_rows).collect()]


def _in_fold(family: Column, dropped: Column) -> Column:
    """Fold membership of a row: its test rows, and the train/val rows not dropped."""
    human = F.col("label") == 0
    test = human | F.col(FAMILY).eqNullSafe(family)
    return F.when(F.col("split") == "test", test).otherwise(human | ~dropped)


def holdout_member(family: str) -> Column:
    """Whether a row is in the fold that holds the family out."""
    name = F.lit(family)
    return _in_fold(name, F.col(FAMILY).eqNullSafe(name))


def holdout_fold(df: DataFrame, family: str) -> DataFrame:
    """Train and validation without the family, test with humans and that family.

    An AI row without a family stays in train and validation.
    """
    return df.where(holdout_member(family))


def control_cutoffs(df: DataFrame, families: Sequence[str], seed: int = 42, key: str = "id") -> DataFrame:
    """Per split and family, the hash up to which AI rows leave the control fold.

    As many AI rows leave a split as the family has in it.
    """
    ai = df.where((F.col("label") == 1) & F.col("split").isin("train", "val"))
    wanted = F.when(F.col(FAMILY).isin(*families), F.col(FAMILY))
    takes = settle(
        ai.groupBy("split", wanted.alias("fold")).agg(F.count(F.lit(1)).alias("take")).where("fold is not null"),
        "control-takes",
    )
    keyed = ai.select("split", seeded_rank(F.col(key), seed).alias("_rank"))
    return rank_cutoffs(keyed, ["split"], takes)


def _dropped_by(cutoffs: Sequence, family: str, seed: int, key: str) -> Column:
    rank, dropped = seeded_rank(F.col(key), seed), F.lit(False)
    for row in cutoffs:
        if row["fold"] == family:
            dropped = dropped | ((F.col("split") == row["split"]) & (rank <= row["cutoff"]))
    return dropped


def control_member(family: str, cutoffs: Sequence, seed: int = 42, key: str = "id") -> Column:
    """Whether a row is in the family's control fold; ``cutoffs`` are the collected rows of ``control_cutoffs``."""
    return _in_fold(F.lit(family), _dropped_by(cutoffs, family, seed, key))


def control_fold(df: DataFrame, family: str, seed: int = 42, key: str = "id", cutoffs: Sequence | None = None) -> DataFrame:
    """As many AI rows dropped as the holdout drops, but at random; same test rows.

    ``cutoffs`` are the collected rows of ``control_cutoffs``, when the caller has them.
    """
    cutoffs = control_cutoffs(df, [family], seed, key).collect() if cutoffs is None else cutoffs
    return df.where(control_member(family, cutoffs, seed, key))


def train_groups(
    families: Sequence[str], mode: str, seed: int = 42, key: str = "id", cutoffs: Sequence = ()
) -> tuple[Column, dict[str, list[int]]]:
    """A number for each training row, and the numbers that each fold leaves out.

    Rows of one number are in the same folds: those of a family, or those between two cut-offs.
    """
    ai = F.col("label") == 1
    if mode == "holdout":
        number = F.coalesce(F.array_position(F.array(*[F.lit(name) for name in families]), F.col(FAMILY)), F.lit(0))
        return F.when(ai, number).otherwise(0), {name: [place] for place, name in enumerate(families, 1)}
    ends = {row["fold"]: row["cutoff"] for row in cutoffs if row["split"] == "train"}
    steps = sorted(set(ends.values()))
    rank = seeded_rank(F.col(key), seed)
    number = F.lit(0)
    for place, end in reversed(list(enumerate(steps, 1))):
        number = F.when(rank <= end, place).otherwise(number)
    out = {name: list(range(1, steps.index(ends[name]) + 2)) if name in ends else [] for name in families}
    return F.when(ai, number).otherwise(0), out


def expand_folds(
    df: DataFrame, families: Sequence[str], mode: str = "holdout", seed: int = 42, key: str = "id"
) -> DataFrame:
    """Rows repeated once per fold they belong to, with a ``fold`` column.

    The families are a short list, so each row works out its own folds and no
    join is needed.
    """
    check_mode(mode)
    cutoffs = control_cutoffs(df, families, seed, key).collect() if mode == "control" else []
    member = []
    for family in families:
        name = F.lit(family)
        dropped = (
            F.col(FAMILY).eqNullSafe(name) if mode == "holdout" else _dropped_by(cutoffs, family, seed, key)
        )
        member.append(F.when(_in_fold(name, dropped), name))
    return df.withColumn("fold", F.explode(F.array_compact(F.array(*member))))


def check_mode(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}, use one of {', '.join(MODES)}")


def fold_sizes(df: DataFrame, families: Sequence[str], mode: str = "holdout", seed: int = 42) -> DataFrame:
    """Human and AI rows of every fold per split, from one count by split, label and family.

    Both modes leave out as many AI rows as the family has, so their sizes agree.
    """
    check_mode(mode)
    known = F.array(*[F.lit(name) for name in families])
    family = F.when(F.array_contains(known, F.col(FAMILY)), F.col(FAMILY))
    cube = settle(df.groupBy("split", "label", family.alias(FAMILY)).agg(F.count(F.lit(1)).alias("rows")), "fold-cube")
    humans, ais = (F.coalesce(F.sum(F.when(F.col("label") == label, F.col("rows"))), F.lit(0)) for label in (0, 1))
    totals = cube.groupBy("split").agg(humans.alias("human_rows"), ais.alias("ais")).withColumn("fold", F.explode(known))
    own = cube.where((F.col("label") == 1) & F.col(FAMILY).isNotNull()).select("split", F.col(FAMILY).alias("fold"), F.col("rows").alias("own"))
    mine = F.coalesce("own", F.lit(0))
    return totals.join(own, ["split", "fold"], "left").select(
        "fold",
        "split",
        "human_rows",
        F.when(F.col("split") == "test", mine).otherwise(F.col("ais") - mine).cast("bigint").alias("ai_rows"),
    ).where("human_rows + ai_rows > 0")


def fold_summary(metrics: DataFrame, train_rows: DataFrame, mode: str = "holdout") -> DataFrame:
    """Summary table from per-fold metric records and per-fold training AI rows.

    ``metrics`` is keyed by ``fold``; ``train_rows`` has ``fold`` and ``train_ai_rows``.
    """
    check_mode(mode)
    return (
        metrics.join(train_rows, "fold")
        .select(
            F.col("fold").alias("held_out_family"),
            "train_ai_rows",
            F.col("support_human").alias("test_human_rows"),
            F.col("support_ai").alias("test_ai_rows"),
            F.col("recall_ai").alias(f"recall_ai_{mode}"),
            "auroc",
            F.col("fp").alias("false_positives_human"),
            F.col("fn").alias("missed_ai_posts"),
        )
        .orderBy(F.desc("test_ai_rows"), F.asc("held_out_family"))
    )


def attach_baseline(summary: DataFrame, by_family: DataFrame | None) -> DataFrame:
    """Join the in-distribution recall per family and the recall lost to it."""
    recall = next((name for name in ("recall_ai_holdout", "recall_ai_control") if name in summary.columns), None)
    if by_family is None or recall is None:
        return summary
    baseline = by_family.select(
        F.col(FAMILY).alias("held_out_family"), F.col("recall_ai").alias("recall_ai_in_distribution")
    )
    return summary.join(baseline, "held_out_family", "left").withColumn(
        "recall_drop", F.col("recall_ai_in_distribution") - F.col(recall)
    )


def decompose(holdout: DataFrame, control: DataFrame, by_family: DataFrame) -> DataFrame:
    """Split the recall lost into the cost of less data and of a new generator."""
    matched = control.select("held_out_family", "recall_ai_control")
    joined = attach_baseline(holdout, by_family).join(matched, "held_out_family")
    seen, middle, unseen = (F.col(f"recall_ai_{name}") for name in ("in_distribution", "control", "holdout"))
    return joined.select(
        "held_out_family",
        "test_ai_rows",
        "recall_ai_in_distribution",
        "recall_ai_control",
        "recall_ai_holdout",
        (seen - middle).alias("cost_of_less_data"),
        (middle - unseen).alias("cost_of_new_generator"),
        "recall_drop",
        "auroc",
        "false_positives_human",
        "missed_ai_posts",
        "train_ai_rows",
    ).orderBy(F.desc("cost_of_new_generator"), F.asc("held_out_family"))
