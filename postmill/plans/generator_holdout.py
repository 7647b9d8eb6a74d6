"""One model per left-out generator family, all folds scored in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.scores import DEFAULT_THRESHOLD
from postmill.operators import holdout as ho
from postmill.operators.metrics import binary_metrics
from postmill.operators.model import FOLD_TRAINERS, ClassifierConfig, TextClassifier, get_trainer, score_all_column
from postmill.operators.ngrams import gram_counts
from postmill.operators.tfidf import NgramConfig, Vectorizer, kept_grams
from postmill.sources import sinks
from postmill.sources.staging import run_folder, settle

# Words for the design record.
DESIGNS = {
    "holdout": "The family's AI rows leave train and validation; the test rows are all humans and that family.",
    "control": "As many AI rows as the family has leave train and validation at random, the family stays; "
    "the test rows are those of the holdout fold.",
}


def run_folds(
    splits: DataFrame,
    mode: str = "holdout",
    families: Sequence[str] | None = None,
    model_name: str = "tfidf_logreg",
    ngrams: NgramConfig = NgramConfig(),
    classifier: ClassifierConfig = ClassifierConfig(),
    seed: int = 42,
    threshold: float = DEFAULT_THRESHOLD,
) -> tuple[DataFrame, DataFrame, dict[str, TextClassifier]]:
    """(summary, scored test rows with ``fold``, models); ``splits`` should be a written table.

    Training texts are counted once for the vocabularies of all folds and analysed once for their fits, which
    share every pass of the solver; test texts are tokenised once and scored by every fold's model.
    """
    ho.check_mode(mode)
    get_trainer(model_name)
    fit = FOLD_TRAINERS[model_name]
    train = splits.where(F.col("split") == "train")
    names = list(families or ho.list_families(train))
    if not names:
        raise ValueError("the training rows name no generator family")
    cutoffs = ho.control_cutoffs(train, names, seed).collect() if mode == "control" else []
    group, left_out = ho.train_groups(names, mode, seed, cutoffs=cutoffs)
    counts = settle(gram_counts(train, ngrams.shortest, ngrams.longest, group=group), "fold-grams")
    sizes = {row["group"]: row["rows"] for row in train.groupBy(group.alias("group")).agg(F.count(F.lit(1)).alias("rows")).collect()}

    def vocabulary_of(name: str) -> Vectorizer:
        inside = ~F.col("group").isin(left_out[name]) if left_out[name] else F.lit(True)
        kept = counts.where(inside).groupBy("gram").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        rows = sum(n for number, n in sizes.items() if number not in left_out[name])
        return Vectorizer.collect(kept_grams(kept, rows, ngrams), ngrams)

    models = fit(train, group, [tuple(left_out[name]) for name in names], [vocabulary_of(name) for name in names], classifier)

    test = splits.where(F.col("split") == "test")
    scores = score_all_column(splits.sparkSession, models)
    with_all = settle(test.select("id", "label", "split", ho.FAMILY, scores.alias("scores")), "fold-scores")
    place = F.array_position(F.array(*[F.lit(name) for name in names]), F.col("fold")).cast("int")
    scored = ho.expand_folds(with_all, names).select(
        "fold", "id", "label", F.element_at("scores", place).alias("score_ai")
    )
    metrics = binary_metrics(scored, ["fold"], threshold)
    sizes = ho.fold_sizes(train, names, mode, seed).select("fold", F.col("ai_rows").alias("train_ai_rows"))
    return ho.fold_summary(metrics, sizes, mode), scored, dict(zip(names, models, strict=True))


def generator_holdout(
    spark: SparkSession, prepared: str, folder: str, mode: str = "holdout", by_family: DataFrame | None = None, **options
) -> DataFrame:
    """Run the sweep on a prepared folder; write the summary and the design record."""
    splits = sinks.read_split(spark, prepared)
    with run_folder(spark):
        summary, _, _ = run_folds(splits, mode, **options)
        table = settle(ho.attach_baseline(summary, by_family), "fold-summary")
        table.write.mode("overwrite").json(f"{folder}/summary")
    design = {
        "model": options.get("model_name", "tfidf_logreg"),
        "mode": mode,
        "families": list(options.get("families") or ho.list_families(splits.where(F.col("split") == "train"))),
        "threshold": options.get("threshold", DEFAULT_THRESHOLD),
        "seed": options.get("seed", 42),
        "design": DESIGNS[mode],
    }
    sinks.write_json(spark, design, f"{folder}/design")
    return spark.read.schema(table.schema).json(f"{folder}/summary")
