"""Every registered query: (session, table folder) -> DataFrame, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import scores as sc
from postmill.functions import text as tx
from postmill.operators import audit, buckets, holdout, leakage, ngrams, sampling, split, tfidf
from postmill.operators import metrics as mt
from postmill.operators import model as md
from postmill.operators.clean import clean_posts, cleaning_report
from postmill.operators.dedupe import copy_groups, dedupe_report, deduplicate, duplicate_counts, label_conflicts, text_overlap
from postmill.plans.evaluate import evaluate_scores
from postmill.plans.generator_holdout import run_folds
from postmill.plans.prepare import audit_posts, prepare_summary
from postmill.plans.train import train_and_score
from postmill.sources import jsonl, sinks
from postmill.sources.posts_view import documents, posts
from postmill.sources.staging import settle, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SEED = 42
THRESHOLD = 0.5
FIRST_ROWS = 100
SAMPLE_ROWS = 200
TOP_GRAMS = 2_000
# The largest part of a fit's gradient, per unit of row weight, that counts as zero.
GRADIENT_BOUND = 1e-4


def query(function: Query) -> Query:
    """Register a query; tables that it prepares are shared inside one call only."""

    @wraps(function)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        PREPARED.clear()
        return function(spark, sf_dir)

    QUERIES[function.__name__] = run
    return run


# Shared frames ---------------------------------------------------------------


PREPARED: dict[tuple[str, str, str], DataFrame] = {}


def _prepared(name: str) -> Callable[[Query], Query]:
    """Write a prepared table once per call of a query, however often the query names it."""

    def wrap(build: Query) -> Query:
        def read(spark: SparkSession, sf_dir: str) -> DataFrame:
            key = (spark.sparkContext.applicationId, name, sf_dir)
            if key not in PREPARED:
                PREPARED[key] = settle(build(spark, sf_dir), name)
            return PREPARED[key]

        return read

    return wrap


@_prepared("cleaned")
def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_posts(posts(spark, sf_dir))


@_prepared("deduped")
def _deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(_cleaned(spark, sf_dir))


def _by_domain(df: DataFrame) -> bool:
    return split.stratum_choice(df).first()["stratify_by"] == "label+domain"


@_prepared("split")
def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _deduped(spark, sf_dir)
    return split.stratified_split(df, _by_domain(df), seed=SEED)


def _bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.predictions(buckets.add_length_buckets(_deduped(spark, sf_dir)), THRESHOLD)


def _rounded(df: DataFrame) -> DataFrame:
    """Floats to six places, so that the order of additions does not show."""
    fractional = [name for name, kind in df.dtypes if kind == "double"]
    return df.withColumns({name: F.round(name, 6) for name in fractional})


# Cleaning and duplicates -----------------------------------------------------


@query
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = posts(spark, sf_dir)
    return raw.select(
        "doc_id",
        tx.normalize_text(F.col("note_title")).alias("title"),
        tx.normalize_text(F.col("note_content")).alias("body"),
    )


@query
def canonical_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_posts(posts(spark, sf_dir)).select("doc_id", "text", "title_only", "text_len_chars")


@query
def clean_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning_report(posts(spark, sf_dir))


@query
def clean_report_long_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning_report(posts(spark, sf_dir), min_title_only_chars=40)


@query
def stable_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_posts(posts(spark, sf_dir)).select("doc_id", "id")


@query
def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_conflicts(_cleaned(spark, sf_dir)).select("doc_id", "label", "text", "source_file", "source_line")


@query
def dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(_cleaned(spark, sf_dir)).select("doc_id", "id", "label", "text", "domain", "model_family")


@query
def dedupe_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe_report(_cleaned(spark, sf_dir))


@query
def nested_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: posts, clean, dedupe, counts by label and domain."""
    return audit.nested_counts(_deduped(spark, sf_dir), "label", "domain")


# Audit -----------------------------------------------------------------------


@query
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.value_counts(_cleaned(spark, sf_dir), "model_family")


@query
def missing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["note_title", "note_content", "label", "note_id", "likes", "domain", "model_family", "model", "text"]
    return audit.missing_counts(clean_posts(posts(spark, sf_dir)).select(*names))


@query
def empty_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.empty_counts(clean_posts(posts(spark, sf_dir)))


@query
def empty_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.empty_title_by_label(clean_posts(posts(spark, sf_dir)))


@query
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_counts(copy_groups(_cleaned(spark, sf_dir)))


@query
def label_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_overlap(copy_groups(_cleaned(spark, sf_dir)))


@query
def length_stats_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(audit.length_stats(clean_posts(posts(spark, sf_dir)), "label"))


@query
def length_stats_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(audit.length_stats(clean_posts(posts(spark, sf_dir)), "domain"))


@query
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(audit.audit_report(_cleaned(spark, sf_dir).drop("score_ai", "doc_id", "source")))


@query
def feature_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model may read, with the metadata columns that were kept from it."""
    df = clean_posts(posts(spark, sf_dir))
    barred = ",".join(audit.metadata_columns(df))
    narrow = sinks.training_frame(df)
    return narrow.groupBy("label").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.length("text")).alias("chars"),
        F.lit(barred).alias("barred_columns"),
    )


# Splits and leakage ----------------------------------------------------------


@query
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_posts(posts(spark, sf_dir)).select("doc_id", tx.text_fingerprint(F.col("text")).alias("fingerprint"))


@query
def near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.near_duplicate_leakage(_split(spark, sf_dir))


@query
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact overlap on rows that were split before their duplicates were removed."""
    cleaned = _cleaned(spark, sf_dir)
    third = F.col("doc_id") % 3
    name = F.when(third == 0, "train").when(third == 1, "val").otherwise("test")
    return leakage.exact_overlap(cleaned.withColumn("split", name))


def _seeded_groups(df: DataFrame) -> DataFrame:
    # The document source is on every row and repeats: it does tie rows together.
    return df.withColumn("seed_id", F.col("source"))


@query
def group_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(split.group_column_report(_seeded_groups(_deduped(spark, sf_dir))))


@query
def stratum_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.stratum_choice(_deduped(spark, sf_dir))


@query
def stratum_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = tx.stratum_key(F.col("label"), F.col("domain"))
    return _deduped(spark, sf_dir).groupBy(key.alias("stratum")).agg(F.count(F.lit(1)).alias("rows"))


@query
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select("id", "split")


@query
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.group_split(_seeded_groups(_deduped(spark, sf_dir)), "seed_id", seed=SEED).select("id", "seed_id", "split")


@query
def split_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.split_checks(_split(spark, sf_dir))


@query
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.manifest_counts(_split(spark, sf_dir))


@query
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_sample(_deduped(spark, sf_dir), SAMPLE_ROWS, SEED).select("id", "label")


@query
def split_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.split_table(split.drop_internal(_split(spark, sf_dir).withColumn("_helper", F.lit(1))))


@query
def prepare_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = posts(spark, sf_dir)
    cleaned = _cleaned(spark, sf_dir)
    return prepare_summary(raw, cleaned, _deduped(spark, sf_dir), _split(spark, sf_dir))


# Metrics ---------------------------------------------------------------------


@query
def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.prediction_table(mt.predictions(_split(spark, sf_dir), THRESHOLD))


@query
def errors_fp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.false_positives(mt.predictions(_split(spark, sf_dir), THRESHOLD))


@query
def errors_fn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.false_negatives(mt.predictions(_split(spark, sf_dir), THRESHOLD))


@query
def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = posts(spark, sf_dir)
    human, ai = F.col("score_ai") * 8 - 4, (F.col("doc_id") % 13).cast("double") - 6
    return _rounded(raw.select("doc_id", sc.softmax_ai(human, ai).alias("p_ai")))


@query
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.confusion(mt.predictions(_deduped(spark, sf_dir), THRESHOLD))


@query
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mt.binary_metrics(_deduped(spark, sf_dir), threshold=THRESHOLD))


@query
def rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUROC and average precision per domain."""
    return _rounded(mt.rank_metrics(_deduped(spark, sf_dir), ["domain"]))


@query
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mt.class_report(mt.predictions(_deduped(spark, sf_dir), THRESHOLD)))


@query
def subgroup_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mt.subgroup_metrics(_deduped(spark, sf_dir), "domain", THRESHOLD))


def _ai_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deduped(spark, sf_dir).where(F.col("label") == 1)


@query
def subgroup_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mt.subgroup_metrics(_ai_rows(spark, sf_dir), "model_family", THRESHOLD))


@query
def subgroup_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mt.subgroup_metrics(_ai_rows(spark, sf_dir), "model", THRESHOLD, min_rows=3))


@query
def subgroup_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mt.subgroup_metrics(_bucketed(spark, sf_dir), "length_bucket", THRESHOLD))


@query
def subgroup_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mt.all_subgroups(settle(_bucketed(spark, sf_dir), "bucketed"), THRESHOLD))


@query
def wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the share of posts that score above a half, per source domain and label."""
    counts = posts(spark, sf_dir).groupBy("domain", "label").agg(
        F.count_if(F.col("score_ai") >= 0.5).alias("successes"), F.count(F.lit(1)).alias("trials")
    )
    low, high = sc.wilson_bounds(F.col("successes"), F.col("trials"))
    return _rounded(counts.withColumns({"low": low, "high": high}))


@query
def majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mt.majority_baseline(_deduped(spark, sf_dir)))


@query
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mt.roc_points(_deduped(spark, sf_dir)))


@query
def pr_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mt.pr_points(_deduped(spark, sf_dir)))


@query
def tertile_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(buckets.tertile_edges(clean_posts(posts(spark, sf_dir))))


@query
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bucketed(spark, sf_dir).select("id", "text_len_chars", "length_bucket")


@query
def train_val_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mt.train_val_table(_split(spark, sf_dir), THRESHOLD))


@query
def class_f1_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mt.per_class_f1(mt.binary_metrics(_deduped(spark, sf_dir), threshold=THRESHOLD)))


@query
def domain_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mt.domain_chart(mt.subgroup_metrics(_deduped(spark, sf_dir), "domain", THRESHOLD)))


@query
def length_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mt.length_chart(mt.subgroup_metrics(_bucketed(spark, sf_dir), "length_bucket", THRESHOLD)))


# Generator holdout on fixture scores ------------------------------------------


@query
def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holdout.family_counts(_deduped(spark, sf_dir))


@query
def holdout_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _split(spark, sf_dir)
    return holdout.fold_sizes(df, holdout.list_families(df), "holdout", SEED)


@query
def control_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AI rows that stay in each control fold, by split and family."""
    df = _split(spark, sf_dir)
    rows = holdout.expand_folds(df, holdout.list_families(df), "control", SEED).where("label = 1")
    return rows.groupBy("fold", "split", "model_family").agg(F.count(F.lit(1)).alias("ai_rows"))


@query
def fold_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _split(spark, sf_dir)
    return holdout.expand_folds(df, holdout.list_families(df), "holdout", SEED).select("fold", "split", "id", "label")


# The control scores of the fixture: the same scores moved by a few thousandths.
def _nudged(df: DataFrame, step: float) -> DataFrame:
    return df.withColumn("score_ai", F.greatest(F.lit(0.0), F.col("score_ai") - F.lit(step)))


def _fold_summary(df: DataFrame, mode: str) -> DataFrame:
    names = holdout.list_families(df)
    tested = holdout.expand_folds(df.where("split = 'test'"), names, "holdout", SEED)
    sizes = holdout.fold_sizes(df.where("split = 'train'"), names, mode, SEED)
    metrics = mt.binary_metrics(tested, ["fold"], THRESHOLD)
    return holdout.fold_summary(metrics, sizes.select("fold", F.col("ai_rows").alias("train_ai_rows")), mode)


def _by_family(df: DataFrame) -> DataFrame:
    return mt.subgroup_metrics(df.where("split = 'test' and label = 1"), "model_family", THRESHOLD)


@query
def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_fold_summary(_split(spark, sf_dir), "holdout"))


@query
def recall_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _split(spark, sf_dir)
    return _rounded(holdout.attach_baseline(_fold_summary(_nudged(df, 0.2), "holdout"), _by_family(df)))


@query
def decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _split(spark, sf_dir)
    unseen, matched = _fold_summary(_nudged(df, 0.2), "holdout"), _fold_summary(_nudged(df, 0.05), "control")
    return _rounded(holdout.decompose(unseen, matched, _by_family(df)))


@query
def fold_recall_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _split(spark, sf_dir)
    unseen, matched = _fold_summary(_nudged(df, 0.2), "holdout"), _fold_summary(_nudged(df, 0.05), "control")
    return _rounded(mt.fold_recall_chart(holdout.decompose(unseen, matched, _by_family(df))))


@query
def evaluate_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subgroup tables as an evaluation has written them."""
    folder = f"{shared_folder(spark)}/postmill-evaluation-{uuid.uuid4().hex}"
    evaluate_scores(_deduped(spark, sf_dir).drop("length_bucket"), folder, THRESHOLD)
    return _rounded(spark.read.json(f"{folder}/subgroup_metrics"))


# Rows without a score ------------------------------------------------------------


def _some_unscored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of the domains have rows whose score is null or not a number."""
    key, score = F.col("doc_id"), F.col("score_ai")
    missing = F.when(key % 2 == 0, F.lit(None).cast("double")).otherwise(F.lit(float("nan")))
    chosen = F.col("domain").isin("de", "es") & (key % 5 == 1)
    return _deduped(spark, sf_dir).withColumn("score_ai", F.when(chosen, missing).otherwise(score))


@query
def rank_metrics_unscored(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = mt.binary_metrics(_some_unscored(spark, sf_dir), ["domain"], THRESHOLD)
    return _rounded(record.select("domain", "rows", "tn", "fp", "fn", "tp", "log_loss", "auroc", "average_precision"))


@query
def roc_points_unscored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mt.roc_points(_some_unscored(spark, sf_dir), ["domain"]))


# JSON lines ------------------------------------------------------------------


def _json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posts as JSON lines under varying keys, some of them broken."""
    key = F.col("doc_id")

    def line(*parts: Column) -> Column:
        return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})

    title, body, likes = F.col("note_title"), F.col("note_content"), F.col("likes")
    domain, family, model = F.col("domain"), F.col("model_family"), F.col("model")
    canonical = line(title, body, likes, domain)
    aliased = line(title, body.alias("desc"), likes.alias("liked_count"), domain, family)
    both = line(title, body, F.lit("unused").alias("desc"), likes.alias("collected_count"), model)
    good = F.when(key % 3 == 0, canonical).when(key % 3 == 1, aliased).otherwise(both)
    value = (
        F.when(key % 97 == 0, F.substring(good, F.lit(1), F.length(good) - 1))
        .when(key % 89 == 0, line(body, likes, domain))
        .when(key % 83 == 0, line(title, likes, domain))
        .when(key % 79 == 0, F.concat(good, F.lit("x")))
        .when(key % 73 == 0, F.concat(F.lit("["), good, F.lit("]")))
        .when(key % 71 == 0, F.lit(" \t"))
        .otherwise(good)
    )
    return posts(spark, sf_dir).select("label", "source_file", "source_line", value.alias("value"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = settle(_json_lines(spark, sf_dir), "json-lines")
    sources = [
        jsonl.parse_lines(lines.where(F.col("label") == label).drop("label"), label) for label in (0, 1)
    ]
    return sources[0].unionByName(sources[1])


@query
def json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bad line with the rule it breaks."""
    bad = jsonl.bad_rows(_parsed(spark, sf_dir))
    return bad.select("source_file", "source_line", F.split_part("problem", F.lit(":"), F.lit(1)).alias("kind"))


@query
def json_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["note_title", "note_content", "label", "source_file", "source_line", "likes", "collections", "domain", "model_family", "model"]
    return jsonl.good_rows(_parsed(spark, sf_dir)).select(*names)


@query
def load_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonl.load_report(_parsed(spark, sf_dir))


@query
def first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first good rows of each source, and the bad lines met on the way."""
    parsed = settle(_parsed(spark, sf_dir), "parsed")
    sources = [jsonl.first_n(parsed.where(F.col("label") == label), FIRST_ROWS) for label in (0, 1)]
    return sources[0].unionByName(sources[1]).select(
        "source_file", "source_line", F.col("_problem").isNull().alias("good")
    )


@query
def json_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in every spelling: whole numbers are read, anything else is kept as it is."""
    key = F.col("doc_id")
    number = key.cast("string")
    spelled = (
        F.when(key % 7 == 0, F.concat(number, F.lit(".0")))
        .when(key % 7 == 1, F.concat(number, F.lit("e3")))
        .when(key % 7 == 2, F.lit('"1.2万"'))
        .when(key % 7 == 3, F.lit("null"))
        .when(key % 7 == 4, F.concat(number, F.lit(".5")))
        .when(key % 7 == 5, F.lit("123456789012345678901234567890"))
        .otherwise(number)
    )
    body = F.to_json(F.struct(F.col("text").alias("note_title"), F.col("lang").alias("note_content")))
    value = F.concat(F.expr("left(b, length(b) - 1)"), F.lit(',"likes":'), spelled, F.lit("}"))
    lines = documents(spark, sf_dir).withColumn("b", body).select(
        F.lit("counts").alias("source_file"), key.alias("source_line"), value.alias("value")
    )
    return jsonl.good_rows(jsonl.parse_lines(lines, 0)).select("source_line", "likes", "likes_raw")


@query
def jsonl_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posts as files of JSON lines, read back with their line numbers."""
    path = f"{shared_folder(spark)}/postmill-lines-{uuid.uuid4().hex}"
    lines = _json_lines(spark, sf_dir).select("source_line", "value", (F.col("source_line") % 8).alias("file"))
    dealt = lines.repartition("file").sortWithinPartitions("file", "source_line")
    dealt.drop("source_line").write.partitionBy("file").text(path)
    return jsonl.read_lines(spark, path).select("source_line", "value")


@query
def audit_with_load_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit that is written for loaded posts, with the report of their loading."""
    folder = f"{shared_folder(spark)}/postmill-audit-{uuid.uuid4().hex}"
    raw = posts(spark, sf_dir).drop("score_ai", "doc_id", "source")
    return _rounded(audit_posts(raw, folder, load_report=jsonl.load_report(_parsed(spark, sf_dir))))


# Features and models ---------------------------------------------------------


@query
def char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grams, distinct grams and the most frequent one's count, per document."""
    grams = ngrams.char_ngrams(documents(spark, sf_dir), key="doc_id")
    size = F.length("gram")
    return grams.groupBy("doc_id").agg(
        F.sum("tf").alias("grams"),
        F.count(F.lit(1)).alias("distinct_grams"),
        F.max("tf").alias("most"),
        F.sum(F.when(size == 5, F.col("tf"))).alias("five_grams"),
    )


@query
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(tfidf.vocabulary(documents(spark, sf_dir)))


@query
def top_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent grams; the limit is the feature and cuts through ties."""
    return _rounded(tfidf.vocabulary(documents(spark, sf_dir), tfidf.NgramConfig(max_features=TOP_GRAMS)))


@query
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms and weights of every document, summed up per document."""
    df = documents(spark, sf_dir)
    weights = tfidf.tfidf_table(df, tfidf.Vectorizer.fit(df), key="doc_id")
    summed = weights.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("terms"), F.sum("weight").alias("total"), F.max("weight").alias("heaviest")
    )
    return _rounded(summed)


@query
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(tfidf.class_weights(_deduped(spark, sf_dir)))


@_prepared("toxicity")
def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a real label, without duplicates, split by label."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    joined = documents(spark, sf_dir).join(labels, "doc_id").select(
        "text", F.col("toxic").alias("label"), F.lit("documents").alias("source_file"), F.col("doc_id").alias("source_line")
    )
    named = joined.withColumn("id", tx.stable_row_id(F.col("label"), F.col("text")))
    unique = settle(deduplicate(settle(named, "labelled")), "labelled-unique")
    return split.stratified_split(unique, by_domain=False, seed=SEED)


def _solved(train: DataFrame, model: md.TextClassifier) -> Column:
    return F.lit(md.largest_gradient(train, model) < GRADIENT_BOUND)


def _in_range() -> Column:
    score = F.col("score_ai")
    return F.coalesce(F.bool_and(score.isNotNull() & score.between(0.0, 1.0) & ~F.isnan(score)), F.lit(True))


@query
def train_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on the training documents, score train and validation.

    The optimum of the penalised loss is unique, so a gradient of zero proves the fit.
    """
    rows = _toxicity(spark, sf_dir)
    model, scored = train_and_score(rows)
    solved = _solved(rows.where("split = 'train'"), model)
    return settle(scored, "train-scores").groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("label").alias("ai_rows"),
        F.lit(len(model.vectorizer)).cast("bigint").alias("grams"),
        F.bool_and(solved).alias("gradient_ok"),
        _in_range().alias("scores_in_range"),
    )


@query
def predict_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inference over all documents with the model of the training documents."""
    model = md.fit_text_classifier(_toxicity(spark, sf_dir).where("split = 'train'"))
    scored = md.score_posts(documents(spark, sf_dir).select("doc_id", "text"), model)
    return scored.groupBy("doc_id").agg(_in_range().alias("scored"))


def _sweep(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    """Sizes of every fold's training and test rows and vocabulary, and whether its fit is the optimum."""
    rows = _split(spark, sf_dir)
    summary, scored, models = run_folds(rows, mode, seed=SEED)
    train = rows.where("split = 'train'")
    names = list(models)
    cutoffs = holdout.control_cutoffs(train, names, SEED).collect()
    inside = [holdout.holdout_member(name) if mode == "holdout" else holdout.control_member(name, cutoffs, SEED) for name in names]
    gradients = md.largest_gradients(train, list(models.values()), inside)
    found = [(name, len(model.vectorizer), gradient < GRADIENT_BOUND) for (name, model), gradient in zip(models.items(), gradients, strict=True)]
    fits = spark.createDataFrame(found, "held_out_family string, grams bigint, gradient_ok boolean")
    ranges = scored.groupBy(F.col("fold").alias("held_out_family")).agg(_in_range().alias("scores_in_range"))
    sizes = summary.select("held_out_family", "train_ai_rows", "test_human_rows", "test_ai_rows")
    return sizes.join(fits, "held_out_family").join(ranges, "held_out_family")


@query
def holdout_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sweep(spark, sf_dir, "holdout")


@query
def control_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sweep(spark, sf_dir, "control")


def _fixed_model(spark: SparkSession, sf_dir: str) -> md.TextClassifier:
    """A model whose coefficients follow from the code points of its grams."""
    vectorizer = tfidf.Vectorizer.fit(documents(spark, sf_dir))
    codes = [sum(place * ord(letter) for place, letter in enumerate(gram, 1)) for gram in vectorizer.grams.to_pylist()]
    return md.TextClassifier(vectorizer, (np.array(codes) % 201 - 100) / 50.0, 0.1)


@query
def fixed_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = md.score_posts(documents(spark, sf_dir), _fixed_model(spark, sf_dir))
    return _rounded(scored.select("doc_id", "score_ai"))


@query
def model_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a model that was saved and loaded."""
    path = f"{shared_folder(spark)}/postmill-model-{uuid.uuid4().hex}"
    md.save_model(spark, _fixed_model(spark, sf_dir), path)
    scored = md.score_posts(documents(spark, sf_dir), md.load_model(spark, path))
    return _rounded(scored.select("doc_id", "score_ai"))


@query
def batch_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outside scorer, here the share of letters in a text, run in batches."""

    def make_scorer() -> Callable[[list[str]], list[float]]:
        return lambda batch: [sum(map(str.isalpha, text)) / max(len(text), 1) for text in batch]

    return _rounded(md.batch_score(documents(spark, sf_dir), make_scorer).select("doc_id", "score_ai"))
