import csv
import io
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from postmill.operators import holdout, ngrams, solver, tfidf
from postmill.operators import model as md

SPLIT = "id string, text string, label int, model_family string, split string"


def split_rows(spark, humans, families, split="train", start=""):
    rows = [(f"{start}h{i}", f"human {i}", 0, None, split) for i in range(humans)]
    rows += [(f"{start}{f}{i}", f"{f} {i}", 1, f, split) for f, n in families.items() for i in range(n)]
    return spark.createDataFrame(rows, SPLIT)


def counts(df, *keys):
    return {tuple(row)[:-1]: row["count"] for row in df.groupBy(*keys).count().collect()}


def test_families_largest_first(spark):
    df = split_rows(spark, 5, {"gpt": 3, "glm": 7, "qwen": 5})
    assert holdout.list_families(df) == ["glm", "qwen", "gpt"]
    assert holdout.list_families(df, min_rows=4) == ["glm", "qwen"]
    with pytest.raises(ValueError, match="model_family"):
        holdout.list_families(df.drop("model_family"))


def all_splits(spark):
    parts = [split_rows(spark, 10, {"gpt": 10, "glm": 6, "qwen": 4}, "train", "a"),
             split_rows(spark, 4, {"gpt": 2, "glm": 2}, "val", "b"),
             split_rows(spark, 6, {"gpt": 3, "glm": 5}, "test", "c")]
    orphan = spark.createDataFrame([("o", "ai", 1, None, "train")], SPLIT)
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(orphan)


def test_holdout_fold(spark):
    df = all_splits(spark)
    got = counts(holdout.holdout_fold(df, "glm"), "split", "model_family")
    assert ("train", "glm") not in got and ("val", "glm") not in got
    # Humans stay, and so does the AI row without a family.
    assert got[("train", None)] == 11 and got[("train", "gpt")] == 10 and got[("train", "qwen")] == 4
    assert got[("test", "glm")] == 5 and got[("test", None)] == 6 and ("test", "gpt") not in got


def test_control_fold_matches_sizes_and_repeats(spark):
    df = all_splits(spark)
    control, held = holdout.control_fold(df, "glm", seed=1), holdout.holdout_fold(df, "glm")
    ai = "label = 1 and split <> 'test'"
    assert counts(control.where(ai), "split") == counts(held.where(ai), "split")
    assert control.where("split = 'train' and model_family = 'glm'").count() > 0
    test = "split = 'test'"
    assert {r["id"] for r in control.where(test).collect()} == {r["id"] for r in held.where(test).collect()}
    again = holdout.control_fold(df.repartition(3), "glm", seed=1)
    assert sorted(r["id"] for r in control.collect()) == sorted(r["id"] for r in again.collect())


@pytest.mark.parametrize("mode", ["holdout", "control"])
def test_expanded_folds_are_the_single_folds(spark, mode):
    df = all_splits(spark)
    expanded = holdout.expand_folds(df, ["gpt", "glm", "qwen"], mode, seed=2)
    for family in ("gpt", "glm", "qwen"):
        single = holdout.holdout_fold(df, family) if mode == "holdout" else holdout.control_fold(df, family, seed=2)
        assert sorted(r["id"] for r in expanded.where(F.col("fold") == family).collect()) == sorted(r["id"] for r in single.collect())
    with pytest.raises(ValueError, match="mode"):
        holdout.expand_folds(df, ["gpt"], "other")


# The published per-fold recalls: family, test AI rows, in distribution, control, holdout.
PUBLISHED = """deepseek,244,0.9057377049180328,0.8934426229508197,0.7704918032786885
gpt,249,0.9036144578313252,0.8795180722891566,0.7871485943775101
anthropic,105,0.8571428571428571,0.8571428571428571,0.8095238095238095
gemini,181,0.9668508287292816,0.9502762430939227,0.9226519337016574
glm,124,0.717741935483871,0.7016129032258065,0.6774193548387096
qwen,183,0.9453551912568308,0.9344262295081968,0.918032786885246"""


def test_decomposition_of_the_published_folds(spark):
    rows = [(r[0], int(r[1]), *map(float, r[2:])) for r in csv.reader(io.StringIO(PUBLISHED))]
    base = spark.createDataFrame(rows, "held_out_family string, test_ai_rows int, seen double, c double, h double")
    extra = {name: F.lit(0) for name in ("auroc", "false_positives_human", "missed_ai_posts", "train_ai_rows")}
    table = holdout.decompose(
        base.withColumn("recall_ai_holdout", F.col("h")).withColumns(extra).drop("seen", "c", "h"),
        base.select("held_out_family", F.col("c").alias("recall_ai_control")),
        base.select(F.col("held_out_family").alias("model_family"), F.col("seen").alias("recall_ai")),
    ).collect()
    assert [row["held_out_family"] for row in table] == ["deepseek", "gpt", "anthropic", "gemini", "glm", "qwen"]
    assert round(sum(row["cost_of_new_generator"] for row in table) / 6, 4) == 0.0552
    assert round(sum(row["cost_of_less_data"] for row in table) / 6, 4) == 0.0133
    assert table[0]["recall_drop"] == pytest.approx(0.1352459016393443)


def test_baseline_join(spark):
    seen = spark.createDataFrame([("glm", 0.9)], "model_family string, recall_ai double")
    control = spark.createDataFrame([("glm", 0.85), ("new", 0.5)], "held_out_family string, recall_ai_control double")
    got = {r["held_out_family"]: r["recall_drop"] for r in holdout.attach_baseline(control, seen).collect()}
    assert got["glm"] == pytest.approx(0.05) and got["new"] is None
    assert holdout.attach_baseline(control, None) is control


def brute_grams(text, shortest, longest):
    text = re.sub(r"\s\s+", " ", text.lower())
    return Counter(text[i : i + n] for n in range(shortest, longest + 1) for i in range(len(text) - n + 1))


def texts(spark):
    rng = random.Random(5)
    pool = ["ab", "Ab ", "中文", "😊", "\n\n", "\x00", "é", "the ", "a", "ΑΣ "]
    values = ["".join(rng.choice(pool) for _ in range(rng.randrange(0, 40))) for _ in range(60)] + ["", None]
    return values, spark.createDataFrame(list(enumerate(values)), "id int, text string").repartition(3)


@pytest.mark.parametrize("chunk", [20, 400_000])
def test_grams_against_brute_force(spark, chunk, monkeypatch):
    monkeypatch.setattr(ngrams, "CHUNK_CHARS", chunk)
    values, df = texts(spark)
    wanted = {(i, g): n for i, v in enumerate(values) for g, n in brute_grams(v or "", 2, 5).items()}
    got = {(r["id"], r["gram"]): r["tf"] for r in ngrams.char_ngrams(df).collect()}
    assert got == wanted
    counted = {r["gram"]: (r["df"], r["cf"]) for r in ngrams.gram_counts(df).collect()}
    assert counted == {
        g: (sum(k[1] == g for k in wanted), sum(n for k, n in wanted.items() if k[1] == g)) for g in {k[1] for k in wanted}}


def test_large_alphabets_are_renumbered():
    rng = random.Random(1)
    text = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(9000))
    grams = ngrams.count_grams([text, text[:50]], 2, 6)
    words = grams.words.to_pylist()
    got = {(int(t), words[w]): int(n) for w, t, n in zip(grams.word, grams.text, grams.times, strict=True)}
    assert got == {(i, g): n for i, v in enumerate((text, text[:50])) for g, n in brute_grams(v, 2, 6).items()}


def test_tfidf_by_hand(spark):
    df = spark.createDataFrame([(0, "abab"), (1, "abc"), (2, "zz"), (3, "abz")], "id int, text string")
    config = tfidf.NgramConfig(2, 2, min_df=2, max_df=0.95)
    assert [tuple(r) for r in tfidf.vocabulary(df, config).select("gram", "df", "cf").collect()] == [("ab", 3, 4)]
    one = tfidf.NgramConfig(1, 2, min_df=1, max_df=1.0)
    rows = tfidf.tfidf_table(df, tfidf.Vectorizer.fit(df, one)).collect()
    assert sum(r["weight"] ** 2 for r in rows if r["id"] == 0) == pytest.approx(1)
    grams = [brute_grams(t, 1, 2) for t in ("abab", "abc", "zz", "abz")]
    def raw(i, g):
        return (1 + math.log(grams[i][g])) * (math.log(5 / (1 + sum(g in x for x in grams))) + 1)
    norm = math.sqrt(sum(raw(0, g) ** 2 for g in grams[0]))
    assert {r["gram"]: r["weight"] for r in rows if r["id"] == 0} == pytest.approx({g: raw(0, g) / norm for g in grams[0]})
    with pytest.raises(ValueError, match="vocabulary is empty"):
        tfidf.Vectorizer.fit(spark.createDataFrame([(0, "ab"), (1, "cd"), (2, "ef"), (3, "gh")], "id int, text string"), tfidf.NgramConfig(2, 2))
    top = tfidf.vocabulary(df, tfidf.NgramConfig(1, 2, 1, 1.0, True, 2)).collect()
    assert sorted((r["gram"], r["cf"]) for r in top) == [("a", 4), ("ab", 4)]


def labelled(spark, n=60):
    rng = random.Random(2)
    words = {0: ["cat ", "dog ", "sun "], 1: ["log ", "sum ", "cut "]}
    rows = []
    for i in range(n):
        label = int(i % 4 == 0)
        pool = words[label] * 2 + words[1 - label]
        rows.append((f"r{i}", "".join(rng.choice(pool) for _ in range(12)), label))
    return spark.createDataFrame(rows, "id string, text string, label int")


def test_fit_reaches_the_penalised_optimum(spark):
    df = labelled(spark)
    config = tfidf.NgramConfig(2, 3, 1, 1.0)
    model = md.fit_text_classifier(df, config, md.ClassifierConfig(tol=1e-12))
    rows = df.orderBy("id").collect()
    text, term, weight = model.vectorizer.weigh([ngrams.analyze(r["text"]) for r in rows])
    x = np.zeros((len(rows), len(model.vectorizer) + 1))
    x[text, term], x[:, -1] = weight, 1.0
    y = np.array([2 * r["label"] - 1 for r in rows])
    class_weight = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(y * (x @ beta)))
        gradient = beta - x.T @ (class_weight * y * p)
        hessian = np.eye(len(beta)) + (x * (class_weight * p * (1 - p))[:, None]).T @ x
        beta -= np.linalg.solve(hessian, gradient)
    assert np.abs(np.append(model.coefficients, model.intercept) - beta).max() < 1e-4


def test_score_save_load_and_registry(spark, tmp_path):
    df = labelled(spark)
    model = md.fit_text_classifier(df, tfidf.NgramConfig(1, 2, 1, 1.0, True, 100))
    scored = {r["id"]: r["score_ai"] for r in md.score_posts(df, model).collect()}
    assert all(0 <= s <= 1 for s in scored.values())
    right = sum((scored[r["id"]] >= 0.5) == bool(r["label"]) for r in df.collect())
    assert right >= 50
    md.save_model(spark, model, str(tmp_path / "m"))
    loaded = md.load_model(spark, str(tmp_path / "m"))
    assert {r["id"]: r["score_ai"] for r in md.score_posts(df, loaded).collect()} == pytest.approx(scored)
    assert md.read_metadata(spark, str(tmp_path / "m"))["model_input_columns"] == ["text"]
    unknown = spark.createDataFrame([("t", "zzzz\x01")], "id string, text string")
    assert md.score_posts(unknown, model).first()["score_ai"] == pytest.approx(1 / (1 + math.exp(-model.intercept)))
    both = df.select("id", md.score_all_column(spark, [model, loaded]).alias("s")).first()["s"]
    assert both[0] == both[1]
    assert md.predict_labels(df, model).where("pred_label not in (0, 1)").isEmpty()
    with pytest.raises(KeyError, match="tfidf_logreg"):
        md.get_trainer("unknown")
    with pytest.raises(ValueError, match="both labels"):
        md.fit_text_classifier(df.where("label = 0"))


def test_outside_scorer_gets_small_batches(spark):
    df = spark.range(50).select("id", F.col("id").cast("string").alias("text"))

    def make_scorer():
        def score(batch):
            assert 0 < len(batch) <= 7
            return [int(text) / 100 for text in batch]

        return score

    got = md.batch_score(df, make_scorer, batch_size=7).collect()
    assert all(row["score_ai"] == row["id"] / 100 for row in got)
    assert md.batch_score(df.where("id < 0"), make_scorer).count() == 0


def test_places_of_grams_in_a_vocabulary():
    rng = random.Random(3)
    wide = [chr(c) for c in range(0x4E00, 0x9FFF)] + ["\U0001f600", "é"]
    for texts in ([""], ["abab", "", "bab\x00"], ["".join(rng.choices(wide, k=9000)) for _ in range(20)]):
        grams = ngrams.count_grams(texts, 1, 6)
        words = grams.words.to_pylist()
        counted = Counter((text, text_of[at : at + n]) for text, text_of in enumerate(texts) for n in range(1, 7) for at in range(len(text_of) - n + 1))
        assert {(t, words[w]): k for w, t, k in zip(grams.word, grams.text, grams.times)} == counted
        known = [*words[::3], "zq", "\U0001f601a", "abcdefgh"]
        rng.shuffle(known)
        where = {gram: place for place, gram in enumerate(known)}
        assert grams.places(ngrams.GramIndex(pa.array(known, pa.large_string()))).tolist() == [where.get(w, -1) for w in words]


def test_sums_of_grams_leave_in_few_rows(spark):
    # 40 texts of 50,000 characters are two parts, not five of 400,000 characters, and their sums are whole.
    text = "".join(random.Random(4).choices("abcdefgh", k=50_000))
    assert sum(1 for _ in ngrams.chunks([text] * 40, ngrams.SUM_CHARS)) == 2
    df = spark.range(40, numPartitions=1).select(F.lit(text).alias("text"))
    found = ngrams.gram_counts(df, 2, 2).collect()
    assert {r["df"] for r in found} == {40} and sum(r["cf"] for r in found) == 40 * (len(text) - 1)


def test_blocks_of_a_fit_are_small_and_in_small_row_groups(spark, tmp_path):
    # A hundred blocks were buffered as one row group, at 16 bytes an entry.
    letters = [chr(c) for c in range(0x61, 0x7A)]
    rng = random.Random(5)
    text = [F.lit("".join(rng.choices(letters, k=400_000))) for _ in range(2)]
    df = spark.range(12, numPartitions=1).select(F.when(F.col("id") % 2 == 0, text[0]).otherwise(text[1]).alias("text"), (F.col("id") % 2).alias("label"))
    grams = pa.array([a + b + c + d for a in letters for b in letters for c in letters for d in letters], pa.large_string())
    fold = solver.Fold((), np.ones(len(grams)), (1.0, 1.0), 12.0)
    blocks = solver.design_blocks(df, F.lit(0), grams, (4, 4), True, [fold])
    files = [pq.ParquetFile(name[len("file:") :]).metadata for name in blocks.table.inputFiles()]
    assert sum(f.num_rows for f in files) == 12
    assert max(f.row_group(i).total_byte_size for f in files for i in range(f.num_row_groups)) < 8 << 20
    names = [name for name, kind in blocks.table.dtypes if kind == "binary"]
    sizes = blocks.table.agg(F.sum("entries"), F.sum(sum((F.length(name) for name in names), F.lit(0)))).first()
    assert sizes[1] < 8 * sizes[0]


def test_a_fit_takes_few_passes(spark, monkeypatch):
    # The gradient of the intercept was the last to fall: 24 passes where these take 9.
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 8))) for _ in range(300)]
    rows = [(" ".join(rng.choices(words[:200] if i % 8 else words[100:], k=60)), int(i % 8 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "text string, label int")
    passes, over = [], solver._over_blocks
    monkeypatch.setattr(solver, "_over_blocks", lambda *args: passes.append(1) or over(*args))
    model = md.fit_text_classifier(df, tfidf.NgramConfig(2, 4))
    assert len(passes) <= 14
    assert md.largest_gradient(df, model) < 1e-5


def test_gradients_of_several_models_from_one_pass(spark):
    df = labelled(spark).withColumn("part", F.substring("id", 2, 9).cast("int") % 3)
    inside = [F.col("part") != 1, F.col("part") != 2]
    configs = [md.ClassifierConfig(c=2.0, tol=1e-2), md.ClassifierConfig(tol=1e-2, balanced=False)]
    models = [md.fit_text_classifier(df.where(own), tfidf.NgramConfig(2, 3, 2, 1.0), config) for own, config in zip(inside, configs)]
    found = md.largest_gradients(df, models, inside)
    for at, (own, model) in enumerate(zip(inside, models)):
        rows = df.where(own).collect()
        text, term, weight = model.vectorizer.weigh([ngrams.analyze(r["text"]) for r in rows])
        x = np.zeros((len(rows), len(model.vectorizer) + 1))
        x[text, term], x[:, -1] = weight, 1.0
        y, beta = np.array([r["label"] for r in rows]), np.append(model.coefficients, model.intercept)
        scale = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())) if at == 0 else np.ones(len(y))
        gradient = beta / configs[at].c + x.T @ (scale * (1 / (1 + np.exp(-x @ beta)) - y))
        assert found[at] == pytest.approx(np.abs(gradient).max() / scale.sum())
        assert found[at] == pytest.approx(md.largest_gradient(df.where(own), model))
    assert found[0] != pytest.approx(found[1])


def test_tiles_hold_the_counts_of_their_texts(spark):
    rng = random.Random(6)
    values = ["".join(rng.choices("abcé", k=rng.choice([0, 1, 40, 3000]))) for _ in range(50)]
    df = spark.createDataFrame([(v, i % 2, i) for i, v in enumerate(values)], "text string, label int, place int").coalesce(1)
    grams = pa.array(sorted({g for v in values for g in brute_grams(v, 2, 4)})[::2], pa.large_string())
    fold = solver.Fold((), np.ones(len(grams)), (1.0, 1.0), 50.0)
    blocks = solver.design_blocks(df, F.col("place"), grams, (2, 4), False, [fold])
    seen = {}
    for block in blocks.table.collect():
        numbers, at = np.frombuffer(block["groups"], "<i4"), 0
        for tile in solver._tiles(tuple(block), [0], [fold], False, np.float64):
            assert tile.dense.shape[1] <= solver.TILE_ROWS and (np.diff(tile.term) > 0).all()
            for column in tile.dense.T:
                seen[numbers[at]] = {grams[int(t)].as_py(): n for t, n in zip(tile.term, column) if n}
                at += 1
    known = set(grams.to_pylist())
    assert seen == {i: {g: n for g, n in brute_grams(v, 2, 4).items() if g in known} for i, v in enumerate(values)}
