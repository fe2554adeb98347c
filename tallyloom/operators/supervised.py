"""Target and feature choice, model comparison, feature importance, metrics."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import FeatureHasher, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.columns import display_name, is_numeric
from tallyloom.functions.exprs import as_number, contains_any, is_missing, literal, ratio, titled
from tallyloom.functions.parallel import side_by_side
from tallyloom.operators.prep import impute_median, impute_mode, stratified_split, zscale
from tallyloom.operators.profile import NUMERIC_TYPES
from tallyloom.operators.stats import binned_relationship, feature_target_corr
from tallyloom.session import materialise

# Names that suggest a prediction target, best first.
TARGET_KEYWORDS = [
    "target", "churn", "attrition", "status", "outcome", "converted", "default", "sales", "revenue", "profit",
    "score", "performance", "rating", "satisfaction", "salary", "price", "amount", "total", "grade",
]
BATCH_KEYWORDS = [
    "grade", "score", "churn", "target", "status", "profit", "amount", "revenue", "outcome", "converted",
]
BATCH_EXCLUDED = ["id", "code", "date", "time", "timestamp", "invoice", "index"]
KEY_SUFFIXES = ["id", "uuid", "key", "code"]

SEED = 42
LEAST_ROWS = 15
# An indexer keeps all its levels on the driver: with more levels a category is refused
# unless the caller asks for hashing. A classifier trains a model per class.
MOST_LEVELS = 10_000
MOST_CLASSES = 100
#: Rows of a task of a fit. Stored features are a few small files, and a scan makes few tasks of those.
FIT_ROWS = 25_000


# --- choosing targets and features -----------------------------------------


def _ends_with(suffixes: Sequence[str]):
    name, test = F.lower("column_name"), F.lit(False)
    for suffix in suffixes:
        test = test | name.endswith(suffix)
    return test


def candidate_targets(profile: DataFrame) -> DataFrame:
    """Columns that could be predicted, with their distinct counts."""
    numeric = F.col("data_type").isin(NUMERIC_TYPES)
    key_like = _ends_with(KEY_SUFFIXES) & (F.col("unique_count") > F.col("row_count") * 0.8)
    return profile.where(~key_like & (F.col("unique_count") > 1)).select(
        "dataset_id",
        "column_name",
        titled(F.col("column_name")).alias("display_name"),
        F.when(numeric | (F.col("data_type") == "boolean"), "numeric").otherwise("categorical").alias("data_type"),
        "unique_count",
        (contains_any(F.lower("column_name"), TARGET_KEYWORDS) | (numeric & (F.col("unique_count") >= 3))).alias(
            "is_candidate"
        ),
    )


def predictor_columns(profile: DataFrame, target: str) -> DataFrame:
    """Usable features: not the target, no near-unique keys, no constants."""
    key_like = _ends_with([*KEY_SUFFIXES, "index"]) & (F.col("unique_count") > F.col("row_count") * 0.8)
    return profile.where((F.col("column_name") != target) & ~key_like & (F.col("unique_count") > 1))


def _best_named(names: Sequence[str], keywords: Sequence[str]) -> str | None:
    """The name with the earliest keyword in it; of several, the first."""
    ranks = {name: min((i for i, word in enumerate(keywords) if word in name.lower()), default=None) for name in names}
    named = [name for name in names if ranks[name] is not None]
    return min(named, key=ranks.get, default=None)


def detect_target(names: Sequence[str], numeric: Sequence[str], distinct: Mapping[str, int]) -> str:
    """The most target-like column: by keyword, else the last varying measure, else the
    last column. Identifiers don't count."""

    def no_ids(columns: Sequence[str]) -> list[str]:
        return [c for c in columns if not c.lower().endswith("id")]

    varying = [c for c in no_ids(numeric) if distinct.get(c, 0) > 1]
    return _best_named(no_ids(names), TARGET_KEYWORDS) or [*names[-1:], *varying][-1]


def pick_batch_target(names: Sequence[str]) -> str:
    """Target for unattended training of many tables; identifiers and dates are out."""
    usable = [n for n in names if not contains_word(n, BATCH_EXCLUDED)]
    return _best_named(usable, BATCH_KEYWORDS) or [*names[-1:], *usable][-1]


def contains_word(name: str, words: Sequence[str]) -> bool:
    return any(word in name.lower() for word in words)


def default_features(names: Sequence[str], target: str) -> list[str]:
    others = [n for n in names if n != target]
    return [n for n in others if not n.lower().endswith(("id", "code"))] or others


def task_of(df: DataFrame, target: str, task: str | None = None) -> str:
    """Regression for a numeric target with more than ten values."""
    if task:
        return task.lower()
    if not is_numeric(df.schema[target].dataType):
        return "classification"
    values = df.select(target).dropna().distinct().limit(11).count()
    return "regression" if values > 10 else "classification"


# --- encoding --------------------------------------------------------------


@dataclass
class Encoded:
    """Rows with ``features`` and ``label``, and the source column of each slot."""

    rows: DataFrame
    slots: list[str]
    classes: list[str]


def encode(
    df: DataFrame,
    key: str,
    target: str,
    features: Sequence[str],
    task: str,
    flag: str | None = None,
    hash_slots: int | None = None,
    max_classes: int = MOST_CLASSES,
) -> Encoded:
    """Impute, scale and encode. With ``flag``, everything is learned from the flagged rows
    only and unseen categories become all zeros.

    Categories are one-hot encoded, all of their levels; one with more than ``MOST_LEVELS``
    raises. With ``hash_slots``, every category is hashed into so many slots instead. A
    target of more than ``max_classes`` classes raises.
    """
    numbers = [f for f in features if is_numeric(df.schema[f].dataType)]
    words = [f for f in features if f not in numbers]
    keep = [flag] if flag else []
    casts = [F.col(f).cast("double").alias(f"n{i}") for i, f in enumerate(numbers)]
    casts += [F.col(f).cast("string").alias(f"w{i}") for i, f in enumerate(words)]
    label = F.col(target).cast("double" if task == "regression" else "string").alias("_target")
    rows = df.select(F.col(key).alias("_key"), label, *keep, *casts)
    number_cols, word_cols = [f"n{i}" for i in range(len(numbers))], [f"w{i}" for i in range(len(words))]

    def seen(frame: DataFrame) -> DataFrame:
        return frame.where(flag) if flag else frame

    if numbers:
        rows = impute_median(rows, number_cols, seen(rows))
        rows = zscale(rows, number_cols, seen(rows))
    if words:
        rows = impute_mode(rows, word_cols, seen(rows))
    rows = materialise(rows, "encoded")

    listed, hashed = (word_cols, []) if hash_slots is None else ([], word_cols)
    for w, name in zip(listed, words):
        if seen(rows).select(w).distinct().limit(MOST_LEVELS + 1).count() > MOST_LEVELS:
            raise ValueError(f"Column '{name}' has more than {MOST_LEVELS} levels; leave it out or set hash_slots.")
    if task == "classification":
        classes_seen = rows.select("_target").distinct().limit(max_classes + 1).count()
        if classes_seen > max_classes:
            raise ValueError(f"Target column '{target}' has more than {max_classes} classes.")
    stages, inputs = [], list(number_cols)
    if listed:
        stages.append(
            StringIndexer(
                inputCols=listed,
                outputCols=[f"{w}_i" for w in listed],
                handleInvalid="keep",
                stringOrderType="alphabetAsc",
            )
        )
        stages.append(OneHotEncoder(inputCols=[f"{w}_i" for w in listed], outputCols=[f"{w}_v" for w in listed]))
        inputs += [f"{w}_v" for w in listed]
    for w in hashed:
        stages.append(FeatureHasher(inputCols=[w], outputCol=f"{w}_v", numFeatures=hash_slots))
        inputs.append(f"{w}_v")
    if task == "classification":
        stages.append(
            StringIndexer(inputCol="_target", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="error")
        )
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    # The label indexer must know every class; the other stages learn from the flagged rows.
    fitted, current = [], rows
    for stage in stages:
        whole = isinstance(stage, StringIndexer) and stage.isSet(stage.inputCol)
        model = stage.fit(current if whole else seen(current)) if hasattr(stage, "fit") else stage
        current = model.transform(current)
        fitted.append(model)
    if task == "regression":
        current = current.withColumn("label", F.col("_target"))

    sources = dict(zip(number_cols, numbers)) | dict(zip(word_cols, words))
    slots = [sources[c] for c in number_cols]
    if listed:
        for w, labels in zip(listed, fitted[0].labelsArray):
            slots += [sources[w]] * len(labels)
    for w in hashed:
        slots += [sources[w]] * hash_slots
    classes = list(fitted[-2].labels) if task == "classification" else []
    slim = current.select("_key", *keep, "label", "features")
    return Encoded(materialise(slim, "features"), slots, classes)


def spread(rows: DataFrame) -> DataFrame:
    """The rows over tasks of about ``FIT_ROWS``, evenly whatever the keys; those of one task stay where they are."""
    tasks = math.ceil(rows.count() / FIT_ROWS)
    return rows.repartition(tasks) if tasks > 1 else rows


# --- metrics ---------------------------------------------------------------


def classification_metrics(predicted: DataFrame) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 of (label, prediction)."""
    cells = predicted.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    none = F.lit(0).cast("bigint")
    sides = cells.select(
        F.inline(
            F.array(
                F.struct(F.col("label").alias("cls"), F.col("n").alias("support"), none.alias("called"), hit.alias("hits")),
                F.struct(F.col("prediction").alias("cls"), none.alias("support"), F.col("n").alias("called"), none.alias("hits")),
            )
        )
    )
    each = sides.groupBy("cls").agg(*[F.sum(c).alias(c) for c in ("support", "called", "hits")])
    precision = ratio(F.col("hits"), F.col("called"))
    recall = ratio(F.col("hits"), F.col("support"))
    f1 = ratio(2 * precision * recall, precision + recall)
    weight = F.col("support").cast("double")

    def weighted(value):
        return F.sum(weight * value) / F.sum(weight)

    return each.agg(
        (F.sum("hits").cast("double") / F.sum("support")).alias("accuracy"),
        weighted(precision).alias("precision"),
        weighted(recall).alias("recall"),
        weighted(f1).alias("f1_score"),
    )


def regression_metrics(predicted: DataFrame) -> DataFrame:
    """MAE, RMSE and R2 of (label, prediction)."""
    error = (F.col("label") - F.col("prediction")).cast("double")
    squared = F.sum(error * error)
    spread = F.var_pop("label") * F.count(F.lit(1))
    return predicted.agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(squared / F.count(F.lit(1))).alias("rmse"),
        (F.lit(1.0) - F.try_divide(squared, spread)).alias("r2_score"),
    )


# --- comparison ------------------------------------------------------------


@dataclass
class Comparison:
    """The leaderboard (a row per model) and what it was trained on."""

    leaderboard: DataFrame
    target: str
    task: str
    features: list[str]
    train_samples: int
    test_samples: int
    best_model: str


def _classifiers(classes: int, train_rows: int, trees: int, boosts: int, depth: int) -> dict:
    boosted = GBTClassifier(maxIter=boosts, maxDepth=3, stepSize=0.1, seed=SEED)
    return {
        "Logistic Regression": LogisticRegression(maxIter=1000, regParam=1.0 / train_rows, standardization=False),
        "Random Forest Classifier": RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED),
        "Gradient Boosting Classifier": boosted if classes == 2 else OneVsRest(classifier=boosted),
    }


def _regressors(train: DataFrame, train_rows: int, trees: int, boosts: int, depth: int) -> dict:
    spread = train.agg(F.stddev_pop("label")).first()[0] or 0.0
    return {
        "Linear Regression": LinearRegression(solver="normal"),
        # alpha = 1 on a sum of squares equals this penalty on Spark's scaled mean.
        "Ridge Regression": LinearRegression(
            solver="normal", regParam=spread / train_rows, elasticNetParam=0.0, standardization=False
        ),
        "Random Forest Regressor": RandomForestRegressor(
            numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", seed=SEED
        ),
        "Gradient Boosting Regressor": GBTRegressor(maxIter=boosts, maxDepth=3, stepSize=0.1, seed=SEED),
    }


def compare_models(
    df: DataFrame,
    key: str,
    target: str,
    features: Sequence[str] | None = None,
    task: str | None = None,
    trees: int = 100,
    boosts: int = 80,
    depth: int = 8,
    hash_slots: int | None = None,
    max_classes: int = MOST_CLASSES,
) -> Comparison:
    """Train the candidate models on 80 % of the rows and score them on the rest; see
    ``encode`` for the limits on categories and classes."""
    if target not in df.columns:
        raise ValueError(f"Target column '{target}' not found in dataset.")
    known = df.where(~is_missing(df, target))
    if known.limit(LEAST_ROWS).count() < LEAST_ROWS:
        raise ValueError(
            "Dataset has too few non-null target rows (minimum 15 required for supervised ML)."
        )
    features = list(features or default_features([c for c in df.columns if c != key], target))
    task = task_of(known, target, task)
    stratify = None
    if task == "classification":
        sizes = known.groupBy(target).count().limit(11).collect()
        if len(sizes) <= 10 and min(r["count"] for r in sizes) >= 2:
            stratify = target
    split = stratified_split(known, key, stratify, seed=SEED)
    encoded = encode(split, key, target, features, task, "is_train", hash_slots, max_classes)
    train = spread(encoded.rows.where("is_train")).persist()
    test = encoded.rows.where("NOT is_train")
    try:
        train_rows, test_rows = train.count(), test.count()
        if task == "classification":
            models = _classifiers(len(encoded.classes), train_rows, trees, boosts, depth)
        else:
            models = _regressors(train, train_rows, trees, boosts, depth)

        def score(name: str, model) -> dict:
            scored = model.fit(train).transform(test)
            pairs = scored.select("label", "prediction")
            if task == "classification":
                found = classification_metrics(pairs).first().asDict()
                row = {m: found[m] * 100 for m in found}
                row["roc_auc"] = (
                    BinaryClassificationEvaluator(rawPredictionCol="rawPrediction").evaluate(scored)
                    if len(encoded.classes) == 2
                    else None
                )
                row["primary_metric"] = row["f1_score"]
            else:
                row = regression_metrics(pairs).first().asDict()
                row["primary_metric"] = row["r2_score"]
            return {"model_name": name, "task": task, **row}

        board = side_by_side(df.sparkSession, [partial(score, *entry) for entry in models.items()])
    finally:
        train.unpersist()
    metrics = [m for m in board[0] if m not in ("model_name", "task")]
    schema = "model_name string, task string, " + ", ".join(f"{m} double" for m in metrics)
    table = df.sparkSession.createDataFrame(
        [tuple([b["model_name"], b["task"], *[b[m] for m in metrics]]) for b in board], schema
    )
    best = max(board, key=lambda b: b["primary_metric"])["model_name"]
    return Comparison(
        table.orderBy(F.desc("primary_metric")), target, task, features, train_rows, test_rows, best
    )


def metrics_long(leaderboard: DataFrame) -> DataFrame:
    """(model_name, task, metric_name, metric_value, split), a row per model and metric."""
    metrics = [c for c in leaderboard.columns if c not in ("model_name", "task", "primary_metric")]
    return (
        leaderboard.unpivot(["model_name", "task"], metrics, "metric_name", "metric_value")
        .where(F.col("metric_value").isNotNull())
        .withColumn("split", F.lit("test"))
    )


# --- importance ------------------------------------------------------------


@dataclass
class Importance:
    features: DataFrame
    target: str
    task: str
    score: float


def feature_importance(
    df: DataFrame, key: str, target: str, features: Sequence[str], distinct: Mapping[str, int], trees: int = 100
) -> Importance:
    """Impurity importance of each source column in a random forest, its correlation
    with the target, and what that means in words.

    The vector has a slot per number and category level; slots are added up per
    source column.
    """
    known = df.where(~is_missing(df, target))
    task = task_of(known, target)
    encoded = encode(known, key, target, features, task)
    rows = spread(encoded.rows).persist()
    try:
        if task == "classification":
            forest = RandomForestClassifier(numTrees=trees, maxDepth=8, seed=SEED)
        else:
            forest = RandomForestRegressor(numTrees=trees, maxDepth=8, featureSubsetStrategy="all", seed=SEED)
        model = forest.fit(rows)
        scored = model.transform(rows).select("label", "prediction")
        found = (classification_metrics if task == "classification" else regression_metrics)(scored).first()
        score = float(found["accuracy" if task == "classification" else "r2_score"])
    finally:
        rows.unpersist()
    shares = dict.fromkeys(features, 0.0)
    for slot, value in zip(encoded.slots, model.featureImportances.toArray()):
        shares[slot] += float(value)
    whole = sum(shares.values()) or 1.0
    spark = df.sparkSession
    listed = spark.createDataFrame(
        [
            (
                i,
                name,
                display_name(name),
                shares[name] / whole,
                "numeric" if is_numeric(df.schema[name].dataType) else "categorical",
                int(distinct.get(name, 0)),
            )
            for i, name in enumerate(features)
        ],
        "i int, name string, display_name string, importance double, data_type string, unique_values bigint",
    )
    correlations = feature_target_corr(known, target, features, key)
    return Importance(_describe(listed, correlations, target), target, task, score)


def driver_relationships(df: DataFrame, drivers: Importance, top_k: int = 3) -> DataFrame | None:
    """(feature, bin, feature_avg, target_avg, rows, low, high): how the target runs along
    the main drivers. Only numbers are binned; a text target reads as numbers where it can.
    None if no main driver is a number."""
    target = df.withColumn("_goal", as_number(df, drivers.target))
    main = drivers.features.where(F.col("rank") <= top_k).orderBy("rank").select("name").collect()
    found = None
    for name in (r["name"] for r in main if is_numeric(df.schema[r["name"]].dataType)):
        binned = binned_relationship(target, name, "_goal").where("bin IS NOT NULL").withColumn("feature", F.lit(name))
        found = binned if found is None else found.unionByName(binned)
    return found


def _describe(listed: DataFrame, correlations: DataFrame, target: str) -> DataFrame:
    """Direction, impact tier, sentence and rank; one row per feature."""
    r, share = F.col("correlation"), F.col("importance")
    goal = literal(display_name(target))
    direction = F.when(r > 0.08, "positive").when(r < -0.08, "negative").otherwise("neutral")
    tier = (
        F.when(share >= 0.20, "critical").when(share >= 0.10, "high").when(share >= 0.05, "moderate").otherwise("low")
    )
    pct = share * 100
    sentence = (
        F.when(
            direction == "positive",
            F.format_string(
                f"Increases in '%s' strongly correlate with higher {goal} (%+.2f). "
                "Represents %.1f%% of total predictive power.",
                "display_name",
                r,
                pct,
            ),
        )
        .when(
            direction == "negative",
            F.format_string(
                f"Higher '%s' values act as an inverse drag on {goal} (%+.2f). "
                "Key lever accounting for %.1f%% of variance.",
                "display_name",
                r,
                pct,
            ),
        )
        .otherwise(
            F.format_string(
                "'%s' exerts a non-linear influence accounting for %.1f%% of predictive importance on " + goal + ".",
                "display_name",
                pct,
            )
        )
    )
    joined = listed.join(correlations.withColumnRenamed("feature", "name"), "name", "left")
    return (
        joined.withColumn("correlation", F.coalesce("correlation", F.lit(0.0)))
        .withColumns(
            {
                "importance_pct": pct,
                "direction": direction,
                "impact_level": tier,
                "summary_insight": sentence,
                "rank": F.row_number().over(W.orderBy(F.desc("importance"), "i")),
            }
        )
        .drop("i")
    )


def driver_report(importance: DataFrame) -> DataFrame:
    """Recommendations from the main, the strongest positive and the strongest negative
    driver; reads a frame with one row per feature."""
    up, down = F.col("direction") == "positive", F.col("direction") == "negative"
    row = F.struct("name", "display_name", "importance_pct", "correlation")
    picked = importance.agg(
        F.min_by(row, "rank").alias("main"),
        F.max_by(F.when(up, row), F.when(up, F.struct("correlation", -F.col("rank")))).alias("up"),
        F.min_by(F.when(down, row), F.when(down, F.struct("correlation", "rank"))).alias("down"),
        F.min_by("name", F.when(F.col("rank") == 2, 1)).alias("second"),
    )

    def entry(place: int, test, title, priority: str, action, impact: str):
        return F.when(
            test,
            F.struct(
                F.lit(place).alias("place"),
                title.alias("title"),
                F.lit(priority).alias("priority"),
                action.alias("action"),
                F.lit(impact).alias("impact"),
            ),
        )

    entries = F.array_compact(
        F.array(
            entry(
                1,
                F.col("main").isNotNull(),
                F.format_string("Focus Strategy on Primary Lever: %s", "main.display_name"),
                "high",
                F.format_string(
                    "Optimize business workflows impacting '%s', which commands %.1f%% of predictive sensitivity.",
                    "main.display_name",
                    "main.importance_pct",
                ),
                "High Impact",
            ),
            entry(
                2,
                F.col("up").isNotNull() & (F.col("up.name") != F.col("main.name")),
                F.format_string("Scale Positive Catalyst: %s", "up.display_name"),
                "medium",
                F.format_string(
                    "Incentivize higher values of '%s' (%+.2f correlation) to sustainably lift target outcomes.",
                    "up.display_name",
                    "up.correlation",
                ),
                "Growth Lever",
            ),
            entry(
                3,
                F.col("down").isNotNull(),
                F.format_string("Mitigate Friction Point: %s", "down.display_name"),
                "high",
                F.format_string(
                    "Audit negative drag from '%s' (%+.2f correlation) and establish guardrails to curb friction.",
                    "down.display_name",
                    "down.correlation",
                ),
                "Risk Reduction",
            ),
            entry(
                4,
                F.col("main").isNotNull(),
                F.lit("Automate Cohort Segmentation Based on Top Features"),
                "medium",
                F.format_string(
                    "Group records along dimensions '%s' and '%s' for segmented operational playbooks.",
                    F.col("main.name"),
                    F.coalesce("second", F.lit("target")),
                ),
                "Operational Efficiency",
            ),
        )
    )
    return picked.select(F.inline(entries))
